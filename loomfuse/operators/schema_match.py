"""Matching source fields to target fields: scores of name pairs in stages, best matches, conflicts and candidates."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfuse.functions import fixed, text
from loomfuse.functions.kernels import pair_kernel
from loomfuse.operators.keys import GENERATED
from loomfuse.operators.lexicon import canonical
from loomfuse.operators.scratch import kept

LONGEST_ATOM = 8
#: Least score by which a column stands for a name that it doesn't have.
LIKE = 80.0


def _atoms(terms: list[str]):
    """Names cut greedily into dictionary words, characters that begin none skipped."""
    known = frozenset(terms)

    def cut(name: str) -> list[str]:
        at, found = 0, []
        while at < len(name):
            word = next((name[at : at + n] for n in range(min(LONGEST_ATOM, len(name) - at), 0, -1) if name[at : at + n] in known), None)
            if word:
                found.append(word)
            at += len(word or " ")
        return found

    @F.pandas_udf("array<string>")
    def atoms(names: pd.Series) -> pd.Series:
        return names.fillna("").map(cut)

    return atoms


def _parts(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("/")), F.filter(F.transform(F.split(c, "/", -1), text.strip), lambda p: p != "")).otherwise(F.array().cast("array<string>"))


def _sub_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of parts that a pair's score asks for: (src, tgt, role, i, sub_src, sub_tgt)."""
    s, t = F.col("src"), F.col("tgt")
    many = F.size("tgt_atoms") > 1
    path = F.contains(s, F.lit(">")) | F.contains(t, F.lit(">"))
    row = lambda role, i, a, b: F.struct(F.lit(role).alias("role"), i.cast("int").alias("i"), a.alias("sub_src"), b.alias("sub_tgt"))
    none = F.array().cast("array<struct<role:string,i:int,sub_src:string,sub_tgt:string>>")
    asked = F.concat(
        F.when(many, F.transform("tgt_atoms", lambda a, i: row("target atom", i, s, a))).otherwise(none),
        F.when(many & (F.size("src_atoms") > 1), F.transform("src_atoms", lambda a, i: row("source atom", i, a, t))).otherwise(none),
        F.when(path & (text.leaf(s) != "") & (text.leaf(t) != ""), F.array(row("leaf", F.lit(0), text.leaf(s), text.leaf(t)))).otherwise(none),
        F.transform(_parts(s), lambda p, i: row("part", i, p, t)),
        F.transform(_parts(t), lambda p, i: row("part", i, p, s)),
    )
    subs = pairs.select("src", "tgt", F.explode(asked).alias("_s")).select("src", "tgt", "_s.*")
    return subs.where(~(F.col("sub_src").eqNullSafe(F.col("src")) & F.col("sub_tgt").eqNullSafe(F.col("tgt"))))


def _described(pairs: DataFrame, terms: DataFrame, atoms, words: list[str]) -> DataFrame:
    """Pairs with forms, synonyms, atoms and tokens of both names, found once a name."""
    names = pairs.select(F.col("src").alias("name")).unionByName(pairs.select(F.col("tgt").alias("name"))).distinct()
    forms = names.select("name", text.norm_field(F.col("name"), fold=True).alias("fold"), text.norm_field(F.col("name")).alias("norm"), text.leaf(F.col("name")).alias("leaf"))
    forms = forms.withColumn("leaf_norm", text.norm_field(F.col("leaf"))).withColumn("leaf_fold", text.norm_field(F.col("leaf"), fold=True)).withColumn("base", F.split("norm", "_", 2)[0]).withColumn("atoms", atoms("norm")).withColumn("tokens", text.tokens(F.col("norm"), words))
    for form in ("norm", "leaf_norm", "base"):
        known = terms.select(F.col("norm").alias(form), F.col("groups").alias(f"{form}_groups"), F.col("canon").alias(f"{form}_canon"))
        forms = forms.join(known, form, "left")
    side = lambda p: forms.select(F.col("name").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in forms.columns if c != "name"])
    return pairs.join(side("src"), "src").join(side("tgt"), "tgt")


def _synonym(form: str) -> Column:
    a, b = F.col(f"src_{form}_groups"), F.col(f"tgt_{form}_groups")
    same = F.col(f"src_{form}_canon") == F.col(f"tgt_{form}_canon")
    return F.when(F.coalesce(F.arrays_overlap(a, b), F.lit(False)), 95.0).when(F.coalesce(same, F.lit(False)), 90.0).otherwise(0.0)


def _excluded(pairs: list[tuple[str, str]]) -> Column:
    s, t, found = F.col("src_norm"), F.col("tgt_norm"), F.lit(False)
    sl, tl = F.col("src_leaf_norm"), F.col("tgt_leaf_norm")
    for a, b in pairs:
        for x, y in ((a, b), (b, a)):
            found = found | ((sl == x) & (tl == y))
        found = found | (s.contains(a) & t.contains(b)) | (t.contains(a) & s.contains(b))
    return found


def _cascade(exclusions: list[tuple[str, str]], exact_first: bool) -> Column:
    """The score of a described pair with its parts' scores (by_target_atom, by_source_atom, by_leaf, by_part) and ``_k``."""
    c = F.col
    s, t = c("src_norm"), c("tgt_norm")
    sp, tp = F.contains(c("src"), F.lit(">")), F.contains(c("tgt"), F.lit(">"))
    one = sp != tp
    conflict = text.unit_conflict(s, t)
    ls, lt = F.length(s), F.length(t)
    least = F.least(ls, lt)
    shorter, longer = F.when(ls <= lt, s).otherwise(t), F.when(ls <= lt, t).otherwise(s)
    leaf_s, leaf_t = c("src_leaf_norm"), c("tgt_leaf_norm")
    short_leaf = F.least(F.length(leaf_s), F.length(leaf_t))
    shared = F.aggregate(F.sequence(F.lit(1), F.greatest(short_leaf, F.lit(1))), F.lit(0), lambda n, i: F.when(F.substring(leaf_s, F.lit(1), i) == F.substring(leaf_t, F.lit(1), i), F.least(i, short_leaf)).otherwise(n))
    ratio = c("_k.ratio")
    close = F.abs(ls - lt) <= F.greatest(F.lit(3.0), 0.5 * least)
    kept_or = lambda high, low: F.when(conflict, low).otherwise(high)
    j = F.coalesce(text.jaccard(c("src_tokens"), c("tgt_tokens")), F.lit(0.0))
    da, db = text.direction(c("src")), text.direction(c("tgt"))
    exact = F.when((c("src_fold") == "") | (c("tgt_fold") == ""), 0.0).when(c("src_fold") == c("tgt_fold"), 100.0).when(s == t, 98.0)
    compound = F.coalesce(c("by_target_atom"), c("by_source_atom")) * 0.95
    start = exact.when(compound.isNotNull(), compound) if exact_first else F.when(compound.isNotNull(), compound).when((c("src_fold") == "") | (c("tgt_fold") == ""), 0.0).when(c("src_fold") == c("tgt_fold"), 100.0).when(s == t, 98.0)
    unit_base = (F.contains(s, F.lit("_")) | F.contains(t, F.lit("_"))) & (_synonym("base") > 0)
    return (
        start.when(_excluded(exclusions), 0.0)
        .when((sp | tp) & (c("src_leaf_fold") == c("tgt_leaf_fold")), F.when(one, 95.0).otherwise(98.0))
        .when((sp | tp) & (leaf_s == leaf_t), F.when(one, 93.0).otherwise(96.0))
        .when((sp | tp) & (_synonym("leaf_norm") > 0), _synonym("leaf_norm"))
        .when((sp | tp) & (F.coalesce(c("by_leaf"), F.lit(0.0)) > 0), c("by_leaf"))
        .when((sp | tp) & (shared >= 2) & (shared >= 0.4 * short_leaf), 65.0)
        .when(unit_base, kept_or(_synonym("base"), F.lit(0.0)))
        .when(_synonym("norm") > 0, _synonym("norm"))
        .when(F.coalesce(c("by_part"), F.lit(0.0)) >= 60, c("by_part"))
        .when(da.isin("start", "end") & db.isin("start", "end") & (da != db), 0.0)
        .when((least == 2) & longer.endswith(shorter), kept_or(F.lit(50.0), F.lit(40.0)))
        .when((least == 2) & longer.startswith(shorter), kept_or(F.lit(45.0), F.lit(40.0)))
        .when((least > 2) & longer.endswith(shorter), kept_or(F.lit(70.0), F.lit(50.0)))
        .when((least > 2) & longer.startswith(shorter), kept_or(F.lit(65.0), F.lit(50.0)))
        .when(close & (ratio >= 0.75), kept_or(75 + (ratio - 0.75) * 52, F.least(75 + (ratio - 0.75) * 52, F.lit(60.0))))
        .when(close & (ratio >= 0.65), kept_or(65 + (ratio - 0.65) * 100, F.least(65 + (ratio - 0.65) * 100, F.lit(50.0))))
        .when((least >= 2) & F.contains(longer, shorter), 45.0)
        .when(j >= 0.5, 60 + 20 * j)
        .otherwise(0.0)
    )


def _penalised(score: Column) -> Column:
    """Scores below 95 between hostile categories shrink, unless the last parts are the same."""
    a, b = text.field_category(F.col("src")), text.field_category(F.col("tgt"))
    hostile = F.lit(False)
    for x, y in fixed.HOSTILE:
        hostile = hostile | ((a == x) & (b == y)) | ((a == y) & (b == x))
    apart = hostile & (F.col("src_leaf") != F.col("tgt_leaf"))
    return F.when((score < 95) & apart, score * fixed.HOSTILE_FACTOR).otherwise(score)


def score_fields(pairs: DataFrame, terms: DataFrame, exclusions: list[tuple[str, str]] = [], words: list[str] = fixed.FIELD_WORDS, exact_first: bool = False) -> DataFrame:  # noqa: B006
    """Rows (src, tgt, score from 0 to 100) for the distinct pairs of field names in ``pairs`` (src, tgt).

    ``terms`` is a lexicon. A pair's score may ask for those of its parts: dictionary words in
    compound names, last parts of paths, alternatives between slashes. Those pairs form the
    next stage, until none is left; then stages are scored from the last to the first. Without
    ``exact_first`` compound names are taken apart even where the names are equal. Null
    names score 0.
    """
    words_of = kept(canonical(terms), "field-terms")
    atoms = _atoms([r[0] for r in words_of.select("norm").collect()])  # the dictionary, a parameter
    stage = pairs.select(F.coalesce("src", F.lit("")).alias("src"), F.coalesce("tgt", F.lit("")).alias("tgt")).distinct()
    stages, asked = [], []
    while True:  # parts are shorter than what they are parts of, so there is a last stage
        described = kept(_described(stage, words_of, atoms, words), "field-pairs")
        subs = kept(_sub_pairs(described), "field-parts")
        stages.append(described)
        asked.append(subs)
        if subs.isEmpty():
            break
        stage = subs.select(F.col("sub_src").alias("src"), F.col("sub_tgt").alias("tgt")).distinct()
    scored = None
    for described, subs in zip(reversed(stages), reversed(asked), strict=True):
        roles = {"target atom": "by_target_atom", "source atom": "by_source_atom", "leaf": "by_leaf", "part": "by_part"}
        if scored is None:
            full = described
            for to in roles.values():
                full = full.withColumn(to, F.lit(None).cast("double"))
        else:
            known = subs.join(scored.select(F.col("src").alias("sub_src"), F.col("tgt").alias("sub_tgt"), "score"), ["sub_src", "sub_tgt"])
            first = lambda role: F.min_by(F.when((F.col("role") == role) & (F.col("score") >= 70), F.col("score")), F.when((F.col("role") == role) & (F.col("score") >= 70), F.col("i")))
            best = known.groupBy("src", "tgt").agg(first("target atom").alias("by_target_atom"), first("source atom").alias("by_source_atom"), F.max(F.when(F.col("role") == "leaf", F.col("score"))).alias("by_leaf"), F.max(F.when(F.col("role") == "part", F.when(F.col("sub_src") == F.col("sub_tgt"), 98.0).otherwise(F.col("score")))).alias("by_part"))
            full = described.join(best, ["src", "tgt"], "left")
        full = full.withColumn("_k", pair_kernel("src_norm", "tgt_norm")).withColumn("score", _cascade(exclusions, exact_first))
        scored = kept(full.select("src", "tgt", _penalised(F.col("score")).alias("score")), "field-scores")
    return scored


def auto_match(scored: DataFrame, src_fields: DataFrame, tgt_fields: DataFrame) -> DataFrame:
    """A row for each target field with its best source field, of equal ones the first.

    ``src_fields`` (ord, name, file, sheet), ``tgt_fields`` (ord, name), ``scored`` from ``score_fields``.
    85 and more match at once, 60 and more are suggested; fewer give no source field. A source
    field that several targets match is a conflict.
    """
    src = src_fields.select(F.col("ord").alias("_so"), F.col("name").alias("src"), "file", "sheet")
    best = scored.join(src, "src").groupBy("tgt").agg(F.min(F.struct((-F.col("score")).alias("worse"), "_so", "src", "file", "sheet")).alias("_b"))
    tgt = tgt_fields.select(F.col("ord").alias("_to"), F.col("name").alias("tgt"))
    score = F.coalesce(-F.col("_b.worse"), F.lit(0.0))
    fine = score >= fixed.FIELD_SUGGEST
    rows = tgt.join(best, "tgt", "left").select(
        F.col("_to").alias("ord"), F.col("tgt").alias("tgt_field"), F.when(fine, F.col("_b.src")).alias("src_field"), F.when(fine, F.col("_b.file")).alias("src_file"), F.when(fine, F.col("_b.sheet")).alias("src_sheet"),
        F.when(fine, F.round(score, 1)).otherwise(0.0).alias("confidence"), (score >= fixed.FIELD_AUTO).alias("auto"), (score >= fixed.FIELD_AUTO).alias("matched"), (fine & (score < fixed.FIELD_AUTO)).alias("suggested"),
    )
    return flag_conflicts(rows)


def flag_conflicts(matches: DataFrame) -> DataFrame:
    """``matches`` with ``conflict``: the source field of this match also fills another target."""
    source = ["src_file", "src_sheet", "src_field"]
    used = matches.where("matched").groupBy(*[F.col(c).alias(f"_{c}") for c in source]).agg(F.count("*").alias("_n"))
    same = F.col("_src_file").eqNullSafe(F.col("src_file")) & F.col("_src_sheet").eqNullSafe(F.col("src_sheet")) & (F.col("_src_field") == F.col("src_field"))
    conflict = F.coalesce(F.col("matched") & (F.col("_n") > 1), F.lit(False))
    return matches.drop("conflict").join(used.where("_n > 1"), same, "left").withColumn("conflict", conflict).drop("_n", *[f"_{c}" for c in source])


def update_matches(matches: DataFrame, changes: DataFrame) -> DataFrame:
    """``matches`` after a user's ``changes`` (tgt_field, new_field, new_file, new_sheet); a null field clears the match."""
    joined = matches.join(changes.withColumn("_changed", F.lit(True)), "tgt_field", "left")
    on = F.coalesce("_changed", F.lit(False))
    sure = on & F.col("new_field").isNotNull()
    values = {"src_field": F.col("new_field"), "src_file": F.col("new_file"), "src_sheet": F.col("new_sheet"), "confidence": F.when(sure, 100.0).otherwise(0.0), "auto": F.lit(False), "matched": sure, "suggested": F.lit(False)}
    return flag_conflicts(joined.select(*[F.when(on, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in matches.columns]))


def ranked_candidates(scored: DataFrame, src_fields: DataFrame, top: int = 30) -> DataFrame:
    """The ``top`` source fields of each target, best first, then in their own order, with a star for those of the first three that match."""
    src = src_fields.select(F.col("ord").alias("_so"), F.col("name").alias("src"), "file", "sheet")
    place = F.row_number().over(Window.partitionBy("tgt").orderBy(F.col("score").desc(), "_so"))
    ranked = scored.join(src, "src").withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.select("tgt", "rank", "src", "file", "sheet", F.round("score", 1).alias("score"), ((F.col("rank") <= 3) & (F.col("score") >= fixed.FIELD_AUTO)).alias("star"))


def status_summary(matches: DataFrame) -> DataFrame:
    """How many targets match, are suggested, remain, and conflict."""
    return matches.agg(F.count_if("matched").alias("matched"), F.count_if("suggested").alias("suggested"), F.count_if(~F.col("matched") & ~F.col("suggested")).alias("unmatched"), F.count_if("conflict").alias("conflicts"))


def _squeeze(name: str) -> str:
    """``text.norm_name`` of a single name."""
    return re.sub(r"[\s_\-]", "", name.strip().translate(str.maketrans(text.WIDE, text.NARROW)).lower())


def _leaf(name: str) -> str:
    return name.rsplit(">", 1)[-1].strip()


def _bare(name: str) -> str:
    return re.sub(fixed.PARENTHESES, "", name).strip()


def _means(column: str, wanted: str) -> bool:
    """Whether a column's name, or the last part of its path, or that without parentheses, is the wanted name or its last part."""
    if _squeeze(column) == _squeeze(wanted) or ">" in wanted and _squeeze(column) == _squeeze(_leaf(wanted)):
        return True
    if ">" not in column or not (last := _leaf(column)):
        return False
    bare = _bare(last)
    return _squeeze(last) == _squeeze(wanted) or bool(bare) and bare != last and _squeeze(bare) in (_squeeze(wanted), _squeeze(_bare(wanted)))


def resolve_column(columns: list[str], name: str, fallback: str = "", score=None) -> str | None:
    """The column that a name means: the same, then one whose name comes to the same, first for ``name``, then for ``fallback``.

    If none does, ``score`` is asked, a function from pairs (column, name) to their scores:
    the best column of LIKE or more, of equal ones the first. Generated columns are never guessed.
    """
    wanted = [x for x in dict.fromkeys((name, fallback)) if x]
    for w in wanted:
        if w in columns:
            return w
        if found := next((c for c in columns if _means(c, w)), None):
            return found
    named = [c for c in columns if not c.startswith(GENERATED)]
    if not (score and wanted and named):
        return None
    pairs = [(c, w) for w in wanted for c in named]
    scores = score(pairs)
    best = max(pairs, key=lambda p: scores[p])
    return best[0] if scores[best] >= LIKE else None


def header_row(rows: dict[int, dict[int, str]], names: list[str], candidate: int | None = None, probe: int = 199) -> int:
    """The row of a sheet (row: column: text) that holds most of ``names``, whole or by their last parts.

    The ``candidate`` is taken if it holds half of them, two at least; otherwise of the first
    ``probe`` rows that with most, then most cells, then the lowest; if that is too few, the
    candidate where it exists, else row 1.
    """
    whole, last = {_squeeze(n) for n in names}, {_squeeze(_leaf(n)) for n in names}

    def hits(r: int) -> int:
        said = [v.strip() for v in rows.get(r, {}).values() if v and v.strip() and "Unnamed" not in v]
        return sum(bool(_squeeze(v)) and (_squeeze(v) in whole or bool(_squeeze(_leaf(v))) and _squeeze(_leaf(v)) in last) for v in said)

    need = max(2, len(names) // 2)
    if candidate and hits(candidate) >= need:
        return candidate
    best = max((r for r in rows if r <= probe), key=lambda r: (hits(r), len(rows[r]), r), default=1)
    if hits(best) >= need:
        return best
    return candidate if candidate and candidate <= max(rows, default=0) else 1


def header_places(rows: dict[int, dict[int, str]], detail: int, names: list[str]) -> dict[str, int]:
    """For each of ``names`` the column whose header means it; a blank header takes the text above it. Names without one are left out."""
    width = max((c for r in rows.values() for c in r), default=0)
    above = rows.get(detail - 1, {})
    headers = [(rows.get(detail, {}).get(c) or "").strip() or (above.get(c) or "").strip() for c in range(1, width + 1)]
    found = {}
    for n in names:
        for own, form in ((n, str), (_leaf(n), _leaf), (_bare(_leaf(n)), _leaf)):
            if n not in found and _squeeze(own) and (at := next((i for i, h in enumerate(headers, 1) if _squeeze(form(h)) == _squeeze(own)), None)):
                found[n] = at
    return found
