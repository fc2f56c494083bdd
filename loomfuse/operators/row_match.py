"""Matching rows by fuzzy keys: features, scores, candidates without loss, and one-to-one alignment."""

from __future__ import annotations

import functools
import heapq

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfuse.functions import fixed, text
from loomfuse.functions.kernels import pair_kernel
from loomfuse.operators.graph import buckets
from loomfuse.operators.keys import numbered_within
from loomfuse.operators.scratch import kept

#: Scores that spelling alone can't exceed where codes differ, or lengths by more than LENGTH_GAP of the longer.
CODES_CAP, LENGTH_CAP, LENGTH_GAP = 0.6, 0.72, 0.34
#: Links and keys that one task settles at most.
LOCAL = 200_000


def features(keys: DataFrame, key: str = "key") -> DataFrame:
    """``keys`` with what a score needs of each, once for each key; keys of one ``kind`` score alike with any other key."""
    norm = text.norm_rowkey(F.col(key))
    df = keys.withColumn("norm", norm)
    road = text.road(F.col(key))
    return df.select(
        *keys.columns, "norm", text.phase(F.col("norm")).alias("phase"), text.section(F.col("norm")).alias("section"), text.domain(F.col("norm")).alias("domain"),
        road.alias("road"), text.longest_digits(F.col("norm")).alias("digits"), text.code_tokens(F.col("norm")).alias("codes"), text.strip_generics(F.col("norm")).alias("core"),
        F.concat_ws("\u0001", "norm", road["road"], F.array_join(road["ends"], "\u0001")).alias("kind"),
    )


FEATURES = ["norm", "phase", "section", "domain", "road", "digits", "codes", "core"]


def _score(a: str, b: str, equality_first: bool) -> Column:
    """The score of two keys' features, columns named with the prefixes ``a`` and ``b``; kernels are in _whole and _core."""
    x, y = (lambda n: F.col(f"{a}{n}")), (lambda n: F.col(f"{b}{n}"))
    differ = lambda n: x(n).isNotNull() & y(n).isNotNull() & (x(n) != y(n))
    size = lambda n: (F.length(x(n)), F.length(y(n)))
    la, lb = size("norm")
    ca, cb = size("core")
    alike = lambda k, p, q: (F.col(f"{k}.common") >= 0.6 * F.least(p, q)) & (F.col(f"{k}.ratio") >= 0.7)
    high = lambda k: 0.85 + 0.15 * F.col(f"{k}.ratio")
    contained = (la >= 4) & (lb >= 4) & (F.contains(x("norm"), y("norm")) | F.contains(y("norm"), x("norm")))
    # what the whole keys say; a core is asked only below 0.85, and very close spelling only below that
    whole = F.when(contained, 0.97).when(alike("_whole", la, lb), high("_whole")).otherwise(0.0)
    core = F.when(whole >= 0.85, whole).when((ca > 0) & (cb > 0) & alike("_core", ca, cb), high("_core")).otherwise(0.0)
    if equality_first:
        core = F.least(core, F.lit(0.99))
    base = F.when((core < 0.85) & (F.col("_whole.ratio") >= 0.9), F.col("_whole.ratio")).otherwise(core)
    base = F.when((x("codes") != y("codes")) & ((F.size(x("codes")) > 0) | (F.size(y("codes")) > 0)), F.least(base, F.lit(CODES_CAP))).otherwise(base)
    base = F.when(F.abs(la - lb) / F.greatest(la, lb) > LENGTH_GAP, F.least(base, F.lit(LENGTH_CAP))).otherwise(base)
    known = lambda c: c.isNotNull() & (c != "unknown")
    same_road = x("road") == y("road")
    both_roads = x("road").isNotNull() & y("road").isNotNull()
    equal = F.when(both_roads & ~same_road, 0.0).otherwise(1.0) if equality_first else F.lit(1.0)
    return (
        F.when((la == 0) | (lb == 0), 0.0)
        .when(x("norm") == y("norm"), equal)
        .when(differ("phase") | differ("section"), 0.0)
        .when(known(x("domain")) & known(y("domain")) & (x("domain") != y("domain")), 0.0)
        .when(both_roads, F.when(same_road, 0.97).otherwise(0.0))
        .when((x("digits") == y("digits")) & (F.length(x("digits")) >= 6), 0.92)
        .otherwise(base)
    )


def score_pairs(pairs: DataFrame, a: str = "t_", b: str = "s_", equality_first: bool = False) -> DataFrame:
    """``pairs`` of features with ``score`` from 0 to 1.

    With ``equality_first`` only equal keys score 1 (equal cores 0.99), and of equal keys
    with road ends in parentheses those ends must agree; otherwise equal cores score 1 as
    equal keys do, and parentheses don't count.
    """
    kernel = pairs.withColumn("_whole", pair_kernel(F.col(f"{a}norm"), F.col(f"{b}norm"))).withColumn("_core", pair_kernel(F.col(f"{a}core"), F.col(f"{b}core")))
    return kernel.withColumn("score", _score(a, b, equality_first)).drop("_whole", "_core")


#: What spelling must share: a stretch of this part of the shorter string at this ratio, or without one the higher ratio.
STRETCH, ALIKE, VERY_ALIKE = 0.6, 0.7, 0.9
#: Longer stretches are looked up by pieces of so many characters.
PIECE = 24
#: Shorter keys count as contained in others only as equal ones.
LEAST_CONTAINED = 4
_EPS = 1e-9


def _stretch(m: Column) -> Column:
    """The shortest stretch that a string of ``m`` characters, the shorter one, must share."""
    return F.ceil(STRETCH * m - _EPS).cast("int")


def _lost(m: Column, n: Column) -> Column:
    """How many characters of the shorter string, of ``m``, the longer one of ``n`` may lack at the ratio VERY_ALIKE; negative: no such pair."""
    return F.floor(((1 - VERY_ALIKE) * (m + n) - (n - m)) / 2 + _EPS).cast("int")


def _pieces(c: Column, size: Column, step: Column) -> Column:
    """Pieces of ``size`` characters, at each ``step``; none of a shorter string."""
    n = F.length(c) - size
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0)), step), lambda i: c.substr(i + 1, size))).otherwise(F.array().cast("array<string>"))


def _ints(values: list[int]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<int>")


def _of_shorter(c: Column, contained: bool) -> Column:
    """What the shorter string is looked up by: pieces of which every stretch that it must share holds one; if it may be ``contained``, its beginning too."""
    size = F.least(_stretch(F.length(c)), F.lit(PIECE))
    found = _pieces(c, size, _stretch(F.length(c)) - size + 1)
    return F.concat(found, F.when(F.length(c) >= LEAST_CONTAINED, F.array(F.concat(F.lit("="), F.left(c, F.lit(PIECE))))).otherwise(F.array().cast("array<string>"))) if contained else found


def _of_longer(c: Column, lengths: list[int], contained: bool) -> Column:
    """All pieces of the longer string by which shorter ones of any of ``lengths`` may be looked up."""
    n, one = F.length(c), F.lit(1)
    fine = F.filter(_ints(lengths), lambda m: (m <= n) & (2 * m >= (m + n) * (ALIKE - _EPS)))
    sizes = F.array_distinct(F.transform(fine, lambda m: F.least(_stretch(m), F.lit(PIECE))))
    found = F.flatten(F.transform(sizes, lambda q: _pieces(c, q, one)))
    if contained:
        short = F.array_distinct(F.transform(F.filter(_ints(lengths), lambda m: (m >= LEAST_CONTAINED) & (m <= n)), lambda m: F.least(m, F.lit(PIECE))))
        found = F.concat(found, F.transform(F.flatten(F.transform(short, lambda q: _pieces(c, q, one))), lambda p: F.concat(F.lit("="), p)))
    return F.array_distinct(found)


def _segments(c: Column, m: Column, n: Column, shifts: bool) -> Column:
    """Segments (_pair, _least, _b), two more than a pair of lengths ``m`` and ``n`` may have edits, so that two stay whole: of the shorter string ``c``,
    or of the longer one wherever deleted and inserted characters may have moved it. ``_least``: so many must be looked up."""
    lost = _lost(m, n)
    parts = 2 * lost + n - m + 2
    begin = lambda i: F.floor(i * m / parts).cast("int")
    name = lambda i, at: F.struct(F.concat_ws(":", m, n).alias("_pair"), (parts - 1).alias("_least"), F.concat_ws(":", m, n, i, c.substr(at + 1, begin(i + 1) - begin(i))).alias("_b"))
    every = lambda i: F.transform(F.sequence(F.greatest(begin(i) - lost, F.lit(0)), F.least(begin(i) + lost + n - m, n - begin(i + 1) + begin(i))), lambda at: name(i, at))
    each = F.sequence(F.lit(0), parts - 1)
    found = F.flatten(F.transform(each, every)) if shifts else F.transform(each, lambda i: name(i, begin(i)))
    return F.when((m <= n) & (m > 0) & (lost >= 0), found).otherwise(F.array().cast("array<struct<_pair:string,_least:int,_b:string>>"))


def _rarest(segments: DataFrame, index: DataFrame) -> DataFrame:
    """Of each string's ``segments`` those that must be looked up, the rarest in ``index``: all but one, as two stay whole."""
    often = index.groupBy("source_id", "_b").agg(F.count("*").alias("_f"))
    w = Window.partitionBy("source_id", "_o", "_pair").orderBy(F.coalesce("_f", F.lit(0)), "_b")
    return segments.join(often, ["source_id", "_b"], "left").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col("_least")).drop("_r", "_f")


def candidates(targets: DataFrame, sources: DataFrame, least: float = fixed.ROW_SUGGEST) -> DataFrame:
    """Distinct pairs (source_id, t_ord, s_ord) that can score ``least``, 0.6 or more; ``targets`` (source_id, t_ord, features), ``sources`` (source_id, s_ord, features).

    Such scores come from equal keys, equal cores, equal long digit runs, equal roads, from keys or cores
    that share a stretch of 0.6 of the shorter at a ratio of 0.7, from keys that contain each other, or from
    keys at a ratio of 0.9. A shared stretch is looked up as a whole: the shorter string by all its
    windows of that length, the longer by all its pieces of the lengths that shorter ones have; what is
    contained by its beginning. At 0.9 the edits that a pair of lengths allows
    leave two segments whole of two more than edits, near their places, so all but the most frequent segment are looked up. So nearly all pairs that
    are found do score. Spelling alone scores over 0.6 only with equal codes and over 0.72 only with lengths about alike;
    for such a ``least`` these narrow the look-up, and keys whose codes no other key has are looked up as equal ones alone. All are looked up by one join. No pair is lost.
    """
    codes = F.array_join("codes", " ") if least > CODES_CAP else F.lit("")
    sides, spelled = ((targets, "t_ord"), (sources, "s_ord")), [targets, sources]
    if least > CODES_CAP:
        there_too = functools.reduce(DataFrame.unionByName, [df.select("source_id", codes.alias("_codes"), "norm", F.lit(i).alias("_i")) for i, df in enumerate(spelled)])
        others = there_too.groupBy("source_id", "_codes").agg(F.min("norm").alias("_a"), F.max("norm").alias("_z"), F.min("_i").alias("_t"), F.max("_i").alias("_s")).where("_a <> _z and _t < _s").select("source_id", "_codes")
        others = kept(others, "row-codes")
        spelled = [kept(df.withColumn("_codes", codes).join(others, ["source_id", "_codes"], "left_semi").select(df.columns), "row-spelled") for df in spelled]
    there: dict[tuple, set] = {}
    for i, n, c in (spelled[0].select(F.lit(0), F.length("norm"), F.length("core")).union(spelled[1].select(F.lit(1), F.length("norm"), F.length("core")))).distinct().collect():  # lengths of keys, few
        there.setdefault((i, "norm"), set()).add(n)
        there.setdefault((i, "core"), set()).add(c)
    lengths = lambda side, name: sorted(n for n in there.get((side, name), ()) if n)
    norm, n = F.col("norm"), F.length("norm")

    key = lambda k, size, b: F.struct(F.lit(k).alias("_k"), size.cast("int").alias("_n"), b.alias("_b"))

    def looked_up(df: DataFrame, at: str, by: Column) -> DataFrame:
        return df.select("source_id", F.col(at).alias("_o"), n.alias("_l"), F.explode(by).alias("_e")).select("source_id", "_o", "_l", "_e.*")

    def same(side: int) -> DataFrame:
        """What a key is looked up by as an equal one: (_k, _n, _b), _k the kind of key: 2 equal, else the side (0 targets, 1 sources) that is the shorter."""
        equal = [("norm", norm, norm != ""), ("core", F.col("core"), F.col("core") != ""), ("digits", F.col("digits"), F.length("digits") >= 6), ("road", F.col("road.road"), F.col("road").isNotNull())]
        return looked_up(*sides[side], F.filter(F.array(*[key(2, F.lit(0), F.when(fine, F.concat(F.lit(f"{name}="), value))) for name, value, fine in equal]), lambda e: e["_b"].isNotNull()))

    def keyed(side: int) -> DataFrame:
        """What a key is looked up by for what it shares with others."""
        found = []
        for name in ("norm", "core"):
            c = F.col(name)
            for k, pieces in ((side, _of_shorter(c, name == "norm")), (1 - side, _of_longer(c, lengths(1 - side, name), name == "norm"))):
                named = F.transform(F.filter(F.array_distinct(pieces), lambda p: p != ""), lambda p: key(k, F.length(c), F.concat_ws(":", F.lit(f"{name}{k}"), codes, p)))  # noqa: B023
                found.append(named)
        return looked_up(spelled[side], sides[side][1], F.concat(*found))

    def segmented(side: int, shorter: bool) -> DataFrame:
        df, at = spelled[side], sides[side][1]
        other = F.transform(_ints(lengths(1 - side, "norm")), lambda m: _segments(norm, n, m, False) if shorter else _segments(norm, m, n, True))
        rows = df.select("source_id", F.col(at).alias("_o"), n.alias("_l"), codes.alias("_c"), F.explode(F.array_distinct(F.flatten(other))).alias("_e")).select("source_id", "_o", "_l", "_c", "_e.*")
        k = F.lit(side if shorter else 1 - side)
        return rows.select("source_id", "_o", "_l", k.alias("_k"), F.col("_l").alias("_n"), F.concat_ws(":", F.lit("segment"), k, "_c", "_b").alias("_b"), "_pair", "_least")

    every = {side: [same(side)] for side in (0, 1)}
    for side in (0, 1) if there else ():
        index = segmented(1 - side, False)
        looked = _rarest(segmented(side, True), index)
        every[side] += [keyed(side), looked]
        every[1 - side].append(index)
    columns = ["source_id", "_o", "_l", "_k", "_n", "_b"]
    t, s = (functools.reduce(DataFrame.unionByName, [df.select(columns) for df in every[side]]) for side in (0, 1))
    met = t.join(s.select("source_id", "_b", F.col("_o").alias("_i"), F.col("_n").alias("_m"), F.col("_l").alias("_p")), ["source_id", "_b"])
    met = met.where(F.when(F.col("_k") == 0, F.col("_n") <= F.col("_m")).when(F.col("_k") == 1, F.col("_m") <= F.col("_n")).otherwise(F.lit(True)))
    if least > LENGTH_CAP:
        met = met.where((F.col("_k") == 2) | (F.abs(F.col("_l") - F.col("_p")) <= LENGTH_GAP * F.greatest("_l", "_p")))
    return met.select("source_id", F.col("_o").alias("t_ord"), F.col("_i").alias("s_ord")).distinct()


def _with_sources(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """``targets`` with a row for each of the few sources, unless they name theirs."""
    if "source_id" in targets.columns:
        return targets
    ids = [F.lit(r[0]) for r in sources.select("source_id").distinct().collect()]
    return targets.withColumn("source_id", F.explode(F.array(*ids).cast("array<string>")))


def kind_scores(targets: DataFrame, sources: DataFrame, equality_first: bool = False, least: float = fixed.ROW_SUGGEST, earlier: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores of kinds of keys, (source_id, t_kind, s_kind, score), and the kinds' members, (source_id, t_kind, t_ord, tgt_key) and (source_id, s_kind, s_ord, src_key).

    A kind is named by the place of its first key. Many equal keys are thus scored once. ``earlier``: only sources that stand before the target are scored.
    """
    t = kept(features(_with_sources(targets, sources), "tgt_key"), "row-targets")
    s = kept(features(sources, "src_key"), "row-sources")
    first = lambda df, o: df.groupBy("source_id", "kind").agg(F.min(o).alias(o), *[F.min_by(c, o).alias(c) for c in FEATURES])
    parts = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # look-ups are much work for few bytes
    ft, fs = (kept(first(df, o).repartition(parts, "source_id", o), "row-kinds") for df, o in ((t, "t_ord"), (s, "s_ord")))
    pairs = candidates(ft, fs, least)
    pairs = pairs.where("s_ord < t_ord") if earlier else pairs
    a = ft.select("source_id", "t_ord", *[F.col(c).alias(f"t_{c}") for c in FEATURES])
    b = fs.select("source_id", "s_ord", *[F.col(c).alias(f"s_{c}") for c in FEATURES])
    scored = score_pairs(pairs.join(a, ["source_id", "t_ord"]).join(b, ["source_id", "s_ord"]), equality_first=equality_first).where(F.col("score") >= least - 1e-9)
    members = lambda df, kinds, o, to, key: df.select("source_id", "kind", o, key).join(kinds.select("source_id", "kind", F.col(o).alias(to)), ["source_id", "kind"]).drop("kind")
    return scored.select("source_id", F.col("t_ord").alias("t_kind"), F.col("s_ord").alias("s_kind"), "score"), members(t, ft, "t_ord", "t_kind", "tgt_key"), members(s, fs, "s_ord", "s_kind", "src_key")


def scored_candidates(targets: DataFrame, sources: DataFrame, equality_first: bool = False, least: float = fixed.ROW_SUGGEST) -> DataFrame:
    """Rows (source_id, t_ord, s_ord, tgt_key, src_key, score) with a score of ``least``, 0.6 or more.

    ``targets`` (t_ord, tgt_key, and source_id if they differ by source) and ``sources`` (source_id, s_ord, src_key) hold distinct keys.
    """
    scored, t, s = kind_scores(targets, sources, equality_first, least)
    return scored.join(t, ["source_id", "t_kind"]).join(s, ["source_id", "s_kind"]).select("source_id", "t_ord", "s_ord", "tgt_key", "src_key", "score")


def _ranked(members: DataFrame, side: str) -> DataFrame:
    return kept(numbered_within(members, ["source_id", f"{side}_kind"], [f"{side}_ord"], f"{side}_rank"), f"align-{side}")


def take_greedily(links: pa.Table, members: list[pa.Table]) -> pa.Table:
    """What a greedy pass over all pairs of members takes, by score, then target, then source; the pairs themselves are never formed.

    ``links`` (source_id, t_kind, s_kind, score), ``members`` (source_id, side, kind, rank, ord) of either side. Score by score, targets
    go in their order, and each takes the first source left among the kinds linked to its own at this score.
    """
    queues: dict[tuple, list] = {}
    rows = lambda t: zip(*(t[c].to_pylist() for c in ("source_id", "side", "kind", "rank", "ord")), strict=True)
    for source, side, kind, rank, at in (m for side in members for m in sorted(rows(side), key=lambda m: m[4], reverse=True)):
        queues.setdefault((source, side, kind), []).append((at, rank))
    levels: dict[tuple, dict] = {}
    for source, t, s, score in zip(*(links[c].to_pylist() for c in ("source_id", "t_kind", "s_kind", "score")), strict=True):
        levels.setdefault((-score, source), {}).setdefault(t, []).append(s)
    taken = []
    for worse, source in sorted(levels, key=lambda x: x[0]):
        level = levels[worse, source]
        queue = lambda side, kind: queues.get((source, side, kind))  # noqa: B023, E731
        order = [(queue(0, t)[-1][0], t) for t in level if queue(0, t)]
        waiting = {t: [(queue(1, s)[-1][0], s) for s in level[t] if queue(1, s)] for _, t in order}
        for heap in (order, *waiting.values()):
            heapq.heapify(heap)
        while order:
            t = heapq.heappop(order)[1]
            heap = waiting[t]
            while heap and not (queue(1, heap[0][1]) and queue(1, heap[0][1])[-1][0] == heap[0][0]):  # its first member has gone
                s = heapq.heappop(heap)[1]
                if queue(1, s):
                    heapq.heappush(heap, (queue(1, s)[-1][0], s))
            if heap:
                s = heap[0][1]
                taken.append((source, t, s, queue(0, t).pop()[1], queue(1, s).pop()[1], -worse))
                if queue(0, t):
                    heapq.heappush(order, (queue(0, t)[-1][0], t))
    types = [links[c].type for c in ("source_id", "t_kind", "s_kind")] + [pa.int64(), pa.int64(), pa.float64()]
    columns = zip(*taken, strict=True) if taken else [[]] * 6
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, types, strict=True)], names=["source_id", "t_kind", "s_kind", "t_rank", "s_rank", "score"])


def _locally(left: DataFrame, t: DataFrame, s: DataFrame) -> DataFrame:
    """The greedy pass over ``left`` (bucket, ...), each bucket in one task, as no link leads from one to another."""
    names = ["bucket", "source_id", "side", "t_kind", "s_kind", "score", "rank", "t_ord", "s_ord"]
    kind = {"bucket": "long", "source_id": dict(left.dtypes)["source_id"], "side": "int", "score": "double", "rank": "long"} | {f"{x}_{c}": dict(d.dtypes)[f"{x}_{c}"] for x, d in (("t", t), ("s", s)) for c in ("kind", "ord")}
    shaped = lambda df: df.select([(F.col(c) if c in df.columns else F.lit(None)).cast(kind[c]).alias(c) for c in names])
    rows = shaped(left.withColumn("side", F.lit(2)))
    for side, (x, members) in enumerate((("t", t), ("s", s))):
        kinds = left.select("bucket", "source_id", f"{x}_kind", f"{x}_used").distinct()
        own = kinds.join(members, ["source_id", f"{x}_kind"]).where(F.col(f"{x}_rank") >= F.col(f"{x}_used"))
        rows = rows.unionByName(shaped(own.withColumn("side", F.lit(side)).withColumnRenamed(f"{x}_rank", "rank")))

    def run(table: pa.Table) -> pa.Table:
        links = table.filter(pc.equal(table["side"], 2))
        members = [table.filter(pc.equal(table["side"], i)).select(["source_id", "side", f"{x}_kind", "rank", f"{x}_ord"]).rename_columns(["source_id", "side", "kind", "rank", "ord"]) for i, x in enumerate("ts")]
        return take_greedily(links, members)

    schema = f"source_id {kind['source_id']}, t_kind {kind['t_kind']}, s_kind {kind['s_kind']}, t_rank long, s_rank long, score double"
    return kept(rows.groupBy("bucket").applyInArrow(run, schema), "align-local")


def _greedy(scored: DataFrame, t: DataFrame, s: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs (source_id, t_kind, s_kind, t_rank, s_rank, score) of members that a greedy pass over all pairs of members would take.

    Kinds that scores link, directly or not, form a component, and what the pass takes in one depends on nothing outside. So components
    go to tasks, together up to ``most`` links and members, and each task makes the pass. Only components too large for a task go in rounds, until what is left is small enough.

    A round takes, of each kind, what is the best left for it and for the other end: the pass
    would take these before any pair that touches them. Kinds that are all best for each
    other at one score form a block, in which the pass takes the k-th target with the k-th
    source; elsewhere, where scores tie unevenly, the next members alone go. Every round
    takes a pair at least, so there is an end. Rounds are written, so lost executors repeat none.
    """
    most = most or LOCAL
    size = lambda df, side: df.groupBy("source_id", f"{side}_kind").agg(F.count("*").alias(f"{side}_n"))
    none = F.lit(0).cast("long")
    left = scored.join(size(t, "t"), ["source_id", "t_kind"]).join(size(s, "s"), ["source_id", "s_kind"])
    left = kept(left.withColumn("t_used", none).withColumn("s_used", none), "align-left")
    node = {side: F.xxhash64(F.lit(side), "source_id", f"{side}_kind") for side in "ts"}  # equal hashes would only join components
    weighed = lambda left: left.select(F.explode(F.array(*[F.struct(node[x].alias("node"), (F.col(f"{x}_n") - F.col(f"{x}_used")).alias("n")) for x in "ts"])).alias("w")).select("w.*")
    taken, parted = [], False
    while n := left.count():
        if n + weighed(left).groupBy("node").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] <= most:
            taken.append(_locally(left.withColumn("bucket", none), t, s))
            left = left.limit(0)
            break
        if not parted:
            parted = True
            dealt = buckets(left.select(node["t"].alias("a"), node["s"].alias("b")), weighed(left), most, "align")
            dealt = left.join(dealt.withColumnRenamed("node", "_node"), node["t"] == F.col("_node")).drop("_node")
            taken.append(_locally(dealt.where("bucket is not null"), t, s))
            left = kept(dealt.where("bucket is null").drop("bucket"), "align-left")
            continue
        now = left
        for side, members in (("t", t), ("s", s)):
            own = members.select("source_id", f"{side}_kind", F.col(f"{side}_rank").alias(f"{side}_used"), F.col(f"{side}_ord").alias(f"{side}_next"))
            now = now.join(own, ["source_id", f"{side}_kind", f"{side}_used"])
        each = {side: Window.partitionBy("source_id", f"{side}_kind") for side in "ts"}
        for side, other in (("t", "s"), ("s", "t")):
            now = now.withColumn(f"{side}_top", F.col("score") == F.max("score").over(each[side]))
            best = F.when(F.col(f"{side}_top"), F.col(f"{other}_next"))
            now = now.withColumn(f"{side}_best", F.col(f"{side}_top") & (F.min(best).over(each[side]) == F.col(f"{other}_next")))
            now = now.withColumn(f"{side}_tops", F.bit_xor(F.when(F.col(f"{side}_top"), F.xxhash64(f"{other}_kind"))).over(each[side]))
        for side, other in (("t", "s"), ("s", "t")):
            tops = F.when(F.col(f"{side}_top"), F.col(f"{other}_tops"))
            both = F.count_if(F.col(f"{side}_top") & ~F.col(f"{other}_top")).over(each[side]) == 0
            now = now.withColumn(f"{side}_even", both & (F.min(tops).over(each[side]) == F.max(tops).over(each[side])))
        now = now.withColumn("even", F.col("t_top") & F.col("s_top") & F.col("t_even") & F.col("s_even"))
        now = now.withColumn("block", F.min(F.when(F.col("even"), F.col("t_kind"))).over(each["s"]))
        now = kept(now.where("even or (t_best and s_best)"), "align-now")
        sides = {}
        for side, members in (("t", t), ("s", s)):
            kinds = now.where("even").select("source_id", "block", "score", f"{side}_kind", f"{side}_used").distinct()
            place = F.row_number().over(Window.partitionBy("source_id", "block").orderBy(f"{side}_ord"))
            sides[side] = kinds.join(members, ["source_id", f"{side}_kind"]).where(F.col(f"{side}_rank") >= F.col(f"{side}_used")).withColumn("k", place).drop(f"{side}_used", f"{side}_ord")
        columns = ["source_id", "t_kind", "s_kind", "t_rank", "s_rank", "score"]
        blocks = sides["t"].join(sides["s"].drop("score"), ["source_id", "block", "k"]).select(*columns)
        alone = now.where("not even").select("source_id", "t_kind", "s_kind", F.col("t_used").alias("t_rank"), F.col("s_used").alias("s_rank"), "score")
        best = kept(blocks.unionByName(alone), "align-best")
        taken.append(best)
        for side in "ts":
            gone = best.groupBy("source_id", f"{side}_kind").agg(F.count("*").alias("_many"))
            left = left.join(gone, ["source_id", f"{side}_kind"], "left").withColumn(f"{side}_used", F.col(f"{side}_used") + F.coalesce("_many", none)).drop("_many")
        left = kept(left.where("t_used < t_n and s_used < s_n"), "align-left")
    out = left.select("source_id", "t_kind", "s_kind", F.col("t_used").alias("t_rank"), F.col("s_used").alias("s_rank"), "score").limit(0)
    for part in taken:
        out = out.unionByName(part)
    return out


def align_keys(targets: DataFrame, sources: DataFrame, equality_first: bool = False, threshold: float = fixed.ROW_AUTO) -> DataFrame:
    """One-to-one pairs (source_id, t_ord, s_ord, tgt_key, src_key, score): best score first, then target order, then source order.

    The pairs of many equal keys are never formed: kinds of keys are scored and aligned, their members by rank.
    """
    scored, t, s = kind_scores(targets, sources, equality_first, threshold)
    t, s = _ranked(t, "t"), _ranked(s, "s")
    found = _greedy(kept(scored, "align-scored"), t, s)
    return found.join(t, ["source_id", "t_kind", "t_rank"]).join(s, ["source_id", "s_kind", "s_rank"]).select("source_id", "t_ord", "s_ord", "tgt_key", "src_key", "score")


def align(scored: DataFrame, threshold: float = fixed.ROW_AUTO) -> DataFrame:
    """The one-to-one pairs of rows that are ``scored`` already, as a greedy pass would take them."""
    good = kept(scored.where(F.col("score") >= threshold), "align-scored")
    members = lambda side: _ranked(good.select("source_id", F.col(f"{side}_ord").alias(f"{side}_kind"), f"{side}_ord").distinct(), side)
    found = _greedy(good.select("source_id", F.col("t_ord").alias("t_kind"), F.col("s_ord").alias("s_kind"), "score"), members("t"), members("s"))
    return good.join(found.select("source_id", F.col("t_kind").alias("t_ord"), F.col("s_kind").alias("s_ord")), ["source_id", "t_ord", "s_ord"]).select(*scored.columns)


def preview(targets: DataFrame, sources: DataFrame, equality_first: bool = False) -> DataFrame:
    """Rows (source_id, t_ord, tgt_key, src_key, score, status) for each target and source: auto if aligned, suggest with the best other key that scores 0.6, else unmatched.

    Only targets that are not aligned are scored down to 0.6.
    """
    every = _with_sources(targets.select("t_ord", "tgt_key"), sources)
    sure = kept(align_keys(every, sources, equality_first).select("source_id", "t_ord", F.col("src_key").alias("_key"), F.col("score").alias("_score")), "preview-sure")
    rest = every.join(sure.select("source_id", "t_ord"), ["source_id", "t_ord"], "left_anti")
    scored = scored_candidates(rest, sources, equality_first)
    best = scored.groupBy("source_id", "t_ord").agg(F.min(F.struct((-F.col("score")).alias("worse"), "s_ord", "src_key")).alias("_b"))
    joined = every.join(sure, ["source_id", "t_ord"], "left").join(best, ["source_id", "t_ord"], "left")
    status = F.when(F.col("_key").isNotNull(), "auto").when(F.col("_b").isNotNull(), "suggest").otherwise("unmatched")
    return joined.select("source_id", "t_ord", "tgt_key", F.coalesce("_key", "_b.src_key").alias("src_key"), F.round(F.coalesce("_score", -F.col("_b.worse"), F.lit(0.0)), 2).alias("score"), status.alias("status"))


def follow(links: pa.Table) -> pa.Table:
    """Rows (ord, leader) of all that ``links`` (ord, before) name: in the order of ``ord``, each follows the first of those before it that lead, or leads."""
    before: dict = {}
    for at, b in zip(links["ord"].to_pylist(), links["before"].to_pylist(), strict=True):
        before.setdefault(at, []).append(b)
        before.setdefault(b, [])
    leader: dict = {}
    for at in sorted(before):
        leader[at] = min((b for b in before[at] if leader[b] == b), default=at)
    kind = links["ord"].type
    return pa.table([pa.array(list(leader), kind), pa.array(list(leader.values()), kind)], names=["ord", "leader"])


def leaders(keys: DataFrame, threshold: float = fixed.ROW_AUTO, most: int | None = None) -> DataFrame:
    """Rows (ord, key, leader): each key with the first earlier leader that it scores ``threshold`` to, else itself.

    ``keys`` (ord, key) are distinct. Who leads depends only on keys that scores link, directly or not: components up to ``most`` links
    and keys go to tasks, which settle them in order, however long their chains are. Only larger components go in rounds: a key whose earlier neighbours are all settled
    is settled; it follows its first leader among them or becomes one.
    """
    most = most or LOCAL
    named = keys.select(F.lit("all").alias("source_id"), F.col("ord").alias("s_ord"), F.col("key").alias("src_key"))
    scored, members, _ = kind_scores(keys.select(F.col("ord").alias("t_ord"), F.col("key").alias("tgt_key")), named, least=threshold, earlier=True)
    members, every = kept(members.select(F.col("t_ord").alias("ord"), F.col("t_kind").alias("kind")), "leader-members"), keys
    edges = kept(scored.select(F.col("t_kind").alias("ord"), F.col("s_kind").alias("before")), "leader-edges")
    keys = members.where("ord = kind").select("ord")  # further keys of a kind follow its first
    kind = dict(edges.dtypes)["ord"]
    locally = lambda dealt: kept(dealt.groupBy("bucket").applyInArrow(lambda t: follow(t), f"ord {kind}, leader {kind}"), "leader-local")
    linked = edges.select("ord").union(edges.select("before")).distinct()
    alone = keys.join(linked, "ord", "left_anti").select("ord", F.col("ord").alias("leader"))
    if edges.count() <= most:
        done = alone.unionByName(locally(edges.withColumn("bucket", F.lit(0))))
        return every.join(members, "ord").join(done.withColumnRenamed("ord", "kind"), "kind").select("ord", "key", "leader")
    name = lambda c: F.xxhash64(F.lit("k"), c)
    dealt = buckets(edges.select(name("ord").alias("a"), name("before").alias("b")), linked.select(name("ord").alias("node"), F.lit(1).cast("long").alias("n")), most, "leader")
    dealt = kept(edges.join(dealt.withColumnRenamed("node", "_node"), name("ord") == F.col("_node")).drop("_node"), "leader-dealt")
    settled = kept(alone.unionByName(locally(dealt.where("bucket is not null"))), "leader-settled")
    edges = kept(dealt.where("bucket is null").drop("bucket"), "leader-edges")
    heads = edges.select(F.col("before").alias("ord")).distinct().join(edges.select("ord").distinct(), "ord", "left_anti")
    done = kept(heads.select("ord", F.col("ord").alias("leader")), "leader-done")
    left = kept(edges.select("ord").distinct(), "leader-left")
    while not left.isEmpty():
        state = edges.join(left, "ord").join(done.select(F.col("ord").alias("before"), "leader"), "before", "left")
        open_ = state.groupBy("ord").agg(F.count_if(F.col("leader").isNull()).alias("_open"), F.min(F.when(F.col("leader") == F.col("before"), F.col("before"))).alias("_lead"), F.min(F.when(F.col("leader").isNull(), F.col("before"))).alias("_wait"))
        now = kept(open_.where((F.col("_open") == 0) | (F.col("_lead") < F.col("_wait"))).select("ord", F.coalesce("_lead", "ord").alias("leader")), "leader-now")
        done = kept(done.unionByName(now), "leader-done")
        left = kept(left.join(now.select("ord"), "ord", "left_anti"), "leader-left")
    done = settled.unionByName(done)
    return every.join(members, "ord").join(done.withColumnRenamed("ord", "kind"), "kind").select("ord", "key", "leader")
