"""Normalisation and extraction as expressions: each takes and returns columns, and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomfuse.functions import fixed

WIDE = "　" + "".join(map(chr, range(0xFF01, 0xFF5F)))
NARROW = " " + "".join(map(chr, range(0x21, 0x7F)))


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def half_width(c: Column) -> Column:
    """Full-width ASCII and the ideographic space as their half-width forms."""
    return F.translate(c, WIDE, NARROW)


def valid(c: Column) -> Column:
    """True for a cell that is neither null nor blank."""
    return F.coalesce(c.cast("string").rlike(r"(?U)\S"), F.lit(False))


def strip_parentheses(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), fixed.PARENTHESES, ""))


def leaf(c: Column) -> Column:
    """The last part of a path a>b>c."""
    return strip(F.substring_index(F.coalesce(c, F.lit("")), ">", -1))


def leaf_any(c: Column) -> Column:
    """The last part of a path, whichever of the three arrows divides it."""
    return leaf(F.translate(F.coalesce(c, F.lit("")), "＞→", ">>"))


def norm_name(c: Column) -> Column:
    """A column name without white space, underscores and hyphens, half-width, lower case; parentheses stay."""
    return F.lower(F.regexp_replace(half_width(strip(F.coalesce(c, F.lit("")))), r"(?U)[\s_\-]", ""))


def norm_name_folded(c: Column) -> Column:
    """As ``norm_name``, but runs of white space become one space."""
    return F.lower(F.regexp_replace(F.regexp_replace(half_width(strip(F.coalesce(c, F.lit("")))), r"(?U)\s+", " "), r"[_\-]", ""))


def unit_in_parentheses(c: Column) -> Column:
    """What the first parentheses hold, if it mentions a unit; else an empty string."""
    inside = strip(F.regexp_extract(half_width(strip(F.coalesce(c, F.lit("")))), fixed.IN_PARENTHESES, 1))
    return F.when(inside.rlike(fixed.UNITS), inside).otherwise(F.lit(""))


def norm_field(c: Column, fold: bool = False) -> Column:
    """A field name without parentheses, half-width, lower case, with ``_unit`` behind it if it names a unit.

    White space goes, or with ``fold`` runs of it become one space; underscores and hyphens go.
    """
    bare = F.regexp_replace(half_width(strip(F.coalesce(c, F.lit("")))), fixed.PARENTHESES, "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?U)\s+", " "), r"[_\-]", "") if fold else F.regexp_replace(bare, r"(?U)[\s_\-]", "")
    unit = unit_in_parentheses(c)
    return strip(F.concat(F.lower(bare), F.when(unit != "", F.concat(F.lit("_"), unit)).otherwise(F.lit(""))))


def unit_of(norm: Column) -> Column:
    """The unit of a normalised field name, empty without one."""
    return F.regexp_extract(norm, r"(?s)^[^_]*_(.*)$", 1)


def unit_conflict(a: Column, b: Column) -> Column:
    """True if both normalised field names have a unit and the units differ."""
    return (unit_of(a) != "") & (unit_of(b) != "") & (unit_of(a) != unit_of(b))


def norm_rowkey(c: Column) -> Column:
    """A row key reduced to what names the row: half-width, no parentheses, no range or section tail, no white space, lower case."""
    s = F.regexp_replace(half_width(strip(F.coalesce(c.cast("string"), F.lit("")))), fixed.PARENTHESES, "")
    s = F.regexp_replace(F.regexp_replace(s, fixed.RANGE_TAIL, ""), fixed.SECTION_TAIL, "")
    return F.lower(F.regexp_replace(s, r"(?U)[\s_\-]", ""))


def _number(c: Column, pattern: str) -> Column:
    mark = F.regexp_extract(c, pattern, 1)
    place = F.call_function("instr", F.lit(fixed.NUMERALS), mark)
    return F.when(mark == "", F.lit(None).cast("int")).when(mark.rlike("^[0-9]$"), mark.try_cast("int")).otherwise(place)


def phase(c: Column) -> Column:
    """The number of a phase (X期), null without one; only its last numeral counts."""
    return _number(c, fixed.PHASE)


def section(c: Column) -> Column:
    """The number of a section (第X标段), null without one."""
    return _number(c, fixed.SECTION)


def _any(c: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | c.contains(w)
    return found


def domain(c: Column) -> Column:
    """contract, project, entity or unknown, by the first list of DOMAINS that has a word of it; null for an empty key."""
    out = F.when(F.coalesce(c, F.lit("")) == "", F.lit(None).cast("string"))
    for name, words in fixed.DOMAINS.items():
        out = out.when(_any(c, words), F.lit(name))
    return out.otherwise(F.lit("unknown"))


def field_category(c: Column) -> Column:
    """location, project, entity, amount, date or general, as the words of CATEGORIES tell."""
    has = {k: _any(F.coalesce(c, F.lit("")), v) for k, v in fixed.CATEGORIES.items()}
    out = F.when(has["entity"], "entity").when(has["project"], "project").when(has["location"], "location")
    return out.when(has["amount"], "amount").when(has["date"], "date").otherwise("general")


def kind_tag(c: Column) -> Column:
    """The first of TAGS that a field name has a word of; empty without one."""
    out = F.when(c.isNull(), "")
    for tag, words in fixed.TAGS.items():
        out = out.when(_any(c, words), F.lit(tag))
    return out.otherwise("")


def phase_tag(c: Column) -> Column:
    """The first of PHASE_TAGS that the first part of a field's path holds, else that part itself; empty for an empty name."""
    top = strip(F.substring_index(F.translate(F.coalesce(c, F.lit("")), "＞→", ">>"), ">", 1))
    out = F.when(top == "", "")
    for p in fixed.PHASE_TAGS:
        out = out.when(top.contains(p), F.lit(p))
    return out.otherwise(top)


def direction(c: Column) -> Column:
    """start, end or both, as the last part of a field's path tells; null if it tells nothing."""
    part = F.when(leaf(c) != "", leaf(c)).otherwise(c)
    starts, ends = _any(part, fixed.START_WORDS), _any(part, fixed.END_WORDS)
    return F.when(starts & ends, "both").when(starts, "start").when(ends, "end")


def tokens(c: Column, words: list[str]) -> Column:
    """The ``words`` that occur, in the order of the list, each taken once out of what is left; then what is left if two characters or more."""

    def take(state: Column, word: Column) -> Column:
        at = F.call_function("instr", state["rest"], word)
        rest = F.concat(F.substring(state["rest"], F.lit(1), at - 1), F.substring(state["rest"], at + F.length(word), F.length(state["rest"])))
        return F.when(at > 0, F.struct(rest.alias("rest"), F.concat(state["found"], F.array(word)).alias("found"))).otherwise(state)

    start = F.struct(c.alias("rest"), F.array().cast("array<string>").alias("found"))
    done = lambda s: F.when(F.length(s["rest"]) >= 2, F.concat(s["found"], F.array(s["rest"]))).otherwise(s["found"])
    return F.aggregate(F.array(*map(F.lit, words)), start, take, done)


def jaccard(a: Column, b: Column) -> Column:
    """Shared distinct elements over all distinct elements; null if there are none."""
    total = F.size(F.array_union(a, b))
    return F.when(total > 0, F.size(F.array_intersect(a, b)) / total)


def strip_generics(c: Column) -> Column:
    """A key without the generic prefixes and suffixes, taken off one at a time, but never down to nothing."""

    def step(core: Column, _: Column) -> Column:
        out = F
        for p in fixed.GENERIC_PREFIXES:
            out = out.when(core.startswith(p) & (F.length(core) > len(p)), F.substring(core, F.lit(len(p) + 1), F.length(core)))
        for s in fixed.GENERIC_SUFFIXES:
            out = out.when(core.endswith(s) & (F.length(core) > len(s)), F.substring(core, F.lit(1), F.length(core) - len(s)))
        return out.otherwise(core)

    return F.aggregate(F.sequence(F.lit(0), F.length(c)), c, step)


def road(c: Column) -> Column:
    """A road with its end points, name（A-B）, as struct(road, ends); null for anything else."""
    squeeze = lambda x: F.regexp_replace(F.lower(half_width(x)), r"(?U)[\s_\-]", "")
    name, inside = F.regexp_extract(c, fixed.ROAD, 1), F.regexp_extract(c, fixed.ROAD, 2)
    ends = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(inside, "[-~至到]", -1), squeeze), lambda e: e != "")))
    return F.when((inside != "") & (F.size(ends) > 0), F.struct(squeeze(name).alias("road"), ends.alias("ends")))


def code_tokens(c: Column) -> Column:
    """The runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(c, F.lit("([A-Za-z0-9]+)"), 1)


def longest_digits(c: Column) -> Column:
    """The longest run of digits, of equal ones the first; empty without digits."""
    runs = F.regexp_extract_all(c, F.lit("([0-9]+)"), 1)
    return F.aggregate(runs, F.lit(""), lambda best, r: F.when(F.length(r) > F.length(best), r).otherwise(best))


def date_text(c: Column) -> Column:
    """A time as text: the date alone at midnight, else date and time."""
    midnight = (F.hour(c) == 0) & (F.minute(c) == 0) & (F.second(c) == 0)
    return F.when(midnight, F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))


def zone(c: Column) -> Column:
    """A header zone "i-j" as struct(start, end), null if it is not one."""
    a, b = F.regexp_extract(c, r"^\s*(\d+)\s*-\s*(\d+)\s*$", 1), F.regexp_extract(c, r"^\s*(\d+)\s*-\s*(\d+)\s*$", 2)
    return F.when(a != "", F.struct(a.try_cast("int").alias("start"), b.try_cast("int").alias("end")))


def fuzzy(c: Column, query: str) -> Column:
    """True if every word of ``query`` is part of the text or, from three characters on, a subsequence of it; case is ignored."""
    import re

    low, found = F.lower(F.coalesce(c, F.lit(""))), F.lit(True)
    for word in query.lower().split():
        hit = low.contains(word)
        if len(word) > 2:
            hit = hit | low.rlike("(?s)" + ".*".join(map(re.escape, word)))
        found = found & hit
    return found


def nonempty_count(columns: list[Column]) -> Column:
    """How many of the cells are valid."""
    return sum((valid(c).cast("int") for c in columns), F.lit(0))
