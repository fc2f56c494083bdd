"""Queries of keys, matching and filling, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomfuse.functions import text
from loomfuse.operators import catalog, fill, keys, lexicon, row_match, schema_match
from loomfuse.plans.text_queries import table


def key_autodetect(spark, d):
    """The key column of each of three tables, and the valid cells of each column."""
    out = None
    for name in ("customer", "orders", "events"):
        df = table(spark, d, name)
        counts = keys.valid_counts(df)
        key = keys.detect_key(df, counts)
        rows = spark.createDataFrame([(name, c, n, c == key) for c, n in counts.items()], "tab string, col string, n_valid long, is_key boolean")
        out = rows if out is None else out.unionByName(rows)
    return out


def gaps(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "click", F.col("user_id")).alias("key"))


def ffill_key(spark, d):
    return keys.forward_fill(gaps(spark, d), "key", "event_id", block=4096)


def ffill_key_by_type(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.when(F.col("value") > 30, F.col("user_id")).alias("key"))
    return keys.forward_fill(e, "key", "event_id", by=["event_type"], block=1000)


def key_index_dups(spark, d):
    return keys.key_index(table(spark, d, "events"), "user_id", "event_id")


def distinct_keys(spark, d):
    return keys.distinct_in_order(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


def field_catalog(spark, d):
    a = catalog.field_catalog(table(spark, d, "customer"), "customer", 0, "c_custkey")
    b = catalog.field_catalog(table(spark, d, "supplier"), "supplier", 1, "s_suppkey")
    return a.unionByName(b).select("source_id", "ord", "field", F.array_join("samples", " / ").alias("samples"))


def canonical_terms(spark, d):
    terms = lexicon.with_norm(table(spark, d, "part").select(F.col("p_size").alias("group_id"), (F.col("p_partkey") - F.min("p_partkey").over(_by_size())).cast("int").alias("pos"), F.col("p_name").alias("term")))
    return lexicon.canonical(terms).select("norm", F.size("groups").alias("n_groups"), "canon")


def _by_size():
    from pyspark.sql import Window

    return Window.partitionBy("p_size")


def dict_json_explode(spark, d):
    props = table(spark, d, "events").select(F.explode(F.from_json("props", "map<string,long>")).alias("name", "v"), "event_id")
    return props.groupBy("name", "v").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def dictionary_groups(spark, d):
    """Part names by type, written as the JSON of a dictionary and read back as a lexicon."""
    rows = table(spark, d, "part").groupBy("p_type").agg(F.array_sort(F.collect_set("p_name")).alias("w"))
    content = rows.select(F.to_json(F.struct(F.create_map("p_type", "w").alias("synonyms"))).alias("value"))
    return lexicon.from_json(spark, content).groupBy("norm").agg(F.count("*").alias("n"))


def matches_of_orders(spark, d):
    """Orders as match decisions: the price stands for the confidence."""
    o = table(spark, d, "orders")
    score = F.col("o_totalprice") / 5000
    return o.select(F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("tgt_field"), F.col("o_custkey").cast("string").alias("src_field"), F.lit("f").alias("src_file"), F.lit("s").alias("src_sheet"), F.lit(0.0).alias("confidence"), (score >= 85).alias("auto"), (score >= 85).alias("matched"), ((score >= 60) & (score < 85)).alias("suggested"))


def match_conflicts(spark, d):
    return schema_match.flag_conflicts(matches_of_orders(spark, d)).select("ord", "src_field", "matched", "conflict")


def match_summary(spark, d):
    return schema_match.status_summary(schema_match.flag_conflicts(matches_of_orders(spark, d)))


def match_updates(spark, d):
    m = schema_match.flag_conflicts(matches_of_orders(spark, d))
    changes = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").cast("string").alias("tgt_field"), F.when(F.col("o_custkey") % 2 == 0, F.lit("7")).alias("new_field"), F.lit("f").alias("new_file"), F.lit("s").alias("new_sheet"))
    return schema_match.update_matches(m, changes).select("ord", "src_field", "matched", "suggested", "conflict")


def candidate_topk(spark, d):
    p = table(spark, d, "part")
    scored = p.select(F.col("p_partkey").cast("string").alias("src"), F.col("p_brand").alias("tgt"), (F.col("p_retailprice") % 97).alias("score"))
    fields = p.select(F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("name"), F.lit("f").alias("file"), F.lit("s").alias("sheet"))
    return schema_match.ranked_candidates(scored, fields).select("tgt", "rank", "src", "score", "star")


def field_pairs(spark, d):
    """Part names against names of brand and type; as names are few, so are the pairs."""
    p = table(spark, d, "part")
    a, b = p.select(F.col("p_name").alias("src")).distinct(), p.select(F.concat_ws(">", "p_type", "p_name").alias("tgt")).distinct()
    return a.join(F.broadcast(b), F.split("src", " ")[0] == F.split(F.split("tgt", ">")[1], " ")[0])


def field_scores(spark, d):
    terms = lexicon.lexicon(spark, [["red ring", "red ring thing"], ["bolt", "nut"]])
    return schema_match.score_fields(field_pairs(spark, d), terms)


def field_matches(spark, d):
    pairs = field_pairs(spark, d)
    scored = schema_match.score_fields(pairs, lexicon.lexicon(spark))
    number = lambda c: F.dense_rank().over(_all().orderBy(c)).cast("int")
    src = pairs.select("src").distinct().select(number("src").alias("ord"), F.col("src").alias("name"), F.lit("part").alias("file"), F.lit("s").alias("sheet"))
    tgt = pairs.select("tgt").distinct().select(number("tgt").alias("ord"), F.col("tgt").alias("name"))
    return schema_match.auto_match(scored, src, tgt)


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def targets(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("t_ord"), F.col("s_name").alias("tgt_key"))


def sources(spark, d):
    return table(spark, d, "customer").select(F.lit("customer").alias("source_id"), F.col("c_custkey").alias("s_ord"), F.col("c_name").alias("src_key"))


def row_scores(spark, d):
    return row_match.scored_candidates(targets(spark, d), sources(spark, d))


def align_rows(spark, d):
    return row_match.align_keys(targets(spark, d), sources(spark, d)).select("t_ord", "s_ord", "score")


def align_preview(spark, d):
    return row_match.preview(targets(spark, d), sources(spark, d)).select("t_ord", "src_key", "score", "status")


#: A letter of another script for each Latin one: names without codes, so that spelling alone decides.
LETTERS, BIRDS = "abcdefghijklmnopqrstuvwxyz", "鹊鸦鹰鹤鹭鸥鸽鸾鹦鹉鹌鹑鹧鸪鸳鸯鸵鸭鸡鹅鸢鸩鸨鹞鹫鹬"


def spelled(spark, d):
    """Names of parts, and names that begin or end otherwise, as keys of another script: (targets, sources)."""
    part = table(spark, d, "part")
    named = lambda c: F.translate(c, LETTERS, BIRDS)
    t = part.groupBy(named(F.col("p_name")).alias("tgt_key")).agg(F.min("p_partkey").alias("t_ord"))
    other = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("the "), "p_name")).when(F.col("p_size") % 3 == 1, F.concat("p_name", F.lit("s"))).otherwise(F.concat(F.reverse(F.split(F.col("p_name"), " ")[0]), F.split(F.col("p_name"), " ")[1]))
    s = part.groupBy(named(other).alias("src_key")).agg(F.min("p_partkey").alias("s_ord")).select(F.lit("part").alias("source_id"), "s_ord", "src_key")
    return t, s


def spelled_scores(spark, d):
    return row_match.scored_candidates(*spelled(spark, d)).select("tgt_key", "src_key", F.round("score", 9).alias("score"))


def suggested_preview(spark, d):
    """Names of parts against names of which half have a word more: those are suggested, as their codes differ."""
    part = table(spark, d, "part")
    t = part.groupBy(F.col("p_name").alias("tgt_key")).agg(F.min("p_partkey").alias("t_ord"))
    s = t.select(F.lit("part").alias("source_id"), F.col("t_ord").alias("s_ord"), F.when(F.col("t_ord") % 2 == 0, F.col("tgt_key")).otherwise(F.concat("tgt_key", F.lit(" plus"))).alias("src_key"))
    return row_match.preview(t.where("t_ord % 5 <> 3"), s).select("tgt_key", "src_key", "score", "status")


def key_leaders(spark, d):
    named = table(spark, d, "part").groupBy(F.col("p_name").alias("key")).agg(F.min("p_partkey").alias("ord"))
    return row_match.leaders(named.select("ord", "key"))


def linked_leaders(spark, d):
    """Names of customers and suppliers, one after the other: those with the same long number follow the first."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    names = c.select(F.col("c_custkey").alias("ord"), F.col("c_name").alias("key")).unionByName(s.select((F.col("s_suppkey") + 10_000_000).alias("ord"), F.col("s_name").alias("key")))
    return row_match.leaders(names)


def override_effective(spark, d):
    own = targets(spark, d).select(F.lit("customer").alias("source_id"), F.col("tgt_key"))
    aligned = sources(spark, d).select("source_id", F.concat(F.lit("Supplier"), F.substring("src_key", 9, 99)).alias("tgt_key"), "src_key")
    given = targets(spark, d).where("t_ord % 3 = 0").select("tgt_key", F.when(F.col("t_ord") % 2 == 0, F.lit("x")).alias("src_key"))
    return fill.effective_keys(own, aligned, given).select("tgt_key", "src_key")


def order_cells(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("tgt_row"), F.col("o_custkey").cast("string").alias("key"), F.lit("value").alias("field"), F.col("o_orderpriority").alias("value"))


def event_source(spark, d):
    e = table(spark, d, "events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return fill.source_cells(e, "events", 0, "user_id", "event_id", ["value"])


def one_match(spark, rows):
    return spark.createDataFrame(rows, "tgt_field string, src_field string, source_id string")


def rank_fill(spark, d):
    cells = order_cells(spark, d)
    own = cells.select(F.lit("events").alias("source_id"), F.col("key").alias("tgt_key")).distinct()
    none = own.limit(0).withColumn("src_key", F.lit(None).cast("string"))
    return fill.fill_cells(cells, event_source(spark, d), fill.effective_keys(own, none), one_match(spark, [("value", "value", "events")])).select("tgt_row", "old", F.col("value").alias("filled"))


def _nation_fill(spark, d, policy):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("row"), F.col("n_nationkey").cast("string").alias("key"), "n_name", F.lit(None).cast("string").alias("who"), F.lit(None).cast("string").alias("lost"))
    a = fill.source_cells(table(spark, d, "customer"), "customer", 0, "c_nationkey", "c_custkey", ["c_name"])
    b = fill.source_cells(table(spark, d, "supplier"), "supplier", 1, "s_nationkey", "s_suppkey", ["s_name"])
    own = n.select("key").crossJoin(spark.createDataFrame([("customer",), ("supplier",)], "source_id string")).select("source_id", F.col("key").alias("tgt_key"))
    none = own.limit(0).withColumn("src_key", F.lit(None).cast("string"))
    matches = one_match(spark, [("who", "c_name", "customer"), ("who", "s_name", "supplier"), ("gone", "s_name", "supplier")])
    return fill.fill(n, "key", "row", a.unionByName(b), fill.effective_keys(own, none), matches, policy)


def fill_first_source(spark, d):
    return _nation_fill(spark, d, "locked")[0].select("row", "who")


def fill_latest_source(spark, d):
    return _nation_fill(spark, d, "coalesce_latest")[0].select("row", "who")


def fill_stats(spark, d):
    return _nation_fill(spark, d, "coalesce_latest")[1]


def template_expand(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_idx"), F.col("s_name").alias("key"), "s_acctbal")
    new = table(spark, d, "supplier").select(F.concat(F.lit("New"), "s_name").alias("key"), F.col("s_suppkey").alias("ord"))
    return keys.expand_target(s, new, "key", "row_idx")


def flagship(spark, d):
    """Orders filled with the name and balance of their customer: keys normalised, aligned, joined by rank, and counted."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    cells = o.select(F.col("o_orderkey").alias("tgt_row"), F.col("o_custkey").cast("string").alias("key"), F.explode(F.array(F.lit("name"), F.lit("balance"))).alias("field"), F.lit(None).cast("string").alias("value"))
    src = fill.source_cells(c, "customer", 0, "c_custkey", "c_custkey", ["c_name", "c_acctbal"])
    own = cells.select(F.lit("customer").alias("source_id"), F.col("key").alias("tgt_key")).distinct()
    aligned = own.select("source_id", "tgt_key", text.norm_rowkey(F.col("tgt_key")).alias("src_key"))
    got = fill.fill_cells(cells, src, fill.effective_keys(own, aligned), one_match(spark, [("name", "c_name", "customer"), ("balance", "c_acctbal", "customer")]))
    return got.groupBy("field").agg(F.count("*").alias("n_cells"), F.count("value").alias("n_filled"))


QUERIES = {f.__name__: f for f in (
    key_autodetect, ffill_key, ffill_key_by_type, key_index_dups, distinct_keys, field_catalog, canonical_terms, dict_json_explode, dictionary_groups, match_conflicts, match_summary, match_updates, candidate_topk,
    field_scores, field_matches, row_scores, align_rows, align_preview, spelled_scores, suggested_preview, key_leaders, linked_leaders, override_effective, rank_fill, fill_first_source, fill_latest_source, fill_stats, template_expand, flagship,
)}

_MATCHES = """
m AS (SELECT o_orderkey AS ord, o_orderstatus, o_custkey, CAST(o_custkey AS VARCHAR) AS src_field, o_totalprice / 5000 >= 85 AS matched, o_totalprice / 5000 >= 60 AND o_totalprice / 5000 < 85 AS suggested FROM orders)"""
_COUNT = lambda t, cols: " UNION ALL ".join(f"SELECT '{t}' AS tab, '{c}' AS col, count({c}) AS n_valid, {i} AS i FROM {t}" for i, c in enumerate(cols))
_SAMPLE = lambda s, o, cols, t: " UNION ALL ".join(f"SELECT '{s}' AS source_id, {i} AS ord, '{c}' AS field, string_agg(substr(CAST({c} AS VARCHAR), 1, 40), ' / ' ORDER BY {o}) AS samples FROM (SELECT * FROM {t} WHERE {c} IS NOT NULL ORDER BY {o} LIMIT 3)" for i, c in enumerate(cols))
_ALIGNED = """
t AS (SELECT s_suppkey AS t_ord, s_name AS tgt_key, substr(s_name, 10) AS n FROM supplier), s AS (SELECT c_custkey AS s_ord, c_name AS src_key, substr(c_name, 10) AS n FROM customer),
pair AS (SELECT t_ord, s_ord, tgt_key, src_key, 0.92 AS score FROM t JOIN s ON t.n = s.n)"""

# Names are an adjective and a noun. A target is a path that ends in a name; below the cases of equal last parts and of
# a shared beginning stands the score of the last parts themselves, by how many letters they share in order.
_FIELDS = """
pair AS (
  SELECT DISTINCT a.p_name AS src, b.p_type || '>' || b.p_name AS tgt, b.p_name AS leaf, replace(a.p_name, ' ', '') AS s, replace(b.p_name, ' ', '') AS t
  FROM part a JOIN part b ON string_split(a.p_name, ' ')[1] = string_split(b.p_name, ' ')[1]
), letter AS (
  SELECT *, string_split(s, '') AS x, string_split(t, '') AS y FROM (SELECT DISTINCT s, t FROM pair)
), lcs AS (
  SELECT s, t, list_reduce(x, lambda acc, ch: list_reduce(range(1, len(y) + 1), lambda r, j: list_append(r, CASE WHEN ch = y[j] THEN coalesce(acc[j - 1], 0) + 1 ELSE greatest(acc[j], coalesce(r[len(r)], 0)) END), []::INTEGER[]), list_transform(y, lambda z: 0)) AS row FROM letter
), alike AS (
  SELECT s, t, 2.0 * row[len(row)] / (length(s) + length(t)) AS r, (SELECT coalesce(max(k), 0) FROM (SELECT unnest(range(1, least(length(s), length(t)) + 1)) AS k) WHERE s[1:k] = t[1:k]) AS shared FROM lcs
), scored AS (
  SELECT src, tgt, CASE WHEN src = leaf THEN 95.0
    WHEN abs(length(s) - length(t)) <= greatest(3, 0.5 * least(length(s), length(t))) AND r >= 0.75 THEN 75 + (r - 0.75) * 52
    WHEN abs(length(s) - length(t)) <= greatest(3, 0.5 * least(length(s), length(t))) AND r >= 0.65 THEN 65 + (r - 0.65) * 100
    WHEN shared >= 2 AND shared >= 0.4 * least(length(s), length(t)) THEN 65.0 ELSE 0.0 END AS score
  FROM pair JOIN alike USING (s, t)
)"""

# How alike two keys t and s are, by letters in order and by the longest run, and the score that spelling gives them.
_SPELLED = """
letters AS (SELECT DISTINCT t, s, string_split(t, '') AS a, string_split(s, '') AS b FROM pair), k AS (
  SELECT t, s, len(a) AS la, len(b) AS lb,
    list_reduce(a, lambda acc, x: list_reduce(range(1, len(b) + 1), lambda r, j: list_append(r, CASE WHEN x = b[j] THEN coalesce(acc[j - 1], 0) + 1 ELSE greatest(acc[j], coalesce(r[len(r)], 0)) END), []::INTEGER[]), list_transform(b, lambda y: 0)) AS seq,
    list_reduce(a, lambda acc, x: list_append(list_transform(range(1, len(b) + 1), lambda j: CASE WHEN x = b[j] THEN coalesce(acc[j - 1], 0) + 1 ELSE 0 END),
      greatest(acc[len(b) + 1], list_max(list_transform(range(1, len(b) + 1), lambda j: CASE WHEN x = b[j] THEN coalesce(acc[j - 1], 0) + 1 ELSE 0 END)))), list_transform(list_append(b, ''), lambda y: 0)) AS run
  FROM letters
), alike AS (SELECT t, s, la, lb, 2.0::DOUBLE * seq[len(seq)] / (la + lb) AS ratio, run[len(run)] AS common FROM k), spelt AS (
  SELECT t, s, CASE WHEN t = s THEN 1.0::DOUBLE ELSE least(CASE
    WHEN least(la, lb) >= 4 AND (contains(t, s) OR contains(s, t)) THEN 0.97::DOUBLE WHEN common >= 0.6::DOUBLE * least(la, lb) AND ratio >= 0.7 THEN 0.85::DOUBLE + 0.15::DOUBLE * ratio WHEN ratio >= 0.9 THEN ratio ELSE 0.0 END,
    CASE WHEN abs(la - lb) / greatest(la, lb) > 0.34 THEN 0.72::DOUBLE ELSE 1.0 END) END AS score FROM alike
)"""

SQL = {
    "spelled_scores": f"""
WITH named AS (
  SELECT translate(p_name, '{LETTERS}', '{BIRDS}') AS tgt_key, translate(CASE p_size % 3 WHEN 0 THEN 'the ' || p_name WHEN 1 THEN p_name || 's' ELSE reverse(string_split(p_name, ' ')[1]) || string_split(p_name, ' ')[2] END, '{LETTERS}', '{BIRDS}') AS src_key FROM part
), pair AS (
  SELECT a.tgt_key, b.src_key, replace(a.tgt_key, ' ', '') AS t, replace(b.src_key, ' ', '') AS s FROM (SELECT DISTINCT tgt_key FROM named) a, (SELECT DISTINCT src_key FROM named) b
), {_SPELLED}
SELECT tgt_key, src_key, round(score, 9) AS score FROM pair JOIN spelt USING (t, s) WHERE score >= 0.6 - 1e-9""",
    "suggested_preview": f"""
WITH name AS (
  SELECT p_name AS tgt_key, min(p_partkey) AS ord FROM part GROUP BY p_name
), pair AS (
  SELECT a.tgt_key, b.ord AS s_ord, CASE WHEN b.ord % 2 = 0 THEN b.tgt_key ELSE b.tgt_key || ' plus' END AS src_key, replace(a.tgt_key, ' ', '') AS t, replace(CASE WHEN b.ord % 2 = 0 THEN b.tgt_key ELSE b.tgt_key || ' plus' END, ' ', '') AS s
  FROM name a, name b WHERE a.ord % 5 <> 3
), {_SPELLED}, best AS (
  SELECT tgt_key, src_key, CASE WHEN pair.t = pair.s THEN 1.0 ELSE least(score, 0.6) END AS score FROM pair JOIN spelt ON spelt.t = pair.t AND spelt.s = pair.s
  QUALIFY row_number() OVER (PARTITION BY tgt_key ORDER BY CASE WHEN pair.t = pair.s THEN 1.0 ELSE least(score, 0.6) END DESC, s_ord) = 1
)
SELECT tgt_key, CASE WHEN score >= 0.6 THEN src_key END AS src_key, CASE WHEN score >= 0.6 THEN score ELSE 0.0 END::DOUBLE AS score, CASE WHEN score = 1 THEN 'auto' WHEN score >= 0.6 THEN 'suggest' ELSE 'unmatched' END AS status FROM best""",
    "field_scores": f"WITH {_FIELDS} SELECT src, tgt, CAST(score AS DOUBLE) AS score FROM scored",
    "field_matches": f"""
WITH {_FIELDS}, best AS (
  SELECT tgt, src, score FROM scored QUALIFY row_number() OVER (PARTITION BY tgt ORDER BY score DESC, src) = 1
), m AS (
  SELECT CAST(dense_rank() OVER (ORDER BY tgt) AS INTEGER) AS ord, tgt AS tgt_field, CASE WHEN score >= 60 THEN src END AS src_field, CASE WHEN score >= 60 THEN 'part' END AS src_file, CASE WHEN score >= 60 THEN 's' END AS src_sheet,
    CAST(CASE WHEN score >= 60 THEN round(score, 1) ELSE 0 END AS DOUBLE) AS confidence, score >= 85 AS auto, score >= 85 AS matched, score >= 60 AND score < 85 AS suggested FROM best
)
SELECT *, matched AND count(*) FILTER (WHERE matched) OVER (PARTITION BY src_field) > 1 AS conflict FROM m""",
    "key_leaders": "SELECT min(p_partkey) AS ord, p_name AS key, min(p_partkey) AS leader FROM part GROUP BY p_name",
    "linked_leaders": """
SELECT c_custkey AS ord, c_name AS key, c_custkey AS leader FROM customer
UNION ALL SELECT s_suppkey + 10000000, s_name, coalesce(c_custkey, s_suppkey + 10000000) FROM supplier LEFT JOIN customer ON substr(c_name, 10) = substr(s_name, 10)""",
    "key_autodetect": f"""
WITH n AS ({_COUNT('customer', ['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment'])} UNION ALL {_COUNT('orders', ['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority'])}
  UNION ALL {_COUNT('events', ['event_id', 'ts', 'user_id', 'event_type', 'value', 'props'])})
SELECT tab, col, n_valid, row_number() OVER (PARTITION BY tab ORDER BY n_valid DESC, i) = 1 AS is_key FROM n""",
    "ffill_key": "SELECT event_id, last_value(key IGNORE NULLS) OVER (ORDER BY event_id) AS key FROM (SELECT event_id, CASE WHEN event_type <> 'click' THEN user_id END AS key FROM events)",
    "ffill_key_by_type": "SELECT event_id, event_type, last_value(key IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id) AS key FROM (SELECT event_id, event_type, CASE WHEN value > 30 THEN user_id END AS key FROM events)",
    "key_index_dups": "SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n_rows, min(event_id) AS first_row, count(*) > 1 AS duplicate FROM events WHERE user_id IS NOT NULL GROUP BY user_id",
    "distinct_keys": "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey",
    "field_catalog": f"{_SAMPLE('customer', 'c_custkey', ['c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment'], 'customer')} UNION ALL {_SAMPLE('supplier', 's_suppkey', ['s_name', 's_nationkey', 's_acctbal'], 'supplier')}",
    "canonical_terms": r"""
WITH t AS (SELECT p_size AS g, p_partkey, lower(regexp_replace(p_name, '[\s_\-]', '', 'g')) AS norm FROM part), st AS (SELECT g, arg_min(norm, p_partkey) AS standard FROM t GROUP BY g)
SELECT norm, CAST(count(DISTINCT t.g) AS INTEGER) AS n_groups, arg_max(standard, t.g) AS canon FROM t JOIN st ON t.g = st.g GROUP BY norm""",
    "dict_json_explode": "SELECT name, v, count(*) AS n, min(event_id) AS first FROM (SELECT event_id, unnest(json_keys(props)) AS name, CAST(json_extract(props, '$.' || unnest(json_keys(props))) AS BIGINT) AS v FROM events) GROUP BY ALL",
    "dictionary_groups": r"""
SELECT norm, count(*) AS n FROM (SELECT lower(regexp_replace(p_name, '[\s_\-]', '', 'g')) AS norm FROM (SELECT DISTINCT p_type, p_name FROM part) UNION ALL SELECT lower(regexp_replace(p_type, '[\s_\-]', '', 'g')) FROM (SELECT DISTINCT p_type FROM part)) GROUP BY norm""",
    "match_conflicts": f"WITH {_MATCHES} SELECT ord, src_field, matched, matched AND count(*) FILTER (WHERE matched) OVER (PARTITION BY src_field) > 1 AS conflict FROM m",
    "match_summary": f"WITH {_MATCHES}, c AS (SELECT *, matched AND count(*) FILTER (WHERE matched) OVER (PARTITION BY src_field) > 1 AS conflict FROM m) SELECT count(*) FILTER (WHERE matched) AS matched, count(*) FILTER (WHERE suggested) AS suggested, count(*) FILTER (WHERE NOT matched AND NOT suggested) AS unmatched, count(*) FILTER (WHERE conflict) AS conflicts FROM c",
    "match_updates": f"""
WITH {_MATCHES}, u AS (
  SELECT ord, CASE WHEN o_orderstatus <> 'P' THEN src_field WHEN o_custkey % 2 = 0 THEN '7' END AS src_field, CASE WHEN o_orderstatus <> 'P' THEN matched ELSE o_custkey % 2 = 0 END AS matched, o_orderstatus <> 'P' AND suggested AS suggested FROM m
) SELECT *, matched AND count(*) FILTER (WHERE matched) OVER (PARTITION BY src_field) > 1 AS conflict FROM u""",
    "candidate_topk": """
SELECT p_brand AS tgt, rank, CAST(p_partkey AS VARCHAR) AS src, round(score, 1) AS score, rank <= 3 AND score >= 85 AS star
FROM (SELECT *, p_retailprice % 97 AS score, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice % 97 DESC, p_partkey) AS INTEGER) AS rank FROM part) WHERE rank <= 30""",
    "row_scores": f"WITH {_ALIGNED} SELECT 'customer' AS source_id, t_ord, s_ord, tgt_key, src_key, CAST(score AS DOUBLE) AS score FROM pair",
    "align_rows": f"WITH {_ALIGNED} SELECT t_ord, s_ord, CAST(score AS DOUBLE) AS score FROM pair",
    "align_preview": f"WITH {_ALIGNED} SELECT t.t_ord, p.src_key, coalesce(CAST(p.score AS DOUBLE), 0.0) AS score, CASE WHEN p.src_key IS NULL THEN 'unmatched' ELSE 'auto' END AS status FROM t LEFT JOIN pair p ON p.t_ord = t.t_ord",
    "override_effective": f"WITH {_ALIGNED} SELECT t.tgt_key, CASE WHEN t.t_ord % 6 = 0 THEN 'x' WHEN t.t_ord % 3 = 0 THEN NULL ELSE coalesce(p.src_key, t.tgt_key) END AS src_key FROM t LEFT JOIN pair p ON p.t_ord = t.t_ord",
    "rank_fill": """
WITH t AS (SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type <> 'error' AND value IS NOT NULL)
SELECT o_orderkey AS tgt_row, o_orderpriority AS old, CAST(s.value AS VARCHAR) AS filled FROM t LEFT JOIN s ON s.user_id = t.o_custkey AND s.k = t.k""",
    "fill_first_source": """
SELECT CAST(n_nationkey AS BIGINT) AS row, coalesce((SELECT arg_min(c_name, c_custkey) FROM customer WHERE c_nationkey = n_nationkey), (SELECT arg_min(s_name, s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey)) AS who FROM nation""",
    "fill_latest_source": """
SELECT CAST(n_nationkey AS BIGINT) AS row, coalesce((SELECT arg_min(s_name, s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), (SELECT arg_min(c_name, c_custkey) FROM customer WHERE c_nationkey = n_nationkey)) AS who FROM nation""",
    "fill_stats": """
SELECT 'who' AS tgt_field, 'ok' AS status, (SELECT count(*) FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) OR n_nationkey IN (SELECT c_nationkey FROM customer)) AS cells, NULL::VARCHAR AS reason
UNION ALL SELECT 'gone', 'skip', 0, 'unknown target field'""",
    "template_expand": "SELECT s_suppkey AS row_idx, s_name AS key, s_acctbal FROM supplier UNION ALL SELECT s_suppkey + (SELECT max(s_suppkey) + 1 FROM supplier) - (SELECT min(s_suppkey) FROM supplier), 'New' || s_name, NULL FROM supplier",
    "flagship": "SELECT field, count(*) AS n_cells, sum(CASE WHEN k = 1 AND c_custkey IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS n_filled FROM (SELECT o.*, c_custkey, unnest(['name', 'balance']) AS field, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders o LEFT JOIN customer c ON o_custkey = c_custkey) GROUP BY field",
}
