"""Queries of normalisation, extraction and grids, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfuse.functions import fixed, text
from loomfuse.functions.kernels import BITS, letter_places, pair_kernel, paired, unwalked, walked
from loomfuse.operators import headers
from loomfuse.sources.grid import lines_as_cells


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def norm_rowkey(spark, d):
    return table(spark, d, "documents").select("doc_id", text.norm_rowkey(F.col("text")).alias("norm"))


def norm_names(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.norm_name(c).alias("squeezed"), text.norm_name_folded(c).alias("folded"), text.strip_parentheses(c).alias("bare"))


def _field():
    return F.concat_ws("", F.col("p_name"), F.lit(" _ "), F.col("p_brand"), F.lit("（"), F.col("p_size").cast("string"), F.lit("个）"))


def norm_field_units(spark, d):
    named = table(spark, d, "part").select("p_partkey", _field().alias("field"))
    return named.select("p_partkey", text.norm_field(F.col("field")).alias("norm"), text.norm_field(F.col("field"), fold=True).alias("folded"), text.unit_of(text.norm_field(F.col("field"))).alias("unit"))


def unit_conflicts(spark, d):
    a, b = F.concat("p_name", F.lit("(万元)")), F.concat("p_name", F.when(F.col("p_size") % 3 == 0, "(元)").when(F.col("p_size") % 3 == 1, "(万元)").otherwise(""))
    return table(spark, d, "part").select("p_partkey", text.unit_conflict(text.norm_field(a), text.norm_field(b)).alias("conflict"))


def leaf_segment(spark, d):
    c = F.concat_ws(" > ", "p_type", "p_brand", "p_name")
    return table(spark, d, "part").select("p_partkey", text.leaf(c).alias("leaf"), text.leaf_any(F.translate(c, ">", "→")).alias("leaf_any"))


def code_tokens(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(text.code_tokens(F.col("url")), " ").alias("codes"), text.longest_digits(F.col("url")).alias("digits"))


def _key():
    return F.concat("p_name", F.lit("第"), (F.col("p_size") % 10).cast("string"), F.lit("标段"), F.substring(F.lit("一二三四五六七八九十"), (F.col("p_size") % 10 + 1).cast("int"), F.lit(1)), F.when(F.col("p_size") % 3 == 0, "期工程").when(F.col("p_size") % 3 == 1, "公司").otherwise("合同"))


def phase_section_domain(spark, d):
    return table(spark, d, "part").select("p_partkey", text.phase(_key()).alias("phase"), text.section(_key()).alias("section"), text.domain(_key()).alias("domain"))


def direction_category(spark, d):
    name = F.concat_ws(">", F.lit("开工竣工"), F.concat(F.when(F.col("event_type") == "click", "实际开工时间").when(F.col("event_type") == "view", "竣工金额").when(F.col("event_type") == "error", "开工竣工单位").otherwise("备注"), F.col("event_type")))
    return table(spark, d, "events").select("event_id", text.direction(name).alias("direction"), text.field_category(text.leaf(name)).alias("category"))


def field_tags(spark, d):
    kind = F.when(F.col("p_size") % 4 == 0, "合同编号").when(F.col("p_size") % 4 == 1, "子项标段").when(F.col("p_size") % 4 == 2, "标段单位").otherwise(F.col("p_brand"))
    top = F.when(F.col("p_size") % 3 == 0, "施工监理阶段").when(F.col("p_size") % 3 == 1, " 立项 ").otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", text.kind_tag(kind).alias("kind"), text.phase_tag(F.concat(top, F.when(F.col("p_size") % 2 == 0, "＞").otherwise(">"), F.col("p_name"))).alias("phase"))


def generic_core(spark, d):
    name = F.concat(F.lit("示例市"), F.col("p_name"), F.when(F.col("p_size") % 2 == 0, "建设工程").otherwise("基础设施项目"))
    return table(spark, d, "part").select("p_partkey", text.strip_generics(name).alias("core"))


def road_ends(spark, d):
    name = F.concat(F.col("p_name"), F.lit("路（"), F.col("p_type"), F.lit("-"), F.col("p_brand"), F.lit("）"))
    road = text.road(F.translate(name, " ", "_"))
    return table(spark, d, "part").select("p_partkey", road["road"].alias("road"), F.array_join(road["ends"], "|").alias("ends"))


def token_jaccard(spark, d):
    return table(spark, d, "part").select("p_partkey", text.jaccard(F.split("p_name", " "), F.array(F.lower("p_type"), F.lit("ring"))).alias("jaccard"))


def field_tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(text.tokens(F.translate("p_name", " ", ""), ["ring", "bolt", "widget", "red", "blue"]), "|").alias("tokens"))


def midnight_date(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"), text.date_text(F.col("o_orderdate")).alias("shown"))
    return orders.unionByName(table(spark, d, "events").select(F.col("event_id").alias("id"), F.lit("event").alias("kind"), text.date_text(F.col("ts")).alias("shown")))


def fuzzy_search(spark, d):
    return table(spark, d, "customer").where(text.fuzzy(F.col("c_name"), "cst 12")).select("c_custkey", "c_name")


def zone_parse(spark, d):
    c = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "-").otherwise("/"), (F.col("p_size") + 2).cast("string"))
    z = text.zone(c)
    return table(spark, d, "part").select("p_partkey", z["start"].alias("start"), z["end"].alias("end"))


def completeness(spark, d):
    e = table(spark, d, "events")
    cells = [F.col("event_type"), F.when(F.col("value") > 20, F.col("value")), F.when(F.col("user_id") % 2 == 0, F.col("props")).otherwise(F.lit(" "))]
    return e.select("event_id", text.nonempty_count(cells).alias("n_valid"))


#: Pairs that a task makes at most, about; cells of pairs that a task gets so that tasks come out alike, and cells at least.
TASK_PAIRS, TASK_CELLS, LEAST_CELLS = 1_000_000, 4, 300


def dealt_pairs(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``a`` and ``b`` dealt for a join on (``key``, _block), which has the pairs of a join on ``key``, each once, in tasks of about as many pairs.

    The rows of ``a`` with one key are cut into blocks, as many as the key has pairs for, and those of ``b`` go to each block.
    """
    sizes = a.groupBy(key).agg(F.count("*").alias("_a")).join(b.groupBy(key).agg(F.count("*").alias("_b")), key).select(key, (F.col("_a") * F.col("_b")).alias("_pairs"))
    total = sizes.agg(F.coalesce(F.sum("_pairs"), F.lit(0))).first()[0]
    parts = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_PAIRS))
    blocks = sizes.select(key, F.ceil(F.col("_pairs") * (TASK_CELLS * parts + LEAST_CELLS) / F.lit(max(1, total))).alias("_blocks"))
    left = a.withColumn("_row", F.monotonically_increasing_id()).join(blocks, key).withColumn("_block", F.pmod(F.xxhash64("_row"), F.col("_blocks"))).drop("_blocks", "_row")
    right = b.join(blocks, key).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks")
    return left.repartition(parts, key, "_block"), right.repartition(parts, key, "_block")


def dealt_names(spark, d):
    """Customers and suppliers, dealt for a join by their nation."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return dealt_pairs(c.select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_name"), s.select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_name"), "nation")


def pairs_of_names(spark, d):
    """Customers with the suppliers of their nation."""
    c, s = dealt_names(spark, d)
    return c.join(s.hint("merge"), ["nation", "_block"]).select("c_custkey", "s_suppkey", "c_name", "s_name")  # sorted, not sent whole to every task


def similarity_kernel(spark, d):
    k = pair_kernel("c_name", "s_name")
    return pairs_of_names(spark, d).withColumn("k", k).select("c_custkey", "s_suppkey", F.round("k.ratio", 9).alias("ratio"), F.col("k.common").alias("common"))


#: Characters at the end of a name that it is compared by alone, and names with one beginning that a row holds at most.
TAIL, ALIKE = 3, 1000


def similarity_native(spark, d):
    """The pairs of ``similarity_kernel`` without Python: names of suppliers that begin alike share the state after their beginning."""
    c, s = dealt_names(spark, d)
    own, other = F.col("c_name"), F.col("s_name")
    s = s.withColumn("head", F.left(other, F.greatest(F.length(other) - TAIL, F.lit(0))))
    part = F.floor((F.row_number().over(Window.partitionBy("nation", "_block", "head").orderBy("s_suppkey")) - 1) / ALIKE)
    heads = s.withColumn("part", part).groupBy("nation", "_block", "head", "part").agg(F.collect_list(F.struct("s_suppkey", "s_name")).alias("names")).drop("part")
    met = c.withColumn("places", letter_places(own)).join(heads.hint("merge"), ["nation", "_block"])
    begun = met.withColumn("begun", F.when(F.length(own).between(1, BITS), walked(unwalked(own), own, F.col("places"), F.coalesce("head", F.lit("")), F.lit(1))))
    pairs = begun.select("c_custkey", "c_name", "places", "begun", F.length("head").alias("skip"), F.inline("names"))
    pairs = pairs.withColumn("state", walked(F.col("begun"), own, F.col("places"), other, F.col("skip") + 1))
    ratio, common = paired(own, other, F.col("state"))
    return pairs.select("c_custkey", "s_suppkey", F.round(ratio, 9).alias("ratio"), common.alias("common"))


def grid(spark, d):
    return lines_as_cells(table(spark, d, "documents"), "doc_id", "text", " ")


def row_stats(spark, d):
    return headers.row_stats(grid(spark, d)).select("sheet", "r", "eff", "real", "uniq", "numbers", "most", "is_title", "is_data")


def header_candidates(spark, d):
    return headers.header_candidates(grid(spark, d))


def no_merges(spark):
    return spark.createDataFrame([], "sheet string, r1 int, r2 int, c1 int, c2 int")


def merges_of(spark, d):
    """A region over the first two cells of the first row of every document's grid, and one over four of the second."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sheet"))
    one = docs.select("sheet", F.lit(1).alias("r1"), F.lit(1).alias("r2"), F.lit(1).alias("c1"), F.lit(2).alias("c2"))
    return one.unionByName(docs.select("sheet", F.lit(2).alias("r1"), F.lit(3).alias("r2"), F.lit(1).alias("c1"), F.lit(4).alias("c2")))


def merge_expansion(spark, d):
    """Every cell of every sheet with the value it shows, covered cells by their region's."""
    return headers.expand_merges(grid(spark, d), merges_of(spark, d)).select("sheet", "r", "c", F.col("v").alias("value"), "in_merge")


def compound_names(spark, d):
    cells = grid(spark, d)
    zones = cells.where(headers.filled(F.col("v"))).groupBy("sheet").agg(F.max("c").alias("n_columns")).select("sheet", F.lit(3).alias("detail"), F.array(F.lit(1), F.lit(2)).alias("categories"), "n_columns")
    return headers.compound_names(cells, zones)


def zone_names(spark, d):
    """The first three rows of every document's grid as a zone that a user gives."""
    cells = grid(spark, d)
    zones = cells.where(headers.filled(F.col("v"))).groupBy("sheet").agg(F.max("c").alias("n_columns"))
    return headers.zone_names(cells, zones.withColumn("start", F.lit(1)).withColumn("end", F.lit(3)))


def legacy_header(spark, d):
    return headers.legacy_header(grid(spark, d))


def named_header(spark, d):
    return headers.named_header(grid(spark, d))


def header_zones(spark, d):
    z = headers.header_zone(headers.expand_merges(grid(spark, d), merges_of(spark, d)), merges_of(spark, d))
    return z.select("sheet", "detail", F.array_join("categories", ",").alias("categories"), "n_columns")


QUERIES = {f.__name__: f for f in (
    norm_rowkey, norm_names, norm_field_units, unit_conflicts, leaf_segment, code_tokens, phase_section_domain, direction_category, field_tags, generic_core, road_ends, token_jaccard, field_tokens, midnight_date,
    fuzzy_search, zone_parse, completeness, similarity_kernel, similarity_native, row_stats, header_candidates, merge_expansion, compound_names, zone_names, legacy_header, named_header, header_zones,
)}

_HALF = f"translate(%s, '{text.WIDE}', '{text.NARROW}')".replace("''''", "''")
WIDE_SQL, NARROW_SQL = text.WIDE, text.NARROW.replace("'", "''")


def half(x: str) -> str:
    return f"translate({x}, '{WIDE_SQL}', '{NARROW_SQL}')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


PAREN = "[（(][^）)]*[）)]"
_FIELD = "p_name || ' _ ' || p_brand || '（' || p_size || '个）'"
_GRID = """
cell AS (
  SELECT CAST(doc_id AS VARCHAR) AS sheet, r, c, ws[c] AS v FROM (
    SELECT doc_id, r, string_split(ls[r], ' ') AS ws, unnest(range(1, len(string_split(ls[r], ' ')) + 1)) AS c FROM (
      SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r FROM documents))
), said AS (
  SELECT sheet, r, c, regexp_replace(v, '^\\s+|\\s+$', '', 'g') AS v FROM cell WHERE regexp_replace(v, '^\\s+|\\s+$', '', 'g') <> '' AND NOT contains(v, 'Unnamed')
)""".replace("\\\\", "\\")
_TOTALS = " OR ".join(f"contains(first, '{w}')" for w in fixed.TOTAL_WORDS)
_MERGES = """
merges AS (
  SELECT CAST(doc_id AS VARCHAR) AS sheet, 1 AS r1, 1 AS r2, 1 AS c1, 2 AS c2 FROM documents UNION ALL SELECT CAST(doc_id AS VARCHAR), 2, 3, 1, 4 FROM documents
)"""
_COVERED = """
shown AS (SELECT sheet, r, c, CASE WHEN regexp_replace(v, '^\\s+|\\s+$', '', 'g') <> '' THEN v END AS v FROM cell), spot AS (
  SELECT sheet, r1, r2, c1, c2, r, unnest(range(c1, c2 + 1)) AS c FROM (SELECT *, unnest(range(r1, r2 + 1)) AS r FROM merges)
), val AS (
  SELECT spot.sheet, r1, r2, c1, c2, arg_min(shown.v, spot.r * 100000 + spot.c) FILTER (WHERE shown.v IS NOT NULL) AS value
  FROM spot LEFT JOIN shown ON shown.sheet = spot.sheet AND shown.r = spot.r AND shown.c = spot.c GROUP BY ALL
), covered AS (SELECT spot.sheet, spot.r, spot.c, value FROM spot JOIN val USING (sheet, r1, r2, c1, c2))""".replace("\\\\", "\\")
_SIMILAR = """
WITH p AS (
  SELECT c_custkey, s_suppkey, string_split(c_name, '') AS a, string_split(s_name, '') AS b FROM customer JOIN supplier ON c_nationkey = s_nationkey
), k AS (
  SELECT c_custkey, s_suppkey, len(a) + len(b) AS n,
    list_reduce(a, lambda acc, x: list_reduce(range(1, len(b) + 1), lambda r, j: list_append(r, CASE WHEN x = b[j] THEN coalesce(acc[j - 1], 0) + 1 ELSE greatest(acc[j], coalesce(r[len(r)], 0)) END), []::INTEGER[]), list_transform(b, lambda y: 0)) AS seq,
    list_reduce(a, lambda acc, x: list_append(list_transform(range(1, len(b) + 1), lambda j: CASE WHEN x = b[j] THEN coalesce(acc[j - 1], 0) + 1 ELSE 0 END),
      greatest(acc[len(b) + 1], list_max(list_transform(range(1, len(b) + 1), lambda j: CASE WHEN x = b[j] THEN coalesce(acc[j - 1], 0) + 1 ELSE 0 END)))), list_transform(list_append(b, ''), lambda y: 0)) AS run
  FROM p
)
SELECT c_custkey, s_suppkey, round(2.0 * seq[len(seq)] / n, 9) AS ratio, run[len(run)] AS common FROM k"""
_WORDS = " + ".join(f"10 * count(*) FILTER (WHERE contains(v, '{w}'))" for w in fixed.HEADER_WORDS)
_IS_NUMBER = f"regexp_matches(regexp_replace(v, '[, ]', '', 'g'), '{fixed.NUMBER}')"

SQL = {
    "norm_rowkey": rf"SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({half(strip('text'))}, '{PAREN}', '', 'g'), '{fixed.RANGE_TAIL}', '', 'g'), '{fixed.SECTION_TAIL}', '', 'g'), '[\s_\-]', '', 'g')) AS norm FROM documents",
    "norm_names": rf"SELECT doc_id, lower(regexp_replace({half(strip('text'))}, '[\s_\-]', '', 'g')) AS squeezed, lower(regexp_replace(regexp_replace({half(strip('text'))}, '\s+', ' ', 'g'), '[_\-]', '', 'g')) AS folded, {strip(f'''regexp_replace(text, '{PAREN}', '', 'g')''')} AS bare FROM documents",
    "norm_field_units": rf"""
SELECT p_partkey, lower(regexp_replace(bare, '[\s_\-]', '', 'g')) || '_' || unit AS norm, trim(lower(regexp_replace(regexp_replace(bare, '\s+', ' ', 'g'), '[_\-]', '', 'g')) || '_' || unit) AS folded, unit
FROM (SELECT p_partkey, {half(f"regexp_replace({_FIELD}, '{PAREN}', '', 'g')")} AS bare, p_size || '个' AS unit FROM part)""",
    "unit_conflicts": "SELECT p_partkey, p_size % 3 = 0 AS conflict FROM part",
    "leaf_segment": "SELECT p_partkey, trim(p_name) AS leaf, trim(p_name) AS leaf_any FROM part",
    "code_tokens": """
SELECT page_id, array_to_string(regexp_extract_all(url, '[A-Za-z0-9]+'), ' ') AS codes,
  coalesce((SELECT arg_min(x, -length(x) * 100000 + i) FROM (SELECT unnest(regexp_extract_all(url, '[0-9]+')) AS x, unnest(range(0, len(regexp_extract_all(url, '[0-9]+')))) AS i)), '') AS digits FROM pages""",
    "phase_section_domain": """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CAST(p_size % 10 + 1 AS INTEGER) END AS phase, CAST(p_size % 10 AS INTEGER) AS section,
  CASE WHEN p_size % 3 = 2 THEN 'contract' ELSE 'project' END AS domain FROM part""",
    "direction_category": """
SELECT event_id, CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN 'end' WHEN 'error' THEN 'both' END AS direction,
  CASE event_type WHEN 'click' THEN 'date' WHEN 'view' THEN 'amount' WHEN 'error' THEN 'entity' ELSE 'general' END AS category FROM events""",
    "field_tags": """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '合同' WHEN 1 THEN '项目' WHEN 2 THEN '标段' ELSE '' END AS kind, CASE p_size % 3 WHEN 0 THEN '施工' WHEN 1 THEN '立项' ELSE p_type END AS phase FROM part""",
    "generic_core": "SELECT p_partkey, p_name AS core FROM part",
    "road_ends": r"SELECT p_partkey, lower(replace(p_name, ' ', '')) || '路' AS road, array_to_string(list_sort(list_distinct([lower(regexp_replace(p_type, '[\s_\-]', '', 'g')), lower(p_brand)])), '|') AS ends FROM part",
    "token_jaccard": "SELECT p_partkey, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS jaccard FROM (SELECT p_partkey, string_split(p_name, ' ') AS a, [lower(p_type), 'ring'] AS b FROM part)",
    "field_tokens": """
SELECT p_partkey, array_to_string(list_concat(list_filter(['ring', 'bolt', 'widget', 'red', 'blue'], lambda w: contains(s, w)), CASE WHEN length(rest) >= 2 THEN [rest] ELSE [] END), '|') AS tokens
FROM (SELECT p_partkey, replace(p_name, ' ', '') AS s, replace(replace(replace(replace(replace(replace(p_name, ' ', ''), 'ring', ''), 'bolt', ''), 'widget', ''), 'red', ''), 'blue', '') AS rest FROM part)""",
    "midnight_date": """
SELECT id, kind, CASE WHEN strftime(t, '%H%M%S') = '000000' THEN strftime(t, '%Y-%m-%d') ELSE strftime(t, '%Y-%m-%d %H:%M:%S') END AS shown
FROM (SELECT o_orderkey AS id, 'order' AS kind, o_orderdate AS t FROM orders UNION ALL SELECT event_id, 'event', ts FROM events)""",
    "fuzzy_search": "SELECT c_custkey, c_name FROM customer WHERE (contains(lower(c_name), 'cst') OR regexp_matches(lower(c_name), 'c.*s.*t')) AND contains(lower(c_name), '12')",
    "zone_parse": 'SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size END AS start, CASE WHEN p_size % 2 = 0 THEN p_size + 2 END AS "end" FROM part',
    "completeness": "SELECT event_id, (event_type IS NOT NULL)::INT + (coalesce(value, 0) > 20)::INT + (user_id % 2 = 0 AND props IS NOT NULL)::INT AS n_valid FROM events",
    "row_stats": f"""
WITH {_GRID}, v AS (
  SELECT sheet, r, v, count(*) AS n, min(c) AS c, count(*) FILTER (WHERE {_IS_NUMBER}) AS numbers FROM said GROUP BY ALL
), s AS (SELECT sheet, r, sum(n) AS eff, count(*) AS uniq, sum(numbers) AS numbers, max(n) AS most, arg_min(v, c) AS first FROM v GROUP BY ALL)
SELECT sheet, CAST(r AS INTEGER) AS r, CAST(eff AS BIGINT) AS eff, CAST(eff AS BIGINT) AS real, uniq, CAST(numbers AS BIGINT) AS numbers, most, eff >= 2 AND most >= 2 AND most / eff >= 0.5 AS is_title, (numbers / eff >= 0.6) OR {_TOTALS} AS is_data FROM s""",
    "header_candidates": f"""
WITH {_GRID}, l AS (SELECT sheet, r, string_agg(v, ' | ' ORDER BY c) AS line FROM said WHERE r <= 6 GROUP BY ALL)
SELECT a.sheet, CAST(a.r AS INTEGER) AS start, CAST(b.r AS INTEGER) AS "end", substr(a.line, 1, 40) AS preview FROM l a JOIN l b ON a.sheet = b.sheet AND b.r BETWEEN a.r AND a.r + 2""",
    "merge_expansion": f"""
WITH {_GRID}, {_MERGES}, {_COVERED}
SELECT coalesce(a.sheet, b.sheet) AS sheet, CAST(coalesce(a.r, b.r) AS INTEGER) AS r, CAST(coalesce(a.c, b.c) AS INTEGER) AS c, CASE WHEN b.sheet IS NOT NULL THEN b.value ELSE a.v END AS value, b.sheet IS NOT NULL AS in_merge
FROM shown a FULL JOIN covered b ON a.sheet = b.sheet AND a.r = b.r AND a.c = b.c""",
    "header_zones": f"""
WITH {_GRID}, {_MERGES}, {_COVERED}, full_grid AS (
  SELECT coalesce(a.sheet, b.sheet) AS sheet, coalesce(a.r, b.r) AS r, coalesce(a.c, b.c) AS c, CASE WHEN b.sheet IS NOT NULL THEN b.value ELSE a.v END AS raw, b.sheet IS NOT NULL AS merged
  FROM shown a FULL JOIN covered b ON a.sheet = b.sheet AND a.r = b.r AND a.c = b.c
), f AS (
  SELECT sheet, r, c, merged, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS v FROM full_grid WHERE regexp_replace(raw, '^\\s+|\\s+$', '', 'g') <> '' AND NOT contains(raw, 'Unnamed')
), width AS (SELECT sheet, max(c) AS n FROM f GROUP BY sheet), times AS (
  SELECT sheet, r, v, count(*) AS k FROM f WHERE r <= 200 GROUP BY ALL
), most AS (SELECT sheet, r, max(k) AS most FROM times GROUP BY ALL), stat AS (
  SELECT sheet, r, count(*) AS eff, count(*) FILTER (WHERE NOT merged) AS own, count(DISTINCT v) AS uniq, count(*) FILTER (WHERE {_IS_NUMBER}) AS numbers, arg_min(v, c) AS first FROM f WHERE r <= 200 GROUP BY ALL
), s AS (
  SELECT stat.*, n, CASE r WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 4 ELSE 0 END AS span, CASE r - 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 4 ELSE 0 END AS above,
    numbers / eff >= 0.6 OR {_TOTALS} AS data, r <= 10 AND eff >= 2 AND most >= 2 AND most / eff >= 0.5 AND lead(r) OVER (PARTITION BY sheet ORDER BY r) IS NOT NULL AS title, greatest(1, least(n // 6, 3)) AS least_
  FROM stat JOIN most USING (sheet, r) JOIN width USING (sheet)
), t AS (
  SELECT *, lead(CASE WHEN NOT title THEN eff END, 1 IGNORE NULLS) OVER w AS e1, lead(CASE WHEN NOT title THEN eff END, 2 IGNORE NULLS) OVER w AS e2,
    lead(CASE WHEN NOT title AND own > 0 THEN own END, 1 IGNORE NULLS) OVER w AS f1, lead(CASE WHEN NOT title AND own > 0 THEN own END, 2 IGNORE NULLS) OVER w AS f2,
    lead(CASE WHEN own > 0 THEN own END, 1 IGNORE NULLS) OVER w AS g1, lead(CASE WHEN own > 0 THEN own END, 2 IGNORE NULLS) OVER w AS g2,
    lead(r) OVER w = r + 1 AS next_, lead(title) OVER w AS nt, lead(span) OVER w AS ns, lead(data) OVER w AS nd, lead(eff) OVER w AS ne, lead(own) OVER w AS no_, lead(uniq) OVER w AS nu
  FROM s WINDOW w AS (PARTITION BY sheet ORDER BY r)
), found AS (
  SELECT sheet, 1 AS p, r, r + CASE WHEN next_ AND NOT nt AND ns < 3 AND NOT nd AND ne >= least_ AND nu > uniq THEN 1 ELSE 0 END AS detail FROM t
  WHERE NOT title AND eff >= least_ AND NOT data AND span < 3 AND NOT (eff < n * 0.6 AND eff < coalesce(greatest(e1, e2), 0) AND above < 3)
    AND (eff >= n * 0.5 OR (least(e1, eff) / greatest(e1, eff) >= 0.3 AND least(e2, eff) / greatest(e2, eff) >= 0.3))
  UNION ALL
  SELECT sheet, 2, r, r + CASE WHEN next_ AND NOT nt AND ns < 3 AND NOT nd AND no_ >= least_ AND no_ > own THEN 1 ELSE 0 END FROM t
  WHERE NOT title AND own >= least_ AND NOT data AND span < 3 AND (own >= n * 0.5 OR (least(f1, own) / greatest(f1, own) >= 0.3 AND least(f2, own) / greatest(f2, own) >= 0.3))
  UNION ALL
  SELECT sheet, 3, r, r + CASE WHEN next_ AND NOT nd AND no_ >= least_ AND no_ > own THEN 1 ELSE 0 END FROM t
  WHERE own >= least_ AND NOT data AND (own >= n * 0.5 OR (least(g1, own) / greatest(g1, own) >= 0.3 AND least(g2, own) / greatest(g2, own) >= 0.3))
), best AS (SELECT sheet, arg_min(detail, p * 1000 + r) AS detail FROM found GROUP BY sheet), cat AS (
  SELECT sheet, r, span >= 0.8 * n AS wide, row_number() OVER w AS i, lead(span >= 0.8 * n, 1, true) OVER w AS next_wide FROM s JOIN best USING (sheet) WHERE NOT title AND r < detail WINDOW w AS (PARTITION BY sheet ORDER BY r)
)
SELECT sheet, CAST(detail AS INTEGER) AS detail, coalesce((SELECT string_agg(CAST(r AS VARCHAR), ',' ORDER BY r) FROM cat WHERE cat.sheet = best.sheet AND NOT (i = 1 AND wide AND NOT next_wide)), '') AS categories, CAST(n AS INTEGER) AS n_columns
FROM best JOIN width USING (sheet)""",
    "named_header": f"""
WITH {_GRID}, s AS (
  SELECT sheet, r, sum(10 + CASE WHEN length(v) <= 30 THEN 5 ELSE 0 END + CASE WHEN regexp_matches(v, '^\\p{{L}}') THEN 3 ELSE 0 END) AS score FROM said WHERE r <= 31 GROUP BY ALL
)
SELECT sheet, CAST(r AS INTEGER) AS r, CAST(score AS BIGINT) AS score FROM s QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY score DESC, r) = 1""",
    "compound_names": f"""
WITH {_GRID}, n AS (SELECT sheet, max(c) AS n FROM said GROUP BY sheet), cols AS (SELECT sheet, unnest(range(1, n + 1)) AS c FROM n)
SELECT cols.sheet, CAST(cols.c AS INTEGER) AS c, concat_ws('>', a.v, CASE WHEN b.v IS NOT NULL AND (a.v IS NULL OR a.v <> b.v) THEN b.v END, coalesce(l.v, 'Col' || cols.c)) AS name
FROM cols LEFT JOIN said a ON a.sheet = cols.sheet AND a.c = cols.c AND a.r = 1 LEFT JOIN said b ON b.sheet = cols.sheet AND b.c = cols.c AND b.r = 2 LEFT JOIN said l ON l.sheet = cols.sheet AND l.c = cols.c AND l.r = 3""",
    "zone_names": f"""
WITH {_GRID}, n AS (SELECT sheet, max(c) AS n FROM said GROUP BY sheet), cols AS (SELECT sheet, unnest(range(1, n + 1)) AS c FROM n), z AS (
  SELECT *, lag(v) OVER (PARTITION BY sheet, c ORDER BY r) AS before FROM said WHERE r <= 3
), p AS (SELECT sheet, c, string_agg(v, '>' ORDER BY r) AS name FROM z WHERE before IS NULL OR before <> v GROUP BY ALL)
SELECT cols.sheet, CAST(cols.c AS INTEGER) AS c, coalesce(name, 'Col' || cols.c) AS name FROM cols LEFT JOIN p ON p.sheet = cols.sheet AND p.c = cols.c""",
    "similarity_kernel": _SIMILAR,
    "similarity_native": _SIMILAR,
    "legacy_header": f"""
WITH {_GRID}, s AS (
  SELECT sheet, r, count(*) AS eff, sum(length(v)) / count(*) AS mean, count(*) FILTER (WHERE {_IS_NUMBER}) AS numbers, {_WORDS} AS words FROM said WHERE r <= 100 GROUP BY ALL
), p AS (
  SELECT sheet, r, eff * 10 + CASE WHEN eff >= 5 THEN 20 WHEN eff >= 3 THEN 10 ELSE 0 END + CASE WHEN mean BETWEEN 2 AND 25 THEN 15 WHEN mean <= 40 THEN 8 ELSE 0 END + words - CASE WHEN numbers = eff THEN 50 ELSE 0 END AS score FROM s
)
SELECT sheet, CAST(r AS INTEGER) AS r, CAST(score AS BIGINT) AS score FROM p QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY score DESC, r) = 1""",
}
