"""Merged regions met in tiles, and names that are free."""

import random

from pyspark.sql import functions as F

from loomfuse.operators import headers
from loomfuse.plans import text_queries


def test_regions_meet_cells_in_tiles(spark):
    rng = random.Random(1)
    regions = []
    for _ in range(60):
        r, c = rng.randint(1, 700), rng.randint(1, 60)
        regions.append(("s", r, r + rng.choice([0, 1, 2, 300]), c, c + rng.choice([0, 1, 5, 40])))
    cells = [("s", r, c, rng.choice(["x", "y", " ", None]) if rng.random() < 0.3 else None, False) for r in range(1, 701, 3) for c in range(1, 61, 2)]
    got = headers.resolve_merges(spark.createDataFrame(cells, "sheet string, r int, c int, v string, in_merge boolean"), spark.createDataFrame(regions, "sheet string, r1 int, r2 int, c1 int, c2 int")).collect()
    assert len(got) == len(regions)
    said = {(r, c): v for _, r, c, v, _ in cells if v and v.strip()}
    for x in got:
        inside = [p for p in said if x.r1 <= p[0] <= x.r2 and x.c1 <= p[1] <= x.c2]
        assert x.value == (said[min(inside)] if inside else None)


def test_many_cells_and_regions_take_linear_time(spark):
    rows = spark.range(400_000).select(F.lit("s").alias("sheet"), (F.col("id") / 40 + 1).cast("int").alias("r"), (F.col("id") % 40 + 1).cast("int").alias("c"), F.col("id").cast("string").alias("v"))
    regions = spark.range(4_000).select(F.lit("s").alias("sheet"), (F.col("id") * 2 + 1).cast("int").alias("r1"), (F.col("id") * 2 + 2).cast("int").alias("r2"), F.lit(1).alias("c1"), F.lit(3).alias("c2"))
    met = headers.covering(rows, regions)
    assert met.count() == 4_000 * 6
    assert "_tr" in met._jdf.queryExecution().executedPlan().toString()
    assert headers.resolve_merges(rows, regions).where("value <> cast((r1 - 1) * 40 as string)").count() == 0


def test_merge_expansion_gives_every_cell(spark, tmp_path):
    texts = ["a b c\n  d\ne", "one", None, "", "x y\n\n1 2 3 4 5\nlast"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for k, t in enumerate(texts):
        own = {(r, c): v for r, line in enumerate([] if t is None else t.split("\n"), 1) for c, v in enumerate(line.split(" "), 1)}
        shown = {p: (v or None, False) for p, v in own.items()}
        for r1, r2, c1, c2 in ((1, 1, 1, 2), (2, 3, 1, 4)):
            inside = [(r, c) for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)]
            shown |= dict.fromkeys(inside, (next((own[p] for p in inside if own.get(p)), None), True))
        want |= {(str(k), *p): x for p, x in shown.items()}
    got = text_queries.merge_expansion(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(x.sheet, x.r, x.c): (x.value, x.in_merge) for x in got} == want


def test_row_stats_of_rows_in_one_place_and_in_several(spark, monkeypatch):
    """Runs of cells are counted where they stand; rows whose cells are apart, as after a shuffle or in repeated sheets, come out the same."""
    rng = random.Random(3)
    said = lambda: rng.choice(["a", "b", "1,000", "2", " 合计 ", "name", " ", None, "Unnamed: 1", "鹊"])
    cells = [(f"s{k}", r, c, said(), rng.random() < 0.2) for k in range(12) for r in range(1, 30) for c in range(1, rng.choice([2, 6, 40]))]
    cells += [("wide", 1, c, str(c % 700), False) for c in range(1, 25_000)] + [("wide", 2, 1, "x", False)] + [(None, 1, 1, "x", False), (None, 1, 2, "y", False)]
    want = {}
    for k, r, c, v, merged in cells:
        if v and v.strip() and "Unnamed" not in v:
            want.setdefault((k, r), []).append((c, v.strip(), merged))
    counts = {}
    for key, row in want.items():
        values = [v for _, v, _ in row]
        counts[key] = (len(row), sum(not m for *_, m in row), len(set(values)), sum(v.replace(",", "").isdigit() for v in values), max(map(values.count, set(values))) if key[0] != "wide" else max(values[:700].count(v) for v in ("1", "x")) * (36 if len(row) > 1 else 1), "合计" in values[0], row[-1][0], sum(map(len, values)))
    shape = "sheet string, r int, c int, v string, in_merge boolean"
    labels = []
    monkeypatch.setattr(headers, "_joined", lambda runs, old=headers._joined: labels.append(1) or old(runs))
    whole = spark.createDataFrame(cells, shape).coalesce(1)
    for df, apart in ((whole, False), (whole.repartition(5, "c"), True), (whole.where("c % 2 = 0").unionByName(whole.where("c % 2 = 1")), True)):
        labels.clear()
        got = headers.row_stats(df, scored=True).collect()
        total = {(x.sheet, x.r): (x.eff, x.real, x.uniq, x.numbers, x.most, x.total, x.last, x.chars) for x in got}
        assert bool(labels) == apart and len(got) == len(counts) and total == counts
    assert "Exchange" not in headers._runs(whole, False)._jdf.queryExecution().executedPlan().toString()


def test_only_cells_near_regions_are_joined(spark):
    cells = spark.range(50_000).selectExpr("concat('s', id % 50) as sheet", "cast(id / 500 + 1 as int) r", "cast(id / 50 % 10 + 1 as int) c", "cast(id as string) v", "false in_merge")
    merges = spark.createDataFrame([("s1", 1, 2, 1, 2), ("s2", 2, 2, 1, 3), ("s60", 1, 1, 1, 1)], "sheet string, r1 int, r2 int, c1 int, c2 int")
    full = headers.expand_merges(cells, merges)
    want = {(x.sheet, x.r, x.c): (x.v, False) for x in cells.collect()}
    for sheet, r1, r2, c1, c2 in (tuple(x) for x in merges.collect()):
        want |= {(sheet, r, c): (want.get((sheet, r1, c1), (None,))[0], True) for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)}
    got = full.collect()
    assert len(got) == len(want) and {(x.sheet, x.r, x.c): (x.v, x.in_merge) for x in got} == want
    plan = full._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan.split("Join")[0] and headers.expand_merges(cells, merges.limit(0)).where("in_merge").isEmpty()


def test_names_stay_unique():
    assert headers.clean_names(["a", "a", "a_2"]) == ["a", "a_3", "a_2"]
    assert headers.clean_names(["a", "a_2", "a", "a", " a", None, "_col_1"]) == ["a", "a_2", "a_3", "a_4", "a_5", "_col_1", "_col_1_2"]
    rng = random.Random(2)
    for _ in range(300):
        names = [rng.choice(["a", "a_2", "a_3", "a_2_2", None, "_col_1", "b"]) for _ in range(8)]
        got = headers.clean_names(names)
        assert len(set(got)) == len(got) and all(g == n for g, n in zip(got, names, strict=True) if n and names.count(n) == 1 and n != "_col_1")
