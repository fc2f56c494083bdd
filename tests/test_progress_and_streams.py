"""Progress and end of a run, its log, keys to choose from, refilled keys, and rows that fill while they arrive."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from loomfuse.operators import fill, headers
from loomfuse.plans.session import Session
from loomfuse.sources import sink
from loomfuse.streaming import ingest


@pytest.fixture
def session(spark, tmp_path):
    names = [f"示范{c}公园" for c in "甲乙丙丁戊己庚辛"]
    sink.publish(sink.new_workbook(["项目名称", "电话"], [[n, str(i)] for i, n in enumerate(names)]), str(tmp_path / "a.xlsx"))
    sink.publish(sink.new_workbook(["项目名称", "电话"], [[names[3], "x"], ["另一处", "9"]]), str(tmp_path / "b.xlsx"))
    sink.publish(sink.new_workbook(["项目名称", "电话"], [[n, None] for n in names]), str(tmp_path / "t.xlsx"))
    s = Session(spark)
    assert s.add_sources([str(tmp_path / "a.xlsx"), str(tmp_path / "b.xlsx")])["sources"] == 2 and s.set_target(str(tmp_path / "t.xlsx"))["success"]
    return s


def test_progress_rises_and_the_run_is_logged(spark, session, tmp_path):
    keys = [r.src_key for r in session.source_keys("项目名称").orderBy("ord").collect()]
    assert keys == [f"示范{c}公园" for c in "甲乙丙丁戊己庚辛"] + ["另一处"]
    matches = session.auto_match().cache()
    run, seen = session.execute(matches, str(tmp_path / "out"), log=str(tmp_path / "log")), []
    while run.is_alive():
        seen.append(session.progress())
        time.sleep(0.2)
    shares = [p["pct"] for p in seen] + [session.progress()["pct"]]
    assert session.status["error"] is None and shares == sorted(shares) and shares[-1] == 100.0
    assert len(set(shares)) > 3 and max(shares[:-2], default=0) <= 95.0
    jobs = [p["jobs"] for p in seen]
    assert jobs == sorted(jobs) and jobs[-1] > 0 and [p["tasks_done"] for p in seen][-1] > 0
    events = [json.loads(x)["event"] for f in (tmp_path / "log").glob("part-*") for x in f.read_text().splitlines()]
    assert events.count("exec_start") == events.count("exec_done") == 1 and events.count("match") == 2


def test_abort_ends_the_run(session, tmp_path):
    matches = session.auto_match().cache()
    run = session.execute(matches, str(tmp_path / "never"))
    while run.is_alive() and not session.progress()["jobs"]:
        time.sleep(0.05)
    session.abort()
    run.join(120)
    assert not run.is_alive() and session.status["aborted"] and session.status["error"] and not session.status["done"]
    assert not (tmp_path / "never").exists() and not session.status["running"] and session.progress()["pct"] < 100


def test_merged_keys_are_filled_again(spark):
    cells = [("s", 1, 1, "甲>项目 名称"), ("s", 1, 2, "n"), ("s", 2, 1, "A"), ("s", 2, 2, "1"), ("s", 3, 2, "2"), ("s", 4, 1, "B"), ("s", 4, 2, "3"), ("t", 3, 1, "no")]
    merges = spark.createDataFrame([("s", 2, 3, 1, 1)], "sheet string, r1 int, r2 int, c1 int, c2 int")
    full = headers.expand_merges(spark.createDataFrame(cells, "sheet string, r int, c int, v string").withColumn("in_merge", F.lit(False)), merges)
    df = spark.createDataFrame([(0, "kept", "1"), (1, " ", "2"), (2, None, "3"), (3, None, "4")], "row_idx long, `项目名称` string, n string")
    assert [r[1] for r in headers.refilled(df, "项目名称", full, "s", 1).orderBy("row_idx").collect()] == ["kept", "A", "B", None]
    assert [r[1] for r in headers.refilled(df.withColumnRenamed("项目名称", "else"), "else", full, "s", 1).orderBy("row_idx").collect()] == ["kept", " ", None, None]


@pytest.mark.parametrize("cuts", [[], [7, 8, 30]])
def test_any_split_of_arrivals_fills_as_one_batch(spark, tmp_path, cuts):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b ", "c", " ", None]), rng.choice(["x", None, " ", f"v{i}"]), f"w{i}") for i in range(40)]
    target = spark.createDataFrame([(r, rng.choice(["a", "b", "c", "d", ""])) for r in range(25)], "row long, key string")
    schema = "at long, k string, v string, `w.w` string"
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, 40], strict=True)):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in" / f"n={n}"))
        time.sleep(0.01)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    filled = ingest.fill_stream(stream, "k", "at", target, "key", "row", {"first": "v", "second": "w.w", "third": "v"})
    query = filled.writeStream.option("checkpointLocation", str(tmp_path / "state")).outputMode("append").format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == len(cuts) + 1
    got = sorted(map(tuple, spark.read.schema("tgt_row long, field string, value string").parquet(str(tmp_path / "out")).collect()))
    want = []
    for field, column in (("first", 2), ("second", 3), ("third", 2)):
        for key in "abcd":
            values = [r[column] for r in rows if (r[1] or "").strip() == key and (r[column] or "").strip()]
            want += [(row, field, v) for row, v in zip([r.row for r in target.orderBy("row").collect() if r.key == key], values, strict=False)]
    assert got == sorted(want) and len(want) > 20


def test_one_key_on_half_of_the_rows(spark):
    n = 4000
    cells = spark.range(n).select(F.col("id").alias("tgt_row"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), F.lit("f").alias("field"), F.lit(None).cast("string").alias("value"))
    src = spark.range(n).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("row"), F.col("id").cast("string").alias("f"))
    own = cells.select(F.lit("s").alias("source_id"), F.col("key").alias("tgt_key")).distinct()
    none = own.limit(0).withColumn("src_key", F.lit(None).cast("string"))
    matches = spark.createDataFrame([("f", "f", "s")], "tgt_field string, src_field string, source_id string")
    got = fill.fill_cells(cells, fill.source_cells(src, "s", 0, "k", "row", ["f"]), fill.effective_keys(own, none), matches)
    assert got.where("value = cast(tgt_row as string)").count() == n
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan  # no window over a key's rows
