"""A whole run: workbook and CSV sources, a template, matches, alignment, fill."""

import json

from pyspark.sql import functions as F

from loomfuse.plans.session import Options, Session
from loomfuse.sources import grid, sink
from loomfuse.streaming import ingest


def test_fill_from_files(spark, tmp_path):
    sink.publish(sink.new_workbook(["项目名称", "项目经理", "金额"], [["示范山公园项目", "张三", "10"], ["示范湖学校（一期）", "李四", "20"], [None, "王五", "30"]]), str(tmp_path / "a.xlsx"))
    (tmp_path / "b.csv").write_text("项目名称,联系电话\n示范山公园项目,123\n", encoding="utf-8")
    (tmp_path / "bad.xlsx").write_bytes(b"x")
    sink.publish(sink.new_workbook(["项目名称", "项目经理人", "电话", "备注"], [["示范山公园项目", None, None, "kept"], ["示范湖学校", "old", None, None], ["别的", None, None, None]]), str(tmp_path / "t.xlsx"))
    s = Session(spark, Options())
    told = s.add_sources([str(tmp_path / "a.xlsx"), str(tmp_path / "b.csv"), str(tmp_path / "A.xlsx"), str(tmp_path / "old.xls"), str(tmp_path / "bad.xlsx")])
    assert told["success"] and told["sources"] == 2 and list(told["failed"]) == [str(tmp_path / "old.xls"), str(tmp_path / "bad.xlsx")]
    assert not s.set_target(str(tmp_path / "bad.xlsx"))["success"]
    assert s.set_target(str(tmp_path / "t.xlsx"))["fields"] == ["项目名称", "项目经理人", "电话", "备注"]
    assert {r.field: r.sample for r in s.all_samples().collect()}["项目经理"] == "张三 / 李四 / 王五"
    matches = s.auto_match()
    got = {r.tgt_field: r.src_field for r in matches.where("matched").collect()}
    assert got["项目经理人"] == "项目经理" and got["电话"] == "联系电话"
    seen = {(r.tgt_key, r.source_id): r.status for r in s.alignment_preview("项目名称").collect()}
    assert seen["示范山公园项目", "s0"] == "auto" and seen["示范湖学校", "s0"] == "auto" and seen["别的", "s0"] == "unmatched"
    assert s.derived_key(matches) == ("项目名称", "项目名称") and s.row_key_candidates()["src"] == ["项目名称", "项目经理", "金额", "联系电话"]
    s.execute(matches, str(tmp_path / "out"), "备注").join(600)  # the matches tell the key
    assert s.status["error"] is None and s.status["result"]["filled"] >= 3
    rows = {r["项目名称"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows["示范山公园项目"]["项目经理人"] == "张三" and rows["示范山公园项目"]["电话"] == "123" and rows["示范山公园项目"]["备注"] == "kept"
    assert rows["示范湖学校"]["项目经理人"] == "李四" and rows["别的"]["项目经理人"] is None
    s.execute(matches, str(tmp_path / "out.xlsx")).join(600)
    assert s.status["error"] is None and "note" not in s.status["result"]
    shown = {(r, c): v for _, k, r, c, _, _, v, _ in grid.workbook((tmp_path / "out.xlsx").read_bytes()) if k == "cell"}
    assert shown == {(1, 1): "项目名称", (1, 2): "项目经理人", (1, 3): "电话", (1, 4): "备注", (2, 1): "示范山公园项目", (2, 2): "张三", (2, 3): "123", (2, 4): "kept", (3, 1): "示范湖学校", (3, 2): "李四", (4, 1): "别的"}
    named = Session(spark)
    sink.publish(sink.new_workbook(["No.项目名称", "电.话"], [["甲项目", "1"], [None, "2"], ["乙项目", "3"]]), str(tmp_path / "dots.xlsx"))
    sink.publish(sink.new_workbook(["No.项目名称", "电.话"], [["乙项目", None], ["甲项目", None]]), str(tmp_path / "empty.xlsx"))
    assert named.add_sources([str(tmp_path / "dots.xlsx")])["success"] and named.set_target(str(tmp_path / "empty.xlsx"))["success"]
    assert {r["No.项目名称"]: r["电.话"] for r in named.fill(named.auto_match())[0].collect()} == {"乙项目": "3", "甲项目": "1"}
    zoned = Session(spark)
    assert zoned.set_target(str(tmp_path / "t.xlsx"), {"start": 1, "end": 2})["fields"] == ["项目名称>示范山公园项目", "项目经理人", "电话", "备注>kept"]
    assert zoned.target.table.count() == 2
    assert s.score_field("项目经理", "项目经理人") >= 85
    moved = matches.withColumn("src_file", F.regexp_replace("src_file", ".*/", "/elsewhere/"))
    assert {r.tgt_field: r.cells for r in s.fill(moved)[1].collect()} == {r["tgt_field"]: r["cells"] for r in s.status["result"]["details"]}
    s.import_dictionary('{"synonyms": {"甲": ["乙"]}, "exclusions": [{"a": "x", "b": "y"}]}', str(tmp_path / "d.json"))
    assert json.loads(s.export_dictionary())["synonyms"] == {"甲": ["乙"]} and s.exclusions == [("x", "y")] and s.reload_dictionary()["exclusions"]


def test_rows_that_arrive_over_time(spark, tmp_path):
    spark.createDataFrame([("示范 山", "2024-01-01 10:00:00", "a"), ("示范山", "2024-01-01 11:00:00", "b"), (" ", "2024-01-01 11:00:00", "c")], "name string, at string, v string").selectExpr("name", "cast(at as timestamp) at", "v").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("name string, at timestamp, v string").parquet(str(tmp_path / "in"))
    query = ingest.latest_rows(rows, "name", "at").writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("latest").collect()
    assert [(r.norm, r.n_rows, r["last"].v) for r in got] == [("示范山", 2, "b")]
    batches = []
    ingest.fill_as_they_come(rows, lambda df, i: batches.append((i, df.count())), str(tmp_path / "state")).awaitTermination(120)
    assert batches == [(0, 3)]


def test_scratch_folder(spark):
    from loomfuse.operators import scratch

    folder = scratch.shared_folder(spark)
    assert folder.endswith(spark.sparkContext.applicationId)
    assert [r.id for r in scratch.kept(spark.range(3), "x").orderBy("id").collect()] == [0, 1, 2]
