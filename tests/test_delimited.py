"""Delimited files whose records go over many lines, read in stretches."""

import csv
import io
import random

import pytest

from loomfuse.sources import grid


def test_where_quoted_fields_stay_open():
    rng = random.Random(1)
    for _ in range(3000):
        line = "".join(rng.choice('a",') for _ in range(rng.randint(0, 12)))
        for inside in (False, True):
            state = "in" if inside else "start"
            for i, ch in enumerate(line):  # a plain machine over the letters
                if state == "in" and ch == '"':
                    state = "quote"
                elif state == "quote":
                    state = "in" if ch == '"' else "start" if ch == "," else "field"
                elif state == "start":
                    state = "in" if ch == '"' else "start" if ch == "," else "field"
                elif state == "field" and ch == ",":
                    state = "start"
            assert grid.ends_inside(line, inside) == (state == "in"), (line, inside)


@pytest.fixture
def small_stretches(spark):
    for k, v in (("spark.sql.files.maxPartitionBytes", "300"), ("spark.sql.files.openCostInBytes", "1"), ("spark.sql.files.minPartitionNum", "1")):
        spark.conf.set(k, v)
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
        spark.conf.unset(k)


def test_records_over_lines_and_stretches(spark, tmp_path, small_stretches):
    rng = random.Random(2)
    value = lambda: rng.choice(["x", "a,b", 'say ""hi""', "two\nlines", "\n\nmany\n" * 30, "", '5"', "end"])
    rows = []
    for i in range(150):
        cells = [value() for _ in range(3)]
        rows.append(",".join([str(i), *(c if c == '5"' or not any(x in c for x in ',"\n') else f'"{c}"' for c in cells)]))
    text = "\n".join(['id,"a\nb",c,c', *rows]) + "\n"
    (tmp_path / "a.csv").write_text(text, encoding="utf-8", newline="")
    assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 10
    got = grid.read_delimited(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["row_idx", "id", "a\nb", "c", "c_2"]
    want = list(csv.reader(io.StringIO(text)))[1:]
    found = got.orderBy("row_idx").collect()
    assert [r.row_idx for r in found] == list(range(150)) and [[x or "" for x in r[1:]] for r in found] == want


def test_one_stray_quote_is_no_task_for_all(spark, tmp_path, small_stretches):
    lines = ["id,v", *(f"{i},w{i}" for i in range(400))]
    lines[200] = '199,5" tube'
    (tmp_path / "b.csv").write_text("\n".join(lines), encoding="utf-8")
    got = grid.read_delimited(spark, str(tmp_path / "b.csv"))
    rows = {r.row_idx: (r.id, r.v) for r in got.collect()}
    assert len(rows) == 400 and rows[199] == ("199", '5" tube') and all(rows[i] == (str(i), f"w{i}") for i in range(400) if i != 199)
    lines[200] = '199,"open'
    (tmp_path / "c.csv").write_text("\n".join(lines), encoding="utf-8")
    got = grid.read_delimited(spark, str(tmp_path / "c.csv")).collect()
    assert len(got) == 200  # as for any reader, a field that nothing closes takes the rest
