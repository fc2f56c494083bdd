"""Workbooks as a data source: sheets as partitions, pushed filters, commit and abort."""

import os
import resource
import zipfile

import pytest
from pyspark.sql import functions as F

from loomfuse.sources import datasource, grid, sink


@pytest.fixture(scope="module")
def books(spark, tmp_path_factory):
    datasource.register(spark)
    folder = tmp_path_factory.mktemp("books")
    for k in range(2):
        one = sink.new_workbook(["name", "n"], [[f"a{k}{i}", str(i)] for i in range(30)], "First")
        with zipfile.ZipFile(folder / f"{k}.xlsx", "w") as out:
            for name in zipfile.ZipFile(__import__("io").BytesIO(one)).namelist():
                xml = zipfile.ZipFile(__import__("io").BytesIO(one)).read(name).decode()
                xml = xml.replace("</sheets>", '<sheet name="Second" sheetId="2" r:id="rId2"/></sheets>').replace("</Relationships>", '<Relationship Id="rId2" Type="x" Target="worksheets/sheet2.xml"/></Relationships>' if "workbook.xml.rels" in name else "</Relationships>")
                out.writestr(name, xml)
            out.writestr("xl/worksheets/sheet2.xml", "<worksheet" if k else sink.SHEET_HEAD + sink.row_xml(1, ["x", None, "z"]) + '</sheetData><mergeCells><mergeCell ref="A1:B2"/></mergeCells></worksheet>')
    (folder / "bad.xlsx").write_bytes(b"no workbook")
    return folder


def rows(df):
    return sorted(map(tuple, df.drop("file").collect()), key=repr)


def test_same_rows_as_the_other_reader_a_task_a_sheet(spark, books):
    path = str(books / "0.xlsx")
    df = spark.read.format("grid").load(path)
    assert rows(df) == rows(grid.read_workbooks(spark, [path])) and df.rdd.getNumPartitions() == 2
    assert {r.kind for r in df.where("sheet = 'Second'").collect()} == {"cell", "merge"}
    both = spark.read.format("grid").option("paths", f'["{path}", "{books / "1.xlsx"}", "{books / "bad.xlsx"}"]').load()
    assert both.rdd.getNumPartitions() == 5
    assert sorted(os.path.basename(r.file) for r in both.where("kind = 'error'").collect()) == ["1.xlsx", "bad.xlsx"]


def test_one_sheet_is_read_without_the_others(spark, books):
    path = str(books / "1.xlsx")  # its second sheet can't be parsed
    for df in (spark.read.format("grid").option("sheet", "First").load(path), spark.read.format("grid").load(path).where(F.col("sheet") == "First")):
        assert df.rdd.getNumPartitions() == 1 and df.where("kind = 'error'").count() == 0 and df.count() == 62
    assert spark.read.format("grid").load(path).where(F.col("sheet").isin("First", "Third")).count() == 62
    assert spark.read.format("grid").load(path).where("sheet = 'Third'").count() == 0
    with pytest.raises(Exception, match="old .xls"):
        spark.read.format("grid").load("a.xls").count()


def test_write_and_read_again(spark, books):
    path = str(books / "out.xlsx")
    df = spark.range(2000).select(F.col("id").alias("row_idx"), F.concat(F.lit("a<&\x01"), "id").alias("name"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("n"))
    df.orderBy("row_idx").write.format("grid").mode("overwrite").save(path)
    back = spark.read.format("grid").load(path)
    assert {(r.r, r.c): r.v for r in back.where("r in (1, 2, 3)").collect()} == {(1, 1): "name", (1, 2): "n", (2, 1): "a<&0", (2, 2): "0", (3, 1): "a<&1"}
    assert back.agg(F.max("r"), F.count("*")).first() == (2001, 2 + 2000 + 667)
    with pytest.raises(Exception, match="sorted"):
        df.orderBy(F.desc("row_idx")).write.format("grid").mode("overwrite").save(path)
    with pytest.raises(Exception, match="exists"):
        df.write.format("grid").mode("append").save(path)
    with pytest.raises(Exception, match="lies beyond"):
        df.select((F.col("row_idx") + 2_000_000).alias("row_idx"), "name").orderBy("row_idx").write.format("grid").mode("overwrite").save(path)
    assert spark.read.format("grid").load(path).count() == 2669  # the older file stays
    assert not [f for f in os.listdir(books) if ".parts-" in f or f.endswith(".new")]


def test_a_full_sheet_in_bounded_memory(tmp_path):
    import pyarrow as pa
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("row_idx", LongType()), StructField("a", StringType()), StructField("b", StringType())])
    writer = datasource.GridWriter({"path": str(tmp_path / "big.xlsx")}, schema, True)
    batch = lambda k: pa.RecordBatch.from_pydict({"row_idx": list(range(k, k + 10_000)), "a": ["some text"] * 10_000, "b": [str(i) for i in range(10_000)]})
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    messages = [writer.write(batch(k) for k in range(at, at + 100_000, 10_000)) for at in range(0, 1_000_000, 100_000)]
    writer.commit(messages[::-1])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # kilobytes
    book = grid.Book(str(tmp_path / "big.xlsx"))
    n = 0
    for n, row in enumerate(book.rows(*book.sheets[0]), 1):
        pass
    assert n == 2_000_002 and row[2] == 1_000_001
