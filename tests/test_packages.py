"""The data source of office packages: against the readers over binary files, broken files, columns, filters, SQL."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sheafline.sources import ooxml, packages
from test_sources import workbook


def document(*texts):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in texts)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    packages.register(spark)
    root = tmp_path_factory.mktemp("packages")
    (root / "deep").mkdir()
    book = workbook()
    for name, data in {"a.xlsx": book, "deep/b.bin": book, "c.docx": document("one", "two"), "cut.xlsx": book[: len(book) // 2], "empty.xlsx": b"", "note.txt": b"text", "~$a.xlsx": book, "_SUCCESS": b""}.items():
        (root / name).write_bytes(data)
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            new.writestr(name, b"<sheet><row>" if "/worksheets/sheet" in name and name.endswith(".xml") else old.read(name))
        new.writestr("extra.txt", "x")
    (root / "torn.xlsx").write_bytes(out.getvalue())
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x.txt", "x")
    (root / "other.zip").write_bytes(out.getvalue())
    return str(root)


def load(spark, folder, table, **options):
    return spark.read.format(packages.NAME).option("table", table).options(**options).load(folder)


def test_tables_equal_the_readers(spark, folder):
    files = spark.createDataFrame([(f"{folder}/{n}", bytearray(open(f"{folder}/{n}", "rb").read())) for n in ("a.xlsx", "deep/b.bin", "c.docx")], "file_id string, content binary")
    for table, read in (("cells", ooxml.cells), ("merges", ooxml.merges), ("attachments", ooxml.attachments), ("layout", ooxml.layout), ("blocks", ooxml.blocks)):
        wanted = files.where(F.col("file_id").endswith(".docx") == (table == "blocks")).transform(read)
        for options in ({}, {"maxPartitionBytes": "1", "batchRows": "2"}):
            got = load(spark, folder, table, **options)
            assert got.schema.simpleString() == wanted.schema.simpleString()
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, wanted.collect()), key=repr)
    assert load(spark, folder, "cells", maxPartitionBytes="1").rdd.getNumPartitions() == 8


def test_diagnostics(spark, folder):
    got = {r.file_id.rpartition("/")[2]: (r.package_type, r.status, r.n_rows) for r in load(spark, folder, "diagnostics").collect()}
    n = load(spark, folder, "cells").where(F.col("file_id").endswith("a.xlsx")).count()
    assert got == {
        "a.xlsx": ("workbook", "ok", n), "b.bin": ("workbook", "ok", n), "c.docx": ("document", "ok", 2), "cut.xlsx": (None, "broken", 0), "empty.xlsx": (None, "broken", 0),
        "note.txt": (None, "broken", 0), "torn.xlsx": ("workbook", "broken", 0), "other.zip": ("other", "unsupported", 0),
    }
    assert load(spark, folder, "diagnostics").where("status = 'broken' and error is null").count() == 0


def test_columns_and_sql(spark, folder):
    some = spark.read.format(packages.NAME).schema("value string, file_id string").option("table", "cells").load(folder)
    assert some.columns == ["value", "file_id"] and some.count() == load(spark, folder, "cells").count()
    spark.sql(f"create or replace temporary view package_blocks using {packages.NAME} options (path '{folder}', table 'blocks')")
    assert [r.text for r in spark.sql("select text from package_blocks order by block_index").collect()] == ["one", "two"]
    with pytest.raises(Exception, match="no table odd"):
        load(spark, folder, "odd").collect()


def test_filters_leave_files_unread(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        all_rows = load(spark, folder, "diagnostics", pushdown="true", maxPartitionBytes="1")
        one = all_rows.where(F.col("file_id") == f"{folder}/a.xlsx")
        assert (one.count(), one.rdd.getNumPartitions()) == (1, 1)
        assert all_rows.where(F.col("file_id").isin(f"{folder}/a.xlsx", f"{folder}/c.docx", "nowhere") & (F.col("status") == "ok")).count() == 2
        assert all_rows.where(F.col("file_id") == "nowhere").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_groups():
    got = packages.grouped([("c", 9000), ("a", 0), ("b", 4096), ("d", 1)], 8192)
    assert [[p for p, _ in g.files] for g in got] == [["a", "b"], ["c"], ["d"]]
    assert packages.grouped([], 10) == []
