"""Segments of embedded documents: rows of sheets, blocks of texts under their headings, slides and drawing pages.

The readers of ``ooxml`` yield cells and blocks; what is made of them here are plans. Windows run over one file.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions import text as T
from sheafline.operators.order import heading_paths
from sheafline.operators.tables import without_repeats

#: Words of header rows in embedded tables.
HEADER_WORDS = ("类别", "项目", "结果", "异常描述", "业务链路", "接入设备", "接入端口", "实际带宽", "ODF信息", "设备名称", "设备位置", "设备IP")
#: Rows of a table among which its header is looked for.
HEADER_ROWS = 3
#: Fixed values: (block type, pattern of the parts, tag whose texts count; None for all).
PAGES = (("pptx_slide", r"ppt/slides/slide.*\.xml", "t"), ("vsdx_page", r"visio/pages/.*\.xml", None))
PAGE = "attachment_id string, block_type string, page_index int, entry_name string, texts array<string>"


def in_context(text: Column, path: Column) -> Column:
    """The text behind the headings that it stands under."""
    return F.when(F.size(path) > 0, F.concat(F.lit("章节："), F.array_join(path, " / "), F.lit("。"), text)).otherwise(text)


def sheet_rows(cells: DataFrame) -> DataFrame:
    """``file_id, sheet_index, sheet_name, row, ordinal, text`` of ``ooxml.cells``: a row's values in order, joined by bars."""
    shown = cells.withColumn("shown", T.collapse(F.col("value"))).where("shown <> ''")
    rows = shown.groupBy("file_id", "sheet_index", "sheet_name", "row").agg(F.array_sort(F.collect_list(F.struct("col", "shown"))).alias("cs"))
    ordinal = F.row_number().over(Window.partitionBy("file_id").orderBy("sheet_index", "row"))
    return rows.select("file_id", "sheet_index", "sheet_name", "row", ordinal.alias("ordinal"), F.array_join("cs.shown", " | ").alias("text"))


def _table_rows(cells: DataFrame) -> DataFrame:
    keys = ["file_id", "block_index", "table_index"]
    listed = cells.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("col", T.collapse(F.col("text")).alias("v"))))["v"].alias("values"), F.first("heading_path").alias("heading_path"))
    listed = listed.where(F.exists("values", lambda v: v != ""))
    listed = listed.withColumn("row", F.row_number().over(Window.partitionBy(*keys).orderBy("row")))
    score = F.size(F.filter("values", lambda v: v.isin(*HEADER_WORDS)))
    best = F.max(F.when(F.col("row") <= HEADER_ROWS, F.struct(score.alias("score"), (-F.col("row")).alias("at"), F.col("values").alias("names")))).over(Window.partitionBy(*keys))
    listed = listed.withColumn("best", best).withColumns({"header_row": -F.col("best.at"), "kept": without_repeats(F.filter("values", lambda v: v != "")), "names": without_repeats(F.filter("best.names", lambda v: v != ""))})
    named = F.transform("kept", lambda v, i: F.concat(F.coalesce(F.get("names", i), F.concat(F.lit("列"), (i + 1).cast("string"))), F.lit("："), v))
    body = F.when((F.size("names") > 0) & (F.col("kept") != F.col("names")), F.array_join(named, "；")).otherwise(F.concat(F.lit("表头："), F.array_join("kept", " | ")))
    next_one = lambda i: F.coalesce(F.get("values", i + 1), F.lit(""))
    turns = F.transform("values", lambda v, i: F.when(i % 2 == 0, F.when(next_one(i) != "", F.concat(v, F.lit("："), next_one(i))).otherwise(v)))
    above = F.array_join(F.array_compact(turns), "；")
    text = in_context(F.when(F.col("row") < F.col("header_row"), above).otherwise(body), F.col("heading_path"))
    return listed.select("file_id", "block_index", F.lit("table_row").alias("block_type"), "table_index", "row", F.col("heading_path").alias("section_context"), text.alias("text"))


def document_segments(blocks: DataFrame) -> DataFrame:
    """``file_id, ordinal, block_index, block_type, table_index, row, section_context, text`` of ``ooxml.blocks``.

    Paragraphs stand under their headings, a heading under those above it. The header of a table is the row with
    most header words among its first; rows before it are keys and values by turns, others are paired with it.
    """
    placed = heading_paths(blocks, "file_id", "block_index", "level", "text", deepest=9)
    path = F.col("heading_path")
    above = F.when(F.col("level") > 0, F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(path)
    texts = placed.where("block_type = 'paragraph'").select("file_id", "block_index", "block_type", "table_index", "row", path.alias("section_context"), in_context(F.col("text"), above).alias("text"))
    both = texts.unionByName(_table_rows(placed.where("block_type = 'table_cell'"))).where("text <> ''")
    return both.withColumn("ordinal", F.row_number().over(Window.partitionBy("file_id").orderBy("block_index", "row")))


def _texts_of(part: bytes, tag: str | None) -> list[str]:
    try:
        nodes = ET.fromstring(part).iter()
        return [n.text for n in nodes if n.text and n.text.strip() and (tag is None or n.tag.rpartition("}")[2] == tag)]
    except ET.ParseError:
        return []


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("attachment_id", pa.string()), ("block_type", pa.string()), ("page_index", pa.int32()), ("entry_name", pa.string()), ("texts", pa.list_(pa.string()))])
    for batch in batches:
        for key, data in zip(batch["attachment_id"].to_pylist(), batch["payload"].to_pylist(), strict=True):
            try:
                package = zipfile.ZipFile(io.BytesIO(data or b""))
                found = [(key, kind, i, name, _texts_of(package.read(name), tag)) for kind, pattern, tag in PAGES for i, name in enumerate(sorted(n for n in package.namelist() if re.fullmatch(pattern, n)), 1)]
            except (zipfile.BadZipFile, KeyError):
                continue  # the object's diagnostics tell which packages are broken
            if found:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in found], schema)


def page_segments(objects: DataFrame) -> DataFrame:
    """``attachment_id, ordinal, block_type, page_index, entry_name, text`` of slides and drawing pages in ``objects(attachment_id, payload)``."""
    found = objects.select("attachment_id", "payload").mapInArrow(_pages, PAGE)
    text = T.collapse(F.array_join(F.transform("texts", T.collapse), "；"))
    ordinal = F.row_number().over(Window.partitionBy("attachment_id").orderBy("block_type", "page_index"))
    return found.withColumn("text", text).where("text <> ''").select("attachment_id", ordinal.alias("ordinal"), "block_type", "page_index", "entry_name", "text")
