"""File registration, format probes by content, and plain text of HTML."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.functions import text as T
from sheafline.operators.order import first_match

#: First bytes of formats, as hex.
OLE_MAGIC, ZIP_MAGIC, PDF_MAGIC, RAR_MAGIC = "D0CF11E0A1B11AE1", "504B0304", "25504446", "526172211A07"


def scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below ``path`` with their bytes: path, size_bytes, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", F.col("length").alias("size_bytes"), "content")


def registered(files: DataFrame) -> DataFrame:
    """``files(path, size_bytes, ...)`` with file_id, file_name, declared_ext and size_mb (three places, half to even)."""
    name = F.regexp_extract("path", r"[^/]+$", 0)
    return files.withColumns({"file_id": T.file_id(F.col("path")), "file_name": name, "declared_ext": F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)), "size_mb": F.bround(F.col("size_bytes") / 1048576, 3)})


#: Extensions that are registered, and the roles of a file by its folder, name and extension.
EXTENSIONS = ("xlsx", "xls", "docx", "doc", "pdf", "png", "jpg", "jpeg")
FORM_FOLDER, INTRO_MARK = "工勘单", "情况说明介绍"


def registrable(files: DataFrame, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """The rows of ``files(path, ...)`` that are registered: of a known extension, and whose name has no leading dot."""
    name = F.regexp_extract("path", r"[^/]+$", 0)
    return files.where(~F.startswith(name, F.lit(".")) & F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*extensions))


def document_role(path: Column) -> Column:
    """What a file is for, by its path: a form, an introduction, the knowledge base, a proof, or unknown. The first rule that holds counts."""
    name = F.regexp_extract(path, r"[^/]+$", 0)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return first_match([
        (F.array_contains(F.split(path, "/"), FORM_FOLDER), "survey_form"), (kind.isin("docx", "doc") & F.contains(name, F.lit(INTRO_MARK)), "intro_doc"),
        (kind.isin("xlsx", "xls"), "knowledge_base"), (kind.isin("png", "jpg", "jpeg", "pdf"), "proof_attachment"),
    ], "unknown")


def _zip_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = []
        for data in batch["content"].to_pylist():
            try:
                names.append(zipfile.ZipFile(io.BytesIO(data or b"")).namelist())
            except zipfile.BadZipFile:
                names.append(None)
        yield pa.RecordBatch.from_arrays([batch["path"], pa.array(names, pa.list_(pa.string()))], ["path", "names"])


def probed(files: DataFrame) -> DataFrame:
    """``files(path, content)`` with what they are by content: package_type, parse_status, media_count, embedding_count.

    Workbook and document packages are told by their parts, whatever the extension says; broken packages and
    compound files need conversion.
    """
    parts = files.where(F.hex(F.substring("content", 1, 4)) == ZIP_MAGIC).select("path", "content").mapInArrow(_zip_names, "path string, names array<string>")
    magic = F.hex(F.substring("content", 1, 8))
    has = lambda p: F.exists("names", lambda n: n.rlike(p))
    kind = first_match([
        (F.col("names").isNotNull() & has(r"^xl/workbook\.xml$"), "xlsx_ooxml"), (F.col("names").isNotNull() & has(r"^word/document\.xml$"), "docx_ooxml"),
        (magic == OLE_MAGIC, "ole_compound_document"), (F.startswith(magic, F.lit(ZIP_MAGIC)), "mixed_or_invalid_ooxml"), (F.startswith(magic, F.lit(PDF_MAGIC)), "pdf"), (F.startswith(magic, F.lit(RAR_MAGIC)), "rar"),
    ], "unknown")
    status = first_match([(kind.isin("xlsx_ooxml", "docx_ooxml"), "ok"), (kind.isin("ole_compound_document", "mixed_or_invalid_ooxml"), "needs_conversion")], "unsupported")
    count = lambda p: F.coalesce(F.size(F.filter("names", lambda n: n.rlike(p))), F.lit(0))
    joined = files.join(parts, "path", "left")
    return joined.withColumns({"package_type": kind, "parse_status": status, "media_count": count("/media/"), "embedding_count": count("/embeddings/")}).drop("names")


def html_text(html: Column) -> Column:
    """Text of a page without scripts, styles and tags, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    return T.collapse(F.regexp_replace(bare, r"(?s)<[^>]*>", " "))
