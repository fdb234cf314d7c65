"""Archives as tables of the objects inside them, to any depth, with their lineage and within bounds.

A frontier of objects is opened one nesting level a round. Opening one object yields a row about itself and a row for
each member; members that can hold others are the next frontier, the rows of all others are done. Each round is one Spark
job over stored rows, in which every object is a piece of work of its own, so a root with many members is opened by many
tasks. Bytes are shuffled once a round, by object; what roots have left comes to them by a broadcast where roots are few.

What a root may expand to is bounded before it is read: what is left of the root's budget is dealt to its objects of the
frontier by their sizes, and a member that its share doesn't hold gives a row that says so instead of its bytes.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.sources import embedded, ooxml, segments
from sheafline.stored import stored

#: Packages that are documents, by a part that they have, and the parts of them that are objects.
DOCUMENT_PARTS = ("word/document.xml", "xl/workbook.xml", "ppt/presentation.xml", "visio/document.xml")
EMBEDDED = re.compile(r"(?:word|xl|ppt|visio)/embeddings/[^/]+")
#: Bytes of members that a task hands on at once, and of packed objects that a task opens.
HANDED = 16_777_216
TASK_BYTES = 33_554_432
#: Roots whose budgets are broadcast, at most: some 20 MB. Beyond, they are joined by a shuffle.
ROOTS = 100_000
#: First bytes of archives and of compound files, which can hold other objects.
HOLDERS = (b"PK\x03\x04", b"PK\x05\x06", bytes.fromhex("D0CF11E0A1B11AE1"))
#: Bytes that tell the type of an object, where the others aren't kept.
HEAD = 16


@dataclass(frozen=True)
class Limits:
    """Nesting levels below a root, bytes that all members of a root come to, bytes of one member, members of one object."""

    depth: int = 8
    root_bytes: int = 4_294_967_296
    member_bytes: int = 536_870_912
    members: int = 1_000_000


NODE = "object_id string, root_id string, parent_id string, path array<string>, depth int, ordinal int, name string, content binary, size long, digest string, above array<string>, status string, parts array<string>, n_members int, itself boolean"
TYPES = pa.schema([
    ("object_id", pa.string()), ("root_id", pa.string()), ("parent_id", pa.string()), ("path", pa.list_(pa.string())), ("depth", pa.int32()), ("ordinal", pa.int32()), ("name", pa.string()), ("content", pa.binary()),
    ("size", pa.int64()), ("digest", pa.string()), ("above", pa.list_(pa.string())), ("status", pa.string()), ("parts", pa.list_(pa.string())), ("n_members", pa.int32()), ("itself", pa.bool_()),
])


def _payload(name: str | None, data: bytes) -> tuple[str | None, bytes, str | None]:
    """Name and bytes of what a compound file wraps, and a note where it wraps nothing."""
    if data[:8].hex().upper() != "D0CF11E0A1B11AE1":
        return name, data, None
    try:
        native = embedded.ole_stream(data, "\x01Ole10Native")
        if native is not None:
            return *embedded.native_payload(native), None
        inner = embedded.ole_stream(data, "Package") or embedded.ole_stream(data, "package") or embedded.ole_stream(data, "CONTENTS")
    except Exception as e:  # compound files are read by offsets that they give themselves
        return name, data, f"broken_compound: {type(e).__name__}"
    return (name, inner, None) if inner else (name, data, "no_payload_stream")


def _read(package: zipfile.ZipFile, info: zipfile.ZipInfo, most: int) -> tuple[bytes | None, str | None]:
    """A member's bytes, or why it has none. No more than ``most`` bytes are unpacked, whatever size the archive declares."""
    if info.flag_bits & 1:
        return None, "encrypted"
    if info.file_size > most:
        return None, "over_budget"
    try:
        with package.open(info) as f:
            data = f.read(most + 1)
    except NotImplementedError:
        return None, "unsupported_method"
    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, ValueError) as e:
        return None, f"broken_member: {type(e).__name__}"
    return (data, None) if len(data) <= most else (None, "over_budget")


def _closed(data: bytes) -> str:
    """The status of an object that nothing is taken out of."""
    return "unsupported_archive" if data[:6] == b"Rar!\x1a\x07" else "leaf"


def _open_batches(limits: Limits, contents: bool):
    def row(**values) -> dict:
        return {k: values.get(k) for k in TYPES.names}

    def kept(data: bytes) -> bytes:
        return data if contents else data[:HEAD]

    def opened(r: dict) -> Iterator[dict]:
        known = {k: r[k] for k in ("object_id", "root_id", "parent_id", "path", "depth", "ordinal")}
        name, data, note = _payload(r["name"], r["content"] or b"")
        digest = hashlib.sha256(data).hexdigest()
        own = known | {"name": name, "content": kept(data), "size": len(data), "digest": digest, "itself": True}
        if data[:4] != b"PK\x03\x04" and data[:4] != b"PK\x05\x06":
            yield row(**own, status=note or _closed(data), n_members=0)
            return
        try:
            package = zipfile.ZipFile(io.BytesIO(data))
            infos = [i for i in package.infolist() if not i.is_dir()]
        except (zipfile.BadZipFile, ValueError, NotImplementedError) as e:
            yield row(**own, status=f"broken_archive: {type(e).__name__}", n_members=0)
            return
        with package:
            parts = [embedded.repaired_name(i.filename) for i in infos]
            document = any(p in DOCUMENT_PARTS for p in parts)
            wanted = [(i, n) for i, n in zip(infos, parts, strict=True) if not document or EMBEDDED.fullmatch(n)]
            done = "document" if document else "parsed_archive"
            refused = "contains_itself" if digest in r["above"] else "too_deep" if r["depth"] >= limits.depth else "too_many_members" if len(wanted) > limits.members else None
            if refused and wanted:
                yield row(**own, parts=parts, status=refused, n_members=len(wanted))
                return
            yield row(**own, parts=parts, status=done, n_members=len(wanted))
            left = r["budget"]
            for ordinal, (info, member) in enumerate(wanted, 1):
                content, why = _read(package, info, min(left, limits.member_bytes))
                left -= len(content or b"")
                one = {
                    "object_id": f"{r['object_id']}/{ordinal}", "root_id": r["root_id"], "parent_id": r["object_id"], "path": [*r["path"], member], "depth": r["depth"] + 1, "ordinal": ordinal,
                    "name": posixpath.basename(member) or member, "size": info.file_size if content is None else len(content),
                }
                if content is None:
                    yield row(**one, status=why, n_members=0, itself=True)
                elif content.startswith(HOLDERS):
                    yield row(**one, content=content, above=[*r["above"], digest], itself=False)
                else:
                    yield row(**one, content=kept(content), digest=hashlib.sha256(content).hexdigest(), status=_closed(content), n_members=0, itself=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                for out in opened(batch.slice(k, 1).to_pylist()[0]):
                    held.append(out)
                    size += len(out["content"] or b"") + 256
                    if size >= HANDED:
                        yield pa.RecordBatch.from_pylist(held, TYPES)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, TYPES)

    return run


def _round(frontier: DataFrame, left: DataFrame, limits: Limits, contents: bool, n: int) -> DataFrame:
    """The frontier opened: each object gets its share, by size, of what its root has left."""
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("double")
    share = F.when(F.col("all") > 0, F.floor(F.col("left") * (size / F.col("all")))).otherwise(0).cast("long")
    dealt = frontier.join(left, "root_id").withColumn("budget", share).drop("all", "left").repartition(n, "object_id")
    return stored(dealt.mapInArrow(_open_batches(limits, contents), NODE))


def expanded(attachments: DataFrame, limits: Limits = Limits(), contents: bool = True) -> DataFrame:
    """Every object in ``attachments(attachment_id, name, content)``, the attachments included, to ``limits.depth`` levels.

    Returns object_id (the attachment_id and the places of members, joined by ``/``), root_id, parent_id, path (names of
    the members down to it), depth, ordinal, name, file_type, size, content, digest (SHA-256), status, n_members.
    Members are those of archives, and the embedded objects of documents. status: ``leaf``, ``document``,
    ``parsed_archive``, or why an object was not opened (``too_deep``, ``too_many_members``, ``contains_itself``,
    ``broken_archive``, ``broken_member``, ``unsupported_archive``, ``unsupported_method``, ``encrypted``,
    ``over_budget``); those that were not read have no content, and their declared size. A null content is an empty leaf.
    Rows that repeat an attachment_id are objects of one root each. An empty table gives an empty table. Without
    ``contents`` bytes are read, measured and digested all the same, but the column content is null.
    """
    none = F.lit(None)
    start = attachments.select(
        F.col("attachment_id").cast("string").alias("object_id"), F.col("attachment_id").cast("string").alias("root_id"), none.cast("string").alias("parent_id"), F.array().cast("array<string>").alias("path"), F.lit(0).alias("depth"), F.lit(0).alias("ordinal"),
        "name", "content", none.cast("long").alias("size"), none.cast("string").alias("digest"), F.array().cast("array<string>").alias("above"), none.cast("string").alias("status"), none.cast("array<string>").alias("parts"), none.cast("int").alias("n_members"), F.lit(False).alias("itself"),
    )
    frontier, levels = stored(start), []
    found = frontier.select("root_id", F.octet_length("content").alias("size"))  # what the last round brought
    spent = frontier.sparkSession.createDataFrame([], "root_id string, bytes long")
    while True:
        n, size = frontier.agg(F.count("*"), F.sum(F.octet_length("content"))).first()
        if not n:
            break
        sizes = found.groupBy("root_id").agg(F.sum(F.coalesce("size", F.lit(0)).cast("double")).alias("all"))
        budget = F.greatest(F.lit(0), F.lit(limits.root_bytes) - F.coalesce("bytes", F.lit(0)))
        left = stored(sizes.join(spent, "root_id", "left").select("root_id", "all", budget.alias("left")))
        few = left.limit(ROOTS + 1).count() <= ROOTS
        # an object is few bytes with much work behind them: what was counted decides how many tasks there are
        tasks = min(n, max(2 * frontier.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // TASK_BYTES)))
        level = _round(frontier, F.broadcast(left) if few else left, limits, contents, tasks)
        levels.append(level.where("itself"))
        frontier = level.where("not itself")
        read = F.when(F.col("status").isNull() | F.col("digest").isNotNull(), F.col("size")).otherwise(0)
        found = level.where(F.col("depth") == len(levels)).select("root_id", read.alias("size"))
        spent = stored(spent.unionByName(found.groupBy("root_id").agg(F.sum("size").alias("bytes"))).groupBy("root_id").agg(F.sum("bytes").alias("bytes")))
    if not levels:
        levels = [frontier]
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    kind = embedded.file_type(F.col("content"), F.col("name"), F.col("parts"))
    return out.select("object_id", "root_id", "parent_id", "path", "depth", "ordinal", "name", kind.alias("file_type"), "size", F.col("content") if contents else F.lit(None).cast("binary").alias("content"), "digest", "status", "n_members")


def lineage(path: Column) -> Column:
    """The names that lead to an object, from the outermost archive on."""
    return F.array_join(path, " > ")


def nested_segments(objects: DataFrame) -> DataFrame:
    """``object_id, root_id, lineage, file_type, block_type, ordinal, text``: what the documents among ``expanded`` objects say.

    Rows of sheets, paragraphs and table rows of texts, slides and drawing pages, wherever the document is nested. A
    document that can't be read gives no segment; ``unread`` names it.
    """
    keys = objects.select("object_id", "root_id", lineage(F.col("path")).alias("lineage"), "file_type")
    found = segments.sheet_rows(ooxml.cells(_files(objects, "xlsx"))).select(F.col("file_id").alias("object_id"), F.lit("sheet_row").alias("block_type"), "ordinal", "text")
    texts = segments.document_segments(ooxml.blocks(_files(objects, "docx"))).select(F.col("file_id").alias("object_id"), "block_type", "ordinal", "text")
    pages = segments.page_segments(objects.where(F.col("file_type").isin("pptx", "vsdx")).select(F.col("object_id").alias("attachment_id"), F.col("content").alias("payload")))
    pages = pages.select(F.col("attachment_id").alias("object_id"), "block_type", "ordinal", "text")
    return keys.join(found.unionByName(texts).unionByName(pages), "object_id")


def _files(objects: DataFrame, kind: str) -> DataFrame:
    return objects.where((F.col("file_type") == kind) & F.col("content").isNotNull()).select(F.col("object_id").alias("file_id"), "content")


#: File types whose texts are read.
READABLE = ("xlsx", "docx", "pptx", "vsdx")


def unread(objects: DataFrame, told: DataFrame) -> DataFrame:
    """The objects that were refused, and the documents among the others that gave no segment, with the reason."""
    silent = objects.where(F.col("file_type").isin(*READABLE) & F.col("content").isNotNull()).join(told.select("object_id").distinct(), "object_id", "left_anti").withColumn("reason", F.lit("no_segments"))
    refused = objects.where(~F.col("status").isin("leaf", "document", "parsed_archive")).withColumn("reason", F.col("status"))
    columns = ["object_id", "root_id", lineage(F.col("path")).alias("lineage"), "file_type", "size", "reason"]
    both = refused.select(*columns).unionByName(silent.join(refused.select("object_id"), "object_id", "left_anti").select(*columns))
    return both


def archive_summary(objects: DataFrame) -> DataFrame:
    """One row a root: objects, the deepest level, bytes of all members, and how many objects have each status."""
    by_status = objects.groupBy("root_id", F.regexp_extract("status", r"^[a-z_]+", 0).alias("status")).agg(F.count("*").alias("n"), F.max("depth").alias("depth"), F.sum(F.when(F.col("depth") > 0, F.col("size")).otherwise(0)).alias("bytes"))
    return by_status.groupBy("root_id").agg(F.sum("n").alias("n_objects"), F.max("depth").alias("depth"), F.sum("bytes").alias("bytes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("statuses"))


def _packed(rows: pa.Table) -> pa.Table:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in zip(rows["member"].to_pylist(), rows["content"].to_pylist(), strict=True):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data or b"")
    return pa.table({"name": [rows["name"][0].as_py()], "content": pa.array([out.getvalue()], pa.binary())})


def packed(members: DataFrame) -> DataFrame:
    """``name, content``: an archive of each name out of ``members(name, member, content)``, in order of member. An archive is built in memory."""
    order = F.row_number().over(Window.partitionBy("name").orderBy("member"))
    return members.select("name", "member", "content").withColumn("at", order).groupBy("name").applyInArrow(lambda rows: _packed(rows.sort_by("at")), "name string, content binary")
