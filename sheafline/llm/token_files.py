"""Token ids of documents in binary files, byte-aligned and of variable length, the frequent ids shortest.

Ids are replaced by their ranks of frequency over all documents. Four ranks share a control byte that holds two bits
for each, its bytes less one; control bytes of a block stand together, before its data bytes. So decoding is a numpy
lookup of lengths in a table of 256 rows, a running sum, and one gather.

A folder holds ``codebook`` (the id of each rank) and files. A file is a mark, blocks of ``BLOCK`` ids without regard
to documents, and a footer: where each block begins, each document's doc_id, and the ids up to its end. Any range of
documents is read from its own blocks. Files follow one another in ascending order of doc_id.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch
from .tokens import VOCABULARY, by_rank, encode_ids, tokenizer
from .warc import _open

#: The id after each document.
END = 2
#: Ids of a block, and ids and documents at which a file ends.
BLOCK = 65_536
FILE_IDS = 33_554_432
FILE_DOCS = 1_048_576
#: Ids that a writing task gets at least where there are cores for more tasks, and those a reading task gets.
LEAST_IDS = 1_048_576
READ_IDS = 4_194_304
MARK = b"ids\x01"
TAIL = struct.Struct("<QQQQI4s")

#: Bytes of the four values of each control byte.
WIDTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.int64) + 1
#: What of four bytes belongs to a value of so many bytes.
KEEP = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], "<u4")


def pack_block(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit integers."""
    values = np.ascontiguousarray(values, "<u4")
    more = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = more
    control = (padded.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(1, dtype=np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]]
    return control.tobytes(), data.tobytes()


def unpack_block(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` integers of a block."""
    widths = WIDTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(widths)
    if n and ends[-1] != len(data):
        raise ValueError("a block's control bytes and data bytes disagree")
    padded = data + b"\0\0\0"
    four = np.ndarray((max(len(data), 1),), "<u4", padded.ljust(4, b"\0"), strides=(1,))
    return four[ends - widths] & KEEP[widths]


class FileWriter:
    """One file, written front to back; memory holds a block and the footer."""

    def __init__(self, out, rank_of: np.ndarray):
        self.out, self.rank_of, self.at = out, rank_of, 0
        self.held, self.n_held, self.n_ids = [], 0, 0
        self.blocks, self.doc_ids, self.known, self.ends = [], [], [], []
        self._put(MARK)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _block(self, values: np.ndarray) -> None:
        control, data = pack_block(values)
        self.blocks.append(self.at)
        self._put(struct.pack("<II", len(values), len(data)) + control + data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.held.append(self.rank_of[ids])
        self.n_held += len(ids)
        self.n_ids += len(ids)
        self.doc_ids.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.ends.append(self.n_ids)
        if self.n_held >= BLOCK:
            values = np.concatenate(self.held)
            whole = len(values) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                self._block(values[i : i + BLOCK])
            self.held, self.n_held = [values[whole:]], len(values) - whole

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        footer = b"".join(np.array(x, t).tobytes() for x, t in ((self.blocks, "<i8"), (self.doc_ids, "<i8"), (self.known, "u1"), (self.ends, "<i8")))
        start = self.at
        self._put(footer + TAIL.pack(start, len(self.blocks), len(self.ends), self.n_ids, zlib.crc32(footer), MARK))


class FileReader:
    """Documents of one file, by ranges of its ids."""

    def __init__(self, file, size: int, id_of: np.ndarray):
        self.file, self.id_of = file, id_of
        start, n_blocks, n_docs, self.n_ids, crc, mark = TAIL.unpack(self._at(size - TAIL.size, TAIL.size))
        footer = self._at(start, size - TAIL.size - start)
        if mark != MARK or zlib.crc32(footer) != crc:
            raise ValueError("no token file, or one whose footer is damaged")
        self.blocks = np.frombuffer(footer, "<i8", n_blocks)
        self.doc_ids = np.frombuffer(footer, "<i8", n_docs, 8 * n_blocks)
        self.known = np.frombuffer(footer, "u1", n_docs, 8 * (n_blocks + n_docs)).astype(bool)
        self.ends = np.frombuffer(footer, "<i8", n_docs, 8 * (n_blocks + n_docs) + n_docs)
        self.limits = np.append(self.blocks, start)

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("the file ends early")
        return data

    def block(self, k: int) -> np.ndarray:
        raw = self._at(int(self.limits[k]), int(self.limits[k + 1] - self.limits[k]))
        n, length = struct.unpack_from("<II", raw)
        control = -(-n // 4)
        return self.id_of[unpack_block(raw[8 : 8 + control], raw[8 + control : 8 + control + length], n)]

    def documents(self, lo: int, hi: int | None) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """(doc_id, ids of the file before it, its ids in parts) of each document that begins at ids ``lo`` to ``hi`` (None: the end)."""
        starts = np.concatenate(([0], self.ends[:-1])) if len(self.ends) else self.ends
        a, b = np.searchsorted(starts, lo), len(starts) if hi is None else np.searchsorted(starts, hi)
        at, ids = -1, None
        for d in range(a, b):
            start, end = int(starts[d]), int(self.ends[d])

            def parts(start=start, end=end):
                nonlocal at, ids
                while start < end:
                    if start // BLOCK != at:
                        at, ids = start // BLOCK, self.block(start // BLOCK)
                    stop = min(end, (at + 1) * BLOCK)
                    yield ids[start - at * BLOCK : stop - at * BLOCK]
                    start = stop

            yield int(self.doc_ids[d]) if self.known[d] else None, start, parts()


ENCODED = "doc_id long, uid long, n_tokens long, crc long, ids binary"


def _encode_batches(vocabulary: str, ranked: bool, end: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer(vocabulary, ranked)
        tail = np.array([] if end is None else [end], "<u4")
        for batch in batches:
            n, crc, out = [], [], []
            for text in batch["text"]:
                ids = np.concatenate((encode_ids(text.as_py() or "", vocabulary), tail))
                n.append(len(ids))
                crc.append(zlib.crc32(ids.tobytes()))
                out.append(_small(ids))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["uid"], pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "uid", "n_tokens", "crc", "ids"])

    return run


def _small(ids: np.ndarray) -> bytes:
    """Ids for the stored table and the shuffle: two bytes each where all fit, compressed."""
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    return bytes([wide]) + pa.compress(ids.astype("<u4" if wide else "<u2").tobytes(), codec="zstd", asbytes=True)


def _large(data: bytes, n: int) -> np.ndarray:
    kind = np.dtype("<u4" if data[0] else "<u2")
    return np.frombuffer(pa.decompress(data[1:], n * kind.itemsize, codec="zstd", asbytes=True), kind)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for n, data in zip(batch["n_tokens"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            counts = np.bincount(_large(data, n), minlength=len(total))
            counts[: len(total)] += total
            total = counts
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])


def codebook(encoded: DataFrame, vocabulary: str = VOCABULARY) -> np.ndarray:
    """The id of each rank: by falling frequency, then by id; ids that don't occur come last.

    Tasks send one row for each id that they have, and the driver gets as many rows as the vocabulary has ids.
    """
    counted = encoded.select("n_tokens", "ids").mapInArrow(_count_batches, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    library = tokenizer(vocabulary)[0]
    size = max(library.get_vocab_size(with_added_tokens=True), int(counted["id"].max()) + 1 if len(counted) else 0)
    times = np.zeros(size, np.int64)
    times[counted["id"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    return np.argsort(-times, kind="stable").astype("<u4")


FILES = "path string, part int, seq int, n_docs long, n_ids long"


def _write_batches(folder: str, id_of: np.ndarray, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of = np.empty(len(id_of), np.uint32)
        rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
        writer, seq, part = None, 0, 0

        def close() -> pa.RecordBatch:
            writer.close()
            writer.out.close()
            return pa.RecordBatch.from_arrays([pa.array([writer.path]), pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(writer.ends)], pa.int64()), pa.array([writer.n_ids], pa.int64())], ["path", "part", "seq", "n_docs", "n_ids"])

        for batch in batches:
            for r in batch.to_pylist():
                if writer is None:
                    path, part = f"{folder}/{uuid.uuid4().hex}.ids", r["part"]
                    where, at = _open(path)
                    where.create_dir(at.rpartition("/")[0], recursive=True)
                    writer = FileWriter(where.open_output_stream(at), rank_of)
                    writer.path = path
                writer.add(r["doc_id"], _large(r["ids"], r["n_tokens"]))
                if writer.n_ids >= most or len(writer.ends) >= FILE_DOCS:
                    yield close()
                    writer, seq = None, seq + 1
        if writer is not None:
            yield close()

    return run


def write_files(docs: DataFrame, vocabulary: str = VOCABULARY, end: int | None = END, most: int = FILE_IDS) -> DataFrame:
    """Writes the ids of every row of ``docs(doc_id, text)`` to files and returns their stored list ``path, part, seq, n_docs, n_ids``.

    Rows are ranged by doc_id (nulls first), those of equal doc_id by number and checksum of their ids, so that a
    doc_id that repeats is dealt to many tasks as well. A task writes files of names of its own attempt; only files of
    attempts that ended are in the list.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), "text")
    encoded = materialise(rows.mapInArrow(_encode_batches(vocabulary, by_rank(vocabulary), end), ENCODED))
    total = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    id_of = codebook(encoded, vocabulary)
    folder = scratch(spark)
    where, at = _open(f"{folder}/codebook")
    where.create_dir(at.rpartition("/")[0], recursive=True)
    with where.open_output_stream(at) as out:
        out.write(id_of.tobytes())
    parts = max(1, -(-total // most), min(2 * spark.sparkContext.defaultParallelism, -(-total // LEAST_IDS)))
    order = [F.col("doc_id").asc_nulls_first(), "n_tokens", "crc", "uid"]
    ranged = encoded.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = ranged.select("doc_id", "n_tokens", "ids", F.spark_partition_id().alias("part"))
    return materialise(ranged.mapInArrow(_write_batches(folder, id_of, most), FILES))


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read_batches(with_ids: bool):
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = {}
        for batch in batches:
            for r in batch.to_pylist():
                folder = r["path"].rpartition("/")[0]
                if folder not in books:
                    where, at = _open(f"{folder}/codebook")
                    with where.open_input_stream(at) as f:
                        books[folder] = np.frombuffer(f.read(), "<u4")
                where, at = _open(r["path"])
                with where.open_input_file(at) as file:
                    reader, out = FileReader(file, file.size(), books[folder]), []
                    for doc_id, start, parts in reader.documents(r["lo"], r["hi"]):
                        n, crc, kept = 0, 0, []
                        for ids in parts:
                            n, crc = n + len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4"), crc)
                            if with_ids:
                                kept += ids.tolist()
                        out.append((doc_id, r["before"] + start, n, crc, *([kept] if with_ids else [])))
                        if len(out) >= (64 if with_ids else 8192):
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                            out = []
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def read_files(files: DataFrame, with_ids: bool = False, span: int = READ_IDS) -> DataFrame:
    """Every document of ``files``: doc_id, start (ids of all documents before it), n_tokens, ids_crc32; with_ids adds ``ids``.

    The driver gets one row a file, of 33 million ids if there are so many, to sum up what stands before each. A task
    reads the documents that begin in a range of ``span`` ids of a file.
    """
    spark, before, ranges = files.sparkSession, 0, []
    for f in files.orderBy("part", "seq").collect():
        cuts = [*range(0, max(1, f["n_ids"]), span)]
        ranges += [(f["path"], before, lo, None if lo == cuts[-1] else lo + span) for lo in cuts]
        before += f["n_ids"]
    tasks = spark.createDataFrame(ranges, "path string, before long, lo long, hi long").repartition(max(1, len(ranges)))
    return tasks.mapInArrow(_read_batches(with_ids), READ + (", ids array<long>" if with_ids else ""))


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, end: int | None = END) -> DataFrame:
    """Writes the ids of every row of ``docs(doc_id, text)``, then ``end``, and reads the files back.

    A null text counts as empty: ``end`` alone. Rows without doc_id come first; rows that repeat a doc_id follow one
    another and are documents each. Texts are encoded whole, in blocks that bound memory. Other columns are ignored;
    an empty table gives an empty table.
    """
    return read_files(write_files(docs, vocabulary, end))
