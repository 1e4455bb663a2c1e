"""Token ids in directly addressable codes: any id is read from a file without decoding a block.

An id is split into chunks of 8 bits, the lowest first. Level k holds the k-th chunk of every id that
has one, a bitmap that tells which of them go on, and a rank directory over the bitmap: the number of
set bits before each block of 512. The place of an id on the next level is the rank of its bit.

A file (little-endian): 8 bytes of magic, then unsigned 64-bit counts: documents, ids, levels, and for
each level its entries; the documents' ids (signed 64-bit), a byte each that is 1 where the id is null,
the first token of each document and the end (unsigned 64-bit); then for each level chunks, bitmap and
directory (words of 64 bits). Sections start at multiples of 8 bytes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, small_text, text_groups, work_dir
from .files import reading, writing
from .tokens import word_tokenizer

MAGIC = b"GLDAC\x00\x01\n"
BLOCK = 8  # words of a directory block
#: Ids in one file at most (and one document): what a writer holds in memory.
FILE_IDS = 8 << 20


def _words(n: int) -> int:
    return (n + 63) // 64


def _padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 8)


def encode(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, directory) of each level."""
    levels, v = [], ids.astype(np.uint32)
    while True:
        more = v >> 8 > 0
        bits = np.zeros(_words(len(v)) * 64, np.uint8)
        bits[: len(v)] = more
        bitmap = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(bitmap), dtype=np.uint64)])
        levels.append((v.astype(np.uint8), bitmap, ones[:-1:BLOCK].astype("<u8")))
        v = v[more] >> 8
        if not len(v):
            return levels


def dump(out, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> None:
    levels = encode(ids)
    head = [len(doc_ids), len(ids), len(levels), *(len(c) for c, _, _ in levels)]
    out.write(MAGIC + np.array(head, "<u8").tobytes())
    out.write(np.array([x or 0 for x in doc_ids], "<i8").tobytes())
    out.write(_padded(bytes(x is None for x in doc_ids)))
    out.write(np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes())
    for chunks, bitmap, ranks in levels:
        out.write(_padded(chunks.tobytes()) + bitmap.tobytes() + ranks.tobytes())


class Reader:
    """Random access to the ids of one file. Only what a call asks for is read."""

    def __init__(self, file):
        self.file = file
        if file.read(8) != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.n_docs, self.n_ids, n_levels = (int(x) for x in np.frombuffer(file.read(24), "<u8"))
        sizes = [int(x) for x in np.frombuffer(file.read(8 * n_levels), "<u8")]
        at = 32 + 8 * n_levels
        self.ids_at, self.null_at = at, at + 8 * self.n_docs
        self.starts_at = self.null_at + self.n_docs + -self.n_docs % 8
        at = self.starts_at + 8 * (self.n_docs + 1)
        self.levels = []
        for n in sizes:
            bitmap = at + n + -n % 8
            ranks = bitmap + 8 * _words(n)
            self.levels.append((n, at, bitmap, ranks))
            at = ranks + 8 * -(-_words(n) // BLOCK)

    def _read(self, at: int, n: int, kind: str) -> np.ndarray:
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * np.dtype(kind).itemsize), kind)

    def doc_ids(self) -> list[int | None]:
        null = self._read(self.null_at, self.n_docs, "u1")
        return [None if z else int(x) for x, z in zip(self._read(self.ids_at, self.n_docs, "<i8"), null)]

    def starts(self) -> np.ndarray:
        return self._read(self.starts_at, self.n_docs + 1, "<u8").astype(np.int64)

    def _rank(self, level: int, i: int) -> int:
        """Set bits before position i of a level's bitmap: one directory entry and one block."""
        n, _, bitmap, ranks = self.levels[level]
        if not i:
            return 0
        block = (i - 1) // (64 * BLOCK)
        words = self._read(bitmap + 8 * BLOCK * block, _words(i) - BLOCK * block, "<u8").copy()
        if i % 64:
            words[-1] &= np.uint64((1 << i % 64) - 1)
        return int(self._read(ranks + 8 * block, 1, "<u8")[0]) + int(np.bitwise_count(words).sum())

    def range(self, a: int, b: int, level: int = 0) -> np.ndarray:
        """Ids a up to b, as unsigned 32-bit integers."""
        n, chunks, bitmap, _ = self.levels[level]
        if not 0 <= a <= b <= n:
            raise IndexError((a, b, n))
        out = self._read(chunks + a, b - a, "u1").astype(np.uint32)
        if b > a and level + 1 < len(self.levels):
            first = a // 64
            bits = np.unpackbits(self._read(bitmap + 8 * first, _words(b) - first, "<u8").view(np.uint8), bitorder="little")[a - 64 * first : b - 64 * first]
            more = np.flatnonzero(bits)
            if len(more):
                j = self._rank(level, a)
                out[more] |= self.range(j, j + len(more), level + 1) << np.uint32(8)
        return out

    def __getitem__(self, i: int) -> int:
        return int(self.range(i, i + 1)[0])


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Writes the ids of every row, each with the end id, in ascending id order; returns the files' list.

    The list is (path, part, file, documents, ids); files in order of (part, file) hold all documents in
    order, null ids first. Null text is empty: the end id alone. Rows of equal id stay, by text. An
    empty table writes nothing.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), small_text(docs[text_col]).alias("text"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        encode_texts, part, done = word_tokenizer(vocabulary).encode, TaskContext.get().partitionId(), 0
        docs_, lengths, held, size = [], [], [], 0

        def flush():
            path = f"{folder}/{part:06d}-{done:06d}.dac"
            with writing(path) as out:
                dump(out, docs_, lengths, np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_pylist([{"path": path, "part": part, "file": done, "documents": len(docs_), "ids": size}], schema=schema)

        for b in text_groups(batches, most=2 << 20):
            for doc, ids in zip(b.column("doc_id").to_pylist(), encode_texts(b.column("text").to_pylist())):
                docs_.append(doc)
                held.append(ids + end)
                lengths.append(len(ids) // 4 + 1)
                size += lengths[-1]
                if size >= FILE_IDS:
                    yield flush()
                    done, docs_, lengths, held, size = done + 1, [], [], [], 0
        if docs_:
            yield flush()

    schema = pa.schema([("path", pa.string()), ("part", pa.int32()), ("file", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64())])
    return materialize(rows.mapInArrow(run, "path string, part int, file int, documents long, ids long"), "files")


def read_tokens(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids binary]) of every document in the files of write_tokens.

    start counts the ids of all documents before; ids are little-endian unsigned 32-bit integers.
    """
    # a row per file: the list is small enough for one ordered window
    placed = files.withColumn("first", F.sum("ids").over(Window.orderBy("part", "file")) - F.col("ids")).select("path", "first")
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]

    def run(batches):
        for b in batches:
            for path, first in zip(b.column("path").to_pylist(), b.column("first").to_pylist()):
                with reading(path) as f:
                    r = Reader(f)
                    docs, starts = r.doc_ids(), r.starts()
                    lo = 0
                    while lo < len(docs):  # documents of about a million ids at a time
                        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + (1 << 20), side="right")) - 1)
                        raw, base = r.range(int(starts[lo]), int(starts[hi])).tobytes(), int(starts[lo])
                        cut = [raw[4 * (s - base) : 4 * (e - base)] for s, e in zip(starts[lo:hi].tolist(), starts[lo + 1 : hi + 1].tolist())]
                        cols = [pa.array(docs[lo:hi], pa.int64()), pa.array(first + starts[lo:hi]), pa.array(np.diff(starts[lo : hi + 1])), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(cut if with_ids else [], pa.binary())]
                        yield pa.RecordBatch.from_arrays(cols[: 4 + with_ids], names=names)
                        lo = hi

    spread = placed.repartition(partitions(files.sparkSession))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def round_trip(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """write_tokens to the shared folder, then read_tokens."""
    return read_tokens(write_tokens(docs, work_dir(spark, "tokens"), vocabulary, end_id=end_id))
