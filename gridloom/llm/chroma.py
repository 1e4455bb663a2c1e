"""Chroma audio fingerprints of a column of recordings, and their alignment.

Spectra of overlapping frames are folded into twelve pitch classes. Sixteen filters, rectangles over an
integral image of the chroma frames, are each quantised to two bits, so that a frame becomes a 32-bit
integer. Recordings that share runs of integers are aligned by a histogram of offsets, and judged by the
share of bits that differ where they overlap.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

RATE = 4000
FRAME = 1024
HOP = 256
LOWEST, HIGHEST = 55.0, 1800.0
#: Frames that a filter spans at most.
SPAN = 8
#: A key is PARTS integers, a step of STEPS frames apart, and of each the coarse bits of the filters of full span.
STEPS, PARTS = (8, 5), 4
COARSE = 0xAAAA0000
#: Places of equal keys, or keys one bit apart, count if at most SIDE of the 64 bits of the other filters differ.
SIDE = 16
#: Offsets of a pair that are judged, those with most shared keys first.
TOP = 3
#: Largest share of differing bits of recordings that match, over at least LEAST frames.
MOST_ERROR = 0.2
LEAST = 24


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, height, width) of sixteen filters: kinds in turn, sizes by steps."""
    out = []
    for i in range(16):
        height = 2 + 2 * (i % 5)
        out.append((i % 4, (5 * i) % (13 - height), height, (SPAN, SPAN // 2)[i // 8]))
    return out


FILTERS = _filters()


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Frames by twelve pitch classes, each frame of unit length (or zero); none for less than a frame."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    x = np.nan_to_num(samples.astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    window = np.hanning(FRAME)
    freq = np.fft.rfftfreq(FRAME, 1 / rate)
    use = np.flatnonzero((freq >= LOWEST) & (freq <= HIGHEST))
    pitch = np.round(12 * np.log2(freq[use] / 440.0)).astype(int) % 12
    fold = (pitch[:, None] == np.arange(12)).astype(float)
    views = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.concatenate([np.abs(np.fft.rfft(v * window, axis=1)[:, use]) ** 2 @ fold for v in np.array_split(views, -(-len(views) // 256))])
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 1e-9)


def integers(frames: np.ndarray) -> np.ndarray:
    """A packed integer for each frame that has SPAN frames from it on."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def area(t0, t1, y0, y1):
        return image[t1, y1] - image[t0, y1] - image[t1, y0] + image[t0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        a, m, b = t, t + w // 2, t + w
        low, mid, top = y, y + h // 2, y + h
        if kind == 0:  # lower against upper pitch classes
            p, q = area(a, b, low, mid), area(a, b, mid, top)
        elif kind == 1:  # earlier against later frames
            p, q = area(a, m, low, top), area(m, b, low, top)
        elif kind == 2:  # a chequer
            p, q = area(a, m, low, mid) + area(m, b, mid, top), area(a, m, mid, top) + area(m, b, low, mid)
        else:  # the band against all the rest
            p, q = area(a, b, low, top), area(a, b, 0, 12) - area(a, b, low, top)
        value = np.log1p(np.maximum(p, 0)) - np.log1p(np.maximum(q, 0))
        level = np.digitize(value, (-0.35, 0.0, 0.35)).astype(np.uint32)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))  # neighbouring levels differ in one bit
    return out


def melody(vector, rate: int = RATE, seconds: float = 0.1) -> np.ndarray:
    """A recording of a numeric vector: a note per entry, its pitch by the value; null entries are rests."""
    v = np.array([np.nan if x is None else x for x in vector or []], dtype=np.float64)
    n = int(rate * seconds)
    t = np.arange(n) / rate
    pitch = np.clip(np.round(np.nan_to_num(v) * 40), -24, 24)
    tone = np.sin(2 * np.pi * (440.0 * 2.0 ** (pitch / 12))[:, None] * t)
    tone[~np.isfinite(v)] = 0
    return (tone * np.hanning(n) ** 0.25).ravel()


def fingerprints(media: DataFrame, id_col: str, samples_col: str, render: bool = False, rate: int = RATE) -> DataFrame:
    """(id, fp array<long>) of every row: unsigned 32-bit integers. render: the column holds vectors for melody().

    Null, empty and short recordings have no integers; null ids and repeated rows stay.
    """

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                s = b.slice(lo, 64)
                fps = [integers(chroma(melody(x) if render else np.array(x or [], dtype=np.float64), rate)) for x in s.column("samples").to_pylist()]
                yield pa.RecordBatch.from_arrays([s.column("id"), pa.array([f.astype(np.int64) for f in fps], pa.list_(pa.int64())), pa.array([zlib.crc32(f.astype("<u4").tobytes()) for f in fps], pa.int64())], names=["id", "fp", "crc"])

    return media.select(media[id_col].cast("long").alias("id"), media[samples_col].alias("samples")).mapInArrow(run, "id long, fp array<long>, crc long")


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of differing bits where b, moved by offset, overlaps a; and the overlap in frames."""
    lo, hi = max(0, offset), min(len(a), len(b) + offset)
    if hi <= lo:
        return 1.0, 0
    wrong = np.bitwise_count(a[lo:hi].astype(np.uint32) ^ b[lo - offset : hi - offset].astype(np.uint32)).sum()
    return float(wrong) / (32 * (hi - lo)), hi - lo


def places(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, side, at) of every place, for each step; of a held note, which repeats a key, its first place."""
    out = []
    for family, step in enumerate(STEPS):
        n = max(0, len(fp) - (PARTS - 1) * step)
        key, side = np.full(n, family, np.uint64), np.zeros(n, np.uint64)
        for k in range(PARTS):
            x = fp[k * step : k * step + n].astype(np.uint64)
            key |= (x & np.uint64(COARSE)) >> np.uint64(16) << np.uint64(16 * k)
            side |= (x & np.uint64(0xFFFF)) << np.uint64(16 * k)
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[:n])
        out.append((key[at], side[at], at))
    return tuple(np.concatenate(x) for x in zip(*out))


#: No change, and each coarse bit of a key changed.
PROBES = np.array([0] + [1 << (16 * k + b) for k in range(PARTS) for b in range(16) if COARSE >> (16 + b) & 1], np.uint64)


def _posted(classes: DataFrame, probe: bool) -> DataFrame:
    """(class_id, key, side, at) of the places of every class; probe: also with each key one bit apart."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                s = b.slice(lo, 64)
                for i, fp in zip(s.column("class_id").to_pylist(), s.column("fp").to_pylist()):
                    key, side, at = places(np.array(fp, np.int64))
                    if probe:
                        key, side, at = (key[:, None] ^ PROBES).ravel(), np.repeat(side, len(PROBES)), np.repeat(at, len(PROBES))
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(key), pa.int64()), pa.array(key.view(np.int64)), pa.array(side.view(np.int64)), pa.array(at.astype(np.int32))], names=["class_id", "key", "side", "at"])

    return classes.select("class_id", "fp").mapInArrow(run, "class_id long, key long, side long, at int")


def align(media: DataFrame, id_col: str, samples_col: str, every: int = 50, render: bool = False) -> tuple[DataFrame, DataFrame]:
    """Classes of recordings with equal fingerprints, and matches of query classes against all classes.

    The first table: (id, class_id, n_frames, fingerprint_crc32, is_query); class_id is the smallest id
    of the class. Queries are the rows whose id is divisible by `every`. The second: (query_class,
    class_id, offset, error, overlap) of distinct classes that share a key but for one bit, if at most
    MOST_ERROR of the bits differ over LEAST frames or more; of the TOP offsets with most shared keys,
    that with the fewest errors (the smallest of equals). Copies are one class, so no group of copies is paired.
    Null, empty and short recordings are one class without frames, which matches nothing; a class whose ids
    are all null is in the first table but matches nothing; an empty table gives two empty ones.
    """
    found = materialize(fingerprints(media, id_col, samples_col, render).withColumn("h1", F.xxhash64("fp")), "chroma")
    classes = found.groupBy("h1", "crc").agg(F.min("id").alias("class_id"), F.first("fp").alias("fp"), F.max(F.coalesce(F.col("id") % every == 0, F.lit(False))).alias("asked"))
    classes = materialize(classes, "classes")
    members = found.select("id", "h1", "crc", F.size("fp").cast("long").alias("n_frames")).join(classes.select("h1", "crc", "class_id"), ["h1", "crc"])
    members = members.select("id", "class_id", "n_frames", F.col("crc").alias("fingerprint_crc32"), F.coalesce(F.col("id") % every == 0, F.lit(False)).alias("is_query"))
    q = _posted(classes.where("asked"), True).select(F.col("class_id").alias("query_class"), "key", F.col("side").alias("q_side"), F.col("at").alias("q_at"))
    near = F.bit_count(F.col("q_side").bitwiseXOR(F.col("side"))) <= SIDE
    met = q.join(_posted(classes, False), "key").where("query_class <> class_id").where(near)
    votes = met.groupBy("query_class", "class_id", (F.col("q_at") - F.col("at")).alias("offset")).count()
    top = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("c"), "offset"))), 1, TOP)
    best = votes.groupBy("query_class", "class_id").agg(top.alias("top")).select("query_class", "class_id", F.col("top.offset").alias("offsets"))
    pairs = best.join(classes.select(F.col("class_id").alias("query_class"), F.col("fp").alias("a")), "query_class").join(classes.select("class_id", F.col("fp").alias("b")), "class_id")

    def judged(a: np.ndarray, b: np.ndarray, offsets: list[int]) -> tuple[float, int, int]:
        """(error, offset, overlap) of the best offset; those of too short an overlap come last."""
        got = [(*bit_errors(a, b, o), o) for o in offsets]
        return min((n < LEAST, e, o, n) for e, n, o in got)[1:]

    def run(batches):
        for b in batches:
            got = [judged(np.array(x), np.array(y), o) for x, y, o in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("offsets").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("query_class"), b.column("class_id"), *(pa.array([g[i] for g in got], t) for i, t in ((1, pa.int32()), (0, pa.float64()), (2, pa.int64())))], names=["query_class", "class_id", "offset", "error", "overlap"])

    matches = pairs.select("query_class", "class_id", "offsets", "a", "b").mapInArrow(run, "query_class long, class_id long, offset int, error double, overlap long")
    return members, matches.where(f"error <= {MOST_ERROR} and overlap >= {LEAST}")


def search(media: DataFrame, id_col: str, samples_col: str, every: int = 50, render: bool = False) -> DataFrame:
    """(id, class_id, n_frames, fingerprint_crc32, is_query, n_matches, best_class, best_offset, best_error) of every row.

    Rows that are no queries have null in the last four columns; a query's copies are its class, not matches.
    """
    members, matches = align(media, id_col, samples_col, every, render)
    best = matches.groupBy("query_class").agg(F.count("*").alias("n_matches"), F.min(F.struct("error", "class_id", "offset")).alias("b"))
    rows = members.join(best.withColumnRenamed("query_class", "class_id"), "class_id", "left")
    asked = F.col("is_query")
    return rows.select("id", "class_id", "n_frames", "fingerprint_crc32", "is_query", F.when(asked, F.coalesce("n_matches", F.lit(0))).alias("n_matches"), F.when(asked, F.col("b.class_id")).alias("best_class"), F.when(asked, F.col("b.offset")).alias("best_offset"), F.when(asked, F.col("b.error")).alias("best_error"))
