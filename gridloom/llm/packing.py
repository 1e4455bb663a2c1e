"""Best-fit packing by patterns: few-document length patterns, repeat counts by non-negative least squares.

Only the histogram of lengths (at most max_len rows) reaches the driver. There patterns of one to
three lengths that fill a sequence exactly are enumerated, repeat counts are fitted to the histogram
by NNLS and rounded, and what is left is packed best-fit decreasing. Counts are rounded to the nearest
number, and once more with every pattern of a positive count used at least once while lengths last; the
plan of fewer sequences stands. The plan says which ranks of each
length go where; ranks within a length are counted in a distributed way, salted by document.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_text, text_groups
from .tokens import word_tokenizer

MAX_LEN = 2048
#: Rows of one length that one task numbers, about.
RANKED = 100_000


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, max_len: int = MAX_LEN, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids binary]) of every row: its ids with the end id, cut.

    A document of at most max_len ids is one piece. Of a longer one the first piece is the shorter
    one, all others are full. ids are little-endian unsigned 32-bit integers. Null text is empty, so
    it is the end id alone; nulls in doc_id and repeated rows are kept.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        encode = word_tokenizer(vocabulary).encode
        for b in text_groups(batches, most=2 << 20):
            out: list[list] = [[], [], [], [], [], []]
            for doc, ids in zip(b.column("doc_id").to_pylist(), encode(b.column("text").to_pylist())):
                ids += end
                n, at = len(ids) // 4, 0
                size, k = (n - 1) % max_len + 1, 0
                while at < n:
                    part = ids[4 * at : 4 * (at + size)]
                    for x, v in zip(out, (doc, k, at, size, zlib.crc32(part), part if with_ids else None)):
                        x.append(v)
                    at, k, size = at + size, k + 1, max_len
            cols = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(cols[: 5 + with_ids], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), small_text(text_col).alias("text")).mapInArrow(run, schema)


def patterns(lengths: np.ndarray, max_len: int) -> np.ndarray:
    """Ascending triples of present lengths (0: none) that sum to max_len exactly: shape (p, 3)."""
    present = np.zeros(max_len + 1, bool)
    present[lengths] = present[0] = True
    out = []
    for a in np.flatnonzero(present[: max_len // 3 + 1]):
        b = np.arange(a, (max_len - a) // 2 + 1)
        b = b[present[b] & present[max_len - a - b] & ((b > 0) | (a == 0))]
        out.append(np.stack([np.full(len(b), a), b, max_len - a - b], axis=1))
    return np.concatenate(out)


def nnls_counts(p: np.ndarray, hist: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that minimises |A x - hist|^2 weighted by length, A the patterns' lengths (accelerated projected gradient)."""
    weight = np.sqrt(np.arange(len(hist)) / (len(hist) - 1.0))
    weight[0] = 0

    def forward(x):
        return sum(np.bincount(p[:, i], weights=x, minlength=len(hist)) for i in range(3))

    def back(r):
        return r[p[:, 0]] + r[p[:, 1]] + r[p[:, 2]]

    w2 = weight**2
    v = np.ones(len(p))
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = back(w2 * forward(v))
        size = np.linalg.norm(v)
        v /= size
    x = y = np.zeros(len(p))
    t = 1.0
    for _ in range(rounds):
        after = np.maximum(0, y - back(w2 * (forward(y) - hist)) / (1.02 * size))
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = after + (t - 1) / t_after * (after - x)
        x, t = after, t_after
    return x


def _best_fit(left: dict[int, int], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: (lengths of a sequence, how many such sequences)."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            space = min((r for r in room if r >= length and room[r]), default=None)
            if space is None:
                per = min(max_len // length, n)
                k = n // per
                bins = room[max_len - per * length]
                bins[(length,) * per] = bins.get((length,) * per, 0) + k
                n -= per * k
                continue
            held, k = next(iter(room[space].items()))
            take = min(k, n)
            if take == k:
                del room[space][held]
            else:
                room[space][held] = k - take
            bins, now = room[space - length], (*held, length)
            bins[now] = bins.get(now, 0) + take
            n -= take
    return [(held, k) for bins in room.values() for held, k in bins.items()]


def plan_packing(hist: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats): sequences that hold every length of the histogram as often as it occurs."""
    left = {k: v for k, v in hist.items() if v}
    plan = [((max_len,), left.pop(max_len))] if max_len in left else []
    if left:
        counts = np.zeros(max_len + 1)
        counts[list(left)] = list(left.values())
        p = patterns(np.array(sorted(left)), max_len)
        if len(p):
            x = nnls_counts(p, counts)
            plans = [_rounded(p, x, left, max_len, least) for least in (1e-9, 0.5)]
            return plan + min(plans, key=lambda y: sum(n for _, n in y))  # of equals that with more patterns
        plan += _best_fit(left, max_len)
    return plan


def _rounded(p: np.ndarray, x: np.ndarray, hist: dict[int, int], max_len: int, least: float) -> list[tuple[tuple[int, ...], int]]:
    """Patterns in order of their counts x, those of at least `least` once or more as far as lengths last; the rest best-fit."""
    left, plan, order = dict(hist), [], np.argsort(-x, kind="stable")
    order = order[: np.count_nonzero(x >= least)]
    for triple, n in zip(p[order].tolist(), np.maximum(1, np.floor(x[order] + 0.5)).astype(np.int64).tolist()):
        held = tuple(a for a in triple if a)[::-1]
        for a in set(held):
            n = min(n, left.get(a, 0) // held.count(a))
        if n:
            plan.append((held, n))
            for a in held:
                left[a] -= n
    return plan + _best_fit({k: v for k, v in left.items() if v}, max_len)


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ranks of each length: key (length, first rank), first rank, first sequence, offset."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for held, n in plan:
        at = 0
        for length in held:
            rows.append((length, used[length], base, at))
            used[length] += n
            at += length
        base += n
    r = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return (r[:, 0] << 44) | r[:, 1], r[:, 1], r[:, 2], r[:, 3]


def pack(found: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """found (doc_id, piece, length, ...) with sequence_id and offset of each row.

    found should be a written table: it is read three times. Sequences have no gaps and at most
    max_len tokens. An empty table gives no rows.
    """
    hist = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # max_len rows at most
    if any(not 0 < k <= max_len for k in hist):
        raise ValueError(f"lengths must lie in 1..{max_len}")
    salts = max(64, sum(hist.values()) // RANKED)
    key, first, base, at = _slots(plan_packing(hist, max_len))
    names = list(found.columns)
    # the columns of found travel in a struct, so none of ours can clash with them
    rows = found.select(F.struct(*names).alias("row"), "length", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int").alias("salt"))
    sizes = rows.groupBy("length", "salt").count()
    before = sizes.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    order = [F.col("row")[c] for c in ("doc_id", "piece", "ids_crc32") if c in names]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)))
    rows = rows.join(before, ["length", "salt"]).select("row", "length", (F.col("before") + F.col("rank") - 1).cast("long").alias("rank"))

    def run(batches):
        for b in batches:
            rank = b.column("rank").to_numpy()
            i = np.searchsorted(key, (b.column("length").to_numpy() << 44) | rank, side="right") - 1
            keep = [b.column("row").field(n) for n in range(len(names))]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(base[i] + rank - first[i], pa.int64()), pa.array(at[i], pa.int64())], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in found.dtypes) + ", sequence_id long, offset long"
    return rows.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, max_len: int = MAX_LEN, with_ids: bool = False) -> DataFrame:
    """Every piece of every row with its place: pieces() written to the shared folder, then pack()."""
    return pack(materialize(pieces(docs, vocabulary, id_col, text_col, end_id, max_len, with_ids), "pieces"), max_len)
