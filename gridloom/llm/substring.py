"""Substring dedup by difference-cover anchors.

Any two equal passages of WINDOW words share, at some common shift below PERIOD, a position that
lies in the cover modulo PERIOD on both sides. So only windows of WINDOW - PERIOD + 1 words at cover
positions are hashed over the whole corpus; where such an anchor recurs, the windows of full length
around it are hashed and counted, which extends the match to its exact ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, partitions, release, small_text, text_groups

WINDOW = 35
PERIOD = 21
#: A perfect difference set modulo 21: every shift is a difference of two of its members.
COVER = (0, 1, 4, 14, 16)
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes of each word: shape (n, 2)."""
    h = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([h(w) for w in words]), dtype="<u8").reshape(-1, 2)


def window_hashes(h: np.ndarray, at: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of the `length` words from each position."""
    x = np.zeros(len(at), np.uint64)
    for t in range(length):
        x = x * base + h[at + t]
    x = (x ^ (x >> np.uint64(32))) * _B1
    return x ^ (x >> np.uint64(29))


def _spread(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    x = (doc.astype(np.uint64) * _B1) ^ (at.astype(np.uint64) * _B2)
    return x ^ (x >> np.uint64(31))


def _emit(keys: list[np.ndarray], doc: np.ndarray, at: np.ndarray, names: list[str]):
    """Rows for the count of equal keys. What recurs within this part is known already: one row of it
    stands for the rest (n = 2), the others go along under keys of their own (n = 0)."""
    if not len(doc):
        return
    order = np.lexsort(keys[::-1])
    keys, doc, at = [k[order] for k in keys], doc[order], at[order]
    new = np.ones(len(doc), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    run = np.cumsum(new) - 1
    again = np.bincount(run)[run] > 1
    n = np.where(new, np.where(again, 2, 1), 0).astype(np.int8)
    # certain rows only need to arrive somewhere: neighbours share a key, and so compress
    keys = [np.where(n == 0, _spread(doc, at >> 10) if i == 0 else np.uint64(0), k) for i, k in enumerate(keys)]
    order = np.lexsort((at, doc, n == 0))
    keys, doc, at, n = [k[order] for k in keys], doc[order], at[order], n[order]
    for lo in range(0, len(doc), 1 << 16):
        s = slice(lo, lo + (1 << 16))
        yield pa.RecordBatch.from_arrays([*(pa.array(k[s].view(np.int64)) for k in keys), pa.array(doc[s]), pa.array(at[s].astype(np.int32)), pa.array(n[s])], names=[*names, "row", "at", "n"])


def _recurring(df: DataFrame, names: list[str]) -> DataFrame:
    """(row, at) whose keys occur at two places or more; rows come from _emit, spread by key."""

    def run(batches):
        kept = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [np.stack([b.column(x).to_numpy() for x in names], axis=1), b.column("row").to_numpy(), b.column("at").to_numpy(), b.column("n").to_numpy()]
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols)]
            new = np.ones(len(cols[1]), bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]).any(axis=1)
            runs = np.cumsum(new) - 1
            last = int(np.searchsorted(runs, runs[-1]))
            # of a run that goes on, its first rows can be told from its count so far: keep two at most
            yield from told(cols, runs, last)
            tail = [x[last:] for x in cols]
            kept = tail if len(tail[1]) <= 2 else (yield from shortened(tail))
        if kept is not None:
            yield from told(kept, np.zeros(len(kept[1]), np.int64), len(kept[1]))

    def shortened(tail):
        """The open run without the rows that are certain: all of them once it counts two."""
        if tail[3].sum(dtype=np.int64) < 2:
            return tail
        yield from rows(tail[1][:-1], tail[2][:-1])
        return [tail[0][-1:], tail[1][-1:], tail[2][-1:], np.full(1, 2, np.int8)]

    def told(cols, runs, last):
        _, doc, at, n = cols
        if last:
            total = np.bincount(runs[:last], weights=n[:last])[runs[:last]]
            hit = (total >= 2) | (n[:last] == 0)
            yield from rows(doc[:last][hit], at[:last][hit])

    def rows(doc, at):
        if len(doc):
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at)], names=["row", "at"])

    return df.repartition(partitions(df.sparkSession), *names).sortWithinPartitions(*names).mapInArrow(run, "row long, at int")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(doc_id, other, copies, n_words, text, starts array<int>) of the documents without and with recurring windows.

    Words are maximal runs without ASCII white space, compared unchanged; a window is `window`
    consecutive words of one document, and it recurs if its word sequence also starts anywhere else,
    overlapping or in the same document included. Null text has no words; a text shorter than a window
    has no windows. Rows equal in id, text and the carried columns are one row here, with copies.
    other is a struct of the carried columns. In the first table starts is null, in the second it may be.
    """
    if window <= PERIOD:
        raise ValueError(f"a window needs more than {PERIOD} words")
    spark, anchor = docs.sparkSession, window - PERIOD + 1
    filler = "_" * (1 + max(map(len, carry), default=0))  # a struct needs a column; its name clashes with none
    other = F.struct(F.lit(0).alias(filler), *[docs[c] for c in carry])
    keyed = docs.select(docs[id_col].cast("long").alias("doc_id"), small_text(docs[text_col]).alias("text"), other.alias("other"))
    # row finds anchors; rows that share one by chance differ in row2 and only share candidate places
    keyed = keyed.withColumns({"row": F.xxhash64("doc_id", "text", "other"), "row2": F.xxhash64(F.lit(1), "other", "text", "doc_id")})
    cover = np.array(COVER)

    def anchors(batches):
        for b in text_groups(batches):
            hs, ds, at = [], [], []
            for row, text in zip(b.column("row").to_pylist(), b.column("text").to_pylist()):
                w = words_of(text)
                if len(w) < window:
                    continue
                p = (np.arange(0, len(w), PERIOD)[:, None] + cover).ravel()
                p = p[p <= len(w) - anchor]
                hs.append(window_hashes(word_hashes(w)[:, 0], p, anchor, _B1))
                ds.append(np.full(len(p), row, np.int64))
                at.append(p)
            if hs:
                yield from _emit([np.concatenate(hs)], np.concatenate(ds), np.concatenate(at), ["h"])

    def shared_anchors() -> DataFrame:
        found = _recurring(keyed.select("row", "text").mapInArrow(anchors, "h long, row long, at int, n byte"), ["h"])
        return materialize(found.groupBy("row").agg(F.sort_array(F.collect_set("at")).alias("anchors")), "anchors")

    def candidates(batches):
        for b in text_groups(batches):
            texts, at = b.column("text").to_pylist(), b.column("anchors")
            n, starts = [], []
            for i, text in enumerate(texts):
                w = words_of(text)
                n.append(len(w))
                if at[i].is_valid and len(w) >= window:
                    p = at[i].values.to_numpy().astype(np.int64)
                    p = p[p < len(w)]
                    s = np.zeros(len(w) + 1, np.int64)  # starts whose window holds the anchor
                    np.add.at(s, np.maximum(p - (PERIOD - 1), 0), 1)
                    np.add.at(s, p + 1, -1)
                    starts.append(np.flatnonzero(np.cumsum(s)[: len(w) - window + 1]).astype(np.int32))
                else:
                    starts.append(None)
            same = [b.column(c) for c in ("doc_id", "other", "row", "copies", "text")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(n, pa.int32()), pa.array(starts, pa.list_(pa.int32()))], names=["doc_id", "other", "row", "copies", "text", "n_words", "near"])

    def candidate_windows(shared: DataFrame) -> DataFrame:
        """The rows, each once, under new numbers: from here on row is unique and not a hash."""
        once = keyed.groupBy("row", "row2").agg(F.first("doc_id").alias("doc_id"), F.first("other").alias("other"), F.first("text").alias("text"), F.count("*").alias("copies"))
        keys = keyed.select("row", "row2").distinct().join(shared, "row")
        rows = once.join(keys, ["row", "row2"], "left").withColumn("row", F.monotonically_increasing_id())
        rows = rows.select("doc_id", "other", "row", "copies", "text", "anchors")
        schema = f"doc_id long, other {dict(keyed.dtypes)['other']}, row long, copies long, text string, n_words int, near array<int>"
        return materialize(rows.mapInArrow(candidates, schema), "windows")

    shared = shared_anchors()
    release(spark)  # the anchors' shuffle is over
    held = candidate_windows(shared)
    drop_table(shared)
    release(spark)

    def windows(batches):
        for b in text_groups(batches):
            hs, gs, ds, at = [], [], [], []
            for row, text, near in zip(b.column("row").to_pylist(), b.column("text").to_pylist(), b.column("near")):
                h, s = word_hashes(words_of(text)), near.values.to_numpy().astype(np.int64)
                hs.append(window_hashes(h[:, 0], s, window, _B1))
                gs.append(window_hashes(h[:, 1], s, window, _B2) >> np.uint64(32))  # 96 bits tell windows apart
                ds.append(np.full(len(s), row, np.int64))
                at.append(s)
            if hs:
                yield from _emit([np.concatenate(hs), np.concatenate(gs)], np.concatenate(ds), np.concatenate(at), ["h", "g"])

    suspect, columns = held.where("near is not null"), ["doc_id", "other", "copies", "n_words", "text"]
    again = _recurring(suspect.select("row", "text", "near").mapInArrow(windows, "h long, g long, row long, at int, n byte"), ["h", "g"])
    # each window of a row with copies recurs in the copies
    again = again.union(suspect.where("copies > 1").select("row", F.explode("near").alias("at")))
    lists = materialize(again.groupBy("row").agg(F.sort_array(F.collect_set("at")).alias("starts")), "starts")
    clean = held.where("near is null").select(*columns, F.lit(None).cast("array<int>").alias("starts"))
    return clean, suspect.select("row", *columns).join(lists, "row", "left").select(*columns, "starts")


def remove_spans(spans: DataFrame, window: int = WINDOW, as_is: bool = False) -> DataFrame:
    """(doc_id, other, n_words, n_removed, kept): kept is what is left, joined by one space.

    With as_is a text that loses nothing keeps its own white space.
    """
    names = ["doc_id", "other", "copies", "n_words", "n_removed", "kept"]

    def run(batches):
        for b in text_groups(batches):
            kept, removed = [], []
            for text, starts in zip(b.column("text").to_pylist(), b.column("starts")):
                w, gone = words_of(text), 0
                if starts.is_valid and len(w) >= window:
                    s = starts.values.to_numpy().astype(np.int64)
                    c = np.zeros(len(w) + 1, np.int64)
                    c[s] += 1
                    c[s + window] -= 1
                    cut = np.cumsum(c)[:-1] > 0
                    gone = int(cut.sum())
                    w = [x for x, g in zip(w, cut.tolist()) if not g]
                removed.append(gone)
                kept.append(text if as_is and not gone else b" ".join(w).decode("utf-8", "surrogatepass"))
            same = [b.column(c) for c in names[:3]]
            yield pa.RecordBatch.from_arrays([*same, b.column("n_words").cast(pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, b.column("text").type)], names=names)

    schema = f"doc_id long, other {dict(spans.dtypes)['other']}, copies long, n_words long, n_removed long, kept string"
    done = spans.select("doc_id", "other", "copies", "n_words", "text", "starts").mapInArrow(run, schema)
    return done.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("_", "copies")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: tuple[str, ...] = (), as_is: bool = False) -> DataFrame:
    """(doc_id, other, n_words, n_removed, kept) of every row: each word in a recurring window is removed.

    Every occurrence goes, the first one included; windows are judged on the input. An empty table
    gives no rows. See repeated_spans for words, nulls, repeated rows and other.
    """
    clean, suspect = repeated_spans(docs, id_col, text_col, window, carry)
    return remove_spans(clean, window, as_is).union(remove_spans(suspect, window, as_is))
