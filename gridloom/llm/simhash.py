"""SimHash near-duplicate classes over pigeonhole blocks.

Exact mode (simhash_classes): a fingerprint of 64 bits is split into m blocks. Two fingerprints that
differ in at most d bits agree in at least m - d blocks, so they share one of the C(m, d) ways to
choose m - d blocks. Fingerprints meet on these choices; the Hamming distance is then verified.

Similarity mode (similar_classes): d = 4 of 64 bits is far stricter than a shingle similarity of
0.8, where one bit in seven differs. Longer fingerprints are split into so many blocks that a pair of
that similarity shares two blocks near each other with probability block_recall(). Pairs that meet on
such two blocks and are near on VERIFY_BITS are candidates only; rows link by the exact Jaccard
similarity of their shingle sets.
"""

from __future__ import annotations

import math
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, partitions, small_text, text_groups
from .components import connected_components

SEED = 42
#: Fingerprints of one key that are compared in one task; larger keys are dealt out as pairs of parts.
PART = 2048
#: Runs up to this size emit the verified pairs themselves, larger ones a spanning forest.
SMALL_RUN = 16
#: Broadcast the sizes of hot keys up to this many rows (24 bytes each); join them otherwise.
HOT_BROADCAST = 100_000
#: One node in so many (by hash) is counted to find the keys that need parts.
SAMPLED = 64
#: Similarity mode: one key in so many connects what is dense before the others add links.
FIRST = 16
#: Similarity mode, the same for tables of every size: 64-bit words of a fingerprint, bits of a block, and
#: how many of the blocks after it (in a circle) each block makes keys with. 49 blocks and 147 keys of 18
#: bits: a pair of similarity 0.8 shares a key with a chance of 0.99; two unrelated texts share one with a
#: chance of 1 in 1800. For far more than 10^8 distinct texts longer blocks keep those meetings few; they need more words.
WORDS, BLOCK, REACH = 7, 9, 3
VERIFY_BITS = 128
#: Standard deviations of the Hamming distance that a candidate may lie above the mean of a pair just similar.
ROOM = 3.5
#: Links for each node, about: only how many files a table of links gets follows from it.
EDGES = 4
#: Shingles of one part of a large component (8 bytes each).
PART_SHINGLES = 1 << 19


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each bit is set, for rows of 64-bit words (n, w): shape (w, 64). Carry-save adders."""
    total, weight, rows = np.zeros((h.shape[1], 64), np.int64), 1, h
    while len(rows):
        carries = []
        while len(rows) >= 3:
            n = len(rows) // 3
            a, b, c = rows[:n], rows[n : 2 * n], rows[2 * n : 3 * n]
            x = a ^ b
            carries.append((a & b) | (c & x))
            rows = np.concatenate([x ^ c, rows[3 * n :]])
        total += weight * np.unpackbits(rows.view(np.uint8).reshape(len(rows), -1, 8), axis=2, bitorder="little").reshape(len(rows), -1, 64).sum(axis=0, dtype=np.int64)
        rows = np.concatenate(carries) if carries else rows[:0]
        weight *= 2
    return total


def _more_words(h: np.ndarray, words: int) -> np.ndarray:
    """(n, words): the hash, then further hashes mixed from it (splitmix64's finaliser)."""
    out = np.empty((len(h), words), np.uint64)
    out[:, 0] = h
    for i in range(1, words):
        x = h + np.uint64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, i] = x ^ (x >> np.uint64(31))
    return out


def shingle_hashes(text: str | None, shingle: int, step: int = 1 << 16):
    """Hashes of the word shingles in order, repeats included, `step` at a time; none for a text without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    joined, h = b" ".join(found), xxhash.xxh64_intdigest
    n = max(1, len(found) - shingle + 1)
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        s, e = starts[lo:hi].tolist(), ends[np.minimum(np.arange(lo, hi) + shingle - 1, len(found) - 1)].tolist()
        yield np.array([h(joined[i:j], SEED) for i, j in zip(s, e)], dtype=np.uint64)


def _majority(parts, words: int) -> np.ndarray:
    counts, n = np.zeros((words, 64), np.int64), 0
    for h in parts:
        counts += bit_counts(_more_words(h, words))
        n += len(h)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view("<u8").reshape(words)


def simhash(text: str | None, shingle: int = 4, words: int = 1) -> np.ndarray:
    """The fingerprint of one text as 64-bit words, the lowest bits first; zero for a text without words."""
    return _majority(shingle_hashes(text, shingle, (1 << 16) // words), words)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).view(np.int64)))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, shingle)]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, words: int = 1, sets: bool = False) -> DataFrame:
    """(doc_id, f array of longs) of every row; null text counts as empty, repeated rows stay.

    sets: f counts each distinct shingle once, and (t1, t2, node) are added: hashes of the text, and of
    its shingle set.
    """
    schema = pa.schema([("doc_id", pa.int64())] + [(n, pa.int64()) for n in ("t1", "t2", "node") if sets] + [("f", pa.list_(pa.int64()))])

    def run(batches):
        for b in text_groups(batches):
            texts = b.column("text").to_pylist()
            if not texts:
                continue
            columns = [b.column("doc_id")]
            if sets:
                found = [shingle_set(t, shingle) for t in texts]
                step = (1 << 16) // words
                fs = [_majority((x[i : i + step] for i in range(0, len(x), step)), words) for x in found]
                columns += [b.column("t1"), b.column("t2"), pa.array(np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in found], np.uint64).view(np.int64))]
            else:
                fs = [simhash(t, shingle, words) for t in texts]
            yield pa.RecordBatch.from_arrays([*columns, _lists(fs)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), small_text(text_col).alias("text"))
    if sets:
        rows = _with_text_hashes(rows)
    return rows.mapInArrow(run, "doc_id long, " + "t1 long, t2 long, node long, " * sets + "f array<long>")


def _with_text_hashes(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})


def blocks_for(rows: int) -> int:
    """Blocks that keep the chance meetings per fingerprint low at this many fingerprints."""
    return 6 if rows <= 1 << 23 else 7 if rows <= 1 << 30 else 8


def masks(m: int, distance: int) -> list[int]:
    edges = [round(64 * i / m) for i in range(m + 1)]
    block = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(m)]
    return [sum(block[i] for i in c) for c in combinations(range(m), m - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def forest(node: np.ndarray, f: np.ndarray, distance: int):
    """Edges that connect what is within the distance, by search from fingerprint to fingerprint."""
    while len(node):
        front, node, f = [(node[0], f[0])], node[1:], f[1:]
        while front and len(node):
            at, x = front.pop()
            near = _distance(f, x) <= distance
            if near.any():
                yield np.full(near.sum(), at), node[near]
                front.extend(zip(node[near], f[near]))
                node, f = node[~near], f[~near]


def _pairs_in_runs(distance: int, words: int):
    names, fs = ["key", "meet"], [f"f{i}" for i in range(words)]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def edges(node: np.ndarray, f: np.ndarray, run: np.ndarray):
        """Rows sorted by run: edges of every run."""
        _, first, size = np.unique(run, return_index=True, return_counts=True)
        few = np.repeat((size <= SMALL_RUN) & (size > 1), size)
        n, g, r = node[few], f[few], run[few]
        for d in range(1, min(SMALL_RUN, int(size[size <= SMALL_RUN].max(initial=1)))):
            same = np.flatnonzero(r[d:] == r[:-d])
            same = same[_distance(g[same + d], g[same]) <= distance]
            if len(same):
                yield n[same], n[same + d]
        for i, k in zip(first[size > SMALL_RUN], size[size > SMALL_RUN]):
            yield from forest(node[i : i + k], f[i : i + k], distance)

    def out(found):
        for x, y in found:
            new = x != y
            if new.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[new], pa.int64()), pa.array(y[new], pa.int64())], schema=schema)

    def run(batches):
        kept = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = (np.stack([b.column(x).to_numpy() for x in names], axis=1).astype(np.int64), b.column("node").to_numpy(), np.stack([b.column(x).to_numpy() for x in fs], axis=1).view(np.uint64))
            if kept:
                rows = tuple(np.concatenate(x) for x in zip(kept, rows))
            ids = np.concatenate([[0], np.cumsum((rows[0][1:] != rows[0][:-1]).any(axis=1))])
            last = int(np.searchsorted(ids, ids[-1]))  # the last run may go on in the next batch
            kept = tuple(x[last:] for x in rows)
            yield from out(edges(rows[1][:last], rows[2][:last], ids[:last]))
        if kept:
            yield from out(edges(kept[1], kept[2], np.zeros(len(kept[1]), np.int64)))

    return run


def close_pairs(nodes: DataFrame, keys: list[Column], verify: list[Column], distance: int, label: str = "node") -> DataFrame:
    """(a, b): enough links between nodes to connect all that share a key and are within the distance.

    nodes has one row per distinct fingerprint (column node). With another label, which nodes known to
    be connected share, the links are those between labels. A key with many of them is cut into
    parts that meet two by two, each meeting in a task of its own, so no key is gathered whole and no
    link is lost; how many parts is estimated from one node in SAMPLED. Large meetings emit a spanning
    forest instead of pairs, from their smallest node on, so that meetings of the same nodes emit the
    same links.
    """
    fs = [f"f{i}" for i in range(len(verify))]
    rows = nodes.select("node", *[v.alias(x) for v, x in zip(verify, fs)], F.col(label).alias("label"), F.posexplode(F.array(*keys)).alias("c", "k"))
    rows = rows.select("node", "label", *fs, F.xxhash64("k", "c").alias("key"))
    some = rows.where(F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(SAMPLED)) == 0).groupBy("key").count().where(F.col("count") * SAMPLED > PART // 2)
    hot = materialize(some.select("key", F.ceil(F.col("count") * SAMPLED / PART).cast("int").alias("parts")), "hot")
    n_hot = hot.count()
    if n_hot:
        rows = rows.join(F.broadcast(hot) if n_hot <= HOT_BROADCAST else hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        rows = rows.withColumn("i", F.pmod(F.xxhash64("node"), "parts")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.withColumn("meet", F.shiftleft(F.least("i", "j").cast("long"), 32) + F.greatest("i", "j"))
    else:
        rows = rows.withColumn("meet", F.lit(0).cast("long"))
    dealt = rows.select("key", "meet", F.col("label").alias("node"), *fs).repartition(partitions(nodes.sparkSession), "key", "meet").sortWithinPartitions("key", "meet", "node")
    return dealt.mapInArrow(_pairs_in_runs(distance, len(fs)), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _linked(nodes: DataFrame, keys: list[Column], verify: list[Column], distance: int) -> DataFrame:
    """nodes, columns node and t, with comp: the component over all links of close_pairs(); only linked nodes.

    A few keys first: what they connect gets one label, and the other keys only add links between
    labels. So a dense group does not emit its links once for each key.
    """
    n = nodes.count()
    first = connected_components(close_pairs(nodes, keys[::FIRST], verify, distance), EDGES * n)
    labelled = nodes.join(first, "node", "left").withColumns({"label": F.coalesce("root", "node"), "linked": F.col("root").isNotNull()})
    labelled = materialize(labelled.drop("root", "rep"), "labelled", n)
    second = connected_components(close_pairs(labelled, [k for i, k in enumerate(keys) if i % FIRST], verify, distance, "label"), EDGES * n)
    second = materialize(second.select(F.col("node").alias("label"), F.struct("root").alias("r")), "labels", n)
    rows = labelled.join(second, "label", "left").where("linked or r is not null")
    out = materialize(rows.select("node", "t", F.coalesce("r.root", "label").alias("comp")), "linked", n)
    drop_table(labelled)
    drop_table(second)
    return out


def _classes(fps: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """fps (doc_id, node, ...) with component_id: the smallest doc_id reachable over links between nodes (node, rep)."""
    n = nodes.count()
    roots = materialize(connected_components(links, EDGES * n), "roots", n)
    ids = materialize(roots.join(nodes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("component_id")), "ids", n)
    named = roots.join(ids, "root").select("node", F.struct("component_id").alias("c"))
    alone = F.when(F.col("c").isNull(), F.col("rep")).otherwise(F.col("c.component_id"))
    of = materialize(nodes.select("node", "rep").join(named, "node", "left").select("node", alone.alias("component_id")), "classes", n)
    drop_table(roots)
    drop_table(ids)
    return fps.join(of, "node")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp long, component_id) of every row of docs.

    Two rows link when their fingerprints differ in at most `distance` bits; component_id is the
    smallest id reachable over links. Equal texts, repeated rows and texts without words (fingerprint
    0) link like any others. A null id is kept; its row gets the component's smallest id that is not
    null. An empty table gives no rows; other columns of docs are not read.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle).select("doc_id", F.col("f")[0].alias("node")), "fingerprints")
    nodes = materialize(fps.groupBy("node").agg(F.min("doc_id").alias("rep")), "nodes", fps.count())
    choices = masks(blocks_for(nodes.count()), distance)
    links = close_pairs(nodes, [F.col("node").bitwiseAND(F.lit(_signed(x)).cast("long")) for x in choices], [F.col("node")], distance)
    return _classes(fps, nodes, links).select("doc_id", F.col("node").alias("fp"), "component_id")


def bit_error(similarity: float) -> float:
    """Share of bits in which SimHashes of two equally large shingle sets of this Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def set_links(node: np.ndarray, size: np.ndarray, flat: np.ndarray, similarity: float):
    """Edges that connect the sets (flat, one after the other) of this Jaccard similarity or more, by exact counts."""
    share = Fraction(similarity).limit_denominator(1000)
    ends, size = np.cumsum(size), size.astype(np.int64)
    token = np.unique(flat, return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    holder, of = np.repeat(np.arange(len(node)), size)[order], token[order]
    start = np.searchsorted(of, np.arange(len(of) + 1))
    left = np.ones(len(node), bool)
    todo = indexed = len(node)
    for first in range(len(node)):
        if not left[first]:
            continue
        left[first], todo, front = False, todo - 1, [first]
        while front and todo:
            x = front.pop()
            if todo < indexed // 2:  # what is reached needs no counts any more
                keep = left[holder]
                holder, of, indexed = holder[keep], of[keep], todo
                start = np.searchsorted(of, np.arange(len(token) + 1))
            t = token[ends[x] - size[x] : ends[x]]
            n = start[t + 1] - start[t]
            at = np.repeat(start[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared = np.bincount(holder[at], minlength=len(node))
            near = np.flatnonzero(left & (shared > 0) & (shared * share.denominator >= share.numerator * (size + size[x] - shared)))
            if len(near):
                yield np.full(len(near), node[x]), node[near]
                left[near], todo = False, todo - len(near)
                front.extend(near.tolist())


def _links_in_runs(similarity: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def out(table: pa.Table):
        if table.num_rows < 2:
            return
        node, s = table.column("node").to_numpy(), table.column("s").combine_chunks()
        size, flat = np.diff(s.offsets.to_numpy()), s.flatten().to_numpy()
        keys = np.stack([table.column(x).to_numpy() for x in ("comp", "kind", "lo", "hi")], axis=1)
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]]))
        at = np.concatenate([[0], np.cumsum(size)])
        for i, j in zip(first[:-1], first[1:]):
            for x, y in set_links(node[i:j], size[i:j], flat[at[i] : at[j]], similarity):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], schema=schema)

    def run(batches):
        kept = []
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(x).to_numpy() for x in ("comp", "kind", "lo", "hi")], axis=1)
            last = b.num_rows - int(np.argmax(np.append((keys[::-1] != keys[-1]).any(axis=1), True)))  # the last run may go on
            before = [kept[0].column(x)[0].as_py() for x in ("comp", "kind", "lo", "hi")] if kept else None
            if last or (kept and before != keys[0].tolist()):
                yield from out(pa.Table.from_batches([*kept, b.slice(0, last)]))
                kept = []
            kept.append(b.slice(last))
        if kept:
            yield from out(pa.Table.from_batches(kept))

    return run


def similar_sets(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that connect all nodes of one comp whose sets s have this Jaccard similarity; sets: (comp, node, s).

    A comp that fits one meeting is searched whole. A larger one is dealt into parts, twice by
    different hashes, which joins what is dense; then the nodes outside its largest class meet all
    others, part by part. So each pair of classes is searched and no comp is gathered in one task.
    """
    spark = sets.sparkSession

    def parts(n: Column, shingles: Column) -> Column:
        return F.ceil(F.greatest(n / PART, shingles / PART_SHINGLES)).cast("int")

    def meet(rows: DataFrame) -> DataFrame:
        keys = ["comp", "kind", "lo", "hi"]
        rows = rows.select("comp", *[F.col(k).cast("int").alias(k) for k in keys[1:]], "node", "s")
        return rows.repartition(partitions(spark), *keys).sortWithinPartitions(*keys).mapInArrow(_links_in_runs(similarity), "a long, b long")

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= HOT_BROADCAST else df

    large = sets.groupBy("comp").agg(parts(F.count("*"), F.sum(F.size("s"))).alias("parts")).where("parts > 1")
    large = materialize(large, "large")
    dealt = sets.join(small(large), "comp", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("kind", F.explode(F.when(F.col("parts") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    dealt = dealt.withColumn("lo", F.pmod(F.xxhash64("node", "kind"), "parts")).withColumn("hi", F.col("lo"))
    links = materialize(meet(dealt), "links")
    if not large.count():
        return links
    rows = sets.join(small(large.select("comp")), "comp").join(connected_components(links), "node", "left").withColumn("class", F.coalesce("root", "node"))
    rows = materialize(rows.select("comp", "node", "s", "class"), "large_sets")
    per = rows.groupBy("comp", "class").agg(F.count("*").alias("n"), F.sum(F.size("s")).alias("m"))
    most = per.groupBy("comp").agg(F.max(F.struct("n", "class", "m")).alias("top"), F.sum("n").alias("n"), F.sum("m").alias("m")).where("n > top.n")
    most = most.select("comp", F.col("top.class").alias("top"), parts(F.col("top.n"), F.col("top.m")).alias("p"), parts(F.col("n") - F.col("top.n"), F.col("m") - F.col("top.m")).alias("q"))
    rows = rows.join(small(materialize(most, "most")), "comp").withColumn("inside", F.col("class") == F.col("top"))
    rows = rows.withColumn("i", F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("p")).otherwise(F.col("q"))))
    p, q = (F.sequence(F.lit(0).cast("long"), F.col(x).cast("long") - 1) for x in ("p", "q"))
    main = F.transform(F.when(F.col("inside"), q).otherwise(p), lambda j: F.struct(F.lit(2).alias("kind"), F.when(F.col("inside"), F.col("i")).otherwise(j).alias("lo"), F.when(F.col("inside"), j).otherwise(F.col("i")).alias("hi")))
    rest = F.transform(q, lambda j: F.struct(F.lit(3).alias("kind"), F.least(F.col("i"), j).alias("lo"), F.greatest(F.col("i"), j).alias("hi")))
    rows = rows.withColumn("to", F.explode(F.when(F.col("inside"), main).otherwise(F.concat(main, rest))))
    return links.union(meet(rows.select("comp", "to.*", "node", "s")))


def block_recall(similarity: float, blocks: int, bits: int, reach: int) -> float:
    """The chance that two texts of this similarity share two blocks at most `reach` apart in the circle."""
    q = (1 - bit_error(similarity)) ** bits
    none = (1 - q) ** blocks
    for k in range(1, blocks):  # k blocks in common, any two of them further apart
        free = blocks - k * reach
        if free < k:
            break
        none += blocks / free * math.comb(free, k) * q**k * (1 - q) ** (blocks - k)
    return 1 - none


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, words: int = WORDS, block: int = BLOCK, reach: int = REACH) -> DataFrame:
    """(doc_id, component_id) of every row; rows link at a Jaccard similarity of their shingle sets of `similarity` or more.

    SimHash blocks only find what may link: see WORDS, BLOCK, REACH and block_recall(). ROOM standard
    deviations are added to the Hamming distance expected. The texts of the components of these
    candidates are read once more and searched by the exact similarity. Nulls, empty texts and repeated
    rows: as for simhash_classes.
    """
    return _similar(docs, id_col, text_col, shingle, similarity, words, block, reach).select("doc_id", "component_id")


def _similar(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, words: int = WORDS, block: int = BLOCK, reach: int = REACH) -> DataFrame:
    """similar_classes with t1, a hash of the text."""
    p = bit_error(similarity)
    most = math.floor(VERIFY_BITS * p + ROOM * math.sqrt(VERIFY_BITS * p * (1 - p)))
    fps = materialize(fingerprints(docs, id_col, text_col, shingle, words, sets=True), "fingerprints")
    nodes = materialize(fps.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min(F.struct("t1", "t2")).alias("t"), F.max("f").alias("f")), "nodes", fps.count())
    each = [F.shiftrightunsigned(F.col("f")[w], b * block).bitwiseAND(F.lit((1 << block) - 1).cast("long")) for w in range(words) for b in range(64 // block)]
    keys = [F.shiftleft(x, block).bitwiseOR(each[(i + d) % len(each)]) for d in range(1, reach + 1) for i, x in enumerate(each)]
    asked = _linked(nodes, keys, [F.col("f")[i] for i in range(VERIFY_BITS // 64)], most).select("node", "comp", "t.t1", "t.t2")
    texts = _with_text_hashes(docs.select(small_text(text_col).alias("text"))).join(asked, ["t1", "t2"])
    texts = texts.groupBy("t1", "t2", "comp", "node").agg(F.first("text").alias("text"))  # of equal texts one

    def run(batches):
        for b in text_groups(batches):
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("comp"), b.column("node"), _lists([shingle_set(t, shingle) for t in b.column("text").to_pylist()])], names=["comp", "node", "s"])

    sets = materialize(texts.select("comp", "node", "text").mapInArrow(run, "comp long, node long, s array<long>"), "sets")
    return _classes(fps.select("doc_id", "t1", "node"), nodes, similar_sets(sets, similarity)).select("doc_id", "t1", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document left of each class of similar_classes: that with the class's smallest id.

    Of rows that share this id, all stay: ids name documents. Rows with a null id stay only in
    classes without any id.
    """
    classes = _similar(docs, id_col, text_col, shingle, similarity).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # without an id the text tells which row it is
    kept = classes.select(F.col("doc_id").alias("kept_id"), F.when(F.col("doc_id").isNull(), F.col("t1")).alias("kept_text")).distinct()
    text = F.when(docs[id_col].isNull(), F.xxhash64(small_text(docs[text_col])))
    return docs.join(kept, docs[id_col].eqNullSafe(kept["kept_id"]) & text.eqNullSafe(kept["kept_text"]), "left_semi")
