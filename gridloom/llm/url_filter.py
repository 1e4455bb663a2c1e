"""URL rules by Bloom filter cascades: exact membership over the corpus's own keys, without a join.

A rule is a host and a path. A URL's candidate keys are the suffixes of its host, as many labels as
rules have, each with the beginnings of its path, as long as rules' paths are. All candidate keys of
the corpus are the universe. A cascade encodes the listed keys in its first filter, the keys of the
universe that pass it wrongly in the second, the listed keys that pass that one in the third, and so
on until none is left: for each key of the universe the first filter that it fails tells the truth.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, work_dir
from .files import reading, writing

#: Bits that the filters of one shard have together at most, by estimate: a task holds two shards' (32 MB).
MOST_BITS = 1 << 27
#: Candidate keys that a task looks up together, so that it reads each shard once for them.
MOST_KEYS = 1 << 18
#: The chance by which a later filter is passed wrongly.
LATER = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lowered) and path of a URL; both empty for null or without ://."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(known, F.expr("substr({0}, instr({0}, '://') + 3)".format("url"))).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, lower), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Filter:
    """A Bloom filter: level seeds its hashes."""

    level: int
    bits: int
    hashes: int
    words: np.ndarray

    def __contains__(self, key: str) -> bool:
        return all(self.words[p >> 6] >> np.uint64(p & 63) & np.uint64(1) for p in positions(key, self.level, self.bits, self.hashes))


@dataclass(frozen=True)
class Cascade:
    filters: tuple[Filter, ...]

    def __contains__(self, key: str) -> bool:
        """Exact for each key that was listed or in the universe."""
        for i, f in enumerate(self.filters):
            if key not in f:
                return i % 2 == 1
        return len(self.filters) % 2 == 1


def positions(key: str, level: int, bits: int, hashes: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), seed=level)
    a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return [(a + i * b) % bits for i in range(hashes)]


def _fill(keys: DataFrame, level: int, chance: float, n: int) -> Filter:
    """The filter of n keys. Tasks set bits of their own; equal words meet pre-aggregated."""
    hashes = max(1, round(-math.log2(chance)))
    bits = max(64, math.ceil(n * hashes / math.log(2)))

    def run(batches):
        for b in batches:
            p = np.array([p for k in b.column("key").to_pylist() for p in positions(k, level, bits, hashes)], dtype=np.int64)
            word, inverse = np.unique(p >> 6, return_inverse=True)
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, inverse, np.uint64(1) << (p & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(value.view(np.int64))], names=["word", "value"])

    words = np.zeros(-(-bits // 64), np.uint64)
    for r in keys.mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toLocalIterator():
        words[r["word"]] = np.uint64(r["value"] & 0xFFFFFFFFFFFFFFFF)  # at most about MOST_BITS
    return Filter(level, bits, hashes, words)


def _passing(keys: DataFrame, f: Filter) -> DataFrame:
    def run(batches):
        for b in batches:
            yield b.filter(pa.array([k in f for k in b.column("key").to_pylist()], pa.bool_()))

    return keys.mapInArrow(run, "key string")


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of distinct listed keys (column key) over a universe of distinct keys.

    Its size follows the listed keys: the first filter is passed wrongly by about as many keys of
    the universe as there are listed ones. No listed keys: an empty cascade, which holds nothing.
    """
    listed = materialize(listed.select("key").distinct(), "listed")
    others = materialize(universe.select("key").join(listed, "key", "left_anti"), "others")
    sizes = [listed.count(), others.count()]
    if not sizes[0]:
        return Cascade(())
    chance, sets, filters = min(0.5, math.sqrt(0.5) * sizes[0] / max(1, sizes[1])), [listed, others], []
    while sizes[0]:
        f = _fill(sets[0], len(filters), chance, sizes[0])
        filters.append(f)
        wrong = materialize(_passing(sets[1], f), "wrong")
        sets, sizes, chance = [wrong, sets[0]], [wrong.count(), sizes[0]], LATER
    return Cascade(tuple(filters))


def shards_for(listed: int, universe: int) -> int:
    """Shards that keep each cascade within MOST_BITS, with room for twice the estimate."""
    first = max(1.0, math.log2(max(1, universe) / max(1, listed)) + 1) / math.log(2)
    later = 1 / math.log(2) / (1 - math.sqrt(0.5))  # each filter has about 0.7 times the keys of the one before
    return max(1, math.ceil(2 * listed * (first + later) / MOST_BITS))


def shard_of(key: str, shards: int) -> int:
    """pmod(xxhash64(key), shards) of Spark."""
    h = xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), seed=42)
    return (h - (h >> 63 << 64)) % shards


def write_cascades(lists: dict[str, DataFrame], universe: DataFrame, folder: str) -> int:
    """Writes a cascade for each list (distinct keys, by name) and shard; returns the number of shards."""
    shards = shards_for(max(x.count() for x in lists.values()), universe.count())
    for s in range(shards):
        here = F.pmod(F.xxhash64("key"), F.lit(shards)) == s
        for name, listed in lists.items():
            with writing(f"{folder}/{name}-{s}") as out:
                out.write(pickle.dumps(build_cascade(listed.where(here), universe.where(here))))
    return shards


def _load(path: str) -> Cascade:
    with reading(path) as f:
        return pickle.loads(f.read())


def _candidates(urls: DataFrame, labels: list[int], lengths: list[int]) -> DataFrame:
    """urls (page_id, host, path) with keys: array of (rule, key), the longest first."""
    parts = F.split("host", r"\.")
    n = F.size(parts)
    suffixes = [F.when(n >= k, F.array_join(F.slice(parts, F.greatest(n - k + 1, F.lit(1)), k), ".")) for k in labels]
    keys = [F.when(s.isNotNull() & (F.length("path") >= k), F.struct((F.length(s) + k).alias("size"), F.length(s).alias("host_size"), F.concat(s, F.substring("path", 1, k)).alias("key"))) for s in suffixes for k in lengths]
    if not keys:
        return urls.withColumn("keys", F.array().cast("array<string>"))
    found = F.reverse(F.array_sort(F.filter(F.array(*keys), lambda x: x.isNotNull())))
    return urls.withColumn("keys", F.transform(found, lambda x: x["key"]))


def judge_urls(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    rules: (verdict, host, path); verdicts are allow or block, hosts lower-case, paths begin with / or
    are empty. A rule fits its host and all subdomains if the URL's path starts with the rule's. The
    rule with most characters wins, of equally long ones that with the longer host; a pair of host and
    path that is listed as both is blocked. Without a fitting rule: rule null and the default. Null URLs
    have empty host and path; repeated rows stay; an empty table gives no rows. Lists of any length go
    through cascades, in shards.
    """
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "verdict string, host string, path string")
    rules = rules.select("verdict", F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length")).distinct()
    # few distinct numbers: hosts have at most 127 labels; paths' lengths are bounded by a URL's
    labels = sorted(r["labels"] for r in rules.select("labels").distinct().collect())
    lengths = sorted(r["length"] for r in rules.select("length").distinct().collect())
    host, path = host_and_path(F.col("url"))
    urls = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    keyed = _candidates(urls, labels, lengths)
    block = rules.where("verdict = 'block'").select("key").distinct()
    allow = rules.where("verdict = 'allow'").select("key").distinct().join(block, "key", "left_anti")
    universe = materialize(keyed.select(F.explode("keys").alias("key")).distinct(), "universe")
    lists = {"block": materialize(block, "block"), "allow": materialize(allow, "allow")}
    folder = work_dir(spark, "cascades")
    shards = write_cascades(lists, universe, folder)

    def run(batches):
        load, part, size = lru_cache(2)(_load), [], 0

        def listed(keys: set[str]) -> dict[str, str]:
            """The verdict of each key that is on a list."""
            by = defaultdict(list)
            for k in keys:
                by[shard_of(k, shards)].append(k)
            return {k: v for s, ks in by.items() for v in ("block", "allow") for c in (load(f"{folder}/{v}-{s}"),) for k in ks if k in c}

        def judged():
            rows = [b.column("keys").to_pylist() for b in part]
            known = listed({k for b in rows for keys in b for k in keys})
            for b, lists in zip(part, rows):
                rule = [next((k for k in keys if k in known), None) for keys in lists]
                verdict = [default if k is None else known[k] for k in rule]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "path")), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

        for b in batches:
            part.append(b)
            size += pc.sum(pc.list_value_length(b.column("keys"))).as_py() or 0
            if size >= MOST_KEYS:
                yield from judged()
                part, size = [], 0
        yield from judged()

    return keyed.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
