"""The pipeline against a plain version of its stages, and the SQL of the queries that have it."""

from __future__ import annotations

import collections
import zlib

import duckdb
import pytest
from public_tokenizers import path as vocabulary
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import queries, simhash, toxicity
from gridloom.llm.common import table

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents").cache()
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, DATA).cache()
        rows = out.collect()
        if name != "packing":
            assert out.columns == columns
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.score(docs, toxicity.fit(docs, table(spark, DATA, "labels"))).collect() if r["predicted"]}
            assert {r["doc_id"] for r in rows} == set(before) - bad
        if name == "near_duplicates":
            kept = {r["doc_id"]: frozenset(shingles(r["text"])) for r in rows}
            by = {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(docs).collect()}
            assert set(kept) == {i for i, c in by.items() if i == c}
            texts = collections.defaultdict(set)
            for i, r in before.items():
                texts[r["text"]].add(i)
            assert all(len(ids & set(kept)) <= 1 for ids in texts.values())  # exact copies: one at most
            for i, c in by.items():
                if i != c:  # what goes is like something in its class
                    same = [j for j in by if by[j] == c and j != i]
                    assert max(jaccard(before[i]["text"], before[j]["text"]) for j in same) > 0.6
            close = [(i, j) for i in kept for j in kept if i < j and kept[i] & kept[j] and len(kept[i] & kept[j]) / len(kept[i] | kept[j]) >= 0.9]
            assert not close
        if name == "repeated_passages":
            n, seen = 35, collections.Counter()
            words = {i: r["text"].encode().split() for i, r in before.items()}
            for w in words.values():
                seen.update(tuple(w[j : j + n]) for j in range(len(w) - n + 1))
            for r in rows:
                w = words[r["doc_id"]]
                gone = {k for j in range(len(w) - n + 1) if seen[tuple(w[j : j + n])] > 1 for k in range(j, j + n)}
                want = b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else before[r["doc_id"]]["text"]
                assert (r["text"], r["n_chars"]) == (want, len(want))
        if name == "packing":
            t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
            length = collections.Counter()
            for r in rows:
                length[r["doc_id"]] += r["length"]
            assert length == {i: len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in before.items()}
        docs = out
    assert corpus_pipeline.run(spark, DATA).count() == docs.count()


def shingles(t):
    w = t.lower().split()
    return [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))]


def jaccard(a, b):
    x, y = set(shingles(a)), set(shingles(b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    cur = c.execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, cur.fetchall()))


def test_held_out_rows_are_the_contracts(spark):
    got = queries.op10_toxicity(spark, DATA).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def odd_docs(spark, texts, ids):
    kind = "doc_id long, text string, lang string, source string, n_chars long, row string, node long, label int, _ string, kept_id long, comp long"
    rows = [(i, t, "en", None, None if t is None else len(t), "r", 1, 2, "x", 3, 4) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, kind).repartition(3)


def test_stages_on_odd_tables(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns, an empty table."""
    words = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"l{i % 9973}_{i}" for i in range(300_000))  # 3.5 MB
    texts = [words, words, words + " end", None, None, "", " ", "\n", long, long + " x", "a", "a", "été " * 50, "one two three"]
    ids = [5, 5, 7, 1, None, 2, 3, 4, 9, 10, 11, 11, None, 12]
    for docs in (odd_docs(spark, texts, ids), odd_docs(spark, texts, ids).limit(0)):
        n, columns = docs.count(), docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA).cache()
            got = out.collect()
            if name == "toxicity":
                assert len(got) == n
            if name == "near_duplicates" and n:
                assert sorted(str(r["doc_id"]) for r in got) == sorted(map(str, [5, 5, 1, 9, 11, 11, None, 12]))
            if name != "packing":
                assert out.columns == columns
            else:
                assert len({r["doc_id"] for r in got}) == (6 if n else 0) and all(r["length"] <= 2048 for r in got)
            docs = out
