"""One query per operator, with production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import path as vocabulary

from . import chroma, dac, iblt, nbest, packing, simhash, substring, toxicity, url_filter, warc
from .common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.version_fingerprints(table(spark, sf_dir, "documents"))


def op2_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.round_trip(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.substring_dedup(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(spark, table(spark, sf_dir, "pages"), least_bytes=0)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.simhash_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: each embedding is rendered as a melody."""
    return chroma.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", every=50, render=True).withColumnRenamed("id", "vec_id")


# The rules of the query, as (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark, table(spark, sf_dir, "pages"), RULES)


def op8_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.digests(nbest.encode_nbest(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, max_len=2048)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_token_codes, op3_substring, op4_warc, op5_simhash, op6_chroma, op7_url_rules, op8_nbest, op9_packing, op10_toxicity)}

ORACLE: dict[str, str] = {
    "op3_substring": r"""
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS words FROM documents),
        p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
        g AS (SELECT doc_id, pos, array_to_string(list_slice(words, pos, pos + 34), ' ') AS seq FROM w, unnest(generate_series(1, len(words) - 34)) AS t(pos) WHERE len(words) >= 35),
        d AS (SELECT seq FROM (SELECT md5(seq) AS seq FROM g) GROUP BY seq HAVING count(*) > 1),
        s AS (SELECT doc_id, pos FROM g WHERE md5(seq) IN (SELECT seq FROM d)),
        gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM s, range(35) AS r(k)),
        kept AS (SELECT p.doc_id, count(*) AS n_words, count(gone.pos) AS n_removed, string_agg(p.word, ' ' ORDER BY p.pos) FILTER (WHERE gone.pos IS NULL) AS kept
                 FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.pos = gone.pos GROUP BY p.doc_id)
        SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id""",
    "op4_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p),
        b AS (SELECT *, list_transform(range(32), lambda i: ('0x' || substr(x, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT & 31) AS fives FROM d)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, array_to_string(list_transform(fives, lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', k + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b""",
    "op7_url_rules": r"""
        WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        hp AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        rules(v, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        hit AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
                FROM hp JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT hp.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hp LEFT JOIN hit ON hp.page_id = hit.page_id""",
}
