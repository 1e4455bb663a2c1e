"""Queries of the text operators over documents, pages, benchmark and conversations."""

from pyspark.sql import functions as F

from ..operators import replicas, solve, text
from .registry import Tables, query

# A small dictionary for the spelling queries, in order of preference.
DICTIONARY = ["the", "and", "of", "to", "in", "is", "that", "it", "was", "for", "on", "are", "as", "with", "his", "they", "at", "be", "this", "have", "from", "or", "one", "had", "by", "word", "but", "not", "what", "all"]
_VALUES = ", ".join(f"('{w}', {i})" for i, w in enumerate(DICTIONARY))
_WORDS = r"""t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{80}-\x{10FFFF}]+(?:''[A-Za-z\x{80}-\x{10FFFF}]+)*')) AS word FROM documents), w AS (SELECT word, count(*) AS n FROM t GROUP BY word)"""


def dictionary(t: Tables):
    return t.spark.createDataFrame(list(zip(DICTIONARY, range(len(DICTIONARY)))), "word string, ord int")


@query(f"WITH {_WORDS} SELECT word, n FROM w")
def doc_tokens(t: Tables):
    return text.word_counts(t.documents, "text")


@query(f"WITH {_WORDS} SELECT word, n FROM w ORDER BY n DESC, word LIMIT 100")
def doc_tokens_top(t: Tables):
    return text.word_counts(t.documents, "text").orderBy(F.desc("n"), "word").limit(100)


@query(f"WITH {_WORDS}, d(word, ord) AS (VALUES {_VALUES}) SELECT word, n FROM w WHERE word NOT IN (SELECT word FROM d)")
def doc_spell_oov(t: Tables):
    return text.unknown_words(text.word_counts(t.documents, "text"), dictionary(t))


@query(f"""WITH {_WORDS}, d(word, ord) AS (VALUES {_VALUES}), p AS (SELECT w.word, d.word AS suggestion, levenshtein(w.word, d.word) AS dist, ord FROM w JOIN d ON abs(length(w.word) - length(d.word)) <= 2 WHERE regexp_full_match(w.word, '[a-z'']+') AND w.word NOT IN (SELECT word FROM d)),
r AS (SELECT word, suggestion, dist, row_number() OVER (PARTITION BY word ORDER BY dist, ord) AS rn FROM p WHERE dist <= CASE WHEN length(word) <= 4 THEN 1 ELSE 2 END) SELECT word, suggestion, dist::BIGINT AS dist, rn FROM r WHERE rn <= 3""")
def doc_spell_suggest(t: Tables):
    oov = text.unknown_words(text.word_counts(t.documents, "text"), dictionary(t)).where(F.col("word").rlike("^[a-z']+$"))
    got = text.suggest(oov, dictionary(t))
    return got.withColumns({"dist": F.col("dist").cast("long"), "rn": F.col("rn").cast("long")})


@query(r"SELECT doc_id, len(regexp_extract_all(text, '  +|\.\.'))::BIGINT AS n FROM documents")
def doc_grammar_doublespace(t: Tables):
    return t.documents.select("doc_id", text.grammar_counts(F.col("text"))["double_space"].cast("long").alias("n"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])[Aa] [aeiouAEIOU]'))::BIGINT AS a_vowel, len(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])[Aa]n [b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]'))::BIGINT AS an_consonant FROM documents")
def doc_grammar_aan_all(t: Tables):
    g = text.grammar_counts(F.col("text"))
    return t.documents.select("doc_id", g["a_vowel"].cast("long").alias("a_vowel"), g["an_consonant"].cast("long").alias("an_consonant"))


@query(f"""WITH r AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+|[^a-z \\t\\n\\r\\f\\x0b]+') AS runs FROM documents)
SELECT doc_id, len(list_filter(range(1, len(runs)), lambda i: runs[i] = runs[i + 1] AND regexp_matches(runs[i], '^[a-z]')))::INT AS doubled,
len(list_filter(runs, lambda x: x IN ({", ".join(f"'{w}'" for w in text.MISSPELLINGS)})))::INT AS misspelled FROM r""")
def doc_grammar_doubled(t: Tables):
    g = text.grammar_counts(F.col("text"))
    return t.documents.select("doc_id", g["doubled"].alias("doubled"), g["misspelled"].alias("misspelled"))


@query()
def doc_grammar_findings(t: Tables):
    return text.grammar_findings(t.documents, "doc_id", "text")


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 'und' ELSE 'en' END AS tag FROM documents")
def doc_script_tag(t: Tables):
    return t.documents.select("doc_id", text.script_tag(F.col("text")).alias("tag"))


@query("""WITH p AS (SELECT doc_id, text, instr(text, 'the') AS pos FROM documents WHERE contains(text, 'the'))
SELECT doc_id, pos::BIGINT AS pos, (length(left(text, pos - 1)) - length(replace(left(text, pos - 1), chr(10), '')) + 1)::BIGINT AS line, substring(text, greatest(pos - 40, 1), least(pos - 1, 40) + 63) AS context FROM p""")
def doc_find_context(t: Tables):
    hits = text.find_in_context(t.documents, "doc_id", "text", "the")
    first = hits.groupBy("doc_id").agg(F.min(F.struct("at", "line", "context")).alias("h"))
    return first.select("doc_id", F.col("h.at").cast("long").alias("pos"), F.col("h.line").cast("long").alias("line"), F.col("h.context").alias("context"))


@query("""WITH p AS (SELECT doc_id, string_split(text, 'the') AS parts FROM documents WHERE contains(text, 'the')),
u AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i, len(parts) AS n FROM p),
h AS (SELECT doc_id, i, n, (sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) + 3 * (i - 1) + 1)::BIGINT AS pos FROM u)
SELECT doc_id, pos, (length(left(text, pos - 1)) - length(replace(left(text, pos - 1), chr(10), '')) + 1)::BIGINT AS line, md5(substring(text, greatest(pos - 40, 1), least(pos - 1, 40) + 63)) AS context FROM h JOIN documents USING (doc_id) WHERE i < n""")
def doc_find_hits(t: Tables):
    hits = text.find_in_context(t.documents, "doc_id", "text", "the")
    return hits.select("doc_id", F.col("at").cast("long").alias("pos"), F.col("line").cast("long").alias("line"), F.md5("context").alias("context"))


@query("SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS n FROM documents WHERE contains(text, 'the')")
def doc_find_count(t: Tables):
    return t.documents.where(F.contains("text", F.lit("the"))).select("doc_id", text.find_count(F.col("text"), "the").alias("n"))


_TERM = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{80}-\x{10FFFF}]+(?:''[A-Za-z\x{80}-\x{10FFFF}]+)*')"


@query(f"""WITH b AS (SELECT DISTINCT unnest({_TERM}) AS term FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest({_TERM}) AS term FROM documents)
SELECT term, count(*) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM b JOIN d USING (term) GROUP BY term""")
def doc_index_terms(t: Tables):
    terms = t.benchmark.select(F.explode(text.tokens(text.ascii_lower(F.col("text")))).alias("term")).distinct()
    return text.book_index(t.documents, "doc_id", "text", terms).groupBy("term").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query(f"""WITH b AS (SELECT DISTINCT unnest({_TERM}) AS term FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest({_TERM}) AS term FROM documents)
SELECT term, doc_id FROM b JOIN d USING (term)""")
def doc_index_postings(t: Tables):
    terms = t.benchmark.select(F.explode(text.tokens(text.ascii_lower(F.col("text")))).alias("term")).distinct()
    return text.book_index(t.documents, "doc_id", "text", terms)


@query("SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines, length(text)::BIGINT AS chars FROM documents")
def doc_line_stats(t: Tables):
    s = text.line_stats(F.col("text"))
    return t.documents.select("doc_id", s["lines"].cast("long").alias("lines"), s["chars"].cast("long").alias("chars"))


@query("SELECT doc_id, sha256(regexp_replace(text, '[0-9]', '█', 'g')) AS redacted FROM documents")
def doc_redact(t: Tables):
    return t.documents.select("doc_id", F.sha2(text.redact(F.col("text"), "[0-9]"), 256).alias("redacted"))


@query(r"""SELECT doc_id, array_to_string(list_transform(list_slice(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> ''), 1, 3), lambda x: trim(regexp_extract(x, '^[^.]*\.?'), ' ')), ' ') AS summary FROM documents""")
def doc_summary(t: Tables):
    return t.documents.select("doc_id", text.summary(F.col("text")).alias("summary"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def doc_sha256(t: Tables):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("hash"))


@query("SELECT doc_id, sha256(base64(encode(text))) AS digest, decode(from_base64(base64(encode(text)))) = text AS same FROM documents")
def doc_base64_whole(t: Tables):
    b = F.base64(F.encode("text", "UTF-8"))
    return t.documents.select("doc_id", F.sha2(F.regexp_replace(b, r"\s", ""), 256).alias("digest"), (F.decode(F.unbase64(b), "UTF-8") == F.col("text")).alias("same"))


_INNER, _OUTER = ("".join(f"{x ^ p:02x}" for x in b"secret".ljust(64, b"\0")) for p in (0x36, 0x5C))


@query(f"SELECT doc_id, sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(text)))) AS signature FROM documents")
def doc_hmac(t: Tables):
    return t.documents.select("doc_id", solve.hmac_sha256("secret", F.col("text")).alias("signature"))


@query("SELECT doc_id, replace(text, 'the', 'THE') <> text AS changed, length(replace(text, 'and', '&'))::BIGINT AS n FROM documents")
def doc_replace(t: Tables):
    return t.documents.select("doc_id", (F.replace("text", F.lit("the"), F.lit("THE")) != F.col("text")).alias("changed"), F.length(F.replace("text", F.lit("and"), F.lit("&"))).cast("long").alias("n"))


@query(r"""SELECT doc_id, (i - 1)::BIGINT AS idx, CASE WHEN regexp_matches(line, '^#+ ') THEN 'heading' WHEN regexp_matches(line, '^\s*[-*] ') THEN 'item' WHEN contains(line, ' | ') THEN 'row' ELSE 'paragraph' END AS kind
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(line, ' ') <> ''""")
def markdown_blocks(t: Tables):
    return text.markdown_blocks(t.documents, "doc_id", "text").select("doc_id", F.col("idx").cast("long").alias("idx"), "kind")


@query(r"SELECT page_id, length(regexp_replace(html, '<[^>]*(>|$)', '', 'g'))::BIGINT AS chars, md5(regexp_replace(html, '<[^>]*(>|$)', '', 'g')) AS digest FROM pages")
def html_strip(t: Tables):
    plain = text.strip_markup(F.col("html"))
    return t.pages.select("page_id", F.length(plain).cast("long").alias("chars"), F.md5(plain).alias("digest"))


@query(r"""SELECT page_id, pos::BIGINT AS pos, substring(h, 3, 1)::BIGINT AS level, trim(regexp_replace(h, '<[^>]*(>|$)', '', 'g'), ' ') AS title FROM (SELECT page_id, unnest(l) AS h, generate_subscripts(l, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS l FROM pages))""")
def html_headings(t: Tables):
    h = text.headings(t.pages, "page_id", "html")
    return h.select("page_id", F.col("ord").cast("long").alias("pos"), F.col("level").cast("long").alias("level"), "title")


@query(r"""SELECT page_id, repeat(' ', least(2 * (substring(h, 3, 1)::INT - 1), 10)) || left(trim(regexp_replace(h, '<[^>]*(>|$)', '', 'g'), ' '), 70) AS entry FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>')) AS h FROM pages)""")
def html_toc(t: Tables):
    return text.outline(text.headings(t.pages, "page_id", "html"), "page_id").select("page_id", "entry")


@query(r"""SELECT page_id, NOT regexp_matches(html, '(?i)<title[^>]*>[^<]') AS no_title, NOT regexp_matches(html, '(?i)<html[^>]* lang=') AS no_lang, (len(regexp_extract_all(html, '(?i)<img[ />]')) - len(regexp_extract_all(html, '(?i)<img[^>]* alt=')))::BIGINT AS images_without_alt, NOT regexp_matches(html, '(?i)<h1[ >]') AS no_h1 FROM pages""")
def html_a11y(t: Tables):
    a = text.accessibility(F.col("html"))
    return t.pages.select("page_id", *[(c.cast("long") if n == "images_without_alt" else c).alias(n) for n, c in a.items()])


_LETTER = "Dear {name}, ${nation} owes {balance}. {unknown}"


@query(f"SELECT c_custkey, replace(replace(replace('{_LETTER}', '{{name}}', c_name), '${{nation}}', n_name), '{{balance}}', c_mktsegment) AS letter FROM customer JOIN nation ON c_nationkey = n_nationkey")
def mail_merge(t: Tables):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", text.expand(_LETTER, {"name": F.col("c_name"), "nation": F.col("n_name"), "balance": F.col("c_mktsegment")}).alias("letter"))


@query("SELECT n_nationkey, 'x=' || n_name || ' y=${other}' AS out FROM nation")
def vars_expand(t: Tables):
    return t.nation.select("n_nationkey", text.expand("x=${n} y=${other}", {"n": F.col("n_name")}).alias("out"))


@query("SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, max(turn) AS last_turn, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def comment_threads(t: Tables):
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.countDistinct("role").alias("roles"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("chars"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, levenshtein(a.p_name, b.p_name)::BIGINT AS dist FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey")
def lev_pairs(t: Tables):
    a = t.part.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x"), "p_brand", "p_size", "p_type")
    b = t.part.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("y"), "p_brand", "p_size", "p_type")
    return a.join(b, ["p_brand", "p_size", "p_type"]).where("a < b").select("a", "b", F.levenshtein("x", "y").cast("long").alias("dist"))


@query()
def doc_line_diff(t: Tables):
    pairs = t.documents.select("doc_id", F.col("text").alias("old"), F.replace("text", F.lit("the "), F.lit("")).alias("new"))
    d = replicas.line_diff(pairs, "doc_id", "old", "new")
    return d.groupBy("doc_id").agg(F.count_if(F.col("op") == "+").alias("added"), F.count_if(F.col("op") == "-").alias("deleted"), F.count_if(F.col("op") == "=").alias("kept"))


@query("SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents WHERE text <> ''")
def doc_charset(t: Tables):
    chars = t.documents.select(F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where("ch <> ''")
    return chars.distinct()


@query(f"WITH {_WORDS} SELECT word FROM w WHERE starts_with(word, 'th') ORDER BY word LIMIT 64")
def doc_autocomplete(t: Tables):
    return text.word_counts(t.documents, "text").where(F.startswith("word", F.lit("th"))).select("word").orderBy("word").limit(64)


@query("SELECT doc_id, sha256('To: archive@example.com' || chr(13) || chr(10) || 'From: ' || source || '@example.com' || chr(13) || chr(10) || 'Subject: Document ' || doc_id || chr(13) || chr(10) || 'Date: Thu, 01 Jan 1970 00:00:00 +0000' || chr(13) || chr(10) || chr(13) || chr(10) || text) AS message FROM documents")
def mail_messages(t: Tables):
    sender, subject = F.concat("source", F.lit("@example.com")), F.concat(F.lit("Document "), "doc_id")
    whole = text.mail_message(F.lit("archive@example.com"), sender, subject, F.lit("Thu, 01 Jan 1970 00:00:00 +0000"), F.col("text"))
    return t.documents.select("doc_id", F.sha2(whole, 256).alias("message"))
