"""Queries of blocks, numbering, lookups, criteria, op-logs and formulas over nulls and errors."""

from pyspark.sql import functions as F

from ..functions.formula import with_formulas
from ..operators import blocks, replicas, solve, tables, text
from .registry import Tables, query

_BLOCKS = r"""SELECT page_id, unnest(l) AS b, generate_subscripts(l, 1) - 1 AS idx FROM (SELECT page_id, regexp_extract_all(html, '(?is)<(?:h[1-6]|p|li|tr)(?:\s[^>]*)?>.*?</(?:h[1-6]|p|li|tr)>') AS l FROM pages)"""
_STRIP = "regexp_replace({}, '<[^>]*(>|$)', '', 'g')"


@query(rf"""WITH b AS ({_BLOCKS}), k AS (SELECT *, lower(regexp_extract(b, '^<([A-Za-z]+[1-6]?)', 1)) AS kind FROM b)
SELECT page_id, idx::BIGINT AS idx, kind, regexp_matches(b, '(?i)<(?:b|strong)[ >]') AS bold,
CASE WHEN kind = 'tr' THEN array_to_string(list_transform(regexp_extract_all(b, '(?is)<t[dh](?:\s[^>]*)?>.*?</t[dh]>'), lambda c: trim({_STRIP.format("c")}, ' ')), ' | ')
ELSE trim({_STRIP.format("regexp_replace(b, '(?i)<br" + chr(92) + "s*/?>', ' ', 'g')")}, ' ') END AS text FROM k""")
def html_blocks(t: Tables):
    return blocks.html_blocks(t.pages, "page_id", "html").withColumn("idx", F.col("idx").cast("long"))


MARKDOWN_LINES = r"""SELECT doc_id, i - 1 AS idx, line, CASE WHEN regexp_matches(line, '^#+ ') THEN 'heading' WHEN regexp_matches(line, '^\s*[-*] ') THEN 'item' WHEN contains(line, ' | ') THEN 'row' ELSE 'paragraph' END AS kind, least(length(regexp_extract(line, '^(#+) ', 1)), 3) AS level,
regexp_replace(regexp_replace(line, '^(#+ |\s*[-*] )', ''), '\*\*', '', 'g') AS text
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(line, ' ') <> ''"""


def _markdown(t: Tables):
    return text.markdown_blocks(t.documents, "doc_id", "text")


@query(f"WITH l AS ({MARKDOWN_LINES}) SELECT doc_id, idx::BIGINT AS idx, kind, level::BIGINT AS level, md5(text) AS digest FROM l")
def markdown_block_texts(t: Tables):
    return _markdown(t).select("doc_id", F.col("idx").cast("long").alias("idx"), "kind", F.col("level").cast("long").alias("level"), F.md5("text").alias("digest"))


@query(rf"""WITH l AS ({MARKDOWN_LINES}), c AS (SELECT doc_id, idx, string_split(regexp_replace(trim(text, ' '), '^\||\|$', '', 'g'), '|') AS parts FROM l WHERE kind = 'row'),
u AS (SELECT doc_id, idx, unnest(parts) AS c, generate_subscripts(parts, 1) AS col FROM c)
SELECT doc_id, idx::BIGINT AS idx, col::BIGINT AS col, trim(c, ' ') AS text FROM u WHERE NOT regexp_matches(trim(c, ' '), '^:?-+:?$')""")
def markdown_cells(t: Tables):
    cells = blocks.markdown_cells(_markdown(t), "doc_id")
    return cells.select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("col").cast("long").alias("col"), "text")


_ESC = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(rf"""WITH l AS ({MARKDOWN_LINES}), e AS (SELECT *, {_ESC} AS x FROM l)
SELECT doc_id, md5(string_agg(CASE kind WHEN 'heading' THEN '<h' || level || '>' || x || '</h' || level || '>' WHEN 'item' THEN '<li>' || x || '</li>' WHEN 'row' THEN '<tr><td>' || x || '</td></tr>' ELSE '<p>' || x || '</p>' END, chr(10) ORDER BY idx)) AS html,
md5(string_agg(CASE kind WHEN 'heading' THEN '\section{{' || text || '}}' WHEN 'item' THEN '\item ' || text WHEN 'row' THEN text || ' \\' ELSE text END, chr(10) ORDER BY idx)) AS latex,
md5(string_agg(CASE kind WHEN 'heading' THEN '<head>' || x || '</head>' WHEN 'item' THEN '<item>' || x || '</item>' WHEN 'row' THEN '<row>' || x || '</row>' ELSE '<p>' || x || '</p>' END, chr(10) ORDER BY idx)) AS tei,
md5(string_agg(CASE kind WHEN 'item' THEN '- ' || text ELSE text END, chr(10) ORDER BY idx)) AS text FROM e GROUP BY doc_id""")
def blocks_render(t: Tables):
    out = None
    for style in ("html", "latex", "tei", "text"):
        one = blocks.render(_markdown(t), "doc_id", style).select("doc_id", F.md5("out").alias(style))
        out = one if out is None else out.join(one, "doc_id")
    return out


_HEADS = r"""SELECT page_id, unnest(l) AS h, generate_subscripts(l, 1) AS ord FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS l FROM pages)"""


@query(f"""WITH h AS ({_HEADS}), p AS (SELECT page_id, ord, substring(h, 3, 1)::BIGINT AS level, coalesce(lag(substring(h, 3, 1)::BIGINT) OVER (PARTITION BY page_id ORDER BY ord), 0) AS before FROM h)
SELECT page_id, ord::BIGINT AS ord, level, before FROM p WHERE level > before + 1""")
def html_heading_skips(t: Tables):
    s = blocks.heading_skips(text.headings(t.pages, "page_id", "html"), "page_id")
    return s.select("page_id", *[F.col(c).cast("long").alias(c) for c in ("ord", "level", "before")])


@query(f"WITH h AS ({_HEADS}) SELECT page_id, ord::BIGINT AS ord, least(row_number() OVER (PARTITION BY page_id ORDER BY ord), 6)::BIGINT AS level FROM h")
def heading_levels(t: Tables):
    h = blocks.enforce_headings(text.headings(t.pages, "page_id", "html"), "page_id")
    return h.select("page_id", F.col("ord").cast("long").alias("ord"), F.col("level").cast("long").alias("level"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, i::BIGINT AS line, '(' || row_number() OVER (PARTITION BY doc_id ORDER BY i) || ')' AS number FROM l WHERE contains(line, '=')""")
def equation_numbers(t: Tables):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l")).where(F.contains("l", F.lit("=")))
    return blocks.numbered(lines, "doc_id", "i").select("doc_id", (F.col("i") + 1).cast("long").alias("line"), F.concat(F.lit("("), F.col("number").cast("string"), F.lit(")")).alias("number"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, coalesce(min(i) FILTER (WHERE i > 2), min(i))::BIGINT AS hit FROM l WHERE contains(line, 'the') GROUP BY doc_id""")
def doc_find_next(t: Tables):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("i", F.col("i") + 1)
    return blocks.find_next(lines, "doc_id", "i", "line", "the", 2).select("doc_id", F.col("hit").cast("long").alias("hit"))


@query("""SELECT c_custkey, '(' || regexp_extract(replace(c_name, '#', ' ') , '([^ ]+) *$', 1) || ', ' || (1900 + c_custkey % 100) || ')' AS cite, '[' || row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) || '] ' || replace(c_name, '#', ' ') || '. ' || c_mktsegment || '. book.' AS line FROM customer""")
def citations(t: Tables):
    c = blocks.numbered(t.customer, "c_nationkey", "c_custkey").withColumn("authors", F.replace("c_name", F.lit("#"), F.lit(" ")))
    return c.select("c_custkey", blocks.cite_inline(F.col("authors"), F.lit(1900) + F.col("c_custkey") % 100).alias("cite"), blocks.bibliography_line(F.col("number"), F.col("authors"), F.col("c_mktsegment"), F.lit("book")).alias("line"))


# A small thesaurus; the later entry of a word replaces the earlier one.
THESAURUS = [("The", 1, "this"), ("and", 2, "also, plus"), ("THE", 3, "that, those"), ("was", 4, "existed")]
_ENTRIES = ", ".join(f"('{w}', {i}, '{x}')" for w, i, x in THESAURUS)
_WORDS = r"""SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents)"""


@query(f"""WITH e(w, o, s) AS (VALUES {_ENTRIES}), k AS (SELECT lower(w) AS k, arg_max(s, o) AS s FROM e GROUP BY 1), d AS ({_WORDS})
SELECT word, s AS synonyms FROM d JOIN k ON lower(word) = k""")
def doc_thesaurus(t: Tables):
    words = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).distinct()
    return blocks.synonyms(words, t.spark.createDataFrame(THESAURUS, "word string, ord int, synonyms string"))


@query("""WITH RECURSIVE w AS (SELECT p_partkey, list_filter(string_split(p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_name, ' '), lambda x: x <> '') AS words FROM part),
r(p_partkey, words, i, done, line) AS (SELECT p_partkey, words, 1, '', '' FROM w UNION ALL
SELECT p_partkey, words, i + 1, CASE WHEN line = '' OR length(line) + 1 + length(words[i]) <= 18 THEN done ELSE done || line || chr(10) END, CASE WHEN line = '' THEN words[i] WHEN length(line) + 1 + length(words[i]) <= 18 THEN line || ' ' || words[i] ELSE words[i] END FROM r WHERE i <= len(words))
SELECT p_partkey, done || line AS wrapped FROM r WHERE i = len(words) + 1""")
def word_wrap(t: Tables):
    return t.part.select("p_partkey", blocks.wrap(F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_name"), 18).alias("wrapped"))


@query(r"""SELECT doc_id, regexp_matches(text, '[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]') AS rtl FROM documents""")
def doc_rtl(t: Tables):
    return t.documents.select("doc_id", blocks.is_rtl(F.col("text")).alias("rtl"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '[A-Za-z0-9)] *[=+*/^<>-] *[A-Za-z0-9(]')::INT + regexp_matches(line, '[\x{0370}-\x{03FF}\x{2200}-\x{22FF}]')::INT + regexp_matches(line, '[0-9]+/[0-9]+')::INT + regexp_matches(line, '\([^()]*\)')::INT >= 2) AS n FROM l GROUP BY doc_id""")
def doc_math_lines(t: Tables):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(blocks.is_math_line(F.col("line"))).alias("n"))


@query("SELECT doc_id, sha256(nfc_normalize(text)) AS nfc FROM documents")
def doc_nfc(t: Tables):
    return blocks.normalised(t.documents, "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("nfc"))


@query(r"""WITH v AS (SELECT source, CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 'und' ELSE 'en' END AS tag, count(*) AS votes FROM documents GROUP BY ALL)
SELECT source, tag, votes FROM v QUALIFY row_number() OVER (PARTITION BY source ORDER BY votes DESC, tag) = 1""")
def script_majority(t: Tables):
    return blocks.majority(t.documents.select("source", text.script_tag(F.col("text")).alias("tag")), "source", "tag")


@query("""SELECT p_partkey, round(len(list_filter(range(1, length(p_name) + 1), lambda i: p_name[i] = replace(p_name, 'e', 'o')[i])) / length(p_name), 9) AS accuracy FROM part""")
def character_accuracy(t: Tables):
    return t.part.select("p_partkey", F.round(blocks.character_accuracy(F.col("p_name"), F.replace("p_name", F.lit("e"), F.lit("o"))), 9).alias("accuracy"))


@query("""WITH n AS (SELECT lower(n_name) AS k, row_number() OVER (ORDER BY n_nationkey) AS pos FROM nation) SELECT s_suppkey, pos::BIGINT AS pos FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN n ON lower(upper(n_name)) = k""")
def match_column(t: Tables):
    names = t.supplier.join(F.broadcast(t.nation.select("n_nationkey", F.upper("n_name").alias("key"))), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return tables.match(names, t.nation, "key", "n_name", "n_nationkey").select("s_suppkey", F.col("pos").cast("long").alias("pos"))


@query("""WITH n AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS pos FROM nation) SELECT c_custkey, n_name FROM customer LEFT JOIN n ON c_custkey % 30 = pos""")
def index_column(t: Tables):
    return tables.index(t.customer.withColumn("at", F.col("c_custkey") % 30), t.nation, "at", "n_name", "n_nationkey", "n_name").select("c_custkey", "n_name")


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN (SELECT r_name FROM region WHERE r_regionkey = 0) WHEN 1 THEN '0' END AS cell FROM supplier""")
def hlookup_column(t: Tables):
    wide = t.region.select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key"), F.col("r_regionkey").alias("at"))
    s = t.supplier.withColumn("want", F.expr("element_at(array('name', 'key', 'none', null), cast(s_suppkey % 4 as int) + 1)"))
    return tables.hlookup(s, wide, "want", 1, "cell", "at").select("s_suppkey", "cell")


@query("""SELECT (SELECT l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC LIMIT 1 OFFSET 9) AS large10, (SELECT l_extendedprice FROM lineitem ORDER BY l_extendedprice LIMIT 1 OFFSET 6) AS small7, NULL::DOUBLE AS none""")
def kth_values(t: Tables):
    large = tables.kth(t.lineitem, "l_extendedprice", 10).withColumnRenamed("value", "large10")
    small = tables.kth(t.lineitem, "l_extendedprice", 7, False).withColumnRenamed("value", "small7")
    none = tables.kth(t.region.withColumn("x", F.lit(1.0)), "x", 99).withColumnRenamed("value", "none")
    return large.join(F.broadcast(small)).join(F.broadcast(none))  # one row each


@query("""SELECT l_returnflag, count(*) FILTER (WHERE l_quantity >= 30 AND lower(l_linestatus) = 'o') AS n, round(coalesce(sum(l_extendedprice) FILTER (WHERE l_discount <> 0.05), 0), 2) AS total, round(coalesce(avg(l_tax) FILTER (WHERE l_quantity < 5), 0), 9) AS mean FROM lineitem GROUP BY l_returnflag""")
def criteria_strings(t: Tables):
    n = tables.conditional(t.lineitem, "COUNT", None, {"l_quantity": ">=30", "l_linestatus": "o"}, ["l_returnflag"]).withColumnRenamed("value", "n")
    total = tables.conditional(t.lineitem, "SUM", "l_extendedprice", {"l_discount": "<>0.05"}, ["l_returnflag"]).select("l_returnflag", F.round("value", 2).alias("total"))
    mean = tables.conditional(t.lineitem, "AVERAGE", "l_tax", {"l_quantity": "<5"}, ["l_returnflag"]).select("l_returnflag", F.round("value", 9).alias("mean"))
    return n.join(total, "l_returnflag").join(mean, "l_returnflag")


@query("""WITH s AS (SELECT l_linenumber AS k, count(*)::DOUBLE a, sum(l_quantity) b, sum(l_quantity * l_quantity) c FROM lineitem GROUP BY 1)
SELECT k::BIGINT AS k, round(c / (a * c - b * b), 9) AS i11, round(-b / (a * c - b * b), 9) AS i12, round(a / (a * c - b * b), 9) AS i22 FROM s""")
def matrix_inverse(t: Tables):
    q = F.col("l_quantity")
    s = t.lineitem.groupBy(F.col("l_linenumber").alias("k")).agg(F.array(F.count("*").cast("double"), F.sum(q), F.sum(q), F.sum(q * q)).alias("m"))
    i = solve.inverse_rows(s, "k", "m")
    return i.select("k", *[F.round(F.col("inverse")[j], 9).alias(n) for j, n in ((0, "i11"), (1, "i12"), (3, "i22"))])


@query("SELECT doc_id, doc_id % 2 = 0 AS genuine FROM documents")
def doc_hmac_verify(t: Tables):
    """Every second signature is that of another text."""
    said = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("x")))
    return t.documents.select("doc_id", solve.hmac_verify("secret", F.col("text"), F.upper(solve.hmac_sha256("secret", said))).alias("genuine"))


def _log(t: Tables):
    return t.events.select(*replicas.insert_op("a", F.col("event_id"), F.col("event_type")))


@query("""SELECT event_id || ':a' AS id, CASE WHEN event_id % 7 = 0 THEN event_id + 1000000 ELSE event_id END AS lamport, event_id % 5 = 0 AS tomb, event_type AS value FROM events""")
def crdt_edits(t: Tables):
    """Insertions of all events, deletions of every fifth, moves of every seventh; written as lines and parsed again."""
    log = _log(t)
    gone = log.where("lamport % 5 = 0").select(*replicas.delete_op(F.col("id"), F.col("lamport"), F.col("value")))
    state = replicas.moved(replicas.merge_replicas(log, gone), log.where("lamport % 7 = 0"), F.col("lamport") + 1000000)
    return replicas.parse_lines(replicas.serialise(state))


@query("""WITH v AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events) SELECT user_id, event_id, version::BIGINT AS version, event_type AS blob FROM v""")
def history_versions(t: Tables):
    v = replicas.version_list(t.events, "user_id", "event_id")
    return v.select("user_id", "event_id", F.col("version").cast("long").alias("version"), F.col("event_type").alias("blob"))


@query("""SELECT p_partkey, coalesce(x::BIGINT::VARCHAR, '') || '!' AS amp, length(coalesce(s, ''))::DOUBLE AS len, coalesce(s, '') || '-' || coalesce(x::BIGINT::VARCHAR, '') AS cat, (coalesce(x, 0) + 3) / 2 AS avg, least(coalesce(x, 0), 5.0) AS least, greatest(coalesce(x, 0), 5.0) AS most,
list_sort([coalesce(x, 0), 10.0::DOUBLE, 30.0::DOUBLE])[2] AS med, ((x IS NULL)::INT + (s IS NULL)::INT)::DOUBLE AS blanks, (1 + (x IS NOT NULL)::INT + (s IS NOT NULL)::INT)::DOUBLE AS filled, (1 + (x IS NOT NULL)::INT)::DOUBLE AS n, coalesce(x, 0) + 1 AS plus, coalesce(x, 0) = 0 AS zero, coalesce(s, '') = '' AS empty
FROM (SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_size::DOUBLE END AS x, CASE WHEN p_size % 4 <> 0 THEN p_name END AS s FROM part)""")
def formula_nulls(t: Tables):
    p = t.part.select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("double")).alias("x"), F.when(F.col("p_size") % 4 != 0, F.col("p_name")).alias("s"))
    fs = {"amp": '[x]&"!"', "len": "LEN([s])", "cat": 'CONCATENATE([s],"-",[x])', "avg": "AVERAGE([x],3)", "least": "MIN([x],5)", "most": "MAX([x],5)", "med": "MEDIAN([x],10,30)", "blanks": "COUNTBLANK([x],[s])", "filled": "COUNTA([x],[s],1)", "n": "COUNT([x],[s],1)", "plus": "[x]+1", "zero": "[x]=0", "empty": '[s]=""'}
    return with_formulas(p, fs).select("p_partkey", *fs)


@query("""SELECT p_partkey, CASE WHEN d = 0 THEN '#DIV/0!' END AS div, CASE WHEN d < 0 THEN '#NUM!' END AS root, CASE WHEN d <= 0 THEN '#NUM!' END AS ln, CASE WHEN d <= 0 THEN '#NUM!' END AS log10, CASE WHEN d = 0 THEN '#DIV/0!' END AS mod, CASE WHEN d = 0 THEN '#DIV/0!' END AS ceil, CASE WHEN d = 0 THEN '#DIV/0!' END AS floor,
'#VALUE!' AS pmt, '#VALUE!' AS fv, '#VALUE!' AS weekday, '#VALUE!' AS year, CASE WHEN p_size > 3 THEN '#NUM!' END AS large, CASE WHEN p_size > 3 THEN '#NUM!' END AS small, '#VALUE!' AS sumproduct, '#VALUE!' AS replace, CASE WHEN d = 0 THEN '#DIV/0!' END AS substitute, CASE WHEN d = 0 THEN '#DIV/0!' END AS textjoin,
CASE WHEN p_size > 2 THEN '#VALUE!' END AS choose, CASE WHEN p_size <> 7 THEN '#N/A' END AS switch, CASE WHEN d <= 0 THEN '#N/A' END AS ifs, CASE WHEN instr(p_name, 'e') = 0 THEN '#VALUE!' END AS find, '#N/A' AS mode, '#N/A' AS stdev, NULL::VARCHAR AS iferror, '#VALUE!' AS edate, '#NAME?' AS name, '#REF!' AS ref, '#PARSE!' AS parse
FROM (SELECT *, p_size - 10 AS d FROM part)""")
def formula_error_codes(t: Tables):
    d = "([p_size]-10)"
    fs = {"div": f"1/{d}", "root": f"SQRT{d}", "ln": f"LN{d}", "log10": f"LOG10{d}", "mod": f"MOD(7,{d})", "ceil": f"CEILING(7,{d})", "floor": f"FLOOR(7,{d})", "pmt": "PMT([p_name],12,100)", "fv": "FV(0.1,[p_name],100)", "weekday": "WEEKDAY([p_name])", "year": "YEAR([p_name])"}
    fs |= {"large": "LARGE([p_retailprice],IF([p_size]>3,[p_size],1))", "small": "SMALL([p_retailprice],IF([p_size]>3,[p_size],1))", "sumproduct": "SUMPRODUCT(1/0,[p_size])", "replace": 'REPLACE([p_name],"x",1,"z")', "substitute": f'SUBSTITUTE([p_name],"a",1/{d})', "textjoin": f'TEXTJOIN("-",1,[p_name],1/{d})', "choose": "CHOOSE([p_size],1,2)", "switch": "SWITCH([p_size],7,1)", "ifs": f"IFS({d}>0,1)"}
    fs |= {"find": 'FIND("e",[p_name])', "mode": "MODE([p_size],[p_size]+1)", "stdev": "STDEV([p_size])", "iferror": f"IFERROR(1/{d},0)", "edate": "EDATE([p_name],1)", "name": "FOO([p_size])", "ref": "[none]+1", "parse": "1+"}
    return with_formulas(t.part, fs, errors=True).select("p_partkey", *[F.col(f"{n}_err").alias(n) for n in fs])


@query("""SELECT l_orderkey, l_linenumber, floor(l_extendedprice / 3 * 10) / 10 AS rounddown, round(power(l_quantity, 1.5), 6) AS power, greatest(l_quantity, 10.0) AS large1, least(l_quantity, 10.0) AS small1, CASE WHEN l_quantity = 10 THEN 10.0::DOUBLE END AS mode, round(stddev_samp2, 6) AS stdev, l_shipmode_ || l_returnflag AS concat, l_quantity::BIGINT::VARCHAR AS text, l_quantity AS value, 2.0::DOUBLE AS count
FROM (SELECT *, sqrt((l_quantity - 10) * (l_quantity - 10) / 2) AS stddev_samp2, l_linestatus AS l_shipmode_ FROM lineitem)""")
def formula_stats(t: Tables):
    fs = {"rounddown": "ROUNDDOWN([l_extendedprice]/3,1)", "power": "POWER([l_quantity],1.5)", "large1": "LARGE([l_quantity],1)", "small1": "SMALL([l_quantity],1)", "mode": "MODE([l_quantity],10)", "stdev": "STDEV([l_quantity],10)", "concat": "CONCAT([l_linestatus],[l_returnflag])", "text": "TEXT([l_quantity])", "value": 'VALUE([l_quantity]&"")', "count": 'COUNT([l_quantity],"x",3)'}
    fs |= {"large1": "IF(LARGE([l_quantity],1)>10,LARGE([l_quantity],1),10)", "small1": "IF(SMALL([l_quantity],1)<10,SMALL([l_quantity],1),10)"}
    out = with_formulas(t.lineitem, fs).select("l_orderkey", "l_linenumber", *fs)
    return out.withColumns({"power": F.round("power", 6), "stdev": F.round("stdev", 6)})


@query("SELECT n_nationkey, n_name || chr(9) || n_regionkey AS line, n_regionkey::BIGINT AS back FROM nation")
def bridge_sheet_text(t: Tables):
    """A sheet's rows as tab-separated lines, and read back."""
    lines = t.nation.select("n_nationkey", F.concat_ws("\t", "n_name", F.col("n_regionkey").cast("string")).alias("line"))
    return lines.select("n_nationkey", "line", F.split("line", "\t")[1].cast("long").alias("back"))


@query("SELECT doc_id, lang, source FROM documents")
def model_json_round_trip(t: Tables):
    """Documents as model JSON and back, whole texts included: rows whose text changed would be missing."""
    kind = "doc_id long, lang string, source string, text string"
    raw = t.documents.select("text", F.to_json(F.struct("doc_id", "lang", "source", "text")).alias("json"))
    back = raw.select(F.col("text").alias("old"), F.from_json("json", kind).alias("m"))
    return back.where("old <=> m.text").select("m.doc_id", "m.lang", "m.source")


@query("SELECT event_id, len(json_keys(props)) + 1 AS n, 7::BIGINT AS put, json_extract_string(props, '$.k') AS k FROM events")
def json_put(t: Tables):
    """props with a key put in: nested values stay as their JSON text."""
    put = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("put_in"), F.lit("7")))
    return t.events.select("event_id", F.size(put).cast("long").alias("n"), put["put_in"].cast("long").alias("put"), put["k"].alias("k"))
