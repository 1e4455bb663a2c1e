"""Text analytics over documents, pages and conversations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[A-Za-z\x{80}-\x{10FFFF}]+(?:'[A-Za-z\x{80}-\x{10FFFF}]+)*"


def tokens(c: Column) -> Column:
    """Runs of letters and non-ASCII characters, apostrophes inside kept."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, n): words in lower-case ASCII letters, counted before and after the shuffle."""
    return df.select(F.explode(tokens(ascii_lower(F.col(text)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def unknown_words(counts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """counts without the dictionary's words."""
    return counts.join(dictionary.select("word"), "word", "left_anti")


def suggest(words: DataFrame, dictionary: DataFrame, most: int = 3) -> DataFrame:
    """(word, suggestion, dist, rn): nearest dictionary words (word, ord), one edit apart for words up to four letters, else two.

    Words that one deletion or two can make equal share a key, so only likely pairs meet.
    """
    limit = F.when(F.length("word") <= 4, 1).otherwise(2)
    w = words.select("word", limit.alias("k")).select("word", "k", F.explode(deletions(F.col("word"))).alias("key"))
    d = dictionary.select(F.col("word").alias("suggestion"), "ord").select("suggestion", "ord", F.explode(deletions(F.col("suggestion"))).alias("key"))
    pairs = w.join(d, "key").select("word", "k", "suggestion", "ord").distinct()
    pairs = pairs.withColumn("dist", F.levenshtein("word", "suggestion")).where("dist <= k")
    rank = F.row_number().over(Window.partitionBy("word").orderBy("dist", "ord"))
    return pairs.withColumn("rn", rank).where(F.col("rn") <= most).select("word", "suggestion", "dist", "rn")


def deletions(c: Column) -> Column:
    """A word and what is left of it after one or two deletions."""

    def one(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.left(s, i - 1), s.substr(i + 1, F.length(s))))

    ones = one(c)
    return F.array_distinct(F.concat(F.array(c), ones, F.flatten(F.transform(ones, one))))


# Misspellings and what they stand for.
MISSPELLINGS = {
    "alot": "a lot", "definately": "definitely", "seperate": "separate", "recieve": "receive", "occured": "occurred", "untill": "until", "wich": "which", "teh": "the",
    "adress": "address", "calender": "calendar", "freind": "friend", "suprise": "surprise", "goverment": "government", "begining": "beginning", "neccessary": "necessary",
}


def grammar_counts(text: Column) -> dict[str, Column]:
    """Findings per rule: doubled words, a before a vowel, an before a consonant, double blanks or stops, misspellings.

    Words are runs of ASCII letters, in any case; a doubled word follows its like after white space only.
    """
    runs = F.regexp_extract_all(ascii_lower(text), F.lit(r"[a-z]+|[^a-z \t\n\r\f\x0b]+"), F.lit(0))
    next_ = F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0)))
    pairs = F.zip_with(runs, next_, lambda x, y: F.coalesce(x == y, F.lit(False)) & x.rlike("^[a-z]"))
    return {
        "doubled": F.size(F.filter(pairs, lambda x: x)),
        "a_vowel": F.regexp_count(text, F.lit(r"(?<![A-Za-z0-9_])[Aa] [aeiouAEIOU]")),
        "an_consonant": F.regexp_count(text, F.lit(r"(?<![A-Za-z0-9_])[Aa]n [b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]")),
        "double_space": F.regexp_count(text, F.lit(r"  +|\.\.")),
        "misspelled": F.size(F.filter(runs, lambda x: x.isin(*MISSPELLINGS))),
    }


#: Rule -> the pattern of a finding, for grammar_findings; misspellings are told by their words.
_RULES = {
    "doubled": r"(?i)(?<![A-Za-z])([a-z]+)(?=[ \t\n\r\f\x0b]+\1(?![A-Za-z]))",
    "a_vowel": r"(?<![A-Za-z0-9_])[Aa] (?=[aeiouAEIOU])",
    "an_consonant": r"(?<![A-Za-z0-9_])[Aa]n (?=[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z])",
    "double_space": r"  +|\.\.",
    "misspelled": r"(?i)(?<![A-Za-z])(?:" + "|".join(MISSPELLINGS) + r")(?![A-Za-z])",
}


def grammar_findings(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, rule, start, length, advice) of every finding, starts from 1 in characters. SQL has no places of matches."""
    import pyarrow as pa

    schema = pa.schema([(id_col, pa.int64()), ("rule", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("advice", pa.string())])
    rules = {k: re.compile(p) for k, p in _RULES.items()}

    def run(batches):
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = [(i, k, m.start() + 1, m.end() - m.start(), MISSPELLINGS.get(m[0].lower())) for k, p in rules.items() for m in p.finditer(t or "")]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), schema)], schema=schema)

    return df.select(F.col(id_col).cast("long"), text).mapInArrow(run, f"{id_col} long, rule string, start int, length int, advice string")


def line_stats(text: Column) -> dict[str, Column]:
    return {"lines": F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, "chars": F.length(text), "words": F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))}


def find_count(text: Column, needle: str) -> Column:
    """Occurrences of a text that is not empty, not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def find_in_context(df: DataFrame, id_col: str, text: str, needle: str, before: int = 40, after: int = 60) -> DataFrame:
    """(id, at, line, context) of each occurrence, not overlapping, positions from 1.

    An Arrow map that carries place and line from one occurrence to the next: SQL functions have no
    places of matches but by counting anew what stands before each.
    """
    import pyarrow as pa

    types = dict(df.dtypes)
    n = len(needle)

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            rows, at_, line_, context_ = [], [], [], []

            def flush():
                out = [ids.take(pa.array(rows)), pa.array(at_, pa.int32()), pa.array(line_, pa.int32()), pa.array(context_, pa.string())]
                for x in (rows, at_, line_, context_):
                    x.clear()
                return pa.RecordBatch.from_arrays(out, names=[id_col, "at", "line", "context"])

            for k, t in enumerate(texts):
                at, line, last = t.find(needle), 1, 0
                while at >= 0:
                    line += t.count("\n", last, at)
                    rows.append(k)
                    at_.append(at + 1)
                    line_.append(line)
                    context_.append(t[max(at - before, 0) : at + n + after])
                    last, at = at, t.find(needle, at + n)
                    if len(rows) >= 20_000:
                        yield flush()
            if rows:
                yield flush()

    held = df.where(F.contains(F.col(text), F.lit(needle))).select(id_col, text)
    return held.mapInArrow(run, f"`{id_col}` {types[id_col]}, at int, line int, context string")


def book_index(docs: DataFrame, id_col: str, text: str, terms: DataFrame) -> DataFrame:
    """(term, id), distinct: every document that contains each word of terms (column term). Words meet by key, not pairwise."""
    words = docs.select(id_col, F.explode(F.array_distinct(tokens(ascii_lower(F.col(text))))).alias("term"))
    hits = words.join(F.broadcast(terms) if terms.count() <= 100_000 else terms, "term")
    return hits.select("term", id_col).distinct()


def script_tag(text: Column) -> Column:
    """The script of the first mapped non-ASCII character; en for plain ASCII, und for others."""
    ranges = {"ru": r"Ѐ-ӿ", "el": r"Ͱ-Ͽ", "he": r"֐-׿", "ar": r"؀-ۿ", "hi": r"ऀ-ॿ", "ja": r"぀-ヿ", "zh": r"一-鿿", "ko": r"가-힯", "th": r"฀-๿"}
    first = F.regexp_extract(text, "[" + "".join(ranges.values()) + "]", 0)
    out = F.when(text.rlike(r"[^\x00-\x7F]"), "und").otherwise("en")
    for tag, r in ranges.items():
        out = F.when(first.rlike(f"[{r}]"), tag).otherwise(out)
    return out


def redact(text: Column, pattern: str, sign: str = "█") -> Column:
    """Each character of what matches (not the empty text) becomes a block."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.repeat(F.lit(sign), F.length(m)))
    kept = F.split(text, pattern, -1)
    pieces = F.zip_with(kept, found, lambda k, m: F.concat(k, F.coalesce(m, F.lit(""))))
    return F.when(text == "", text).otherwise(F.array_join(pieces, ""))


def redact_range(text: Column, start: int, length: int, sign: str = "█") -> Column:
    """The characters from start (from 1) on become blocks; null where the range leaves the text."""
    inside = (F.lit(start) >= 1) & (F.lit(length) >= 0) & (F.length(text) >= start + length - 1)
    return F.when(inside, F.overlay(text, F.lit(sign * length), F.lit(start), F.lit(length)))


def summary(text: Column, most: int = 3) -> Column:
    """The first sentence of each of the first paragraphs that are not blank."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.array_join(F.transform(F.slice(lines, 1, most), lambda x: F.trim(F.regexp_extract(x, r"^[^.]*\.?", 0))), " ")


def expand(template: str, fields: dict[str, Column]) -> Column:
    """${name} and {name} replaced by columns in one pass over the template, unknown names kept."""
    parts, at = [], 0
    for m in re.finditer(r"\$\{([^{}]*)\}|\{([^{}]*)\}", template):
        name = m[1] if m[1] is not None else m[2]
        if name in fields:
            parts += [F.lit(template[at : m.start()]), F.coalesce(fields[name].cast("string"), F.lit(""))]
            at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def mail_message(to: Column, sender: Column, subject: Column, date: Column, body: Column) -> Column:
    """A message with its headers, a blank line and the whole body."""
    return F.concat(F.lit("To: "), to, F.lit("\r\nFrom: "), sender, F.lit("\r\nSubject: "), subject, F.lit("\r\nDate: "), date, F.lit("\r\n\r\n"), body)


def strip_markup(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]*(>|$)", "")


def headings(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id, ord, level, title) of h1 to h6, in order."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<h[1-6][^>]*>.*?</h[1-6]>"), F.lit(0))
    rows = pages.select(id_col, F.posexplode(found).alias("pos", "h"))
    return rows.select(id_col, (F.col("pos") + 1).alias("ord"), F.substring("h", 3, 1).cast("int").alias("level"), F.trim(strip_markup(F.col("h"))).alias("title"))


def accessibility(html: Column) -> dict[str, Column]:
    """Rules over a page: no title, no language, images without a text, no top heading."""
    images, with_alt = F.regexp_count(html, F.lit(r"(?i)<img[ />]")), F.regexp_count(html, F.lit(r"(?i)<img[^>]* alt="))
    return {"no_title": ~html.rlike(r"(?i)<title[^>]*>[^<]"), "no_lang": ~html.rlike(r"(?i)<html[^>]* lang="), "images_without_alt": images - with_alt, "no_h1": ~html.rlike(r"(?i)<h1[ >]")}


def outline(blocks: DataFrame, id_col: str) -> DataFrame:
    """A table of contents from headings: two blanks of indent a level, ten at most."""
    return blocks.select(id_col, "ord", F.concat(F.repeat(F.lit(" "), F.least(2 * (F.col("level") - 1), F.lit(10))), F.left("title", F.lit(70))).alias("entry"))


def markdown_blocks(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, idx, kind, level, text) of each line that is not blank: headings (three levels), list items, table rows, paragraphs."""
    rows = docs.select(id_col, F.posexplode(F.split(F.col(text), "\n")).alias("idx", "line")).where(F.trim("line") != "")
    marks = F.length(F.regexp_extract("line", r"^(#+) ", 1))
    kind = F.when(marks > 0, "heading").when(F.col("line").rlike(r"^\s*[-*] "), "item").when(F.col("line").contains(" | "), "row").otherwise("paragraph")
    body = F.regexp_replace(F.regexp_replace("line", r"^(#+ |\s*[-*] )", ""), r"\*\*", "")
    return rows.select(id_col, "idx", kind.alias("kind"), F.least(marks, F.lit(3)).alias("level"), body.alias("text"))
