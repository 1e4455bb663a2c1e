"""Blocks of documents and pages: HTML and Markdown in and out, numbering, citations, word lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import strip_markup

# The elements that are blocks, and the shape of one.
BLOCK = r"(?is)<(?:h[1-6]|p|li|tr)(?:\s[^>]*)?>.*?</(?:h[1-6]|p|li|tr)>"
CELL = r"(?is)<t[dh](?:\s[^>]*)?>.*?</t[dh]>"
#: Block kind -> what stands before and after its text, by format; @ is a heading's level.
STYLES = {
    "html": {"heading": ("<h@>", "</h@>"), "item": ("<li>", "</li>"), "row": ("<tr><td>", "</td></tr>"), "paragraph": ("<p>", "</p>")},
    "latex": {"heading": (r"\section{", "}"), "item": (r"\item ", ""), "row": ("", r" \\"), "paragraph": ("", "")},
    "tei": {"heading": ("<head>", "</head>"), "item": ("<item>", "</item>"), "row": ("<row>", "</row>"), "paragraph": ("<p>", "</p>")},
    "text": {"heading": ("", ""), "item": ("- ", ""), "row": ("", ""), "paragraph": ("", "")},
}


def html_blocks(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id, idx, kind, bold, text) of each heading, paragraph, list item and table row, in order.

    A br is a blank; a row's cells are joined by ' | '; text outside blocks is dropped. Null pages have none.
    """
    found = pages.select(id_col, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(BLOCK), F.lit(0))).alias("idx", "b"))
    kind = F.lower(F.regexp_extract("b", r"^<([A-Za-z]+[1-6]?)", 1))
    cells = F.transform(F.regexp_extract_all("b", F.lit(CELL), F.lit(0)), lambda c: F.trim(strip_markup(c)))
    plain = F.trim(strip_markup(F.regexp_replace("b", r"(?i)<br\s*/?>", " ")))
    text = F.when(kind == "tr", F.array_join(cells, " | ")).otherwise(plain)
    return found.select(id_col, "idx", kind.alias("kind"), F.col("b").rlike(r"(?i)<(?:b|strong)[ >]").alias("bold"), text.alias("text"))


def markdown_cells(blocks: DataFrame, id_col: str) -> DataFrame:
    """(id, idx, col, text) of the cells of Markdown table rows (blocks of kind row); rules of dashes are left out."""
    inner = F.regexp_replace(F.trim("text"), r"^\||\|$", "")
    rows = blocks.where("kind = 'row'").select(id_col, "idx", F.posexplode(F.split(inner, r"\|")).alias("col", "c"))
    return rows.select(id_col, "idx", (F.col("col") + 1).alias("col"), F.trim("c").alias("text")).where(~F.col("text").rlike("^:?-+:?$"))


def escaped(c: Column) -> Column:
    """The signs of markup as entities."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def render(blocks: DataFrame, id_col: str, style: str) -> DataFrame:
    """(id, out): a document's blocks (id, idx, kind, level, text) as lines of a format of STYLES."""
    body = escaped(F.col("text")) if style in ("html", "tei") else F.col("text")

    def sign(x: str) -> Column:
        return F.replace(F.lit(x), F.lit("@"), F.col("level").cast("string"))

    out = F.lit(None).cast("string")
    for kind, (before, after) in STYLES[style].items():
        out = F.when(F.col("kind") == kind, F.concat(sign(before), body, sign(after))).otherwise(out)
    lines = F.array_sort(F.collect_list(F.struct("idx", out.alias("line"))))  # a document's own blocks
    return blocks.groupBy(id_col).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("out"))


def numbered(df: DataFrame, group: str, order: str, name: str = "number") -> DataFrame:
    """df with the number of each row within its group: of headings, equations, sections."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(order)))


def enforce_headings(headings: DataFrame, id_col: str) -> DataFrame:
    """Headings (id, ord, level, title) with level n for the nth section, six at most."""
    return numbered(headings, id_col, "ord", "n").withColumn("level", F.least("n", F.lit(6))).drop("n")


def heading_skips(headings: DataFrame, id_col: str) -> DataFrame:
    """(id, ord, level, before) of headings more than one level below the heading before; the first follows level 0."""
    w = Window.partitionBy(id_col).orderBy("ord")
    return headings.withColumn("before", F.coalesce(F.lag("level").over(w), F.lit(0))).where("level > before + 1").select(id_col, "ord", "level", "before")


def find_next(lines: DataFrame, group: str, order: str, line: str, needle: str, after: int) -> DataFrame:
    """(group, hit): the next line after `after` that holds the needle, from the beginning again if there is none."""
    held = lines.where(F.contains(F.col(line), F.lit(needle)))
    later = F.min(F.when(F.col(order) > after, F.col(order)))
    return held.groupBy(group).agg(F.coalesce(later, F.min(order)).alias("hit"))


def cite_inline(authors: Column, year: Column) -> Column:
    """(Surname, year): the last word of the authors, ? without one."""
    surname = F.regexp_extract(authors, r"([^ ]+) *$", 1)
    return F.concat(F.lit("("), F.when(surname == "", "?").otherwise(surname), F.lit(", "), year.cast("string"), F.lit(")"))


def bibliography_line(number: Column, authors: Column, title: Column, kind: Column) -> Column:
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), authors, F.lit(". "), title, F.lit(". "), kind, F.lit("."))


def synonyms(words: DataFrame, entries: DataFrame) -> DataFrame:
    """(word, synonyms): words looked up in any case; of several entries (word, ord, synonyms) of a word the last counts."""
    last = entries.groupBy(F.lower("word").alias("key")).agg(F.max_by("synonyms", "ord").alias("synonyms"))
    return words.withColumn("key", F.lower("word")).join(last, "key").select("word", "synonyms")


def wrap(text: Column, width: int) -> Column:
    """Greedy word wrap: words at single blanks, lines of at most `width` characters unless a word is longer.

    State is the array of lines so far and the open line, so the cost follows the number of lines.
    """
    words = F.filter(F.split(text, " "), lambda w: w != "")

    def add(s: Column, w: Column) -> Column:
        fits = (F.length(s["open"]) == 0) | (F.length(s["open"]) + 1 + F.length(w) <= width)
        longer = F.when(s["open"] == "", w).otherwise(F.concat(s["open"], F.lit(" "), w))
        return F.struct(F.when(fits, s["lines"]).otherwise(F.array_append(s["lines"], s["open"])).alias("lines"), F.when(fits, longer).otherwise(w).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("open"))
    return F.aggregate(words, start, add, lambda s: F.array_join(F.array_append(s["lines"], s["open"]), "\n"))


def is_rtl(text: Column) -> Column:
    """Whether a Hebrew or Arabic letter occurs."""
    return text.rlike(r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]")


def is_math_line(line: Column) -> Column:
    """At least two of: a relation or operator between terms, a Greek letter or mathematical sign, a fraction, balanced brackets."""
    signs = [r"[A-Za-z0-9)] *[=+*/^<>-] *[A-Za-z0-9(]", r"[\x{0370}-\x{03FF}\x{2200}-\x{22FF}]", r"[0-9]+/[0-9]+", r"\([^()]*\)"]
    return sum((line.rlike(p).cast("int") for p in signs[1:]), line.rlike(signs[0]).cast("int")) >= 2


def normalised(df: DataFrame, id_col: str, text: str, form: str = "NFC") -> DataFrame:
    """(id, text) in a Unicode normal form. Spark SQL has none, so this is an Arrow map."""
    import unicodedata

    import pyarrow as pa

    def run(batches):
        for b in batches:
            out = [None if t is None else unicodedata.normalize(form, t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[id_col, "text"])

    return df.select(id_col, F.col(text).alias("text")).mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, text string")


def majority(df: DataFrame, group: str, tag: str) -> DataFrame:
    """(group, tag, votes): the most frequent tag of each group, of equally frequent ones the smallest."""
    votes = df.groupBy(group, tag).agg(F.count("*").alias("votes"))
    best = F.min(F.struct((-F.col("votes")).alias("n"), tag)).alias("b")  # most votes, then the smallest tag
    return votes.groupBy(group).agg(best).select(group, F.col(f"b.{tag}").alias(tag), (-F.col("b.n")).alias("votes"))


def character_accuracy(truth: Column, got: Column) -> Column:
    """Share of the truth's characters that stand at the same place in what was got; 1 for two empty texts."""
    same = F.filter(F.arrays_zip(F.split(truth, "").alias("a"), F.split(got, "").alias("b")), lambda p: (p["a"] == p["b"]) & (p["a"] != ""))
    return F.when(F.length(truth) == 0, (F.length(got) == 0).cast("double")).otherwise(F.size(same) / F.length(truth))
