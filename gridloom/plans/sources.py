"""Queries that write and read files: round trips through the shared folder."""

import uuid

from pyspark.sql import functions as F

from ..operators import text
from ..sources import files
from .blocks import MARKDOWN_LINES
from .registry import Tables, query


def folder(t: Tables, name: str) -> str:
    base = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/gridloom/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(t: Tables):
    path, df = folder(t, "csv"), t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    files.write_csv(df, path)
    return files.read_csv(t.spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def tsv_round_trip(t: Tables):
    path = folder(t, "tsv")
    files.write_csv(t.nation.select("n_nationkey", "n_name", "n_regionkey"), path, sep="\t")
    return files.read_csv(t.spark, path, "n_nationkey int, n_name string, n_regionkey int", sep="\t", lines=True)


@query("SELECT item_id, text FROM benchmark")
def json_lines_round_trip(t: Tables):
    path = folder(t, "json")
    files.write_json_lines(t.benchmark.select("item_id", "text"), path)
    return files.read_json_lines(t.spark, path, "item_id long, text string")


@query("SELECT event_id, try_cast(props ->> '$.k' AS BIGINT) AS k FROM events")
def json_props(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT event_type, count(*) AS n, sum(try_cast(props ->> '$.k' AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type")
def json_struct(t: Tables):
    k = F.from_json("props", "k long")["k"]
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@query("SELECT 'Data' AS sheet, n_nationkey + 1 AS row, n_name AS text FROM nation")
def xlsx_scan(t: Tables):
    """nation as a workbook of the shared folder, written by the driver (25 rows) and read by tasks."""
    rows = t.nation.orderBy("n_nationkey").select("n_name", "n_regionkey").collect()
    raw = files.xlsx_bytes({"Data": [[r["n_name"], r["n_regionkey"]] for r in rows]})
    path = folder(t, "xlsx")
    jvm = t.spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/book.xlsx")
    out = p.getFileSystem(t.spark._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(raw))
    out.close()
    return files.read_xlsx(t.spark, path).where("col = 1").select("sheet", "row", "text")


def workbook_round_trip(t: Tables, kind: str, read):
    """customer as workbooks, written and read back by tasks; each row from its cells."""
    path = folder(t, kind)
    files.write_workbooks(t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path, kind, rows_each=10_000)

    def at(col: int, what: str):
        return F.max(F.when(F.col("col") == col, F.col(what)))

    cells = read(t.spark, path).where("row > 1").groupBy("path", "row")
    rows = cells.agg(at(1, "num").cast("long").alias("c_custkey"), at(2, "text").alias("c_name"), at(3, "num").alias("c_acctbal"), at(4, "text").alias("c_mktsegment"))
    return rows.drop("path", "row")


@query("SELECT c_custkey::BIGINT AS c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def xlsx_round_trip(t: Tables):
    return workbook_round_trip(t, "xlsx", files.read_xlsx)


@query("SELECT c_custkey::BIGINT AS c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def ods_round_trip(t: Tables):
    return workbook_round_trip(t, "ods", files.read_ods)


@query(f"""WITH l AS ({MARKDOWN_LINES}) SELECT doc_id, string_agg(CASE kind WHEN 'heading' THEN repeat('#', level::INT) || ' ' || text WHEN 'item' THEN '- ' || text ELSE text END, chr(10) ORDER BY idx) AS markdown FROM l GROUP BY doc_id""")
def markdown_write(t: Tables):
    return files.to_markdown(text.markdown_blocks(t.documents, "doc_id", "text"), "doc_id")


@query("SELECT sum(c)::BIGINT AS cells FROM (SELECT 3 * count(*) AS c FROM region UNION ALL SELECT 0)")
def cells_of_table(t: Tables):
    """A table as a sparse long table of cells, header included; empty cells are left out."""
    wide = t.region.select("r_regionkey", *[F.col(c).cast("string").alias(f"v_{c}") for c in t.region.columns], F.lit("x").alias("v_extra"))
    return wide.unpivot("r_regionkey", [c for c in wide.columns if c.startswith("v_")], "col", "text").where("text is not null").agg(F.count("*").alias("cells"))


@query("SELECT 'html' AS kind, count(*) AS n FROM pages WHERE starts_with(html, '<!DOC') OR starts_with(html, '<html') UNION ALL SELECT 'text', count(*) FROM pages WHERE NOT (starts_with(html, '<!DOC') OR starts_with(html, '<html')) HAVING count(*) > 0")
def format_sniff(t: Tables):
    head = t.pages.select(F.encode(F.left("html", F.lit(8)), "UTF-8").alias("content"))
    return head.groupBy(files.format_of().alias("kind")).agg(F.count("*").alias("n"))
