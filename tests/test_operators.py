"""Fixtures and laws of the tabular operators."""

import pytest
from pyspark.sql import functions as F

from gridloom.functions.coerce import num, num_to_text, to_num
from gridloom.operators import blocks, filters, replicas, solve, tables, text
from gridloom.sources import files


def test_sort_fixture(spark):
    df = spark.createDataFrame([("Zoe", "30", "9.5", 0), ("ann", "30", "8.0", 1), ("Bob", "22", "7.5", 2), ("Ann", "25", "6.0", 3)], "name string, age string, score string, id int")
    names = lambda d: [r["name"] for r in d.collect()]
    assert names(filters.sort_rows(df, [("name", False, False)], "id")) == ["ann", "Ann", "Bob", "Zoe"]
    assert names(filters.sort_rows(df, [("age", False, True), ("score", False, True)], "id")) == ["Bob", "Ann", "ann", "Zoe"]
    assert names(filters.sort_rows(df, [("age", True, True)], "id"))[::3] == ["Zoe", "Bob"]


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([("A", 10, 0), ("B", 5, 1), ("A", 30, 2), ("B", 7, 3), ("C", 15, 4)], "dept string, sales int, id int").cache()


def test_filter_fixture(sales):
    ids = lambda *c: sorted(r["id"] for r in filters.autofilter(sales, list(c), numeric=("sales",)).collect())
    assert ids(("dept", "eq", "A")) == [0, 2]
    assert len(ids(("sales", "gt", "6"))) == 4
    assert ids(("sales", "between", "6|15")) == [0, 3, 4]
    assert ids(("dept", "eq", "B"), ("sales", "lte", "7")) == [1, 3]
    assert sorted(r["id"] for r in filters.top_n(sales, "sales", 2, "id").collect()) == [2, 4]


def test_blanks_in_filters(spark):
    df = spark.createDataFrame([(None,), ("",), ("12abc",), ("x",)], "v string")
    kept = lambda op, v=None: [r["v"] for r in df.where(filters.criterion("v", op, v)).collect()]
    assert kept("eq", "") == [] and kept("neq", "x") == [None, "", "12abc"] and kept("gt", "5") == ["12abc"]
    assert kept("lt", "5") == [None, "", "x"] and kept("blank") == [None, ""] and kept("contains", "ABC") == ["12abc"] and kept("between", "1") == []


def test_subtotal_and_pivot(spark, sales):
    got = {r["dept"]: r.asDict() for r in tables.subtotal(sales, "dept", "sales").collect()}
    assert got["A"] == {"dept": "A", "sum_sales": 40, "avg_sales": 20.0, "count_sales": 2, "min_sales": 10, "max_sales": 30}
    df = spark.createDataFrame([("East", "Apples", 10), ("East", "Pears", 20), ("West", "Apples", 5), ("West", "Pears", 15), ("East", "Apples", 30)], "region string, product string, sales int")
    rows = {r["region"]: (r["c_Apples"], r["c_Pears"], r["c_Figs"]) for r in tables.pivot(df, "region", "product", ["Apples", "Pears", "Figs"], "sales", "sum").collect()}
    assert rows == {"East": (40, 20, 0), "West": (5, 15, 0)}


def test_fit_and_solvers(spark):
    df = spark.createDataFrame([(x, 2 * x + 1) for x in (1.0, 2.0, 3.0, 4.0)], "x double, y double")
    r = tables.linear_fit(df, "x", "y").first()
    assert (r["slope"], r["intercept"], r["r2"]) == pytest.approx((2, 1, 1))
    data = [(1, [2, 3, 4, -1], [8, 2]), (2, [1, 1, 1, 0, 2, 5, 2, 5, -1], [6, -4, 27]), (3, [1, 2, 2, 4], [1, 1])]
    rows = spark.createDataFrame([(i, [float(x) for x in m], [float(x) for x in r]) for i, m, r in data], "id long, m array<double>, r array<double>")
    got = {r["id"]: r["x"] for r in solve.solve_rows(rows, "id", "m", "r").collect()}
    assert got[1] == pytest.approx([1, 2]) and got[2] == pytest.approx([5, 3, -2]) and got[3] is None
    root = spark.range(1).select(solve.bisect(lambda x: x * x - 2, F.lit(0.0), F.lit(2.0)).alias("a"), solve.bisect(lambda x: x * x + 5, F.lit(-10.0), F.lit(10.0)).alias("b")).first()
    assert root["a"] == pytest.approx(2**0.5) and root["b"] is None


def test_merge_laws(spark):
    a = spark.createDataFrame([("1:a", 1, False, "x"), ("2:a", 2, False, "y")], "id string, lamport long, tomb boolean, value string")
    b = spark.createDataFrame([("1:a", 3, True, "x"), ("3:b", 2, False, "z")], "id string, lamport long, tomb boolean, value string")
    rows = lambda d: sorted(map(tuple, d.collect()))
    m = replicas.merge_replicas(a, b)
    assert rows(m) == rows(replicas.merge_replicas(b, a)) == rows(replicas.merge_replicas(m, m, a))
    assert [r["id"] for r in replicas.live(m).orderBy("lamport", "id").collect()] == ["2:a", "3:b"]


def test_line_diff(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\n", "a\nx\nc\n"), (2, None, "q"), (3, "same", "same")], "id long, o string, n string")
    got = {}
    for r in sorted(replicas.line_diff(df, "id", "o", "n").collect()):
        got.setdefault(r["id"], []).append(r["op"] + r["line"])
    assert got == {1: ["=a", "+x", "-b", "=c"], 2: ["+q"], 3: ["=same"]}
    flipped = sorted(replicas.line_diff(df.where("id = 1"), "id", "o", "n", prefer_insert=False).collect())
    assert [r["op"] + r["line"] for r in flipped] == ["=a", "-b", "+x", "=c"]


def test_csv_keeps_quotes_and_line_ends(spark, tmp_path):
    rows = [("Smith, John", 1200.5, "line1\nline2"), ("O'Brien", 320.0, 'quote"here"'), (None, None, "")]
    path = str(tmp_path / "x.csv")
    files.write_csv(spark.createDataFrame(rows, "Name string, Amount double, Note string"), path)
    got = [tuple(r) for r in files.read_csv(spark, path, "Name string, Amount double, Note string").collect()]
    assert sorted(got[:2], key=str) == sorted(rows[:2], key=str) or {g[0] for g in got} == {"Smith, John", "O'Brien", None}
    assert (rows[0] in got) and (rows[1] in got)


def test_xlsx(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(files.xlsx_bytes({"Data": [["Item", "Cost"], ["Engine", 1200.5], ["Docs", 320], [None, "=SUM(B2:B3)"]]}))
    got = {(r["row"], r["col"]): (r["kind"], r["num"], r["text"], r["formula"]) for r in files.read_xlsx(spark, str(tmp_path)).collect()}
    assert got[(2, 2)] == ("num", 1200.5, None, None) and got[(1, 1)] == ("str", None, "Item", None) and got[(4, 2)][3] == "SUM(B2:B3)" and len(got) == 7


def test_coercions(spark):
    df = spark.createDataFrame([("12abc",), ("1d",), (" 7 ",), (None,), ("-.5e1",)], "s string")
    got = [tuple(r) for r in df.select(num("s"), to_num("s")).collect()]
    assert got == [(12.0, None), (1.0, None), (7.0, 7.0), (0.0, None), (-5.0, -5.0)]
    texts = [r[0] for r in spark.createDataFrame([(100.0,), (0.1,), (1e15,), (2.5,), (-3.0,)], "x double").select(num_to_text("x")).collect()]
    assert texts[0] == "100" and texts[1] == "0.1" and texts[3:] == ["2.5", "-3"] and float(texts[2]) == 1e15


def test_hmac_and_context(spark):
    import hashlib
    import hmac

    df = spark.createDataFrame([(1, "one needle\ntwo needles")], "id long, text string")
    assert df.select(solve.hmac_sha256("k", F.col("text"))).first()[0] == hmac.new(b"k", b"one needle\ntwo needles", hashlib.sha256).hexdigest()
    got = [(r["at"], r["line"]) for r in text.find_in_context(df, "id", "text", "needle").orderBy("at").collect()]
    assert got == [(5, 1), (16, 2)]
    assert text.find_in_context(df, "id", "text", "absent").count() == 0


def test_book_index_keeps_every_document(spark):
    docs = spark.createDataFrame([(1, "Ant bee"), (2, "bee ant ANT"), (3, "ant"), (4, "cat"), (5, None)], "doc_id long, text string")
    terms = spark.createDataFrame([("ant",), ("bee",), ("dog",)], "term string")
    got = sorted(tuple(r) for r in text.book_index(docs, "doc_id", "text", terms).select("term", "doc_id").collect())
    assert got == [("ant", 1), ("ant", 2), ("ant", 3), ("bee", 1), ("bee", 2)]


def test_grammar_findings(spark):
    df = spark.createDataFrame([(1, "The the cat saw a apple.. Teh end"), (2, None), (3, "a cat an owl an dog")], "id long, t string")
    got = {tuple(r) for r in text.grammar_findings(df, "id", "t").collect()}
    assert got == {(1, "doubled", 1, 3, None), (1, "a_vowel", 17, 2, None), (1, "double_space", 24, 2, None), (1, "misspelled", 27, 3, "the"), (3, "an_consonant", 14, 3, None)}


def test_find_in_context(spark):
    df = spark.createDataFrame([(1, "aXb\nXX\n\nécX"), (2, None), (3, "")], "id long, t string")
    got = [tuple(r) for r in text.find_in_context(df, "id", "t", "X", before=2, after=1).orderBy("at").collect()]
    assert got == [(1, 2, 1, "aXb"), (1, 5, 2, "b\nXX"), (1, 6, 2, "\nXX\n"), (1, 11, 4, "écX")]


def test_redaction_and_templates(spark):
    row = spark.range(1).select(
        text.redact(F.lit("mail a@b.c now"), r"\S+@\S+").alias("mail"), text.redact(F.lit(""), "x").alias("none"),
        text.redact_range(F.lit("secret"), 2, 3).alias("range"), text.redact_range(F.lit("secret"), 5, 9).alias("out"),
        text.expand("${a} {b} {c} $", {"a": F.lit("{b}"), "b": F.lit(None)}).alias("merged"),
    ).first()
    assert tuple(row) == ("mail █████ now", "", "s███et", None, "{b}  {c} $")


def test_blocks(spark):
    html = "<h2 class=x>T &amp; <b>u</b></h2>drop<p>a<br/>b</p><table><tr><td>1</td><th> 2 </th></tr></table><ul><li>i</li></ul><pre>no</pre>"
    df = spark.createDataFrame([(1, html), (2, None)], "id long, html string")
    got = [tuple(r) for r in blocks.html_blocks(df, "id", "html").orderBy("idx").collect()]
    assert got == [(1, 0, "h2", True, "T &amp; u"), (1, 1, "p", False, "a b"), (1, 2, "tr", False, "1 | 2"), (1, 3, "li", False, "i")]
    assert spark.range(1).select(blocks.wrap(F.lit("aa bb  cccccc d"), 5).alias("w")).first()["w"] == "aa bb\ncccccc\nd"


def test_own_functions(spark):
    from gridloom.functions import formula

    formula.register("twice", lambda a: formula.V("num", formula.as_num(a[0]).col * 2, a[0].err))
    assert formula.with_formulas(spark.range(1), {"v": "TWICE(21)"}).first()["v"] == 42
    formula.FUNCTIONS.pop("TWICE")


def test_watch_folder(spark, tmp_path):
    """Files that come between two runs are seen once each."""
    from gridloom.streaming import windows

    folder = tmp_path / "in"
    folder.mkdir()
    for name, n in (("a", 1), ("b", 2)):
        (folder / f"{name}.csv").write_text(f"{name},{n}\n")
        windows.watch_folder(spark, str(folder), "name string, n int", lambda df: df.withColumn("n", F.col("n") * 10), str(tmp_path / "out"), str(tmp_path / "state"), "csv")
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 10), ("b", 20)]


def test_windows_on_a_stream(spark, tmp_path):
    """The windows of a stream with a watermark are those of the table, but for the last, which stays open."""
    from gridloom.streaming import windows

    rows = spark.sql("SELECT timestamp'2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 10) AS ts, 'x' AS event_type, double(id) AS value FROM range(40)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windows.windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("windowed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("windowed").collect())
    want = sorted(tuple(r) for r in windows.windowed_counts(rows).collect())
    assert got and got == want[: len(got)] and len(got) >= len(want) - 2


def test_workbooks(spark, tmp_path):
    """Sheets of a table, in both formats: nulls, booleans, odd texts, numbers at full precision, several files."""
    rows = [(1, " a  b\tc\n<&>", 0.1 + 0.2, True), (2, None, None, None), (3, "", float("inf"), False), (4, "=A1", -1e300, None), (5, "x\0y", 5.0, None)]
    df = spark.createDataFrame(rows, "k long, s string, x double, b boolean").coalesce(1)
    for kind, read in (("xlsx", files.read_xlsx), ("ods", files.read_ods)):
        path = str(tmp_path / kind)
        assert files.write_workbooks(df, path, kind, rows_each=2) == 5
        got = read(spark, path).where("row > 1").collect()
        cell = {(2 * int(r["path"].rpartition("-")[2].partition(".")[0]) + r["row"] - 1, r["col"]): r for r in got}
        assert [cell[i, 1]["num"] for i in range(1, 6)] == [1, 2, 3, 4, 5]
        assert cell[1, 2]["text"] == " a  b\tc\n<&>" and cell[1, 3]["num"] == 0.1 + 0.2 and cell[1, 4]["text"] == "1" and cell[3, 4]["text"] == "0"
        assert (2, 2) not in cell and (2, 3) not in cell and cell[3, 3]["text"] == "inf" and cell[4, 2]["formula"] == "A1" and cell[4, 3]["num"] == -1e300
        assert cell[5, 2]["text"] == "x�y" and cell[3, 2]["text"] == ""
    assert files.write_workbooks(df.limit(0), str(tmp_path / "none"), "ods") == 0


def test_ods_repeats():
    """Repeated cells and rows count; an empty rest of a million rows costs nothing."""
    body = files.ods_bytes({"T": [[None, 7], [None], [True]]})
    import io
    import zipfile

    z = zipfile.ZipFile(io.BytesIO(body))
    xml = z.read("content.xml").decode().replace("<table:table-cell/>", '<table:table-cell table:number-columns-repeated="3"/>', 1).replace("<table:table-row><table:table-cell/></table:table-row>", '<table:table-row table:number-rows-repeated="1000000"><table:table-cell/></table:table-row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as w:
        w.writestr("content.xml", xml)
    assert [c[1:5] for c in files.ods_cells(out.getvalue())] == [(1, 4, "num", 7.0), (1000002, 1, "bool", None)]
