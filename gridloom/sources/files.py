"""Readers and writers: delimited text, JSON lines, Markdown, HTML, XLSX and ODS."""

from __future__ import annotations

import io
import math
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CSV = {"quote": '"', "escape": '"', "multiLine": True}


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = ",", lines: bool = False) -> DataFrame:
    """RFC 4180: doubled quotes, line ends inside quotes; empty fields are null. A schema spares a pass for types.

    lines=True promises that no field holds a line end, so large files split.
    """
    return spark.read.schema(schema).options(**(_CSV | {"multiLine": not lines, "header": header, "sep": sep})).csv(path)


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",") -> None:
    """Numbers keep their full precision. A field that could be misread is quoted."""
    df.write.mode("overwrite").options(header=header, sep=sep, quote='"', escape='"').csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_CELL = re.compile(r"([A-Z]+)(\d+)")
CELLS = "sheet string, row int, col int, kind string, num double, text string, formula string"


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n


def xlsx_cells(raw: bytes) -> Iterator[tuple]:
    """(sheet, row, col, kind, num, text, formula) of each cell of a workbook: num, str or bool."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    strings = []
    if "xl/sharedStrings.xml" in z.namelist():
        for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
            strings.append("".join(t.text or "" for t in si.iter(f"{_MAIN}t")))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = targets[sheet.get(_REL)].lstrip("/")
        with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
            for _, c in ElementTree.iterparse(f):
                if c.tag != f"{_MAIN}c":
                    continue
                letters, row = _CELL.match(c.get("r")).groups()
                kind, value, formula = c.get("t", "n"), c.findtext(f"{_MAIN}v"), c.findtext(f"{_MAIN}f")
                if kind == "inlineStr":
                    value, kind = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")), "str"
                elif kind == "s":
                    value, kind = strings[int(value)], "str"
                number = float(value) if kind == "n" and value not in (None, "") else None
                if value is not None or formula is not None:
                    yield sheet.get("name"), int(row), _column(letters), {"n": "num", "b": "bool"}.get(kind, "str"), number, value if kind != "n" else None, formula
                c.clear()


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, col, kind, num, text, formula) of the workbooks under a path, one file a task at a time."""
    return _read_cells(spark, path, xlsx_cells)


def read_ods(spark: SparkSession, path: str) -> DataFrame:
    """As read_xlsx, of OpenDocument spreadsheets; dates and times are text as the file has them."""
    return _read_cells(spark, path, ods_cells)


def _read_cells(spark: SparkSession, path: str, cells_of: Callable[[bytes], Iterator[tuple]]) -> DataFrame:

    def run(batches):
        for b in batches:
            for p, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                cells = [(p, *c) for c in cells_of(raw)]
                types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], t) for i, t in enumerate(types)], names=["path", "sheet", "row", "col", "kind", "num", "text", "formula"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"path string, {CELLS}")


# Names of OpenDocument.
_ODF = "urn:oasis:names:tc:opendocument:xmlns:"
_OFFICE, _TABLE, _TEXT = (f"{{{_ODF}{x}:1.0}}" for x in ("office", "table", "text"))
_ODS = "application/vnd.oasis.opendocument.spreadsheet"


def _paragraph(e: ElementTree.Element) -> str:
    """The text of an ODF paragraph; runs of blanks, tabs and line ends are elements of their own."""
    own = {f"{_TEXT}s": " " * int(e.get(f"{_TEXT}c", 1)), f"{_TEXT}tab": "\t", f"{_TEXT}line-break": "\n"}.get(e.tag, e.text or "")
    return own + "".join(_paragraph(x) + (x.tail or "") for x in e)


def ods_cells(raw: bytes) -> Iterator[tuple]:
    """(sheet, row, col, kind, num, text, formula) of each cell of an OpenDocument spreadsheet."""
    sheet, row = None, 1
    with zipfile.ZipFile(io.BytesIO(raw)) as z, z.open("content.xml") as f:
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                if e.tag == f"{_TABLE}table":
                    sheet, row = e.get(f"{_TABLE}name"), 1
                continue
            if e.tag != f"{_TABLE}table-row":
                continue
            found, col = [], 1
            for c in e:
                if c.tag not in (f"{_TABLE}table-cell", f"{_TABLE}covered-table-cell"):
                    continue
                many, formula = int(c.get(f"{_TABLE}number-columns-repeated", 1)), c.get(f"{_TABLE}formula")
                kind, number, text = c.get(f"{_OFFICE}value-type"), c.get(f"{_OFFICE}value"), None
                if kind == "boolean":
                    text = str(int(c.get(f"{_OFFICE}boolean-value") == "true"))
                elif number is None and kind is not None:
                    text = c.get(f"{_OFFICE}date-value") or c.get(f"{_OFFICE}time-value") or "\n".join(_paragraph(x) for x in c.findall(f"{_TEXT}p"))
                if kind is not None or formula is not None:
                    name = "bool" if kind == "boolean" else "num" if number is not None else "str"
                    cell = (name, float(number) if number is not None else None, text, re.sub("^(of:)?=", "", formula) if formula else None)
                    found += [(col + i, *cell) for i in range(many)]
                col += many
            many = int(e.get(f"{_TABLE}number-rows-repeated", 1))
            for r in range(many if found else 0):  # the empty rest of a sheet is one row, repeated
                yield from ((sheet, row + r, *c) for c in found)
            row += many
            e.clear()


def ods_bytes(sheets: dict[str, list[list[object]]]) -> bytes:
    """An OpenDocument spreadsheet of small sheets: None is no cell, text that begins with = a formula."""
    from xml.sax.saxutils import escape, quoteattr

    def blanks(m: re.Match) -> str:
        return f'<text:s text:c="{len(m[0])}"/>'

    def cell(v: object) -> str:
        if v is None:
            return "<table:table-cell/>"
        if isinstance(v, str) and v.startswith("="):
            return f"<table:table-cell table:formula={quoteattr('of:' + v)}/>"
        if isinstance(v, bool):
            return f'<table:table-cell office:value-type="boolean" office:boolean-value="{str(v).lower()}"/>'
        if isinstance(v, (int, float)):
            return f'<table:table-cell office:value-type="float" office:value="{v!r}"/>'
        lines = (re.sub("^ +| +$|  +", blanks, escape(x)).replace("\t", "<text:tab/>") for x in str(v).split("\n"))
        return '<table:table-cell office:value-type="string">' + "".join(f"<text:p>{x}</text:p>" for x in lines) + "</table:table-cell>"

    names = "".join(f' xmlns:{x}="{_ODF}{x}:1.0"' for x in ("office", "table", "text"))
    body = "".join(f"<table:table table:name={quoteattr(n)}>" + "".join("<table:table-row>" + "".join(map(cell, row)) + "</table:table-row>" for row in rows) + "</table:table>" for n, rows in sheets.items())
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), _ODS)  # first and stored
        z.writestr("META-INF/manifest.xml", f'<manifest:manifest xmlns:manifest="{_ODF}manifest:1.0"><manifest:file-entry manifest:full-path="/" manifest:media-type="{_ODS}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>')
        z.writestr("content.xml", f'<?xml version="1.0" encoding="UTF-8"?><office:document-content{names} office:version="1.3"><office:body><office:spreadsheet>{body}</office:spreadsheet></office:body></office:document-content>')
    return out.getvalue()


#: What XML 1.0 cannot hold, and the carriage return, which its readers change.
_NOT_XML = re.compile("[^\t\n\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def write_workbooks(df: DataFrame, path: str, kind: str = "xlsx", sheet: str = "Data", rows_each: int = 50_000) -> int:
    """Writes df as workbooks (kind xlsx or ods) under path and returns the number of its rows.

    Each task writes its rows in order, rows_each to a workbook at most, each with a header row. Nulls
    are no cells, an empty text is one; numbers and booleans keep their type, what is not finite and all
    else is text, and text that begins with = a formula. Characters that XML cannot hold become U+FFFD.
    An empty table writes nothing. A workbook appears only when it is complete, under a name that a
    repeated task writes again.
    """
    make, names = {"xlsx": xlsx_bytes, "ods": ods_bytes}[kind], df.columns

    def value(v: object) -> object:
        if v is None or isinstance(v, (bool, int)) or isinstance(v, float) and math.isfinite(v):
            return v
        return _NOT_XML.sub("\ufffd", str(v))

    def put(rows: list[list[object]], number: int) -> None:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        name = f"{folder}/{TaskContext.get().partitionId():06d}-{number:06d}.{kind}"
        part = f"{folder}/.{uuid.uuid4().hex}.part"
        with store.open_output_stream(part) as out:
            out.write(make({sheet: [names, *rows]}))
        store.move(part, name)

    def run(batches):
        held, number, total = [], 0, 0
        for b in batches:
            held += [[value(v) for v in row] for row in zip(*(c.to_pylist() for c in b.columns))]
            total += b.num_rows
            while len(held) >= rows_each:
                put(held[:rows_each], number)
                held, number = held[rows_each:], number + 1
        if held:
            put(held, number)
        yield pa.RecordBatch.from_pydict({"rows": pa.array([total], pa.int64())})

    return df.mapInArrow(run, "rows long").agg(F.sum("rows").alias("rows")).first()["rows"] or 0


def xlsx_bytes(sheets: dict[str, list[list[object]]]) -> bytes:
    """A workbook of small sheets: None is no cell, text that begins with = a formula."""
    from xml.sax.saxutils import escape

    def cell(r: int, c: int, v: object) -> str:
        at = _letters(c) + str(r)
        if isinstance(v, str) and v.startswith("="):
            return f'<c r="{at}"><f>{escape(v[1:])}</f></c>'
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    main, rel, office = _MAIN[1:-1], "http://schemas.openxmlformats.org/package/2006/relationships", _REL[1:-3]
    names = list(sheets)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{rel}"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{rel}">' + "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, n in enumerate(names, 1):
            rows = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row, 1) if v is not None) + "</row>" for r, row in enumerate(sheets[n], 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def to_markdown(blocks: DataFrame, id_col: str) -> DataFrame:
    """(id, markdown) of blocks (id, idx, kind, level, text): one text a document, in order."""
    line = F.concat(F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "))).when(F.col("kind") == "item", "- ").otherwise(""), "text")
    rows = F.array_sort(F.collect_list(F.struct("idx", line.alias("line"))))
    return blocks.groupBy(id_col).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("markdown"))


def format_of(head: str = "content") -> F.Column:
    """A file's kind by its first bytes."""
    h = F.hex(F.substring(head, 1, 8))
    return F.when(h.startswith("504B0304"), "zip").when(h.startswith("25504446"), "pdf").when(h.startswith("D0CF11E0"), "cfb").when(h.startswith("7B5C727466"), "rtf").when(h.startswith("50415231"), "parquet").when(h.startswith("3C21444F43") | h.startswith("3C68746D6C"), "html").otherwise("text")
