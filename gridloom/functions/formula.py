"""Spreadsheet formulas compiled to Spark columns.

A formula is parsed into a tree and compiled to a pair of columns: its value and its error code (null
where there is none). Names in square brackets are columns of the row; A1 references and ranges go to
a resolver. Compiling costs no job; Catalyst folds constants and prunes columns as for any expression.

Precedence, low to high: comparison, &, + -, * /, ^ (right-associative), unary + -, postfix %. So -2^2
is 4. IF and the like evaluate only the branch taken.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coerce import num_to_text, to_num

_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<str>"(?:[^"]|"")*")|(?P<col>\[[^\]]+\])|(?P<call>[A-Za-z_][A-Za-z0-9_.]*)(?=\s*\()|(?P<ref>(?:[A-Za-z_]\w*!)?\$?[A-Za-z]{1,3}\$?\d+(?::\$?[A-Za-z]{1,3}\$?\d+)?)|(?P<word>[A-Za-z_]\w*)|(?P<op><=|>=|<>|[-+*/^&=<>%(),;]))""")


@dataclass(frozen=True)
class Node:
    kind: str  # num str bool col ref call binary unary percent
    value: object = None
    args: tuple[Node, ...] = ()


class FormulaError(ValueError):
    """A formula that cannot be parsed (#PARSE!)."""


def parse(source: str) -> Node:
    text, tokens, at = source.strip().removeprefix("="), [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"cannot read {text[at:]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    at = 0

    def peek(*ops: str) -> bool:
        return tokens[at][0] == "op" and tokens[at][1] in ops

    def take() -> tuple[str, str]:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def expect(op: str) -> None:
        if not peek(op):
            raise FormulaError(f"{op} expected before {tokens[at][1]!r}")
        take()

    def left(ops: tuple[str, ...], lower: Callable[[], Node]) -> Node:
        node = lower()
        while peek(*ops):
            node = Node("binary", take()[1], (node, lower()))
        return node

    def compare() -> Node:
        return left(("=", "<>", "<", ">", "<=", ">="), lambda: left(("&",), lambda: left(("+", "-"), lambda: left(("*", "/"), power))))

    def power() -> Node:
        node = unary()
        return Node("binary", take()[1], (node, power())) if peek("^") else node

    def unary() -> Node:
        return Node("unary", take()[1], (unary(),)) if peek("+", "-") else postfix()

    def postfix() -> Node:
        node = primary()
        while peek("%"):
            take()
            node = Node("percent", None, (node,))
        return node

    def primary() -> Node:
        kind, value = take()
        if kind == "num":
            return Node("num", float(value))
        if kind == "str":
            return Node("str", value[1:-1].replace('""', '"'))
        if kind == "col":
            return Node("col", value[1:-1])
        if kind == "ref":
            return Node("ref", value.replace("$", ""))
        if kind == "word" and value.upper() in ("TRUE", "FALSE"):
            return Node("bool", value.upper() == "TRUE")
        if kind == "call":
            expect("(")
            args = []
            while not peek(")"):
                args.append(compare())
                if not peek(")"):
                    if not peek(",", ";"):
                        raise FormulaError("a comma is missing")
                    take()
            take()
            return Node("call", value.upper(), tuple(args))
        if (kind, value) == ("op", "("):
            node = compare()
            expect(")")
            return node
        raise FormulaError(f"unexpected {value!r}")

    node = compare()
    if tokens[at][0] != "end":
        raise FormulaError(f"unexpected {tokens[at][1]!r}")
    return node


@dataclass
class V:
    """A compiled value: kind is num, str, bool or empty; err is null where the value stands. A null value without an error is blank."""

    kind: str
    col: Column
    err: Column = field(default_factory=lambda: F.lit(None).cast("string"))
    #: for ranges: the cells, row by row, and their number a row
    cells: list[V] | None = None
    width: int = 1


Resolver = Callable[[str], V]


def _error(code: str) -> V:
    return V("num", F.lit(None).cast("double"), F.lit(code))


def _first(*errs: Column) -> Column:
    return errs[0] if len(errs) == 1 else F.coalesce(*errs)


def as_num(v: V) -> V:
    """Numbers stand; true is 1; blank is 0; text counts if all of it is a number, else #VALUE!."""
    if v.kind == "empty":
        return V("num", F.lit(0.0), v.err)
    if v.kind in ("num", "bool"):
        return V("num", F.coalesce(v.col.cast("double"), F.lit(0.0)), v.err)
    x = to_num(v.col)
    return V("num", F.when(v.col.isNull(), 0.0).otherwise(x), _first(v.err, F.when(x.isNull() & v.col.isNotNull(), "#VALUE!")))


def as_text(v: V) -> V:
    """Text stands; blank is the empty text."""
    if v.kind == "empty":
        return V("str", F.lit(""), v.err)
    c = v.col if v.kind == "str" else num_to_text(v.col) if v.kind == "num" else F.upper(v.col.cast("string"))
    return V("str", F.when(v.col.isNull(), "").otherwise(c), v.err)


def is_blank(v: V) -> Column:
    return v.err.isNull() & (F.lit(True) if v.kind == "empty" else v.col.isNull())


def _errors(vs: list[V], code: str | None = None) -> Column:
    """The first error of the arguments, or the function's own code for any of them."""
    if not vs:
        return F.lit(None).cast("string")
    err = _first(*[v.err for v in vs])
    return err if code is None else F.when(err.isNotNull(), code)


def as_bool(v: V) -> Column:
    """The condition of IF and others: errors and blanks are false."""
    if v.kind == "num":
        c = v.col != 0
    elif v.kind == "bool":
        c = v.col
    elif v.kind == "empty":
        c = F.lit(False)
    else:
        c = (v.col != "") & (F.upper(v.col) != "FALSE")
    return v.err.isNull() & F.coalesce(c, F.lit(False))


def _flat(args: list[V]) -> list[V]:
    return [c for a in args for c in (a.cells if a.cells is not None else [a])]


def _numbers(args: list[V], only_numbers: bool = False) -> Column:
    """The array of what counts as a number: blanks are 0, other text and errors are left out."""
    cells = [(c, as_num(c)) for c in _flat(args) if not only_numbers or c.kind == "num"]
    values = [F.when(n.err.isNull() & ~(is_blank(c) & only_numbers), n.col) for c, n in cells]
    return F.filter(F.array(*values) if values else F.array().cast("array<double>"), lambda x: x.isNotNull())


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _same(a: V, b: V, fold: bool = False) -> Column:
    """Equality within a kind; different kinds are unequal."""
    if a.kind != b.kind:
        return F.lit(False)
    return F.coalesce(F.lower(a.col) == F.lower(b.col) if fold and a.kind == "str" else a.col == b.col, F.lit(False))


def criterion(cell: V, crit: V) -> Column:
    """Whether a cell meets a criterion: a number, a text, or a text that begins with a comparison."""
    if crit.kind != "str":
        n = as_num(cell)
        return F.coalesce(n.err.isNull() & (n.col == as_num(crit).col), F.lit(False))
    n = as_num(cell) if cell.kind != "str" else V("num", to_num(cell.col))
    op, rest = F.regexp_extract(crit.col, r"^(>=|<=|<>|>|<|=)?", 0), F.regexp_replace(crit.col, r"^(>=|<=|<>|>|<|=)", "")
    bound, text = to_num(rest), as_text(cell).col
    tests = F.when(op == ">", n.col > bound).when(op == "<", n.col < bound).when(op == ">=", n.col >= bound).when(op == "<=", n.col <= bound).when(op == "<>", n.col != bound).otherwise(n.col == bound)
    return F.coalesce(F.when(bound.isNotNull(), tests).otherwise(op.isin("", "=") & (F.lower(text) == F.lower(rest))), F.lit(False))


def _matches(args: list[V]) -> list[Column]:
    """For range, criterion, range, criterion, ...: whether all hold at each position."""
    out = None
    for r, c in zip(args[::2], args[1::2]):
        hits = [criterion(x, c) for x in (r.cells or [r])]
        out = hits if out is None else [a & b for a, b in zip(out, hits)]
    return out


def _chosen(values: list[V], hits: list[Column]) -> Column:
    xs = [F.when(h & as_num(v).err.isNull(), as_num(v).col) for v, h in zip(values, hits)]
    return F.filter(F.array(*xs), lambda x: x.isNotNull())


def _mean(xs: Column, none: Column) -> Column:
    return F.when(F.size(xs) > 0, _sum(xs) / F.greatest(F.size(xs), F.lit(1))).otherwise(none)


def _scale(args: list[V], at: int) -> Column:
    return F.pow(F.lit(10.0), as_num(args[at]).col.cast("int")) if len(args) > at else F.lit(1.0)


def _n(f: Callable[..., Column], bad: Callable[..., Column] | None = None, code: str = "#NUM!"):
    """A function of numbers; bad(...) tells where it fails with the code."""

    def make(args: list[V]) -> V:
        ns = [as_num(a) for a in args]
        cols, err = [n.col for n in ns], _first(*[n.err for n in ns])
        if bad is None:
            return V("num", F.when(err.isNull(), f(*cols)), err)
        wrong = F.coalesce(bad(*cols), F.lit(False))
        return V("num", F.when(err.isNull() & ~wrong, f(*cols)), _first(err, F.when(wrong, code)))

    return make


def _t(f: Callable[..., Column], kind: str = "str"):
    """A function of a text and perhaps numbers after it."""

    def make(args: list[V]) -> V:
        vs = [as_text(args[0]), *(as_num(a) for a in args[1:])]
        return V(kind, f(*[v.col for v in vs]), _first(*[v.err for v in vs]))

    return make


def _texts(f: Callable[..., Column], kind: str = "str"):
    def make(args: list[V]) -> V:
        vs = [as_text(a) for a in args]
        return V(kind, f(*[v.col for v in vs]), _first(*[v.err for v in vs]))

    return make


def _branch(pairs: list[tuple[Column, V]], last: V) -> V:
    """The first value whose condition holds."""
    values = [v for _, v in pairs] + [last]
    kind = values[0].kind if len({v.kind for v in values if not _is_error(v)}) <= 1 else "str"
    kind = next((v.kind for v in values if not _is_error(v)), kind) if kind != "str" else "str"
    cast = [as_text(v) if kind == "str" and v.kind != "str" and not _is_error(v) else v for v in values]
    null = {"num": "double", "str": "string", "bool": "boolean", "empty": "string"}[kind]
    col, err = cast[-1].col.cast(null), cast[-1].err
    for (cond, _), v in reversed(list(zip(pairs, cast))):
        col, err = F.when(cond, v.col.cast(null)).otherwise(col), F.when(cond, v.err).otherwise(err)
    return V(kind, col, err)


def _is_error(v: V) -> bool:
    return v.kind == "num" and str(v.col) == str(F.lit(None).cast("double"))


def _if(args: list[V]) -> V:
    return _branch([(as_bool(args[0]), args[1])], args[2] if len(args) > 2 else V("bool", F.lit(False)))


def _ifs(args: list[V]) -> V:
    if len(args) % 2:
        return _error("#VALUE!")
    return _branch([(as_bool(c), v) for c, v in zip(args[::2], args[1::2])], _error("#N/A"))


def _switch(args: list[V]) -> V:
    e, rest = args[0], args[1:]
    default = rest[-1] if len(rest) % 2 else _error("#N/A")
    return _branch([(_same(e, v, True), r) for v, r in zip(rest[::2], rest[1::2])], default)


def _iferror(args: list[V]) -> V:
    return _branch([(args[0].err.isNotNull(), args[1])], args[0])


def _textjoin(args: list[V]) -> V:
    d, skip, cells = as_text(args[0]), as_bool(args[1]), [as_text(c) for c in _flat(args[2:])]
    every = F.array(*[c.col for c in cells])
    return V("str", F.when(skip, _joined(F.filter(every, lambda x: x != ""), d.col)).otherwise(_joined(every, d.col)), _errors([d, *cells]))


def _joined(xs: Column, d: Column) -> Column:
    return F.coalesce(F.reduce(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), F.get(xs, F.lit(0)), lambda a, x: F.concat(a, d, x)), F.lit(""))


def _substitute(args: list[V]) -> V:
    texts = [as_text(a) for a in args[:3]]
    s, old, new = (v.col for v in texts)
    if len(args) < 4:
        return V("str", F.when(old == "", s).otherwise(F.replace(s, old, new)), _errors(texts))
    nth = as_num(args[3])
    k = nth.col.cast("int")
    parts = F.split(s, F.concat(F.lit(r"\Q"), old, F.lit(r"\E")), -1)
    done = F.concat(_joined(F.slice(parts, 1, k), old), new, _joined(F.slice(parts, k + 1, F.size(parts)), old))
    return V("str", F.when((old == "") | (k < 1) | (F.size(parts) <= k), s).otherwise(done), _errors([*texts, nth]))


def _find(fold: bool):
    def make(args: list[V]) -> V:
        texts = [as_text(a) for a in args[:2]]
        needle, hay = (v.col for v in texts)
        at = F.instr(F.lower(hay), F.lower(needle)) if fold else F.instr(hay, needle)
        return V("num", F.when(at > 0, at.cast("double")), _first(_errors(texts), F.when(at <= 0, "#VALUE!")))

    return make


def _replace(vs: list[V]) -> V:
    s, at, n, new = (v.col for v in vs)
    return V("str", F.overlay(s, new, at.cast("int"), n.cast("int")), _errors(vs))


def _tally(hits: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [h.cast("double") for h in hits], F.lit(0.0))


def proper(s: Column) -> Column:
    words = F.regexp_extract_all(s, F.lit(r"[\p{Punct}\s]+|[^\p{Punct}\s]+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 2147483646)))), "")


def _table(args: list[V], by_row: bool) -> V:
    """VLOOKUP and HLOOKUP: a numeric key, the first exact match."""
    key, table, at = args[0], args[1], args[2]
    if key.kind == "str":
        return _error("#VALUE!")
    cells, w = table.cells, table.width
    h = len(cells) // w
    rows = [cells[r * w : (r + 1) * w] for r in range(h)] if by_row else [[cells[r * w + c] for r in range(h)] for c in range(w)]
    k = as_num(at).col
    hits = [(_same(key, row[0]) if row[0].kind == "num" else F.lit(False), row) for row in rows]
    picked = [(hit, _branch([(k == i + 1, c) for i, c in enumerate(row)], _error("#REF!"))) for hit, row in hits]
    return _branch(picked, _error("#N/A"))


def _index(args: list[V]) -> V:
    cells, w = args[0].cells, args[0].width
    r = as_num(args[1]).col
    c = as_num(args[2]).col if len(args) > 2 else F.lit(1.0)
    return _branch([((r == i // w + 1) & (c == i % w + 1), x) for i, x in enumerate(cells)], _error("#REF!"))


def _match(args: list[V]) -> V:
    return _branch([(_same(args[0], x, True), V("num", F.lit(float(i + 1)))) for i, x in enumerate(args[1].cells or [args[1]])], _error("#N/A"))


def _choose(args: list[V]) -> V:
    i = F.floor(as_num(args[0]).col)
    return _branch([(i == k + 1, v) for k, v in enumerate(args[1:])], _error("#VALUE!"))


def _reduce(f: Callable[[Column], Column], least: int = 0, code: str = "#N/A"):
    def make(args: list[V]) -> V:
        xs = _numbers(args)
        short = F.size(xs) < least
        return V("num", F.when(~short, f(xs)), F.when(short, code))

    return make


def _variance(xs: Column) -> Column:
    n = F.size(xs)
    m = _sum(xs) / F.greatest(n, F.lit(1))
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.greatest(n - 1, F.lit(1))


def _median(xs: Column) -> Column:
    s, n = F.array_sort(xs), F.size(xs)
    half = F.floor((n - 1) / 2).cast("int")
    return (F.get(s, half) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def _mode(args: list[V]) -> V:
    xs = _numbers(args)
    counted = F.transform(F.array_distinct(xs), lambda d: F.struct(F.size(F.filter(xs, lambda x: x == d)).alias("n"), (-d).alias("d")))
    best = F.array_max(counted)
    return V("num", F.when(best["n"] > 1, -best["d"]), F.when(F.coalesce(best["n"] <= 1, F.lit(True)), "#N/A"))


def _kth(largest: bool):
    def make(args: list[V]) -> V:
        xs, nth = F.sort_array(_numbers(args[:1]), asc=not largest), as_num(args[1])
        k = nth.col.cast("int")
        out = nth.err.isNotNull() | (k < 1) | (k > F.size(xs))
        return V("num", F.when(~out, F.get(xs, k - 1)), F.when(F.size(xs) == 0, "#N/A").when(out, "#NUM!"))

    return make


def _sumproduct(args: list[V]) -> V:
    rows = [a.cells or [a] for a in args]
    if len({len(r) for r in rows}) > 1 or any(c.kind == "str" for r in rows for c in r):
        return _error("#VALUE!")
    numbers = [[as_num(c) for c in r] for r in rows]
    total = reduce(lambda a, b: a + b, [reduce(lambda x, y: x * y, [c.col for c in cs]) for cs in zip(*numbers)])
    return V("num", total, _errors([c for r in numbers for c in r], "#VALUE!"))


def _if_aggregate(f: Callable[[Column], Column]):
    def make(args: list[V]) -> V:
        values = args[2] if len(args) > 2 else args[0]
        return V("num", f(_chosen(values.cells or [values], _matches(args[:2]))))

    return make


def _count_true(args: list[V]) -> V:
    return V("num", reduce(lambda a, b: a + b, [h.cast("double") for h in _matches(args)]))


# Serial 1 is 1900-01-01; 60 is the day after 1900-02-28 that never was, so from 61 on counts run one ahead.
EPOCH, LEAP = "DATE'1899-12-31'", 60


def _date_of(serial: Column) -> Column:
    day = F.floor(serial).cast("int")
    return F.date_add(F.expr(EPOCH), F.when(day > LEAP, day - 1).otherwise(day))


def _serial(date: Column) -> Column:
    days = F.datediff(date, F.expr(EPOCH))
    return F.when(days >= LEAP, days + 1).otherwise(days).cast("double")


def _make_date(y: Column, m: Column, d: Column) -> Column:
    """The serial of a date; days beyond the month's end go on; months outside 1-12 and days below 1 give 0."""
    first = F.expr("make_date({0}, {1}, 1)".format("1900", "1"))
    months = ((y - 1900) * 12 + m - 1).cast("int")
    found = _serial(F.date_add(F.add_months(first, months), (d - 1).cast("int")))
    february = (y == 1900) & (m == 2) & (d >= 29)
    return F.when(~m.between(1, 12) | (d < 1), 0.0).when(february, F.when(d < 30, float(LEAP)).otherwise(LEAP + 1.0)).otherwise(found)


def _weekday(args: list[V]) -> V:
    vs = [as_num(a) for a in args]
    day = F.dayofweek(_date_of(vs[0].col)).cast("double")  # Sunday is 1
    kind = vs[1].col if len(vs) > 1 else F.lit(1.0)
    return V("num", F.when(kind == 2, F.when(day == 1, 7.0).otherwise(day - 1)).when(kind == 3, F.when(day == 1, 6.0).otherwise(day - 2)).otherwise(day), _errors(vs))


def _annuity(args: list[V], future: bool) -> V:
    vs = [as_num(a) for a in args]
    r, n, p = (v.col for v in vs[:3])
    other = vs[3].col if len(vs) > 3 else F.lit(0.0)
    due = vs[4].col if len(vs) > 4 else F.lit(0.0)
    f, err = F.pow(1 + r, n), _errors(vs)
    if future:
        return V("num", F.when(r == 0, -(other + p * n)).otherwise(-(other * f + p * (1 + r * due) * (f - 1) / F.nullif(r, F.lit(0.0)))), err)
    return V("num", F.when(r == 0, -(p + other) / F.nullif(n, F.lit(0.0))).otherwise(-(p * f + other) * r / F.nullif((1 + r * due) * (f - 1), F.lit(0.0))), _first(err, F.when(n == 0, "#DIV/0!")))


def round_half_up(x: Column, p: Column) -> Column:
    """Ties go towards plus infinity."""
    return F.floor(x * p + 0.5).cast("double") / p


FUNCTIONS: dict[str, Callable[[list[V]], V]] = {
    # logic
    "IF": _if, "IFS": _ifs, "SWITCH": _switch, "IFERROR": _iferror,
    "AND": lambda a: V("bool", reduce(lambda x, y: x & y, [as_bool(v) for v in _flat(a)])),
    "OR": lambda a: V("bool", reduce(lambda x, y: x | y, [as_bool(v) for v in _flat(a)])),
    "NOT": lambda a: V("bool", ~as_bool(a[0]), a[0].err),
    # lookup and conditional aggregates
    "VLOOKUP": lambda a: _table(a, True), "HLOOKUP": lambda a: _table(a, False), "INDEX": _index, "MATCH": _match, "CHOOSE": _choose,
    "SUMIF": _if_aggregate(_sum), "AVERAGEIF": _if_aggregate(lambda xs: _mean(xs, F.lit(0.0))), "COUNTIF": _count_true, "COUNTIFS": _count_true,
    "SUMIFS": lambda a: V("num", _sum(_chosen(a[0].cells or [a[0]], _matches(a[1:])))),
    # mathematics
    "SUM": lambda a: V("num", _sum(_numbers(a))), "AVERAGE": lambda a: V("num", _mean(_numbers(a), F.lit(0.0))),
    "PRODUCT": lambda a: V("num", F.when(F.size(_numbers(a)) > 0, F.aggregate(_numbers(a), F.lit(1.0), lambda x, y: x * y)).otherwise(0.0)),
    "MIN": lambda a: V("num", F.coalesce(F.array_min(_numbers(a)), F.lit(0.0))), "MAX": lambda a: V("num", F.coalesce(F.array_max(_numbers(a)), F.lit(0.0))),
    "COUNT": lambda a: V("num", F.size(_numbers(a, True)).cast("double")),
    "COUNTA": lambda a: V("num", _tally([~is_blank(v) for v in _flat(a)])), "COUNTBLANK": lambda a: V("num", _tally([is_blank(v) for v in _flat(a)])),
    "ROUND": lambda a: _n(lambda x, *_: round_half_up(x, _scale(a, 1)))(a), "ROUNDUP": lambda a: _n(lambda x, *_: F.ceil(x * _scale(a, 1)).cast("double") / _scale(a, 1))(a), "ROUNDDOWN": lambda a: _n(lambda x, *_: F.floor(x * _scale(a, 1)).cast("double") / _scale(a, 1))(a),
    "ABS": _n(F.abs), "INT": _n(lambda x: F.floor(x).cast("double")), "SIGN": _n(F.signum), "EXP": _n(F.exp), "POWER": _n(F.pow),
    "MOD": _n(lambda x, y: x % F.nullif(y, F.lit(0.0)) + 0.0, lambda x, y: y == 0, "#DIV/0!"),
    "SQRT": _n(lambda x: F.sqrt(F.greatest(x, F.lit(0.0))), lambda x: x < 0), "LN": _n(F.ln, lambda x: x <= 0), "LOG10": _n(F.log10, lambda x: x <= 0),
    "CEILING": _n(lambda x, m: F.ceil(x / F.nullif(m, F.lit(0.0))).cast("double") * m, lambda x, m: m == 0, "#DIV/0!"), "FLOOR": _n(lambda x, m: F.floor(x / F.nullif(m, F.lit(0.0))).cast("double") * m, lambda x, m: m == 0, "#DIV/0!"),
    "PI": lambda a: V("num", F.pi()), "SUMPRODUCT": _sumproduct,
    # text
    "CONCATENATE": lambda a: _texts(F.concat)(_flat(a)), "CONCAT": lambda a: _texts(F.concat)(_flat(a)), "TEXTJOIN": _textjoin,
    "LEFT": lambda a: _t(lambda s, *n: F.left(s, F.greatest(n[0].cast("int"), F.lit(0)) if n else F.lit(1)))(a),
    "RIGHT": lambda a: _t(lambda s, *n: F.right(s, F.greatest(n[0].cast("int"), F.lit(0)) if n else F.lit(1)))(a),
    "MID": lambda a: _t(lambda s, st, *n: s.substr(F.greatest(st.cast("int"), F.lit(1)), F.greatest(n[0].cast("int"), F.lit(0)) if n else F.length(s)))(a),
    "LEN": _t(lambda s: F.length(s).cast("double"), "num"), "UPPER": _t(F.upper), "LOWER": _t(F.lower), "TRIM": _t(lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))),
    "TEXT": lambda a: as_text(a[0]), "VALUE": lambda a: as_num(a[0]), "REPT": lambda a: _t(lambda s, n: F.repeat(s, F.greatest(n.cast("int"), F.lit(0))))(a),
    "EXACT": _texts(lambda x, y: x == y, "bool"), "SUBSTITUTE": _substitute, "FIND": _find(False), "SEARCH": _find(True), "PROPER": _t(proper),
    "REPLACE": lambda a: _replace([as_text(a[0]), as_num(a[1]), as_num(a[2]), as_text(a[3])]),
    # statistics
    "MEDIAN": _reduce(_median, 1), "MODE": _mode, "STDEV": _reduce(lambda xs: F.sqrt(_variance(xs)), 2), "VAR": _reduce(_variance, 2), "LARGE": _kth(True), "SMALL": _kth(False),
    # dates and finance
    "DATE": _n(_make_date), "YEAR": _n(lambda s: F.year(_date_of(s)).cast("double")), "MONTH": _n(lambda s: F.month(_date_of(s)).cast("double")), "DAY": _n(lambda s: F.day(_date_of(s)).cast("double")),
    "WEEKDAY": _weekday, "EDATE": _n(lambda s, m: _serial(F.add_months(_date_of(s), m.cast("int")))), "EOMONTH": _n(lambda s, m: _serial(F.last_day(F.add_months(_date_of(s), m.cast("int"))))),
    "TODAY": lambda a: V("num", _serial(F.current_date())), "NOW": lambda a: V("num", _serial(F.current_date()) + F.pmod(F.unix_timestamp(), F.lit(86400)) / 86400),
    "PMT": lambda a: _annuity(a, False), "FV": lambda a: _annuity(a, True),
}


def register(name: str, f: Callable[[list[V]], V]) -> None:
    """Adds a function to the language, or replaces one: f makes a value of compiled arguments."""
    FUNCTIONS[name.upper()] = f


def _equal(a: V, b: V) -> Column:
    """Equality of values; a blank equals 0, false, the empty text and another blank."""
    if "empty" in (a.kind, b.kind):
        return as_num(a).col == as_num(b).col if {a.kind, b.kind} & {"num", "bool"} else as_text(a).col == as_text(b).col
    if a.kind == b.kind:
        return as_text(a).col == as_text(b).col if a.kind == "str" else as_num(a).col == as_num(b).col

    def like_blank(v: V) -> Column:
        return as_text(v).col == "" if v.kind == "str" else as_num(v).col == 0

    return F.when(a.col.isNull(), like_blank(b)).when(b.col.isNull(), like_blank(a)).otherwise(False)


def _binary(op: str, a: V, b: V) -> V:
    if op in ("=", "<>"):
        same = _equal(a, b)
        err = _first(a.err, b.err)
        return V("bool", F.when(err.isNull(), same if op == "=" else ~same), err)
    if op == "&":
        x, y = as_text(a), as_text(b)
        return V("str", F.concat(x.col, y.col), _first(x.err, y.err))
    if op in ("<", ">", "<=", ">="):
        x, y = as_num(a), as_num(b)
        test = {"<": x.col < y.col, ">": x.col > y.col, "<=": x.col <= y.col, ">=": x.col >= y.col}[op]
        err = _first(a.err, b.err)
        return V("bool", F.when(err.isNull(), F.coalesce(test, F.lit(False))), err)
    x, y = as_num(a), as_num(b)
    err = _first(x.err, y.err)
    if op == "/":
        zero = F.coalesce(y.col == 0, F.lit(False))
        return V("num", x.col / F.when(y.col != 0, y.col), _first(err, F.when(zero, "#DIV/0!")))
    f = {"+": lambda: x.col + y.col, "-": lambda: x.col - y.col, "*": lambda: x.col * y.col, "^": lambda: F.pow(x.col, y.col)}[op]
    return V("num", f(), err)


_KINDS = {"string": "str", "boolean": "bool"}


def compile_node(node: Node, types: dict[str, str], resolve: Resolver | None = None) -> V:
    if node.kind == "num":
        return V("num", F.lit(node.value))
    if node.kind == "str":
        return V("str", F.lit(node.value))
    if node.kind == "bool":
        return V("bool", F.lit(node.value))
    if node.kind == "col":
        if node.value not in types:
            return _error("#REF!")
        t = types[node.value]
        if t.startswith(("timestamp", "date")):
            return V("num", _serial(F.to_date(F.col(f"`{node.value}`"))))
        kind = _KINDS.get(t, "num")
        return V(kind, F.col(f"`{node.value}`").cast("double") if kind == "num" else F.col(f"`{node.value}`"))
    if node.kind == "ref":
        return resolve(node.value) if resolve else _error("#REF!")
    args = [compile_node(a, types, resolve) for a in node.args]
    if node.kind == "unary":
        v = as_num(args[0])
        return V("num", -v.col if node.value == "-" else v.col, v.err)
    if node.kind == "percent":
        v = as_num(args[0])
        return V("num", v.col / 100, v.err)
    if node.kind == "binary":
        return _binary(node.value, *args)
    if node.value not in FUNCTIONS:
        return _error("#NAME?")
    try:
        return FUNCTIONS[node.value](args)
    except IndexError:
        return _error("#VALUE!")


def compile_formula(source: str, types: dict[str, str], resolve: Resolver | None = None) -> V:
    """The formula over columns of these types (name -> Spark type); #PARSE! where it cannot be read."""
    try:
        return compile_node(parse(source), types, resolve)
    except FormulaError:
        return _error("#PARSE!")


def with_formulas(df: DataFrame, formulas: dict[str, str], errors: bool = False) -> DataFrame:
    """df with a column for each formula (null where it fails), and with errors its code in <name>_err."""
    out, types = {}, dict(df.dtypes)
    for name, source in formulas.items():
        v = compile_formula(source, types)
        out[name] = F.when(v.err.isNull(), v.col)
        if errors:
            out[f"{name}_err"] = v.err
    return df.withColumns(out)


# --- ranges over whole columns: the formula's aggregates -------------------------------------------


def column_aggregate(function: str, value: Column, criteria: Column | None = None) -> Column:
    """The aggregate of a whole column, its blanks (nulls) left out; criteria: rows that count."""
    x = value if criteria is None else F.when(criteria, value)
    n = F.coalesce(F.count(x), F.lit(0))
    found = {
        "SUM": lambda: F.coalesce(F.sum(x), F.lit(0.0)), "COUNT": lambda: n, "COUNTA": lambda: n, "COUNTBLANK": lambda: F.count_if(x.isNull()),
        "AVERAGE": lambda: F.coalesce(F.avg(x), F.lit(0.0)), "MIN": lambda: F.coalesce(F.min(x), F.lit(0.0)), "MAX": lambda: F.coalesce(F.max(x), F.lit(0.0)),
        "PRODUCT": lambda: F.product(x), "MEDIAN": lambda: F.median(x), "STDEV": lambda: F.stddev_samp(x), "VAR": lambda: F.var_samp(x), "MODE": lambda: F.mode(x, True),
    }
    return found[function]()
