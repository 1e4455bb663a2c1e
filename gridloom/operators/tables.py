"""Subtotals, pivots, fits and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formula import V, criterion

AGGREGATES = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
    "avg": lambda c: F.coalesce(F.avg(c), F.lit(0.0)),
    "count": lambda c: F.count(c),
    "min": lambda c: F.coalesce(F.min(c), F.lit(0.0)),
    "max": lambda c: F.coalesce(F.max(c), F.lit(0.0)),
}


def key(c: str) -> Column:
    """Group keys: blanks are one group, the empty text."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def subtotal(df: DataFrame, by: str, measure: str, functions: tuple[str, ...] = ("sum", "avg", "count", "min", "max")) -> DataFrame:
    """One row per group; blanks of the measure are left out, an empty group gives 0."""
    return df.groupBy(key(by).alias(by)).agg(*[AGGREGATES[f](F.col(measure)).alias(f"{f}_{measure}") for f in functions])


def pivot(df: DataFrame, rows: str, columns: str, values: list[str], measure: str, function: str) -> DataFrame:
    """A cross table with 0 in empty cells; count counts rows. values: the columns, so no job looks for them."""
    cell = F.count(F.lit(1)) if function == "count" else AGGREGATES[function](F.col(measure))
    out = df.groupBy(key(rows).alias(rows)).pivot(columns, values).agg(cell)
    return out.select(rows, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(f"c_{v}") for v in values])


def linear_fit(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """slope, intercept, r2: null without spread in x, r2 1 without spread in y."""
    x_, y_ = F.col(x), F.col(y)
    flat = F.var_pop(x_) == 0
    r2 = F.when(flat, None).when(F.var_pop(y_) == 0, 1.0).otherwise(F.regr_r2(y_, x_))
    return df.groupBy(*(by or [])).agg(F.regr_slope(y_, x_).alias("slope"), F.regr_intercept(y_, x_).alias("intercept"), r2.alias("r2"))


def vlookup(df: DataFrame, table: DataFrame, on: str, table_key: str, value: str, order: str, name: str, missing: str | None = None) -> DataFrame:
    """df with the value of the table's first row (by order) for its key."""
    first = table.groupBy(F.col(table_key).alias(on)).agg(F.min_by(value, order).alias(name))
    out = df.join(first, on, "left")
    return out if missing is None else out.withColumn(name, F.coalesce(F.col(name).cast("string"), F.lit(missing)))


def positions(table: DataFrame, order: str, name: str = "pos") -> DataFrame:
    """A lookup table's rows with their place (from 1) in an order; the table is small enough for one window."""
    return table.withColumn(name, F.row_number().over(Window.orderBy(order)))


def match(df: DataFrame, table: DataFrame, on: str, table_key: str, order: str, name: str = "pos") -> DataFrame:
    """MATCH: df with the place of the table's first row whose key equals that of the row, text in any case; null without one."""

    def fold(c: str, of: DataFrame) -> Column:
        return F.lower(c) if dict(of.dtypes)[c] == "string" else F.col(c)

    first = positions(table, order, "_pos").groupBy(fold(table_key, table).alias("_key")).agg(F.min("_pos").alias(name))
    return df.join(first, fold(on, df) == F.col("_key"), "left").drop("_key")


def index(df: DataFrame, table: DataFrame, at: str, value: str, order: str, name: str) -> DataFrame:
    """INDEX: df with the value at the place of the table that column `at` tells; null outside the table."""
    cells = positions(table, order, "_pos").select(F.col("_pos").alias("_at"), F.col(value).alias(name))
    return df.join(cells, F.col(at) == F.col("_at"), "left").drop("_at")


def hlookup(df: DataFrame, wide: DataFrame, on: str, row: int, name: str, order: str) -> DataFrame:
    """HLOOKUP: df with the cell in the given row (from 1, by order) of the column of `wide` that is named as the key."""
    columns = [c for c in wide.columns if c != order]
    cells = positions(wide, order, "_pos").where(F.col("_pos") == row).select(*[F.col(c).cast("string") for c in columns])
    long = cells.unpivot([], columns, "_key", name)
    return df.join(long, F.col(on).cast("string") == F.col("_key"), "left").drop("_key")


def kth(df: DataFrame, column: str, k: int, largest: bool = True) -> DataFrame:
    """LARGE or SMALL: one row with the kth value (column value), null if there are fewer. A heap of k rows a task."""
    c = F.col(column)
    few = df.where(c.isNotNull()).orderBy(c.desc() if largest else c.asc()).limit(k)
    return few.agg(F.when(F.count("*") == k, F.min(c) if largest else F.max(c)).alias("value"))


def meets(column: Column, kind: str, condition: str) -> Column:
    """Whether a cell (kind num or str) meets a criteria string of SUMIF and its like, as in formulas."""
    return criterion(V(kind, column), V("str", F.lit(condition)))


def conditional(df: DataFrame, function: str, value: str | None, conditions: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """SUMIF(S), COUNTIF(S) and AVERAGEIF over columns and criteria strings: one row (column value), or one a group."""
    kinds = dict(df.dtypes)
    tests = [meets(F.col(c) if kinds[c] == "string" else F.col(c).cast("double"), "str" if kinds[c] == "string" else "num", x) for c, x in conditions.items()]
    hit = reduce(lambda a, b: a & b, tests)
    chosen = F.when(hit, F.coalesce(F.col(value).cast("double"), F.lit(0.0))) if value else None
    out = {"COUNT": lambda: F.count_if(hit), "SUM": lambda: F.coalesce(F.sum(chosen), F.lit(0.0)), "AVERAGE": lambda: F.coalesce(F.avg(chosen), F.lit(0.0))}[function]()
    return df.groupBy(*(by or [])).agg(out.alias("value"))


def solve2(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> tuple[Column, Column]:
    """x, y of ax + by = e, cx + dy = f; null where singular."""
    det = a * d - b * c
    ok = F.abs(det) >= 1e-12
    det = F.when(ok, det)
    return (e * d - b * f) / det, (a * f - e * c) / det
