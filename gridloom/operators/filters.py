"""AutoFilter criteria, top N, scenario overrides and stable sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import blank, num


def criterion(column: str, op: str, value: str | None = None, numeric: bool = False) -> Column:
    """A filter's predicate. numeric: the column is a number already, so its statistics can be pushed down.

    eq never holds for blanks and neq does; comparisons read the number at a text's start, blanks as 0;
    contains ignores case; between takes "lo|hi", both included.
    """
    c = F.col(column)
    text = c.cast("string")
    if op == "blank":
        return blank(c)
    if op == "notblank":
        return ~blank(c)
    if op == "eq":
        return (~blank(c)) & (text == value)
    if op == "neq":
        return blank(c) | (text != value)
    if op == "contains":
        return ~blank(c) & (F.instr(F.lower(text), value.lower()) > 0) if value else ~blank(c)
    x = F.coalesce(c, F.lit(0)) if numeric else num(c)
    if numeric and op != "between":
        x = c if _fails_zero(op, float(value)) else x  # a null reads as 0: where 0 fails, plain comparison is the same and pushes down
    if op == "between":
        lo, bar, hi = (value or "").partition("|")
        if not bar:
            return F.lit(False)
        if numeric and not float(lo) <= 0 <= float(hi):
            x = c
        return x.between(float(lo), float(hi))
    bound = float(value)
    return {"gt": x > bound, "gte": x >= bound, "lt": x < bound, "lte": x <= bound}[op]


def _fails_zero(op: str, bound: float) -> bool:
    return not {"gt": 0 > bound, "gte": 0 >= bound, "lt": 0 < bound, "lte": 0 <= bound}[op]


def autofilter(df: DataFrame, criteria: list[tuple], numeric: tuple[str, ...] = ()) -> DataFrame:
    """Rows that meet all criteria (column, op, value)."""
    for column, op, *value in criteria:
        df = df.where(criterion(column, op, value[0] if value else None, column in numeric))
    return df


def top_n(df: DataFrame, column: str, n: int, row_id: str) -> DataFrame:
    """The n rows with the largest values, ties by the smallest row id; at least one row. A bounded heap a task."""
    return df.orderBy(F.coalesce(F.col(column), F.lit(0)).desc(), F.col(row_id)).limit(max(1, n))


def top_n_by(df: DataFrame, group: str, column: str, n: int, row_id: str) -> DataFrame:
    """top_n within each group; Spark keeps n rows of a group before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.col(column).desc(), F.col(row_id))
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def sort_keys(keys: list[tuple[str, bool, bool]], row_id: str) -> list[Column]:
    """(column, descending, numeric) in order, then the row id: a stable sort. Text ignores case, blanks are 0 or ""."""
    out = []
    for column, down, numeric in keys:
        k = num(column) if numeric else F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
        out.append(k.desc() if down else k.asc())
    return [*out, F.col(row_id).asc()]


def sort_rows(df: DataFrame, keys: list[tuple[str, bool, bool]], row_id: str) -> DataFrame:
    """Range-partitioned global sort."""
    return df.orderBy(*sort_keys(keys, row_id))


def with_rank(df: DataFrame, keys: list[Column], name: str = "pos", parts: int = 64) -> DataFrame:
    """df with the 1-based position of each row in the order of keys, without one task that sees all rows.

    Rows are range-partitioned by the first key through its approximate quantiles (`parts` numbers), ranked
    within a range, and ranges are offset by the sizes of those before. The first key must be numeric.
    """
    first, own = keys[0], "_" * (1 + max(map(len, df.columns)))  # no column of df begins so
    key, part, rank, ahead = (own + x for x in "krnb")
    df = df.withColumn(key, first[0].cast("double"))
    cuts = sorted(set(df.stat.approxQuantile(key, [i / parts for i in range(1, parts)], 0.001)))
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>"), lambda c: c < F.col(key)))
    df = df.withColumn(part, -place if first[1] else place)
    order = [F.col(key).desc() if first[1] else F.col(key).asc(), *[k[0].desc() if k[1] else k[0].asc() for k in keys[1:]]]
    sizes = df.groupBy(part).count()
    before = sizes.select(part, (F.sum("count").over(Window.orderBy(part)) - F.col("count")).alias(ahead))  # `parts` rows
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    return ranked.join(F.broadcast(before), part).withColumn(name, F.col(rank) + F.col(ahead)).drop(key, part, rank, ahead)


def apply_scenario(df: DataFrame, overrides: DataFrame, keys: list[str], column: str) -> DataFrame:
    """column with the overrides (keys, value, ord) put in: of several for a key the last in order wins."""
    last = overrides.groupBy(*keys).agg(F.max_by("value", "ord").alias("_v"))
    return df.join(last, keys, "left").withColumn(column, F.coalesce("_v", column)).drop("_v")
