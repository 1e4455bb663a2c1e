"""Spreadsheet coercions between text, numbers and booleans, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PREFIX = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c: Column | str) -> Column:
    """The number at the start of a text, 0 where there is none (filters and sorts)."""
    return F.coalesce(F.regexp_substr(_col(c).cast("string"), F.lit(_PREFIX)).try_cast("double"), F.lit(0.0))


def to_num(c: Column | str) -> Column:
    """A whole text as a number, null otherwise (formulas). A Java suffix as in 1d is no number."""
    text = F.trim(_col(c).cast("string"))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def to_bool(c: Column | str) -> Column:
    """Text as a truth value: anything but the empty text and FALSE, in any case."""
    text = F.coalesce(_col(c).cast("string"), F.lit(""))
    return (text != "") & (F.upper(text) != "FALSE")


def num_to_text(c: Column | str) -> Column:
    """A number as text: integers below 1e15 plainly, others with up to twelve significant digits."""
    x = _col(c).cast("double")
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    plain = F.format_string("%.12g", x)
    short = F.when(plain.contains("e"), F.regexp_replace(plain, r"\.?0+e", "e")).when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    return F.when(whole, x.try_cast("decimal(16,0)").cast("string")).otherwise(short)


def blank(c: Column | str) -> Column:
    """Null and the empty text are blank."""
    return F.coalesce(_col(c).cast("string"), F.lit("")) == ""
