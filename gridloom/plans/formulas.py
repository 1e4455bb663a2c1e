"""Queries that compile formulas over columns."""

from pyspark.sql import functions as F

from ..functions.formula import with_formulas
from .registry import Tables, query


def formulas(df, id_cols, digits=None, **fs):
    out = with_formulas(df, fs).select(*id_cols, *fs)
    return out.withColumns({n: F.round(n, digits) for n in fs if dict(out.dtypes)[n] == "double"}) if digits else out


LINE = ["l_orderkey", "l_linenumber"]


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS a, round(l_quantity * 7 / 100, 6) AS b, round(-l_quantity + 2 * 3, 6) AS c, round(power(l_quantity, 2), 6) AS d, round(power(-2, 2), 6) AS e FROM lineitem")
def formula_arith(t: Tables):
    return formulas(t.lineitem, LINE, 6, a="=[l_extendedprice]*(1-[l_discount])", b="=[l_quantity]*7%", c="=-[l_quantity]+2*3", d="=[l_quantity]^2", e="=-2^2")


@query("SELECT l_orderkey, l_linenumber, floor(l_extendedprice * 10 + 0.5) / 10 AS a, floor(-l_quantity / 2 + 0.5) AS b, ceil(l_extendedprice) AS c, floor(l_extendedprice / 1000) * 1000 AS d, ceil(l_quantity / 5) * 5 AS e, floor(l_extendedprice) AS f FROM lineitem")
def formula_round_family(t: Tables):
    return formulas(t.lineitem, LINE, None, a="ROUND([l_extendedprice],1)", b="ROUND(-[l_quantity]/2)", c="ROUNDUP([l_extendedprice])", d="FLOOR([l_extendedprice],1000)", e="CEILING([l_quantity],5)", f="INT([l_extendedprice])")


@query("SELECT l_orderkey, l_linenumber, l_quantity % 7 + 0.0::DOUBLE AS a, -l_quantity % 7 + 0.0::DOUBLE AS b, sign(l_quantity - 25)::DOUBLE AS c, abs(l_quantity - 25) AS d FROM lineitem")
def formula_mod_sign(t: Tables):
    return formulas(t.lineitem, LINE, None, a="MOD([l_quantity],7)", b="MOD(-[l_quantity],7)", c="SIGN([l_quantity]-25)", d="ABS([l_quantity]-25)")


@query("SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 6) AS a, round(ln(l_quantity), 6) AS b, round(log10(l_quantity), 6) AS c, round(exp(l_discount), 6) AS d, round(pi() * l_quantity, 6) AS e, CASE WHEN l_quantity >= 20 THEN round(sqrt(l_quantity - 20), 6) END AS f FROM lineitem")
def formula_math(t: Tables):
    return formulas(t.lineitem, LINE, 6, a="SQRT([l_quantity])", b="LN([l_quantity])", c="LOG10([l_quantity])", d="EXP([l_discount])", e="PI()*[l_quantity]", f="SQRT([l_quantity]-20)")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS a, l_quantity > 10 AND l_discount > 0.05 AS b, l_quantity > 40 OR l_tax = 0 AS c, NOT l_quantity > 10 AS d, CASE WHEN l_quantity < 10 THEN 1.0::DOUBLE WHEN l_quantity < 30 THEN 2.0::DOUBLE END AS e, CASE WHEN l_quantity = 25 THEN -1.0::DOUBLE ELSE round(1 / (l_quantity - 25), 9) END AS f FROM lineitem")
def formula_logic(t: Tables):
    out = formulas(t.lineitem, LINE, None, a='IF([l_quantity]>25,"big","small")', b="AND([l_quantity]>10,[l_discount]>0.05)", c="OR([l_quantity]>40,[l_tax]=0)", d="NOT([l_quantity]>10)", e="IFS([l_quantity]<10,1,[l_quantity]<30,2)", f="IFERROR(1/([l_quantity]-25),-1)")
    return out.withColumn("f", F.round("f", 9))


@query("SELECT o_orderkey, CASE lower(o_orderstatus) WHEN 'o' THEN 'open' WHEN 'f' THEN 'filled' ELSE 'other' END AS a, CASE l WHEN 1 THEN 'x' WHEN 2 THEN 'y' END AS b FROM (SELECT *, o_orderkey % 3 AS l FROM orders)")
def formula_switch(t: Tables):
    return formulas(t.orders, ["o_orderkey"], None, a='SWITCH([o_orderstatus],"o","open","F","filled","other")', b='CHOOSE(MOD([o_orderkey],3),"x","y")')


@query("SELECT p_partkey, left(p_name, 3) AS a, right(p_name, 4) AS b, substring(p_name, 2, 5) AS c, upper(p_brand) AS d, lower(p_type) AS e, length(p_name)::DOUBLE AS f, repeat(left(p_brand, 1), 3) AS g, p_name || ' / ' || p_size AS h, trim(regexp_replace('  ' || p_type || '  ', '\\s+', ' ', 'g')) AS i FROM part")
def formula_text(t: Tables):
    return formulas(t.part, ["p_partkey"], None, a="LEFT([p_name],3)", b="RIGHT([p_name],4)", c="MID([p_name],2,5)", d="UPPER([p_brand])", e="LOWER([p_type])", f="LEN([p_name])", g="REPT(LEFT([p_brand]),3)", h='[p_name]&" / "&[p_size]', i='TRIM("  "&[p_type]&"  ")')


@query("SELECT p_partkey, replace(p_name, 'a', '*') AS a, regexp_replace(p_name, 'a', '*') AS b, left(p_name, 1) || 'XY' || substring(p_name, 4) AS c FROM part")
def formula_substitute(t: Tables):
    return formulas(t.part, ["p_partkey"], None, a='SUBSTITUTE([p_name],"a","*")', b='SUBSTITUTE([p_name],"a","*",1)', c='REPLACE([p_name],2,2,"XY")')


@query("SELECT p_partkey, nullif(instr(p_name, 'e'), 0)::DOUBLE AS a, nullif(instr(lower(p_type), 'a'), 0)::DOUBLE AS b, p_name = p_type AS c FROM part")
def formula_find(t: Tables):
    return formulas(t.part, ["p_partkey"], None, a='FIND("e",[p_name])', b='SEARCH("A",[p_type])', c="EXACT([p_name],[p_type])")


@query(r"""SELECT c_custkey, array_to_string(list_transform(regexp_extract_all(lower(c_name || ' of-the ' || c_mktsegment), '[^A-Za-z0-9]+|[A-Za-z0-9]+'), lambda w: upper(left(w, 1)) || substring(w, 2)), '') AS a FROM customer""")
def formula_proper(t: Tables):
    return formulas(t.customer, ["c_custkey"], None, a='PROPER([c_name]&" of-the "&[c_mktsegment])')


@query("SELECT c_custkey, concat_ws('-', nullif(c_name, ''), nullif(c_mktsegment, ''), c_nationkey::VARCHAR) AS a, c_name || '--' || c_mktsegment AS b, c_name || c_mktsegment AS c FROM customer")
def formula_textjoin(t: Tables):
    return formulas(t.customer, ["c_custkey"], None, a='TEXTJOIN("-",1,[c_name],"",[c_mktsegment],[c_nationkey])', b='TEXTJOIN("-",0,[c_name],"",[c_mktsegment])', c="CONCATENATE([c_name],[c_mktsegment])")


_D = "(o_orderdate::DATE)"


@query(f"SELECT o_orderkey, ({_D} - DATE '1899-12-30')::DOUBLE AS a, year(o_orderdate)::DOUBLE AS b, month(o_orderdate)::DOUBLE AS c, day(o_orderdate)::DOUBLE AS d, (make_date(year(o_orderdate), month(o_orderdate), 1) - DATE '1899-12-30')::DOUBLE AS e FROM orders")
def formula_dates(t: Tables):
    return formulas(t.orders, ["o_orderkey"], None, a="[o_orderdate]+0", b="YEAR([o_orderdate])", c="MONTH([o_orderdate])", d="DAY([o_orderdate])", e="DATE(YEAR([o_orderdate]),MONTH([o_orderdate]),1)")


@query(f"SELECT o_orderkey, (dayofweek({_D}) + 1)::DOUBLE AS a, isodow({_D})::DOUBLE AS b, (isodow({_D}) - 1)::DOUBLE AS c FROM orders")
def formula_weekday(t: Tables):
    return formulas(t.orders, ["o_orderkey"], None, a="WEEKDAY([o_orderdate])", b="WEEKDAY([o_orderdate],2)", c="WEEKDAY([o_orderdate],3)")


@query(f"SELECT o_orderkey, (({_D} + INTERVAL 1 MONTH)::DATE - DATE '1899-12-30')::DOUBLE AS a, (({_D} - INTERVAL 13 MONTH)::DATE - DATE '1899-12-30')::DOUBLE AS b FROM orders")
def formula_edate(t: Tables):
    return formulas(t.orders, ["o_orderkey"], None, a="EDATE([o_orderdate],1)", b="EDATE([o_orderdate],-13)")


@query(f"SELECT o_orderkey, (last_day({_D}) - DATE '1899-12-30')::DOUBLE AS a, (last_day(({_D} + INTERVAL 2 MONTH)::DATE) - DATE '1899-12-30')::DOUBLE AS b FROM orders")
def formula_eomonth(t: Tables):
    return formulas(t.orders, ["o_orderkey"], None, a="EOMONTH([o_orderdate],0)", b="EOMONTH([o_orderdate],2)")


@query("SELECT o_orderkey, round(-(o_totalprice * power(1 + 0.05 / 12, 120)) * (0.05 / 12) / (power(1 + 0.05 / 12, 120) - 1), 4) AS a, round(100 * (power(1 + 0.05 / 12, 24) - 1) / (0.05 / 12) - o_totalprice * power(1 + 0.05 / 12, 24), 4) AS b, round(100 * 24 - o_totalprice, 4) AS c FROM orders")
def formula_finance(t: Tables):
    return formulas(t.orders, ["o_orderkey"], 4, a="PMT(0.05/12,120,[o_totalprice])", b="FV(0.05/12,24,-100,[o_totalprice])", c="FV(0,24,-100,[o_totalprice])")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity + l_discount + l_tax, 6) AS a, round((l_quantity + l_discount + l_tax) / 3, 6) AS b, greatest(l_quantity, l_discount, 3.0) AS c, least(l_quantity, 7.0) AS d, round(l_quantity * l_tax, 6) AS e, list_sort([l_quantity, 10.0::DOUBLE, 30.0::DOUBLE])[2] AS f FROM lineitem")
def formula_row_aggregates(t: Tables):
    return formulas(t.lineitem, LINE, 6, a="SUM([l_quantity],[l_discount],[l_tax])", b="AVERAGE([l_quantity],[l_discount],[l_tax])", c="MAX([l_quantity],[l_discount],3)", d="MIN([l_quantity],7)", e="PRODUCT([l_quantity],[l_tax])", f="MEDIAN([l_quantity],10,30)")


@query("""SELECT p_partkey, CASE WHEN p_size > 0 THEN NULL ELSE '#N/A' END AS none, CASE WHEN p_size = 10 THEN '#DIV/0!' END AS div0, CASE WHEN p_size < 20 THEN '#NUM!' END AS num, '#NAME?' AS name, CASE WHEN try_cast(p_name AS DOUBLE) IS NULL THEN '#VALUE!' END AS val FROM part""")
def formula_errors(t: Tables):
    fs = {"none": "[p_size]+1", "div0": "1/([p_size]-10)", "num": "SQRT([p_size]-20)", "name": "FOO([p_size])", "val": "VALUE([p_name])"}
    return with_formulas(t.part, fs, errors=True).select("p_partkey", *[F.col(f"{n}_err").alias(n) for n in fs])
