"""Queries of the tabular operators: filters, sorts, subtotals, pivots, lookups, fits, scenarios, replicas."""

from pyspark.sql import functions as F

from ..functions.coerce import num, num_to_text, to_bool, to_num
from ..functions.formula import column_aggregate
from ..operators import filters, replicas, solve, tables
from .registry import Tables, query


def rounded(df, digits: int, *names: str):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("SELECT l_returnflag, round(sum(l_quantity), 2) AS sum_l_quantity, round(avg(l_quantity), 6) AS avg_l_quantity, count(l_quantity) AS count_l_quantity, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity FROM lineitem GROUP BY l_returnflag")
def subtotal_lineitem(t: Tables):
    return rounded(rounded(tables.subtotal(t.lineitem, "l_returnflag", "l_quantity"), 2, "sum_l_quantity"), 6, "avg_l_quantity")


def _pivot(function: str, digits: int):
    def run(t: Tables):
        out = tables.pivot(t.lineitem, "l_returnflag", "l_linestatus", ["F", "O"], "l_quantity", function)
        return rounded(out, digits, "c_F", "c_O") if function != "count" else out

    run.__name__ = f"pivot_{function}"
    cell = "count(*)" if function == "count" else f"{function}(l_quantity)"
    one = lambda v: f"{cell} FILTER (WHERE l_linestatus = '{v}')"
    shape = (lambda x: f"coalesce({x}, 0)") if function == "count" else (lambda x: f"coalesce(round({x}, {digits}), 0)")
    query(f"SELECT l_returnflag, {shape(one('F'))} AS \"c_F\", {shape(one('O'))} AS \"c_O\" FROM lineitem GROUP BY l_returnflag")(run)


for _f, _d in (("sum", 2), ("count", 0), ("avg", 6), ("min", 2), ("max", 2)):
    _pivot(_f, _d)


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_eq(t: Tables):
    return filters.autofilter(t.customer, [("c_mktsegment", "eq", "BUILDING")]).select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IS NULL OR c_mktsegment <> 'BUILDING'")
def filter_neq(t: Tables):
    return filters.autofilter(t.customer, [("c_mktsegment", "neq", "BUILDING")]).select("c_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a1') OR contains(lower(p_name), 'red')")
def filter_contains(t: Tables):
    hit = filters.criterion("p_name", "contains", "A1") | filters.criterion("p_name", "contains", "RED")
    return t.part.where(hit).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000")
def filter_gt(t: Tables):
    return filters.autofilter(t.orders, [("o_totalprice", "gt", "250000")], numeric=("o_totalprice",)).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 15")
def filter_between(t: Tables):
    return filters.autofilter(t.part, [("p_size", "between", "10|15")], numeric=("p_size",)).select("p_partkey", "p_size")


@query("SELECT count(*) FILTER (WHERE coalesce(c_mktsegment, '') = '') AS blanks, count(*) FILTER (WHERE coalesce(c_mktsegment, '') <> '') AS others FROM customer")
def filter_blank(t: Tables):
    return t.customer.agg(F.count_if(filters.criterion("c_mktsegment", "blank")).alias("blanks"), F.count_if(filters.criterion("c_mktsegment", "notblank")).alias("others"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice <= 100000 AND o_orderpriority <> '1-URGENT'")
def filter_multi(t: Tables):
    return filters.autofilter(t.orders, [("o_orderstatus", "eq", "F"), ("o_totalprice", "lte", "100000"), ("o_orderpriority", "neq", "1-URGENT")], numeric=("o_totalprice",)).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 25")
def filter_top_n(t: Tables):
    return filters.top_n(t.orders, "o_totalprice", 25, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderpriority, o_orderkey, rn FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def top_n_by_group(t: Tables):
    return filters.top_n_by(t.orders, "o_orderpriority", "o_totalprice", 3, "o_orderkey").select("o_orderpriority", "o_orderkey", F.col("rn").cast("long").alias("rn"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, lower(p_brand), p_partkey) AS pos FROM part")
def sort_multi(t: Tables):
    keys = [(F.col("p_size"), True), (F.lower("p_brand"), False), (F.col("p_partkey"), False)]
    return filters.with_rank(t.part, keys).select("p_partkey", F.col("pos").cast("long").alias("pos"))


@query("SELECT p_partkey, p_name, p_size FROM part")
def sort_rows(t: Tables):
    return filters.sort_rows(t.part, [("p_size", False, True), ("p_name", True, False)], "p_partkey").select("p_partkey", "p_name", "p_size")


@query("SELECT max(l_extendedprice) FILTER (WHERE d = 3) AS large3, max(l_extendedprice) FILTER (WHERE a = 5) AS small5 FROM (SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice DESC) AS d, row_number() OVER (ORDER BY l_extendedprice) AS a FROM lineitem)")
def kth_large_small(t: Tables):
    x = F.col("l_extendedprice")
    large = t.lineitem.orderBy(x.desc()).limit(3).agg(F.min(x).alias("large3"))
    return large.crossJoin(t.lineitem.orderBy(x).limit(5).agg(F.max(x).alias("small5")))  # one row each


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def vlookup_nation(t: Tables):
    found = tables.vlookup(t.customer, t.nation, "c_nationkey", "n_nationkey", "n_name", "n_nationkey", "n_name")
    return found.select("c_custkey", "n_name")


@query("SELECT s_suppkey, coalesce(n_name, '#N/A') AS n_name FROM supplier LEFT JOIN nation ON s_nationkey + 20 = n_nationkey")
def vlookup_missing(t: Tables):
    s = t.supplier.withColumn("k", F.col("s_nationkey") + 20)
    return tables.vlookup(s, t.nation, "k", "n_nationkey", "n_name", "n_nationkey", "n_name", "#N/A").select("s_suppkey", "n_name")


@query("SELECT max(CASE WHEN r_regionkey = 2 THEN r_name END) AS name FROM region")
def hlookup_region(t: Tables):
    wide = t.region.groupBy().pivot("r_regionkey", [0, 1, 2, 3, 4]).agg(F.first("r_name"))
    long = wide.unpivot([], wide.columns, "k", "name")
    return long.where(F.col("k") == "2").select("name")


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS pos, n_name FROM nation QUALIFY lower(n_name) = (SELECT lower(n_name) FROM nation WHERE n_nationkey = 7)")
def match_pos(t: Tables):
    name = t.nation.where("n_nationkey = 7").select(F.lower("n_name").alias("w"))
    hit = t.nation.join(F.broadcast(name), F.lower("n_name") == F.col("w")).orderBy("n_nationkey").limit(1)
    before = t.nation.select(F.col("n_nationkey").alias("k"))
    return before.join(F.broadcast(hit), F.col("k") <= F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("pos")).select("pos", "n_name")


@query("SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 4")
def index_cell(t: Tables):
    return t.nation.orderBy("n_nationkey").offset(4).limit(1).select("n_name")


def _conditional(name: str, sql: str, make):
    def run(t: Tables):
        return make(t)

    run.__name__ = name
    query(sql)(run)


def _x():
    return F.col("l_extendedprice")


def _q():
    return F.col("l_quantity")


_conditional("sumif", "SELECT round(coalesce(sum(l_extendedprice) FILTER (WHERE l_quantity > 15), 0), 2) AS v FROM lineitem", lambda t: t.lineitem.agg(F.round(column_aggregate("SUM", _x(), _q() > 15), 2).alias("v")))
_conditional("countif", "SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS v FROM lineitem", lambda t: t.lineitem.agg(F.count_if(F.lower("l_returnflag") == "r").alias("v")))
_conditional("averageif", "SELECT round(coalesce(avg(l_extendedprice) FILTER (WHERE l_quantity < 0), 0), 4) AS none, round(coalesce(avg(l_extendedprice) FILTER (WHERE l_quantity <= 10), 0), 4) AS v FROM lineitem", lambda t: t.lineitem.agg(F.round(column_aggregate("AVERAGE", _x(), _q() < 0), 4).alias("none"), F.round(column_aggregate("AVERAGE", _x(), _q() <= 10), 4).alias("v")))
_conditional("sumifs", "SELECT round(coalesce(sum(l_extendedprice) FILTER (WHERE l_quantity > 10 AND l_returnflag = 'A'), 0), 2) AS v FROM lineitem", lambda t: t.lineitem.agg(F.round(column_aggregate("SUM", _x(), (_q() > 10) & (F.col("l_returnflag") == "A")), 2).alias("v")))
_conditional("countifs", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice > 100000) AS v FROM orders GROUP BY o_orderpriority", lambda t: t.orders.groupBy("o_orderpriority").agg(F.count_if((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 100000)).alias("v")))


@query("""WITH m AS (SELECT l_quantity AS mode FROM lineitem GROUP BY l_quantity ORDER BY count(*) DESC, l_quantity LIMIT 1)
SELECT round(median(l_extendedprice), 4) AS median, any_value(mode) AS mode, round(stddev_samp(l_extendedprice), 4) AS stdev, round(var_samp(l_quantity), 6) AS var FROM lineitem, m""")
def stats_median_mode_var(t: Tables):
    a = column_aggregate
    return t.lineitem.agg(F.round(a("MEDIAN", _x()), 4).alias("median"), a("MODE", _q()).alias("mode"), F.round(a("STDEV", _x()), 4).alias("stdev"), F.round(a("VAR", _q()), 6).alias("var"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY l_returnflag")
def linear_fit(t: Tables):
    return rounded(rounded(tables.linear_fit(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"]), 4, "slope", "intercept"), 6, "r2")


@query("""WITH s AS (SELECT l_returnflag, sum(l_quantity) a, sum(l_discount) b, sum(l_tax) c, count(*) d, sum(l_extendedprice) e, sum(l_quantity * l_tax) f FROM lineitem GROUP BY 1)
SELECT l_returnflag, round((e * d - b * f) / (a * d - b * c), 4) AS x, round((a * f - e * c) / (a * d - b * c), 4) AS y FROM s""")
def solve2_group(t: Tables):
    s = t.lineitem.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("a"), F.sum("l_discount").alias("b"), F.sum("l_tax").alias("c"), F.count("*").cast("double").alias("d"), F.sum("l_extendedprice").alias("e"), F.sum(F.col("l_quantity") * F.col("l_tax")).alias("f"))
    x, y = tables.solve2(*[F.col(c) for c in "abcdef"])
    return s.select("l_returnflag", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query("SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root FROM part")
def goal_seek(t: Tables):
    price = F.col("p_retailprice")
    return t.part.select("p_partkey", F.round(solve.bisect(lambda x: x * x - price, F.lit(0.0), price + 1), 6).alias("root"))


@query("""WITH n AS (SELECT l_linenumber AS k, count(*)::DOUBLE n, sum(l_quantity) sx, sum(l_quantity * l_quantity) sxx, sum(l_extendedprice) sy, sum(l_quantity * l_extendedprice) sxy FROM lineitem GROUP BY 1)
SELECT k::BIGINT AS k, round((sy * sxx - sx * sxy) / (n * sxx - sx * sx), 2) AS intercept, round((n * sxy - sx * sy) / (n * sxx - sx * sx), 4) AS slope FROM n""")
def solve_normal_equations(t: Tables):
    q, y = F.col("l_quantity"), F.col("l_extendedprice")
    s = t.lineitem.groupBy(F.col("l_linenumber").alias("k")).agg(F.array(F.count("*").cast("double"), F.sum(q), F.sum(q), F.sum(q * q)).alias("m"), F.array(F.sum(y), F.sum(q * y)).alias("r"))
    got = solve.solve_rows(s, "k", "m", "r")
    return got.select("k", F.round(F.col("x")[0], 2).alias("intercept"), F.round(F.col("x")[1], 4).alias("slope"))


@query("SELECT p_partkey, CASE WHEN p_size = 1 THEN 99.5 WHEN p_size = 2 THEN 0.5 ELSE p_retailprice END AS price FROM part")
def scenario_apply(t: Tables):
    rows = [(1, 10.0, 1), (1, 99.5, 2), (2, 0.5, 3)]
    o = t.spark.createDataFrame(rows, "p_size int, value double, ord int")
    return filters.apply_scenario(t.part.withColumn("price", F.col("p_retailprice")), o, ["p_size"], "price").select("p_partkey", "price")


@query("SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS v FROM lineitem")
def sumproduct(t: Tables):
    return t.lineitem.agg(F.round(F.sum(_x() * (1 - F.col("l_discount"))), 2).alias("v"))


@query("SELECT p_mfr, p_brand, price, round(price / sum(price) OVER (), 8) AS share FROM (SELECT left(p_brand, 7) AS p_mfr, p_brand, sum(p_retailprice) AS price FROM part GROUP BY ALL)".replace("p_mfr, p_brand, price,", "p_brand, round(price, 2) AS price,").replace("left(p_brand, 7) AS p_mfr, ", ""))
def chart_shares(t: Tables):
    s = t.part.groupBy("p_brand").agg(F.sum("p_retailprice").alias("price"))
    total = s.agg(F.sum("price").alias("total"))
    return s.join(F.broadcast(total)).select("p_brand", F.round("price", 2).alias("price"), F.round(F.col("price") / F.col("total"), 8).alias("share"))


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT label::BIGINT AS label, i::BIGINT AS i, round(avg(e::DOUBLE), 6) AS mean FROM x GROUP BY label, i""")
def ensemble_mean(t: Tables):
    x = t.embeddings.select("label", F.posexplode("embedding").alias("i", "e"))
    return x.groupBy(F.col("label").cast("long").alias("label"), F.col("i").cast("long").alias("i")).agg(F.round(F.avg(F.col("e").cast("double")), 6).alias("mean"))


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS dot FROM embeddings")
def embedding_dot(t: Tables):
    e = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", F.round(F.aggregate(F.zip_with(e, e, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x), 6).alias("dot"))


@query("""SELECT user_id, max(event_id) AS version, count(*) AS versions, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id""")
def history_latest(t: Tables):
    return replicas.latest_versions(t.events, "user_id", "event_id", "event_type")


@query("""WITH l AS (SELECT user_id AS id, event_id AS lamport, event_type = 'error' AS tomb, event_type AS value FROM events)
SELECT id, min(lamport) AS lamport, max(tomb::INT)::BOOLEAN AS tomb, arg_max(value, lamport) AS value FROM l GROUP BY id""")
def crdt_merge_state(t: Tables):
    log = t.events.select(F.col("user_id").alias("id"), F.col("event_id").alias("lamport"), (F.col("event_type") == "error").alias("tomb"), F.col("event_type").alias("value"))
    return replicas.merge_replicas(log.where("lamport % 2 = 0"), log.where("lamport % 3 = 0"), log)


@query("""WITH l AS (SELECT user_id AS id, min(event_id) AS lamport, bool_or(event_type = 'error') AS tomb FROM events GROUP BY 1)
SELECT id, lamport FROM l WHERE NOT tomb""")
def crdt_materialise(t: Tables):
    log = t.events.select(F.col("user_id").alias("id"), F.col("event_id").alias("lamport"), (F.col("event_type") == "error").alias("tomb"), F.col("event_type").alias("value"))
    return replicas.live(replicas.merge_replicas(log)).select("id", "lamport").orderBy("lamport", "id")


@query("""SELECT p_partkey, coalesce(try_cast(regexp_extract(p_name || '', '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)') AS DOUBLE), 0) AS n, try_cast(p_size || '' AS DOUBLE) AS whole, TRUE AS yes, p_size::VARCHAR AS txt FROM part""")
def coercions(t: Tables):
    return t.part.select("p_partkey", num("p_name").alias("n"), to_num(F.col("p_size").cast("string")).alias("whole"), to_bool(F.col("p_brand")).alias("yes"), num_to_text("p_size").alias("txt"))


@query("SELECT count(*) AS blanks_counted, round(sum(coalesce(c_acctbal, 0)), 2) AS total, round(max(abs(c_acctbal)), 2) AS largest FROM customer")
def sum_flat(t: Tables):
    b = F.coalesce(F.col("c_acctbal"), F.lit(0.0))
    return t.customer.agg(F.count("*").alias("blanks_counted"), F.round(F.sum(b), 2).alias("total"), F.round(F.max(F.abs("c_acctbal")), 2).alias("largest"))
