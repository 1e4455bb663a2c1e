"""Relational operators that Spark brings along; none is claimed for the original feature set."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..streaming import windows
from .registry import Tables, query


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def ext_semi_anti(t: Tables):
    o = t.orders
    has = t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return has.join(o.where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT coalesce(c_nationkey, s_nationkey) AS nationkey, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM (SELECT c_nationkey, count(*) c FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) s FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def ext_full_join(t: Tables):
    c = t.customer.groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("customers"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nationkey", "full").na.fill(0, ["customers", "suppliers"])


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def ext_setops(t: Tables):
    c, s = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select("s_nationkey")
    return c.intersect(s).exceptAll(t.nation.where("n_regionkey = 0").select("n_nationkey"))


@query("SELECT o_custkey, o_orderkey, rank() OVER w AS r, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS running, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def ext_window_rank(t: Tables):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", F.rank().over(w).cast("long").alias("r"), F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), F.lag("o_orderkey").over(w).alias("before"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def pivot_totals(t: Tables):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.grouping_id().alias("level"))


@query("SELECT year(o_orderdate)::BIGINT AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (year(o_orderdate), o_orderstatus)")
def ext_rollup(t: Tables):
    return t.orders.rollup(F.year("o_orderdate").cast("long").alias("y"), "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_windows(t: Tables):
    return windows.windowed_counts(t.events).withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def ext_session(t: Tables):
    return windows.sessions(t.events)


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def ext_pricing_summary(t: Tables):
    li = t.lineitem.where("l_shipdate <= timestamp'1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT event_id, last.event_id AS purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL) last ON e.user_id = last.user_id AND e.ts >= last.ts""".replace("SELECT event_id,", "SELECT e.event_id,"))
def ext_asof(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    hit = F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))
    return t.events.select("event_id", F.max(hit).over(w)["event_id"].alias("purchase"))
