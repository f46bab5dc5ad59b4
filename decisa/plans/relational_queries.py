"""Generic analytics on the star schema: the same operators over orders and line items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from decisa.functions import windows
from decisa.operators import asof, joins, panel as books
from decisa.plans.base import query, rounded, table


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def local_supplier_revenue(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    l = t("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    j = l.join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority), ())""")
def order_grouping_sets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupingSets([[F.col("o_orderpriority"), F.col("o_orderstatus")], [F.col("o_orderpriority")], []], "o_orderpriority", "o_orderstatus")
    return o.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def customers_without_orders(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "leftanti").select("c_custkey")


@query("""SELECT DISTINCT p_partkey FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity > 45""")
def parts_in_bulk(spark, sf_dir):
    return table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem").filter("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "leftsemi").select("p_partkey")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders), m AS (SELECT a.o_orderkey, max(struct_pack(d := b.o_orderdate, k := b.o_orderkey, p := b.o_totalprice)) AS b FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate GROUP BY 1)
SELECT o_orderkey, round(b.p, 6) AS previous FROM m""")
def previous_order_value(spark, sf_dir):
    """Each order with the customer's last order value strictly before it."""
    o = table(spark, sf_dir, "orders")
    facts = o.select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("previous"))
    return rounded(asof.asof_join(o.select("o_orderkey", "o_custkey", "o_orderdate"), facts, ["o_custkey"], "o_orderdate", "o_orderdate", ["previous"], strict=True, tie=["k"]).select("o_orderkey", "previous"))


@query("""WITH m AS (SELECT l_suppkey, date_trunc('month', l_shipdate) AS month, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, CAST(year(month) * 100 + month(month) AS INT) AS month, round((rank() OVER (PARTITION BY month ORDER BY v) - 1 + 0.5::DOUBLE * count(*) OVER (PARTITION BY month, v)) / count(*) OVER (PARTITION BY month), 6) AS pct FROM m""")
def supplier_month_rank(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", (F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("month")).agg(F.sum("l_extendedprice").alias("v"))
    return rounded(windows.cross_section_mid_rank(m, "month", "v", "pct").select("l_suppkey", "month", "pct"))


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank, l_suppkey FROM lineitem) SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM k WHERE rank <= 3""")
def top_lines_by_supplier(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return books.top_k(l, ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 3).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("""WITH s AS (SELECT event_type, user_id FROM events) SELECT a.event_type AS left_type, b.event_type AS right_type, count(DISTINCT a.user_id) AS users FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY 1, 2""")
def event_type_overlap(spark, sf_dir):
    """Users that two event types share: distinct users of a type meet once, not once an event."""
    s = table(spark, sf_dir, "events").select("event_type", "user_id").distinct()
    a, b = s.select(F.col("event_type").alias("left_type"), "user_id"), s.select(F.col("event_type").alias("right_type"), "user_id")
    return a.join(b, "user_id").filter("left_type < right_type").groupBy("left_type", "right_type").agg(F.count("*").alias("users"))


@query("""SELECT o_orderkey, o_orderpriority, CASE WHEN o_totalprice >= 300000 THEN 'big' WHEN o_totalprice >= 100000 THEN 'mid' ELSE 'small' END AS band, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running FROM orders""")
def order_running_totals(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    band = F.when(F.col("o_totalprice") >= 300000, "big").when(F.col("o_totalprice") >= 100000, "mid").otherwise("small")
    return o.select("o_orderkey", "o_orderpriority", band.alias("band"), F.round(F.sum("o_totalprice").over(w), 2).alias("running"))


@query("""SELECT o.o_orderkey, o.o_totalprice, l.n AS lines FROM orders o JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F'""")
def overlay_line_counts(spark, sf_dir):
    """Order rows with a column laid over from line items; unknown keys and changed shared columns would be errors."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines")).join(o, "o_orderkey")
    return joins.overlay_labels(o, n, "o_orderkey", ["o_totalprice"], ["lines"]).filter("lines is not null")
