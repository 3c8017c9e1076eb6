"""General relational shapes over the star tables: the generic primitives beside the graph's operators."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from grapnel.plans.views import table
from grapnel.registry import query


def _t(spark, sf, *names):
    return [table(spark, sf, n) for n in names]


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS mean_discount, count(*) AS n
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def rel_pricing_summary(spark, sf):
    (l,) = _t(spark, sf, "lineitem")
    return l.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region
 WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY 1""")
def rel_local_suppliers(spark, sf):
    c, o, l, s, n, r = _t(spark, sf, "customer", "orders", "lineitem", "supplier", "nation", "region")
    j = c.join(o, c.c_custkey == o.o_custkey).join(l, l.l_orderkey == o.o_orderkey).join(s, (l.l_suppkey == s.s_suppkey) & (c.c_nationkey == s.s_nationkey)).join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.where("r_name = 'ASIA'").groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def rel_semi(spark, sf):
    c, o = _t(spark, sf, "customer", "orders")
    return c.join(o.where("o_totalprice > 200000"), c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def rel_anti(spark, sf):
    c, o = _t(spark, sf, "customer", "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT e.event_id, (SELECT max(o_orderkey) FROM orders o WHERE o.o_custkey = e.user_id AND o.o_orderdate <= e.ts AND o.o_orderdate = (SELECT max(o_orderdate) FROM orders p WHERE p.o_custkey = e.user_id AND p.o_orderdate <= e.ts)) AS order_key FROM events e")
def rel_asof(spark, sf):
    """Each event's last order of the same customer: union, then the last value carried forward."""
    e, o = _t(spark, sf, "events", "orders")
    left = e.select(F.col("user_id").alias("k"), "ts", F.lit(1).alias("side"), "event_id", F.lit(None).cast("long").alias("order_key"))
    right = o.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("ts"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("event_id"), F.col("o_orderkey").alias("order_key"))
    w = Window.partitionBy("k").orderBy("ts", "side", "order_key").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right).withColumn("found", F.last("order_key", ignorenulls=True).over(w)).where("side = 1").select("event_id", F.col("found").alias("order_key"))


@query("SELECT c_mktsegment, n_regionkey::BIGINT AS region, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (c_mktsegment, n_regionkey)")
def rel_cube(spark, sf):
    c, n = _t(spark, sf, "customer", "nation")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).withColumn("region", F.col("n_regionkey")).cube("c_mktsegment", "region").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def rel_top_per_group(spark, sf):
    (o,) = _t(spark, sf, "orders")
    return o.withColumn("rn", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("rn <= 3").select("o_custkey", "o_orderkey", "rn")


@query("SELECT p_partkey FROM part WHERE p_size < 20 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.05 EXCEPT SELECT l_partkey FROM lineitem WHERE l_tax > 0.07")
def rel_set_ops(spark, sf):
    p, l = _t(spark, sf, "part", "lineitem")
    return p.where("p_size < 20").select("p_partkey").intersect(l.where("l_discount > 0.05").select("l_partkey")).exceptAll(l.where("l_tax > 0.07").select("l_partkey").distinct()).distinct()


@query("SELECT c_custkey AS node, 'customer' AS kind, count(DISTINCT o_orderkey) AS n_out, round(sum(l_quantity / 50), 4) AS importance FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def rel_typed_graph_degree(spark, sf):
    """The star schema as a typed graph: importance from quantity, cost from tax (never above 9)."""
    c, o, l = _t(spark, sf, "customer", "orders", "lineitem")
    return c.join(o, c.c_custkey == o.o_custkey).join(l, l.l_orderkey == o.o_orderkey).groupBy(F.col("c_custkey").alias("node")).agg(F.countDistinct("o_orderkey").alias("n_out"), F.round(F.sum(F.col("l_quantity") / 50), 4).alias("importance")).withColumn("kind", F.lit("customer"))
