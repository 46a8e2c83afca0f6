"""Sorts, limits, set operations and subquery shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import on_tables
from .aggregates import money

c = F.col


@on_tables("srt_01_many_keys", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey")
def many_keys(t):
    return t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice").orderBy("o_orderstatus", c("o_totalprice").desc(), "o_orderkey")


@on_tables("srt_02_by_aggregate", "SELECT o_orderpriority, sum(o_totalprice::DECIMAL(12,2))::DOUBLE AS total FROM orders GROUP BY 1 ORDER BY total DESC")
def by_aggregate(t):
    return t.orders.groupBy("o_orderpriority").agg(F.sum(money("o_totalprice")).cast("double").alias("total")).orderBy(c("total").desc())


@on_tables("srt_03_by_ordinal", "SELECT n_regionkey, n_name FROM nation ORDER BY 1, 2, 1")
def by_ordinal(t):
    return t.spark.sql("SELECT n_regionkey, n_name FROM {nation} ORDER BY 1, 2, 1", nation=t.nation)


@on_tables("srt_04_by_case", "SELECT p_partkey, p_type, p_size FROM part ORDER BY CASE WHEN p_size > 25 THEN p_type END, p_size, p_partkey")
def by_case(t):
    case = F.when(c("p_size") > 25, c("p_type"))
    return t.part.select("p_partkey", "p_type", "p_size").orderBy(case.asc_nulls_last(), "p_size", "p_partkey")


@on_tables("srt_05_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_k(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(c("o_totalprice").desc(), "o_orderkey").limit(100)


@on_tables("srt_06_limit_sample", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 1500")
def limit_sample(t):
    """An unordered limit is not repeatable; ordering by the key first makes it so."""
    return t.events.select("event_id", "event_type").orderBy("event_id").limit(1500)


@on_tables("srt_07_view_without_order", """SELECT c_mktsegment, year(o_orderdate) AS year, sum(o_totalprice::DECIMAL(12,2))::DOUBLE / count(*) AS average FROM orders
    JOIN customer ON o_custkey = c_custkey GROUP BY ALL ORDER BY average DESC""")
def view_without_order(t):
    """The view holds the aggregate; only the final query sorts."""
    joined = t.orders.join(t.customer.select("c_custkey", "c_mktsegment"), c("o_custkey") == c("c_custkey"))
    view = joined.groupBy("c_mktsegment", F.year("o_orderdate").cast("long").alias("year")).agg(
        (F.sum(money("o_totalprice")).cast("double") / F.count("*")).alias("average"))
    view.createOrReplaceTempView("tallyforge_segment_averages")
    return t.spark.sql("SELECT * FROM tallyforge_segment_averages ORDER BY average DESC")


@on_tables("set_01_union_all", "SELECT c_nationkey AS k, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def union_all(t):
    tagged = lambda frame, key, kind: frame.select(c(key).alias("k"), F.lit(kind).alias("kind"))
    return tagged(t.customer, "c_nationkey", "customer").unionByName(tagged(t.supplier, "s_nationkey", "supplier"))


@on_tables("set_02_union_distinct", "SELECT o_custkey AS k FROM orders UNION SELECT user_id FROM events")
def union_distinct(t):
    return t.orders.select(c("o_custkey").alias("k")).union(t.events.select(c("user_id").alias("k"))).distinct()


@on_tables("set_03_intersect_chain", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders INTERSECT SELECT user_id FROM events")
def intersect_chain(t):
    keys = lambda frame, name: frame.select(c(name).alias("k"))
    return keys(t.customer, "c_custkey").intersect(keys(t.orders, "o_custkey")).intersect(keys(t.events, "user_id"))


@on_tables("set_04_except_chain", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48 EXCEPT SELECT s_suppkey FROM supplier")
def except_chain(t):
    keys = lambda frame, name: frame.select(c(name).alias("k"))
    big = t.lineitem.where(c("l_quantity") > 48)
    return keys(t.part, "p_partkey").subtract(keys(big, "l_partkey")).subtract(keys(t.supplier, "s_suppkey"))


_PER_SQL = "(SELECT o_custkey, year(o_orderdate) AS year, sum(o_totalprice::DECIMAL(12,2))::DOUBLE AS total FROM orders GROUP BY ALL)"


@on_tables("sub_01_cte_used_twice", f"SELECT a.o_custkey, a.year, a.total, b.total AS before FROM {_PER_SQL} a JOIN {_PER_SQL} b ON a.o_custkey = b.o_custkey AND a.year = b.year + 1")
def cte_used_twice(t):
    """Both sides share one shuffled aggregate: Spark reuses the exchange."""
    per = t.orders.groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("year")).agg(F.sum(money("o_totalprice")).cast("double").alias("total"))
    before = per.select("o_custkey", (c("year") + 1).alias("year"), c("total").alias("before"))
    return per.join(before, ["o_custkey", "year"])


@on_tables("sub_02_correlated_average", """SELECT p_partkey FROM part a WHERE p_retailprice::DECIMAL(12,2)::DOUBLE >
    1.04 * (SELECT sum(p_retailprice::DECIMAL(12,2))::DOUBLE / count(*) FROM part b WHERE b.p_brand = a.p_brand)""")
def correlated_average(t):
    means = t.part.groupBy("p_brand").agg((F.sum(money("p_retailprice")).cast("double") / F.count("*")).alias("m"))
    return t.part.join(means, "p_brand").where(money("p_retailprice").cast("double") > F.lit(1.04) * c("m")).select("p_partkey")


@on_tables("sub_03_uncorrelated_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
def uncorrelated_scalar(t):
    highest = t.orders.agg(F.max("o_totalprice").alias("m"))
    return t.orders.where(c("o_totalprice") == highest.scalar()).select("o_orderkey")


@on_tables("sub_04_scalars_in_case", """SELECT CASE WHEN (SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) > 1000
    THEN (SELECT sum(l_extendedprice::DECIMAL(12,2))::DOUBLE / count(*) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20)
    ELSE (SELECT sum(l_tax::DECIMAL(12,2))::DOUBLE / count(*) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) END AS bucket""")
def scalars_in_case(t):
    small = t.lineitem.where(c("l_quantity").between(1, 20))
    mean = lambda name: F.sum(money(name)).cast("double") / F.count("*")
    return small.agg(F.when(F.count("*") > 1000, mean("l_extendedprice")).otherwise(mean("l_tax")).alias("bucket"))


@on_tables("sub_05_correlated_count", """SELECT DISTINCT p_name FROM part a WHERE (SELECT count(*) FROM part b WHERE b.p_brand = a.p_brand AND b.p_size = 50 AND b.p_type = 'PROMO') > 0""")
def correlated_count(t):
    brands = t.part.where((c("p_size") == 50) & (c("p_type") == "PROMO")).select("p_brand").distinct()
    return t.part.join(brands, "p_brand", "left_semi").select("p_name").distinct()


@on_tables("sub_06_exists_subquery", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50) AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
def exists_subquery(t):
    full = t.lineitem.where(c("l_quantity") == 50)
    africa = t.nation.where(c("n_regionkey") == 0)
    # NOT IN over a nullable key: a null on the left is never true, a null in the list makes all false
    has_null = africa.agg(F.coalesce(F.max(c("n_nationkey").isNull().cast("int")), F.lit(0)))
    return (t.supplier.join(full, c("l_suppkey") == c("s_suppkey"), "left_semi").where(c("s_nationkey").isNotNull() & (has_null.scalar() == 0))
            .join(africa, c("s_nationkey") == c("n_nationkey"), "left_anti").select("s_suppkey"))


@on_tables("sub_07_derived_table", "SELECT bucket, count(*) AS customers FROM (SELECT o_custkey, count(*) // 5 AS bucket FROM orders GROUP BY 1) GROUP BY 1")
def derived_table(t):
    return t.spark.sql("SELECT bucket, count(*) AS customers FROM (SELECT o_custkey, count(*) div 5 AS bucket FROM {orders} GROUP BY o_custkey) GROUP BY bucket", orders=t.orders)
