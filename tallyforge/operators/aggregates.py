"""Grouped and global aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import on_tables
from .ordered import distribution, medians

c = F.col


def money(name: str) -> Column:
    return c(name).cast("decimal(12,2)")


def sum_numeric(frame: DataFrame, *keys: str) -> DataFrame:
    """Sum of every numeric column per key; text columns (an uncast CSV) are left out."""
    numeric = [n for n, t in frame.dtypes if n not in keys and t.startswith(("int", "bigint", "double", "float", "decimal", "smallint"))]
    return frame.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in numeric])


@on_tables("agg_01_count_per_group", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def count_per_group(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@on_tables("agg_02_basic_functions", """SELECT l_returnflag, l_linestatus, sum(l_quantity::BIGINT)::BIGINT AS sum_qty, sum(l_extendedprice::DECIMAL(12,2))::DOUBLE AS sum_price,
    sum(l_extendedprice::DECIMAL(12,2))::DOUBLE / count(*) AS avg_price, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price,
    count(l_tax) AS n FROM lineitem GROUP BY ALL""")
def basic_functions(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(c("l_quantity").cast("long")).alias("sum_qty"), F.sum(money("l_extendedprice")).cast("double").alias("sum_price"),
        (F.sum(money("l_extendedprice")).cast("double") / F.count("*")).alias("avg_price"), F.min("l_extendedprice").alias("min_price"),
        F.max("l_extendedprice").alias("max_price"), F.count("l_tax").alias("n"))


@on_tables("agg_03_mixed_aggregate", """SELECT o_custkey AS cust_id, strftime(max(o_orderdate), '%Y-%m-%d') AS most_recent, sum(o_totalprice::DECIMAL(12,2))::DOUBLE AS monetary,
    count(o_orderkey) AS frequency FROM orders GROUP BY 1""")
def mixed_aggregate(t):
    """Named aggregates; a dict of functions would leave the column order to the map."""
    return t.orders.groupBy(c("o_custkey").alias("cust_id")).agg(
        F.max("o_orderdate").cast("date").cast("string").alias("most_recent"), F.sum(money("o_totalprice")).cast("double").alias("monetary"),
        F.count("o_orderkey").alias("frequency"))


@on_tables("agg_04_sum_all_numeric", """SELECT l_returnflag, sum(l_orderkey)::BIGINT l_orderkey, sum(l_partkey)::BIGINT l_partkey, sum(l_linenumber)::BIGINT l_linenumber,
    sum(l_extendedprice::DECIMAL(12,2))::DOUBLE l_extendedprice FROM lineitem GROUP BY 1""")
def sum_all_numeric(t):
    narrow = t.lineitem.select("l_returnflag", "l_linestatus", "l_orderkey", "l_partkey", "l_linenumber", money("l_extendedprice").alias("l_extendedprice"))
    return sum_numeric(narrow, "l_returnflag").withColumn("l_extendedprice", c("l_extendedprice").cast("double"))


@on_tables("agg_05_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def count_distinct(t):
    """Two distinct counts: each is a de-duplication by (group, key), joined on the few groups."""
    def distinct_of(column, alias):
        return t.lineitem.select("l_returnflag", column).distinct().groupBy("l_returnflag").agg(F.count("*").alias(alias))

    return distinct_of("l_suppkey", "suppliers").join(distinct_of("l_orderkey", "orders"), "l_returnflag")


@on_tables("agg_06_select_distinct", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def select_distinct(t):
    return t.orders.select("o_custkey", "o_orderstatus").distinct()


@on_tables("agg_07_having", """SELECT o_custkey, sum(o_totalprice::DECIMAL(12,2))::DOUBLE AS total FROM orders GROUP BY 1
    HAVING count(*) > 10 AND sum(o_totalprice::DECIMAL(12,2))::DOUBLE > (SELECT sum(o_totalprice::DECIMAL(12,2))::DOUBLE / count(DISTINCT o_custkey) FROM orders)""")
def having(t):
    per = t.orders.groupBy("o_custkey").agg(F.sum(money("o_totalprice")).alias("s"), F.count("*").alias("n"))
    bar = per.agg((F.sum("s").cast("double") / F.count("*")).alias("bar"))
    return per.where((c("n") > 10) & (c("s").cast("double") > bar.scalar())).select("o_custkey", c("s").cast("double").alias("total"))


_ROLL_SQL = """SELECT {0} FROM orders GROUP BY ROLLUP (year(o_orderdate), o_orderstatus, o_orderpriority)"""


def _yearly(t):
    return t.orders.groupBy(F.year("o_orderdate").cast("string").alias("year"), "o_orderstatus", "o_orderpriority").agg(
        F.sum(money("o_totalprice")).alias("s"), F.count("*").alias("k"))


@on_tables("agg_08_rollup", _ROLL_SQL.format("year(o_orderdate)::VARCHAR AS year, o_orderstatus, o_orderpriority, sum(o_totalprice::DECIMAL(12,2))::DOUBLE AS total, count(*) AS n"))
def rollup(t):
    """The finest level is summed first; the roll-up multiplies those few rows, not the table."""
    return _yearly(t).rollup("year", "o_orderstatus", "o_orderpriority").agg(F.sum("s").cast("double").alias("total"), F.sum("k").alias("n"))


@on_tables("agg_09_grouping_level", _ROLL_SQL.format("""year(o_orderdate)::VARCHAR AS year, o_orderstatus, o_orderpriority, grouping(o_orderpriority)::BIGINT AS g_priority,
    (grouping(year(o_orderdate)) + grouping(o_orderstatus) + grouping(o_orderpriority))::BIGINT AS level, sum(o_totalprice::DECIMAL(12,2))::DOUBLE AS total"""))
def grouping_level(t):
    g = lambda name: F.grouping(name).cast("long")
    return _yearly(t).rollup("year", "o_orderstatus", "o_orderpriority").agg(
        g("o_orderpriority").alias("g_priority"), (g("year") + g("o_orderstatus") + g("o_orderpriority")).alias("level"),
        F.sum("s").cast("double").alias("total"))


@on_tables("agg_10_standard_deviation", """SELECT l_suppkey, round(stddev_samp(l_quantity), 6) AS stdev,
    round(stddev_samp(l_quantity) / (sum(l_quantity::BIGINT)::DOUBLE / count(*)), 6) AS cov FROM lineitem GROUP BY 1""")
def standard_deviation(t):
    mean = F.sum(c("l_quantity").cast("long")).cast("double") / F.count("*")
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.stddev_samp("l_quantity"), 6).alias("stdev"),
                                               F.round(F.stddev_samp("l_quantity") / mean, 6).alias("cov"))


@on_tables("agg_11_conditional_pivot", "SELECT user_id, " + ", ".join(
    f"count(*) FILTER (WHERE event_type = '{e}') AS {e}" for e in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")
def conditional_pivot(t):
    kinds = ["click", "error", "purchase", "signup", "view"]
    return t.events.groupBy("user_id").pivot("event_type", kinds).agg(F.count("event_id")).na.fill(0, kinds)


@on_tables("agg_12_aggregate_of_aggregate", """SELECT c_mktsegment, max(s)::DOUBLE AS best, sum(s)::DOUBLE / count(*) AS mean FROM
    (SELECT o_custkey, sum(o_totalprice::DECIMAL(12,2)) s FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def aggregate_of_aggregate(t):
    per = t.orders.groupBy("o_custkey").agg(F.sum(money("o_totalprice")).alias("s"))
    return per.join(t.customer.select("c_custkey", "c_mktsegment"), c("o_custkey") == c("c_custkey")).groupBy("c_mktsegment").agg(
        F.max("s").cast("double").alias("best"), (F.sum("s").cast("double") / F.count("*")).alias("mean"))


@on_tables("agg_13_global_over_empty", "SELECT count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS qty, max(l_partkey) AS part FROM lineitem WHERE l_quantity < 0")
def global_over_empty(t):
    return t.lineitem.where(c("l_quantity") < 0).agg(F.count("*").alias("n"), F.sum(c("l_quantity").cast("long")).alias("qty"), F.max("l_partkey").alias("part"))


@on_tables("agg_14_column_summary", """SELECT unnest(['count', 'mean', 'stddev', 'min', 'max']) AS summary,
    unnest([count(p_size)::DOUBLE, round(sum(p_size)::DOUBLE / count(*), 6), round(stddev_samp(p_size), 6), min(p_size)::DOUBLE, max(p_size)::DOUBLE]) AS p_size FROM part""")
def column_summary(t):
    return t.part.describe("p_size").select("summary", F.round(c("p_size").cast("double"), 6).alias("p_size"))


@on_tables("agg_15_mean_and_rows", "SELECT sum(s)::DOUBLE / count(*) AS mean_score, count(*) AS n FROM (SELECT sum(o_totalprice::DECIMAL(12,2)) s FROM orders GROUP BY o_custkey)")
def mean_and_rows(t):
    per = t.orders.groupBy("o_custkey").agg(F.sum(money("o_totalprice")).alias("s"))
    return per.agg((F.sum("s").cast("double") / F.count("*")).alias("mean_score"), F.count("*").alias("n"))


@on_tables("agg_16_distribution", """SELECT l_suppkey, count(l_quantity) AS count, sum(l_quantity::BIGINT)::BIGINT AS total, max(l_quantity::BIGINT) AS max,
    median(l_quantity) AS median FROM lineitem GROUP BY 1""")
def distribution_per_supplier(t):
    """The exact median picks the middle rows of a distributed sort: no group is gathered."""
    return distribution(t.lineitem.select("l_suppkey", c("l_quantity").cast("long").alias("q")), ["l_suppkey"], "q")


@on_tables("agg_17_counts_by_category", """SELECT event_type, lang, count(*) AS n FROM events JOIN documents ON doc_id = user_id GROUP BY ALL""")
def counts_by_category(t):
    per = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("k"))
    return per.join(t.documents.select("doc_id", "lang"), c("doc_id") == c("user_id")).groupBy("event_type", "lang").agg(F.sum("k").alias("n"))


@on_tables("agg_18_sum_of_medians", "SELECT sum(m) AS total FROM (SELECT o_orderpriority, median(o_totalprice) m FROM orders GROUP BY 1)")
def sum_of_medians(t):
    per = medians(t.orders.select("o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice")
    return per.agg(F.sum("median").alias("total"))
