"""Window shapes. Frames over a group that may hold most rows use ``operators.ordered``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.common import with_group
from ..registry import on_tables
from .aggregates import money
from .ordered import running, with_group_position, with_position

c = F.col


def _supplier_totals(t):
    lines = t.lineitem.groupBy("l_suppkey").agg(F.sum(money("l_extendedprice")).alias("v"))
    return lines.join(t.supplier.select("s_suppkey", "s_nationkey"), c("l_suppkey") == c("s_suppkey")).select("s_nationkey", "s_suppkey", "v")


_SUPP_SQL = "WITH s AS (SELECT s_nationkey, s_suppkey, sum(l_extendedprice::DECIMAL(12,2)) v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) "


@on_tables("win_01_rank_in_partition", _SUPP_SQL + "SELECT s_nationkey, s_suppkey, v::DOUBLE AS v, rank() OVER (PARTITION BY s_nationkey ORDER BY v DESC) AS rnk FROM s")
def rank_in_partition(t):
    """Every row keeps its rank, so the place comes from a distributed sort, ties share the first place."""
    totals = _supplier_totals(t).withColumn("down", -c("v"))
    placed = with_group_position(totals, ["s_nationkey"], ["down", "s_suppkey"], "place")
    first = placed.groupBy("s_nationkey", "down").agg(F.min("place").alias("rnk"))
    return placed.join(first, ["s_nationkey", "down"]).select("s_nationkey", "s_suppkey", c("v").cast("double").alias("v"), "rnk")


@on_tables("win_02_rank_unpartitioned", _SUPP_SQL + "SELECT s_suppkey, rank() OVER (ORDER BY v) AS up, rank() OVER (ORDER BY v DESC) AS down FROM s")
def rank_unpartitioned(t):
    totals = _supplier_totals(t)
    placed = with_position(totals, ["v", "s_suppkey"], "place")
    same = placed.groupBy("v").agg(F.min("place").alias("up"), F.max("place").alias("last"))
    size = totals.agg(F.count("*").alias("n"))
    return placed.join(same, "v").select("s_suppkey", "up", (size.scalar() - c("last") + 1).alias("down"))


@on_tables("win_03_rank_by_level", """WITH r AS (SELECT p_type, p_brand, count(*) AS n, (grouping(p_type) + grouping(p_brand))::BIGINT AS level, grouping(p_brand) g FROM part GROUP BY ROLLUP (p_type, p_brand))
    SELECT p_type, p_brand, n, level, rank() OVER (PARTITION BY level, CASE WHEN g = 0 THEN p_type END ORDER BY n DESC) AS rank_within_parent FROM r""")
def rank_by_level(t):
    levels = (t.part.groupBy("p_type", "p_brand").count().rollup("p_type", "p_brand")
              .agg(F.sum("count").alias("n"), (F.grouping("p_type") + F.grouping("p_brand")).cast("long").alias("level"), F.grouping("p_brand").alias("g")))
    line = Window.partitionBy("level", F.when(c("g") == 0, c("p_type"))).orderBy(c("n").desc())
    return levels.withColumn("rank_within_parent", F.rank().over(line).cast("long")).drop("g")


@on_tables("win_04_row_number_small", """SELECT c_mktsegment, row_number() OVER (ORDER BY max(c_acctbal)) AS up, row_number() OVER (ORDER BY max(c_acctbal) DESC) AS down
    FROM customer GROUP BY 1""")
def row_number_small(t):
    """One row per segment: a fixed handful, so a single-partition window is right."""
    per = t.customer.groupBy("c_mktsegment").agg(F.max("c_acctbal").alias("m"))
    number = lambda order: F.row_number().over(Window.orderBy(order)).cast("long")
    return per.select("c_mktsegment", number(c("m").asc()).alias("up"), number(c("m").desc()).alias("down"))


@on_tables("win_05_share_of_total", _SUPP_SQL + "SELECT s_nationkey, s_suppkey, v::DOUBLE * 100 / (sum(v) OVER (PARTITION BY s_nationkey))::DOUBLE AS share FROM s")
def share_of_total(t):
    shared = with_group(_supplier_totals(t), ["s_nationkey"], F.sum("v").alias("whole"))
    return shared.select("s_nationkey", "s_suppkey", (c("v").cast("double") * 100 / c("whole").cast("double")).alias("share"))


@on_tables("win_06_average_of_sums", _SUPP_SQL + """SELECT s_nationkey, s_suppkey, v::DOUBLE AS v,
    (sum(v) OVER (PARTITION BY s_nationkey))::DOUBLE / count(*) OVER (PARTITION BY s_nationkey) AS nation_avg FROM s""")
def average_of_sums(t):
    shared = with_group(_supplier_totals(t), ["s_nationkey"], (F.sum("v").cast("double") / F.count("*")).alias("nation_avg"))
    return shared.select("s_nationkey", "s_suppkey", c("v").cast("double").alias("v"), "nation_avg")


@on_tables("win_07_running_sum", """SELECT o_custkey, o_orderkey, (sum(o_totalprice::DECIMAL(12,2)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE AS running FROM orders""")
def running_sum(t):
    rows = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", money("o_totalprice").alias("p"))
    out = running(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "p", "running")
    return out.select("o_custkey", "o_orderkey", c("running").cast("double").alias("running"))


_FULL_SQL = """WITH d AS (SELECT user_id, day(ts) d, event_type e, sum((value * 100)::BIGINT)::BIGINT s FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL),
    a AS (SELECT user_id, d, s FROM d WHERE e = 'click'), b AS (SELECT user_id, d, s FROM d WHERE e = 'view'),
    j AS (SELECT coalesce(a.user_id, b.user_id) user_id, coalesce(a.d, b.d) AS day, a.s AS clicks, b.s AS views FROM a FULL JOIN b ON a.user_id = b.user_id AND a.d = b.d)
    SELECT user_id, day, max(clicks) OVER l AS clicks_high, max(views) OVER l AS views_high FROM j
    WINDOW l AS (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING)"""


@on_tables("win_08_running_max_over_full_outer", _FULL_SQL)
def running_max(t):
    def daily(kind, alias):
        cents = F.round(c("value") * 100).cast("long")
        return (t.events.where(c("event_type") == kind).groupBy("user_id", F.dayofmonth("ts").cast("long").alias("day")).agg(F.sum(cents).alias(alias)))

    both = daily("click", "clicks").join(daily("view", "views"), ["user_id", "day"], "full_outer")
    line = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most 31 rows a user
    return both.select("user_id", "day", F.max("clicks").over(line).alias("clicks_high"), F.max("views").over(line).alias("views_high"))


@on_tables("win_09_top_per_partition", """SELECT * FROM (SELECT p_brand, p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS rk FROM part) WHERE rk <= 5""")
def top_per_partition(t):
    """The rank filter lets Spark keep five rows per group inside each task before the shuffle."""
    ranked = t.part.withColumn("rk", F.rank().over(Window.partitionBy("p_brand").orderBy(c("p_retailprice").desc())))
    return ranked.where(c("rk") <= 5).select("p_brand", "p_partkey", c("rk").cast("long").alias("rk"))


@on_tables("win_10_neighbours_by_rank", """WITH m AS (SELECT o_orderpriority p, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS mseq, sum(o_totalprice::DECIMAL(12,2))::DOUBLE s FROM orders GROUP BY ALL),
    r AS (SELECT *, rank() OVER (PARTITION BY p ORDER BY mseq) rn FROM m)
    SELECT a.p AS priority, a.mseq, a.s AS total, b.s AS previous, n.s AS following FROM r a JOIN r b ON b.p = a.p AND b.rn = a.rn - 1 JOIN r n ON n.p = a.p AND n.rn = a.rn + 1""")
def neighbours_by_rank(t):
    """The self-join form; the months of one priority are at most the calendar's."""
    mseq = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")
    monthly = t.orders.groupBy(c("o_orderpriority").alias("priority"), mseq.cast("long").alias("mseq")).agg(
        F.sum(money("o_totalprice")).cast("double").alias("total"))
    ranked = monthly.withColumn("rn", F.rank().over(Window.partitionBy("priority").orderBy("mseq")))
    before = ranked.select("priority", (c("rn") + 1).alias("rn"), c("total").alias("previous"))
    after = ranked.select("priority", (c("rn") - 1).alias("rn"), c("total").alias("following"))
    return ranked.join(before, ["priority", "rn"]).join(after, ["priority", "rn"]).drop("rn")
