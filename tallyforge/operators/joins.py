"""Join shapes. Nothing is broadcast by hand except fixed small tables; Spark broadcasts a
side by its measured size and splits skewed sort-merge partitions at run time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import on_tables
from .ordered import with_position

c = F.col


@on_tables("joi_01_inner_equi", "SELECT n_name, count(*) AS customers FROM customer, nation WHERE c_nationkey = n_nationkey GROUP BY n_name")
def inner_equi(t):
    per = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return per.join(t.nation, c("c_nationkey") == c("n_nationkey"), "inner").select("n_name", "customers")


@on_tables("joi_02_using_column", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def using_column(t):
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id").select("doc_id", "lang", "quality")


@on_tables("joi_03_many_tables", """SELECT cr.r_name AS customer_region, sr.r_name AS supplier_region, p_type, year(o_orderdate) AS year,
      sum(l_extendedprice::DECIMAL(12,2))::DOUBLE AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN part ON l_partkey = p_partkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
    JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey GROUP BY ALL""")
def many_tables(t):
    def place(role):
        joined = t.nation.join(t.region, c("n_regionkey") == c("r_regionkey"))
        return joined.select(c("n_nationkey").alias(f"{role}_nation"), c("r_name").alias(f"{role}_region"))

    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", c("l_extendedprice").cast("decimal(12,2)").alias("price"))
    joined = (lines.join(t.part.select("p_partkey", "p_type"), c("l_partkey") == c("p_partkey"))
              .join(t.supplier.select("s_suppkey", c("s_nationkey").alias("supplier_nation")), c("l_suppkey") == c("s_suppkey"))
              .join(t.orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("long").alias("year")), c("l_orderkey") == c("o_orderkey"))
              .join(t.customer.select("c_custkey", c("c_nationkey").alias("customer_nation")), c("o_custkey") == c("c_custkey"))
              .join(place("customer"), "customer_nation").join(place("supplier"), "supplier_nation"))
    return joined.groupBy("customer_region", "supplier_region", "p_type", "year").agg(F.sum("price").cast("double").alias("revenue"))


@on_tables("joi_04_left_outer", """SELECT c_custkey, coalesce(n, 0) AS orders_1998 FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) n FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1) ON o_custkey = c_custkey""")
def left_outer(t):
    counts = t.orders.where(F.year("o_orderdate") == 1998).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t.customer.join(counts, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders_1998"))


_PAIR_SQL = "(SELECT o_custkey k, month(o_orderdate) m, sum(o_totalprice::DECIMAL(12,2)) s FROM orders WHERE o_orderstatus = '{}' GROUP BY ALL)"


@on_tables("joi_05_full_outer", f"""SELECT coalesce(a.k, b.k) AS custkey, coalesce(a.m, b.m) AS month, a.s::DOUBLE AS open_total, b.s::DOUBLE AS filled_total
    FROM {_PAIR_SQL.format("O")} a FULL JOIN {_PAIR_SQL.format("F")} b ON a.k = b.k AND a.m = b.m""")
def full_outer(t):
    def totals(status, alias):
        return (t.orders.where(c("o_orderstatus") == status).groupBy(c("o_custkey").alias("custkey"), F.month("o_orderdate").cast("long").alias("month"))
                .agg(F.sum(c("o_totalprice").cast("decimal(12,2)")).cast("double").alias(alias)))

    return totals("O", "open_total").join(totals("F", "filled_total"), ["custkey", "month"], "full_outer")


@on_tables("joi_06_product_of_single_rows", """SELECT * FROM (SELECT count(*) AS orders FROM orders), (SELECT count(*) AS lines FROM lineitem),
    (SELECT count(*) AS small_lines FROM lineitem WHERE l_quantity < 10)""")
def single_rows(t):
    """Products of one-row aggregates: scalar subqueries, and one pass where the table is the same."""
    lines = t.lineitem.agg(F.count("*").alias("lines"), F.sum(F.when(c("l_quantity") < 10, 1).otherwise(0)).alias("small_lines"))
    return lines.select("lines", "small_lines", t.orders.agg(F.count("*").alias("n")).scalar().alias("orders"))


@on_tables("joi_07_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def exists(t):
    return t.customer.join(t.orders.where(c("o_totalprice") > 400000), c("o_custkey") == c("c_custkey"), "left_semi").select("c_custkey")


@on_tables("joi_08_exists_other_value", """SELECT DISTINCT l_orderkey FROM lineitem a WHERE EXISTS
    (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)""")
def exists_other_value(t):
    """EXISTS with ``<>`` holds where min and max differ; no pairs of rows are built."""
    return t.lineitem.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b")).where(c("a") != c("b")).select("l_orderkey")


@on_tables("joi_09_exists_or_exists", """SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
    OR c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')""")
def exists_or_exists(t):
    urgent = t.orders.where(c("o_orderpriority") == "1-URGENT").select(c("o_custkey").alias("c_custkey")).distinct().withColumn("u", F.lit(True))
    bought = t.events.where(c("event_type") == "purchase").select(c("user_id").alias("c_custkey")).distinct().withColumn("b", F.lit(True))
    flagged = t.customer.select("c_custkey").join(urgent, "c_custkey", "left").join(bought, "c_custkey", "left")
    return flagged.where(c("u").isNotNull() | c("b").isNotNull()).select("c_custkey")


@on_tables("joi_10_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def not_exists(t):
    return t.customer.join(t.orders.where(c("o_orderstatus") == "F"), c("o_custkey") == c("c_custkey"), "left_anti").select("c_custkey")


@on_tables("joi_11_left_join_is_null", "SELECT p_partkey FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45 WHERE l_orderkey IS NULL")
def left_join_is_null(t):
    big = t.lineitem.where((c("l_returnflag") == "R") & (c("l_quantity") > 45))
    return t.part.join(big, c("l_partkey") == c("p_partkey"), "left_anti").select("p_partkey")


@on_tables("joi_12_in_subquery", """SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN
    (SELECT r_regionkey FROM region WHERE r_name IN ('ASIA', 'EUROPE')))""")
def in_subquery(t):
    regions = t.region.where(c("r_name").isin("ASIA", "EUROPE"))
    nations = t.nation.join(regions, c("n_regionkey") == c("r_regionkey"), "left_semi")
    return t.supplier.join(nations, c("s_nationkey") == c("n_nationkey"), "left_semi").select("s_suppkey")


_MONTHLY_SQL = "(SELECT (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS mseq, sum(o_totalprice::DECIMAL(12,2))::DOUBLE s FROM orders GROUP BY 1)"


@on_tables("joi_13_offset_self_join", f"SELECT a.mseq, a.s AS total, b.s AS year_later FROM {_MONTHLY_SQL} a JOIN {_MONTHLY_SQL} b ON b.mseq = a.mseq + 12")
def offset_self_join(t):
    mseq = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    monthly = t.orders.groupBy(mseq.cast("long").alias("mseq")).agg(F.sum(c("o_totalprice").cast("decimal(12,2)")).cast("double").alias("total"))
    later = monthly.select((c("mseq") - 12).alias("mseq"), c("total").alias("year_later"))
    return monthly.join(later, "mseq")


@on_tables("joi_14_four_way_self_join", """WITH q AS (SELECT o_custkey, quarter(o_orderdate) qt, sum(o_totalprice::DECIMAL(12,2))::DOUBLE s FROM orders
      WHERE year(o_orderdate) = 1998 GROUP BY ALL)
    SELECT a.o_custkey AS custkey, a.s AS q1, b.s AS q2, x.s AS q3, d.s AS q4 FROM q a JOIN q b USING (o_custkey) JOIN q x USING (o_custkey) JOIN q d USING (o_custkey)
    WHERE a.qt = 1 AND b.qt = 2 AND x.qt = 3 AND d.qt = 4 AND d.s > a.s""")
def four_way_self_join(t):
    """One pivoted aggregate stands for the four copies of the same CTE."""
    per = (t.orders.where(F.year("o_orderdate") == 1998).withColumn("quarter", F.quarter("o_orderdate"))
           .groupBy(c("o_custkey").alias("custkey")).pivot("quarter", [1, 2, 3, 4])
           .agg(F.sum(c("o_totalprice").cast("decimal(12,2)"))))
    wide = per.select("custkey", *[c(str(q)).cast("double").alias(f"q{q}") for q in (1, 2, 3, 4)])
    return wide.where(c("q1").isNotNull() & c("q2").isNotNull() & c("q3").isNotNull() & (c("q4") > c("q1")))


@on_tables("joi_15_theta", """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey
    JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity < p_size AND l_extendedprice <= 10 * p_retailprice AND l_shipdate > o_orderdate + INTERVAL 5 DAY""")
def theta(t):
    parts = t.part.select("p_partkey", "p_size", "p_retailprice")
    low = t.lineitem.join(parts, (c("l_partkey") == c("p_partkey")) & (c("l_quantity") < c("p_size")) & (c("l_extendedprice") <= 10 * c("p_retailprice")))
    heads = t.orders.select("o_orderkey", "o_orderdate")
    late = low.join(heads, (c("l_orderkey") == c("o_orderkey")) & (F.to_date("l_shipdate") > F.date_add(F.to_date("o_orderdate"), 5)))
    return late.select("l_orderkey", "l_linenumber", "l_partkey")


@on_tables("joi_16_scalar_bounds", """SELECT event_id FROM events WHERE ts >= (SELECT min(ts) FROM events WHERE event_type = 'purchase') + INTERVAL 1 DAY
    AND ts <= (SELECT min(ts) FROM events WHERE event_type = 'purchase') + INTERVAL 3 DAY""")
def scalar_bounds(t):
    first = t.events.where(c("event_type") == "purchase").agg(F.min("ts").alias("t0"))
    day = F.expr("interval 1 day")
    return t.events.where((c("ts") >= first.scalar() + day) & (c("ts") <= first.scalar() + day * 3)).select("event_id")


@on_tables("joi_17_dimension_roles", """SELECT d1.n_name AS customer_nation, d2.n_name AS supplier_nation, count(*) AS lines
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation d1 ON d1.n_nationkey = c_nationkey JOIN nation d2 ON d2.n_nationkey = s_nationkey GROUP BY ALL""")
def dimension_roles(t):
    d1, d2 = t.nation.alias("d1"), t.nation.alias("d2")
    keys = (t.lineitem.select("l_orderkey", "l_suppkey").join(t.supplier.select("s_suppkey", "s_nationkey"), c("l_suppkey") == c("s_suppkey"))
            .join(t.orders.select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey"))
            .join(t.customer.select("c_custkey", "c_nationkey"), c("o_custkey") == c("c_custkey"))
            .groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("lines")))
    return (keys.join(d1, c("d1.n_nationkey") == c("c_nationkey")).join(d2, c("d2.n_nationkey") == c("s_nationkey"))
            .select(c("d1.n_name").alias("customer_nation"), c("d2.n_name").alias("supplier_nation"), "lines"))


@on_tables("joi_18_join_on_rank", """WITH s AS (SELECT l_suppkey k, sum(l_extendedprice::DECIMAL(12,2)) v FROM lineitem GROUP BY 1),
    r AS (SELECT k, rank() OVER (ORDER BY v, k) a, rank() OVER (ORDER BY v DESC, k) d FROM s)
    SELECT x.a AS rnk, x.k AS lowest, y.k AS highest FROM r x JOIN r y ON x.a = y.d WHERE x.a < 11""")
def join_on_rank(t):
    totals = t.lineitem.groupBy("l_suppkey").agg(F.sum(c("l_extendedprice").cast("decimal(12,2)")).alias("v"))

    def ten(order, alias):
        ranked = totals.withColumn("rnk", F.rank().over(Window.orderBy(order, "l_suppkey"))).where(c("rnk") < 11)
        return ranked.select(c("rnk").cast("long").alias("rnk"), c("l_suppkey").alias(alias))

    return ten(c("v").asc(), "lowest").join(ten(c("v").desc(), "highest"), "rnk")


@on_tables("joi_20_positional", """SELECT s_suppkey, p_partkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) n FROM supplier)
    JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) n FROM part) USING (n)""")
def positional(t):
    left = with_position(t.supplier.select("s_suppkey"), ["s_suppkey"], "n")
    right = with_position(t.part.select((-c("p_retailprice")).alias("down"), "p_partkey"), ["down", "p_partkey"], "n")
    return left.join(right, "n").select("s_suppkey", "p_partkey")


@on_tables("joi_19_wide_chain", """SELECT cr.r_name AS home, sr.r_name AS source, p_type, o_orderpriority, e.event_type, d.lang, count(*) AS lines, sum(l_quantity::BIGINT * e.n)::BIGINT AS weight
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey JOIN part ON l_partkey = p_partkey
    JOIN (SELECT user_id, min(event_type) event_type, count(*) n FROM events GROUP BY 1) e ON e.user_id = c_custkey JOIN documents d ON d.doc_id = c_custkey
    LEFT JOIN labels b ON b.doc_id = d.doc_id LEFT JOIN benchmark q ON q.item_id = d.doc_id LEFT JOIN (SELECT DISTINCT conv_id FROM conversations) v ON v.conv_id = d.doc_id
    LEFT JOIN pages g ON g.page_id = d.doc_id GROUP BY ALL""")
def wide_chain(t):
    """All tables in one chain; small filtered customer sides come first, the line items last."""
    def place(role, name):
        return t.nation.join(t.region, c("n_regionkey") == c("r_regionkey")).select(c("n_nationkey").alias(role), c("r_name").alias(name))

    active = t.events.groupBy("user_id").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))
    people = (t.customer.select("c_custkey", c("c_nationkey").alias("cn")).join(active, c("c_custkey") == c("user_id"))
              .join(t.documents.select("doc_id", "lang"), c("c_custkey") == c("doc_id")).join(t.labels.select("doc_id"), "doc_id", "left")
              .join(t.benchmark.select(c("item_id").alias("doc_id")), "doc_id", "left").join(t.conversations.select(c("conv_id").alias("doc_id")).distinct(), "doc_id", "left")
              .join(t.pages.select(c("page_id").alias("doc_id")), "doc_id", "left").join(place("cn", "home"), "cn"))
    bought = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority").join(people, c("o_custkey") == c("c_custkey"))
    lines = (t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", c("l_quantity").cast("long").alias("q")).join(bought, c("l_orderkey") == c("o_orderkey"))
             .join(t.part.select("p_partkey", "p_type"), c("l_partkey") == c("p_partkey"))
             .join(t.supplier.select("s_suppkey", c("s_nationkey").alias("sn")), c("l_suppkey") == c("s_suppkey")).join(place("sn", "source"), "sn"))
    return lines.groupBy("home", "source", "p_type", "o_orderpriority", "event_type", "lang").agg(F.count("*").alias("lines"), F.sum(c("q") * c("n")).alias("weight"))
