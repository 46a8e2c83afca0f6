"""Projections and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import on_tables
from .ordered import with_position

c = F.col


def cast_columns(frame: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast the named columns in one projection; text that does not fit becomes null."""
    return frame.select(*[c(n).try_cast(types[n]).alias(n) if n in types else c(n) for n in frame.columns])


def level_of(value: Column) -> dict[str, Column]:
    """Alert levels by remaining life. The ranges meet at 30, so 30 is both RED and YELLOW;
    values under 10 have no level, as in the system this follows."""
    return {"RED": value.between(10, 30), "YELLOW": value.between(30, 60), "GREEN": value > 60}


@on_tables("prj_01_struct_star", "SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer")
def struct_star(t):
    return t.customer.select(F.struct("c_custkey", "c_name", "c_mktsegment").alias("data"), "c_nationkey").select("data.*", "c_nationkey")


@on_tables("prj_02_constant_column", "SELECT *, 'constant' AS new_column FROM nation")
def constant_column(t):
    return t.nation.withColumn("new_column", F.lit("constant"))


@on_tables("prj_03_load_timestamp", "SELECT s_suppkey, s_name, true AS stamped FROM supplier")
def load_timestamp(t):
    stamped = t.supplier.withColumn("time_stamp", F.current_timestamp())
    return stamped.select("s_suppkey", "s_name", (c("time_stamp") <= F.current_timestamp()).alias("stamped"))


@on_tables("prj_04_cast_loop", """SELECT p_partkey, TRY_CAST(p_name AS INTEGER) p_name, p_size::DOUBLE p_size,
    TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) p_brand FROM part""")
def cast_loop(t):
    text = t.part.select("p_partkey", "p_name", c("p_size").cast("string").alias("p_size"), F.replace(c("p_brand"), F.lit("Brand#"), F.lit("")).alias("p_brand"))
    return cast_columns(text, {"p_name": "int", "p_size": "double", "p_brand": "double"})


@on_tables("prj_05_rename_all", "SELECT r_regionkey AS id, r_name AS label FROM region")
def rename_all(t):
    return t.region.select("r_regionkey", "r_name").toDF("id", "label")


@on_tables("prj_06_rename_and_drop", "SELECT o_orderkey AS order_id, o_custkey, o_orderstatus FROM orders")
def rename_and_drop(t):
    return t.orders.withColumnRenamed("o_orderkey", "order_id").drop("o_totalprice", "o_orderdate", "o_orderpriority")


@on_tables("prj_07_sql_expressions", """SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS START_TIME,
    strftime(date_trunc('minute', ts) + INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') AS END_TIME, event_type AS WORD, event_id FROM events""")
def sql_expressions(t):
    return (t.events.select(F.window(c("ts").cast("timestamp"), "1 minute").alias("window"), "event_type", "event_id")
            .selectExpr("date_format(window.start, 'yyyy-MM-dd HH:mm:ss') AS START_TIME",
                        "date_format(window.end, 'yyyy-MM-dd HH:mm:ss') AS END_TIME", "event_type AS WORD", "event_id"))


@on_tables("prj_08_row_position", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS position FROM orders")
def row_position(t):
    return with_position(t.orders.select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "position")


@on_tables("prj_09_pack_json", """SELECT c_custkey, to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey})::VARCHAR AS value FROM customer""")
def pack_json(t):
    narrow = t.customer.select("c_custkey", "c_name", "c_nationkey")
    return narrow.select("c_custkey", F.to_json(F.struct("*")).alias("value"))


@on_tables("flt_01_inclusive_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 10000 AND 30000 AND year(o_orderdate) BETWEEN 1998 AND 1998 + 2")
def inclusive_range(t):
    kept = c("o_totalprice").between(10000, 30000) & F.year("o_orderdate").between(1998, 1998 + 2)
    return t.orders.where(kept).select("o_orderkey", "o_totalprice")


@on_tables("flt_02_comparisons", "SELECT o_orderkey FROM orders WHERE o_totalprice > 60000 AND o_custkey <= 500 AND o_orderstatus <> 'P' AND o_orderpriority != '1-URGENT'")
def comparisons(t):
    kept = (c("o_totalprice") > 60000) & (c("o_custkey") <= 500) & (c("o_orderstatus") != "P") & (c("o_orderpriority") != "1-URGENT")
    return t.orders.where(kept).select("o_orderkey")


@on_tables("flt_03_in_list", """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
    AND substr(lpad((o_custkey * 37 % 100000)::VARCHAR, 5, '0'), 1, 5) IN (SELECT lpad((k * 111 + 37)::VARCHAR, 5, '0') FROM range(400) g(k))""")
def in_list(t):
    """A short list is a literal; the list of 400 codes is a fixed-size broadcast semi join."""
    codes = t.spark.range(400).select(F.lpad((c("id") * 111 + 37).cast("string"), 5, "0").alias("code"))
    coded = t.orders.where(c("o_orderpriority").isin("1-URGENT", "2-HIGH")).withColumn(
        "code", F.substring(F.lpad((c("o_custkey") * 37 % 100000).cast("string"), 5, "0"), 1, 5))
    return coded.join(F.broadcast(codes), "code", "left_semi").select("o_orderkey", "o_custkey")


@on_tables("flt_04_like_prefix", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small%' OR p_name LIKE '%ring'")
def like_prefix(t):
    return t.part.where(c("p_name").like("small%") | c("p_name").endswith("ring")).select("p_partkey", "p_name")


@on_tables("flt_05_null_tests", """SELECT d.doc_id, l.quality IS NULL AS unlabelled FROM documents d LEFT JOIN labels l USING (doc_id)
    WHERE (l.quality IS NULL AND d.lang IS NOT NULL) OR l.toxic = 1""")
def null_tests(t):
    joined = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return joined.where((c("quality").isNull() & c("lang").isNotNull()) | (c("toxic") == 1)).select(
        "doc_id", c("quality").isNull().alias("unlabelled"))


@on_tables("flt_06_contains", "SELECT page_id, url FROM pages WHERE contains(url, '/fr/')")
def contains_literal(t):
    return t.pages.where(c("url").contains("/fr/")).select("page_id", "url")


@on_tables("flt_07_or_of_ands", """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE (p_type = 'SMALL' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5)
       OR (p_type = 'MEDIUM' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10)
       OR (p_type = 'LARGE' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15)""")
def or_of_ands(t):
    parts = t.part.where(c("p_type").isin("SMALL", "MEDIUM", "LARGE") & c("p_size").between(1, 15)).select("p_partkey", "p_type", "p_size")
    joined = t.lineitem.where(c("l_quantity").between(1, 30)).join(parts, c("l_partkey") == c("p_partkey"))
    group = lambda kind, low, high, size: (c("p_type") == kind) & c("l_quantity").between(low, high) & c("p_size").between(1, size)
    return joined.where(group("SMALL", 1, 11, 5) | group("MEDIUM", 10, 20, 10) | group("LARGE", 20, 30, 15)).select(
        "l_orderkey", "l_linenumber", "l_partkey")


@on_tables("flt_08_predicate_on_case", """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE CASE WHEN l_discount > 0 THEN l_tax / l_discount ELSE NULL END > 0.5""")
def predicate_on_case(t):
    return t.lineitem.where(F.when(c("l_discount") > 0, c("l_tax") / c("l_discount")) > 0.5).select("l_orderkey", "l_linenumber", "l_partkey")


@on_tables("flt_09_regex_signature", """SELECT doc_id, regexp_matches(text, '(?i)(licen[cs]e|copyright)') AS legal, regexp_matches(text, '(?i)[a-z0-9._]+@[a-z0-9.]+') AS mail
    FROM documents WHERE regexp_matches(text, '(?i)(licen[cs]e|copyright)') OR regexp_matches(text, '(?i)[a-z0-9._]+@[a-z0-9.]+')""")
def regex_signature(t):
    legal, mail = c("text").rlike("(?i)(licen[cs]e|copyright)"), c("text").rlike("(?i)[a-z0-9._]+@[a-z0-9.]+")
    return t.documents.where(legal | mail).select("doc_id", legal.alias("legal"), mail.alias("mail"))
