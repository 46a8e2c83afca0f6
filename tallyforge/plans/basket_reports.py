"""Reports on tickets, customers, stock and chains of sale, return and repurchase."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import TOP, c, mean, top, total, tpcds

any_of = lambda conditions: reduce(lambda a, b: a | b, conditions)
all_of = lambda conditions: reduce(lambda a, b: a & b, conditions)


def _ints(*names):
    return [c(n).cast("long").alias(n) for n in names]


# ---- one-row reports: several scalar aggregates in one scan --------------------------------

_BUCKETS = ((1, 10, 1200), (11, 20, 4100), (21, 30, 1000), (31, 40, 4400), (41, 50, 900))


@tpcds("tpcds_009_quantity_buckets", "SELECT " + ", ".join(
    f"""CASE WHEN (SELECT count(*) FROM sales WHERE channel = 'store' AND quantity BETWEEN {lo} AND {hi}) > {n}
  THEN (SELECT sum(ext_discount_amt)::DOUBLE / count(*) FROM sales WHERE channel = 'store' AND quantity BETWEEN {lo} AND {hi})
  ELSE (SELECT sum(net_paid)::DOUBLE / count(*) FROM sales WHERE channel = 'store' AND quantity BETWEEN {lo} AND {hi}) END bucket{i}"""
    for i, (lo, hi, n) in enumerate(_BUCKETS, 1)))
def quantity_buckets(m):
    """Fifteen scalar subqueries become one scan: per bucket a count and two means."""
    inside = lambda lo, hi: c("quantity").between(lo, hi)
    aggs = []
    for lo, hi, n in _BUCKETS:
        count = F.sum(F.when(inside(lo, hi), 1).otherwise(0))
        discount, paid = (mean(F.when(inside(lo, hi), c(x)), x) for x in ("ext_discount_amt", "net_paid"))
        aggs.append(F.when(count > n, discount).otherwise(paid).alias(f"bucket{len(aggs) + 1}"))
    return m.sold("store").agg(*aggs)


_BANDS = ((0, 5, 2000, 9000), (6, 10, 3000, 12000), (11, 15, 1000, 4000), (16, 20, 500, 2500), (21, 25, 300, 1800), (26, 30, 100, 900))


@tpcds("tpcds_030_price_bands", "SELECT * FROM " + ", ".join(
    f"""(SELECT sum(list_price)::DOUBLE / count(list_price) b{i}_avg, count(list_price) b{i}_cnt, count(DISTINCT list_price) b{i}_distinct
  FROM sales WHERE channel = 'store' AND quantity BETWEEN {lo} AND {hi}
    AND (list_price BETWEEN {a} AND {b} OR coupon_amt BETWEEN {a} AND {b} OR wholesale_cost BETWEEN {a} AND {b}))"""
    for i, (lo, hi, a, b) in enumerate(_BANDS, 1)))
def price_bands(m):
    """The bands do not overlap, so one grouped aggregate replaces six scans and their product."""
    tests = [c("quantity").between(lo, hi) & any_of([c(x).between(a, b) for x in ("list_price", "coupon_amt", "wholesale_cost")])
             for lo, hi, a, b in _BANDS]
    band = F.coalesce(*[F.when(t, i) for i, t in enumerate(tests, 1)])
    per = (m.sold("store").select(band.alias("band"), "list_price").where(c("band").isNotNull()).groupBy("band", "list_price")
           .count().groupBy("band").agg((F.sum(c("list_price") * c("count")).cast("double") / F.sum("count")).alias("avg"),
                                        F.sum("count").alias("cnt"), F.count("*").alias("distinct")))
    pick = lambda i, x: F.max(F.when(c("band") == i, c(x)))
    return per.agg(*[e for i in range(1, 7) for e in (
        pick(i, "avg").alias(f"b{i}_avg"), F.coalesce(pick(i, "cnt"), F.lit(0)).alias(f"b{i}_cnt"),
        F.coalesce(pick(i, "distinct"), F.lit(0)).alias(f"b{i}_distinct"))])


_HALF_HOURS = [(8, 30), (9, 0), (9, 30), (10, 0), (10, 30), (11, 0), (11, 30), (12, 0)]


def _household_or(m):
    return m.household_demographics.where(any_of([
        (c("dep_count") == d) & (c("vehicle_count") <= d + 2) for d in (4, 2, 0)])).select("hdemo_sk")


@tpcds("tpcds_091_half_hour_counts", "SELECT " + ", ".join(
    f"(count(*) FILTER (WHERE minute_of_day BETWEEN {h * 60 + mi} AND {h * 60 + mi + 29})) AS h{h}_{mi}" for h, mi in _HALF_HOURS)
    + """ FROM sales JOIN hdemo USING (hdemo_sk) JOIN store ON store_sk = site_sk WHERE channel = 'store' AND store_name = 'store 4'
  AND ((dep_count = 4 AND vehicle_count <= 6) OR (dep_count = 2 AND vehicle_count <= 4) OR (dep_count = 0 AND vehicle_count <= 2))""")
def half_hour_counts(m):
    shops = m.store.where(c("store_name") == "store 4").select(c("store_sk").alias("site_sk"))
    times = m.time_dim.where(c("hour").between(8, 12)).select(c("time_sk").alias("sold_time_sk"), "hour", "minute")
    sold = m.sold("store").join(_household_or(m), "hdemo_sk").join(shops, "site_sk").join(times, "sold_time_sk")
    inside = lambda h, mi: (c("hour") == h) & ((c("minute") >= 30) if mi else (c("minute") < 30))
    return sold.agg(*[F.coalesce(F.sum(F.when(inside(h, mi), 1)), F.lit(0)).alias(f"h{h}_{mi}") for h, mi in _HALF_HOURS])


@tpcds("tpcds_099_half_hour_count", """
SELECT count(*) cnt FROM sales JOIN hdemo USING (hdemo_sk) JOIN store ON store_sk = site_sk
WHERE channel = 'store' AND minute_of_day BETWEEN 1230 AND 1259 AND dep_count = 7 AND store_name = 'store 4'""")
def half_hour_count(m):
    shops = m.store.where(c("store_name") == "store 4").select(c("store_sk").alias("site_sk"))
    times = m.time_dim.where((c("hour") == 20) & (c("minute") >= 30)).select(c("time_sk").alias("sold_time_sk"))
    homes = m.household_demographics.where(c("dep_count") == 7).select("hdemo_sk")
    return (m.sold("store").join(times, "sold_time_sk").join(homes, "hdemo_sk").join(shops, "site_sk")
            .agg(F.count("*").alias("cnt")))


@tpcds("tpcds_093_morning_evening_ratio", """
, b AS (SELECT h FROM sales JOIN hdemo USING (hdemo_sk) JOIN clock USING (minute_of_day)
  WHERE channel = 'web' AND dep_count = 6 AND 2000 + 100 * page_sk BETWEEN 3000 AND 5200)
SELECT (count(*) FILTER (WHERE h BETWEEN 8 AND 9))::DECIMAL(15,4)::DOUBLE / (count(*) FILTER (WHERE h BETWEEN 19 AND 20))::DECIMAL(15,4)::DOUBLE am_pm_ratio FROM b""")
def morning_evening(m):
    homes = m.household_demographics.where(c("dep_count") == 6).select("hdemo_sk")
    pages = m.web_page.where(c("char_count").between(3000, 5200)).select(c("web_page_sk").alias("page_sk"))
    times = m.time_dim.select(c("time_sk").alias("sold_time_sk"), "hour")
    count = lambda lo: F.sum(F.when(c("hour").between(lo, lo + 1), 1).otherwise(0)).cast("decimal(15,4)").cast("double")
    return (m.sold("web").join(homes, "hdemo_sk").join(pages, "page_sk").join(times, "sold_time_sk")
            .agg(F.try_divide(count(8), count(19)).alias("am_pm_ratio")))


@tpcds("tpcds_064_promoted_share", """
, b AS (SELECT s.*, dmail, email, tv FROM sales s JOIN cust USING (customer_sk) JOIN addr h ON h.addr_sk = current_addr_sk
  JOIN item USING (item_sk) JOIN store ON store_sk = site_sk LEFT JOIN promo USING (promo_sk)
  WHERE s.channel = 'store' AND h.gmt_offset = -5 AND store.gmt_offset = -5 AND category = 'SMALL' AND s.y = 1998)
SELECT (sum(ext_sales_price) FILTER (WHERE dmail = 'Y' OR email = 'Y' OR tv = 'Y'))::DOUBLE promotions, sum(ext_sales_price)::DOUBLE total,
  (sum(ext_sales_price) FILTER (WHERE dmail = 'Y' OR email = 'Y' OR tv = 'Y'))::DOUBLE / sum(ext_sales_price)::DOUBLE * 100 share FROM b""")
def promoted_share(m):
    near = m.customer_address.where(c("gmt_offset") == -5).select(c("addr_sk").alias("current_addr_sk"))
    people = m.customer.select("customer_sk", "current_addr_sk").join(near, "current_addr_sk").select("customer_sk")
    shops = m.store.where(c("gmt_offset") == -5).select(c("store_sk").alias("site_sk"))
    sold = (m.sold_in(c("year") == 1998, "store").join(people, "customer_sk").join(shops, "site_sk")
            .join(m.item.where(c("category") == "SMALL").select("item_sk"), "item_sk").join(m.promotion, "promo_sk", "left"))
    offered = any_of([c(x) == "Y" for x in ("dmail", "email", "tv")])
    out = sold.agg(F.sum(F.when(offered, c("ext_sales_price"))).cast("double").alias("promotions"), total("ext_sales_price", "total"))
    return out.withColumn("share", c("promotions") / c("total") * 100)


# ---- customers by the channels they bought in ----------------------------------------------


def _activity(m, when):
    """Per customer a flag for each channel: one aggregate instead of three EXISTS joins."""
    return m.sold_in(when).groupBy("customer_sk").agg(
        *[F.max(c("channel") == ch).alias(ch) for ch in ("store", "catalog", "web")])


_ACT_SQL = "customer_sk IN (SELECT customer_sk FROM sales WHERE channel = '{}' AND {})"
_COUNTED = ["dep_count", "dep_employed_count", "dep_college_count"]


def _by_demographics(m, when, keep, states, *more):
    homes = m.customer_address.where(c("state").isin(*states)).select(c("addr_sk").alias("current_addr_sk"))
    people = (m.customer.join(homes, "current_addr_sk").join(_activity(m, when).where(keep), "customer_sk")
              .join(m.customer_demographics.withColumnRenamed("cdemo_sk", "current_cdemo_sk"), "current_cdemo_sk"))
    keys = ["gender", "marital_status", "education_status", "purchase_estimate", "credit_rating", *more]
    out = people.groupBy(*keys).agg(F.count("*").alias("cnt"))
    return top(out, *keys)


def _demographics_sql(condition, states, more=""):
    return f"""
SELECT gender, marital_status, education_status, purchase_estimate, credit_rating{more}, count(*) cnt
FROM cust JOIN addr h ON h.addr_sk = current_addr_sk JOIN cdemo ON cdemo_sk = current_cdemo_sk
WHERE state IN ({", ".join(f"'{s}'" for s in states)}) AND {condition} GROUP BY ALL
ORDER BY gender, marital_status, education_status, purchase_estimate, credit_rating{more} LIMIT 100"""


_TEN = [f"NATION_{n}" for n in range(0, 10)]


@tpcds("tpcds_010_store_and_other_buyers", _demographics_sql(
    _ACT_SQL.format("store", "y = 1998 AND m BETWEEN 1 AND 4") + " AND (" + _ACT_SQL.format("web", "y = 1998 AND m BETWEEN 1 AND 4")
    + " OR " + _ACT_SQL.format("catalog", "y = 1998 AND m BETWEEN 1 AND 4") + ")", _TEN, ", " + ", ".join(_COUNTED)))
def store_and_other(m):
    return _by_demographics(m, (c("year") == 1998) & c("moy").between(1, 4), c("store") & (c("web") | c("catalog")), _TEN, *_COUNTED)


@tpcds("tpcds_072_store_only_buyers", _demographics_sql(
    _ACT_SQL.format("store", "y = 1999 AND m BETWEEN 4 AND 6") + " AND NOT " + _ACT_SQL.format("web", "y = 1999 AND m BETWEEN 4 AND 6")
    + " AND NOT " + _ACT_SQL.format("catalog", "y = 1999 AND m BETWEEN 4 AND 6"), _TEN))
def store_only(m):
    return _by_demographics(m, (c("year") == 1999) & c("moy").between(4, 6), c("store") & ~c("web") & ~c("catalog"), _TEN)


@tpcds("tpcds_037_state_demographics", """
SELECT state, gender, marital_status, dep_count, dep_employed_count, dep_college_count, count(*) cnt,
  """ + ", ".join(f"min({x})::BIGINT min_{x}, max({x})::BIGINT max_{x}, sum({x})::DOUBLE / count({x}) avg_{x}" for x in _COUNTED) + """
FROM cust JOIN addr h ON h.addr_sk = current_addr_sk JOIN cdemo ON cdemo_sk = current_cdemo_sk
WHERE """ + _ACT_SQL.format("store", "y = 1999 AND quarter(sold) < 4") + " AND (" + _ACT_SQL.format("web", "y = 1999 AND quarter(sold) < 4")
       + " OR " + _ACT_SQL.format("catalog", "y = 1999 AND quarter(sold) < 4") + """) GROUP BY ALL
ORDER BY state, gender, marital_status, dep_count, dep_employed_count, dep_college_count LIMIT 100""")
def state_demographics(m):
    homes = m.customer_address.select(c("addr_sk").alias("current_addr_sk"), "state")
    active = _activity(m, (c("year") == 1999) & (c("qoy") < 4)).where(c("store") & (c("web") | c("catalog")))
    keys = ["state", "gender", "marital_status", *_COUNTED]
    out = (m.customer.join(homes, "current_addr_sk").join(active, "customer_sk")
           .join(m.customer_demographics.withColumnRenamed("cdemo_sk", "current_cdemo_sk"), "current_cdemo_sk").groupBy(*keys)
           .agg(F.count("*").alias("cnt"), *[e for x in _COUNTED for e in (
               F.min(x).alias(f"min_{x}"), F.max(x).alias(f"max_{x}"), mean(x, f"avg_{x}"))]))
    return top(out, *keys)


# ---- OR of AND groups: the join keys are stated once, the bands stay a filter -----------------


@tpcds("tpcds_013_averages_under_bands", """
SELECT sum(quantity)::DOUBLE / count(quantity) avg_quantity, sum(ext_sales_price)::DOUBLE / count(*) avg_price,
  sum(ext_wholesale_cost)::DOUBLE / count(*) avg_wholesale, sum(ext_wholesale_cost)::DOUBLE sum_wholesale
FROM sales s JOIN store ON store_sk = site_sk JOIN cdemo cd USING (cdemo_sk) JOIN hdemo hd USING (hdemo_sk) JOIN addr a USING (addr_sk)
WHERE channel = 'store' AND s.y = 1998
  AND ((marital_status = 'M' AND education_status = 'Advanced Degree' AND sales_price BETWEEN 100 AND 15000 AND hd.dep_count <= 4)
    OR (marital_status = 'S' AND education_status = 'College' AND sales_price BETWEEN 50 AND 10000 AND hd.dep_count <= 4)
    OR (marital_status = 'W' AND education_status = '2 yr Degree' AND sales_price BETWEEN 150 AND 20000 AND hd.dep_count <= 5))
  AND ((a.country = 'AFRICA' AND net_profit BETWEEN 100 AND 20000) OR (a.country = 'ASIA' AND net_profit BETWEEN 150 AND 30000)
    OR (a.country = 'EUROPE' AND net_profit BETWEEN 50 AND 25000))""")
def averages_under_bands(m):
    homes = m.household_demographics.select("hdemo_sk", c("dep_count").alias("home_deps"))
    sold = (m.sold_in(c("year") == 1998, "store").join(m.store.select(c("store_sk").alias("site_sk")), "site_sk")
            .join(m.customer_demographics, "cdemo_sk").join(homes, "hdemo_sk").join(m.customer_address, "addr_sk"))
    people = any_of([(c("marital_status") == ms) & (c("education_status") == ed) & c("sales_price").between(lo, hi) & (c("home_deps") <= n)
                     for ms, ed, lo, hi, n in (("M", "Advanced Degree", 100, 15000, 4), ("S", "College", 50, 10000, 4),
                                               ("W", "2 yr Degree", 150, 20000, 5))])
    places = any_of([(c("country") == p) & c("net_profit").between(lo, hi)
                     for p, lo, hi in (("AFRICA", 100, 20000), ("ASIA", 150, 30000), ("EUROPE", 50, 25000))])
    return sold.where(people & places).agg(mean("quantity", "avg_quantity"), mean("ext_sales_price", "avg_price"),
                                           mean("ext_wholesale_cost", "avg_wholesale"), total("ext_wholesale_cost", "sum_wholesale"))


@tpcds("tpcds_051_quantity_under_bands", """
SELECT sum(quantity)::BIGINT quantity FROM sales s JOIN store ON store_sk = site_sk JOIN cdemo USING (cdemo_sk) JOIN addr a USING (addr_sk)
WHERE channel = 'store' AND s.y = 1999
  AND ((marital_status = 'M' AND education_status = '4 yr Degree' AND sales_price BETWEEN 100 AND 1500)
    OR (marital_status = 'D' AND education_status = '2 yr Degree' AND sales_price BETWEEN 50 AND 10000)
    OR (marital_status = 'S' AND education_status = 'College' AND sales_price BETWEEN 150 AND 20000))
  AND ((a.state IN ('NATION_0', 'NATION_5', 'NATION_10') AND net_profit BETWEEN 0 AND 20000)
    OR (a.state IN ('NATION_1', 'NATION_6', 'NATION_11', 'NATION_16') AND net_profit BETWEEN 150 AND 30000)
    OR (a.state IN ('NATION_3', 'NATION_8', 'NATION_13') AND net_profit BETWEEN 50 AND 25000))""")
def quantity_under_bands(m):
    sold = (m.sold_in(c("year") == 1999, "store").join(m.store.select(c("store_sk").alias("site_sk")), "site_sk")
            .join(m.customer_demographics, "cdemo_sk").join(m.customer_address.select("addr_sk", "state"), "addr_sk"))
    people = any_of([(c("marital_status") == ms) & (c("education_status") == ed) & c("sales_price").between(lo, hi)
                     for ms, ed, lo, hi in (("M", "4 yr Degree", 100, 1500), ("D", "2 yr Degree", 50, 10000), ("S", "College", 150, 20000))])
    places = any_of([c("state").isin(*[f"NATION_{n}" for n in ns]) & c("net_profit").between(lo, hi)
                     for ns, lo, hi in (((0, 5, 10), 0, 20000), ((1, 6, 11, 16), 150, 30000), ((3, 8, 13), 50, 25000))])
    return sold.where(people & places).agg(F.sum("quantity").alias("quantity"))


@tpcds("tpcds_088_return_reasons_under_bands", """
SELECT left(reason_desc, 20) reason, sum(s.quantity)::DOUBLE / count(*) avg_quantity, sum(refunded_cash)::DOUBLE / count(*) avg_refund,
  sum(fee)::DOUBLE / count(*) avg_fee
FROM sales s JOIN rets r ON r.order_number = s.order_number AND r.item_sk = s.item_sk JOIN cdemo cd ON cd.cdemo_sk = r.cdemo_sk
JOIN addr a ON a.addr_sk = r.addr_sk JOIN (SELECT k, 'reason ' || k reason_desc FROM range(10) g(k)) ON k = r.reason_sk
WHERE s.channel = 'web' AND s.y = 1999
  AND ((marital_status = 'M' AND education_status = 'Advanced Degree' AND sales_price BETWEEN 100 AND 15000)
    OR (marital_status = 'S' AND education_status = 'College' AND sales_price BETWEEN 50 AND 10000)
    OR (marital_status = 'W' AND education_status = '2 yr Degree' AND sales_price BETWEEN 150 AND 20000))
  AND ((a.country = 'AFRICA' AND net_profit BETWEEN 100 AND 20000) OR (a.country = 'ASIA' AND net_profit BETWEEN 150 AND 30000)
    OR (a.country = 'EUROPE' AND net_profit BETWEEN 50 AND 25000))
GROUP BY ALL ORDER BY reason, avg_quantity, avg_refund, avg_fee LIMIT 100""")
def return_reasons(m):
    backs = m.returned("web").select("order_number", "item_sk", c("cdemo_sk").alias("back_cdemo"), c("addr_sk").alias("back_addr"),
                                     "reason_sk", "refunded_cash", "fee")
    people = m.customer_demographics.select(c("cdemo_sk").alias("back_cdemo"), "marital_status", "education_status")
    places = m.customer_address.select(c("addr_sk").alias("back_addr"), "country")
    joined = (m.sold_in(c("year") == 1999, "web").join(m.web_page.select(c("web_page_sk").alias("page_sk")), "page_sk")
              .join(backs, ["order_number", "item_sk"]).join(people, "back_cdemo").join(places, "back_addr").join(m.reason, "reason_sk"))
    who = any_of([(c("marital_status") == ms) & (c("education_status") == ed) & c("sales_price").between(lo, hi)
                  for ms, ed, lo, hi in (("M", "Advanced Degree", 100, 15000), ("S", "College", 50, 10000), ("W", "2 yr Degree", 150, 20000))])
    where = any_of([(c("country") == p) & c("net_profit").between(lo, hi)
                    for p, lo, hi in (("AFRICA", 100, 20000), ("ASIA", 150, 30000), ("EUROPE", 50, 25000))])
    out = joined.where(who & where).groupBy(F.substring("reason_desc", 1, 20).alias("reason")).agg(
        mean("quantity", "avg_quantity"), mean("refunded_cash", "avg_refund"), mean("fee", "avg_fee"))
    return top(out, "reason", "avg_quantity", "avg_refund", "avg_fee")


@tpcds("tpcds_094_call_center_return_loss", """
SELECT 'CC' || site_sk call_center, 'center ' || site_sk name, 'manager ' || site_sk manager, marital_status, education_status, sum(net_loss)::DOUBLE returns_loss
FROM rets r JOIN cust USING (customer_sk) JOIN cdemo cd ON cd.cdemo_sk = current_cdemo_sk JOIN hdemo hd ON hd.hdemo_sk = current_hdemo_sk
JOIN addr a ON a.addr_sk = current_addr_sk
WHERE channel = 'catalog' AND r.y = 1998 AND ((marital_status = 'M' AND education_status = 'Unknown')
    OR (marital_status = 'W' AND education_status = 'Advanced Degree')) AND buy_potential LIKE 'Unknown%' AND gmt_offset = -7
GROUP BY ALL""")
def call_center_loss(m):
    people = m.customer_demographics.where(any_of([
        (c("marital_status") == ms) & (c("education_status") == ed) for ms, ed in (("M", "Unknown"), ("W", "Advanced Degree"))])).select(
        c("cdemo_sk").alias("current_cdemo_sk"), "marital_status", "education_status")
    homes = m.household_demographics.where(c("buy_potential").like("Unknown%")).select(c("hdemo_sk").alias("current_hdemo_sk"))
    near = m.customer_address.where(c("gmt_offset") == -7).select(c("addr_sk").alias("current_addr_sk"))
    buyers = (m.customer.select("customer_sk", "current_cdemo_sk", "current_hdemo_sk", "current_addr_sk").join(people, "current_cdemo_sk")
              .join(homes, "current_hdemo_sk").join(near, "current_addr_sk"))
    centers = m.call_center.select(c("call_center_sk").alias("site_sk"), c("call_center_id").alias("call_center"), "name", "manager")
    return (m.returned_in(c("year") == 1998, "catalog").join(buyers, "customer_sk").join(centers, "site_sk")
            .groupBy("call_center", "name", "manager", "marital_status", "education_status").agg(total("net_loss", "returns_loss"))
            .orderBy(c("returns_loss").desc(), "call_center", "marital_status"))


# ---- orders shipped from several warehouses ---------------------------------------------------


def _several_warehouses(m, channel):
    """Orders with two different warehouses: min <> max, with no pairs of rows built."""
    return (m.sold(channel).groupBy("order_number").agg(F.min("warehouse_sk").alias("a"), F.max("warehouse_sk").alias("b"))
            .where(c("a") != c("b")).select("order_number"))


def _shipped(m, channel, sites):
    start = F.datediff(F.lit("1999-02-01").cast("date"), F.lit("1995-01-01").cast("date"))
    near = m.customer_address.where(c("state").isin("NATION_5", "NATION_10", "NATION_15")).select(c("addr_sk").alias("ship_addr_sk"))
    return (m.sold(channel).where(c("ship_date_sk").between(start, start + 60)).join(near, "ship_addr_sk").join(sites, "site_sk")
            .join(_several_warehouses(m, channel), "order_number", "left_semi"))


def _order_totals(frame):
    """COUNT DISTINCT over orders after one row per order, so hot orders shrink map-side."""
    per = frame.groupBy("order_number").agg(F.sum("ext_ship_cost").alias("s"), F.sum("net_profit").alias("p"))
    return per.agg(F.count("*").alias("order_count"), total("s", "total_shipping_cost"), total("p", "total_net_profit"))


_SHIPPED_SQL = """
SELECT count(DISTINCT order_number) order_count, sum(ext_ship_cost)::DOUBLE total_shipping_cost, sum(net_profit)::DOUBLE total_net_profit
FROM sales s JOIN addr a ON a.addr_sk = ship_addr_sk
WHERE channel = '{0}' AND shipped BETWEEN DATE '1999-02-01' AND DATE '1999-04-02' AND state IN ('NATION_5', 'NATION_10', 'NATION_15') AND {1}
  AND EXISTS (FROM sales o WHERE o.order_number = s.order_number AND o.channel = '{0}' AND o.warehouse_sk <> s.warehouse_sk)
  AND {2} (FROM rets r WHERE r.channel = '{0}' AND r.order_number = s.order_number {3})"""


@tpcds("tpcds_016_catalog_orders_kept", _SHIPPED_SQL.format("catalog", "site_sk IN (1, 2, 3)", "NOT EXISTS", ""))
def catalog_orders_kept(m):
    sites = m.call_center.where(c("county").isin("County_1", "County_2", "County_3")).select(c("call_center_sk").alias("site_sk"))
    return _order_totals(_shipped(m, "catalog", sites).join(m.returned("catalog").select("order_number"), "order_number", "left_anti"))


_SITE0 = "site_sk % 3 = 0"


@tpcds("tpcds_097_web_orders_kept", _SHIPPED_SQL.format("web", _SITE0, "NOT EXISTS", ""))
def web_orders_kept(m):
    sites = m.web_site.where(c("company_name") == "company 0").select(c("web_site_sk").alias("site_sk"))
    return _order_totals(_shipped(m, "web", sites).join(m.returned("web").select("order_number"), "order_number", "left_anti"))


@tpcds("tpcds_098_web_orders_returned", _SHIPPED_SQL.format("web", _SITE0, "EXISTS", ""))
def web_orders_returned(m):
    sites = m.web_site.where(c("company_name") == "company 0").select(c("web_site_sk").alias("site_sk"))
    return _order_totals(_shipped(m, "web", sites).join(m.returned("web").select("order_number"), "order_number", "left_semi"))


# ---- sale, return, repurchase ------------------------------------------------------------------


def _chain(m):
    """Store sale joined to its return and to catalog sales of the same item and customer."""
    backs = m.returned_in(c("year").between(1995, 2000), "store").select(
        "order_number", "item_sk", "customer_sk", "return_quantity", "net_loss")
    again = m.sold_in(c("year").between(1995, 2001), "catalog").select(
        "customer_sk", "item_sk", c("quantity").alias("again_quantity"), c("net_profit").alias("again_profit"))
    shops = m.store.select(c("store_sk").alias("site_sk"), "store_id", "store_name", "state")
    return (m.sold_in(c("year").between(1995, 1999), "store").join(backs, ["order_number", "item_sk", "customer_sk"])
            .join(again, ["customer_sk", "item_sk"]).join(shops, "site_sk")
            .join(m.item.select("item_sk", "item_id", "item_desc"), "item_sk"))


_CHAIN_SQL = """
, ch AS (SELECT item_id, item_desc, store_id, store_name, store.state, s.quantity, s.net_profit, r.return_quantity, r.net_loss,
    k.quantity again_quantity, k.net_profit again_profit
  FROM sales s JOIN rets r ON (r.order_number, r.item_sk, r.customer_sk) = (s.order_number, s.item_sk, s.customer_sk)
  JOIN sales k ON k.channel = 'catalog' AND k.customer_sk = s.customer_sk AND k.item_sk = s.item_sk
  JOIN store ON store_sk = s.site_sk JOIN item ON item.item_sk = s.item_sk
  WHERE s.channel = 'store' AND s.y BETWEEN 1995 AND 1999 AND r.y BETWEEN 1995 AND 2000 AND k.y BETWEEN 1995 AND 2001)"""
_CHAIN_KEYS = ["item_id", "item_desc", "store_id", "store_name"]


@tpcds("tpcds_027_chain_profit", _CHAIN_SQL + """
SELECT item_id, item_desc, store_id, store_name, sum(net_profit)::DOUBLE store_profit, sum(net_loss)::DOUBLE return_loss,
  sum(again_profit)::DOUBLE catalog_profit FROM ch GROUP BY ALL ORDER BY item_id, item_desc, store_id, store_name LIMIT 100""")
def chain_profit(m):
    out = _chain(m).groupBy(*_CHAIN_KEYS).agg(total("net_profit", "store_profit"), total("net_loss", "return_loss"),
                                              total("again_profit", "catalog_profit"))
    return top(out, *_CHAIN_KEYS)


@tpcds("tpcds_031_chain_quantity", _CHAIN_SQL + """
SELECT item_id, item_desc, store_id, store_name, sum(quantity)::BIGINT store_quantity, sum(return_quantity)::BIGINT return_quantity,
  sum(again_quantity)::BIGINT catalog_quantity FROM ch GROUP BY ALL ORDER BY item_id, item_desc, store_id, store_name LIMIT 100""")
def chain_quantity(m):
    out = _chain(m).groupBy(*_CHAIN_KEYS).agg(F.sum("quantity").alias("store_quantity"), F.sum("return_quantity").alias("return_quantity"),
                                              F.sum("again_quantity").alias("catalog_quantity"))
    return top(out, *_CHAIN_KEYS)


_CHAIN_STATS = {"store": "quantity", "return": "return_quantity", "catalog": "again_quantity"}


@tpcds("tpcds_017_chain_statistics", _CHAIN_SQL + "SELECT item_desc, state, " + ", ".join(
    f"count({x}) {n}_count, sum({x})::DOUBLE / count({x}) {n}_avg, round(stddev_samp({x}), 6) {n}_stdev, "
    f"round(stddev_samp({x}) / (sum({x})::DOUBLE / count({x})), 6) {n}_cov" for n, x in _CHAIN_STATS.items())
    + " FROM ch GROUP BY ALL ORDER BY item_desc, state LIMIT 100")
def chain_statistics(m):
    out = _chain(m).groupBy("item_desc", "state").agg(*[e for n, x in _CHAIN_STATS.items() for e in (
        F.count(x).alias(f"{n}_count"), mean(x, f"{n}_avg"), F.round(F.stddev_samp(x), 6).alias(f"{n}_stdev"),
        F.round(F.stddev_samp(x) / mean(x, "a"), 6).alias(f"{n}_cov"))])
    return top(out, "item_desc", "state")


@tpcds("tpcds_096_net_sales_for_reason", """
SELECT s.customer_sk, sum(CASE WHEN return_quantity IS NOT NULL THEN (quantity - return_quantity) * sales_price
  ELSE quantity * sales_price END)::DOUBLE sumsales
FROM sales s LEFT JOIN rets r ON r.item_sk = s.item_sk AND r.order_number = s.order_number
WHERE s.channel = 'store' AND r.reason_sk = 3 GROUP BY ALL ORDER BY sumsales, customer_sk LIMIT 100""")
def net_sales_for_reason(m):
    reason = m.reason.where(c("reason_desc") == "reason 3").select("reason_sk")
    backs = m.returned("store").join(reason, "reason_sk").select("order_number", "item_sk", "return_quantity")
    sold = m.sold("store").join(backs, ["order_number", "item_sk"])  # the reason makes the outer join an inner one
    kept = F.when(c("return_quantity").isNotNull(), c("quantity") - c("return_quantity")).otherwise(c("quantity"))
    return top(sold.groupBy("customer_sk").agg(total(kept * c("sales_price"), "sumsales")), "sumsales", "customer_sk")


def _colour_customers(m, colours):
    """Net paid of returned sales by customer, where the store sits in the customer's zip."""
    backs = m.returned("store").select("order_number", "item_sk")
    shops = m.store.where(c("market_id") < 8).select(c("store_sk").alias("site_sk"), "store_name", c("state").alias("shop_state"), "zip")
    homes = m.customer_address.select(c("addr_sk").alias("current_addr_sk"), c("state").alias("home_state"), "country", "zip")
    people = m.customer.select("customer_sk", "last_name", "first_name", "birth_country", "current_addr_sk")
    items = m.item.select("item_sk", "color", "current_price", "manager_id", "units", "size")
    fine = (m.sold("store").join(backs, ["order_number", "item_sk"]).join(shops, "site_sk").join(people, "customer_sk")
            .join(homes, ["current_addr_sk", "zip"]).where(c("birth_country") != F.upper("country")).join(items, "item_sk")
            .groupBy("last_name", "first_name", "store_name", "home_state", "shop_state", "color", "current_price", "manager_id", "units", "size")
            .agg(F.sum("net_paid").alias("netpaid")))
    bar = fine.agg((F.sum("netpaid").cast("double") / F.count("netpaid") * 0.05).alias("bar"))
    out = (fine.where(c("color").isin(*colours)).groupBy("last_name", "first_name", "store_name").agg(total("netpaid", "paid"))
           .where(c("paid") > bar.scalar()))
    return out.orderBy("last_name", "first_name", "store_name")


_COLOUR_SQL = """
, f AS (SELECT last_name, first_name, store_name, color, current_price, manager_id, units, size, a.state hs, store.state ss, sum(net_paid) p
  FROM sales s JOIN rets r ON r.order_number = s.order_number AND r.item_sk = s.item_sk JOIN store ON store_sk = s.site_sk
  JOIN cust c ON c.customer_sk = s.customer_sk JOIN addr a ON a.addr_sk = current_addr_sk JOIN item i ON i.item_sk = s.item_sk
  WHERE s.channel = 'store' AND market_id < 8 AND a.zip = store.zip AND birth_country <> upper(a.country) GROUP BY ALL)
SELECT last_name, first_name, store_name, sum(p)::DOUBLE paid FROM f WHERE color IN ({}) GROUP BY ALL
HAVING sum(p)::DOUBLE > (SELECT sum(p)::DOUBLE / count(p) * 0.05 FROM f)"""


@tpcds("tpcds_025_net_paid_by_colour_a", _COLOUR_SQL.format("'ring', 'bolt'"))
def colour_a(m):
    return _colour_customers(m, ["ring", "bolt"])


@tpcds("tpcds_026_net_paid_by_colour_b", _COLOUR_SQL.format("'gear', 'rod'"))
def colour_b(m):
    return _colour_customers(m, ["gear", "rod"])


# ---- stock --------------------------------------------------------------------------------------


@tpcds("tpcds_021_stock_before_and_after", """
, t AS (SELECT 'Warehouse ' || warehouse_sk warehouse_name, item_id, sum(CASE WHEN sold < DATE '1999-06-15' THEN quantity_on_hand ELSE 0 END)::BIGINT inv_before,
    sum(CASE WHEN sold >= DATE '1999-06-15' THEN quantity_on_hand ELSE 0 END)::BIGINT inv_after
  FROM stock JOIN item USING (item_sk) WHERE current_price BETWEEN 920 AND 980 AND sold BETWEEN DATE '1999-05-16' AND DATE '1999-07-15' GROUP BY ALL)
SELECT * FROM t WHERE CASE WHEN inv_before > 0 THEN inv_after::DOUBLE / inv_before END BETWEEN 2.0::DOUBLE / 3 AND 3.0::DOUBLE / 2
ORDER BY warehouse_name, item_id LIMIT 100""")
def stock_before_after(m):
    day = F.lit("1999-06-15").cast("date")
    items = m.item.where(c("current_price").between(920, 980)).select("item_sk", "item_id")
    stock = m.stock_in(c("d_date").between(F.date_sub(day, 30), F.date_add(day, 30)), ("d_date",)).join(items, "item_sk").join(m.warehouse, "warehouse_sk")
    out = stock.groupBy("warehouse_name", "item_id").agg(
        F.sum(F.when(c("d_date") < day, c("quantity_on_hand")).otherwise(0)).alias("inv_before"),
        F.sum(F.when(c("d_date") >= day, c("quantity_on_hand")).otherwise(0)).alias("inv_after"))
    ratio = F.when(c("inv_before") > 0, c("inv_after").cast("double") / c("inv_before"))
    return top(out.where(ratio.between(F.lit(2.0) / 3, F.lit(3.0) / 2)), "warehouse_name", "item_id")


@tpcds("tpcds_022_average_stock_rollup", """
SELECT product_name, brand, class, category, sum(quantity_on_hand)::DOUBLE / count(*) qoh FROM stock JOIN item USING (item_sk)
WHERE mseq BETWEEN 48 AND 59 GROUP BY ROLLUP (product_name, brand, class, category)
ORDER BY qoh, product_name NULLS FIRST, brand NULLS FIRST, class NULLS FIRST, category NULLS FIRST LIMIT 100""")
def average_stock(m):
    keys = ["product_name", "brand", "class", "category"]
    per_item = m.stock_in(c("month_seq").between(48, 59)).groupBy("item_sk").agg(F.sum("quantity_on_hand").alias("q"), F.count("*").alias("n"))
    fine = per_item.join(m.item.select("item_sk", *keys), "item_sk").groupBy(*keys).agg(F.sum("q").alias("q"), F.sum("n").alias("n"))
    return top(fine.rollup(*keys).agg((F.sum("q").cast("double") / F.sum("n")).alias("qoh")), "qoh", *keys)


def _stocked_and_sold(m, channel, makers):
    """Semi joins against stock and sales: an item is kept once, however often it was sold."""
    day = F.lit("1999-02-01").cast("date")
    stocked = m.stock_in(c("d_date").between(day, F.date_add(day, 60))).where(c("quantity_on_hand").between(10, 50)).select("item_sk")
    items = (m.item.where(c("current_price").between(930, 960) & c("manufact_id").isin(*makers)).join(stocked, "item_sk", "left_semi")
             .join(m.sold(channel).select("item_sk"), "item_sk", "left_semi"))
    out = items.select("item_id", "item_desc", c("current_price").cast("double").alias("current_price")).distinct()
    return top(out, "item_id")


_STOCKED_SQL = """
SELECT item_id, item_desc, current_price::DOUBLE current_price FROM item JOIN stock USING (item_sk) JOIN sales s USING (item_sk)
WHERE current_price BETWEEN 930 AND 960 AND manufact_id IN ({}) AND stock.sold BETWEEN DATE '1999-02-01' AND DATE '1999-04-02'
  AND quantity_on_hand BETWEEN 10 AND 50 AND channel = '{}' GROUP BY ALL ORDER BY item_id LIMIT 100"""


@tpcds("tpcds_039_stocked_and_sold_catalog", _STOCKED_SQL.format("3, 7, 12, 18, 22, 29, 33, 41", "catalog"))
def stocked_catalog(m):
    return _stocked_and_sold(m, "catalog", (3, 7, 12, 18, 22, 29, 33, 41))


@tpcds("tpcds_085_stocked_and_sold_store", _STOCKED_SQL.format("2, 5, 11, 17, 23, 31, 37, 43", "store"))
def stocked_store(m):
    return _stocked_and_sold(m, "store", (2, 5, 11, 17, 23, 31, 37, 43))


def _variation(m, bar):
    """Coefficient of variation of daily stock per year, against the next year."""
    stats = (m.stock_in(c("year").isin(1998, 1999), ("year",)).groupBy("warehouse_sk", "item_sk", "year")
             .agg(F.stddev_samp("quantity_on_hand").alias("stdev"), mean("quantity_on_hand", "mean"))
             .withColumn("cov", F.when(c("mean") != 0, F.round(c("stdev") / c("mean"), 6))).where(c("cov") > 0.6))
    side = lambda year, p: stats.where(c("year") == year).select("warehouse_sk", "item_sk", c("mean").alias(f"mean{p}"), c("cov").alias(f"cov{p}"))
    out = side(1998, 1).join(side(1999, 2), ["warehouse_sk", "item_sk"])
    return (out.where(c("cov1") > bar) if bar else out).orderBy("warehouse_sk", "item_sk", "mean1", "cov1")


_VARIATION_SQL = """
, t AS (SELECT warehouse_sk, item_sk, y, sum(quantity_on_hand)::DOUBLE / count(*) mean, round(stddev_samp(quantity_on_hand) / (sum(quantity_on_hand)::DOUBLE / count(*)), 6) cov
  FROM stock WHERE y IN (1998, 1999) GROUP BY ALL)
SELECT a.warehouse_sk, a.item_sk, a.mean mean1, a.cov cov1, b.mean mean2, b.cov cov2
FROM t a JOIN t b ON a.item_sk = b.item_sk AND a.warehouse_sk = b.warehouse_sk AND b.y = a.y + 1 WHERE a.cov > 0.6 AND b.cov > 0.6 {}"""


@tpcds("tpcds_041_stock_variation_a", _VARIATION_SQL.format(""))
def variation_a(m):
    return _variation(m, None)


@tpcds("tpcds_042_stock_variation_b", _VARIATION_SQL.format("AND a.cov > 0.9"))
def variation_b(m):
    return _variation(m, 0.9)


@tpcds("tpcds_043_net_sales_before_and_after", """
SELECT 'State_' || s.warehouse_sk state, item_id,
  sum(CASE WHEN sold < DATE '1999-03-11' THEN sales_price - coalesce(refunded_cash, 0) ELSE 0 END)::DOUBLE sales_before,
  sum(CASE WHEN sold >= DATE '1999-03-11' THEN sales_price - coalesce(refunded_cash, 0) ELSE 0 END)::DOUBLE sales_after
FROM sales s LEFT JOIN rets r ON r.order_number = s.order_number AND r.item_sk = s.item_sk JOIN item i ON i.item_sk = s.item_sk
WHERE s.channel = 'catalog' AND current_price BETWEEN 930 AND 950 AND sold BETWEEN DATE '1999-02-09' AND DATE '1999-04-10'
GROUP BY ALL ORDER BY state, item_id LIMIT 100""")
def net_before_after(m):
    day = F.lit("1999-03-11").cast("date")
    items = m.item.where(c("current_price").between(930, 950)).select("item_sk", "item_id")
    backs = m.returned("catalog").select("order_number", "item_sk", "refunded_cash")
    sold = (m.sold_in(c("d_date").between(F.date_sub(day, 30), F.date_add(day, 30)), "catalog", extra=("d_date",)).join(items, "item_sk")
            .join(backs, ["order_number", "item_sk"], "left").join(m.warehouse.select("warehouse_sk", "state"), "warehouse_sk"))
    net = c("sales_price") - F.coalesce("refunded_cash", F.lit(0).cast("decimal(18,2)"))
    out = sold.groupBy("state", "item_id").agg(total(F.when(c("d_date") < day, net).otherwise(0), "sales_before"),
                                               total(F.when(c("d_date") >= day, net).otherwise(0), "sales_after"))
    return top(out, "state", "item_id")


@tpcds("tpcds_075_promotion_shortage", """
, ss AS (SELECT *, floor(date_diff('day', DATE '1995-01-01', sold) / 7)::BIGINT wk FROM stock)
SELECT item_desc, 'Warehouse ' || ss.warehouse_sk warehouse_name, s.wseq week_seq, count(*) FILTER (WHERE p.promo_sk IS NULL) no_promo,
  count(*) FILTER (WHERE p.promo_sk IS NOT NULL) promo, count(*) total_cnt
FROM sales s JOIN ss ON ss.item_sk = s.item_sk AND ss.wk = s.wseq JOIN item i ON i.item_sk = s.item_sk JOIN cdemo cd ON cd.cdemo_sk = s.cdemo_sk
JOIN hdemo hd ON hd.hdemo_sk = s.hdemo_sk LEFT JOIN promo p ON p.promo_sk = s.promo_sk
LEFT JOIN rets r ON r.order_number = s.order_number AND r.item_sk = s.item_sk
WHERE s.channel = 'catalog' AND s.y = 1999 AND quantity_on_hand < quantity AND shipped > s.sold + 5
  AND buy_potential IN ('>10000', 'Unknown', '1001-5000') AND marital_status IN ('D', 'S', 'M')
GROUP BY ALL ORDER BY total_cnt DESC, item_desc, warehouse_name, week_seq LIMIT 100""")
def promotion_shortage(m):
    """Sales and stock are counted per (item, week, quantity) before they meet, so a hot item joins
    a few counted rows. The outer join to returns is left out: their key is the sale's key, so it
    neither drops nor adds a row."""
    homes = m.household_demographics.where(c("buy_potential").isin(">10000", "Unknown", "1001-5000")).select("hdemo_sk")
    people = m.customer_demographics.where(c("marital_status").isin("D", "S", "M")).select("cdemo_sk")
    stock = (m.stock_in(c("month_seq").between(47, 60), ("week_seq",)).groupBy("item_sk", "week_seq", "quantity_on_hand", c("warehouse_sk").alias("stock_at"))
             .agg(F.count("*").alias("stocks")))
    sites = m.warehouse.select(c("warehouse_sk").alias("stock_at"), "warehouse_name")
    offers = m.promotion.select("promo_sk", F.lit(1).alias("offered"))
    count = lambda cond, name: F.sum(F.when(cond, 1).otherwise(0)).alias(name)
    sold = (m.sold_in(c("year") == 1999, "catalog", extra=("week_seq",)).join(homes, "hdemo_sk").join(people, "cdemo_sk")
            .where(c("ship_date_sk") > c("sold_date_sk") + 5).join(offers, "promo_sk", "left").groupBy("item_sk", "week_seq", "quantity")
            .agg(count(c("offered").isNull(), "without"), count(c("offered").isNotNull(), "with"), F.count("*").alias("n")))
    short = (sold.join(stock, ["item_sk", "week_seq"]).where(c("quantity_on_hand") < c("quantity")).join(sites, "stock_at")
             .join(m.item.select("item_sk", "item_desc"), "item_sk"))
    out = short.groupBy("item_desc", "warehouse_name", c("week_seq").cast("long").alias("week_seq")).agg(
        F.sum(c("without") * c("stocks")).alias("no_promo"), F.sum(c("with") * c("stocks")).alias("promo"), F.sum(c("n") * c("stocks")).alias("total_cnt"))
    return top(out, "-total_cnt", "item_desc", "warehouse_name", "week_seq")


# ---- tickets ------------------------------------------------------------------------------------


def _tickets(m, when, homes, counties, low, high):
    shops = m.store.where(c("county").isin(*counties)).select(c("store_sk").alias("site_sk"))
    per = (m.sold_in(when, "store").join(shops, "site_sk").join(m.household_demographics.where(homes).select("hdemo_sk"), "hdemo_sk")
           .groupBy(c("order_number").alias("ticket"), "customer_sk").agg(F.count("*").alias("cnt")).where(c("cnt").between(low, high)))
    people = m.customer.select("customer_sk", "last_name", "first_name", "salutation", "preferred")
    return per.join(people, "customer_sk").drop("customer_sk").orderBy("last_name", "first_name", "salutation", c("preferred").desc(), "ticket")


_TICKET_SQL = """
, t AS (SELECT order_number ticket, customer_sk, count(*) cnt FROM sales s JOIN hdemo USING (hdemo_sk) JOIN store ON store_sk = site_sk
  WHERE channel = 'store' AND {} AND s.y BETWEEN 1998 AND 2000 AND buy_potential IN ('>10000', 'Unknown') AND vehicle_count > 0
    AND dep_count::DOUBLE / vehicle_count > {} AND county IN ({}) GROUP BY ALL)
SELECT last_name, first_name, salutation, preferred, ticket, cnt FROM t JOIN cust USING (customer_sk) WHERE cnt BETWEEN {}"""


def _crowded(bar):
    return (c("buy_potential").isin(">10000", "Unknown") & (c("vehicle_count") > 0)
            & (F.when(c("vehicle_count") > 0, c("dep_count").cast("double") / c("vehicle_count")) > bar))


_EIGHT = [f"County_{n}" for n in range(8)]
_EIGHT_SQL = ", ".join(f"'{x}'" for x in _EIGHT)


@tpcds("tpcds_036_large_tickets", _TICKET_SQL.format("(day(sold) BETWEEN 1 AND 3 OR day(sold) BETWEEN 25 AND 28)", 1.2, _EIGHT_SQL, "4 AND 9"))
def large_tickets(m):
    when = (c("dom").between(1, 3) | c("dom").between(25, 28)) & c("year").between(1998, 2000)
    return _tickets(m, when, _crowded(1.2), _EIGHT, 4, 9)


@tpcds("tpcds_076_small_tickets", _TICKET_SQL.format("day(sold) BETWEEN 1 AND 2", "1", _EIGHT_SQL, "1 AND 5"))
def small_tickets(m):
    return _tickets(m, c("dom").between(1, 2) & c("year").between(1998, 2000), _crowded(1.0), _EIGHT, 1, 5)


def _away(m, when, sums):
    """Ticket sums where the city of purchase is not the customer's home city."""
    homes = m.household_demographics.where((c("dep_count") == 4) | (c("vehicle_count") == 3)).select("hdemo_sk")
    shops = m.store.where(c("city").isin("City_0", "City_1", "City_2", "City_4")).select(c("store_sk").alias("site_sk"))
    bought = m.customer_address.select("addr_sk", c("city").alias("bought_city"))
    per = (m.sold_in(when, "store").join(homes, "hdemo_sk").join(shops, "site_sk").groupBy("order_number", "customer_sk", "addr_sk")
           .agg(*[F.sum(x).cast("double").alias(a) for a, x in sums.items()]).join(bought, "addr_sk"))
    people = m.customer.select("customer_sk", "last_name", "first_name", "current_addr_sk")
    now = m.customer_address.select(c("addr_sk").alias("current_addr_sk"), "city")
    return (per.join(people, "customer_sk").join(now, "current_addr_sk").where(c("city") != c("bought_city"))
            .select("last_name", "first_name", "city", "bought_city", c("order_number").alias("ticket"), *sums))


_AWAY_SQL = """
, t AS (SELECT order_number ticket, customer_sk, addr_sk, {} FROM sales s JOIN hdemo USING (hdemo_sk) JOIN store ON store_sk = site_sk
  WHERE channel = 'store' AND (dep_count = 4 OR vehicle_count = 3) AND {} AND store.city IN ('City_0', 'City_1', 'City_2', 'City_4') GROUP BY ALL)
SELECT last_name, first_name, n.city, b.city bought_city, ticket, {} FROM t JOIN cust USING (customer_sk) JOIN addr n ON n.addr_sk = current_addr_sk
JOIN addr b ON b.addr_sk = t.addr_sk WHERE n.city <> b.city ORDER BY {} LIMIT 100"""


@tpcds("tpcds_049_weekend_tickets_away", _AWAY_SQL.format(
    "sum(coupon_amt)::DOUBLE amt, sum(net_profit)::DOUBLE profit", "dayofweek(sold) IN (6, 0) AND s.y BETWEEN 1998 AND 2000", "amt, profit",
    "last_name, first_name, n.city, bought_city, ticket"))
def weekend_away(m):
    out = _away(m, c("dow").isin(6, 0) & c("year").between(1998, 2000), {"amt": "coupon_amt", "profit": "net_profit"})
    return top(out, "last_name", "first_name", "city", "bought_city", "ticket")


@tpcds("tpcds_071_month_start_tickets_away", _AWAY_SQL.format(
    "sum(ext_sales_price)::DOUBLE extended_price, sum(ext_list_price)::DOUBLE list_price, sum(ext_tax)::DOUBLE extended_tax",
    "day(sold) BETWEEN 1 AND 2 AND s.y BETWEEN 1998 AND 2000", "extended_price, list_price, extended_tax", "last_name, ticket"))
def month_start_away(m):
    out = _away(m, c("dom").between(1, 2) & c("year").between(1998, 2000),
                {"extended_price": "ext_sales_price", "list_price": "ext_list_price", "extended_tax": "ext_tax"})
    return top(out, "last_name", "ticket")


@tpcds("tpcds_082_monday_tickets", """
, t AS (SELECT order_number ticket, customer_sk, addr_sk, store.city, sum(coupon_amt)::DOUBLE amt, sum(net_profit)::DOUBLE profit
  FROM sales s JOIN hdemo USING (hdemo_sk) JOIN store ON store_sk = site_sk WHERE channel = 'store' AND (dep_count = 6 OR vehicle_count > 2)
    AND dayofweek(sold) = 1 AND s.y BETWEEN 1998 AND 2000 AND employees BETWEEN 200 AND 295 GROUP BY ALL)
SELECT last_name, first_name, left(city, 30) city, ticket, amt, profit FROM t JOIN cust USING (customer_sk)
ORDER BY last_name, first_name, city, profit, ticket LIMIT 100""")
def monday_tickets(m):
    homes = m.household_demographics.where((c("dep_count") == 6) | (c("vehicle_count") > 2)).select("hdemo_sk")
    shops = m.store.where(c("employees").between(200, 295)).select(c("store_sk").alias("site_sk"), "city")
    per = (m.sold_in((c("dow") == 1) & c("year").between(1998, 2000), "store").join(homes, "hdemo_sk").join(shops, "site_sk")
           .groupBy(c("order_number").alias("ticket"), "customer_sk", "addr_sk", "city").agg(total("coupon_amt", "amt"), total("net_profit", "profit")))
    out = per.join(m.customer.select("customer_sk", "last_name", "first_name"), "customer_sk").select(
        "last_name", "first_name", F.substring("city", 1, 30).alias("city"), "ticket", "amt", "profit")
    return top(out, "last_name", "first_name", "city", "profit", "ticket")


# ---- roll-ups with a rank inside each parent ----------------------------------------------------


def _ranked_levels(levels, measure, upper, lower, descending):
    parent = F.when(c("g_lower") == 0, c(upper))
    line = Window.partitionBy("lochierarchy", parent).orderBy(c(measure).desc() if descending else c(measure).asc())
    out = (levels.withColumn("lochierarchy", c("g_upper") + c("g_lower")).withColumn("rank_within_parent", F.rank().over(line).cast("long"))
           .drop("g_upper", "g_lower"))
    return out.orderBy(c("lochierarchy").desc(), F.when(c("lochierarchy") == 0, c(upper)), "rank_within_parent", upper, lower).limit(100)


def _levels(fine, upper, lower, *aggs):
    """The roll-up reads sums that are already one row per (upper, lower)."""
    grouping = [F.grouping(upper).cast("long").alias("g_upper"), F.grouping(lower).cast("long").alias("g_lower")]
    return fine.rollup(upper, lower).agg(*aggs, *grouping)


_LEVEL_SQL = """
SELECT *, rank() OVER (PARTITION BY lochierarchy, CASE WHEN gl = 0 THEN {u} END ORDER BY {m} {d}) rank_within_parent FROM (
  SELECT {expr} AS {m}, {u}, {l}, (grouping({u}) + grouping({l}))::BIGINT lochierarchy, grouping({l}) gl {rest} GROUP BY ROLLUP ({u}, {l}))"""


def _level_sql(**kw):
    return ("SELECT * EXCLUDE (gl) FROM (" + _LEVEL_SQL.format(**kw)
            + f") ORDER BY lochierarchy DESC, CASE WHEN lochierarchy = 0 THEN {kw['u']} END NULLS FIRST, rank_within_parent, "
            + f"{kw['u']} NULLS FIRST, {kw['l']} NULLS FIRST LIMIT 100")


_EIGHT_STATES = [f"NATION_{n}" for n in (0, 1, 2, 3, 4, 15, 16, 20)]
_EIGHT_STATES_SQL = ", ".join(f"'{s}'" for s in _EIGHT_STATES)


@tpcds("tpcds_038_gross_margin_rollup", _level_sql(
    expr="sum(net_profit)::DOUBLE / sum(ext_sales_price)::DOUBLE", m="gross_margin", u="category", l="class", d="ASC",
    rest=f"FROM sales s JOIN item USING (item_sk) JOIN store ON store_sk = site_sk WHERE channel = 'store' AND s.y = 1999 AND state IN ({_EIGHT_STATES_SQL})"))
def gross_margin(m):
    shops = m.store.where(c("state").isin(*_EIGHT_STATES)).select(c("store_sk").alias("site_sk"))
    fine = (m.sold_in(c("year") == 1999, "store").join(shops, "site_sk").join(m.item.select("item_sk", "category", "class"), "item_sk")
            .groupBy("category", "class").agg(F.sum("net_profit").alias("p"), F.sum("ext_sales_price").alias("s")))
    levels = _levels(fine, "category", "class", (F.sum("p").cast("double") / F.sum("s").cast("double")).alias("gross_margin"))
    return _ranked_levels(levels, "gross_margin", "category", "class", False)


@tpcds("tpcds_073_state_profit_rollup", _level_sql(
    expr="sum(net_profit)::DOUBLE", m="total_sum", u="state", l="county", d="DESC",
    rest="FROM sales s JOIN store ON store_sk = site_sk WHERE channel = 'store' AND mseq BETWEEN 48 AND 59"))
def state_profit(m):
    """States qualify by a rank inside their own single-row partition, so each of them does."""
    shops = m.store.select(c("store_sk").alias("site_sk"), "state", "county")
    fine = (m.sold_in(c("month_seq").between(48, 59), "store").join(shops, "site_sk").groupBy("state", "county")
            .agg(F.sum("net_profit").alias("p")))
    own = Window.partitionBy("state").orderBy(c("profit").desc())
    best = fine.groupBy("state").agg(F.sum("p").alias("profit")).withColumn("ranking", F.rank().over(own)).where(c("ranking") <= 5)
    levels = _levels(fine.join(best.select("state"), "state", "left_semi"), "state", "county", total("p", "total_sum"))
    return _ranked_levels(levels, "total_sum", "state", "county", True)


@tpcds("tpcds_089_web_net_paid_rollup", _level_sql(
    expr="sum(net_paid)::DOUBLE", m="total_sum", u="category", l="class", d="DESC",
    rest="FROM sales s JOIN item USING (item_sk) WHERE channel = 'web' AND mseq BETWEEN 48 AND 59"))
def web_net_paid(m):
    fine = (m.sold_in(c("month_seq").between(48, 59), "web").join(m.item.select("item_sk", "category", "class"), "item_sk")
            .groupBy("category", "class").agg(F.sum("net_paid").alias("p")))
    return _ranked_levels(_levels(fine, "category", "class", total("p", "total_sum")), "total_sum", "category", "class", True)


_EIGHT_KEYS = ["category", "class", "brand", "product_name", "year", "qoy", "moy", "store_id"]


@tpcds("tpcds_070_top_rows_of_eight_level_rollup", """
, b AS (SELECT category, class, brand, product_name, s.y AS year, quarter(sold) AS qoy, s.m AS moy, store_id, sum(coalesce(sales_price * quantity, 0)) sumsales
  FROM sales s JOIN item USING (item_sk) JOIN store ON store_sk = site_sk WHERE channel = 'store' AND mseq BETWEEN 48 AND 59
  GROUP BY ROLLUP (category, class, brand, product_name, year, qoy, moy, store_id)),
k AS (SELECT *, rank() OVER (PARTITION BY category ORDER BY sumsales DESC) rk FROM b)
SELECT * REPLACE (sumsales::DOUBLE AS sumsales) FROM k WHERE rk <= 100
ORDER BY """ + ", ".join(f"{k} NULLS FIRST" for k in _EIGHT_KEYS) + ", sumsales, rk LIMIT 100")
def eight_level_rollup(m):
    shops = m.store.select(c("store_sk").alias("site_sk"), "store_id")
    items = m.item.select("item_sk", "category", "class", "brand", "product_name")
    fine = (m.sold_in(c("month_seq").between(48, 59), "store", extra=("year", "qoy", "moy")).join(shops, "site_sk").join(items, "item_sk")
            .groupBy(*_EIGHT_KEYS).agg(F.sum(F.coalesce(c("sales_price") * c("quantity"), F.lit(0))).alias("s")))
    levels = fine.rollup(*_EIGHT_KEYS).agg(F.sum("s").alias("sumsales"))
    ranked = levels.withColumn("rk", F.rank().over(Window.partitionBy("category").orderBy(c("sumsales").desc()))).where(c("rk") <= 100)
    out = ranked.select(*_EIGHT_KEYS[:4], *_ints("year", "qoy", "moy"), "store_id", c("sumsales").cast("double").alias("sumsales"), *_ints("rk"))
    return top(out, *_EIGHT_KEYS, "sumsales", "rk")


@tpcds("tpcds_047_best_and_worst_items", """
, a AS (SELECT item_sk, sum(net_profit)::DOUBLE / count(*) p FROM sales WHERE channel = 'store' AND site_sk BETWEEN 4 AND 7 GROUP BY item_sk
  HAVING sum(net_profit)::DOUBLE / count(*) > 0.9 * (SELECT sum(net_profit)::DOUBLE / count(*) FROM sales
    WHERE channel = 'store' AND site_sk BETWEEN 4 AND 7 AND promo_sk = 0)),
r AS (SELECT item_sk, rank() OVER (ORDER BY p) up, rank() OVER (ORDER BY p DESC) down FROM a)
SELECT u.up AS rnk, i.product_name best_performing, j.product_name worst_performing
FROM r u JOIN r d ON u.up = d.down JOIN item i ON i.item_sk = u.item_sk JOIN item j ON j.item_sk = d.item_sk WHERE u.up < 11 ORDER BY ALL LIMIT 100""")
def best_and_worst(m):
    """Both ranks are cut to ten inside each task before the single-partition step."""
    sold = m.sold("store").where(c("site_sk").between(4, 7))
    bar = sold.where(c("promo_sk") == 0).agg(mean("net_profit", "p"))
    means = sold.groupBy("item_sk").agg(mean("net_profit", "p")).where(c("p") > F.lit(0.9) * bar.scalar())
    names = m.item.select("item_sk", "product_name")

    def first_ten(order, alias):
        ranked = means.withColumn("rnk", F.rank().over(Window.orderBy(order))).where(c("rnk") < 11)
        return ranked.join(names, "item_sk").select(c("rnk").cast("long").alias("rnk"), c("product_name").alias(alias))

    out = first_ten(c("p").asc(), "best_performing").join(first_ten(c("p").desc(), "worst_performing"), "rnk")
    return top(out, "rnk", "best_performing", "worst_performing")


@tpcds("tpcds_044_products_of_matching_makers", """
SELECT DISTINCT product_name FROM item i WHERE manufact_id BETWEEN 10 AND 30 AND (SELECT count(*) FROM item j WHERE j.manufact = i.manufact
  AND ((category = 'SMALL' AND color IN ('ring', 'bolt') AND units IN ('Each', 'Box') AND size = 'small')
    OR (category = 'LARGE' AND color IN ('gear', 'rod') AND units IN ('Case', 'Dozen') AND size IN ('large', 'extra large')))) > 0
ORDER BY product_name LIMIT 100""")
def products_of_makers(m):
    small = ((c("category") == "SMALL") & c("color").isin("ring", "bolt") & c("units").isin("Each", "Box") & (c("size") == "small"))
    large = ((c("category") == "LARGE") & c("color").isin("gear", "rod") & c("units").isin("Case", "Dozen")
             & c("size").isin("large", "extra large"))
    makers = m.item.where(small | large).select("manufact").distinct()
    out = m.item.where(c("manufact_id").between(10, 30)).join(makers, "manufact", "left_semi").select("product_name").distinct()
    return top(out, "product_name")


# ---- customers by revenue, by place and by income -----------------------------------------------


@tpcds("tpcds_057_revenue_segments", """
, mc AS (SELECT DISTINCT customer_sk, current_addr_sk FROM sales JOIN item USING (item_sk) JOIN cust USING (customer_sk)
  WHERE channel IN ('catalog', 'web') AND category = 'SMALL' AND class IN ('red', 'blue', 'hot') AND mseq = 47),
mr AS (SELECT customer_sk, sum(ext_sales_price) revenue FROM mc JOIN sales s USING (customer_sk) JOIN addr a ON a.addr_sk = current_addr_sk
  JOIN store ON store.county = a.county AND store.state = a.state
  WHERE s.channel = 'store' AND s.mseq BETWEEN 48 AND 50 GROUP BY ALL)
SELECT trunc(revenue::DOUBLE / 50000)::BIGINT segment, count(*) num_customers, trunc(revenue::DOUBLE / 50000)::BIGINT * 50000 segment_base
FROM mr GROUP BY ALL ORDER BY segment, num_customers LIMIT 100""")
def revenue_segments(m):
    """Store rows only count how many stores share the customer's county, so they are counted first."""
    start = m.date_dim.where((c("year") == 1998) & (c("moy") == 12)).select("month_seq").distinct()
    items = m.item.where((c("category") == "SMALL") & c("class").isin("red", "blue", "hot")).select("item_sk")
    buyers = (m.sold_in((c("year") == 1998) & (c("moy") == 12), "catalog", "web").join(items, "item_sk").select("customer_sk").distinct()
              .join(m.customer.select("customer_sk", "current_addr_sk"), "customer_sk"))
    shops = m.store.groupBy("county", "state").agg(F.count("*").alias("shops"))
    near = m.customer_address.join(shops, ["county", "state"]).select(c("addr_sk").alias("current_addr_sk"), "shops")
    after = m.sold("store").where((c("sold_month") >= start.scalar() + 1) & (c("sold_month") <= start.scalar() + 3))
    revenue = (after.join(buyers.join(near, "current_addr_sk"), "customer_sk").groupBy("customer_sk")
               .agg(F.sum(c("ext_sales_price") * c("shops")).cast("double").alias("revenue")))
    out = revenue.groupBy((c("revenue") / 50000).cast("long").alias("segment")).agg(F.count("*").alias("num_customers"))
    return top(out.withColumn("segment_base", c("segment") * 50000), "segment", "num_customers")


@tpcds("tpcds_087_customers_by_city_and_income", """
SELECT c.customer_id, concat(coalesce(last_name, ''), ', ', coalesce(first_name, '')) customer_name
FROM cust c JOIN addr a ON a.addr_sk = current_addr_sk JOIN hdemo ON hdemo_sk = current_hdemo_sk JOIN rets r ON r.cdemo_sk = current_cdemo_sk
WHERE city = 'City_3' AND lower_bound >= 30000 AND upper_bound <= 90000 AND r.channel = 'store' ORDER BY c.customer_id LIMIT 100""")
def customers_by_city(m):
    """A customer repeats once per store return of the same demographic group.

    The group sizes are counted first; a customer's copies are then made up to the
    rows that the report shows, so the customer x return product is never built.
    """
    bands = m.income_band.where((c("lower_bound") >= 30000) & (c("upper_bound") <= 90000)).select("income_band_sk")
    homes = m.household_demographics.join(bands, "income_band_sk").select(c("hdemo_sk").alias("current_hdemo_sk"))
    places = m.customer_address.where(c("city") == "City_3").select(c("addr_sk").alias("current_addr_sk"))
    copies = m.returned("store").groupBy(c("cdemo_sk").alias("current_cdemo_sk")).agg(F.count("*").alias("n"))
    people = (m.customer.join(places, "current_addr_sk").join(homes, "current_hdemo_sk").join(copies, "current_cdemo_sk")
              .select("customer_id", F.concat(F.coalesce("last_name", F.lit("")), F.lit(", "), F.coalesce("first_name", F.lit(""))).alias("customer_name"),
                      F.explode(F.sequence(F.lit(1), F.least(c("n"), F.lit(TOP)))).alias("copy")))
    return top(people.drop("copy"), "customer_id")


@tpcds("tpcds_067_cross_channel_items_two_years", """
, ui AS (SELECT s.item_sk FROM sales s JOIN rets r ON r.order_number = s.order_number AND r.item_sk = s.item_sk
  WHERE s.channel = 'catalog' GROUP BY s.item_sk HAVING sum(ext_list_price) > 2 * sum(refunded_cash) * 0.5),
cs AS (SELECT product_name, s.item_sk, store_name, store.zip store_zip, b.street_name b_street, b.city b_city, n.street_name c_street, n.city c_city, s.y AS syear,
    year(DATE '1995-01-01' + first_sales_sk) fsyear, year(DATE '1995-01-01' + first_shipto_sk) s2year, count(*) cnt,
    sum(s.wholesale_cost) s1, sum(s.list_price) s2, sum(s.coupon_amt) s3
  FROM sales s JOIN rets r ON r.order_number = s.order_number AND r.item_sk = s.item_sk JOIN ui ON ui.item_sk = s.item_sk
  JOIN store ON store_sk = s.site_sk JOIN cust c ON c.customer_sk = s.customer_sk JOIN cdemo d1 ON d1.cdemo_sk = s.cdemo_sk
  JOIN cdemo d2 ON d2.cdemo_sk = current_cdemo_sk JOIN hdemo h1 ON h1.hdemo_sk = s.hdemo_sk JOIN hdemo h2 ON h2.hdemo_sk = current_hdemo_sk
  JOIN addr b ON b.addr_sk = s.addr_sk JOIN addr n ON n.addr_sk = current_addr_sk JOIN promo p ON p.promo_sk = s.promo_sk JOIN item i ON i.item_sk = s.item_sk
  WHERE s.channel = 'store' AND d1.marital_status <> d2.marital_status AND color IN ('ring', 'bolt', 'gear', 'rod', 'plate', 'anvil')
    AND i.current_price BETWEEN 905 AND 995 GROUP BY ALL)
SELECT a.product_name, a.store_name, a.store_zip, a.b_street, a.b_city, a.c_street, a.c_city, a.syear, a.cnt, a.s1::DOUBLE s11, a.s2::DOUBLE s21, a.s3::DOUBLE s31,
  z.s1::DOUBLE s12, z.s2::DOUBLE s22, z.s3::DOUBLE s32, z.syear syear2, z.cnt cnt2
FROM cs a JOIN cs z ON a.item_sk = z.item_sk AND a.store_name = z.store_name
WHERE a.syear = 1998 AND z.syear = 1999 AND z.cnt <= a.cnt""")
def cross_channel_two_years(m):
    """Eighteen tables: the fixed dimensions broadcast, the facts meet on (order, item)."""
    sold_back = m.returned("catalog").select("order_number", "item_sk", "refunded_cash")
    refunded = (m.sold("catalog").join(sold_back, ["order_number", "item_sk"]).groupBy("item_sk")
                .agg(F.sum("ext_list_price").alias("sale"), F.sum("refunded_cash").alias("refund"))
                .where(c("sale") > 2 * c("refund") * F.lit("0.5").cast("decimal(2,1)")).select("item_sk"))
    backs = m.returned("store").select("order_number", "item_sk")
    shops = m.store.select(c("store_sk").alias("site_sk"), "store_name", c("zip").alias("store_zip"))
    first = lambda role, name: F.broadcast(m.date_dim.select(c("date_sk").alias(role), c("year").alias(name)))
    bands = m.income_band.select("income_band_sk")
    home = lambda key: m.household_demographics.join(bands, "income_band_sk").select(c("hdemo_sk").alias(key))
    people = (m.customer.select("customer_sk", "current_cdemo_sk", "current_hdemo_sk", "current_addr_sk", "first_sales_sk", "first_shipto_sk")
              .join(first("first_sales_sk", "fsyear"), "first_sales_sk").join(first("first_shipto_sk", "s2year"), "first_shipto_sk")
              .join(m.customer_demographics.select(c("cdemo_sk").alias("current_cdemo_sk"), c("marital_status").alias("now_marital")), "current_cdemo_sk")
              .join(home("current_hdemo_sk"), "current_hdemo_sk")
              .join(m.customer_address.select(c("addr_sk").alias("current_addr_sk"), c("street_name").alias("c_street"), c("city").alias("c_city")), "current_addr_sk"))
    items = m.item.where(c("color").isin("ring", "bolt", "gear", "rod", "plate", "anvil") & c("current_price").between(905, 995)).select(
        "item_sk", "product_name")
    sold = (m.sold_in(c("year").isin(1998, 1999), "store", extra=("year",)).join(items, "item_sk").join(refunded, "item_sk", "left_semi")
            .join(m.promotion.select("promo_sk"), "promo_sk").join(home("hdemo_sk"), "hdemo_sk").join(backs, ["order_number", "item_sk"])
            .join(shops, "site_sk").join(m.customer_demographics.select("cdemo_sk", "marital_status"), "cdemo_sk")
            .join(m.customer_address.select("addr_sk", c("street_name").alias("b_street"), c("city").alias("b_city")), "addr_sk")
            .join(people, "customer_sk").where(c("marital_status") != c("now_marital")))
    keys = ["product_name", "item_sk", "store_name", "store_zip", "b_street", "b_city", "c_street", "c_city", "year", "fsyear", "s2year"]
    cross = sold.groupBy(*keys).agg(F.count("*").alias("cnt"), total("wholesale_cost", "s1"), total("list_price", "s2"), total("coupon_amt", "s3"))
    year = lambda y: c("year") == y
    one = cross.where(year(1998)).select(*[c(k) for k in keys[:8]], c("year").cast("long").alias("syear"), "cnt", c("s1").alias("s11"),
                                         c("s2").alias("s21"), c("s3").alias("s31"))
    two = cross.where(year(1999)).select("item_sk", "store_name", c("s1").alias("s12"), c("s2").alias("s22"), c("s3").alias("s32"),
                                         c("year").cast("long").alias("syear2"), c("cnt").alias("cnt2"))
    out = one.join(two, ["item_sk", "store_name"]).where(c("cnt2") <= c("cnt")).drop("item_sk")
    return out.orderBy("product_name", "store_name", "cnt2", "s11", "s12")
