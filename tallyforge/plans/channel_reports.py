"""Reports over several channels. The sales fact holds all channels, so most of them are
one scan and one shuffle with conditional sums, where the usual text joins one
aggregate per channel and year."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import rank_by_value
from .common import c, mean, top, total, tpcds
from .star_reports import _DAYS, _DAY_SQL, weekday_sums

CHANNELS = ("store", "catalog", "web")


def _in(channel: str, value, *more: Column) -> Column:
    """Sum of ``value`` over the rows of one channel (null where it has none)."""
    keep = reduce(lambda a, b: a & b, more, c("channel") == channel)
    return F.sum(F.when(keep, c(value) if isinstance(value, str) else value))


# ---- weekly pivots, year against year ------------------------------------------------------

_SHORT = [f"{d[:3].lower()}_sales" for d in _DAYS]
_WEEK_RATIO = ", ".join(f"round(a.{s} / b.{s}, 2) AS {s}_ratio" for s in _SHORT)


@tpcds("tpcds_002_weekday_ratio_year_on_year", f"""
, w AS (SELECT wseq, {_DAY_SQL} FROM sales WHERE channel IN ('web', 'catalog') GROUP BY wseq),
d AS (SELECT floor(date_diff('day', DATE '1995-01-01', d::DATE) / 7)::BIGINT wk, year(d) y
  FROM range(DATE '1998-01-01', DATE '2000-01-01', INTERVAL 1 DAY) g(d))
SELECT a.wseq AS week, {_WEEK_RATIO}
FROM w a JOIN d d1 ON d1.wk = a.wseq AND d1.y = 1998 JOIN w b ON b.wseq = a.wseq + 53
JOIN d d2 ON d2.wk = b.wseq AND d2.y = 1999""")
def weekday_ratio(m):
    span = c("month_seq").between(35, 60)  # both years with the weeks that reach over their ends
    weekly = (m.sold_in(span, "web", "catalog", extra=("week_seq", "day_name")).groupBy("week_seq")
              .agg(*weekday_sums("sales_price")))
    per_day = lambda year: F.broadcast(m.date_dim.where(c("year") == year).select("week_seq"))
    first = weekly.join(per_day(1998), "week_seq")
    second = weekly.join(per_day(1999), "week_seq").select(
        (c("week_seq") - 53).alias("week_seq"), *[c(s).alias(f"next_{s}") for s in _SHORT])
    return first.join(second, "week_seq").select(
        c("week_seq").cast("long").alias("week"),
        *[F.round(F.try_divide(c(s), c(f"next_{s}")), 2).alias(f"{s}_ratio") for s in _SHORT])


@tpcds("tpcds_062_store_weekday_ratio", f"""
, w AS (SELECT wseq, site_sk, {_DAY_SQL} FROM sales WHERE channel = 'store' GROUP BY ALL),
d AS (SELECT floor(date_diff('day', DATE '1995-01-01', d::DATE) / 7)::BIGINT wk, (year(d) - 1995) * 12 + month(d) - 1 ms
  FROM range(DATE '1998-01-01', DATE '2000-01-01', INTERVAL 1 DAY) g(d))
SELECT store_name, store_id, a.wseq AS week, {", ".join(f"a.{s} / b.{s} AS {s}_ratio" for s in _SHORT)}
FROM w a JOIN d d1 ON d1.wk = a.wseq AND d1.ms BETWEEN 36 AND 47 JOIN w b ON b.wseq = a.wseq + 52 AND b.site_sk = a.site_sk
JOIN d d2 ON d2.wk = b.wseq AND d2.ms BETWEEN 48 AND 59 JOIN store ON store_sk = a.site_sk
ORDER BY store_name, store_id, week LIMIT 100""")
def store_weekday_ratio(m):
    weekly = (m.sold_in(c("month_seq").between(35, 60), "store", extra=("week_seq", "day_name"))
              .where(c("site_sk").isNotNull()).groupBy("week_seq", "site_sk").agg(*weekday_sums("sales_price")))
    per_day = lambda low: F.broadcast(m.date_dim.where(c("month_seq").between(low, low + 11)).select("week_seq"))
    first = weekly.join(per_day(36), "week_seq")
    second = weekly.join(per_day(48), "week_seq").select(
        (c("week_seq") - 52).alias("week_seq"), "site_sk", *[c(s).alias(f"next_{s}") for s in _SHORT])
    shops = m.store.select(c("store_sk").alias("site_sk"), "store_name", "store_id")
    out = first.join(second, ["week_seq", "site_sk"]).join(shops, "site_sk").select(
        "store_name", "store_id", c("week_seq").cast("long").alias("week"),
        *[F.try_divide(c(s), c(f"next_{s}")).alias(f"{s}_ratio") for s in _SHORT])
    return top(out, "store_name", "store_id", "week")


# ---- growth of a customer in one channel against another -----------------------------------


def _growth(m, value, channels):
    """One row per customer with the sums of 1998 and 1999 for each channel."""
    sums = [_in(ch, value, c("year") == y).cast("double").alias(f"{ch}_{y}") for ch in channels for y in (1998, 1999)]
    found = [_in(ch, F.lit(1), c("year") == y).alias(f"has_{ch}_{y}") for ch in channels for y in (1998, 1999)]
    per = m.sold_in(c("year").isin(1998, 1999), *channels, extra=("year",)).groupBy("customer_sk").agg(*sums, *found)
    both = reduce(lambda a, b: a & b, [(c(f"{ch}_1998") > 0) & c(f"has_{ch}_1999").isNotNull() for ch in channels])
    people = m.customer.select("customer_sk", "customer_id", "first_name", "last_name", "preferred")
    return per.where(both), people


def _rate(channel):
    return c(f"{channel}_1999") / c(f"{channel}_1998")


def _growth_sql(value, channels, condition, columns):
    parts = ", ".join(f"(sum({value}) FILTER (WHERE channel = '{ch}' AND y = {y}))::DOUBLE {ch[0]}{i}"
                      for ch in channels for i, y in ((1, 1998), (2, 1999)))
    positive = " AND ".join(f"{ch[0]}1 > 0 AND {ch[0]}2 IS NOT NULL" for ch in channels)
    return f"""
, t AS (SELECT customer_sk, {parts} FROM sales GROUP BY ALL)
SELECT {columns} FROM t JOIN cust USING (customer_sk) WHERE {positive} AND {condition} ORDER BY {columns} LIMIT 100"""


_PERSON = "customer_id, first_name, last_name, preferred"
_MARGIN_SQL = "(ext_list_price - ext_wholesale_cost - ext_discount_amt) + ext_sales_price"


@tpcds("tpcds_004_catalog_growth_leads", _growth_sql(_MARGIN_SQL, CHANNELS, "c2 / c1 > s2 / s1 AND c2 / c1 > w2 / w1", _PERSON))
def catalog_growth_leads(m):
    value = c("ext_list_price") - c("ext_wholesale_cost") - c("ext_discount_amt") + c("ext_sales_price")
    per, people = _growth(m, value, CHANNELS)
    out = per.where((_rate("catalog") > _rate("store")) & (_rate("catalog") > _rate("web"))).join(people, "customer_sk")
    return top(out.select(*_PERSON.split(", ")), *_PERSON.split(", "))


@tpcds("tpcds_011_web_growth_over_store",
       _growth_sql("ext_list_price - ext_discount_amt", ("store", "web"), "w2 / w1 > s2 / s1", _PERSON))
def web_growth(m):
    per, people = _growth(m, c("ext_list_price") - c("ext_discount_amt"), ("store", "web"))
    out = per.where(_rate("web") > _rate("store")).join(people, "customer_sk")
    return top(out.select(*_PERSON.split(", ")), *_PERSON.split(", "))


@tpcds("tpcds_077_web_growth_net_paid",
       _growth_sql("net_paid", ("store", "web"), "w2 / w1 > s2 / s1", "customer_id, first_name, last_name"))
def web_growth_paid(m):
    per, people = _growth(m, "net_paid", ("store", "web"))
    out = per.where(_rate("web") > _rate("store")).join(people, "customer_sk")
    return top(out.select("customer_id", "first_name", "last_name"), "customer_id", "first_name", "last_name")


@tpcds("tpcds_033_state_quarter_growth", """
, t AS (SELECT state, """ + ", ".join(
    f"(sum(ext_sales_price) FILTER (WHERE channel = '{ch}' AND quarter(sold) = {q}))::DOUBLE {ch[0]}{q}"
    for ch in ("store", "web") for q in (1, 2, 3)) + """ FROM sales JOIN addr USING (addr_sk) WHERE y = 1999 GROUP BY state)
SELECT state, 1999::BIGINT AS year, w2 / w1 web_q1_q2, s2 / s1 store_q1_q2, w3 / w2 web_q2_q3, s3 / s2 store_q2_q3
FROM t WHERE w2 / w1 > s2 / s1 AND w3 / w2 > s3 / s2""")
def state_quarter_growth(m):
    sums = [_in(ch, "ext_sales_price", c("qoy") == q).cast("double").alias(f"{ch}_{q}")
            for ch in ("store", "web") for q in (1, 2, 3)]
    per = (m.sold_in((c("year") == 1999) & (c("qoy") <= 3), "store", "web", extra=("qoy",))
           .groupBy("addr_sk", "channel", "qoy").agg(F.sum("ext_sales_price").alias("ext_sales_price"))
           .join(m.customer_address.select("addr_sk", "state"), "addr_sk").groupBy("state").agg(*sums))
    rate = lambda ch, a, b: F.when(c(f"{ch}_{a}") > 0, c(f"{ch}_{b}") / c(f"{ch}_{a}"))
    out = per.select("state", F.lit(1999).cast("long").alias("year"), rate("web", 1, 2).alias("web_q1_q2"),
                     rate("store", 1, 2).alias("store_q1_q2"), rate("web", 2, 3).alias("web_q2_q3"),
                     rate("store", 2, 3).alias("store_q2_q3"))
    return out.where((c("web_q1_q2") > c("store_q1_q2")) & (c("web_q2_q3") > c("store_q2_q3")))


# ---- the same item sales in three channels --------------------------------------------------


def _three_channels(m, key, chosen, when):
    """Revenue per item attribute whose value occurs in ``chosen`` items (IN subquery -> semi join)."""
    wanted = m.item.where(chosen).select(key).distinct()
    items = m.item.join(wanted, key, "left_semi").select("item_sk", key)
    places = m.customer_address.where(c("gmt_offset") == -5).select("addr_sk")
    out = (m.sold_in(when).join(places, "addr_sk").join(items, "item_sk")
           .groupBy(key).agg(total("ext_sales_price", "total_sales")))
    return out


_THREE_SQL = """
, k AS (SELECT {0} FROM item WHERE {1}),
legs AS (SELECT {0}, sum(ext_sales_price) s FROM sales JOIN item USING (item_sk) JOIN addr USING (addr_sk)
  WHERE channel = 'store' AND gmt_offset = -5 AND {2} AND {0} IN (FROM k) GROUP BY {0}
  UNION ALL SELECT {0}, sum(ext_sales_price) FROM sales JOIN item USING (item_sk) JOIN addr USING (addr_sk)
  WHERE channel = 'catalog' AND gmt_offset = -5 AND {2} AND {0} IN (FROM k) GROUP BY {0}
  UNION ALL SELECT {0}, sum(ext_sales_price) FROM sales JOIN item USING (item_sk) JOIN addr USING (addr_sk)
  WHERE channel = 'web' AND gmt_offset = -5 AND {2} AND {0} IN (FROM k) GROUP BY {0})
SELECT {0}, sum(s)::DOUBLE total_sales FROM legs GROUP BY {0} ORDER BY {3} LIMIT 100"""


@tpcds("tpcds_035_manufacturer_three_channels",
       _THREE_SQL.format("manufact_id", "category = 'PROMO'", "y = 1998 AND m = 5", "total_sales, manufact_id"))
def manufacturer_channels(m):
    out = _three_channels(m, "manufact_id", c("category") == "PROMO", (c("year") == 1998) & (c("moy") == 5))
    return top(out, "total_sales", "manufact_id")


@tpcds("tpcds_059_colour_three_channels",
       _THREE_SQL.format("item_id", "color IN ('ring', 'bolt', 'gear')", "y = 1999 AND m = 2", "total_sales, item_id"))
def colour_channels(m):
    out = _three_channels(m, "item_id", c("color").isin("ring", "bolt", "gear"), (c("year") == 1999) & (c("moy") == 2))
    return top(out, "total_sales", "item_id")


@tpcds("tpcds_063_category_three_channels",
       _THREE_SQL.format("item_id", "category = 'LARGE'", "y = 1998 AND m = 9", "item_id, total_sales"))
def category_channels(m):
    out = _three_channels(m, "item_id", c("category") == "LARGE", (c("year") == 1998) & (c("moy") == 9))
    return top(out, "item_id", "total_sales")


@tpcds("tpcds_074_brand_sales_at_meal_times", """
SELECT brand_id, brand, h AS hour, mi AS minute, sum(ext_sales_price)::DOUBLE ext_price
FROM sales JOIN item USING (item_sk) JOIN clock USING (minute_of_day)
WHERE y = 1999 AND m = 11 AND manager_id < 10 AND (meal_time = 'breakfast' OR meal_time = 'dinner') GROUP BY ALL""")
def meal_time_sales(m):
    times = m.time_dim.where((c("meal_time") == "breakfast") | (c("meal_time") == "dinner")).select(
        c("time_sk").alias("sold_time_sk"), "hour", "minute")
    items = m.item.where(c("manager_id") < 10).select("item_sk", "brand_id", "brand")
    return (m.sold_in((c("year") == 1999) & (c("moy") == 11)).join(times, "sold_time_sk").join(items, "item_sk")
            .groupBy("brand_id", "brand", "hour", "minute").agg(total("ext_sales_price", "ext_price"))
            .orderBy(c("ext_price").desc(), "brand_id", "hour", "minute"))


@tpcds("tpcds_079_sales_with_missing_keys", """
SELECT channel, CASE channel WHEN 'store' THEN 'site_sk' WHEN 'web' THEN 'ship_customer_sk' ELSE 'ship_addr_sk' END col_name,
  y AS year, quarter(sold) AS qoy, category, count(*) sales_cnt, sum(ext_sales_price)::DOUBLE sales_amt
FROM sales JOIN item USING (item_sk)
WHERE (channel = 'store' AND site_sk IS NULL) OR (channel = 'web' AND ship_customer_sk IS NULL)
  OR (channel = 'catalog' AND ship_addr_sk IS NULL)
GROUP BY ALL ORDER BY channel, col_name, year, qoy, category LIMIT 100""")
def missing_keys(m):
    leg = lambda channel, column: m.sold(channel).where(c(column).isNull()).select(
        "channel", F.lit(column).alias("col_name"), "sold_date_sk", "sold_month", "item_sk", "ext_sales_price")
    legs = leg("store", "site_sk").unionByName(leg("web", "ship_customer_sk")).unionByName(leg("catalog", "ship_addr_sk"))
    out = (legs.join(m.days(None, "year", "qoy"), ["sold_date_sk", "sold_month"]).join(m.item.select("item_sk", "category"), "item_sk")
           .groupBy("channel", "col_name", c("year").cast("long").alias("year"), c("qoy").cast("long").alias("qoy"), "category")
           .agg(F.count("*").alias("sales_cnt"), total("ext_sales_price", "sales_amt")))
    return top(out, "channel", "col_name", "year", "qoy", "category")


# ---- sales, returns and profit per channel and place, with totals --------------------------


def _site_names(m, **web_and_catalog: DataFrame) -> DataFrame:
    stores = m.store.select(F.lit("store").alias("channel"), c("store_sk").alias("key"),
                            F.concat(F.lit("store"), "store_id").alias("id"))
    pages = m.catalog_page.select(F.lit("catalog").alias("channel"), c("catalog_page_sk").alias("key"),
                                  F.concat(F.lit("catalog_page"), "catalog_page_id").alias("id"))
    sites = m.web_site.select(F.lit("web").alias("channel"), c("web_site_sk").alias("key"),
                              F.concat(F.lit("web_site"), "web_site_id").alias("id"))
    return stores.unionByName(pages).unionByName(sites)


def _key():
    return F.when(c("channel") == "catalog", c("page_sk")).otherwise(c("site_sk")).alias("key")


def _channel_rollup(fine: DataFrame) -> DataFrame:
    """Totals over (channel, id) from sums that are already one row per id."""
    out = fine.rollup("channel", "id").agg(total("sales"), total("returns"), total("profit"))
    return top(out, "channel", "id")


_ID_SQL = """CASE channel WHEN 'store' THEN 'store' || (SELECT s_name FROM supplier WHERE s_suppkey = site_sk)
  WHEN 'catalog' THEN 'catalog_pagePAGE' || page_sk ELSE 'web_siteWEB' || site_sk END"""
_ROLLUP_TAIL = """
SELECT channel, id, sum(sales)::DOUBLE sales, sum(ret)::DOUBLE returns, sum(profit)::DOUBLE profit
FROM f GROUP BY ROLLUP (channel, id) ORDER BY channel NULLS FIRST, id NULLS FIRST LIMIT 100"""


@tpcds("tpcds_005_channel_sales_returns_rollup", f"""
, f AS (SELECT channel, {_ID_SQL} id, ext_sales_price sales, 0 ret, net_profit profit FROM sales
  WHERE sold BETWEEN DATE '1998-08-04' AND DATE '1998-08-18' AND NOT (channel = 'store' AND site_sk IS NULL)
  UNION ALL SELECT channel, {_ID_SQL}, 0, return_amt, -net_loss FROM rets
  WHERE returned BETWEEN DATE '1998-08-04' AND DATE '1998-08-18' AND NOT (channel = 'store' AND site_sk IS NULL))""" + _ROLLUP_TAIL)
def channel_sales_returns(m):
    when = c("d_date").between("1998-08-04", F.date_add(F.lit("1998-08-04").cast("date"), 14))
    zero = F.lit(0).cast("decimal(18,2)")
    sales = m.sold_in(when).select("channel", _key(), c("ext_sales_price").alias("sales"), zero.alias("returns"), c("net_profit").alias("profit"))
    backs = m.returned_in(when).select("channel", _key(), zero.alias("sales"), c("return_amt").alias("returns"), (-c("net_loss")).alias("profit"))
    fine = sales.unionByName(backs).groupBy("channel", "key").agg(*[F.sum(x).alias(x) for x in ("sales", "returns", "profit")])
    return _channel_rollup(fine.join(_site_names(m), ["channel", "key"]))


@tpcds("tpcds_083_channel_net_of_returns_rollup", f"""
, f AS (SELECT channel, {_ID_SQL} id, ext_sales_price sales, coalesce(r.return_amt, 0) ret, net_profit - coalesce(r.net_loss, 0) profit
  FROM sales s LEFT JOIN (SELECT order_number o, item_sk i, return_amt, net_loss FROM rets) r ON o = order_number AND i = s.item_sk
  JOIN item USING (item_sk) JOIN promo USING (promo_sk)
  WHERE sold BETWEEN DATE '1998-08-04' AND DATE '1998-09-03' AND current_price > 920 AND tv = 'N'
    AND NOT (channel = 'store' AND site_sk IS NULL))""" + _ROLLUP_TAIL)
def channel_net_of_returns(m):
    when = c("d_date").between("1998-08-04", F.date_add(F.lit("1998-08-04").cast("date"), 30))
    sold = (m.sold_in(when).join(m.promotion.where(c("tv") == "N").select("promo_sk"), "promo_sk")
            .join(m.item.where(c("current_price") > 920).select("item_sk"), "item_sk"))
    backs = m.returns.select("channel", "order_number", "item_sk", "return_amt", "net_loss")
    none = F.lit(0).cast("decimal(18,2)")
    fine = (sold.join(backs, ["channel", "order_number", "item_sk"], "left").groupBy("channel", _key()).agg(
        F.sum("ext_sales_price").alias("sales"), F.sum(F.coalesce("return_amt", none)).alias("returns"),
        F.sum(c("net_profit") - F.coalesce("net_loss", none)).alias("profit")))
    return _channel_rollup(fine.join(_site_names(m), ["channel", "key"]))


@tpcds("tpcds_080_channel_profit_rollup", """
, ss AS (SELECT channel, CASE channel WHEN 'web' THEN page_sk ELSE site_sk END k, sum(ext_sales_price) sales, sum(net_profit) profit
  FROM sales WHERE sold BETWEEN DATE '1998-08-04' AND DATE '1998-09-03' GROUP BY ALL),
rr AS (SELECT channel, CASE channel WHEN 'web' THEN page_sk ELSE site_sk END k, sum(return_amt) ret, sum(net_loss) loss
  FROM rets WHERE returned BETWEEN DATE '1998-08-04' AND DATE '1998-09-03' GROUP BY ALL),
f AS (SELECT ss.channel, ss.k AS id, sales, coalesce(ret, 0) ret, profit - coalesce(loss, 0) profit
  FROM ss LEFT JOIN rr ON ss.channel = rr.channel AND ss.k = rr.k WHERE ss.channel <> 'catalog' AND ss.k IS NOT NULL
  UNION ALL SELECT 'catalog', ss.k, sales, ret, profit - loss FROM ss CROSS JOIN rr WHERE ss.channel = 'catalog' AND rr.channel = 'catalog')
SELECT channel, id::VARCHAR id, sum(sales)::DOUBLE sales, sum(ret)::DOUBLE returns, sum(profit)::DOUBLE profit
FROM f GROUP BY ROLLUP (channel, id) ORDER BY channel NULLS FIRST, id NULLS FIRST LIMIT 100""")
def channel_profit(m):
    """Store and web sites keep their own returns; the catalog pairs every call center
    with every returning call center. The pairing is computed, not joined: each sales
    row repeats once per returning center and meets the sum of all returns."""
    when = c("d_date").between("1998-08-04", F.date_add(F.lit("1998-08-04").cast("date"), 30))
    place = F.when(c("channel") == "web", c("page_sk")).otherwise(c("site_sk")).alias("id")
    sales = (m.sold_in(when).groupBy("channel", place)
             .agg(F.sum("ext_sales_price").alias("sales"), F.sum("net_profit").alias("profit")).where(c("id").isNotNull()))
    backs = (m.returned_in(when).groupBy("channel", place)
             .agg(F.sum("return_amt").alias("ret"), F.sum("net_loss").alias("loss")))
    none = F.lit(0).cast("decimal(18,2)")
    own = sales.where(c("channel") != "catalog").join(backs, ["channel", "id"], "left").select(
        "channel", "id", "sales", F.coalesce("ret", none).alias("returns"), (c("profit") - F.coalesce("loss", none)).alias("profit"))
    whole = backs.where(c("channel") == "catalog").groupBy("channel").agg(
        F.count("*").alias("n"), F.sum("ret").alias("ret"), F.sum("loss").alias("loss"))
    paired = sales.where(c("channel") == "catalog").join(whole, "channel").select(
        "channel", "id", (c("sales") * c("n")).alias("sales"), c("ret").alias("returns"),
        (c("profit") * c("n") - c("loss")).alias("profit"))
    levels = own.unionByName(paired).rollup("channel", "id").agg(total("sales"), total("returns"), total("profit"))
    return top(levels.withColumn("id", c("id").cast("string")), "channel", "id")


# ---- returns against sales -------------------------------------------------------------------


@tpcds("tpcds_052_worst_return_ratios", """
, t AS (SELECT s.channel, s.item_sk item, sum(coalesce(r.return_quantity, 0))::BIGINT rq, sum(s.quantity)::BIGINT q,
    (sum(coalesce(r.return_amt, 0)) * 100)::BIGINT ra, (sum(s.net_paid) * 100)::BIGINT np
  FROM sales s LEFT JOIN rets r ON r.order_number = s.order_number AND r.item_sk = s.item_sk
  WHERE r.return_amt > 10000 AND s.net_profit > 1 AND s.net_paid > 0 AND s.quantity > 0 AND s.y = 1999 AND s.m = 12 GROUP BY ALL),
v AS (SELECT channel, item, (20000 * rq + q) // (2 * q) AS a, (20000 * ra + np) // (2 * np) AS b FROM t),
k AS (SELECT *, rank() OVER (PARTITION BY channel ORDER BY a) return_rank, rank() OVER (PARTITION BY channel ORDER BY b) currency_rank FROM v)
SELECT channel, item, a::DOUBLE / 10000 return_ratio, return_rank, currency_rank FROM k
WHERE return_rank <= 10 OR currency_rank <= 10 ORDER BY channel, return_rank, currency_rank, item LIMIT 100""")
def worst_return_ratios(m):
    backs = m.returns.where(c("return_amt") > 10000).select("channel", "order_number", "item_sk", "return_quantity", "return_amt")
    sold = m.sold_in((c("year") == 1999) & (c("moy") == 12)).where(
        (c("net_profit") > 1) & (c("net_paid") > 0) & (c("quantity") > 0))
    ratio = lambda a, b: F.round(F.sum(a).cast("decimal(25,4)") / F.sum(b).cast("decimal(25,4)"), 4).cast("decimal(15,4)")
    per = sold.join(backs, ["channel", "order_number", "item_sk"]).groupBy("channel", c("item_sk").alias("item")).agg(
        ratio("return_quantity", "quantity").alias("ratio"), ratio("return_amt", "net_paid").alias("money_ratio"))
    ranked = rank_by_value(rank_by_value(per, ["channel"], "ratio", "return_rank"), ["channel"], "money_ratio", "currency_rank")
    out = ranked.where((c("return_rank") <= 10) | (c("currency_rank") <= 10)).select(
        "channel", "item", c("ratio").cast("double").alias("return_ratio"), "return_rank", "currency_rank").distinct()
    return top(out, "channel", "return_rank", "currency_rank", "item")


@tpcds("tpcds_078_brand_sales_year_on_year", """
, d AS (SELECT s.y, brand_id, class, category, manufact_id, quantity - coalesce(return_quantity, 0) cnt,
    ext_sales_price - coalesce(return_amt, 0) amt FROM sales s JOIN item USING (item_sk)
  LEFT JOIN rets r ON r.order_number = s.order_number AND r.item_sk = s.item_sk WHERE category = 'SMALL' AND s.channel = 'catalog'
  UNION SELECT s.y, brand_id, class, category, manufact_id, quantity - coalesce(return_quantity, 0),
    ext_sales_price - coalesce(return_amt, 0) FROM sales s JOIN item USING (item_sk)
  LEFT JOIN rets r ON r.order_number = s.order_number AND r.item_sk = s.item_sk WHERE category = 'SMALL' AND s.channel <> 'catalog'),
a AS (SELECT y, brand_id, class, category, manufact_id, sum(cnt)::BIGINT cnt, sum(amt) amt FROM d GROUP BY ALL)
SELECT p.y AS prev_year, n.y AS year, n.brand_id, n.class, n.category, n.manufact_id, p.cnt prev_yr_cnt, n.cnt curr_yr_cnt,
  n.cnt - p.cnt cnt_diff, (n.amt - p.amt)::DOUBLE amt_diff
FROM a n JOIN a p ON (n.brand_id, n.class, n.category, n.manufact_id) = (p.brand_id, p.class, p.category, p.manufact_id)
WHERE n.y = 1999 AND p.y = 1998 AND n.cnt::DECIMAL(17,2) / p.cnt::DECIMAL(17,2) < 0.9
ORDER BY cnt_diff, amt_diff, n.brand_id, n.class, n.manufact_id LIMIT 100""")
def brand_year_on_year(m):
    keys = ["brand_id", "class", "category", "manufact_id"]
    backs = m.returns.select("channel", "order_number", "item_sk", "return_quantity", "return_amt")
    items = m.item.where(c("category") == "SMALL").select("item_sk", *keys)
    detail = (m.sold_in(c("year").isin(1998, 1999), extra=("year",)).join(items, "item_sk")
              .join(backs, ["channel", "order_number", "item_sk"], "left")
              .select("year", *keys, (c("quantity") - F.coalesce("return_quantity", F.lit(0))).alias("cnt"),
                      (c("ext_sales_price") - F.coalesce("return_amt", F.lit(0).cast("decimal(18,2)"))).alias("amt"))
              .distinct())  # equal detail rows count once, whatever their channel
    of = lambda year, x: F.sum(F.when(c("year") == year, c(x)))
    out = detail.groupBy(*keys).agg(of(1998, "cnt").alias("prev_yr_cnt"), of(1999, "cnt").alias("curr_yr_cnt"),
                                    of(1998, "amt").alias("prev_amt"), of(1999, "amt").alias("curr_amt"))
    share = F.try_divide(c("curr_yr_cnt").cast("decimal(17,2)"), c("prev_yr_cnt").cast("decimal(17,2)"))
    out = out.where(share < 0.9).select(
        F.lit(1998).cast("long").alias("prev_year"), F.lit(1999).cast("long").alias("year"), *keys, "prev_yr_cnt", "curr_yr_cnt",
        (c("curr_yr_cnt") - c("prev_yr_cnt")).alias("cnt_diff"), (c("curr_amt") - c("prev_amt")).cast("double").alias("amt_diff"))
    return top(out, "cnt_diff", "amt_diff", "brand_id", "class", "manufact_id")


@tpcds("tpcds_081_kept_sales_store_against_other", """
, k AS (SELECT s.* FROM sales s LEFT JOIN rets r ON r.order_number = s.order_number AND r.item_sk = s.item_sk WHERE r.item_sk IS NULL),
g AS (SELECT channel, y, item_sk, customer_sk, sum(quantity)::BIGINT q, sum(wholesale_cost) wc, sum(sales_price) sp FROM k GROUP BY ALL)
SELECT s.y AS year, s.item_sk, s.customer_sk, ((200 * s.q + coalesce(w.q, 0) + coalesce(ct.q, 0)) // (2 * (coalesce(w.q, 0) + coalesce(ct.q, 0))))::DOUBLE / 100 ratio,
  s.q store_qty, s.wc::DOUBLE store_wholesale_cost, s.sp::DOUBLE store_sales_price, coalesce(w.q, 0) + coalesce(ct.q, 0) other_qty,
  (coalesce(w.wc, 0) + coalesce(ct.wc, 0))::DOUBLE other_wholesale_cost, (coalesce(w.sp, 0) + coalesce(ct.sp, 0))::DOUBLE other_sales_price
FROM g s LEFT JOIN g w ON w.channel = 'web' AND (w.y, w.item_sk, w.customer_sk) = (s.y, s.item_sk, s.customer_sk)
LEFT JOIN g ct ON ct.channel = 'catalog' AND (ct.y, ct.item_sk, ct.customer_sk) = (s.y, s.item_sk, s.customer_sk)
WHERE s.channel = 'store' AND (coalesce(w.q, 0) > 0 OR coalesce(ct.q, 0) > 0) AND s.y BETWEEN 1996 AND 2000
ORDER BY ALL LIMIT 100""")
def kept_sales(m):
    backs = m.returns.select("channel", "order_number", "item_sk")
    kept = m.sold_in(c("year").between(1996, 2000), extra=("year",)).join(backs, ["channel", "order_number", "item_sk"], "left_anti")
    other = c("channel") != "store"
    part = lambda cond, x, name: F.sum(F.when(cond, c(x))).alias(name)
    out = (kept.groupBy(c("year").cast("long").alias("year"), "item_sk", "customer_sk").agg(
        part(~other, "quantity", "store_qty"), part(~other, "wholesale_cost", "store_wholesale_cost"),
        part(~other, "sales_price", "store_sales_price"), part(other, "quantity", "other_qty"),
        part(other, "wholesale_cost", "other_wholesale_cost"), part(other, "sales_price", "other_sales_price"))
        .where(c("store_qty").isNotNull() & (c("other_qty") > 0)))
    exact = c("store_qty").cast("decimal(18,0)") / c("other_qty").cast("decimal(18,0)")
    money = ["store_wholesale_cost", "store_sales_price", "other_wholesale_cost", "other_sales_price"]
    out = out.withColumn("ratio", F.round(exact, 2).cast("double")).select(
        "year", "item_sk", "customer_sk", "ratio", "store_qty", "other_qty", *[c(x).cast("double").alias(x) for x in money])
    return top(out, "year", "item_sk", "customer_sk", "ratio")


# ---- customers and pairs seen in several channels --------------------------------------------


def _person_months(m):
    """(last name, first name, month) with one flag per channel: one shuffle for all of them."""
    names = m.customer.select("customer_sk", "last_name", "first_name")
    active = m.sold_in(c("month_seq").between(36, 59)).groupBy("customer_sk", "sold_month").agg(
        *[F.max(c("channel") == ch).alias(ch) for ch in CHANNELS])
    return active.join(names, "customer_sk").groupBy("last_name", "first_name", "sold_month").agg(
        *[F.max(ch).alias(ch) for ch in CHANNELS])


_NAMES_SQL = "(SELECT DISTINCT last_name, first_name, mseq FROM sales JOIN cust USING (customer_sk) WHERE mseq BETWEEN 36 AND 59 AND channel = '{}')"


@tpcds("tpcds_040_customers_in_all_channels", "SELECT count(*) num_cust FROM ("
       + " INTERSECT ".join(_NAMES_SQL.format(ch) for ch in CHANNELS) + ")")
def customers_in_all(m):
    return _person_months(m).where(c("store") & c("catalog") & c("web")).agg(F.count("*").alias("num_cust"))


@tpcds("tpcds_090_store_only_customers", "SELECT count(*) num_cust FROM ("
       + " EXCEPT ".join(_NAMES_SQL.format(ch) for ch in CHANNELS) + ")")
def store_only_customers(m):
    return _person_months(m).where(c("store") & ~c("catalog") & ~c("web")).agg(F.count("*").alias("num_cust"))


@tpcds("tpcds_100_pairs_by_channel", """
, s AS (SELECT customer_sk, item_sk FROM sales WHERE channel = 'store' AND mseq BETWEEN 24 AND 59 GROUP BY ALL),
k AS (SELECT customer_sk, item_sk FROM sales WHERE channel = 'catalog' AND mseq BETWEEN 24 AND 59 GROUP BY ALL)
SELECT count(*) FILTER (WHERE k.item_sk IS NULL) store_only, count(*) FILTER (WHERE s.item_sk IS NULL) catalog_only,
  count(*) FILTER (WHERE s.item_sk IS NOT NULL AND k.item_sk IS NOT NULL) store_and_catalog
FROM s FULL JOIN k ON s.customer_sk = k.customer_sk AND s.item_sk = k.item_sk""")
def pairs_by_channel(m):
    pairs = m.sold_in(c("month_seq").between(24, 59), "store", "catalog").groupBy("customer_sk", "item_sk").agg(
        F.max(c("channel") == "store").alias("s"), F.max(c("channel") == "catalog").alias("k"))
    count = lambda cond, name: F.sum(F.when(cond, 1).otherwise(0)).alias(name)
    return pairs.agg(count(c("s") & ~c("k"), "store_only"), count(~c("s") & c("k"), "catalog_only"),
                     count(c("s") & c("k"), "store_and_catalog"))


@tpcds("tpcds_054_cumulative_web_over_store", """
, w AS (SELECT item_sk, sold, sum(sum(sales_price)) OVER (PARTITION BY item_sk ORDER BY sold) cume FROM sales
  WHERE channel = 'web' AND mseq BETWEEN 48 AND 59 GROUP BY item_sk, sold),
s AS (SELECT item_sk, sold, sum(sum(sales_price)) OVER (PARTITION BY item_sk ORDER BY sold) cume FROM sales
  WHERE channel = 'store' AND mseq BETWEEN 48 AND 59 GROUP BY item_sk, sold),
j AS (SELECT coalesce(w.item_sk, s.item_sk) item_sk, coalesce(w.sold, s.sold) d, w.cume web_sales, s.cume store_sales
  FROM w FULL JOIN s ON w.item_sk = s.item_sk AND w.sold = s.sold),
x AS (SELECT *, max(web_sales) OVER l web_cumulative, max(store_sales) OVER l store_cumulative FROM j
  WINDOW l AS (PARTITION BY item_sk ORDER BY d ROWS UNBOUNDED PRECEDING))
SELECT item_sk, strftime(d, '%Y-%m-%d') d_date, web_sales::DOUBLE web_sales, store_sales::DOUBLE store_sales,
  web_cumulative::DOUBLE web_cumulative, store_cumulative::DOUBLE store_cumulative
FROM x WHERE web_cumulative > store_cumulative ORDER BY item_sk, d LIMIT 100""")
def cumulative_web_over_store(m):
    """Per item a line of at most one row per calendar day; both channels in one aggregate."""
    daily = (m.sold_in(c("month_seq").between(48, 59), "web", "store", extra=("d_date",)).groupBy("item_sk", "d_date")
             .agg(_in("web", "sales_price").alias("w"), _in("store", "sales_price").alias("s")))
    line = Window.partitionBy("item_sk").orderBy("d_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = daily.select("item_sk", "d_date", F.when(c("w").isNotNull(), F.sum("w").over(line)).alias("web_sales"),
                       F.when(c("s").isNotNull(), F.sum("s").over(line)).alias("store_sales"))
    run = run.withColumn("web_cumulative", F.max("web_sales").over(line)).withColumn("store_cumulative", F.max("store_sales").over(line))
    out = run.where(c("web_cumulative") > c("store_cumulative")).select(
        "item_sk", c("d_date").cast("string").alias("d_date"),
        *[c(x).cast("double").alias(x) for x in ("web_sales", "store_sales", "web_cumulative", "store_cumulative")])
    return top(out, "item_sk", "d_date")


# ---- items sold in all channels ----------------------------------------------------------------

_CROSS_SQL = """
, x AS (SELECT brand_id, class, category FROM sales JOIN item USING (item_sk) WHERE channel = 'store' AND y BETWEEN 1999 AND 2001
  INTERSECT SELECT brand_id, class, category FROM sales JOIN item USING (item_sk) WHERE channel = 'catalog' AND y BETWEEN 1999 AND 2001
  INTERSECT SELECT brand_id, class, category FROM sales JOIN item USING (item_sk) WHERE channel = 'web' AND y BETWEEN 1999 AND 2001),
ci AS (SELECT item_sk, brand_id, class, category FROM item JOIN x USING (brand_id, class, category)),
av AS (SELECT sum(quantity * list_price)::DOUBLE / count(*) a FROM sales WHERE y BETWEEN 1999 AND 2001)"""


def _cross_items(m):
    keys = ["brand_id", "class", "category"]
    seen = m.sold_in(c("year").between(1999, 2001)).groupBy("item_sk").agg(*[F.max(c("channel") == ch).alias(ch) for ch in CHANNELS])
    items = m.item.select("item_sk", *keys)
    groups = seen.join(items, "item_sk").groupBy(*keys).agg(*[F.max(ch).alias(ch) for ch in CHANNELS])
    everywhere = groups.where(c("store") & c("catalog") & c("web")).select(*keys)
    return items.join(everywhere, keys, "left_semi")


def _average_sale(m):
    return m.sold_in(c("year").between(1999, 2001)).agg(mean(c("quantity") * c("list_price"), "a"))


def _sales_of(m, when, *channels):
    return (m.sold_in(when, *channels).join(_cross_items(m), "item_sk").groupBy("channel", "brand_id", "class", "category")
            .agg(F.sum(c("quantity") * c("list_price")).alias("sales"), F.count("*").alias("number_sales"))
            .where(c("sales").cast("double") > _average_sale(m).scalar()))


@tpcds("tpcds_014_cross_channel_items_rollup", _CROSS_SQL + """
, t AS (SELECT channel, brand_id, class, category, sum(quantity * list_price) sales, count(*) number_sales
  FROM sales JOIN ci USING (item_sk) WHERE y = 2000 AND m = 11 GROUP BY ALL HAVING sum(quantity * list_price)::DOUBLE > (SELECT a FROM av))
SELECT channel, brand_id, class, category, sum(sales)::DOUBLE sales, sum(number_sales)::BIGINT number_sales
FROM t GROUP BY ROLLUP (channel, brand_id, class, category)
ORDER BY channel NULLS FIRST, brand_id NULLS FIRST, class NULLS FIRST, category NULLS FIRST LIMIT 100""")
def cross_channel_items(m):
    fine = _sales_of(m, (c("year") == 2000) & (c("moy") == 11))
    out = fine.rollup("channel", "brand_id", "class", "category").agg(total("sales"), F.sum("number_sales").alias("number_sales"))
    return top(out, "channel", "brand_id", "class", "category")


@tpcds("tpcds_014b_cross_items_this_year_last_year", _CROSS_SQL + """
, t AS (SELECT y, brand_id, class, category, sum(quantity * list_price) sales, count(*) number_sales
  FROM sales JOIN ci USING (item_sk) WHERE channel = 'store' AND (wseq BETWEEN
    floor(date_diff('day', DATE '1995-01-01', DATE '2000-11-06') / 7)::BIGINT AND floor(date_diff('day', DATE '1995-01-01', DATE '2000-11-06') / 7)::BIGINT + 6
    OR wseq BETWEEN floor(date_diff('day', DATE '1995-01-01', DATE '1999-11-06') / 7)::BIGINT AND floor(date_diff('day', DATE '1995-01-01', DATE '1999-11-06') / 7)::BIGINT + 6)
  GROUP BY ALL HAVING sum(quantity * list_price)::DOUBLE > (SELECT a FROM av))
SELECT 'store' AS channel, n.brand_id, n.class, n.category, n.sales::DOUBLE ty_sales, n.number_sales ty_number_sales,
  p.sales::DOUBLE ly_sales, p.number_sales ly_number_sales
FROM t n JOIN t p ON (n.brand_id, n.class, n.category) = (p.brand_id, p.class, p.category)
WHERE n.y = 2000 AND p.y = 1999 ORDER BY n.brand_id, n.class, n.category LIMIT 100""")
def cross_items_years(m):
    def weeks_from(day):
        start = m.date_dim.where(c("d_date") == F.lit(day).cast("date")).select("week_seq")
        return (c("week_seq") >= start.scalar()) & (c("week_seq") <= start.scalar() + 6)

    keys = ["channel", "brand_id", "class", "category"]
    this = _sales_of(m, weeks_from("2000-11-06"), "store").withColumnsRenamed({"sales": "ty_sales", "number_sales": "ty_number_sales"})
    last = _sales_of(m, weeks_from("1999-11-06"), "store").withColumnsRenamed({"sales": "ly_sales", "number_sales": "ly_number_sales"})
    out = this.join(last, keys).select(*keys, c("ty_sales").cast("double").alias("ty_sales"), "ty_number_sales",
                                       c("ly_sales").cast("double").alias("ly_sales"), "ly_number_sales")
    return top(out, *keys)


_BEST_SQL = """
, freq AS (SELECT item_sk FROM (SELECT item_sk, mseq FROM sales WHERE channel = 'store' AND y BETWEEN 1998 AND 2000
  GROUP BY ALL HAVING count(*) > 1) GROUP BY item_sk),
spend AS (SELECT customer_sk, sum(quantity * sales_price) s FROM sales WHERE channel = 'store' GROUP BY ALL),
best AS (SELECT customer_sk FROM spend WHERE s::DOUBLE > 0.5 * (SELECT max(p)::DOUBLE FROM (SELECT sum(quantity * sales_price) p
  FROM sales WHERE channel = 'store' AND y BETWEEN 1998 AND 2000 GROUP BY customer_sk)))"""


def _frequent_items_best_customers(m):
    often = (m.sold_in(c("year").between(1998, 2000), "store").groupBy("item_sk", "sold_month").count()
             .where(c("count") > 1).select("item_sk").distinct())
    spend = m.sold("store").groupBy("customer_sk").agg(F.sum(c("quantity") * c("sales_price")).alias("s"))
    most = (m.sold_in(c("year").between(1998, 2000), "store").groupBy("customer_sk")
            .agg(F.sum(c("quantity") * c("sales_price")).alias("p")).agg(F.max("p").cast("double").alias("most")))
    best = spend.where(c("s").cast("double") > F.lit(0.5) * most.scalar()).select("customer_sk")
    return (m.sold_in((c("year") == 1999) & c("moy").between(2, 7), "catalog", "web")
            .join(often, "item_sk", "left_semi").join(best, "customer_sk", "left_semi"))


@tpcds("tpcds_023_frequent_items_best_customers", _BEST_SQL + """
SELECT sum(quantity * list_price)::DOUBLE total_sales FROM sales WHERE channel IN ('catalog', 'web') AND y = 1999 AND m BETWEEN 2 AND 7
  AND item_sk IN (FROM freq) AND customer_sk IN (FROM best)""")
def frequent_best_total(m):
    return _frequent_items_best_customers(m).agg(total(c("quantity") * c("list_price"), "total_sales"))


@tpcds("tpcds_024_frequent_items_best_customers_by_name", _BEST_SQL + """
SELECT last_name, first_name, channel, sum(quantity * list_price)::DOUBLE sales FROM sales JOIN cust USING (customer_sk)
WHERE channel IN ('catalog', 'web') AND y = 1999 AND m BETWEEN 2 AND 7 AND item_sk IN (FROM freq) AND customer_sk IN (FROM best)
GROUP BY ALL ORDER BY last_name, first_name, sales, channel LIMIT 100""")
def frequent_best_by_name(m):
    names = m.customer.select("customer_sk", "last_name", "first_name")
    out = _frequent_items_best_customers(m).join(names, "customer_sk").groupBy("last_name", "first_name", "channel").agg(
        total(c("quantity") * c("list_price"), "sales"))
    return top(out, "last_name", "first_name", "sales", "channel")


@tpcds("tpcds_061_items_with_similar_revenue", """
, t AS (SELECT item_id, channel, sum(ext_sales_price)::DOUBLE r FROM sales JOIN item USING (item_sk)
  WHERE y = 1999 AND quarter(sold) = 1 GROUP BY ALL),
p AS (SELECT s.item_id, s.r a, k.r b, w.r d FROM t s JOIN t k USING (item_id) JOIN t w USING (item_id)
  WHERE s.channel = 'store' AND k.channel = 'catalog' AND w.channel = 'web')
SELECT item_id, a store_rev, a / ((a + b + d) / 3) * 100 store_dev, b catalog_rev, b / ((a + b + d) / 3) * 100 catalog_dev,
  d web_rev, d / ((a + b + d) / 3) * 100 web_dev, (a + b + d) / 3 average FROM p
WHERE a BETWEEN 0.5 * b AND 1.5 * b AND a BETWEEN 0.5 * d AND 1.5 * d AND b BETWEEN 0.5 * a AND 1.5 * a
  AND b BETWEEN 0.5 * d AND 1.5 * d AND d BETWEEN 0.5 * a AND 1.5 * a AND d BETWEEN 0.5 * b AND 1.5 * b
ORDER BY item_id, store_rev LIMIT 100""")
def similar_revenue(m):
    quarter = m.date_dim.where(c("d_date") == F.lit("1999-02-03").cast("date")).select("quarter_name")
    days = m.date_dim.join(quarter, "quarter_name", "left_semi").select(
        c("date_sk").alias("sold_date_sk"), c("month_seq").alias("sold_month"))
    per = (m.sales.join(F.broadcast(days), ["sold_date_sk", "sold_month"]).join(m.item.select("item_sk", "item_id"), "item_sk")
           .groupBy("item_id").agg(*[_in(ch, "ext_sales_price").cast("double").alias(f"{ch}_rev") for ch in CHANNELS]))
    revs = [f"{ch}_rev" for ch in CHANNELS]
    near = reduce(lambda a, b: a & b, [c(x).between(F.lit(0.5) * c(y), F.lit(1.5) * c(y)) for x in revs for y in revs if x != y])
    average = (c("store_rev") + c("catalog_rev") + c("web_rev")) / 3
    out = per.where(near).select("item_id", *revs, *[(c(r) / average * 100).alias(r.replace("rev", "dev")) for r in revs],
                                 average.alias("average"))
    return top(out, "item_id", "store_rev")


@tpcds("tpcds_086_item_returns_three_channels", """
, t AS (SELECT item_id, channel, sum(return_quantity)::BIGINT q FROM rets JOIN item USING (item_sk)
  WHERE (y = 1998 AND quarter(returned) = 3) OR (y = 1999 AND quarter(returned) IN (1, 4)) GROUP BY ALL)
SELECT s.item_id, s.q store_qty, s.q::DOUBLE / (s.q + k.q + w.q) / 3.0 * 100 store_dev, k.q catalog_qty,
  k.q::DOUBLE / (s.q + k.q + w.q) / 3.0 * 100 catalog_dev, w.q web_qty, w.q::DOUBLE / (s.q + k.q + w.q) / 3.0 * 100 web_dev,
  (s.q + k.q + w.q)::DOUBLE / 3.0 average
FROM t s JOIN t k USING (item_id) JOIN t w USING (item_id)
WHERE s.channel = 'store' AND k.channel = 'catalog' AND w.channel = 'web' ORDER BY item_id, store_qty LIMIT 100""")
def item_returns(m):
    picked = m.date_dim.where(c("d_date").isin(*[F.lit(d).cast("date") for d in ("1998-09-27", "1999-03-30", "1999-11-17")]))
    days = m.date_dim.join(picked.select("quarter_name"), "quarter_name", "left_semi").select(
        c("date_sk").alias("returned_date_sk"), c("month_seq").alias("returned_month"))
    per = (m.returns.join(F.broadcast(days), ["returned_date_sk", "returned_month"]).join(m.item.select("item_sk", "item_id"), "item_sk")
           .groupBy("item_id").agg(*[_in(ch, "return_quantity").alias(f"{ch}_qty") for ch in CHANNELS]))
    sum3 = c("store_qty") + c("catalog_qty") + c("web_qty")
    out = per.where(sum3.isNotNull()).select(
        "item_id", *[f"{ch}_qty" for ch in CHANNELS],
        *[(c(f"{ch}_qty").cast("double") / sum3 / 3.0 * 100).alias(f"{ch}_dev") for ch in CHANNELS],
        (sum3.cast("double") / 3.0).alias("average"))
    return top(out, "item_id", "store_qty")


# ---- warehouse months ---------------------------------------------------------------------------

_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH_SQL = ", ".join(
    f"(sum(v) FILTER (WHERE m = {i}))::DOUBLE {n}_sales, (sum(v) FILTER (WHERE m = {i}))::DOUBLE / sq_ft {n}_sales_per_sq_foot, "
    f"(sum(net) FILTER (WHERE m = {i}))::DOUBLE {n}_net" for i, n in enumerate(_MONTHS, 1))


@tpcds("tpcds_069_warehouse_months", """
, b AS (SELECT warehouse_sk, m, CASE channel WHEN 'web' THEN ext_sales_price ELSE sales_price END * quantity v,
    CASE channel WHEN 'web' THEN net_paid ELSE net_paid + ext_tax END * quantity net
  FROM sales JOIN ship_mode USING (ship_mode_sk) WHERE channel IN ('web', 'catalog') AND y = 1999
    AND minute_of_day BETWEEN 500 AND 1000 AND carrier IN ('DHL', 'BARIAN'))
SELECT warehouse_name, sq_ft, city, county, state, country, concat('DHL', ',', 'BARIAN') ship_carriers, 1999::BIGINT AS year,
  """ + _MONTH_SQL + """ FROM b JOIN wh USING (warehouse_sk)
GROUP BY warehouse_name, sq_ft, city, county, state, country ORDER BY warehouse_name LIMIT 100""")
def warehouse_months(m):
    web = c("channel") == "web"
    value = F.when(web, c("ext_sales_price")).otherwise(c("sales_price")) * c("quantity")
    net = F.when(web, c("net_paid")).otherwise((c("net_paid") + c("ext_tax")).cast("decimal(18,2)")) * c("quantity")
    modes = m.ship_mode.where(c("carrier").isin("DHL", "BARIAN")).select("ship_mode_sk")
    sold = m.sold_in(c("year") == 1999, "web", "catalog", extra=("moy",)).where(c("sold_time_sk").between(500, 1000)).join(modes, "ship_mode_sk")
    per = sold.groupBy("warehouse_sk", "moy").agg(F.sum(value).alias("v"), F.sum(net).alias("net"))
    place = ["warehouse_name", "sq_ft", "city", "county", "state", "country"]
    of = lambda i, x: F.sum(F.when(c("moy") == i, c(x))).cast("double")
    out = per.join(m.warehouse, "warehouse_sk").groupBy(*place).agg(
        *[of(i, "v").alias(f"{n}_sales") for i, n in enumerate(_MONTHS, 1)],
        *[of(i, "net").alias(f"{n}_net") for i, n in enumerate(_MONTHS, 1)])
    out = out.select(*place, F.concat(F.lit("DHL"), F.lit(","), F.lit("BARIAN")).alias("ship_carriers"),
                     F.lit(1999).cast("long").alias("year"), *[f"{n}_sales" for n in _MONTHS],
                     *[(c(f"{n}_sales") / c("sq_ft")).alias(f"{n}_sales_per_sq_foot") for n in _MONTHS], *[f"{n}_net" for n in _MONTHS])
    return top(out, "warehouse_name")
