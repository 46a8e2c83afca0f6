"""Reports on one channel: star joins, demographic averages, shares and deviations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import c, mean, top, total, tpcds, with_group

# ---- revenue by brand, category, manager -------------------------------------------------


def _revenue(m, when, item_filter, *keys):
    items = m.item.where(item_filter).select("item_sk", *[k for k in keys if k != "year"])
    return m.sold_in(when, "store", extra=("year",)).join(items, "item_sk").groupBy(*keys).agg(
        total("ext_sales_price", "revenue"))


@tpcds("tpcds_003_brand_revenue_by_year", """
SELECT y AS year, brand_id, brand, sum(ext_sales_price)::DOUBLE revenue
FROM sales JOIN item USING (item_sk) WHERE channel = 'store' AND m = 11 AND manufact_id = 12
GROUP BY y, brand_id, brand ORDER BY year, revenue DESC, brand_id LIMIT 100""")
def brand_by_year(m):
    out = _revenue(m, c("moy") == 11, c("manufact_id") == 12, "year", "brand_id", "brand")
    return top(out.withColumn("year", c("year").cast("long")), "year", "-revenue", "brand_id")


@tpcds("tpcds_045_category_revenue", """
SELECT y AS year, category, sum(ext_sales_price)::DOUBLE revenue
FROM sales JOIN item USING (item_sk) WHERE channel = 'store' AND m = 11 AND y = 1998 AND manager_id < 10
GROUP BY y, category ORDER BY revenue DESC, category LIMIT 100""")
def category_revenue(m):
    when = (c("moy") == 11) & (c("year") == 1998)
    out = _revenue(m, when, c("manager_id") < 10, "year", "category")
    return top(out.withColumn("year", c("year").cast("long")), "-revenue", "category")


@tpcds("tpcds_055_brand_revenue_month", """
SELECT y AS year, brand_id, brand, sum(ext_sales_price)::DOUBLE revenue
FROM sales JOIN item USING (item_sk) WHERE channel = 'store' AND m = 12 AND y = 1999 AND manager_id = 1
GROUP BY y, brand_id, brand ORDER BY revenue DESC, brand_id LIMIT 100""")
def brand_month(m):
    when = (c("moy") == 12) & (c("year") == 1999)
    out = _revenue(m, when, c("manager_id") == 1, "year", "brand_id", "brand")
    return top(out.withColumn("year", c("year").cast("long")), "-revenue", "brand_id")


@tpcds("tpcds_058_brand_revenue_manager", """
SELECT brand_id, brand, sum(ext_sales_price)::DOUBLE revenue
FROM sales JOIN item USING (item_sk) WHERE channel = 'store' AND m = 11 AND y = 1999 AND manager_id = 28
GROUP BY brand_id, brand ORDER BY revenue DESC, brand_id LIMIT 100""")
def brand_manager(m):
    when = (c("moy") == 11) & (c("year") == 1999)
    return top(_revenue(m, when, c("manager_id") == 28, "brand_id", "brand"), "-revenue", "brand_id")


@tpcds("tpcds_019_brand_revenue_other_zip", """
SELECT brand_id, brand, manufact_id, manufact, sum(ext_sales_price)::DOUBLE revenue
FROM sales s JOIN item USING (item_sk) JOIN cust USING (customer_sk) JOIN addr a ON a.addr_sk = current_addr_sk
JOIN store ON store_sk = s.site_sk
WHERE s.channel = 'store' AND s.m = 11 AND s.y = 1999 AND manager_id = 8 AND left(a.zip, 5) <> left(store.zip, 5)
GROUP BY ALL ORDER BY revenue DESC, brand_id, manufact_id LIMIT 100""")
def brand_other_zip(m):
    sold = m.sold_in((c("moy") == 11) & (c("year") == 1999), "store").join(m.item.where(c("manager_id") == 8), "item_sk")
    home = m.customer.select("customer_sk", c("current_addr_sk").alias("home_sk"))
    homes = m.customer_address.select(c("addr_sk").alias("home_sk"), c("zip").alias("home_zip"))
    shops = m.store.select(c("store_sk").alias("site_sk"), c("zip").alias("shop_zip"))
    out = (sold.join(home, "customer_sk").join(homes, "home_sk").join(shops, "site_sk")
           .where(F.substring("home_zip", 1, 5) != F.substring("shop_zip", 1, 5))
           .groupBy("brand_id", "brand", "manufact_id", "manufact").agg(total("ext_sales_price", "revenue")))
    return top(out, "-revenue", "brand_id", "manufact_id")


# ---- averages for one demographic group ---------------------------------------------------

_AVG = ("quantity", "list_price", "coupon_amt", "sales_price")
_AVG_SQL = ", ".join(f"sum({x})::DOUBLE / count({x}) AS avg_{x}" for x in _AVG)


def _demographic(m, channel, year, gender, marital, education):
    people = m.customer_demographics.where(
        (c("gender") == gender) & (c("marital_status") == marital) & (c("education_status") == education))
    return m.sold_in(c("year") == year, channel).join(people.select("cdemo_sk"), "cdemo_sk")


def _demographic_by_item(m, channel):
    offers = m.promotion.where((c("email") == "N") | (c("event") == "N")).select("promo_sk")
    out = (_demographic(m, channel, 1998, "M", "S", "College").join(offers, "promo_sk")
           .join(m.item.select("item_sk", "item_id"), "item_sk")
           .groupBy("item_id").agg(*[mean(x, f"avg_{x}") for x in _AVG]))
    return top(out, "item_id")


_DEMO_SQL = """
SELECT item_id, """ + _AVG_SQL + """ FROM sales JOIN cdemo USING (cdemo_sk) JOIN promo USING (promo_sk) JOIN item USING (item_sk)
WHERE channel = '{}' AND y = 1998 AND gender = 'M' AND marital_status = 'S' AND education_status = 'College'
  AND (email = 'N' OR event = 'N') GROUP BY item_id ORDER BY item_id LIMIT 100"""


@tpcds("tpcds_007_store_demographic_averages", _DEMO_SQL.format("store"))
def store_demographic(m):
    return _demographic_by_item(m, "store")


@tpcds("tpcds_028_catalog_demographic_averages", _DEMO_SQL.format("catalog"))
def catalog_demographic(m):
    return _demographic_by_item(m, "catalog")


@tpcds("tpcds_029_item_state_rollup", """
SELECT item_id, store.state, grouping(store.state)::BIGINT g_state, """ + _AVG_SQL + """
FROM sales s JOIN cdemo USING (cdemo_sk) JOIN item USING (item_sk) JOIN store ON store_sk = s.site_sk
WHERE channel = 'store' AND s.y BETWEEN 1997 AND 1999 AND gender = 'M' AND marital_status = 'S' AND education_status = 'College'
  AND store.state IN ('NATION_0', 'NATION_1', 'NATION_2', 'NATION_3', 'NATION_4', 'NATION_15', 'NATION_16', 'NATION_20')
GROUP BY ROLLUP (item_id, store.state) ORDER BY item_id NULLS FIRST, store.state NULLS FIRST LIMIT 100""")
def item_state_rollup(m):
    people = m.customer_demographics.where((c("gender") == "M") & (c("marital_status") == "S")
                                           & (c("education_status") == "College")).select("cdemo_sk")
    shops = m.store.where(c("state").isin(*[f"NATION_{n}" for n in (0, 1, 2, 3, 4, 15, 16, 20)])).select(
        c("store_sk").alias("site_sk"), "state")
    fine = (m.sold_in(c("year").between(1997, 1999), "store").join(people, "cdemo_sk").join(shops, "site_sk")
            .join(m.item.select("item_sk", "item_id"), "item_sk").groupBy("item_id", "state")
            .agg(F.count("quantity").alias("n"), *[F.sum(x).alias(x) for x in _AVG]))
    out = fine.rollup("item_id", "state").agg(
        F.grouping("state").cast("long").alias("g_state"),
        *[(F.sum(x).cast("double") / F.sum("n")).alias(f"avg_{x}") for x in _AVG])
    return top(out, "item_id", "state")


@tpcds("tpcds_018_catalog_place_rollup", """
, base AS (
  SELECT country, state, county, item_id, quantity::DECIMAL(12,2) q, list_price::DECIMAL(12,2) lp, coupon_amt::DECIMAL(12,2) cp,
    sales_price::DECIMAL(12,2) sp, net_profit::DECIMAL(12,2) np, birth_year::DECIMAL(12,2) b, d1.dep_count::DECIMAL(12,2) dc
  FROM sales s JOIN cdemo d1 USING (cdemo_sk) JOIN cust USING (customer_sk) JOIN cdemo d2 ON d2.cdemo_sk = current_cdemo_sk
  JOIN addr a ON a.addr_sk = current_addr_sk JOIN item USING (item_sk)
  WHERE channel = 'catalog' AND s.y = 1998 AND d1.gender = 'F' AND d1.education_status = 'Unknown'
    AND birth_month IN (1, 2, 6, 8, 9, 12))
SELECT item_id, country, state, county, sum(q)::DOUBLE / count(q) avg_quantity, sum(lp)::DOUBLE / count(lp) avg_list_price,
  sum(cp)::DOUBLE / count(cp) avg_coupon, sum(sp)::DOUBLE / count(sp) avg_sales_price,
  sum(np)::DOUBLE / count(np) avg_profit, sum(b)::DOUBLE / count(b) avg_birth_year, sum(dc)::DOUBLE / count(dc) avg_dep_count
FROM base GROUP BY ROLLUP (country, state, county, item_id)
ORDER BY country NULLS FIRST, state NULLS FIRST, county NULLS FIRST, item_id NULLS FIRST LIMIT 100""")
def catalog_place_rollup(m):
    people = m.customer_demographics.where((c("gender") == "F") & (c("education_status") == "Unknown")).select(
        "cdemo_sk", "dep_count")
    buyers = m.customer.where(c("birth_month").isin(1, 2, 6, 8, 9, 12)).select(
        "customer_sk", "birth_year", c("current_addr_sk").alias("home_sk"), c("current_cdemo_sk").alias("now_sk"))
    homes = m.customer_address.select(c("addr_sk").alias("home_sk"), "country", "state", "county")
    now = m.customer_demographics.select(c("cdemo_sk").alias("now_sk"))
    measures = {"avg_quantity": "quantity", "avg_list_price": "list_price", "avg_coupon": "coupon_amt",
                "avg_sales_price": "sales_price", "avg_profit": "net_profit", "avg_birth_year": "birth_year",
                "avg_dep_count": "dep_count"}
    fine = (m.sold_in(c("year") == 1998, "catalog").join(people, "cdemo_sk").join(buyers, "customer_sk")
            .join(now, "now_sk").join(homes, "home_sk").join(m.item.select("item_sk", "item_id"), "item_sk")
            .groupBy("country", "state", "county", "item_id")
            .agg(F.count("*").alias("n"), *[F.sum(c(x).cast("decimal(12,2)")).alias(x) for x in measures.values()]))
    out = fine.rollup("country", "state", "county", "item_id").agg(
        *[(F.sum(x).cast("double") / F.sum("n")).alias(a) for a, x in measures.items()])
    return top(out, "country", "state", "county", "item_id")


# ---- share of the class -------------------------------------------------------------------


def _class_share(m, channel, first, last):
    items = m.item.where(c("category").isin("SMALL", "PROMO", "LARGE")).select(
        "item_sk", "item_id", "item_desc", "category", "class", "current_price")
    per_item = (m.sold_in(c("d_date").between(first, last), channel).join(items, "item_sk")
                .groupBy("item_id", "item_desc", "category", "class", "current_price")
                .agg(F.sum("ext_sales_price").alias("revenue")))
    shared = with_group(per_item, ["class"], F.sum("revenue").alias("class_revenue"))
    out = shared.select(
        "item_id", "item_desc", "category", "class", c("current_price").cast("double").alias("current_price"),
        c("revenue").cast("double").alias("revenue"),
        (c("revenue").cast("double") * 100 / c("class_revenue").cast("double")).alias("revenue_share"))
    return top(out, "category", "class", "item_id", "item_desc", "revenue_share")


_SHARE_SQL = """
, t AS (SELECT item_id, item_desc, category, class, current_price, sum(ext_sales_price) revenue
  FROM sales JOIN item USING (item_sk) WHERE channel = '{}' AND category IN ('SMALL', 'PROMO', 'LARGE')
    AND sold BETWEEN DATE '{}' AND DATE '{}' GROUP BY ALL)
SELECT item_id, item_desc, category, class, current_price::DOUBLE current_price, revenue::DOUBLE revenue,
  revenue::DOUBLE * 100 / (sum(revenue) OVER (PARTITION BY class))::DOUBLE revenue_share
FROM t ORDER BY category, class, item_id, item_desc, revenue_share LIMIT 100"""


@tpcds("tpcds_012_web_class_share", _SHARE_SQL.format("web", "1999-02-22", "1999-03-24"))
def web_share(m):
    return _class_share(m, "web", "1999-02-22", "1999-03-24")


@tpcds("tpcds_020_catalog_class_share", _SHARE_SQL.format("catalog", "1999-02-22", "1999-03-24"))
def catalog_share(m):
    return _class_share(m, "catalog", "1999-02-22", "1999-03-24")


@tpcds("tpcds_101_store_class_share", _SHARE_SQL.format("store", "1999-02-22", "1999-03-24"))
def store_share(m):
    return _class_share(m, "store", "1999-02-22", "1999-03-24")


# ---- period sums against the average of their group ---------------------------------------


def _deviation(frame, keys, sums, average):
    """Rows whose sum is more than 10% off the average of their group."""
    shared = with_group(frame, keys, (F.sum(sums).cast("double") / F.count(sums)).alias(average))
    value = c(sums).cast("double")
    off = F.when(c(average) > 0, F.abs(value - c(average)) / c(average))
    return shared.where(off > 0.1).withColumn(sums, value)


def _brand_or(m):
    return m.item.where((c("category").isin("SMALL", "LARGE") & c("class").isin("red", "blue"))
                        | (c("category").isin("PROMO", "ECONOMY") & c("class").isin("hot", "cold")))


_BRAND_OR = """((category IN ('SMALL', 'LARGE') AND class IN ('red', 'blue'))
    OR (category IN ('PROMO', 'ECONOMY') AND class IN ('hot', 'cold')))"""


def _quarterly(m, key, period, year_filter):
    sold = m.sold_in(year_filter, "store", extra=(period,)).join(m.store.select(c("store_sk").alias("site_sk")), "site_sk")
    sums = (sold.join(_brand_or(m).select("item_sk", key), "item_sk").groupBy(key, period)
            .agg(F.sum("sales_price").alias("sum_sales")))
    out = _deviation(sums, [key], "sum_sales", "avg_sales")
    return top(out.withColumn(period, c(period).cast("long")), "avg_sales", "sum_sales", key, period)


_PERIOD_SQL = """
, t AS (SELECT {0}, {1} AS {2}, sum(sales_price)::DOUBLE sum_sales FROM sales JOIN item USING (item_sk)
  JOIN store ON store_sk = site_sk WHERE channel = 'store' AND mseq BETWEEN 48 AND 59 AND """ + _BRAND_OR + """ GROUP BY 1, 2),
a AS (SELECT {0}, sum(sum_sales::DECIMAL(28,2))::DOUBLE / count(*) avg_sales FROM t GROUP BY {0})
SELECT {0}, {2}, sum_sales, avg_sales FROM t JOIN a USING ({0})
WHERE abs(sum_sales - avg_sales) / avg_sales > 0.1 ORDER BY avg_sales, sum_sales, {0}, {2} LIMIT 100"""


@tpcds("tpcds_056_manufacturer_quarter_deviation",
       _PERIOD_SQL.format("manufact_id", "quarter(sold)", "qoy"))
def manufacturer_quarter(m):
    return _quarterly(m, "manufact_id", "qoy", c("month_seq").between(48, 59))


@tpcds("tpcds_066_manager_month_deviation", _PERIOD_SQL.format("manager_id", "m", "moy"))
def manager_month(m):
    return _quarterly(m, "manager_id", "moy", c("month_seq").between(48, 59))


@tpcds("tpcds_092_class_month_deviation", """
, t AS (SELECT category, class, brand, store_name, company_name, m AS moy, sum(sales_price) s
  FROM sales JOIN item USING (item_sk) JOIN store ON store_sk = site_sk
  WHERE channel = 'store' AND y = 1999 AND """ + _BRAND_OR + """ GROUP BY ALL),
a AS (SELECT category, brand, store_name, company_name, sum(s)::DOUBLE / count(*) avg_monthly_sales FROM t GROUP BY ALL)
SELECT category, class, brand, store_name, company_name, moy, s::DOUBLE sum_sales, avg_monthly_sales
FROM t JOIN a USING (category, brand, store_name, company_name)
WHERE abs(s::DOUBLE - avg_monthly_sales) / avg_monthly_sales > 0.1
ORDER BY s::DOUBLE - avg_monthly_sales, store_name, category, class, brand, company_name, moy LIMIT 100""")
def class_month(m):
    shops = m.store.select(c("store_sk").alias("site_sk"), "store_name", "company_name")
    sums = (m.sold_in(c("year") == 1999, "store", extra=("moy",)).join(shops, "site_sk")
            .join(_brand_or(m).select("item_sk", "category", "class", "brand"), "item_sk")
            .groupBy("category", "class", "brand", "store_name", "company_name", c("moy").cast("long").alias("moy"))
            .agg(F.sum("sales_price").alias("sum_sales")))
    out = _deviation(sums, ["category", "brand", "store_name", "company_name"], "sum_sales", "avg_monthly_sales")
    return (out.orderBy(c("sum_sales") - c("avg_monthly_sales"), "store_name", "category", "class", "brand",
                        "company_name", "moy").limit(100))


def _neighbours(m, sold, keys):
    """Months far off their yearly average, with the month before and after (q47, q57).

    One window over the months of a (category, brand, place) group replaces two joins on
    rank +- 1; the group holds one row per calendar month, however large the facts are.
    """
    from pyspark.sql import Window

    monthly = sold.groupBy(*keys, "year", "moy").agg(F.sum("sales_price").alias("sum_sales"))
    line = Window.partitionBy(*keys).orderBy("year", "moy")
    around = monthly.withColumn("psum", F.lag("sum_sales").over(line)).withColumn("nsum", F.lead("sum_sales").over(line))
    yearly = with_group(around, [*keys, "year"], (F.sum("sum_sales").cast("double") / F.count("*")).alias("avg_monthly_sales"))
    value = c("sum_sales").cast("double")
    kept = yearly.where((c("year") == 1999) & (c("avg_monthly_sales") > 0) & c("psum").isNotNull() & c("nsum").isNotNull()
                        & (F.abs(value - c("avg_monthly_sales")) / c("avg_monthly_sales") > 0.1))
    out = kept.select(*keys, c("year").cast("long").alias("year"), c("moy").cast("long").alias("moy"), "avg_monthly_sales",
                      value.alias("sum_sales"), c("psum").cast("double").alias("psum"), c("nsum").cast("double").alias("nsum"))
    return out.orderBy(c("sum_sales") - c("avg_monthly_sales"), *keys, "moy").limit(100)


_NEIGHBOUR_SQL = """
, t AS (SELECT {0}, y AS year, m AS moy, sum(sales_price) s FROM sales JOIN item USING (item_sk) {1}
  WHERE channel = '{2}' AND mseq BETWEEN 47 AND 60 GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY {0} ORDER BY year, moy) rn FROM t),
a AS (SELECT {0}, year, sum(s)::DOUBLE / count(*) avg_monthly_sales FROM t GROUP BY ALL)
SELECT {3}, r.year, r.moy, avg_monthly_sales, r.s::DOUBLE sum_sales, p.s::DOUBLE psum, n.s::DOUBLE nsum
FROM r JOIN a USING ({0}, year) JOIN r p ON {4} AND p.rn = r.rn - 1 JOIN r n ON {5} AND n.rn = r.rn + 1
WHERE r.year = 1999 AND abs(r.s::DOUBLE - avg_monthly_sales) / avg_monthly_sales > 0.1
ORDER BY r.s::DOUBLE - avg_monthly_sales, {3}, r.moy LIMIT 100"""


def _neighbour_sql(keys, join, channel):
    same = lambda t: " AND ".join(f"{t}.{k} = r.{k}" for k in keys)
    return _NEIGHBOUR_SQL.format(", ".join(keys), join, channel, ", ".join(f"r.{k}" for k in keys), same("p"), same("n"))


_SHOP_KEYS = ["category", "brand", "store_name", "company_name"]


@tpcds("tpcds_050_store_month_neighbours", _neighbour_sql(_SHOP_KEYS, "JOIN store ON store_sk = site_sk", "store"))
def store_neighbours(m):
    shops = m.store.select(c("store_sk").alias("site_sk"), "store_name", "company_name")
    sold = (m.sold_in(c("month_seq").between(47, 60), "store", extra=("year", "moy")).join(shops, "site_sk")
            .join(m.item.select("item_sk", "category", "brand"), "item_sk"))
    return _neighbours(m, sold, _SHOP_KEYS)


@tpcds("tpcds_060_call_center_month_neighbours",
       _neighbour_sql(["category", "brand", "name"], "JOIN (SELECT k, 'center ' || k AS name FROM range(6) g(k)) ON k = site_sk", "catalog"))
def call_center_neighbours(m):
    centers = m.call_center.select(c("call_center_sk").alias("site_sk"), "name")
    sold = (m.sold_in(c("month_seq").between(47, 60), "catalog", extra=("year", "moy")).join(centers, "site_sk")
            .join(m.item.select("item_sk", "category", "brand"), "item_sk"))
    return _neighbours(m, sold, ["category", "brand", "name"])


# ---- weekday, latency and half-hour buckets ------------------------------------------------

_DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
_DAY_SQL = ", ".join(f"(sum(sales_price) FILTER (WHERE dayname(sold) = '{d}'))::DOUBLE AS {d[:3].lower()}_sales" for d in _DAYS)


def weekday_sums(value):
    return [F.sum(F.when(c("day_name") == d, c(value))).cast("double").alias(f"{d[:3].lower()}_sales") for d in _DAYS]


@tpcds("tpcds_046_store_weekdays", """
SELECT store_name, store_id, """ + _DAY_SQL + """ FROM sales s JOIN store ON store_sk = site_sk
WHERE channel = 'store' AND s.y = 1998 AND gmt_offset = -5 GROUP BY ALL ORDER BY store_name, store_id LIMIT 100""")
def store_weekdays(m):
    shops = m.store.where(c("gmt_offset") == -5).select(c("store_sk").alias("site_sk"), "store_name", "store_id")
    out = (m.sold_in(c("year") == 1998, "store", extra=("day_name",)).join(shops, "site_sk")
           .groupBy("store_name", "store_id").agg(*weekday_sums("sales_price")))
    return top(out, "store_name", "store_id")


_LATENCY = {"days_30": (None, 30), "days_31_60": (30, 60), "days_61_90": (60, 90), "days_91_120": (90, 120),
            "days_over_120": (120, None)}


def _latency(days):
    out = []
    for name, (low, high) in _LATENCY.items():
        inside = F.lit(True)
        if low is not None:
            inside = inside & (days > low)
        if high is not None:
            inside = inside & (days <= high)
        out.append(F.sum(F.when(inside, 1).otherwise(0)).alias(name))
    return out


def _latency_sql(days):
    return f"""count(*) FILTER (WHERE {days} <= 30) days_30, count(*) FILTER (WHERE {days} > 30 AND {days} <= 60) days_31_60,
  count(*) FILTER (WHERE {days} > 60 AND {days} <= 90) days_61_90, count(*) FILTER (WHERE {days} > 90 AND {days} <= 120) days_91_120,
  count(*) FILTER (WHERE {days} > 120) days_over_120"""


@tpcds("tpcds_053_return_latency", """
SELECT store_name, store_id, street.county, """ + _latency_sql("(r.returned - s.sold)") + """
FROM sales s JOIN rets r ON s.order_number = r.order_number AND s.item_sk = r.item_sk AND s.customer_sk = r.customer_sk
JOIN store street ON street.store_sk = s.site_sk
WHERE s.channel = 'store' AND r.channel = 'store' AND r.y = 1999 AND r.m = 8
GROUP BY ALL ORDER BY store_name, store_id, county LIMIT 100""")
def return_latency(m):
    back = m.returned_in((c("year") == 1999) & (c("moy") == 8), "store").select(
        "order_number", "item_sk", "customer_sk", "returned_date_sk")
    shops = m.store.select(c("store_sk").alias("site_sk"), "store_name", "store_id", "county")
    out = (m.sold("store").join(back, ["order_number", "item_sk", "customer_sk"]).join(shops, "site_sk")
           .groupBy("store_name", "store_id", "county").agg(*_latency(c("returned_date_sk") - c("sold_date_sk"))))
    return top(out, "store_name", "store_id", "county")


def _ship_latency(m, channel, sites):
    out = (m.sold_in(c("month_seq").between(48, 59), channel).join(m.warehouse, "warehouse_sk").join(m.ship_mode, "ship_mode_sk")
           .join(sites, "site_sk").groupBy(F.substring("warehouse_name", 1, 20).alias("warehouse_name"), "type", "name")
           .agg(*_latency(c("ship_date_sk") - c("sold_date_sk"))))
    return top(out, "warehouse_name", "type", "name")


_SHIP_SQL = """
SELECT left(warehouse_name, 20) warehouse_name, type, '{}' || site_sk AS name, """ + _latency_sql("(shipped - sold)") + """
FROM sales JOIN wh USING (warehouse_sk) JOIN ship_mode USING (ship_mode_sk)
WHERE channel = '{}' AND mseq BETWEEN 48 AND 59 GROUP BY ALL ORDER BY warehouse_name, type, name LIMIT 100"""


@tpcds("tpcds_065_web_ship_latency", _SHIP_SQL.format("site ", "web"))
def web_ship_latency(m):
    return _ship_latency(m, "web", m.web_site.select(c("web_site_sk").alias("site_sk"), "name"))


@tpcds("tpcds_102_catalog_ship_latency", _SHIP_SQL.format("center ", "catalog"))
def catalog_ship_latency(m):
    return _ship_latency(m, "catalog", m.call_center.select(c("call_center_sk").alias("site_sk"), "name"))


# ---- rows against the average of their group (correlated scalar subqueries) ---------------


def _over_group_average(frame, group, value, factor):
    kept = with_group(frame, [group], (F.sum(value).cast("double") / F.count(value)).alias("group_avg"))
    return kept.where(c(value).cast("double") > c("group_avg") * factor)


@tpcds("tpcds_001_store_return_outliers", """
, t AS (SELECT customer_sk, site_sk, sum(return_amt) amt FROM rets WHERE channel = 'store' AND y = 1999 GROUP BY ALL)
SELECT customer_id FROM t JOIN store ON store_sk = site_sk JOIN cust USING (customer_sk)
WHERE state IN ('NATION_15', 'NATION_16', 'NATION_20')
  AND amt::DOUBLE > (SELECT sum(amt)::DOUBLE / count(amt) FROM t t2 WHERE t2.site_sk = t.site_sk) * 1.2
ORDER BY customer_id LIMIT 100""")
def store_return_outliers(m):
    shops = m.store.where(c("state").isin("NATION_15", "NATION_16", "NATION_20")).select(c("store_sk").alias("site_sk"))
    per = m.returned_in(c("year") == 1999, "store").join(shops, "site_sk").groupBy("customer_sk", "site_sk").agg(
        F.sum("return_amt").alias("amt"))
    out = _over_group_average(per, "site_sk", "amt", 1.2).join(m.customer.select("customer_sk", "customer_id"), "customer_sk")
    return top(out.select("customer_id"), "customer_id")


_STATE_RETURN_SQL = """
, t AS (SELECT r.customer_sk, state, sum(return_amt) amt FROM rets r JOIN addr USING (addr_sk)
  WHERE channel = '{0}' AND r.y = 1999 GROUP BY ALL)
SELECT customer_id, salutation, first_name, last_name, {1} amt::DOUBLE total_return
FROM t JOIN cust USING (customer_sk) JOIN addr h ON h.addr_sk = current_addr_sk
WHERE h.state IN ('NATION_2', 'NATION_6', 'NATION_16')
  AND amt::DOUBLE > (SELECT sum(amt)::DOUBLE / count(amt) FROM t t2 WHERE t2.state = t.state) * 1.2
ORDER BY customer_id, total_return LIMIT 100"""


def _state_return_outliers(m, channel, *address):
    per = (m.returned_in(c("year") == 1999, channel).join(m.customer_address.select("addr_sk", "state"), "addr_sk")
           .groupBy("customer_sk", "state").agg(F.sum("return_amt").alias("amt")))
    homes = m.customer_address.where(c("state").isin("NATION_2", "NATION_6", "NATION_16")).select(
        c("addr_sk").alias("current_addr_sk"), *address)
    out = _over_group_average(per, "state", "amt", 1.2).drop("state").join(m.customer, "customer_sk").join(homes, "current_addr_sk")
    return top(out.select("customer_id", "salutation", "first_name", "last_name", *address,
                          c("amt").cast("double").alias("total_return")), "customer_id", "total_return")


@tpcds("tpcds_032_web_return_outliers", _STATE_RETURN_SQL.format("web", ""))
def web_return_outliers(m):
    return _state_return_outliers(m, "web")


@tpcds("tpcds_084_catalog_return_outliers",
       _STATE_RETURN_SQL.format("catalog", "street_name, h.city, h.county, h.zip, h.country, h.gmt_offset, location_type,"))
def catalog_return_outliers(m):
    return _state_return_outliers(m, "catalog", "street_name", "city", "county", "zip", "country", "gmt_offset", "location_type")


_EXCESS_SQL = """
, t AS (SELECT item_sk, ext_discount_amt d FROM sales WHERE channel = '{}' AND sold BETWEEN DATE '1998-01-27' AND DATE '1998-04-27')
SELECT sum(d)::DOUBLE excess_discount FROM t JOIN item USING (item_sk)
WHERE manufact_id BETWEEN 10 AND 20 AND d::DOUBLE > (SELECT sum(d)::DOUBLE / count(d) FROM t t2 WHERE t2.item_sk = t.item_sk) * 1.3"""


def _excess_discount(m, channel):
    when = c("d_date").between("1998-01-27", F.date_add(F.lit("1998-01-27").cast("date"), 90))
    items = m.item.where(c("manufact_id").between(10, 20)).select("item_sk")
    sold = m.sold_in(when, channel).join(items, "item_sk").select("item_sk", "ext_discount_amt")
    return _over_group_average(sold, "item_sk", "ext_discount_amt", 1.3).agg(total("ext_discount_amt", "excess_discount"))


@tpcds("tpcds_034_catalog_excess_discount", _EXCESS_SQL.format("catalog"))
def catalog_excess(m):
    return _excess_discount(m, "catalog")


@tpcds("tpcds_095_web_excess_discount", _EXCESS_SQL.format("web"))
def web_excess(m):
    return _excess_discount(m, "web")


@tpcds("tpcds_006_states_buying_dear_items", """
, dear AS (SELECT item_sk FROM item i WHERE current_price::DOUBLE >
  1.02 * (SELECT sum(current_price)::DOUBLE / count(*) FROM item j WHERE j.category = i.category))
SELECT state, count(*) cnt FROM sales JOIN cust USING (customer_sk) JOIN addr a ON a.addr_sk = current_addr_sk
WHERE channel = 'store' AND mseq = (SELECT DISTINCT mseq FROM sales WHERE y = 1999 AND m = 1) AND item_sk IN (FROM dear)
GROUP BY state HAVING count(*) >= 3 ORDER BY cnt, state LIMIT 100""")
def states_buying_dear(m):
    days = m.date_dim
    month = days.where((c("year") == 1999) & (c("moy") == 1)).select("month_seq").distinct()
    dear = _over_group_average(m.item, "category", "current_price", 1.02).select("item_sk")
    homes = m.customer.select("customer_sk", c("current_addr_sk").alias("home_sk")).join(
        m.customer_address.select(c("addr_sk").alias("home_sk"), "state"), "home_sk")
    out = (m.sold("store").where(c("sold_month") == month.scalar()).join(dear, "item_sk", "left_semi")
           .join(homes, "customer_sk").groupBy("state").agg(F.count("*").alias("cnt")).where(c("cnt") >= 3))
    return top(out, "cnt", "state")


@tpcds("tpcds_068_items_far_below_store_average", """
, t AS (SELECT site_sk, item_sk, sum(sales_price) revenue FROM sales WHERE channel = 'store' AND mseq BETWEEN 48 AND 59 GROUP BY ALL),
a AS (SELECT site_sk, sum(revenue)::DOUBLE / count(*) ave FROM t GROUP BY ALL)
SELECT store_name, item_desc, revenue::DOUBLE revenue, current_price::DOUBLE current_price, item.wholesale_cost::DOUBLE wholesale_cost, brand, item_id
FROM t JOIN a USING (site_sk) JOIN store ON store_sk = site_sk JOIN item USING (item_sk) WHERE revenue::DOUBLE <= 0.1 * ave
ORDER BY store_name, item_desc, revenue, item_id LIMIT 100""")
def items_below_average(m):
    per = (m.sold_in(c("month_seq").between(48, 59), "store").where(c("site_sk").isNotNull())
           .groupBy("site_sk", "item_sk").agg(F.sum("sales_price").alias("revenue")))
    low = with_group(per, ["site_sk"], (F.sum("revenue").cast("double") / F.count("*")).alias("ave")).where(
        c("revenue").cast("double") <= F.lit(0.1) * c("ave"))
    shops = m.store.select(c("store_sk").alias("site_sk"), "store_name")
    out = low.join(shops, "site_sk").join(m.item, "item_sk").select(
        "store_name", "item_desc", c("revenue").cast("double").alias("revenue"), c("current_price").cast("double").alias("current_price"),
        c("wholesale_cost").cast("double").alias("wholesale_cost"), "brand", "item_id")
    return top(out, "store_name", "item_desc", "revenue", "item_id")


# ---- zip and place filters -----------------------------------------------------------------

_ZIPS = ("03701", "07402", "11103", "14804", "29608", "33309", "59216", "74020", "77721")
_ZIP_SQL = ", ".join(f"'{z}'" for z in _ZIPS)


@tpcds("tpcds_015_catalog_sales_by_zip", f"""
SELECT zip, sum(sales_price)::DOUBLE total_sales FROM sales JOIN cust USING (customer_sk) JOIN addr a ON a.addr_sk = current_addr_sk
WHERE channel = 'catalog' AND y = 1998 AND quarter(sold) = 2
  AND (left(zip, 5) IN ({_ZIP_SQL}) OR state IN ('NATION_5', 'NATION_17') OR sales_price > 20000)
GROUP BY zip ORDER BY zip LIMIT 100""")
def catalog_by_zip(m):
    homes = m.customer.select("customer_sk", c("current_addr_sk").alias("home_sk")).join(
        m.customer_address.select(c("addr_sk").alias("home_sk"), "state", "zip"), "home_sk")
    out = (m.sold_in((c("year") == 1998) & (c("qoy") == 2), "catalog").join(homes, "customer_sk")
           .where(F.substring("zip", 1, 5).isin(*_ZIPS) | c("state").isin("NATION_5", "NATION_17") | (c("sales_price") > 20000))
           .groupBy("zip").agg(total("sales_price", "total_sales")))
    return top(out, "zip")


@tpcds("tpcds_048_web_sales_zip_or_item", f"""
SELECT zip, city, sum(sales_price)::DOUBLE total_sales FROM sales JOIN cust USING (customer_sk)
JOIN addr a ON a.addr_sk = current_addr_sk JOIN item USING (item_sk)
WHERE channel = 'web' AND y = 1998 AND quarter(sold) = 2
  AND (left(zip, 5) IN ({_ZIP_SQL}) OR item_id IN (SELECT item_id FROM item WHERE item_sk IN (2, 3, 5, 7, 11, 13, 17, 19, 23, 29)))
GROUP BY ALL ORDER BY zip, city LIMIT 100""")
def web_by_zip_or_item(m):
    chosen = m.item.where(c("item_sk").isin(2, 3, 5, 7, 11, 13, 17, 19, 23, 29)).select("item_id").distinct().withColumn(
        "chosen", F.lit(True))
    items = m.item.select("item_sk", "item_id").join(chosen, "item_id", "left")
    homes = m.customer.select("customer_sk", c("current_addr_sk").alias("home_sk")).join(
        m.customer_address.select(c("addr_sk").alias("home_sk"), "city", "zip"), "home_sk")
    out = (m.sold_in((c("year") == 1998) & (c("qoy") == 2), "web").join(items, "item_sk").join(homes, "customer_sk")
           .where(F.substring("zip", 1, 5).isin(*_ZIPS) | c("chosen").isNotNull())
           .groupBy("zip", "city").agg(total("sales_price", "total_sales")))
    return top(out, "zip", "city")


@tpcds("tpcds_008_store_profit_near_preferred_customers", f"""
, near AS (SELECT left(zip, 5) z FROM addr WHERE left(zip, 5) IN ({_ZIP_SQL}) INTERSECT
  SELECT left(zip, 5) FROM cust JOIN addr ON addr_sk = current_addr_sk WHERE preferred = 'Y' GROUP BY 1 HAVING count(*) > 2)
SELECT store_name, sum(net_profit)::DOUBLE profit FROM sales s JOIN store ON store_sk = site_sk
WHERE channel = 'store' AND s.y = 1998 AND quarter(sold) = 2 AND left(store.zip, 2) IN (SELECT left(z, 2) FROM near)
GROUP BY store_name ORDER BY store_name LIMIT 100""")
def profit_near_preferred(m):
    zips = m.customer_address.select(F.substring("zip", 1, 5).alias("z")).where(c("z").isin(*_ZIPS))
    liked = (m.customer.where(c("preferred") == "Y").join(m.customer_address, c("current_addr_sk") == c("addr_sk"))
             .groupBy(F.substring("zip", 1, 5).alias("z")).count().where(c("count") > 2).select("z"))
    near = zips.intersect(liked).select(F.substring("z", 1, 2).alias("z2")).distinct()
    shops = m.store.withColumn("z2", F.substring("zip", 1, 2)).join(near, "z2", "left_semi").select(
        c("store_sk").alias("site_sk"), "store_name")
    out = (m.sold_in((c("year") == 1998) & (c("qoy") == 2), "store").join(shops, "site_sk")
           .groupBy("store_name").agg(total("net_profit", "profit")))
    return top(out, "store_name")
