"""Star schema built once from the given tables and kept as partitioned Parquet.

Sales of all channels are one fact, partitioned by (channel, sold_month); returns are
partitioned by (channel, returned_month), inventory by month. A query on one channel or
a span of months then reads only those folders, and a query over three channels scans
one table once. The facts carry every foreign key, so no query regroups line items.
"""

from __future__ import annotations

import hashlib
import uuid
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources.tables import cached_read, table

c = F.col
MONEY = "decimal(18,2)"
EPOCH = "1995-01-01"  # day 0 of the date keys
SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# Fixed values of the small dimensions, each picked by position = key modulo length.
EDUCATION = ("Primary", "Secondary", "College", "2 yr Degree", "4 yr Degree", "Advanced Degree", "Unknown")
MARITAL = ("S", "M", "D", "W", "U")
BUY_POTENTIAL = ("0-500", "501-1000", "1001-5000", "5001-10000", ">10000", "Unknown")
SHIP_TYPES = ("EXPRESS", "OVERNIGHT", "REGULAR", "TWO DAY", "LIBRARY")
CARRIERS = ("UPS", "FEDEX", "AIRBORNE", "USPS", "DHL", "TBS", "ZHOU", "LATVIAN", "BARIAN", "GREAT EASTERN")
UNITS = ("Each", "Box", "Case", "Dozen")
SIZES = ("small", "medium", "large", "extra large")
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def pick(values: tuple[str, ...], position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (position + 1).cast("int"))


def cents(amount: Column) -> Column:
    return amount.cast(MONEY)


def unit_price(total: Column, quantity: Column) -> Column:
    """Whole cents per piece, cut off, so that no engine rounds it differently."""
    whole = F.floor(F.try_divide((total * 100).cast("long"), quantity))
    return (whole.cast("decimal(14,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY)


def month_key(day: Column) -> Column:
    return (F.year(day) - 1995) * 12 + F.month(day) - 1


def line_facts(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per (order, part) with amounts, returned part and order data.

    The lines are dealt by order once, in short exact types: totals and the join with the orders both use that layout.
    """
    lines = lineitem.where(c("l_orderkey").isNotNull()).select(
        "l_orderkey", "l_partkey", "l_suppkey", c("l_quantity").cast("long").alias("qty"), c("l_extendedprice").cast("decimal(12,2)").alias("price"),
        c("l_discount").cast("decimal(4,2)").alias("discount"), c("l_tax").cast("decimal(4,2)").alias("tax"), (c("l_returnflag") == "R").alias("back"))
    price, qty, back = c("price"), c("qty"), c("back")
    off, tax = price * c("discount"), price * c("tax")
    totals = lines.repartition("l_orderkey").groupBy("l_orderkey", "l_partkey").agg(
        F.min("l_suppkey").alias("supp"),
        F.sum(qty).alias("quantity"),
        cents(F.sum(price)).alias("ext_list_price"),
        cents(F.sum(off)).alias("ext_discount_amt"),
        cents(F.sum(tax)).alias("ext_tax"),
        F.sum(F.when(back, qty)).alias("return_quantity"),
        cents(F.sum(F.when(back, price - off))).alias("return_amt"),
        cents(F.sum(F.when(back, tax))).alias("return_tax"),
    )
    heads = orders.select("o_orderkey", "o_custkey", c("o_orderdate").cast("date").alias("sold"))
    return totals.join(heads, totals.l_orderkey == heads.o_orderkey)


def sales_fact(lines: DataFrame) -> DataFrame:
    """Sales laid out by channel and month; columns that follow from others are added after the shuffle."""
    lines = spread(lines.withColumn("channel_no", c("l_orderkey") % 3).withColumn("sold_month", month_key(c("sold"))), ("channel_no", "sold_month"))
    order, part, supp, cust = c("l_orderkey"), c("l_partkey"), c("supp"), c("o_custkey")
    sold_sk = F.datediff("sold", F.lit(EPOCH).cast("date"))
    named = lines.select(
        order.alias("order_number"), part.alias("item_sk"), cust.alias("customer_sk"),
        pick(("store", "catalog", "web"), c("channel_no")).alias("channel"),
        sold_sk.alias("sold_date_sk"), "sold_month",
        ((part * 37 + order * 11) % 1440).cast("int").alias("sold_time_sk"),
        (sold_sk + (part * 7) % 150).cast("int").alias("ship_date_sk"),
        F.when(order % 3 != 0, supp % 6).when(order % 50 != 0, supp).alias("site_sk"),
        (supp % 5).alias("warehouse_sk"), (part % 10).alias("ship_mode_sk"),
        (part % 36).alias("promo_sk"), (part % 40).alias("page_sk"),
        ((cust + order) % 140).alias("cdemo_sk"), (cust % 72).alias("hdemo_sk"), (order % 25).alias("addr_sk"),
        F.when((order % 3 != 1) | (order % 50 != 2), (order + 7) % 25).alias("ship_addr_sk"),
        F.when((order % 3 != 2) | (order % 50 != 1), cust).alias("ship_customer_sk"),
        "quantity", "ext_list_price", "ext_discount_amt", "ext_tax", c("return_quantity").alias("back_quantity"),
        c("return_amt").alias("back_amt"), c("return_tax").alias("back_tax"),
        cents(c("ext_list_price") - c("ext_discount_amt")).alias("ext_sales_price"),
        cents(c("ext_list_price") * F.lit("0.6").cast("decimal(2,1)")).alias("ext_wholesale_cost"),
        cents(c("quantity") * F.lit("1.25").cast("decimal(3,2)")).alias("ext_ship_cost"),
    )
    with_coupon = named.withColumn("coupon_amt", cents(
        F.when(c("item_sk") % 5 == 0, c("ext_sales_price") * F.lit("0.1").cast("decimal(2,1)")).otherwise(F.lit(0))))
    paid = with_coupon.withColumn("net_paid", cents(c("ext_sales_price") - c("coupon_amt")))
    return paid.select(
        "*", cents(c("net_paid") - c("ext_wholesale_cost")).alias("net_profit"),
        unit_price(c("ext_list_price"), c("quantity")).alias("list_price"),
        unit_price(c("ext_sales_price"), c("quantity")).alias("sales_price"),
        unit_price(c("ext_wholesale_cost"), c("quantity")).alias("wholesale_cost"))


def returns_fact(sales: DataFrame) -> DataFrame:
    """Returned part of each sale, laid out by channel and month; read off the finished sales, so line items are shuffled once."""
    order, part = c("order_number"), c("item_sk")
    day = F.date_add(F.lit(EPOCH).cast("date"), (c("sold_date_sk") + part % 150).cast("int"))
    back = sales.where(c("back_quantity") > 0).select(
        order, part, "customer_sk", "channel", F.datediff(day, F.lit(EPOCH).cast("date")).alias("returned_date_sk"),
        month_key(day).alias("returned_month"), "site_sk", "page_sk", "hdemo_sk",
        c("back_quantity").alias("return_quantity"), c("back_amt").alias("return_amt"), c("back_tax").alias("return_tax"))
    named = spread(back, FACTS["returns"]).select(
        order, part, "customer_sk", "channel", "returned_date_sk", "returned_month", "site_sk", "page_sk", (part % 10).alias("reason_sk"),
        (c("customer_sk") % 140).alias("cdemo_sk"), "hdemo_sk", ((order + 3) % 25).alias("addr_sk"), "return_quantity", "return_amt", "return_tax",
        cents(c("return_quantity") * F.lit("0.5").cast("decimal(2,1)")).alias("fee"),
        cents(c("return_amt") * F.lit("0.8").cast("decimal(2,1)")).alias("refunded_cash"),
    )
    return named.withColumn(
        "net_loss", cents(c("return_amt") - c("refunded_cash") + c("fee")))


def inventory_fact(sales: DataFrame) -> DataFrame:
    """Stock per item, warehouse and day, taken as the pieces moved that day.

    Ranges of days serve the sums and the month folders, so the rows are shuffled once; a busy day is cut by item.
    """
    moved = sales.select("item_sk", "warehouse_sk", c("sold_date_sk").alias("date_sk"), c("sold_month").alias("month"), "quantity")
    ranges = moved.repartitionByRange("month", "date_sk", "item_sk", "warehouse_sk")
    return ranges.groupBy("item_sk", "warehouse_sk", "date_sk", "month").agg(F.sum("quantity").alias("quantity_on_hand"))


def calendar(spark: SparkSession) -> DataFrame:
    """1990 to 2029: a fixed 14610 rows, whatever the size of the facts."""
    d = c("d_date")
    days = spark.range(14610).select(F.date_add(F.lit("1990-01-01").cast("date"), c("id").cast("int")).alias("d_date"))
    days = days.withColumn("date_sk", F.datediff(d, F.lit(EPOCH).cast("date")))
    return days.select(
        "date_sk", "d_date", F.year(d).alias("year"), F.month(d).alias("moy"), F.dayofmonth(d).alias("dom"),
        F.quarter(d).alias("qoy"), (F.dayofweek(d) - 1).alias("dow"),
        pick(DAY_NAMES, F.dayofweek(d) - 1).alias("day_name"),
        F.floor(c("date_sk") / 7).cast("int").alias("week_seq"), month_key(d).alias("month_seq"),
        F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string")).alias("quarter_name"))


def dimensions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Dimensions that grow with the given tables."""
    get = lambda name: table(spark, sf_dir, name)
    text = lambda prefix, col: F.concat(F.lit(prefix), col.cast("string"))
    places = get("nation").join(get("region"), c("n_regionkey") == c("r_regionkey"))
    n = c("n_nationkey").cast("long")
    address = places.select(
        n.alias("addr_sk"), text("City_", n % 7).alias("city"), text("County_", n % 10).alias("county"),
        c("n_name").alias("state"), c("r_name").alias("country"),
        F.lpad((n * 3701 % 100000).cast("string"), 5, "0").alias("zip"),
        (-(c("n_regionkey") + 4)).alias("gmt_offset"), text("Street ", n).alias("street_name"),
        pick(("apartment", "condo", "single family"), n % 3).alias("location_type"))
    s = c("s_suppkey")
    store = get("supplier").join(address, c("s_nationkey") == c("addr_sk")).select(
        s.alias("store_sk"), c("s_name").alias("store_id"), text("store ", s % 10).alias("store_name"),
        "city", "county", "state", "zip", "gmt_offset", (s % 10).alias("market_id"),
        (200 + s % 100).alias("employees"), (s % 3).alias("company_id"), text("company ", s % 3).alias("company_name"))
    u = c("c_custkey")
    customer = get("customer").select(
        u.alias("customer_sk"), c("c_name").alias("customer_id"), (u % 140).alias("current_cdemo_sk"),
        (u % 72).alias("current_hdemo_sk"), c("c_nationkey").cast("long").alias("current_addr_sk"),
        text("First", u % 97).alias("first_name"), text("Last", u % 89).alias("last_name"),
        pick(("Mr.", "Ms.", "Dr."), u % 3).alias("salutation"),
        F.when(u % 2 == 0, "Y").otherwise("N").alias("preferred"), (u % 12 + 1).alias("birth_month"),
        (1930 + u % 60).alias("birth_year"), text("Country_", u % 15).alias("birth_country"),
        F.lower("c_mktsegment").alias("segment"), (400 + u % 700).cast("int").alias("first_sales_sk"),
        (430 + u % 700).cast("int").alias("first_shipto_sk"))
    p = c("p_partkey")
    price = c("p_retailprice").cast(MONEY)
    item = get("part").select(
        p.alias("item_sk"), text("ITEM", p).alias("item_id"), c("p_name").alias("product_name"),
        text("about ", c("p_name")).alias("item_desc"), c("p_brand").alias("brand"),
        F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("brand_id"),
        F.element_at(F.split("p_name", " "), 1).alias("class"), F.element_at(F.split("p_name", " "), -1).alias("color"),
        c("p_type").alias("category"), c("p_size").alias("manufact_id"), text("maker ", c("p_size")).alias("manufact"),
        (p % 50).alias("manager_id"), price.alias("current_price"),
        cents(price * F.lit("0.6").cast("decimal(2,1)")).alias("wholesale_cost"),
        pick(UNITS, p % 4).alias("units"), pick(SIZES, F.floor(p / 4) % 4).alias("size"))
    return {"customer_address": address, "store": store, "customer": customer, "item": item}


def fixed_dimensions(spark: SparkSession) -> dict[str, DataFrame]:
    """Dimensions with a fixed number of rows; never stored, always small enough to broadcast."""
    k = c("sk")
    keys = lambda n: spark.range(n).select(c("id").alias("sk"))
    text = lambda prefix, col: F.concat(F.lit(prefix), col.cast("string"))
    return {
        "date_dim": calendar(spark),
        "time_dim": keys(1440).select(
            k.cast("int").alias("time_sk"), F.floor(k / 60).alias("hour"), (k % 60).alias("minute"),
            F.when(k < 720, "AM").otherwise("PM").alias("am_pm"),
            F.when(F.floor(k / 60).between(6, 8), "breakfast").when(F.floor(k / 60).between(11, 13), "lunch")
            .when(F.floor(k / 60).between(17, 19), "dinner").alias("meal_time")),
        "customer_demographics": keys(140).select(
            k.alias("cdemo_sk"), F.when(k % 2 == 0, "M").otherwise("F").alias("gender"),
            pick(MARITAL, F.floor(k / 2) % 5).alias("marital_status"),
            pick(EDUCATION, F.floor(k / 10) % 7).alias("education_status"), (500 * (k % 20 + 1)).alias("purchase_estimate"),
            pick(("Low Risk", "Good", "High Risk"), k % 3).alias("credit_rating"), (k % 7).alias("dep_count"),
            (k % 5).alias("dep_employed_count"), (k % 4).alias("dep_college_count")),
        "household_demographics": keys(72).select(
            k.alias("hdemo_sk"), (k % 20).alias("income_band_sk"), pick(BUY_POTENTIAL, k % 6).alias("buy_potential"),
            (k % 10).alias("dep_count"), (F.floor(k / 6) % 6 - 1).alias("vehicle_count")),
        "income_band": keys(20).select(k.alias("income_band_sk"), (k * 10000).alias("lower_bound"),
                                       (k * 10000 + 10000).alias("upper_bound")),
        "promotion": keys(30).select(
            k.alias("promo_sk"), text("PROMO", k).alias("promo_id"), F.when(k % 2 == 0, "N").otherwise("Y").alias("email"),
            F.when(k % 3 == 0, "Y").otherwise("N").alias("event"), F.when(k % 5 == 0, "Y").otherwise("N").alias("dmail"),
            F.when(k % 7 == 0, "Y").otherwise("N").alias("tv")),
        "ship_mode": keys(10).select(k.alias("ship_mode_sk"), pick(SHIP_TYPES, k % 5).alias("type"),
                                     pick(CARRIERS, k).alias("carrier")),
        "reason": keys(10).select(k.alias("reason_sk"), text("reason ", k).alias("reason_desc")),
        "warehouse": keys(5).select(
            k.alias("warehouse_sk"), text("Warehouse ", k).alias("warehouse_name"), (50000 + 1000 * k).alias("sq_ft"),
            text("City_", k).alias("city"), text("County_", k).alias("county"), text("State_", k).alias("state"),
            F.lit("Country_0").alias("country")),
        "call_center": keys(6).select(k.alias("call_center_sk"), text("CC", k).alias("call_center_id"),
                                      text("center ", k).alias("name"), text("manager ", k).alias("manager"),
                                      text("County_", k).alias("county")),
        "web_site": keys(6).select(k.alias("web_site_sk"), text("WEB", k).alias("web_site_id"),
                                   text("site ", k).alias("name"), text("company ", k % 3).alias("company_name")),
        "web_page": keys(40).select(k.alias("web_page_sk"), (2000 + 100 * k).alias("char_count")),
        "catalog_page": keys(40).select(k.alias("catalog_page_sk"), text("PAGE", k).alias("catalog_page_id")),
    }


FACTS = {"sales": ("channel", "sold_month"), "returns": ("channel", "returned_month"), "inventory": ("month",)}


def _fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Name of the mart for the present state of the source files (one call per table)."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    digest = hashlib.sha1(Path(__file__).read_bytes())  # other rules make another mart
    for name in SOURCES:
        path = hadoop.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        summary = fs.getContentSummary(path)
        facts = (str(fs.makeQualified(path)), summary.getLength(), summary.getFileCount(),
                 fs.getFileStatus(path).getModificationTime())
        digest.update(repr(facts).encode())
    return digest.hexdigest()[:16]


def load_star_schema(spark: SparkSession, sf_dir: str, target: str) -> None:
    """Write every table of the mart below ``target``.

    REBALANCE lets adaptive execution cut big (channel, month) slices into several
    tasks and merge small ones, so neither a hot month nor a small test writes badly.
    Facts come laid out by their own functions.
    """
    lines = line_facts(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))
    small = dimensions(spark, sf_dir)

    def write(name: str) -> None:
        frame = small[name].hint("rebalance") if name in small else facts[name]
        frame.write.partitionBy(*FACTS.get(name, ())).option("compression", "zstd").parquet(f"{target}/{name}")

    with ThreadPoolExecutor(4) as pool:  # independent writes share the cluster
        facts = {"sales": sales_fact(lines)}
        list(pool.map(write, ["sales", *small]))
        sales = spark.read.parquet(f"{target}/sales")
        facts |= {"returns": returns_fact(sales), "inventory": inventory_fact(sales)}
        list(pool.map(write, ["returns", "inventory"]))


def spread(frame: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return frame.hint("rebalance", *[c(k) for k in keys])


class Mart:
    """Opened mart: every method returns a lazy DataFrame."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fixed = {name: F.broadcast(frame) for name, frame in fixed_dimensions(spark).items()}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._fixed[name] if name in self._fixed else cached_read(self.spark, f"{self.path}/{name}")

    def sold(self, *channels: str) -> DataFrame:
        return self.sales.where(c("channel").isin(*channels)) if channels else self.sales

    def returned(self, *channels: str) -> DataFrame:
        return self.returns.where(c("channel").isin(*channels)) if channels else self.returns

    def days(self, condition=None, *extra: str, role: str = "sold") -> DataFrame:
        """Calendar rows keyed like a fact: day key, and month key so that partitions are pruned."""
        days = calendar(self.spark) if condition is None else calendar(self.spark).where(condition)
        return F.broadcast(days.select(
            c("date_sk").alias(f"{role}_date_sk"), c("month_seq").alias(f"{role}_month"), *extra))

    def sold_in(self, condition, *channels: str, extra: tuple[str, ...] = ()) -> DataFrame:
        return self.sold(*channels).join(self.days(condition, *extra), ["sold_date_sk", "sold_month"])

    def returned_in(self, condition, *channels: str, extra: tuple[str, ...] = ()) -> DataFrame:
        return self.returned(*channels).join(
            self.days(condition, *extra, role="returned"), ["returned_date_sk", "returned_month"])

    def stock_in(self, condition, extra: tuple[str, ...] = ()) -> DataFrame:
        days = calendar(self.spark).where(condition).select(
            "date_sk", c("month_seq").alias("month"), *extra)
        return self.inventory.join(F.broadcast(days), ["date_sk", "month"])


_MARTS: dict[tuple[int, str], Mart] = {}


def open_mart(spark: SparkSession, sf_dir: str) -> Mart:
    """The mart of ``sf_dir``, loaded first if no finished load exists for its files.

    A load writes to its own folder and is published by an empty marker written last;
    a load that died, or a second one at the same time, is never read half-way.
    """
    root = f"{shared_dir(spark)}/star/{_fingerprint(spark, sf_dir)}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    ready = hadoop.Path(f"{root}/_ready")
    fs = ready.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(ready) or not fs.listStatus(ready):
        run = f"{root}/{uuid.uuid4().hex}"
        load_star_schema(spark, sf_dir, run)
        fs.mkdirs(ready)
        fs.create(hadoop.Path(f"{root}/_ready/{run.rsplit('/', 1)[1]}")).close()
    run = sorted(status.getPath().getName() for status in fs.listStatus(ready))[0]
    key = (id(spark), f"{root}/{run}")
    if key not in _MARTS or _MARTS[key].spark is not spark:
        _MARTS[key] = Mart(spark, key[1])
    return _MARTS[key]
