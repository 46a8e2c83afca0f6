"""Whole mart tables as queries: the load itself is checked row by row (CAT-06, JOB-13)."""

from pyspark.sql import functions as F

from ..registry import query
from ..session import scratch
from .mart import load_star_schema, open_mart
from .mart_oracle import MART_SQL

c = F.col
MONEYS = ("ext_list_price ext_discount_amt ext_tax ext_sales_price ext_wholesale_cost ext_ship_cost coupon_amt net_paid "
          "net_profit list_price sales_price wholesale_cost").split()
BACKS = "return_amt return_tax fee refunded_cash net_loss".split()
KEYS = "order_number item_sk customer_sk channel site_sk page_sk cdemo_sk hdemo_sk addr_sk".split()


@query("cat_06_sales_fact", MART_SQL + "SELECT " + ", ".join(KEYS) + """, warehouse_sk, ship_mode_sk, promo_sk,
    ship_addr_sk, ship_customer_sk, quantity, date_diff('day', DATE '1995-01-01', sold) sold_date_sk, mseq sold_month,
    date_diff('day', DATE '1995-01-01', shipped) ship_date_sk, minute_of_day::INT sold_time_sk, """
       + ", ".join(f"{x}::DOUBLE {x}" for x in MONEYS) + " FROM sales")
def sales_fact(spark, sf_dir):
    sales = open_mart(spark, sf_dir).sales
    return sales.select(*KEYS, "warehouse_sk", "ship_mode_sk", "promo_sk", "ship_addr_sk", "ship_customer_sk", "quantity",
                        "sold_date_sk", "sold_month", "ship_date_sk", "sold_time_sk",
                        *[c(x).cast("double").alias(x) for x in MONEYS])


@query("cat_06_returns_fact", MART_SQL + "SELECT " + ", ".join(KEYS) + """, reason_sk, return_quantity,
    date_diff('day', DATE '1995-01-01', returned) returned_date_sk, mseq returned_month, """
       + ", ".join(f"{x}::DOUBLE {x}" for x in BACKS) + " FROM rets")
def returns_fact(spark, sf_dir):
    return open_mart(spark, sf_dir).returns.select(
        *KEYS, "reason_sk", "return_quantity", "returned_date_sk", "returned_month",
        *[c(x).cast("double").alias(x) for x in BACKS])


def _plain(frame):
    return frame.select(*[c(n).cast("double").alias(n) if t.startswith("decimal") else
                          c(n).cast("string").alias(n) if t == "date" else c(n) for n, t in frame.dtypes])


def _dimension(name: str, sql: str) -> None:
    @query(f"cat_06_{name}", MART_SQL + sql)
    def run(spark, sf_dir):
        return _plain(getattr(open_mart(spark, sf_dir), name))


_dimension("inventory", """SELECT item_sk, warehouse_sk, date_diff('day', DATE '1995-01-01', sold) date_sk, mseq AS month,
    quantity_on_hand FROM stock""")
_dimension("item", "SELECT * REPLACE (current_price::DOUBLE AS current_price, wholesale_cost::DOUBLE AS wholesale_cost) FROM item")
_dimension("customer", "SELECT * FROM cust")
_dimension("store", "SELECT * FROM store")
_dimension("customer_address", "SELECT * FROM addr")


@query("job_13_star_load", MART_SQL + """SELECT 'sales' AS name, channel AS part, count(*) AS rows FROM sales GROUP BY ALL UNION ALL SELECT 'returns', channel, count(*) FROM rets GROUP BY ALL
    UNION ALL SELECT 'inventory', 'all', count(*) FROM stock UNION ALL SELECT 'item', 'all', count(*) FROM item UNION ALL SELECT 'customer', 'all', count(*) FROM cust UNION ALL SELECT 'store', 'all', count(*) FROM store""")
def star_load(spark, sf_dir):
    """A new load of the whole star schema and the rows of what it wrote."""
    path = scratch(spark, "star")
    load_star_schema(spark, sf_dir, path)

    def counted(name, part):
        return spark.read.parquet(f"{path}/{name}").groupBy(part.alias("part")).agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "part", "rows")

    out = counted("sales", c("channel")).unionByName(counted("returns", c("channel")))
    for name in ("inventory", "item", "customer", "store"):
        out = out.unionByName(counted(name, F.lit("all")))
    return out
