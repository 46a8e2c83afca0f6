"""The same star schema as DuckDB CTEs over the given tables, written on its own.

Statements in this package put their text behind ``MART_SQL``; a CTE that a
statement does not use is never evaluated.
"""

_STORE_SITE = "CASE WHEN l_orderkey % 3 <> 0 THEN supp % 6 WHEN l_orderkey % 50 <> 0 THEN supp END"
_CHANNEL = "CASE l_orderkey % 3 WHEN 0 THEN 'store' WHEN 1 THEN 'catalog' ELSE 'web' END"


def _nth(values: str, position: str) -> str:
    items = ",".join(f"'{v}'" for v in values.split("|"))
    return f"([{items}])[({position}) + 1]"


MART_SQL = f"""WITH
lines AS (
  SELECT l_orderkey, l_partkey, min(l_suppkey) supp, sum(l_quantity::BIGINT)::BIGINT quantity,
    round(sum(pr), 2)::DECIMAL(18,2) ext_list_price, round(sum(pr * dc), 2)::DECIMAL(18,2) ext_discount_amt,
    round(sum(pr * tx), 2)::DECIMAL(18,2) ext_tax,
    (sum(l_quantity::BIGINT) FILTER (WHERE back))::BIGINT return_quantity,
    round(sum(pr - pr * dc) FILTER (WHERE back), 2)::DECIMAL(18,2) return_amt,
    round(sum(pr * tx) FILTER (WHERE back), 2)::DECIMAL(18,2) return_tax
  FROM (SELECT *, l_extendedprice::DECIMAL(12,2) pr, l_discount::DECIMAL(4,2) dc, l_tax::DECIMAL(4,2) tx,
          l_returnflag = 'R' back FROM lineitem)
  GROUP BY l_orderkey, l_partkey),
li AS (SELECT *, o_orderdate::DATE sold, o_custkey cust FROM lines JOIN orders ON l_orderkey = o_orderkey),
sales0 AS (
  SELECT l_orderkey order_number, l_partkey item_sk, cust customer_sk, {_CHANNEL} channel, sold,
    (sold + ((l_partkey * 7) % 150)::INT)::DATE shipped, (l_partkey * 37 + l_orderkey * 11) % 1440 minute_of_day,
    {_STORE_SITE} site_sk, supp % 5 warehouse_sk, l_partkey % 10 ship_mode_sk, l_partkey % 36 promo_sk,
    l_partkey % 40 page_sk, (cust + l_orderkey) % 140 cdemo_sk, cust % 72 hdemo_sk, l_orderkey % 25 addr_sk,
    CASE WHEN NOT (l_orderkey % 3 = 1 AND l_orderkey % 50 = 2) THEN (l_orderkey + 7) % 25 END ship_addr_sk,
    CASE WHEN NOT (l_orderkey % 3 = 2 AND l_orderkey % 50 = 1) THEN cust END ship_customer_sk,
    quantity, ext_list_price, ext_discount_amt, ext_tax,
    (ext_list_price - ext_discount_amt)::DECIMAL(18,2) ext_sales_price,
    round(ext_list_price * 0.6, 2)::DECIMAL(18,2) ext_wholesale_cost,
    (quantity * 1.25)::DECIMAL(18,2) ext_ship_cost,
    CASE WHEN l_partkey % 5 = 0 THEN round((ext_list_price - ext_discount_amt) * 0.1, 2) ELSE 0 END::DECIMAL(18,2) coupon_amt
  FROM li),
sales AS (
  SELECT *, (ext_sales_price - coupon_amt)::DECIMAL(18,2) net_paid,
    (ext_sales_price - coupon_amt - ext_wholesale_cost)::DECIMAL(18,2) net_profit,
    (((ext_list_price * 100)::BIGINT // quantity) * 0.01)::DECIMAL(18,2) list_price,
    (((ext_sales_price * 100)::BIGINT // quantity) * 0.01)::DECIMAL(18,2) sales_price,
    (((ext_wholesale_cost * 100)::BIGINT // quantity) * 0.01)::DECIMAL(18,2) wholesale_cost,
    year(sold) y, month(sold) m, (year(sold) - 1995) * 12 + month(sold) - 1 mseq,
    floor(date_diff('day', DATE '1995-01-01', sold) / 7)::BIGINT wseq
  FROM sales0),
returns0 AS (
  SELECT l_orderkey order_number, l_partkey item_sk, cust customer_sk, {_CHANNEL} channel,
    (sold + (l_partkey % 150)::INT)::DATE returned, {_STORE_SITE} site_sk, l_partkey % 40 page_sk,
    l_partkey % 10 reason_sk, cust % 140 cdemo_sk, cust % 72 hdemo_sk, (l_orderkey + 3) % 25 addr_sk,
    return_quantity, return_amt, return_tax, (return_quantity * 0.5)::DECIMAL(18,2) fee,
    round(return_amt * 0.8, 2)::DECIMAL(18,2) refunded_cash
  FROM li WHERE return_quantity > 0),
rets AS (
  SELECT *, (return_amt - refunded_cash + fee)::DECIMAL(18,2) net_loss, year(returned) y, month(returned) m,
    (year(returned) - 1995) * 12 + month(returned) - 1 mseq,
    floor(date_diff('day', DATE '1995-01-01', returned) / 7)::BIGINT wseq
  FROM returns0),
stock AS (
  SELECT item_sk, warehouse_sk, sold, y, m, mseq, sum(quantity)::BIGINT quantity_on_hand FROM sales GROUP BY ALL),
addr AS (
  SELECT n_nationkey::BIGINT addr_sk, 'City_' || n_nationkey % 7 city, 'County_' || n_nationkey % 10 county,
    n_name state, r_name country, lpad((n_nationkey * 3701 % 100000)::VARCHAR, 5, '0') zip,
    -(n_regionkey + 4) gmt_offset, 'Street ' || n_nationkey street_name,
    {_nth('apartment|condo|single family', 'n_nationkey % 3')} location_type
  FROM nation JOIN region ON n_regionkey = r_regionkey),
store AS (
  SELECT s_suppkey store_sk, s_name store_id, 'store ' || s_suppkey % 10 store_name, city, county, state, zip, gmt_offset,
    s_suppkey % 10 market_id, 200 + s_suppkey % 100 employees, s_suppkey % 3 company_id,
    'company ' || s_suppkey % 3 company_name
  FROM supplier JOIN addr ON s_nationkey = addr_sk),
cust AS (
  SELECT c_custkey customer_sk, c_name customer_id, c_custkey % 140 current_cdemo_sk, c_custkey % 72 current_hdemo_sk,
    c_nationkey::BIGINT current_addr_sk, 'First' || c_custkey % 97 first_name, 'Last' || c_custkey % 89 last_name,
    {_nth('Mr.|Ms.|Dr.', 'c_custkey % 3')} salutation, CASE c_custkey % 2 WHEN 0 THEN 'Y' ELSE 'N' END preferred,
    c_custkey % 12 + 1 birth_month, 1930 + c_custkey % 60 birth_year, 'Country_' || c_custkey % 15 birth_country,
    lower(c_mktsegment) segment,
    (400 + c_custkey % 700)::INT first_sales_sk, (430 + c_custkey % 700)::INT first_shipto_sk
  FROM customer),
item AS (
  SELECT p_partkey item_sk, 'ITEM' || p_partkey item_id, p_name product_name, 'about ' || p_name item_desc, p_brand brand,
    replace(p_brand, 'Brand#', '')::INT brand_id, split_part(p_name, ' ', 1) class, split_part(p_name, ' ', -1) color,
    p_type category, p_size manufact_id, 'maker ' || p_size manufact, p_partkey % 50 manager_id,
    p_retailprice::DECIMAL(18,2) current_price, round(p_retailprice::DECIMAL(18,2) * 0.6, 2)::DECIMAL(18,2) wholesale_cost,
    {_nth('Each|Box|Case|Dozen', 'p_partkey % 4')} units,
    {_nth('small|medium|large|extra large', '(p_partkey // 4) % 4')} size
  FROM part),
cdemo AS (
  SELECT k cdemo_sk, CASE k % 2 WHEN 0 THEN 'M' ELSE 'F' END gender, {_nth('S|M|D|W|U', '(k // 2) % 5')} marital_status,
    {_nth('Primary|Secondary|College|2 yr Degree|4 yr Degree|Advanced Degree|Unknown', '(k // 10) % 7')} education_status,
    500 * (k % 20 + 1) purchase_estimate, {_nth('Low Risk|Good|High Risk', 'k % 3')} credit_rating,
    k % 7 dep_count, k % 5 dep_employed_count, k % 4 dep_college_count
  FROM range(140) g(k)),
hdemo AS (
  SELECT k hdemo_sk, k % 20 income_band_sk,
    {_nth('0-500|501-1000|1001-5000|5001-10000|>10000|Unknown', 'k % 6')} buy_potential, k % 10 dep_count,
    (k // 6) % 6 - 1 vehicle_count, (k % 20) * 10000 lower_bound, (k % 20) * 10000 + 10000 upper_bound
  FROM range(72) g(k)),
promo AS (
  SELECT k promo_sk, 'PROMO' || k promo_id, CASE k % 2 WHEN 0 THEN 'N' ELSE 'Y' END email,
    CASE k % 3 WHEN 0 THEN 'Y' ELSE 'N' END event, CASE k % 5 WHEN 0 THEN 'Y' ELSE 'N' END dmail,
    CASE k % 7 WHEN 0 THEN 'Y' ELSE 'N' END tv
  FROM range(30) g(k)),
ship_mode AS (
  SELECT k ship_mode_sk, {_nth('EXPRESS|OVERNIGHT|REGULAR|TWO DAY|LIBRARY', 'k % 5')} type,
    {_nth('UPS|FEDEX|AIRBORNE|USPS|DHL|TBS|ZHOU|LATVIAN|BARIAN|GREAT EASTERN', 'k')} carrier
  FROM range(10) g(k)),
wh AS (
  SELECT k warehouse_sk, 'Warehouse ' || k warehouse_name, 50000 + 1000 * k sq_ft, 'City_' || k city,
    'County_' || k county, 'State_' || k state, 'Country_0' country FROM range(5) g(k)),
clock AS (
  SELECT k minute_of_day, k // 60 h, k % 60 mi, CASE WHEN k // 60 BETWEEN 6 AND 8 THEN 'breakfast'
    WHEN k // 60 BETWEEN 11 AND 13 THEN 'lunch' WHEN k // 60 BETWEEN 17 AND 19 THEN 'dinner' END meal_time
  FROM range(1440) g(k))
"""
