"""One query per scalar function, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.projection import level_of
from ..registry import on_tables
from . import scalar as S

c = F.col


@on_tables("str_01_substring", "SELECT doc_id, substr(text, 1, 20) AS head, substr(text, 21, 10) AS middle, substr(text, n_chars // 2 + 1, 5) AS centre FROM documents")
def substring(t):
    return t.documents.select("doc_id", F.substring("text", 1, 20).alias("head"), F.substring("text", 21, 10).alias("middle"),
                              c("text").substr((F.floor(c("n_chars") / 2) + 1).cast("int"), F.lit(5)).alias("centre"))


@on_tables("str_02_split", "SELECT doc_id, len(string_split(text, ' '))::BIGINT AS words, string_split(text, ' ')[1] AS first FROM documents")
def split(t):
    words = F.split("text", " ")
    return t.documents.select("doc_id", F.size(words).cast("long").alias("words"), words[0].alias("first"))


@on_tables("str_03_concat", "SELECT p_partkey, p_brand || ', ' || p_type AS label, CASE WHEN p_size > 25 THEN p_name || ', ' || p_brand END AS maybe FROM part")
def concat(t):
    return t.part.select("p_partkey", F.concat("p_brand", F.lit(", "), "p_type").alias("label"),
                         F.concat(F.when(c("p_size") > 25, c("p_name")), F.lit(", "), "p_brand").alias("maybe"))


@on_tables("str_04_upper", "SELECT c_custkey, upper(c_name) AS name FROM customer")
def upper(t):
    return t.customer.select("c_custkey", F.upper("c_name").alias("name"))


@on_tables("str_05_length", "SELECT conv_id, turn, length(text)::BIGINT AS chars FROM conversations")
def length(t):
    return t.conversations.select("conv_id", "turn", F.length("text").cast("long").alias("chars"))


@on_tables("str_06_strip_leading_junk", r"SELECT page_id, regexp_replace('?? ' || html, '^([\W]+)<', '<') AS html FROM pages")
def strip_leading_junk(t):
    return t.pages.select("page_id", S.strip_leading_junk(F.concat(F.lit("?? "), "html")).alias("html"))


@on_tables("str_07_remove_punctuation", r"SELECT doc_id, regexp_replace(text, '[[:punct:]0-9\r\t\n]', ' ', 'g') AS clean FROM documents")
def remove_punctuation(t):
    return t.documents.select("doc_id", S.remove_punctuation(c("text")).alias("clean"))


@on_tables("str_08_shorten", r"""SELECT doc_id, CASE WHEN length(f) <= 220 THEN f ELSE rtrim(substr(f, 1, 217)) || '...' END AS short
    FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) f FROM documents)""")
def shorten(t):
    return t.documents.select("doc_id", S.shorten(c("text")).alias("short"))


@on_tables("str_09_size_to_bytes", """SELECT event_id, value * (CASE event_id % 3 WHEN 0 THEN 1024.0 ** 3 WHEN 1 THEN 1000.0 ** 2 ELSE 1024.0 END) AS bytes FROM events""")
def size_to_bytes(t):
    unit = F.when(c("event_id") % 3 == 0, " GiB").when(c("event_id") % 3 == 1, " mb").otherwise("KiB")
    return t.events.select("event_id", S.size_to_bytes(F.concat(F.lit("read "), c("value").cast("string"), unit, F.lit(" so far"))).alias("bytes"))


@on_tables("str_10_amounts_to_text", """WITH a AS (SELECT o_orderkey, ((o_totalprice * 100)::BIGINT * (1 + o_orderkey % 7) ** (o_orderkey % 9))::BIGINT AS b, (o_totalprice * 100)::BIGINT * (1 + o_orderkey % 3) AS ms FROM orders)
    SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1024 ** 2 THEN printf('%.1f KiB', b / 1024.0::DOUBLE) WHEN b < 1024 ** 3 THEN printf('%.1f MiB', b / (1024 ** 2)::DOUBLE)
      WHEN b < 1024 ** 4 THEN printf('%.1f GiB', b / (1024 ** 3)::DOUBLE) WHEN b < 1024 ** 5 THEN printf('%.1f TiB', b / (1024 ** 4)::DOUBLE) ELSE printf('%.1f PiB', b / (1024 ** 5)::DOUBLE) END AS bytes_text,
      CASE WHEN ms < 1000 THEN ms || ' ms' WHEN ms / 1000.0::DOUBLE < 120 THEN printf('%.1f s', ms / 1000.0::DOUBLE) WHEN ms / 1000.0::DOUBLE / 60 < 120 THEN printf('%.1f min', ms / 1000.0::DOUBLE / 60)
      ELSE printf('%.1f hr', ms / 1000.0::DOUBLE / 60 / 60) END AS ms_text FROM a""")
def amounts_to_text(t):
    cents = F.round(c("o_totalprice") * 100).cast("long")
    big = (cents * F.round(F.pow(1 + c("o_orderkey") % 7, c("o_orderkey") % 9)).cast("long")).alias("b")
    rows = t.orders.select("o_orderkey", big, (cents * (1 + c("o_orderkey") % 3)).alias("ms"))
    return rows.select("o_orderkey", S.bytes_to_text(c("b")).alias("bytes_text"), S.millis_to_text(c("ms")).alias("ms_text"))


@on_tables("str_12_nested_text", "SELECT event_id, event_type || ' ' || user_id || ' ' || event_type || ' x y ' || json_extract_string(props, '$.k') AS text FROM events")
def nested_text(t):
    nested = F.struct(c("event_type").alias("a"), F.struct(c("user_id").alias("n")).alias("b"), F.array("event_type", F.lit("x y")).alias("list"),
                      F.from_json("props", "k long").alias("props"))
    return t.events.select("event_id", S.nested_text(F.to_json(nested)).alias("text"))


@on_tables("dat_01_add_days", """SELECT o_orderkey, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS later, strftime(o_orderdate - INTERVAL 14 DAY, '%Y-%m-%d') AS earlier FROM orders""")
def add_days(t):
    day = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", F.date_add(day, 30).cast("string").alias("later"), F.date_sub(day, 14).cast("string").alias("earlier"))


@on_tables("dat_02_text_to_date", "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1999-02-22' AND DATE '1999-02-22' + INTERVAL 30 DAY")
def text_to_date(t):
    text = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    first = F.lit("1999-02-22").cast("date")
    return text.where(c("day").try_cast("date").between(first, F.date_add(first, 30))).select("o_orderkey")


@on_tables("dat_03_days_between", "SELECT o_custkey, date_diff('day', max(o_orderdate)::DATE, DATE '2020-12-31') AS recency FROM orders GROUP BY 1")
def days_between(t):
    last = t.orders.groupBy("o_custkey").agg(F.max(F.to_date("o_orderdate")).alias("last"))
    return last.select("o_custkey", F.datediff(F.to_date(F.lit("2020-12-31")), "last").cast("long").alias("recency"))


@on_tables("dat_04_text_to_timestamp", "SELECT event_id, epoch_us(ts) AS micros FROM events")
def text_to_timestamp(t):
    text = t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("text"))
    return text.select("event_id", F.unix_micros(F.try_to_timestamp("text")).alias("micros"))


@on_tables("dat_05_year", "SELECT year(o_orderdate) AS year, count(*) AS orders FROM orders GROUP BY 1")
def year(t):
    return t.orders.groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("orders"))


@on_tables("dat_06_current_time", "SELECT count(*) AS n, true AS same FROM events")
def current_time(t):
    stamped = t.events.select((F.unix_timestamp() - F.unix_timestamp(F.current_timestamp())).alias("gap"))
    return stamped.agg(F.count("*").alias("n"), (F.max(F.abs("gap")) == 0).alias("same"))


@on_tables("dat_07_millis_to_iso", """SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S+00:00') END AS iso FROM events""")
def millis_to_iso(t):
    millis = F.when(c("event_id") % 10 != 0, F.floor(F.unix_micros(c("ts").cast("timestamp")) / 1000)).otherwise(F.lit(0))
    return t.events.select("event_id", S.millis_to_iso(millis).alias("iso"))


@on_tables("dat_08_date_key_arithmetic", """SELECT count(*) FILTER (WHERE d <= 30) AS d30, count(*) FILTER (WHERE d > 30 AND d <= 60) AS d60, count(*) FILTER (WHERE d > 60) AS more
    FROM (SELECT date_diff('day', o_orderdate, l_shipdate) d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")
def date_key_arithmetic(t):
    key = lambda name: F.datediff(name, F.lit("1995-01-01").cast("date"))
    joined = (t.lineitem.select("l_orderkey", key("l_shipdate").alias("ship_sk"))
              .join(t.orders.select("o_orderkey", key("o_orderdate").alias("sold_sk")), c("l_orderkey") == c("o_orderkey")))
    d = c("ship_sk") - c("sold_sk")
    count = lambda cond, name: F.sum(F.when(cond, 1).otherwise(0)).alias(name)
    return joined.agg(count(d <= 30, "d30"), count((d > 30) & (d <= 60), "d60"), count(d > 60, "more"))


@on_tables("dat_09_elapsed_seconds", """SELECT user_id, epoch(max(date_trunc('second', ts)))::BIGINT - epoch(min(date_trunc('second', ts)))::BIGINT AS seconds FROM events GROUP BY 1""")
def elapsed_seconds(t):
    span = t.events.groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("a"), F.max("ts").cast("timestamp").alias("b"))
    return span.select("user_id", S.elapsed_seconds(c("a"), c("b")).alias("seconds"))


@on_tables("mth_01_round", "SELECT l_orderkey, l_partkey, l_linenumber, round(l_extendedprice::DECIMAL(12,2) * l_discount::DECIMAL(4,2), 2)::DOUBLE AS off FROM lineitem")
def rounded(t):
    off = c("l_extendedprice").cast("decimal(12,2)") * c("l_discount").cast("decimal(4,2)")
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", F.round(off, 2).cast("double").alias("off"))


@on_tables("mth_02_abs", "SELECT c_custkey, abs(c_acctbal - 5000) AS gap FROM customer")
def absolute(t):
    return t.customer.select("c_custkey", F.abs(c("c_acctbal") - 5000).alias("gap"))


@on_tables("mth_03_guarded_ratio", """SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_discount > 0 THEN l_tax / l_discount END AS ratio, CASE WHEN l_discount > 0 THEN l_tax / l_discount ELSE 0 END AS or_zero FROM lineitem""")
def guarded_ratio(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", F.try_divide("l_tax", "l_discount").alias("ratio"),
                             S.ratio_or_zero(c("l_tax"), c("l_discount")).alias("or_zero"))


@on_tables("mth_04_decimal_casts", """SELECT o_orderkey, o_totalprice::DECIMAL(15,4)::DOUBLE AS fine, o_totalprice::DECIMAL(12,2)::DOUBLE / 8 AS eighth FROM orders""")
def decimal_casts(t):
    eighth = c("o_totalprice").cast("decimal(12,2)") / F.lit(8).cast("decimal(17,2)")
    return t.orders.select("o_orderkey", c("o_totalprice").cast("decimal(15,4)").cast("double").alias("fine"), eighth.cast("double").alias("eighth"))


@on_tables("mth_05_int_bucket", "SELECT trunc(o_totalprice / 5000)::BIGINT AS segment, count(*) AS n FROM orders GROUP BY 1")
def int_bucket(t):
    return t.orders.groupBy((c("o_totalprice") / 5000).cast("int").cast("long").alias("segment")).agg(F.count("*").alias("n"))


@on_tables("mth_06_tolerant_int", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id WHEN 1 THEN trunc(value)::BIGINT ELSE -1 END AS n FROM events""")
def tolerant_int(t):
    text = (F.when(c("event_id") % 4 == 0, c("user_id").cast("string")).when(c("event_id") % 4 == 1, c("value").cast("string"))
            .when(c("event_id") % 4 == 2, c("event_type")))
    return t.events.select("event_id", S.tolerant_int(text, -1).alias("n"))


@on_tables("cnd_01_case", """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band,
    CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 0 END AS code FROM orders""")
def case(t):
    band = F.when(c("o_totalprice") > 300000, "high").when(c("o_totalprice") > 100000, "middle").otherwise("low")
    code = F.when(c("o_orderstatus") == "O", 1).when(c("o_orderstatus") == "F", 2).otherwise(0)
    return t.orders.select("o_orderkey", band.alias("band"), code.alias("code"))


@on_tables("cnd_02_coalesce", "SELECT d.doc_id, coalesce(quality, toxic, -1) AS mark FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def coalesce(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", F.coalesce("quality", "toxic", F.lit(-1)).alias("mark"))


@on_tables("cnd_03_text_flag", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM part")
def text_flag(t):
    text = F.when(c("p_size") % 4 == 0, F.when(c("p_partkey") % 2 == 0, "true").otherwise("1")).when(
        c("p_size") % 4 == 1, F.when(c("p_partkey") % 2 == 0, "false").otherwise("0")).otherwise("other")
    return t.part.select("p_partkey", S.text_flag(text).alias("flag"))


@on_tables("cnd_04_rating_to_label", "SELECT event_id, CASE WHEN (user_id % 5) + 1 >= 4 THEN 1 ELSE 0 END AS label FROM events")
def rating_to_label(t):
    return t.events.select("event_id", F.when(c("user_id") % 5 + 1 >= 4, 1).otherwise(0).alias("label"))


@on_tables("cnd_05_levels", """SELECT user_id, 'RED' AS level, count(*) AS n FROM events WHERE value BETWEEN 10 AND 30 GROUP BY 1
    UNION ALL SELECT user_id, 'YELLOW', count(*) FROM events WHERE value BETWEEN 30 AND 60 GROUP BY 1
    UNION ALL SELECT user_id, 'GREEN', count(*) FROM events WHERE value > 60 GROUP BY 1""")
def levels(t):
    found = F.array_compact(F.array(*[F.when(inside, F.lit(name)) for name, inside in level_of(c("value")).items()]))
    return t.events.select("user_id", F.explode(found).alias("level")).groupBy("user_id", "level").agg(F.count("*").alias("n"))


@on_tables("arr_01_explode_split", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY 1")
def explode_split(t):
    return t.documents.select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@on_tables("arr_02_explode_outer", """SELECT o_orderkey, unnest(CASE WHEN o_totalprice > 400000 THEN [o_custkey, o_orderkey + 1] ELSE [NULL::BIGINT] END) AS k FROM orders""")
def explode_outer(t):
    """Rows whose array is empty or missing stay, with a null."""
    keys = F.when(c("o_totalprice") > 400000, F.array("o_custkey", c("o_orderkey") + 1)).when(c("o_totalprice") > 200000, F.array().cast("array<bigint>"))
    return t.orders.select("o_orderkey", F.explode_outer(keys).alias("k"))


@on_tables("jsn_01_from_json", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def from_json(t):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("missing", T.StringType())])
    return t.events.select("event_id", F.from_json("props", schema).alias("data")).select("event_id", "data.k")


@on_tables("jsn_02_to_json", "SELECT to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey})::VARCHAR AS value FROM nation")
def to_json(t):
    return t.nation.select("n_nationkey", "n_name", "n_regionkey").select(F.to_json(F.struct("*")).alias("value"))


@on_tables("jsn_03_unwrap_envelope", "SELECT event_id, '{\"Event\":\"' || event_type || '\",\"User\":' || user_id || '}' AS event FROM events")
def unwrap_envelope(t):
    event = F.concat(F.lit('{"Event":"'), "event_type", F.lit('","User":'), c("user_id").cast("string"), F.lit("}"))
    line = F.when(c("event_id") % 2 == 0, F.to_json(F.struct(event.alias("log")))).otherwise(event)
    return t.events.select("event_id", S.unwrap_envelope(line).alias("event"))


@on_tables("jsn_04_truncate_fields", "SELECT doc_id, CASE WHEN length(text) > 1000 THEN '[TRUNCATED ' || length(text) || ' chars]' ELSE text END AS text FROM documents")
def truncate_fields(t):
    return t.documents.select("doc_id", S.truncate_field(c("text"), 1000).alias("text"))


@on_tables("jsn_05_properties", "SELECT event_id, event_type AS kind, user_id::VARCHAR AS owner FROM events")
def properties(t):
    as_object = F.to_json(F.struct(c("event_type").alias("kind"), c("user_id").cast("string").alias("owner")))
    as_pairs = F.to_json(F.array(F.array(F.lit("kind"), "event_type"), F.array(F.lit("owner"), c("user_id").cast("string"))))
    props = S.properties_map(F.when(c("event_id") % 2 == 0, as_object).otherwise(as_pairs))
    return t.events.select("event_id", props["kind"].alias("kind"), props["owner"].alias("owner"))


@on_tables("jsn_06_flatten", """SELECT o_orderkey, o_custkey AS customer_id, l_partkey AS lines_part, l_quantity::BIGINT AS lines_qty_pieces FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    UNION ALL SELECT o_orderkey, o_custkey, l_suppkey, l_linenumber::BIGINT FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def flatten(t):
    """Structs inside an array inside a record, down to plain columns and one row per element."""
    entry = lambda part, pieces: F.struct(c(part).alias("part"), F.struct(c(pieces).cast("long").alias("pieces")).alias("qty"))
    lines = t.lineitem.select("l_orderkey", F.array(entry("l_partkey", "l_quantity"), entry("l_suppkey", "l_linenumber")).alias("lines"))
    nested = t.orders.join(lines, c("l_orderkey") == c("o_orderkey")).select("o_orderkey", F.struct(c("o_custkey").alias("id")).alias("customer"), "lines")
    return S.flatten(nested)


@on_tables("xml_01_element_text", "SELECT o_orderkey, o_orderpriority AS priority, o_custkey::VARCHAR AS customer, o_orderstatus AS status, NULL::VARCHAR AS nothing FROM orders")
def element_text(t):
    xml = F.concat(F.lit('<Order status="'), "o_orderstatus", F.lit('"><Head><Priority>'), "o_orderpriority", F.lit("</Priority><Customer>"),
                   c("o_custkey").cast("string"), F.lit("</Customer><Empty></Empty></Head></Order>"))
    text = T.StringType()
    head = T.StructType([T.StructField(n, text) for n in ("Priority", "Customer", "Empty")])
    schema = T.StructType([T.StructField("_status", text), T.StructField("Head", head)])
    get = lambda path, name: S.blank_to_null(c(f"r.{path}")).alias(name)
    return t.orders.select("o_orderkey", S.xml_record(xml, schema).alias("r")).select(
        "o_orderkey", get("Head.Priority", "priority"), get("Head.Customer", "customer"), get("_status", "status"), get("Head.Empty", "nothing"))


@on_tables("udf_01_punctuation_native", r"SELECT conv_id, turn, regexp_replace(text, '[[:punct:]0-9\r\t\n]', ' ', 'g') AS clean FROM conversations")
def punctuation_native(t):
    """The row function of the source system as a built-in expression; tests hold a pandas twin."""
    return t.conversations.select("conv_id", "turn", S.remove_punctuation(c("text")).alias("clean"))


@on_tables("udf_02_rating_native", "SELECT conv_id, turn, CASE WHEN turn % 5 + 1 >= 4 THEN 1 ELSE 0 END AS label FROM conversations")
def rating_native(t):
    """A rating function as ``when``, with a number as result where the row function gave text."""
    return t.conversations.select("conv_id", "turn", F.when(c("turn") % 5 + 1 >= 4, 1).otherwise(0).alias("label"))


@on_tables("udf_03_rows_to_rows", "SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents")
def rows_to_rows(t):
    return t.documents.select("doc_id", F.explode(F.split("text", " ")).alias("word"))


@on_tables("udf_04_row_to_record", "SELECT p_partkey, p_name AS name, p_size::BIGINT AS size, p_size > 25 AS large FROM part")
def row_to_record(t):
    text = F.concat_ws("|", c("p_partkey").cast("string"), "p_name", c("p_size").cast("string"))
    field = F.split(text, r"\|")
    return t.part.select(field[0].cast("long").alias("p_partkey"), field[1].alias("name"), field[2].try_cast("long").alias("size"),
                         (field[2].try_cast("long") > 25).alias("large"))
