"""Column functions: text, numbers, dates, JSON and XML. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col

# Bytes per unit of a size text, binary and decimal.
SIZE_UNITS = {"B": 1, "KIB": 2**10, "MIB": 2**20, "GIB": 2**30, "TIB": 2**40, "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12}


# ---- text --------------------------------------------------------------------------------


def strip_leading_junk(text: Column) -> Column:
    """Drop what stands before the first tag, such as a byte order mark."""
    return F.regexp_replace(text, r"^([\W]+)<", "<")


def remove_punctuation(text: Column) -> Column:
    """Every ASCII punctuation mark, digit, tab and line end becomes a blank."""
    return F.regexp_replace(text, r"[\p{Punct}0-9\r\t\n]", " ")


def shorten(text: Column, limit: int = 220) -> Column:
    """Whitespace runs become one blank; longer text ends in three dots."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("...")))


def size_to_bytes(text: Column) -> Column:
    """``2.1 GiB`` to bytes as double; null where there is no size."""
    number = F.regexp_extract(text, r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(TiB|GiB|MiB|KiB|TB|GB|MB|KB|B)\b", 1)
    unit = F.upper(F.regexp_extract(text, r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(TiB|GiB|MiB|KiB|TB|GB|MB|KB|B)\b", 2))
    factor = F.create_map(*[F.lit(x) for pair in SIZE_UNITS.items() for x in (pair[0], float(pair[1]))])
    return number.try_cast("double") * factor[unit]


def one_decimal(value: Column) -> Column:
    return F.call_function("format_number", value, F.lit("0.0"))


def bytes_to_text(value: Column) -> Column:
    """``1536`` to ``1.5 KiB``; exact halves go to the even digit."""
    out = F.concat(one_decimal(value / F.lit(float(2**50))), F.lit(" PiB"))
    for power, unit in ((40, "TiB"), (30, "GiB"), (20, "MiB"), (10, "KiB")):
        out = F.when(F.abs(value) < F.lit(float(2 ** (power + 10))), F.concat(one_decimal(value / F.lit(float(2**power))), F.lit(f" {unit}"))).otherwise(out)
    return F.when(F.abs(value) < 1024, F.concat(value.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def millis_to_text(value: Column) -> Column:
    """``1500`` to ``1.5 s``; minutes from 120 s, hours from 120 minutes."""
    with_unit = lambda x, unit: F.concat(one_decimal(x), F.lit(unit))
    seconds = value / 1000
    return (F.when(value < 1000, F.concat(value.cast("string"), F.lit(" ms"))).when(seconds < 120, with_unit(seconds, " s"))
            .when(seconds / 60 < 120, with_unit(seconds / 60, " min")).otherwise(with_unit(seconds / 60 / 60, " hr")))


def nested_text(json: Column, limit: int | None = None) -> Column:
    """All values of a JSON text joined by blanks: strings that are not keys, numbers, booleans."""
    token = r'"(?:[^"\\]|\\.)*"\s*:?|-?[0-9][0-9.eE+-]*|true|false'
    values = F.filter(F.regexp_extract_all(json, F.lit(token), F.lit(0)), lambda v: ~v.endswith(":"))
    joined = F.array_join(F.transform(values, lambda v: F.regexp_replace(v, r'^"|"$', "")), " ")
    return joined if limit is None else F.substring(joined, 1, limit)


# ---- numbers and dates ----------------------------------------------------------------------


def tolerant_int(text: Column, default: int = 0) -> Column:
    """Whole number from text; decimals are cut, anything else gives ``default``."""
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def ratio_or_zero(above: Column, below: Column) -> Column:
    return F.coalesce(F.try_divide(above.cast("double"), below.cast("double")), F.lit(0.0))


def millis_to_iso(millis: Column) -> Column:
    """UTC text of epoch milliseconds; null for missing or non-positive values."""
    return F.when(millis > 0, F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))


def elapsed_seconds(start: Column, end: Column) -> Column:
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def text_flag(text: Column) -> Column:
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)


# ---- JSON ---------------------------------------------------------------------------------


def unwrap_envelope(line: Column) -> Column:
    """The event inside ``{"log": "<event json>"}``; other lines stay as they are."""
    trimmed = F.trim(line)
    wrapped = trimmed.contains('"log"') & ~trimmed.startswith('{"Event":')
    return F.when(wrapped, F.coalesce(F.trim(F.get_json_object(trimmed, "$.log")), trimmed)).otherwise(trimmed)


def truncate_field(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.lit("[TRUNCATED "), F.length(text).cast("string"), F.lit(" chars]"))).otherwise(text)


def properties_map(json: Column) -> Column:
    """Properties written as an object or as a list of pairs, as one map."""
    pairs = F.from_json(json, T.ArrayType(T.ArrayType(T.StringType())))
    from_pairs = F.map_from_entries(F.transform(F.filter(pairs, lambda p: F.size(p) >= 2), lambda p: F.struct(p[0], p[1])))
    return F.when(json.startswith("["), from_pairs).otherwise(F.from_json(json, T.MapType(T.StringType(), T.StringType())))


def flatten(frame: DataFrame) -> DataFrame:
    """Structs become ``parent_child`` columns and arrays are exploded until neither is left.

    The schema is walked on the driver; each round is one projection, and one generator per
    array. Rows with empty or missing arrays are kept with nulls.
    """
    while True:
        nested = {f.name: f.dataType for f in frame.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType))}
        if not nested:
            return frame
        structs = {n: t for n, t in nested.items() if isinstance(t, T.StructType)}
        if structs:
            columns = []
            for field in frame.schema.fields:
                if field.name in structs:
                    columns += [c(f"`{field.name}`.`{k}`").alias(f"{field.name}_{k}") for k in structs[field.name].names]
                else:
                    columns.append(c(f"`{field.name}`"))
            frame = frame.select(*columns)
        else:
            name = next(iter(nested))
            frame = frame.withColumn(name, F.explode_outer(c(f"`{name}`")))


# ---- XML ----------------------------------------------------------------------------------


def xml_record(xml: Column, schema: T.StructType) -> Column:
    """One parse of the whole document into a struct; attributes carry a leading underscore."""
    return F.from_xml(xml, schema, {"mode": "PERMISSIVE", "attributePrefix": "_", "ignoreNamespace": "true"})


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)
