"""Scalar column functions: rounding, units, durations, dates, ids, text and clean-up of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructField, StructType


def rnd(x: Column, digits: int = 0) -> Column:
    """Half up, towards plus infinity; a double."""
    f = float(10**digits)
    return F.floor(x * f + 0.5).cast("double") / f


def micro(x: Column) -> Column:
    """Fixed point in millionths: sums of it don't depend on the order of rows."""
    return F.floor(x * 1e6 + 0.5).cast("bigint")


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def km(metres: Column) -> Column:
    return metres / 1000.0


def miles(metres: Column) -> Column:
    return metres / 1609.344


def feet(metres: Column) -> Column:
    return metres * 3.28084


def kmh(metres_per_second: Column) -> Column:
    return metres_per_second * 3.6


def clock(seconds: Column) -> Column:
    """HH:MM:SS, hours beyond 24 counted on."""
    s = F.floor(seconds).cast("bigint")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(s / 3600).cast("bigint")
    wide = F.when(hours < 100, two(hours)).otherwise(hours.cast("string"))
    return F.concat_ws(":", wide, two(F.floor(s % 3600 / 60).cast("bigint")), two(s % 60))


def time_of_day(seconds: Column) -> Column:
    """HH:MM:SS within one day."""
    return clock(F.floor(seconds).cast("bigint") % 86400)


def short_duration(seconds: Column) -> Column:
    """`2h 5m`, or `5m` under an hour."""
    s = F.floor(seconds).cast("bigint")
    h, m = F.floor(s / 3600).cast("bigint").cast("string"), F.floor(s % 3600 / 60).cast("bigint").cast("string")
    return F.when(s >= 3600, F.concat(h, F.lit("h "), m, F.lit("m"))).otherwise(F.concat(m, F.lit("m")))


def pace(metres_per_second: Column) -> Column:
    """Minutes for a kilometre as m:ss; null when standing still."""
    per_km = F.when(metres_per_second > 0, F.floor(1000.0 / metres_per_second + 0.5).cast("bigint"))
    return F.concat(F.floor(per_km / 60).cast("bigint").cast("string"), F.lit(":"), F.lpad((per_km % 60).cast("string"), 2, "0"))


def day(x: Column) -> Column:
    return F.to_date(x)


def local_text(x: Column) -> Column:
    """MM/DD/YYYY, HH:MM of a local time, never shifted between zones."""
    return F.date_format(x, "MM/dd/yyyy, HH:mm")


def shortened(x: Column, most: int = 100) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x)


def joined(*parts: Column, by: str = ", ") -> Column:
    """Parts that are neither null nor empty."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), by)


def valid_id(x: Column) -> Column:
    """The trimmed digits of an id, null for anything else; ids stay strings."""
    t = F.trim(x.cast("string"))
    return F.when(t.rlike("^[0-9]+$"), t)


def truth(x: Column) -> Column:
    """Booleans and the texts true and false; null for anything else."""
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t == "true", F.lit(True)).when(t == "false", F.lit(False))


def one_of(x: Column, values: list[str]) -> Column:
    """Membership whatever the case of letters."""
    return F.lower(x).isin([v.lower() for v in values])


def types_key(types: Column) -> Column:
    """Eight hex digits that name a set of series types."""
    return F.substring(F.sha1(F.array_join(F.array_sort(types), ",")), 1, 8)


def decoded(x: Column, names: dict[int, str], other: str) -> Column:
    """The name of a code, `other` for a code without one, null for null."""
    out = F.when(x.isNotNull(), F.lit(other))
    for code, name in names.items():
        out = F.when(x == code, name).otherwise(out)
    return out


def entries(df: DataFrame, column: str, key: str, value: str) -> DataFrame:
    """A row for each entry of a map column; rows with an empty or null map go."""
    return df.select(*[c for c in df.columns if c != column], F.explode(F.map_entries(column)).alias("__e")).select("*", F.col("__e.key").alias(key), F.col("__e.value").alias(value)).drop("__e")


def compact(x: Column) -> Column:
    """JSON without spaces."""
    return F.to_json(x)


def pretty(x: Column) -> Column:
    """JSON over indented lines."""
    return F.to_json(x, {"pretty": "true"})


def _clean(x: Column, kind: DataType) -> Column:
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~(F.isnan(x) | (F.abs(x) == float("inf"))), x)
    if isinstance(kind, ArrayType):
        return F.transform(x, lambda y: _clean(y, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(x, lambda _, y: _clean(y, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(x.isNotNull(), F.struct(*[_clean(x.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    return x


def _odd(x: Column, kind: DataType, path: Column) -> Column:
    """Paths of the numbers in x that aren't finite, with what they are."""
    if isinstance(kind, (DoubleType, FloatType)):
        what = F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity")
        return F.when(what.isNotNull(), F.array(F.concat(path, F.lit(": "), what))).otherwise(F.array().cast("array<string>"))
    if isinstance(kind, ArrayType):
        return F.flatten(F.transform(F.coalesce(x, F.array().cast(kind)), lambda y, k: _odd(y, kind.elementType, F.concat(path, F.lit("["), k.cast("string"), F.lit("]")))))
    if isinstance(kind, MapType):
        entries = F.coalesce(F.map_entries(x), F.array().cast(ArrayType(StructType([StructField("key", kind.keyType), StructField("value", kind.valueType)]))))
        return F.flatten(F.transform(entries, lambda e: _odd(e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"].cast("string")))))
    return F.concat(*[_odd(x.getField(f.name), f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields if _numbers(f.dataType)])


def _numbers(kind: DataType) -> bool:
    """Whether a type holds doubles or floats, map keys apart."""
    if isinstance(kind, StructType):
        return any(_numbers(f.dataType) for f in kind.fields)
    inner = kind.elementType if isinstance(kind, ArrayType) else kind.valueType if isinstance(kind, MapType) else None
    return _numbers(inner) if inner is not None else isinstance(kind, (DoubleType, FloatType))


def sanitized(df: DataFrame, changed: str = "changed") -> DataFrame:
    """df with null for each NaN or infinite number, at any depth of structs, arrays and map values, and `changed`, an array of
    their paths: `metrics.curve[3]: NaN`.

    The schema says what to visit, so the rewrite is one expression a column; columns without doubles or floats stay as they
    are, and so do map keys, null structs, arrays and maps, and 0.
    """
    odd = [_odd(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name)) for f in df.schema.fields if _numbers(f.dataType)]
    clean = [(_clean(F.col(f"`{f.name}`"), f.dataType) if _numbers(f.dataType) else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields]
    return df.select(*clean, (F.concat(*odd) if odd else F.array().cast("array<string>")).alias(changed))
