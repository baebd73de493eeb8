"""Recorded series in JSON files, as one row a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.ordered import KEY
from cadenza.functions.scalars import truth

#: Names of the signals in the files.
NUMBERS = ("watts", "heartrate", "cadence", "altitude", "distance", "grade_smooth", "grade")
_WIDE = f"{KEY} string, device_watts boolean, start_date timestamp, streams struct<" + ", ".join(f"{n}: struct<data: array<string>>" for n in ("time", *NUMBERS, "moving")) + ">"
_LISTED = "type string, data array<string>"


def _long(rows: DataFrame, data: dict[str, Column], keep: list[str]) -> DataFrame:
    """One row a sample from a row's arrays; a signal that ends early, or isn't there, is null."""
    rows = rows.select(*keep, *[c.alias(f"_{n}") for n, c in data.items()]).select("*", F.posexplode("_time").alias("sample_idx", "t"))
    at = {n: F.get(F.col(f"_{n}"), F.col("sample_idx")) for n in data}
    number = {n: at[n].try_cast("double") for n in NUMBERS}
    number["grade"] = F.coalesce(number.pop("grade_smooth"), number["grade"])
    return rows.select(*keep, "sample_idx", F.col("t").try_cast("double").alias("t"), *[c.alias(n) for n, c in number.items()], truth(at["moving"]).alias("moving"))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """Samples of files that hold an activity each: its id, flags, and `streams` by name, each with `data`."""
    rows = spark.read.schema(_WIDE).json(path, multiLine=True)
    return _long(rows, {n: F.col(f"streams.{n}.data") for n in ("time", *NUMBERS, "moving")}, [KEY, "device_watts", "start_date"])


def read_listed_series(spark: SparkSession, path: str) -> DataFrame:
    """Samples of files that hold a list of {type, data}; the activity's id is the file's name up to its first dot."""
    rows = spark.read.schema(_LISTED).json(path, multiLine=True).withColumn(KEY, F.substring_index("_metadata.file_name", ".", 1))
    names = ("time", *NUMBERS, "moving")
    one = rows.groupBy(KEY).agg(*[F.first(F.when(F.col("type") == n, F.col("data")), ignorenulls=True).alias(n) for n in names])
    return _long(one, {n: F.col(n) for n in names}, [KEY])
