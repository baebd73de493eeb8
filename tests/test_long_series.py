"""Queries take series of any length, as their SQL does."""

import pytest
from pyspark.sql import functions as F

from cadenza.plans.oracles import SQL
from cadenza.plans.registry import QUERIES
from tests.oracle import check, duck_rows


@pytest.fixture(scope="module")
def long_dir(spark, tmp_path_factory):
    """Events of a series of more than 86,400 cells, its climbs behind them, and of a short one."""
    folder = tmp_path_factory.mktemp("long")
    i = F.col("id")
    # every 701st event comes 6 s after the one before: such gaps stay open, so there is no climb among them
    long = spark.range(15_300).select(F.when(i < 14_480, 701 * i + 701).otherwise(701 * i + 1).alias("event_id"), i, F.lit(3).cast("long").alias("user_id"))
    short = spark.range(900).select((701 * i + 2).alias("event_id"), i, F.lit(13).cast("long").alias("user_id"))
    rows = long.unionByName(short).select(
        "event_id",
        F.timestamp_seconds(1_704_067_200 + i).cast("timestamp_ntz").alias("ts"),
        "user_id",
        F.lit("view").alias("event_type"),
        (100.0 + i % 7 + F.floor(i / 900) % 5).alias("value"),
        F.format_string('{"k": %d}', i * 7 % 100).alias("props"),
    )
    rows.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["climb_segments", "climb_trend", "climb_trend_hr"])
def test_long_series(spark, long_dir, name):
    assert check(spark, QUERIES[name], SQL[name], long_dir) >= 2
    assert {"r0", "r1"} <= {v for r in duck_rows(long_dir, SQL[name])[1] for v in r if isinstance(v, str)}
