"""Ordered operators over one series: prefix sums, trailing means, centred means, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from cadenza.functions.scalars import micro

KEY = "activity_id"
#: Samples of a task: windows over their cells, twice as many, take some 400 MB in the widest query.
TASK_SAMPLES = 50_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """How many tasks deal with so many samples; 0 where an even share for each core is small enough."""
    if rows <= TASK_SAMPLES * spark.sparkContext.defaultParallelism:
        return 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_SAMPLES))


def dealt(df: DataFrame, rows: int, by: str = KEY) -> DataFrame:
    """df by series, in so many tasks for its count of rows that a task's share doesn't grow with the table.

    A sample is small and its cells with their windows are wide, so tasks cut by the bytes shuffled would be too large. Windows
    by series need no other exchange. There are as many tasks as shuffle partitions at least, so that a join keeps them.
    """
    tasks = tasks_for(df.sparkSession, rows)
    return df.repartition(tasks, by) if tasks else df


def along(*order: str | Column, by: str = KEY) -> WindowSpec:
    return Window.partitionBy(by).orderBy(*(order or ("i",)))


def upto(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def prefixes(df: DataFrame, signal: str) -> DataFrame:
    """df with `s`, the running sum of the signal in millionths, and `ok`, the running count of valid cells."""
    w = upto(along())
    return df.withColumns({"s": F.sum(micro(F.col(signal))).over(w), "ok": F.sum(F.col("valid").cast("int")).over(w)})


def trailing_sum(size: int) -> Column:
    """Sum in millionths of the last `size` cells, null unless all of them are there and valid.

    A difference of prefix sums: its cost doesn't depend on the size.
    """
    w = along()
    whole = F.col("ok") - F.lag("ok", size, 0).over(w) == size
    return F.when(whole & (F.col("i") >= size - 1), F.col("s") - F.lag("s", size, 0).over(w))


def centred_mean(df: DataFrame, signal: str, window: int, out: str) -> DataFrame:
    """Mean over the cells around each one, the radius shrinking alike on both sides at the ends.

    Only valid cells count; without any the cell keeps its own value. Each mean is the difference of two running sums, looked
    up as many cells ahead and back as the radius says; near the ends that is less, so there is a look-up for each radius.
    """
    half, w = window // 2, along()
    sums = F.struct(F.sum(F.when(F.col("valid"), micro(F.col(signal)))).over(upto(w)).alias("s"), F.sum(F.col("valid").cast("int")).over(upto(w)).alias("n"))
    df = df.withColumns({"__sums": sums, "__n": F.count("*").over(Window.partitionBy(KEY))})
    found = {f"__up{k}": F.lead("__sums", k).over(w) for k in range(1, half + 1)} | {f"__low{k}": F.lag("__sums", k + 1).over(w) for k in range(half + 1)}
    radius = F.least(F.lit(half), F.col("i"), F.col("__n") - 1 - F.col("i"))
    df = df.withColumns(found | {"__r": radius})
    upper, lower = F.col("__sums"), F.col("__low0")
    for k in range(1, half + 1):
        upper, lower = (F.when(F.col("__r") == k, F.col(f"__{side}{k}")).otherwise(x) for side, x in (("up", upper), ("low", lower)))
    gone = lambda c: F.coalesce(upper[c], F.lit(0)) - F.coalesce(lower[c], F.lit(0))
    mean = F.when(gone("n") > 0, gone("s") / gone("n") / 1e6).otherwise(F.col(signal))
    return df.withColumn(out, mean).drop(*found, "__sums", "__n", "__r")
