"""What the corpus operators share: shared-folder tables, ordered ranges and word patterns."""

from __future__ import annotations

import contextlib
import ctypes
import json
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='cadenza-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cadenza/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() gave, once nothing reads them any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranges(df: DataFrame, col: str, tie: str, rows_per_range: int = 500) -> tuple[Column, int]:
    """A deterministic range number for each row by (col, tie), ascending, nulls first, and the count of ranges.

    There are as many ranges as the session has shuffle partitions, fewer for small tables. A value that many rows have,
    null among them, takes several ranges, its rows dealt by tie, a 64-bit hash. Only the cuts reach the driver.
    """
    n, nulls = df.agg(F.count("*"), F.count_if(F.col(col).isNull())).first()
    count = max(1, min(partitions(df.sparkSession), n // rows_per_range))
    first = max(1, round(count * nulls / max(1, n)))
    cuts = df.agg(F.percentile_approx(col, [i / count for i in range(1, count)] or [0.5], 10 * count + 100).alias("c")).first()["c"] or []
    literal = F.from_json(F.lit(json.dumps(sorted(cuts))), "array<bigint>")
    # How many cuts are below the value; a binary search folded over the bits of the position.
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, len(cuts).bit_length())))])
    below = lambda hit: F.aggregate(
        steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & hit(F.get(literal, at + step - 1)), at + step).otherwise(at)
    )
    share = F.col(tie) / float(1 << 64) + 0.5
    at, upto = below(lambda cut: cut < F.col(col)), below(lambda cut: cut <= F.col(col))
    same = F.floor(share * (upto - at)).cast("int")
    place = F.when(F.col(col).isNull(), F.least(F.floor(share * first).cast("int"), F.lit(first - 1))).otherwise(first + at + F.least(same, F.greatest(upto - at - 1, F.lit(0))))
    return place, first + len(cuts) + 1


def partitions_of(df: DataFrame, size: int) -> DataFrame:
    """df with input splits put together to about `size` bytes a task, if that leaves two tasks a core."""
    conf = df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes").lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(conf[-1:], 0)
    split = int(conf.rstrip("kmg")) << unit
    together = max(1, size // max(1, split))
    tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions() // together)
    return df.coalesce(tasks)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), f)[0]


def release() -> None:
    """At the end of a task: give freed memory back, as idle Python workers stay beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def running(df: DataFrame, by: list[str], order: list, value: str) -> Column:
    """Sum of value over the rows before this one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))
