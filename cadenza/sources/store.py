"""A store of aligned cells: bucketed and sorted by activity, filled by what is new or changed."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadenza.functions.ordered import KEY
from cadenza.operators import align, records
from cadenza.sources.shared import written

#: Grows when alignment changes, so that older cells are no longer read.
VERSION = 1
BUCKETS = 32
#: Entries and bytes that a trimmed store keeps.
KEEP_ENTRIES, KEEP_BYTES = 200, 128 << 20


def types_key(signals: Sequence[str]) -> str:
    """Eight hex digits that name a set of signals, see scalars.types_key()."""
    return hashlib.sha1(",".join(sorted(signals)).encode()).hexdigest()[:8]


class CellStore:
    """Cells of align.align() by activity, set of signals and version, in a folder that driver and executors share.

    Two tables share one bucketing by activity: cells, each with the number of the fill that wrote it, and an index, a row for
    each filling or removal of an activity, with a digest of its samples. The newest index row of an activity says which of its
    cells count, so a fill only appends: cells first and index last, and one that breaks off in between leaves nothing that is
    read. Reading joins both without an exchange, and what groups or windows by activity next needs none either.

    Every session that names the same folder, signals and buckets finds the same tables. One writer at a time; readers see
    the fills that ended before they began.
    """

    def __init__(self, spark: SparkSession, folder: str, signals: Sequence[str] = align.SIGNALS, gap_fill: int = align.GAP_FILL, buckets: int = BUCKETS) -> None:
        self.spark, self.signals, self.gap_fill, self.buckets = spark, tuple(signals), gap_fill, buckets
        place = f"{types_key(signals)}-g{gap_fill}-b{buckets}-v{VERSION}"
        self.root = f"{folder.rstrip('/')}/{place}"
        self.name = f"cadenza_{hashlib.sha1(self.root.encode()).hexdigest()[:12]}"
        none = spark.createDataFrame([], f"{KEY} string, sample_idx bigint, t double, {', '.join(f'{s} double' for s in signals)}, moving boolean")
        self.kept = align.align(none, self.signals, gap_fill, moving=True).schema
        self._table("cells", StructType(list(self.kept.fields)).add("fill", "long"), f"{KEY}, i")
        self._table("index", StructType().add(KEY, "string").add("digest", "string").add("cells", "long").add("fill", "long"), KEY)

    def _table(self, kind: str, schema: StructType, order: str) -> None:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name}_{kind} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({order}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{kind}'")
        self.spark.catalog.refreshTable(f"{self.name}_{kind}")

    def _append(self, df: DataFrame, kind: str, order: Sequence[str]) -> None:
        table = self.spark.table(f"{self.name}_{kind}")
        df.select(*table.columns).write.format("parquet").mode("append").bucketBy(self.buckets, KEY).sortBy(*order).saveAsTable(f"{self.name}_{kind}")

    def index(self) -> DataFrame:
        """(activity_id, digest, cells, fill) of the activities that the store holds."""
        newest = F.max_by(F.struct("digest", "cells", "fill"), "fill")
        rows = self.spark.table(f"{self.name}_index").groupBy(KEY).agg(newest.alias("x")).select(KEY, "x.*")
        return rows.where("digest is not null")

    def cells(self) -> DataFrame:
        """What align.align() gives for the samples of all activities in the store."""
        held = self.index().select(KEY, F.col("fill").alias("__fill"))
        # a difference, as an equation would become a key of the join, which then no longer fits the tables' bucketing
        rows = self.spark.table(f"{self.name}_cells").join(held, KEY).where(F.col("fill") - F.col("__fill") == 0)
        return rows.select(*self.kept.names)

    def digests(self, samples: DataFrame) -> DataFrame:
        """(activity_id, digest): the count of an activity's samples and a sum of their hashes, whatever their order."""
        parts = F.xxhash64("sample_idx", "t", *self.signals, "moving").cast("decimal(38,0)")
        return samples.groupBy(KEY).agg(F.concat_ws(":", F.count("*"), F.sum(parts)).alias("digest"))

    def stale(self, samples: DataFrame) -> DataFrame:
        """(activity_id, digest) of the activities in samples that the store lacks, or holds with other samples."""
        return self.digests(samples).join(self.index().select(KEY, "digest"), [KEY, "digest"], "left_anti")

    def fill(self, samples: DataFrame) -> DataFrame:
        """Align what is new or changed in samples, and nothing else; gives (activity_id, digest, cells, fill) of that.

        samples has (activity_id, sample_idx, t, signals..., moving). Series that are too long or have no usable time are noted
        with 0 cells, so they aren't tried again.
        """
        number = time.time_ns() // 1000
        stale = written(self.stale(samples), "stale")  # a row a series, read twice, so that samples are digested once
        fresh = samples.repartition(self.buckets, KEY).join(stale.select(KEY), KEY, "left_semi")
        rows = align.align(fresh, self.signals, self.gap_fill, moving=True).withColumn("fill", F.lit(number))
        self._append(rows, "cells", (KEY, "i"))
        made = self.spark.table(f"{self.name}_cells").where(F.col("fill") == number).groupBy(KEY).agg(F.count("*").alias("cells"))
        entries = stale.join(made, KEY, "left").select(KEY, "digest", F.coalesce("cells", F.lit(0)).alias("cells"), F.lit(number).alias("fill"))
        self._append(entries.repartition(self.buckets, KEY), "index", (KEY,))
        return self.spark.table(f"{self.name}_index").where(F.col("fill") == number)

    def forget(self, ids: DataFrame) -> None:
        """Drop activities; their next fill aligns them anew."""
        none = ids.select(KEY).distinct().select(KEY, F.lit(None).cast("string").alias("digest"), F.lit(0).cast("bigint").alias("cells"), F.lit(time.time_ns() // 1000).alias("fill"))
        self._append(none, "index", (KEY,))

    def trim(self, most: int = KEEP_ENTRIES, most_bytes: int = KEEP_BYTES) -> None:
        """Keep the activities filled last, as many as stay within both limits; a cell counts 8 bytes for each signal."""
        sized = self.index().withColumn("bytes", F.col("cells") * (8 * len(self.signals)))
        kept = records.kept_newest(sized, F.col("fill"), F.col("bytes"), KEY, most, most_bytes)
        self.forget(self.index().join(kept.select(KEY), KEY, "left_anti"))
