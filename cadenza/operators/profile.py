"""Effective-dated parameters: as-of lookup, integrity checks and upserts."""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator, Sequence
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType


#: The unit and the plausible range of each metric.
METRICS = {
    "ftp_w": ("W", 50.0, 600.0),
    "weight_kg": ("kg", 30.0, 200.0),
    "hr_max_bpm": ("bpm", 120.0, 230.0),
    "hr_threshold_bpm": ("bpm", 100.0, 210.0),
    "aet_power_w": ("W", 50.0, 500.0),
    "aet_hr_bpm": ("bpm", 80.0, 200.0),
    "map_w": ("W", 100.0, 700.0),
}
#: Metrics that must rise in this order where their windows overlap.
HEART_ORDER = ("aet_hr_bpm", "hr_threshold_bpm", "hr_max_bpm")
SCHEMA = "metric string, value double, unit string, effective_from date, effective_to date, source string"
#: An athlete's rows are dealt to this many tasks, the entries going to each.
SALTS = 8


def as_of(rows: DataFrame, profile: DataFrame, by: Sequence[str], day: str, salts: int = SALTS) -> DataFrame:
    """rows with `value` and `effective_from` of the entry that covers their day.

    profile has (by, value, effective_from, effective_to), without overlaps (see overlaps()); both ends count, a
    null end is open. Rows without a covering entry get nulls, never the current value. Entries and rows are
    sorted together and each row takes the last entry before it, so nothing is multiplied but the entries, by salts.
    """
    entry = F.struct("effective_from", "value", "effective_to")
    empty = F.lit(None).cast(profile.select(entry.alias("x")).schema["x"].dataType)
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    no_row = F.lit(None).cast(rows.select(row.alias("x")).schema["x"].dataType)
    left = rows.select(*by, F.col(day).alias("__day"), F.lit(1).alias("__kind"), F.pmod(F.xxhash64(row), F.lit(salts)).cast("int").alias("__salt"), row.alias("__row"), empty.alias("__entry"))
    right = profile.select(*by, F.col("effective_from").alias("__day"), F.lit(0).alias("__kind"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"), no_row.alias("__row"), entry.alias("__entry"))
    w = Window.partitionBy(*by, "__salt").orderBy("__day", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("__last", F.last("__entry", ignorenulls=True).over(w)).where("__kind = 1")
    covers = F.col("__last.effective_to").isNull() | (F.col("__day") <= F.col("__last.effective_to"))
    found = lambda c: F.when(covers, F.col(f"__last.{c}")).alias(c)
    return both.select("__row.*", found("value"), found("effective_from"))


def as_of_all(rows: DataFrame, profile: DataFrame, by: Sequence[str], day: str, metrics: Sequence[str]) -> DataFrame:
    """rows with a column for each metric, as of their day; profile has a `metric` column."""
    each = rows.withColumn("metric", F.explode(F.array(*map(F.lit, metrics))))
    found = as_of(each, profile, [*by, "metric"], day).drop("effective_from")
    return found.groupBy(*rows.columns).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])


def load(spark: SparkSession, path: str) -> DataFrame:
    """The entries of profile files, each a JSON object with `metrics`; a malformed file raises."""
    rows = spark.read.schema(f"metrics array<struct<{SCHEMA.replace(' string', ': string').replace(' double', ': double').replace(' date', ': date')}>>")
    return rows.option("mode", "FAILFAST").json(path, multiLine=True).select(F.inline("metrics"))


def save(profile: DataFrame, path: str) -> None:
    """profile as a JSON file of that form, if it has neither invalid nor overlapping entries."""
    if not violations(profile).isEmpty() or not overlaps(profile, ["metric"]).isEmpty():
        raise ValueError("the profile has invalid or overlapping entries")
    one = profile.agg(F.array_sort(F.collect_list(F.struct(*[c.split()[0] for c in SCHEMA.split(", ")]))).alias("metrics"))
    one.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def with_defaults(entries: DataFrame) -> DataFrame:
    """Entries that begin today, stay open and come by hand where they don't say otherwise."""
    return entries.withColumns({"effective_from": F.coalesce("effective_from", F.current_date()), "source": F.coalesce("source", F.lit("manual"))})


def violations(entries: DataFrame) -> DataFrame:
    """entries that break a rule, with its `problem`: unknown_metric, unit, range or order of dates, the first that applies."""
    spec = F.create_map(*[F.lit(x) for m, (unit, lo, hi) in METRICS.items() for x in (m, f"{unit}:{lo}:{hi}")])
    parts = F.split(F.try_element_at(spec, F.col("metric")), ":")
    value = F.col("value")
    outside = value.isNull() | F.isnan(value) | (value < parts[1].cast("double")) | (value > parts[2].cast("double"))
    problem = (
        F.when(F.col("metric").isNull() | ~F.coalesce(F.col("metric").isin(list(METRICS)), F.lit(False)), "unknown_metric")
        .when(~F.col("unit").eqNullSafe(parts[0]), "unit")
        .when(outside, "range")
        .when(F.col("effective_from").isNull() | (F.col("effective_to") < F.col("effective_from")), "dates")
    )
    return entries.withColumn("problem", problem).where("problem is not null")


def estimated(source: Column) -> Column:
    """Whether a value was estimated from a twenty minutes' effort in power."""
    return source.eqNullSafe(F.lit("estimated_20min"))


def resolved(override: Column, value: Column) -> tuple[Column, Column]:
    """An override before the profile's value, and where it came from."""
    return F.coalesce(override, value), F.when(override.isNotNull(), "override").when(value.isNotNull(), "profile").otherwise("missing_parameter")


def resolved_as_of(rows: DataFrame, profile: DataFrame, by: Sequence[str], day: str, override: str) -> DataFrame:
    """rows with value, source, effective_from, estimated and status: the override where a row has one, else the entry as of its day.

    profile has (by, value, source, effective_from, effective_to). source is override, the entry's, or null; status is override,
    profile or missing_parameter. Only an entry's value can be an estimate; values never come from another day's entry.
    """
    entries = profile.select(*by, "effective_from", "effective_to", F.struct("value", "source").alias("value"))
    found = as_of(rows, entries, by, day).withColumnRenamed("value", "__entry")
    value, status = resolved(F.col(override), F.col("__entry.value"))
    own = F.col(override).isNotNull()
    return found.select(
        *rows.columns,
        value.alias("value"),
        F.when(own, F.lit("override")).otherwise(F.col("__entry.source")).alias("source"),
        F.when(~own, F.col("effective_from")).alias("effective_from"),
        (~own & estimated(F.col("__entry.source"))).alias("estimated"),
        status.alias("status"),
    )


def overlaps(profile: DataFrame, by: Sequence[str]) -> DataFrame:
    """Entries whose window reaches the start of the next one of the same parameter; an open one blocks all later."""
    w = Window.partitionBy(*by).orderBy("effective_from")
    rows = profile.withColumn("next_from", F.lead("effective_from").over(w))
    return rows.where(F.col("next_from").isNotNull() & (F.col("effective_to").isNull() | (F.col("effective_to") >= F.col("next_from"))))


class Active:
    """Entries of one athlete that are open on the sweep's day, by place and value."""

    def __init__(self, places: int) -> None:
        self.by_value: list[list[tuple]] = [[] for _ in range(places)]
        self.ends: list[tuple] = []

    def expire(self, day: date) -> None:
        while self.ends and self.ends[0][0] < day:
            _, key, place = heapq.heappop(self.ends)
            at = bisect.bisect_left(self.by_value[place], key)
            del self.by_value[place][at]

    def add(self, place: int, key: tuple, until: date) -> None:
        bisect.insort(self.by_value[place], key)
        heapq.heappush(self.ends, (until, key, place))

    def broken(self, place: int, value: float) -> Iterator[tuple[tuple, bool]]:
        """Open entries that an entry of this place and value breaks the order with, and whether theirs is the lower place."""
        for other, entries in enumerate(self.by_value):
            if other < place:
                yield from ((e, True) for e in entries[bisect.bisect_left(entries, (value,)) :])
            elif other > place:
                yield from ((e, False) for e in entries[: bisect.bisect_left(entries, (value, float("inf")))])


def _sweep(batches: Iterator[pa.RecordBatch], keys: int, order: Sequence[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pairs that break the order, of rows (keys..., metric, value, from, to) sorted by keys and from."""
    places, now, active, number, out = {m: k for k, m in enumerate(order)}, None, Active(len(order)), 0, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key, (metric, value, start, end) = row[:keys], row[keys:]
            if key != now:
                now, active = key, Active(len(order))
            number += 1  # tells equal values apart, so rows themselves are never compared
            active.expire(start)
            for (_, _, other), lower in active.broken(places[metric], value):
                a, b = (other, row[keys:]) if lower else (row[keys:], other)
                out.append((*key, *a, *b))
                if len(out) >= 10_000:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
            active.add(places[metric], (value, number, row[keys:]), end or date.max)
    if out:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def order_violations(profile: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Pairs of entries with overlapping windows whose metrics must rise in the given order and don't.

    profile has (by, metric, value, effective_from, effective_to), a null end being open. Rows with a null key, value or start, NaN, or
    an end before their start take part in no pair. An athlete's entries are swept in the order of their starts; those that are open are kept sorted by
    value, so an entry meets only those it breaks the order with: the work grows with entries and pairs, what is
    held with the entries open at a time.
    """
    columns = ("metric", "value", "effective_from", "effective_to")
    known = F.coalesce(F.col("effective_to") >= F.col("effective_from"), F.lit(True))
    for c in (*by, "value", "effective_from"):
        known &= F.col(c).isNotNull()
    rows = profile.where(F.col("metric").isin(list(order)) & known & ~F.isnan("value")).select(*by, "metric", F.col("value").cast("double").alias("value"), "effective_from", "effective_to")
    rows = rows.repartition(*by).sortWithinPartitions(*by, "effective_from")
    fields = [rows.schema[c] for c in by] + [StructField(f"{c}_{s}", rows.schema[c].dataType) for s in "ab" for c in columns]
    schema = StructType(fields)
    arrow = to_arrow_schema(schema)
    return rows.mapInArrow(lambda it: _sweep(it, len(by), order, arrow), schema)


def upserted(profile: DataFrame, entry: DataFrame, by: Sequence[str], close_previous: bool = True, overwrite: bool = True) -> DataFrame:
    """profile with the entries in place of those of the same key and start; the open entry before each ends the day before.

    Without overwrite an entry whose key and start are taken already is left out; taken() lists these.
    """
    keys = [*by, "effective_from"]
    if overwrite:
        both = profile.join(entry.select(*keys), keys, "left_anti").select(*entry.columns, F.lit(False).alias("new")).unionByName(entry.withColumn("new", F.lit(True)))
    else:
        both = profile.select(*entry.columns, F.lit(False).alias("new")).unionByName(entry.join(profile.select(*keys), keys, "left_anti").select(*entry.columns, F.lit(True).alias("new")))
    if close_previous:
        w = Window.partitionBy(*by).orderBy("effective_from")
        cut = F.lead("new").over(w) & F.col("effective_to").isNull()
        both = both.withColumn("effective_to", F.when(cut, F.date_sub(F.lead("effective_from").over(w), 1)).otherwise(F.col("effective_to")))
    return both.drop("new")


def taken(profile: DataFrame, entry: DataFrame, by: Sequence[str]) -> DataFrame:
    """The entries whose key and start the profile has already."""
    return entry.join(profile.select(*by, "effective_from").distinct(), [*by, "effective_from"], "left_semi")
