"""Records as they are asked for: one by its id, a person's collections, efforts of a period, with derived units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import decoded, joined, km, kmh, miles, pace, rnd


def by_id(rows: DataFrame, column: str, wanted: int | str) -> DataFrame:
    """The row of an id, which reaches the scan as a filter; ids are whole numbers or their digits."""
    digits = str(wanted).strip()
    if not digits.isascii() or not digits.isdigit():
        raise ValueError(f"{wanted!r} is no id")
    return rows.where(F.col(column) == F.lit(int(digits)))


def in_period(rows: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows whose local time lies in a period, both ends included; an end that isn't given is open."""
    if start is not None:
        rows = rows.where(F.col(column) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.where(F.col(column) <= F.lit(end).cast("timestamp_ntz"))
    return rows


def details(rows: DataFrame, metres: Column, seconds: Column, running: Column) -> DataFrame:
    """rows with kilometres, km/h, and for runs the pace; null where nothing moved."""
    speed = metres / F.nullif(seconds, F.lit(0))
    return rows.withColumns({"km": rnd(km(metres), 2), "kmh": rnd(kmh(speed), 1), "pace": F.when(running, pace(speed))})


def laps(rows: DataFrame, by: str, place: str, metres: Column, seconds: Column) -> DataFrame:
    """A row for each lap, numbered from 1 in their order, with kilometres, km/h and the kilometres up to its end."""
    w = Window.partitionBy(by).orderBy(place)
    rows = rows.withColumn("lap", F.row_number().over(w)).withColumn("__m", metres)
    rows = rows.withColumn("total_km", rnd(km(F.sum("__m").over(w)), 2))
    return rows.withColumns({"km": rnd(km(F.col("__m")), 2), "kmh": rnd(kmh(F.col("__m") / F.nullif(seconds, F.lit(0))), 1)}).drop("__m")


def zones(rows: DataFrame, column: str) -> DataFrame:
    """A row for each zone of a list of struct<min, max>, counted from 1; a top of -1, or none, is open."""
    out = rows.select(*[c for c in rows.columns if c != column], F.posexplode(column).alias("__at", "__z"))
    top = F.when(F.col("__z.max") != -1, F.col("__z.max"))
    return out.withColumns({"zone": F.col("__at") + 1, "lower": F.col("__z.min"), "upper": top}).drop("__at", "__z")


def gear(rows: DataFrame, column: str) -> DataFrame:
    """A row for each item of a list of struct<name, distance, primary>, with its kilometres and the count of the owner's items."""
    out = rows.withColumn("items", F.size(column))
    out = out.select(*[c for c in out.columns if c != column], F.explode(column).alias("__g"))
    return out.withColumns({"name": F.col("__g.name"), "km": rnd(km(F.col("__g.distance")), 2), "primary": F.col("__g.primary")}).drop("__g")


def starred(rows: DataFrame, flag: str, metres: Column, metric: Column) -> DataFrame:
    """Starred rows with their length in the owner's unit: kilometres, or miles."""
    length = F.when(metric, rnd(km(metres), 2)).otherwise(rnd(miles(metres), 2))
    return rows.where(F.col(flag)).withColumns({"length": length, "unit": F.when(metric, "km").otherwise("mi")})


#: Names of a route's type.
ROUTE_TYPES = {1: "Ride", 2: "Run"}
#: Routes of a page at most.
ROUTES_PAGE = 50


def routes(rows: DataFrame, by: str, number: int, size: int, *order: Column | str) -> DataFrame:
    """One page, from 1, of each owner's routes (by, metres, climbed, type, segments array, ...), with `place`, `pages`, km, gain_m,
    kind and segment_count (null without a list). A page that an owner doesn't have gives no rows."""
    if number < 1 or not 1 <= size <= ROUTES_PAGE:
        raise ValueError(f"pages are counted from 1 and hold {ROUTES_PAGE} routes at most")
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    pages = F.ceil(F.count("*").over(Window.partitionBy(by)) / size).cast("int")
    rows = rows.withColumns({"place": place, "pages": pages}).where(F.col("place").between((number - 1) * size + 1, number * size))
    return route_details(rows)


def route_details(rows: DataFrame) -> DataFrame:
    """Routes with km (1 decimal), gain_m (whole), kind and segment_count in place of metres, climbed, type and segments."""
    count = F.when(F.col("segments").isNotNull(), F.size("segments").cast("bigint"))
    shown = {"km": rnd(km(F.col("metres")), 1), "gain_m": rnd(F.col("climbed"), 0), "kind": decoded(F.col("type"), ROUTE_TYPES, "Other"), "segment_count": count}
    return rows.withColumns(shown).drop("metres", "climbed", "type", "segments")


def clubs(rows: DataFrame) -> DataFrame:
    """Clubs (club_id, name, sports array, members, city, state, country, private) with their sports and location as text."""
    place = joined(F.col("city"), F.col("state"), F.col("country"))
    return rows.select("club_id", "name", F.array_join(F.array_sort(F.array_distinct("sports")), ", ").alias("sports"), "members", place.alias("location"), "private")
