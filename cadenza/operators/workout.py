"""Workout plans: lines of text to segments, segments to XML files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# An intensity named by a target, as a fraction of threshold power. The first that the target holds counts.
INTENSITY = {
    "very easy": 0.5,
    "easy": 0.6,
    "zone 1": 0.6,
    "zone 2": 0.75,
    "moderate": 0.75,
    "tempo": 0.85,
    "zone 3": 0.85,
    "threshold": 1.0,
    "zone 4": 1.0,
    "hard": 1.05,
    "zone 5": 1.1,
    "very hard": 1.15,
    "max": 1.2,
}
DEFAULT_INTENSITY = 0.75
# Fixed format: `- kind: 10 min at target [Cadence: 90, Notes: text]`.
LINE = r"(?i)^-\s*([^:]+):\s*([0-9]+)\s*(min|sec)\s*at\s*([^\[]+)(?:\[([^\]]+)\])?"


def intensity(target: Column) -> Column:
    """Fraction of threshold power: a percentage of FTP, else a named intensity, else DEFAULT_INTENSITY."""
    low = F.lower(target)
    out = F.when(low.rlike(r"[0-9]+%\s*ftp"), F.regexp_extract(low, r"([0-9]+)%\s*ftp", 1).cast("double") / 100)
    for name, power in INTENSITY.items():
        out = out.when(low.contains(name), F.lit(power))
    return out.otherwise(F.lit(DEFAULT_INTENSITY))


def segments(plans: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, kind, seconds, target, power, cadence, notes) of each line in the fixed format; other lines are skipped.

    A null or empty text has no segments. Durations too long for a long are null.
    """
    return segments_of_lines(plans.select(key, F.posexplode(F.split(text, "\n")).alias("place", "line")), key)


def segments_of_lines(lines: DataFrame, key: str) -> DataFrame:
    """segments() of plans that come as rows (key, place, line)."""
    lines = lines.where(F.col("line").rlike(LINE))
    part = lambda i: F.regexp_extract("line", LINE, i)
    count = part(2).try_cast("bigint")
    extras, target = part(5), F.trim(part(4))
    noted = F.trim(F.regexp_extract(extras, r"(?i)Notes:\s*(.+)", 1))
    return lines.select(
        key,
        "place",
        F.trim(part(1)).alias("kind"),
        F.when(F.lower(part(3)) == "min", count * 60).otherwise(count).alias("seconds"),
        target.alias("target"),
        intensity(target).alias("power"),
        F.nullif(F.regexp_extract(extras, r"(?i)Cadence:\s*([0-9]+)", 1).try_cast("int"), F.lit(0)).alias("cadence"),
        F.nullif(noted, F.lit("")).alias("notes"),
    )


def escaped(x: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(sign), F.lit(name))
    return x


def as_xml(found: DataFrame, key: str, author: str = "") -> DataFrame:
    """(key, xml): one workout file for each key that has segments, its segments in order of place."""
    attribute = lambda name, value: F.coalesce(F.concat(F.lit(f' {name}="'), value, F.lit('"')), F.lit(""))
    power = F.regexp_replace(F.col("power").cast("string"), r"\.0$", "")
    step = F.concat(
        F.lit("        <SteadyState"),
        attribute("Duration", F.col("seconds").cast("string")),
        attribute("Power", power),
        attribute("Cadence", F.col("cadence").cast("string")),
        F.when(F.lower("target").contains("ftp"), F.lit(' ShowsPower="1"')).otherwise(""),
        attribute("textEvent", escaped(F.col("notes"))),
        F.lit("/>"),
    )
    steps = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", step.alias("step")))), lambda x: x["step"]), "\n")
    # fixed format
    head = f"<workout_file>\n    <author>{author}</author>\n    <name>Generated Workout</name>\n    <description>Workout generated based on recent activities</description>\n    <sportType>bike</sportType>\n    <tags></tags>\n    <workout>\n"
    return found.groupBy(key).agg(F.concat(F.lit(head), steps, F.lit("\n    </workout>\n</workout_file>")).alias("xml"))


def save(files: DataFrame, key: str, path: str) -> None:
    """One text file for each key, in the folder `key=...` below path."""
    files.select(key, F.col("xml").alias("value")).write.partitionBy(key).text(path)
