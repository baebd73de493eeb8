"""Route files: tracks as GPX and TCX, a file for each route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.workout import escaped


def _degrees(x: Column) -> Column:
    return F.format_string("%.6f", x.cast("double"))


def _in_order(points: DataFrame, key: str, one: Column) -> DataFrame:
    track = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", one.alias("point")))), lambda p: p["point"]), "")
    return points.where("lat is not null and lng is not null").groupBy(key).agg(track.alias("points"))


def track_points(points: DataFrame, key: str) -> DataFrame:
    """(key, points): the track points (key, place, lat, lng, maybe altitude) of each route as GPX elements, in order of place.

    Points without a position are left out. A route's points are gathered in one row, as its file is one text.
    """
    height = F.coalesce(F.concat(F.lit("<ele>"), F.col("altitude").cast("string"), F.lit("</ele>")), F.lit("")) if "altitude" in points.columns else F.lit("")
    start = F.concat(F.lit('<trkpt lat="'), _degrees(F.col("lat")), F.lit('" lon="'), _degrees(F.col("lng")), F.lit('"'))
    one = F.when(height == "", F.concat(start, F.lit("/>"))).otherwise(F.concat(start, F.lit(">"), height, F.lit("</trkpt>")))
    return _in_order(points, key, one)


def gpx(points: DataFrame, key: str, name: Column) -> DataFrame:
    """(key, file, text): a GPX file for each route; name is a column of the key."""
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>'
    text = F.concat(F.lit(head), escaped(name), F.lit("</name><trkseg>"), "points", F.lit("</trkseg></trk></gpx>"))
    return track_points(points, key).select(key, F.concat(F.lit("route-"), F.col(key).cast("string"), F.lit(".gpx")).alias("file"), text.alias("text"))


def tcx(points: DataFrame, key: str, name: Column) -> DataFrame:
    """(key, file, text): a TCX course for each route."""
    one = F.concat(
        F.lit("<Trackpoint><Position><LatitudeDegrees>"), _degrees(F.col("lat")), F.lit("</LatitudeDegrees><LongitudeDegrees>"), _degrees(F.col("lng")), F.lit("</LongitudeDegrees></Position></Trackpoint>")
    )
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<TrainingCenterDatabase xmlns="http://www.garmin.com/xmlschemas/TrainingCenterDatabase/v2"><Courses><Course><Name>'
    text = F.concat(F.lit(head), escaped(name), F.lit("</Name><Track>"), "points", F.lit("</Track></Course></Courses></TrainingCenterDatabase>"))
    return _in_order(points, key, one).select(key, F.concat(F.lit("route-"), F.col(key).cast("string"), F.lit(".tcx")).alias("file"), text.alias("text"))


def save(files: DataFrame, path: str) -> None:
    """One text file for each route, in the folder `file=...` below path."""
    files.select("file", F.col("text").alias("value")).write.partitionBy("file").text(path)
