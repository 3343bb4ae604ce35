"""Geography on a sphere: points as struct(lon, lat) in degrees, lines and rings as arrays of points; lengths in metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evenkeel.functions.warehouse import col

#: Metres.
RADIUS = 6371008.8


def point(lon, lat) -> Column:
    """ST_GEOGPOINT; null where a coordinate is null or outside its range."""
    x, y = col(lon).cast("double"), col(lat).cast("double")
    return F.when((F.abs(x) <= 180) & (F.abs(y) <= 90), F.struct(x.alias("lon"), y.alias("lat")))


def as_text(p) -> Column:
    """ST_ASTEXT of a point, with whole numbers without decimals."""
    number = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    return F.concat(F.lit("POINT("), number(col(p)["lon"]), F.lit(" "), number(col(p)["lat"]), F.lit(")"))


def from_text(c) -> Column:
    """ST_GEOGFROMTEXT of a point; null where the text is none."""
    part = lambda i: F.regexp_extract(col(c), r"(?i)^\s*POINT\s*\(\s*(-?[0-9.eE+-]+)\s+(-?[0-9.eE+-]+)\s*\)\s*$", i).try_cast("double")
    return point(part(1), part(2))


def distance(a, b) -> Column:
    """ST_DISTANCE: along the great circle."""
    a, b = col(a), col(b)
    h = F.pow(F.sin(F.radians(b["lat"] - a["lat"]) / 2), 2) + F.cos(F.radians(a["lat"])) * F.cos(F.radians(b["lat"])) * F.pow(F.sin(F.radians(b["lon"] - a["lon"]) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def within(a, b, metres) -> Column:
    """ST_DWITHIN."""
    return distance(a, b) <= metres


def azimuth(a, b) -> Column:
    """ST_AZIMUTH: radians from north, clockwise, from 0 up to two pi; null between equal points."""
    a, b = col(a), col(b)
    step = F.radians(b["lon"] - a["lon"])
    y = F.sin(step) * F.cos(F.radians(b["lat"]))
    x = F.cos(F.radians(a["lat"])) * F.sin(F.radians(b["lat"])) - F.sin(F.radians(a["lat"])) * F.cos(F.radians(b["lat"])) * F.cos(step)
    angle = F.atan2(y, x)
    return F.when(a != b, F.when(angle < 0, angle + 2 * F.pi()).otherwise(angle))


def _sides(points: Column) -> Column:
    """Each point with the next one."""
    n = F.size(points)
    return F.arrays_zip(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b"))


def length(line) -> Column:
    """ST_LENGTH of a line."""
    return F.aggregate(_sides(col(line)), F.lit(0.0), lambda total, s: total + distance(s["a"], s["b"]))


def contains(ring, p) -> Column:
    """ST_CONTAINS of a closed ring that doesn't cross the date line, in plane coordinates: whether a ray to the east crosses it an odd number of times."""
    x, y = col(p)["lon"], col(p)["lat"]

    def crossed(total, s):
        a, b = s["a"], s["b"]
        straddles = (a["lat"] > y) != (b["lat"] > y)
        at = a["lon"] + (y - a["lat"]) * (b["lon"] - a["lon"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0))
        return total + F.when(straddles & (x < at), 1).otherwise(0)

    return F.aggregate(_sides(col(ring)), F.lit(0), crossed) % 2 == 1
