"""Raw coordinates to the unit square: (map_id, seg_id, x1, y1, x2, y2) in, the same out, y growing southwards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strada.functions.planar import clipped

# The ellipsoid's half axes in metres.
EQUATORIAL, POLAR = 6378137.0, 6356752.3


def bounds(segs: DataFrame, open_end: bool = True) -> DataFrame:
    """(map_id, xmin, ymin, xmax, ymax) of each map; with open_end one is added to the far side."""
    far = F.lit(1.0 if open_end else 0.0)
    return segs.groupBy("map_id").agg(
        F.min(F.least("x1", "x2")).alias("xmin"), F.min(F.least("y1", "y2")).alias("ymin"),
        (F.max(F.greatest("x1", "x2")) + far).alias("xmax"), (F.max(F.greatest("y1", "y2")) + far).alias("ymax"),
    )


def earth_radius(lat: Column) -> Column:
    """From the earth's centre to sea level at a latitude in degrees."""
    phi = lat * F.lit(math.pi) / 180.0
    a, b = F.lit(EQUATORIAL), F.lit(POLAR)
    up = a * a * F.cos(phi) * (a * a * F.cos(phi)) + b * b * F.sin(phi) * (b * b * F.sin(phi))
    down = a * F.cos(phi) * (a * F.cos(phi)) + b * F.sin(phi) * (b * F.sin(phi))
    return F.sqrt(up / down)


def _boxes(segs: DataFrame, rect: tuple[float, float, float, float] | None) -> DataFrame:
    """A row a map: the extent, or the rectangle to which maps are cut."""
    if rect is None:
        return bounds(segs, False)
    x, y = sorted((rect[0], rect[2])), sorted((rect[1], rect[3]))
    one = segs.select("map_id").distinct()
    return one.select("map_id", *[F.lit(float(v)).alias(n) for v, n in zip((x[0], y[0], x[1], y[1]), ("xmin", "ymin", "xmax", "ymax"))])


def scaling(segs: DataFrame, gcs: str, rect=None, altitude: float = 0.0, degrees_as_radians: bool = False) -> DataFrame:
    """A row a map: (map_id, translation, unit, world, x_max, y_max, truncate).

    `unit` is the metres that one raw unit measures, `world` normalised units a metre. Metres
    along the sphere are radians times the radius; degrees_as_radians leaves out the conversion,
    which changes both and no normalised coordinate.
    """
    boxes = _boxes(segs, rect)
    high, wide = F.col("ymax") - F.col("ymin"), F.col("xmax") - F.col("xmin")
    unit = F.lit(1.0)
    if gcs == "latlong":  # the raw x is the latitude, which grows upwards
        high, wide = wide, high
        unit = earth_radius((F.col("xmin") + F.col("xmax")) / 2.0) + F.lit(float(altitude))
        unit = unit if degrees_as_radians else unit * F.lit(math.pi) / 180.0
    world = 1.0 / (F.greatest(wide, high) * F.col("unit"))
    made = boxes.withColumn("unit", unit).withColumn("world", world)
    return made.select(
        "map_id", F.array("xmin", "ymin", "xmin", "ymin").alias("translation"), "unit", "world",
        (wide * F.col("unit") * F.col("world")).alias("x_max"), (high * F.col("unit") * F.col("world")).alias("y_max"), F.lit(rect is not None).alias("truncate"),
    )


def condition(segs: DataFrame, gcs: str, rect=None, altitude: float = 0.0, degrees_as_radians: bool = False) -> DataFrame:
    """Moved to the south-west corner, scaled so that the longer side is 1, y growing southwards.

    The scaling has a row a map and joins on map_id: Spark broadcasts it while it is small.
    """
    both = segs.join(scaling(segs, gcs, rect, altitude, degrees_as_radians), "map_id")
    factor = F.col("unit") * F.col("world")
    east, north = (("y", 1), ("x", 0)) if gcs == "latlong" else (("x", 0), ("y", 1))
    out = []
    for end in "12":
        out.append(((F.col(east[0] + end) - F.col("translation")[east[1]]) * factor).alias("x" + end))
        out.append((F.col("y_max") - (F.col(north[0] + end) - F.col("translation")[north[1]]) * factor).alias("y" + end))
    return both.select("map_id", "seg_id", *out)


def clip(segs: DataFrame, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> DataFrame:
    """The parts of segments inside a rectangle, (.., is_degenerate); those with none go."""
    ends = segs.withColumn("__ends", clipped(xmin, ymin, xmax, ymax)).where(F.size("__ends") == 2)
    p, q = F.col("__ends")[0], F.col("__ends")[1]
    new = {"x1": p["x"], "y1": p["y"], "x2": q["x"], "y2": q["y"], "is_degenerate": (p["x"] == q["x"]) & (p["y"] == q["y"])}
    return ends.withColumns(new).drop("__ends")
