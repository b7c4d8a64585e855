"""Segments from text, one LINESTRING a line, and their coordinate systems."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The two line formats. White space after the comma is required; what follows the bracket is ignored.
SIGNED = r"^\s*(?:LINESTRING)?\s*\((-?\d+\.?\d*)\s+(-?\d+\.?\d*),\s+(-?\d+\.?\d*)\s+(-?\d+\.?\d*)\)"
UNSIGNED = r"^\s*(?:LINESTRING)?\s*\((\d+\.?\d*)\s+(\d+\.?\d*),\s+(\d+\.?\d*)\s+(\d+\.?\d*)\)"


@dataclass(frozen=True)
class CoordinateSystem:
    """How lines are read, and which of the four numbers are x1, y1, x2, y2 of the raw segment."""

    name: str
    pattern: str
    order: tuple[int, int, int, int]


#: Latitude is the raw x, longitude the raw y: the file has longitude first.
SYSTEMS = {
    "osgb36": CoordinateSystem("osgb36", UNSIGNED, (1, 2, 3, 4)),
    "latlong": CoordinateSystem("latlong", SIGNED, (2, 1, 4, 3)),
}


class UnknownCoordinateSystem(ValueError):
    pass


def system(name: str) -> CoordinateSystem:
    """By name, whatever its case."""
    try:
        return SYSTEMS[name.lower()]
    except KeyError:
        raise UnknownCoordinateSystem(name) from None


def parse(lines: DataFrame, name: str, value: str = "value") -> DataFrame:
    """Raw segments of text lines, other columns kept; lines that don't match are dropped."""
    gcs = system(name)
    part: Callable[[int], Column] = lambda k: F.regexp_extract(value, gcs.pattern, k).cast("double")
    kept = lines.where(F.col(value).rlike(gcs.pattern))
    return kept.select(*[c for c in lines.columns if c != value], *[part(k).alias(n) for k, n in zip(gcs.order, ("x1", "y1", "x2", "y2"))])


def parse_polylines(lines: DataFrame, name: str, value: str = "value") -> DataFrame:
    """The lenient reading: any number of points, exponents and no blank after a comma; a row a segment."""
    gcs = system(name)
    body = F.regexp_extract(value, r"\(([^()]*)\)", 1)
    points = F.transform(F.split(body, r"\s*,\s*"), lambda p: F.transform(F.split(F.trim(p), r"\s+"), lambda v: v.try_cast("double")))
    pairs = F.arrays_zip(F.slice(points, 1, F.size(points) - 1).alias("a"), F.slice(points, 2, F.size(points) - 1).alias("b"))
    each = lines.withColumn("__n", F.size(points)).where("__n >= 2").select(*[c for c in lines.columns if c != value], F.explode(pairs).alias("p"))
    flat = [F.col("p.a")[0], F.col("p.a")[1], F.col("p.b")[0], F.col("p.b")[1]]
    chosen = [flat[k - 1].alias(n) for k, n in zip(gcs.order, ("x1", "y1", "x2", "y2"))]
    return each.select(*[c for c in lines.columns if c != value], *chosen).dropna(subset=["x1", "y1", "x2", "y2"])


def read(spark: SparkSession, path: str | list[str], name: str) -> DataFrame:
    """Raw segments of text files, (map_id, seg_id, x1..y2): the map is the file, numbers follow the lines of a split."""
    lines = spark.read.text(path).select("value", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("map_id"), F.monotonically_increasing_id().alias("seg_id"))
    return parse(lines, name).select("map_id", "seg_id", "x1", "y1", "x2", "y2")


def read_config(spark: SparkSession, path: str) -> dict:
    """A map's JSON configuration: {file, gcs, gcs_params: {truncate_rect, altitude}}."""
    rows = spark.read.json(path, multiLine=True).limit(1).toJSON().collect()
    out = json.loads(rows[0])
    system(out["gcs"])
    return out
