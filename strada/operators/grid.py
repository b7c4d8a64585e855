"""Lattices of keypoints, and which pixels each looks at."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strada.schema import DescriptorConfig


def valid_radii(config: DescriptorConfig) -> list[int]:
    """Radii of one octave, rounded half to even."""
    return [round(config.radius_min * 2 ** (i / config.radius_k)) for i in range(config.radius_k)]


@dataclass(frozen=True)
class ScalePlan:
    smin: int
    rmin_idx: int
    smax: int
    rmax_idx: int

    def radii(self, config: DescriptorConfig) -> list[tuple[int, int, int]]:
        """(level, radius index, radius) of all octaves."""
        out = []
        for level in range(self.smin, self.smax + 1):
            first = self.rmin_idx if level == self.smin else 0
            last = self.rmax_idx if level == self.smax else config.radius_k - 1
            out += [(level, i, valid_radii(config)[i]) for i in range(first, last + 1)]
        return out


def scale_plan(smallest: float, largest: float, config: DescriptorConfig | None = None) -> ScalePlan:
    """Octaves and radii that cover a range of radii in pixels of level 0.

    The first radius is the last but one of the octave if its largest exceeds `smallest`, else the first; the
    last radius is always the octave's largest.
    """
    config = config or DescriptorConfig()
    radii = valid_radii(config)
    smin = math.floor(math.log2(smallest / config.radius_min))
    smax = math.floor(math.log2(largest / config.radius_min))
    smax += radii[-1] * 2.0**smax < largest
    first = config.radius_k - 2 if radii[-1] * 2.0**smin > smallest else 0
    return ScalePlan(smin, max(0, first), smax, config.radius_k - 1)


def scale_plans(spark: SparkSession, ranges: list[tuple[float, float]], config: DescriptorConfig | None = None) -> DataFrame:
    plans = [(float(a), float(b), p.smin, p.rmin_idx, p.smax, p.rmax_idx) for a, b in ranges for p in [scale_plan(a, b, config)]]
    return spark.createDataFrame(plans, "gmin double, gmax double, smin int, rmin_idx int, smax int, rmax_idx int")


def offset(radius: Column, config: DescriptorConfig | None = None) -> Column:
    return (radius * (config or DescriptorConfig()).grid_offset).cast("int")


def steps(size: Column, radius: Column, config: DescriptorConfig | None = None) -> Column:
    """Points along one side: from the offset, spaced by the radius, to the far offset, end excluded."""
    room = size - 2 * offset(radius, config)
    return F.greatest(F.lit(0), F.ceil(room / radius)).cast("int")


def grid_points(levels: DataFrame, config: DescriptorConfig | None = None) -> DataFrame:
    """(map_id, level, radius, row, col, lin, gx, gy) of (map_id, level, radius, w, h), row by row."""
    sized = levels.withColumns({"__off": offset(F.col("radius"), config), "__nc": steps(F.col("w"), F.col("radius"), config), "__nr": steps(F.col("h"), F.col("radius"), config)})
    some = sized.where("__nc > 0 and __nr > 0")
    rows = some.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("__nr") - 1)))
    cells = rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("__nc") - 1)))
    return cells.select("map_id", "level", "radius", "row", "col", (F.col("row") * F.col("__nc") + F.col("col")).alias("lin"), (F.col("__off") + F.col("col") * F.col("radius")).alias("gx"), (F.col("__off") + F.col("row") * F.col("radius")).alias("gy"))


def from_linear(lin: Column, columns: Column) -> tuple[Column, Column]:
    """(row, col) of a linear index."""
    return F.floor(lin / columns).cast("int"), F.pmod(lin, columns).cast("int")


def near_keypoints(pixels: DataFrame, levels: DataFrame, config: DescriptorConfig | None = None) -> DataFrame:
    """Each pixel row with the keypoints whose window [g - r, g + r) on both axes holds it.

    Keypoints stand one radius apart, so on either axis just the two with index q and q + 1 can,
    q = floor((p - offset) / r): the range join is two small generators. `levels` has
    (map_id, level, radius, w, h), a row a level and radius, and is broadcast while it is small.
    """
    dims = levels.select("map_id", "level", "radius", offset(F.col("radius"), config).alias("__off"), steps(F.col("w"), F.col("radius"), config).alias("__nc"), steps(F.col("h"), F.col("radius"), config).alias("__nr"))
    both = pixels.join(dims, ["map_id", "level"])
    q = lambda p: F.floor((F.col(p) - F.col("__off")) / F.col("radius")).cast("int")
    cols = both.withColumn("col", F.explode(F.array(q("x"), q("x") + 1))).where("col >= 0 and col < __nc")
    cells = cols.withColumn("row", F.explode(F.array(q("y"), q("y") + 1))).where("row >= 0 and row < __nr")
    return cells.withColumns({"lin": F.col("row") * F.col("__nc") + F.col("col"), "gx": F.col("__off") + F.col("col") * F.col("radius"), "gy": F.col("__off") + F.col("row") * F.col("radius")}).drop("__off", "__nc", "__nr")
