"""How concentrated a map's roads are, and the size at which they reach a target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def densities(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(map_id, step, s, density): of `sizes` (map_id, step, s, w, h), the fullest s by s tile's share of all road pixels.

    Tiles have the whole part of s as their side but are as many as s itself fits, so the last
    rows and columns may lie outside all of them, and then count nowhere. Null without pixels.
    """
    road = pixels.select("map_id", "y", "x").distinct()
    each = road.join(sizes, "map_id").withColumns({"__i": F.floor(F.col("y") / F.floor("s")), "__j": F.floor(F.col("x") / F.floor("s"))})
    inside = each.where((F.col("__i") < F.ceil(F.col("h") / F.col("s"))) & (F.col("__j") < F.ceil(F.col("w") / F.col("s"))))
    tiles = inside.groupBy("map_id", "step", "s", "__i", "__j").agg(F.count(F.lit(1)).alias("n"))
    return tiles.groupBy("map_id", "step", "s").agg((F.max("n").cast("double") / F.sum("n")).alias("density"))


def _sizes(maps: DataFrame, smin: float, factor: float) -> DataFrame:
    """smin * factor**i up to one that covers the whole map, where the density is 1."""
    most = F.greatest(F.lit(0), F.ceil(F.log(F.greatest("w", "h") / F.lit(smin)) / F.log(F.lit(factor)))).cast("int") + 1
    return maps.select("map_id", "w", "h", F.explode(F.sequence(F.lit(0), most)).alias("step")).withColumn("s", F.lit(float(smin)) * F.pow(F.lit(float(factor)), F.col("step")))


def optimal_sizes(pixels: DataFrame, maps: DataFrame, target: float = 0.05, smin: float = 20.0, factor: float = 1.5) -> DataFrame:
    """(map_id, size): where the density reaches the target, between the last two of growing sizes.

    The candidates are known beforehand, so all are measured in one pass; the last covers the map.
    """
    found = densities(pixels, _sizes(maps, smin, factor))
    by_size = Window.partitionBy("map_id").orderBy("step")
    steps = found.withColumns({"s0": F.lag("s").over(by_size), "d0": F.lag("density").over(by_size)}).where(F.col("density") >= target)
    first = steps.groupBy("map_id").agg(F.min_by(F.struct("s", "density", "s0", "d0"), "step").alias("f"))
    between: Column = F.col("f.s0") + (F.lit(target) - F.col("f.d0")) * (F.col("f.s") - F.col("f.s0")) / (F.col("f.density") - F.col("f.d0"))
    return first.select("map_id", F.when(F.col("f.s0").isNull(), F.col("f.s")).otherwise(between).cast("int").alias("size"))
