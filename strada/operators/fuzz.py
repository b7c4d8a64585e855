"""Noisy copies of maps, to test how robust identification is. Order: missing, jitter, inaccuracy, extra."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strada.functions.segment import COORDS


@dataclass(frozen=True)
class Noise:
    """Shares of segments missing and added; standard deviations in pixels."""

    missing: float = 0.0
    jitter: float = 0.0
    inaccuracy: float = 0.0
    extra: float = 0.0
    extra_length: float = 40.0
    extra_std: float = 20.0


def uniform(seed: int, *of: str) -> Column:
    """A number in (0, 1) of these columns and the seed alone: reruns agree, however the rows are dealt."""
    digits = F.substring(F.md5(F.concat_ws("/", *of, F.lit(str(seed))).cast("binary")), 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 32)


def normal(seed: int, *of: str) -> Column:
    """A standard normal number of these columns and the seed, by Box and Muller's transform."""
    return F.sqrt(-2.0 * F.ln(uniform(seed, *of))) * F.cos(2 * math.pi * uniform(-1 - seed, *of))


def remove(segs: DataFrame, share: float, seed: int) -> DataFrame:
    """Without round(share * n) segments of each map, drawn without replacement: those that come first by a digest.

    Segments are counted by map and the digest's first three digits, which tells the one part of a map in which
    the draw ends; only that part, a 4096th of the map, is ranked.
    """
    marked = segs.withColumn("__d", F.md5(F.concat_ws("/", "seg_id", F.lit(str(seed))).cast("binary"))).withColumn("__p", F.substring("__d", 1, 3))
    parts = marked.groupBy("map_id", "__p").agg(F.count(F.lit(1)).alias("n"))
    by_map = Window.partitionBy("map_id")
    so_far, n = F.sum("n").over(by_map.orderBy("__p")), F.sum("n").over(by_map)
    goal = F.least(F.col("all"), F.round(F.col("all") * F.lit(float(share))).cast("long"))
    placed = parts.withColumns({"to": so_far, "all": n}).withColumn("goal", goal)
    last = placed.where("to >= goal").groupBy("map_id").agg(F.min("__p").alias("__last"), F.min_by(F.col("goal") - F.col("to") + F.col("n"), "__p").alias("__gone"))
    each = marked.join(last, "map_id")
    after = each.where(F.col("__p") > F.col("__last"))
    rank = F.row_number().over(Window.partitionBy("map_id", "__p").orderBy("__d", "seg_id"))
    tied = each.where(F.col("__p") == F.col("__last")).withColumn("__r", rank).where(F.col("__r") > F.col("__gone"))
    return after.select(*segs.columns).unionByName(tied.select(*segs.columns))


def jitter(segs: DataFrame, sd: float, seed: int) -> DataFrame:
    """Both ends moved, each coordinate by itself."""
    return segs.withColumns({c: F.col(c) + normal(seed + i, "map_id", "seg_id") * sd for i, c in enumerate(COORDS)})


def misplace(segs: DataFrame, sd: float, seed: int) -> DataFrame:
    """Segments moved as a whole."""
    moved = segs.withColumns({"__dx": normal(seed, "map_id", "seg_id") * sd, "__dy": normal(seed + 1, "map_id", "seg_id") * sd})
    return moved.withColumns({c: F.col(c) + F.col("__dx" if c[0] == "x" else "__dy") for c in COORDS}).drop("__dx", "__dy")


def added(maps: DataFrame, share: float, length: float, sd: float, seed: int) -> DataFrame:
    """round(share * n) new segments of each map of (map_id, n, next_id, w, h); a negative length turns one round."""
    k = F.round(F.col("n") * F.lit(float(share))).cast("long")
    each = maps.withColumn("__k", k).where("__k > 0").withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__k") - 1)))
    of = ("map_id", "__i")
    drawn = each.withColumns({"x1": uniform(seed, *of) * F.col("w"), "y1": uniform(seed + 1, *of) * F.col("h"), "__l": normal(seed + 2, *of) * sd + length, "__a": uniform(seed + 3, *of) * (2 * math.pi)})
    return drawn.select("map_id", (F.col("next_id") + F.col("__i")).alias("seg_id"), "x1", "y1", (F.col("x1") + F.col("__l") * F.cos("__a")).alias("x2"), (F.col("y1") + F.col("__l") * F.sin("__a")).alias("y2"))


def fuzz(segs: DataFrame, noise: Noise, width: float, height: float, seed: int = 0) -> DataFrame:
    """Noise of all kinds; how many segments are added depends on the original number."""
    out = segs.select("map_id", "seg_id", *COORDS)
    maps = segs.groupBy("map_id").agg(F.count(F.lit(1)).alias("n"), (F.max("seg_id") + 1).alias("next_id")).withColumns({"w": F.lit(float(width)), "h": F.lit(float(height))})
    if noise.missing > 0:
        out = remove(out, noise.missing, seed)
    if noise.jitter > 0:
        out = jitter(out, noise.jitter, seed + 10)
    if noise.inaccuracy > 0:
        out = misplace(out, noise.inaccuracy, seed + 20)
    if noise.extra > 0:
        out = out.unionByName(added(maps, noise.extra, noise.extra_length, noise.extra_std, seed + 30))
    return out
