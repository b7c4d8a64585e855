"""Segments to pixels and pyramids, as a sparse relation (map_id, level, y, x, seg_id, cnt)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strada.functions.segment import angle_unoriented


def line_pixels(segs: DataFrame, *keep: str) -> DataFrame:
    """(keep..., x, y): one pixel for each step along the longer axis of x1, y1, x2, y2.

    Ends are rounded half away from zero. After k steps the shorter axis has moved
    floor((2 k minor + major) / (2 major)); a segment and its reverse have the same pixels.
    Written in steps, each of columns made before, so that nothing is computed a pixel that
    belongs to the segment.
    """
    ends = segs.select(*keep, *[F.round(c).cast("long").alias(f"__{c}") for c in ("x1", "y1", "x2", "y2")])
    axes = ends.withColumn("__steep", F.abs(F.col("__y2") - F.col("__y1")) > F.abs(F.col("__x2") - F.col("__x1")))
    by_axis = lambda major, minor: F.when(F.col("__steep"), F.col(minor)).otherwise(F.col(major))
    turned = axes.select(*keep, "__steep", by_axis("__x1", "__y1").alias("__p0"), by_axis("__x2", "__y2").alias("__p1"), by_axis("__y1", "__x1").alias("__q0"), by_axis("__y2", "__x2").alias("__q1"))
    back = F.col("__p1") < F.col("__p0")
    line = turned.select(
        *keep, "__steep", F.least("__p0", "__p1").alias("__a"), F.abs(F.col("__p1") - F.col("__p0")).alias("__n"),
        F.when(back, F.col("__q1")).otherwise(F.col("__q0")).alias("__b"), F.when(back, F.col("__q0") - F.col("__q1")).otherwise(F.col("__q1") - F.col("__q0")).alias("__m"),
    )
    steps = line.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n"))))
    moved = F.call_function("div", 2 * F.col("__k") * F.abs("__m") + F.col("__n"), F.greatest(2 * F.col("__n"), F.lit(1)))
    placed = steps.select(*keep, "__steep", (F.col("__a") + F.col("__k")).alias("__a"), (F.col("__b") + F.when(F.col("__m") < 0, -moved).otherwise(moved)).alias("__b"))
    return placed.select(*keep, F.when(F.col("__steep"), F.col("__b")).otherwise(F.col("__a")).alias("x"), F.when(F.col("__steep"), F.col("__a")).otherwise(F.col("__b")).alias("y"))


def rasterize(segs: DataFrame, width: Column | int, height: Column | int) -> DataFrame:
    """Level 0: the pixels of each segment that are inside the map.

    A segment never has a pixel twice and (map_id, seg_id) is unique, so each row counts
    one and nothing is shuffled.
    """
    w, h = (F.lit(v) if isinstance(v, int) else v for v in (width, height))
    each = line_pixels(segs.withColumns({"__w": w, "__h": h}), "map_id", "seg_id", "__w", "__h")
    inside = each.where("x >= 0 and x < __w and y >= 0 and y < __h")
    return inside.select("map_id", F.lit(0).alias("level"), "y", "x", "seg_id", F.lit(1).cast("long").alias("cnt"))


def thickened(pixels: DataFrame, line_width: int, width: int, height: int) -> DataFrame:
    """(map_id, y, x): the pixels of lines drawn with a round pen of line_width pixels, each once."""
    low, high = -((line_width - 1) // 2), line_width // 2
    middle = (low + high) / 2
    pen = [(dx, dy) for dx in range(low, high + 1) for dy in range(low, high + 1) if (dx - middle) ** 2 + (dy - middle) ** 2 <= (line_width / 2) ** 2]
    dots = pixels.select("map_id", "y", "x").distinct() if len(pen) > 1 else pixels.select("map_id", "y", "x")
    each = dots.withColumn("d", F.explode(F.array(*[F.struct(F.lit(dx).alias("x"), F.lit(dy).alias("y")) for dx, dy in pen])))
    moved = each.select("map_id", (F.col("y") + F.col("d.y")).alias("y"), (F.col("x") + F.col("d.x")).alias("x"))
    return moved.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).distinct()


def drawn_pixels(segs: DataFrame, width: int, height: int, line_width: int = 1, cut_off: bool = False) -> DataFrame:
    """(map_id, y, x) of an image of the segments; ends are rounded, or cut off as the map imager does."""
    ends = segs.withColumns({c: F.col(c).cast("long").cast("double") for c in ("x1", "y1", "x2", "y2")}) if cut_off else segs
    return thickened(rasterize(ends, width, height), line_width, width, height)


def union(*pixels: DataFrame) -> DataFrame:
    """Sum of multisets."""
    out = pixels[0]
    for more in pixels[1:]:
        out = out.unionByName(more)
    return out.groupBy("map_id", "level", "y", "x", "seg_id").agg(F.sum("cnt").alias("cnt"))


def pixel_totals(pixels: DataFrame) -> DataFrame:
    """(map_id, level, y, x, n_segs, total) of each pixel that is not empty."""
    return pixels.groupBy("map_id", "level", "y", "x").agg(F.count(F.lit(1)).alias("n_segs"), F.sum("cnt").alias("total"))


def downsample(pixels: DataFrame, k: int) -> DataFrame:
    """Blocks of 2**k by 2**k pixels become one, whose multiset is their sum."""
    if k < 0:
        raise ValueError("a map can only be made smaller")
    small = pixels.select("map_id", (F.col("level") + k).alias("level"), *[F.shiftright(c, k).alias(c) for c in ("y", "x")], "seg_id", "cnt")
    return small.groupBy("map_id", "level", "y", "x", "seg_id").agg(F.sum("cnt").alias("cnt"))


def pyramid(pixels: DataFrame, levels: list[int]) -> DataFrame:
    """All levels from level 0 in one shuffle: rows are dealt to the levels wanted and summed there; level 0 passes through."""
    if min(levels, default=0) < 0:
        raise ValueError("a map can only be made smaller")
    above = [k for k in levels if k]
    each = pixels.withColumn("__k", F.explode(F.array(*[F.lit(k) for k in above]).cast("array<int>")))
    small = each.select("map_id", F.col("__k").alias("level"), *[F.call_function("shiftright", F.col(c), F.col("__k")).alias(c) for c in ("y", "x")], "seg_id", "cnt")
    made = small.groupBy("map_id", "level", "y", "x", "seg_id").agg(F.sum("cnt").alias("cnt"))
    return pixels.select(*made.columns).unionByName(made) if 0 in levels else made


def level_size(size: Column, level: Column) -> Column:
    """Rows or columns of a level."""
    return F.ceil(size / F.pow(F.lit(2.0), level)).cast("int")


def downscaled_roads(segs: DataFrame, k: int) -> DataFrame:
    """Segments of a lower level, with the exact angle of level 0 carried along."""
    angle = F.col("angle_u") if "angle_u" in segs.columns else angle_unoriented()
    carried = segs.withColumn("angle_u", angle)
    return carried.withColumns({c: F.col(c) / float(1 << k) for c in ("x1", "y1", "x2", "y2")})
