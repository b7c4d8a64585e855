"""Row-wise expressions on segments (x1, y1, x2, y2)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

COORDS = ("x1", "y1", "x2", "y2")
TAU = 2 * math.pi


def c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def length() -> Column:
    dx, dy = c("x1") - c("x2"), c("y1") - c("y2")
    return F.sqrt(dx * dx + dy * dy)


def _direction() -> Column:
    return F.atan2(c("y2") - c("y1"), c("x2") - c("x1"))


def angle_oriented() -> Column:
    """In [0, 2 pi)."""
    return (_direction() + F.lit(TAU)) % F.lit(TAU)


def angle_unoriented() -> Column:
    """In [0, pi): a segment and its reverse are alike."""
    a = _direction()
    up = F.when(a < 0, a + F.lit(math.pi)).otherwise(a)
    return F.when(up >= F.lit(math.pi), up - F.lit(math.pi)).otherwise(up)


def scaled(factor: Column | float) -> list[Column]:
    return [(c(n) * factor).alias(n) for n in COORDS]


def shifted(dx: Column | float, dy: Column | float) -> list[Column]:
    return [(c(n) - (dx if n[0] == "x" else dy)).alias(n) for n in COORDS]


def displayed(threshold: float = 0.01) -> Column:
    """Of normalised segments, those long enough to be drawn; a threshold of exactly 0 takes all."""
    return F.lit(True) if threshold == 0 else length() >= threshold


def described(threshold: float = 0.04) -> Column:
    return displayed(threshold)


def metric_distance(pixels: Column, pixels_a_side: Column | float, world: Column) -> Column:
    """Pixels to metres, of a map drawn with so many pixels, `world` being normalised units a metre."""
    return pixels / (pixels_a_side * world)


def pixel_distance(metres: Column, pixels_a_side: Column | float, world: Column) -> Column:
    return metres * (pixels_a_side * world)


def metric_scale(world: Column, pixels: Column) -> Column:
    """Metres a pixel of a region, from one distance in both."""
    return world / pixels


def keypoint(x: Column, y: Column, s: Column, o: Column, as_int: bool = False) -> Column:
    """(x, y, s, o); with as_int, place and scale are truncated."""
    if as_int:
        x, y, s = (v.cast("int").cast("double") for v in (x, y, s))
    return F.struct(x.alias("x"), y.alias("y"), s.alias("s"), o.alias("o"))
