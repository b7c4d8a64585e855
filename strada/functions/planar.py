"""Points and lines in the plane, as structs of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this the homogeneous coordinate counts as zero, and lines as parallel.
PARALLEL = 1e-7
Point = tuple[Column, Column]


def cross(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """Of two lines their point, of two points their line, in homogeneous coordinates."""
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def to_homogeneous(p: Point) -> tuple[Column, Column, Column]:
    return p[0], p[1], F.lit(1.0)


def to_euclidean(p: tuple[Column, Column, Column]) -> Point:
    """Null at infinity."""
    w = F.nullif(p[2], F.lit(0.0))
    return p[0] / w, p[1] / w


def line_of(a: Point, b: Point) -> tuple[Column, Column, Column]:
    """Coefficients of the line through two points, in the sign of (b - a) turned left."""
    return b[1] - a[1], a[0] - b[0], -(a[0] * b[1] - a[1] * b[0])


def _between(p: Point, a: Point, b: Point) -> Column:
    """Whether a point of the line through a and b lies from a to b, both included."""
    tx, ty, vx, vy = p[0] - a[0], p[1] - a[1], b[0] - a[0], b[1] - a[1]
    return (tx * vx + ty * vy >= 0) & (tx * tx + ty * ty <= vx * vx + vy * vy)


def intersection(a: Point, b: Point, d: Point, e: Point) -> Column:
    """The point of segments ab and de, STRUCT<x, y>, or null."""
    x, y, w = cross(line_of(a, b), line_of(d, e))
    flat = F.abs(w) < PARALLEL
    safe = F.when(~flat, w)
    p = x / safe, y / safe
    inside = _between(p, a, b) & _between(p, d, e)
    return F.when(~flat & inside, F.struct(p[0].alias("x"), p[1].alias("y")))


def clipped(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """The part of (x1, y1, x2, y2) in a rectangle: an array of its two ends, or of fewer if nothing is inside.

    Ends inside come first, then where it meets the left, right, top and bottom side; so it
    may be turned round, and one that touches a corner or starts on a side and leaves by another may have no length.
    """
    a, b = (F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2"))

    def inner(p: Point) -> Column:
        return F.when(p[0].between(xmin, xmax) & p[1].between(ymin, ymax), F.struct(p[0].alias("x"), p[1].alias("y")))

    corners = {"tl": (xmin, ymin), "tr": (xmax, ymin), "bl": (xmin, ymax), "br": (xmax, ymax)}
    sides = [("tl", "bl"), ("tr", "br"), ("tl", "tr"), ("bl", "br")]
    found = F.array(inner(a), inner(b), *[intersection(a, b, corners[s], corners[t]) for s, t in sides])
    return F.slice(F.array_compact(found), 1, 2)
