"""Projective maps: small matrices made by the driver, applied as column arithmetic."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_PLANES = {"x": (1, 2), "y": (2, 0), "z": (0, 1)}


def axis_rotation(axis: str, angle: float, dims: int = 3) -> np.ndarray:
    """Homogeneous rotation about one axis, in radians."""
    if axis not in _PLANES:
        raise ValueError(f"no axis {axis!r}")
    out = np.eye(4)
    if abs(angle) >= 1e-6:
        i, j = _PLANES[axis]
        out[i, i] = out[j, j] = math.cos(angle)
        out[i, j], out[j, i] = -math.sin(angle), math.sin(angle)
    return out if dims == 3 else out[:3, :3]


def rotation(angles: tuple[float, float, float]) -> np.ndarray:
    """About x, then y, then z, in radians."""
    return axis_rotation("x", angles[0]) @ axis_rotation("y", angles[1]) @ axis_rotation("z", angles[2])


def axis_translation(axis: str, t: float, dims: int = 3) -> np.ndarray:
    out = np.eye(dims + 1)
    out["xyz".index(axis), dims] = t
    return out


def perspective(height: float, width: float, target: float, angles: tuple[float, float, float], degrees: bool = True) -> tuple[np.ndarray, tuple[int, int]]:
    """The view of a turned sheet through a camera of 100 degrees, moved and scaled to fit target: (3x3, (h, w))."""
    turn = rotation(tuple(math.radians(a) for a in angles) if degrees else angles)
    f = width / (2 * math.tan(math.radians(50)))
    lift = np.array([[1, 0, -width / 2], [0, 1, -height / 2], [0, 0, 0], [0, 0, 1.0]])
    placed = axis_translation("z", 1.5 * f) @ turn @ lift

    def view(cx: float, cy: float) -> np.ndarray:
        return np.array([[f, 0, cx, 0], [0, f, cy, 0], [0, 0, 1.0, 0]]) @ placed

    corners = view(width / 2, height / 2) @ np.array([[0, width, 0, width], [0, 0, height, height], [1, 1, 1, 1.0]])
    low, high = (corners[:2] / corners[2]).min(axis=1), (corners[:2] / corners[2]).max(axis=1)
    size, middle = high - low, (high + low) / 2
    centre = size / 2 - (middle - np.array([width, height]) / 2)
    scale = target / size.max()
    return np.diag([scale, scale, 1.0]) @ view(*centre), (int(size[1] * scale), int(size[0] * scale))


def image_rotation(height: int, width: int, angle: float, degrees: bool = True) -> tuple[np.ndarray, tuple[int, int]]:
    """The 2x3 map that turns an image and keeps all of it in view, and the new (h, w)."""
    a = math.radians(angle) if degrees else angle
    turn = np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]])
    corners = turn @ np.array([[0, width, 0, width], [0, 0, height, height]])
    low, high = np.rint(corners.min(axis=1)).astype(int), np.rint(corners.max(axis=1)).astype(int)
    return np.column_stack([turn, -low]), (int(high[1] - low[1]), int(high[0] - low[0]))


def project(m: np.ndarray, x: Column, y: Column) -> tuple[Column, Column]:
    """A 3x3 map of a point; the division by w is left out where w is 1."""
    row = [F.lit(float(a)) * x + F.lit(float(b)) * y + F.lit(float(t)) for a, b, t in m[:2]]
    if np.array_equal(m[2], [0, 0, 1]):
        return row[0], row[1]
    a, b, t = m[2]
    w = F.lit(float(a)) * x + F.lit(float(b)) * y + F.lit(float(t))
    return row[0] / w, row[1] / w


def transformed(m: np.ndarray) -> list[Column]:
    """Both ends of a segment under a 3x3 or 2x3 map."""
    m = np.vstack([m, [0, 0, 1.0]]) if m.shape == (2, 3) else m
    a, b = project(m, F.col("x1"), F.col("y1")), project(m, F.col("x2"), F.col("y2"))
    return [v.alias(n) for v, n in zip((*a, *b), ("x1", "y1", "x2", "y2"))]


def similarity_inverse(x: Column, y: Column, tx, ty, s, o) -> tuple[Column, Column]:
    """A point of the reference in the test map's coordinates."""
    u, v = (x - tx) / s, (y - ty) / s
    return F.cos(o) * u + F.sin(o) * v, F.cos(o) * v - F.sin(o) * u


def similarity(x: Column, y: Column, tx, ty, s, o) -> tuple[Column, Column]:
    """A point of the test map in the reference's coordinates."""
    return s * (F.cos(o) * x - F.sin(o) * y) + tx, s * (F.sin(o) * x + F.cos(o) * y) + ty
