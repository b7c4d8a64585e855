"""Column names and types of the working relations, and the fixed parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

SEGMENT = T.StructType([T.StructField("map_id", T.StringType()), T.StructField("seg_id", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2")]])
PIXEL = T.StructType([T.StructField("map_id", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("y", T.LongType()), T.StructField("x", T.LongType()), T.StructField("seg_id", T.LongType()), T.StructField("cnt", T.LongType())])
KEYPOINT = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "s", "o")])
MAP_META = T.StructType([
    T.StructField("map_id", T.StringType()), T.StructField("gcs", T.StringType()), T.StructField("translation", T.ArrayType(T.DoubleType())),
    *[T.StructField(c, T.DoubleType()) for c in ("world", "x_max", "y_max")], T.StructField("truncate", T.BooleanType()),
    T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()), T.StructField("metric_scale", T.DoubleType()),
])


@dataclass(frozen=True)
class DescriptorConfig:
    """N x N cells of `bins` orientations; entries capped; more than `min_segs` segments needed."""

    n: int = 4
    bins: int = 9
    cap: float = 0.15
    min_segs: int = 10
    grid_offset: float = 0.7
    radius_min: int = 15
    radius_k: int = 3

    @property
    def length(self) -> int:
        return self.n * self.n * self.bins


@dataclass(frozen=True)
class MatchConfig:
    """Ratio test, hypotheses a test map, early acceptance, tolerances, refits."""

    ratio: float = 0.95
    max_hypotheses: int = 1000
    accept: int = 30
    dtol: float = 1.0
    atol: float = 0.1
    refits: int = 10
    min_metric: float = 200.0
    max_metric: float = 10_000.0
    min_inliers: float = 3.0
    to_first: float = 0.6
