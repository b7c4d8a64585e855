"""Which reference map, if any, a test map is from; or each of many, by test_id (see `model`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strada.operators.model import maps_of, of_tests, with_tests
from strada.schema import MatchConfig


def visible_share(x: Column, y: Column, s: Column, w: Column, h: Column, clamp: bool = False) -> Column:
    """How much of a keypoint's window is inside its map; with clamp, none if it is outside on both axes."""
    right = F.least(w - 1, x + s) - F.greatest(F.lit(0.0), x - s + 1)
    down = F.least(h - 1, y + s) - F.greatest(F.lit(0.0), y - s + 1)
    if clamp:
        right, down = F.greatest(right, F.lit(0.0)), F.greatest(down, F.lit(0.0))
    return right * down / (4 * s * s)


def weighted_inliers(inliers: DataFrame, clamp: bool = False) -> DataFrame:
    """(ref_id, w): the sum of the harmonic means of both windows' visible shares. Needs w_ref, h_ref, w_test, h_test."""
    t = visible_share(F.col("xt"), F.col("yt"), F.col("st"), F.col("w_test"), F.col("h_test"), clamp)
    r = visible_share(F.col("xr"), F.col("yr"), F.col("sr"), F.col("w_ref"), F.col("h_ref"), clamp)
    return inliers.groupBy(*maps_of(inliers)).agg(F.sum(F.try_divide(2 * t * r, t + r)).alias("w"))


def in_metric_band(models: DataFrame, maps: DataFrame, test_size: float | Column, config: MatchConfig | None = None) -> DataFrame:
    """Models by which the test map measures a plausible number of metres: maps (ref_id, metric_scale)."""
    config = config or MatchConfig()
    size = test_size if isinstance(test_size, Column) else F.lit(float(test_size))
    metres = size * F.col("s") * F.col("metric_scale")
    return models.join(maps.select("ref_id", "metric_scale"), "ref_id").where(metres.between(config.min_metric, config.max_metric))


def confidences(weights: DataFrame, config: MatchConfig | None = None) -> DataFrame:
    """(ref_id, confidence): of maps with enough inliers and not far behind the first, the share of all their weight."""
    config = config or MatchConfig()
    keys = maps_of(weights)
    enough = weights.where(F.col("w") >= config.min_inliers)
    near = with_tests(enough, of_tests(enough, keys, F.max("w").alias("__top")), keys).where(F.col("w") >= F.col("__top") * config.to_first).select(*keys, "w")
    shared = with_tests(near, of_tests(near, keys, F.sum("w").alias("__all")), keys)
    return shared.select(*keys, (F.col("w") / F.col("__all")).alias("confidence"))


def identify(inliers: DataFrame, maps: DataFrame, test_size: float | None = None, config: MatchConfig | None = None, clamp: bool = True) -> DataFrame:
    """(ref_id, confidence) from the refined inliers; no row means no match. The test map's longer side is c_test where test_size isn't given."""
    keys = maps_of(inliers)
    models = inliers.groupBy(*keys).agg(F.first("s").alias("s"), F.first("c_test").alias("c_test"))
    band = in_metric_band(models, maps, F.col("c_test") if test_size is None else test_size, config).select(*keys)
    return confidences(weighted_inliers(inliers.join(band, keys, "left_semi"), clamp), config)
