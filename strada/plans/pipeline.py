"""The three journeys: a reference map into the catalogue, a test map to descriptors, and both to an identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strada.functions.segment import angle_unoriented
from strada.operators import conditioning, density, descriptor, grid, identify, match, model, raster, render
from strada.schema import DescriptorConfig, MatchConfig
from strada.sources import wkt


def ingest(spark: SparkSession, config_path: str, segments: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(conditioned segments, scaling) of the map that a JSON configuration describes."""
    config = wkt.read_config(spark, config_path)
    params = config.get("gcs_params") or {}
    gcs, rect, altitude = config["gcs"].lower(), params.get("truncate_rect"), params.get("altitude") or 0.0
    raw = segments if segments is not None else wkt.read(spark, config["file"], gcs)
    meta = conditioning.scaling(raw, gcs, rect, altitude)
    segs = conditioning.condition(raw, gcs, rect, altitude)
    if rect is not None:
        limits = segs.join(meta.select("map_id", "x_max", "y_max"), "map_id")
        segs = conditioning.clip(limits, F.lit(0.0), F.lit(0.0), F.col("x_max"), F.col("y_max")).select("map_id", "seg_id", "x1", "y1", "x2", "y2")
    return segs, meta


def _levels(spark: SparkSession, map_id: str, width: int, height: int, plan: grid.ScalePlan, config: DescriptorConfig) -> DataFrame:
    rows = [(map_id, level, r, -(-width // 2**level), -(-height // 2**level)) for level, _, r in plan.radii(config)]
    return spark.createDataFrame(rows, "map_id string, level int, radius int, w int, h int")


def describe(segs: DataFrame, map_id: str, width: int, height: int, plan: grid.ScalePlan, config: DescriptorConfig | None = None, angle: float | None = None) -> DataFrame:
    """Descriptors with keypoints of one map given in pixels, at all octaves of the plan; `angle` overrides the reference angles."""
    config = config or DescriptorConfig()
    levels = _levels(segs.sparkSession, map_id, width, height, plan, config)
    if plan.smin < 0:
        raise ValueError("a map can only be made smaller")
    roads = segs.withColumn("angle_u", angle_unoriented())
    return descriptor.keypoints(descriptor.describe(roads, width, height, levels, config, angle))


def plan_by_density(segs: DataFrame, width: int, height: int, low: float = 0.05, high: float = 0.2, config: DescriptorConfig | None = None) -> grid.ScalePlan:
    """Radii for one map without a scale: half the sizes at which its roads reach two densities, at least the smallest radius."""
    config = config or DescriptorConfig()
    pixels = raster.rasterize(segs, width, height)
    maps = segs.select("map_id").distinct().withColumns({"w": F.lit(width), "h": F.lit(height)})
    found = [density.optimal_sizes(pixels, maps, t, s).first() for t, s in ((low, float(config.radius_min)), (high, 2.0 * config.radius_min))]
    radii = [max(config.radius_min, 0.5 * f["size"]) if f else float(config.radius_min) for f in found]
    return grid.scale_plan(radii[0], max(radii), config)


def plan_by_scale(metres_a_pixel: float, smallest: float = 50.0, largest: float = 500.0, config: DescriptorConfig | None = None) -> grid.ScalePlan:
    """Radii for a map of known scale, from radii in metres."""
    config = config or DescriptorConfig()
    return grid.scale_plan(*[max(int(m / metres_a_pixel), config.radius_min) for m in (smallest, largest)], config)


_ID = ("map_id", "level", "radius", "lin")


def _matched(tests: DataFrame, refs: DataFrame, test_sizes: DataFrame, ref_sizes: DataFrame, config: MatchConfig) -> DataFrame:
    """Matches with both keypoints and both maps' sizes, by test_id and ref_id."""
    number = F.xxhash64(*_ID)
    q = tests.select(number.alias("qid"), F.col("map_id").alias("test_id"), "desc", *[F.col(a).alias(b) for a, b in (("x", "xt"), ("y", "yt"), ("s", "st"), ("o", "o_t"))])
    r = refs.select(number.alias("rid"), F.col("map_id").alias("ref_id"), "desc", *[F.col(a).alias(b) for a, b in (("x", "xr"), ("y", "yr"), ("s", "sr"), ("o", "o_r"))])
    near = match.ratio_matches(match.knn2(q, r), config.ratio)
    size = lambda d, name, s: d.select(F.col("map_id").alias(name), F.col("w").cast("double").alias("w_" + s), F.col("h").cast("double").alias("h_" + s))
    both = near.join(q.drop("desc"), "qid").join(r.drop("desc"), ["rid", "ref_id"]).join(size(ref_sizes, "ref_id", "ref"), "ref_id").join(size(test_sizes, "test_id", "test"), "test_id")
    return both.withColumns({"c_test": F.greatest("h_test", "w_test"), "c_ref": F.greatest("w_ref", "h_ref")})


def match_rows(tests: DataFrame, refs: DataFrame, test_size: tuple[int, int] | DataFrame, ref_sizes: DataFrame, config: MatchConfig | None = None) -> DataFrame:
    """Matches with both keypoints: tests and refs as `describe` makes them, ref_sizes (map_id, w, h).

    test_size is (height, width) of the one test map, or sizes (map_id, w, h) of many, whose matches have a test_id.
    """
    config = config or MatchConfig()
    if isinstance(test_size, DataFrame):
        return _matched(tests, refs, test_size, ref_sizes, config)
    h, w = test_size
    sizes = tests.select("map_id").distinct().withColumns({"w": F.lit(w), "h": F.lit(h)})
    return _matched(tests, refs, sizes, ref_sizes, config).drop("test_id")


def identify_map(tests: DataFrame, refs: DataFrame, test_size: tuple[int, int], ref_sizes: DataFrame, scales: DataFrame, config: MatchConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(confidences, refined inliers) of a test map; scales (ref_id, metric_scale) is metres a reference pixel."""
    inliers = model.estimate(match_rows(tests, refs, test_size, ref_sizes, config), config)
    return identify.identify(inliers, scales, max(test_size), config), inliers


def identify_maps(tests: DataFrame, refs: DataFrame, test_sizes: DataFrame, ref_sizes: DataFrame, scales: DataFrame, config: MatchConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """As `identify_map` for any number of test maps in one plan, by test_id: test_sizes (map_id, w, h).

    Descriptors of the test maps must have been made apart, each by its map_id; a test map without a match has no row.
    """
    inliers = model.estimate(match_rows(tests, refs, test_sizes, ref_sizes, config), config)
    return identify.identify(inliers, scales, None, config), inliers


def image_segments(segs: DataFrame, size: int) -> DataFrame:
    """The segments that a map drawn at `size` pixels describes."""
    return render.drawn(segs, size).where("is_described").drop("is_described")
