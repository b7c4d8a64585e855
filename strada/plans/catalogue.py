"""A query for each operator, over the whole test tables."""

from __future__ import annotations


from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strada.functions import planar, segment, transform
from strada.operators import conditioning, density, descriptor, fuzz, grid, identify, match, model, raster, render, results
from strada.plans import views
from strada.plans.views import SIDE
from strada.schema import DescriptorConfig, MatchConfig
from strada.sources import arrays, wkt

COORDS = segment.COORDS
#: The model that overlays are drawn with: tx, ty, s, o.
MODEL = (120.0, -45.0, 1.25, 0.3)
#: Radius of the descriptors in queries of one level.
RADIUS = 15


def r6(value: Column | str, name: str) -> Column:
    """Rounded, and without a negative zero."""
    return (F.round(F.col(value) if isinstance(value, str) else value, 6) + F.lit(0.0)).alias(name)


def _coords() -> list[Column]:
    return [r6(c, c) for c in COORDS]


def _levels(spark: SparkSession, segs: DataFrame) -> DataFrame:
    return segs.select("map_id").distinct().select("map_id", F.lit(0).alias("level"), F.lit(RADIUS).alias("radius"), F.lit(SIDE).alias("w"), F.lit(SIDE).alias("h"))


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    return raster.rasterize(views.segments(spark, d), SIDE, SIDE)


def _roads(spark: SparkSession, d: str) -> DataFrame:
    return views.segments(spark, d).withColumn("angle_u", segment.angle_unoriented())


def _normal(segs: DataFrame) -> DataFrame:
    return segs.select("map_id", "seg_id", *segment.scaled(1.0 / SIDE))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return match.ratio_matches(match.knn2(*views.descriptors(spark, d)))


def _match_rows(spark: SparkSession, d: str) -> DataFrame:
    return views.match_rows(spark, d, _matches(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each segment with the next one of its embedding."""
    segs = views.segments(spark, d)
    nxt = segs.select((F.col("seg_id") - 1).alias("seg_id"), *[F.col(c).alias(c + "b") for c in COORDS])
    return segs.join(nxt, "seg_id").where("seg_id % 16 <> 15")


def _line(suffix: str = "") -> tuple[Column, Column, Column]:
    a, b = ((F.col(f"x{n}{suffix}"), F.col(f"y{n}{suffix}")) for n in "12")
    return planar.line_of(a, b)


def parse_wkt_osgb36(spark, d):
    return wkt.parse(views.wkt_lines(spark, d), "osgb36")


def parse_wkt_latlong(spark, d):
    return wkt.parse(views.wkt_lines(spark, d), "latlong")


def condition_osgb36(spark, d):
    return conditioning.condition(views.segments(spark, d), "osgb36").select("map_id", "seg_id", *_coords())


def condition_latlong(spark, d):
    degrees = views.segments(spark, d).select("map_id", "seg_id", *[(F.col(c) / 10).alias(c) for c in COORDS])
    return conditioning.condition(degrees, "latlong").select("map_id", "seg_id", *_coords())


def earth_radius(spark, d):
    return spark.range(-90, 91).select(F.col("id").alias("lat"), F.round(conditioning.earth_radius(F.col("id").cast("double")), 3).alias("r"))


def seg_lengths(spark, d):
    return views.segments(spark, d).select("seg_id", r6(segment.length(), "value"))


def seg_angles_oriented(spark, d):
    return views.segments(spark, d).select("seg_id", r6(segment.angle_oriented(), "value"))


def seg_angles_unoriented(spark, d):
    return views.segments(spark, d).select("seg_id", r6(segment.angle_unoriented(), "value"))


def filter_length(spark, d):
    segs = _normal(views.segments(spark, d))
    count = lambda c: F.sum(c.cast("long"))
    return segs.groupBy("map_id").agg(count(segment.displayed(0.2)).alias("n_displayed"), count(segment.described(0.3)).alias("n_described"))


def seg_bounds(spark, d):
    return conditioning.bounds(views.segments(spark, d)).select("map_id", *[r6(c, c) for c in ("xmin", "ymin", "xmax", "ymax")])


def seg_bounds_large(spark, d):
    return conditioning.bounds(views.large_segments(spark, d)).select("map_id", *[r6(c, c) for c in ("xmin", "ymin", "xmax", "ymax")])


def seg2line(spark, d):
    return views.segments(spark, d).select("seg_id", *[F.round(v, 3).alias(n) for v, n in zip(_line(), "abc")])


def line_intersect_homog(spark, d):
    return _pairs(spark, d).select("seg_id", *[F.round(v, 1).alias(n) for v, n in zip(planar.cross(_line(), _line("b")), ("hx", "hy", "hw"))])


def intersect_segments(spark, d):
    ends = [(F.col(f"x{n}{s}"), F.col(f"y{n}{s}")) for s in ("", "b") for n in "12"]
    return _pairs(spark, d).select("seg_id", planar.intersection(*ends).alias("p")).select("seg_id", r6("p.x", "x"), r6("p.y", "y"))


def clip_to_rect(spark, d):
    cut = conditioning.clip(views.segments(spark, d), F.lit(450.0), F.lit(470.0), F.lit(540.0), F.lit(560.0))
    return cut.select("map_id", "seg_id", *_coords(), "is_degenerate")


def transform_affine(spark, d):
    m, _ = transform.image_rotation(SIDE, SIDE, 30.0)
    return views.segments(spark, d).select("seg_id", *transform.transformed(m)).select("seg_id", *_coords())


def transform_perspective(spark, d):
    m, _ = transform.perspective(SIDE, SIDE, 800, (20.0, -15.0, 10.0))
    return views.segments(spark, d).select("seg_id", *transform.transformed(m)).select("seg_id", *_coords())


def perspective_segments(spark, d):
    flat = render.drawn_in_perspective(_normal(views.segments(spark, d)), 800, (20.0, -15.0, 10.0), 1.0, 1.0, 0.05, 0.2)
    return flat.select("map_id", "seg_id", *_coords(), "is_described")


def imager_scaled_described(spark, d):
    return render.drawn(_normal(views.segments(spark, d)), 1200, 0.05, 0.2).where("is_described").select("map_id", "seg_id", *_coords())


def metric_distance(spark, d):
    return views.segments(spark, d).select("seg_id", r6(segment.metric_distance(segment.length(), float(SIDE), F.lit(0.0005)), "d"))


def pixel_distance(spark, d):
    return views.segments(spark, d).select("seg_id", r6(segment.pixel_distance(segment.length(), float(SIDE), F.lit(0.0005)), "d"))


def rasterize_segments(spark, d):
    return _pixels(spark, d).groupBy("map_id").agg(F.count(F.lit(1)).alias("n_pixels"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


def pixel_multiset(spark, d):
    return raster.pixel_totals(_pixels(spark, d)).drop("level")


def downsample_pyramid(spark, d):
    small = raster.pyramid(_pixels(spark, d), [0, 1, 2, 3])
    return raster.pixel_totals(small).groupBy("map_id", "level").agg(F.count(F.lit(1)).alias("n_pixels"), F.sum("total").alias("total"))


def _density_sizes(spark, d) -> DataFrame:
    sizes = [(i, 15.0 * 1.5**i) for i in range(8)]
    maps = views.segments(spark, d).select("map_id").distinct()
    return maps.select("map_id", F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(s).alias("s")) for i, s in sizes])).alias("v")).select("map_id", "v.step", "v.s", F.lit(SIDE).alias("w"), F.lit(SIDE).alias("h"))


def map_density(spark, d):
    return density.densities(_pixels(spark, d), _density_sizes(spark, d)).select("map_id", "step", r6("density", "density"))


def density_optimal_size(spark, d):
    maps = views.segments(spark, d).select("map_id").distinct().select("map_id", F.lit(SIDE).alias("w"), F.lit(SIDE).alias("h"))
    return density.optimal_sizes(_pixels(spark, d), maps, 0.05, 15.0)


def grid_points(spark, d):
    levels = spark.createDataFrame([("m", level, r, 1000 >> level, 800 >> level) for level in range(3) for r in grid.valid_radii(DescriptorConfig())], "map_id string, level int, radius int, w int, h int")
    points = grid.grid_points(levels)
    return points.groupBy("map_id", "level", "radius").agg(F.count_distinct("col").alias("n_cols"), F.count_distinct("row").alias("n_rows"), F.max("gx").cast("long").alias("last_x"), F.max("lin").cast("long").alias("last"))


def scale_plan(spark, d):
    return grid.scale_plans(spark, [(15, 15), (16, 100), (25, 100), (30, 120), (50, 500)])


def keypoint_pixel_count(spark, d):
    segs = views.segments(spark, d)
    seen = grid.near_keypoints(raster.rasterize(segs, SIDE, SIDE), _levels(spark, segs))
    counts = seen.groupBy("map_id", "lin").agg(F.count(F.lit(1)).alias("n_elements"), F.count_distinct("seg_id").alias("n_segs"))
    return counts.where(F.col("n_segs") > DescriptorConfig().min_segs)


def gaussian_weights(spark, d):
    side = spark.range(0, RADIUS + 1)
    cells = side.select(F.col("id").alias("dx"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(RADIUS).cast("long"))).alias("dy"))
    return cells.select("dx", "dy", F.round(descriptor.gaussian(F.col("dx"), F.col("dy"), F.lit(RADIUS), F.lit(descriptor.gaussian_norm(RADIUS))), 8).alias("w"))


def global_orientation_hist(spark, d):
    roads = _roads(spark, d)
    hist = descriptor.histograms(roads, SIDE, SIDE, _levels(spark, roads))
    return hist.select("map_id", "lin", *[r6(F.col("hist")[b], f"h{b}") for b in range(DescriptorConfig().bins)])


def ref_angle(spark, d):
    roads = _roads(spark, d)
    hist = descriptor.histograms(roads, SIDE, SIDE, _levels(spark, roads))
    return hist.select("map_id", "lin", r6(descriptor.reference_angle(F.col("hist"), DescriptorConfig().bins), "angle"))


def lrp_descriptor(spark, d):
    roads = _roads(spark, d)
    made = descriptor.describe(roads, SIDE, SIDE, _levels(spark, roads))
    add = lambda f: F.aggregate("desc", F.lit(0.0), lambda t, x: t + f(x))
    weighted = F.aggregate(F.transform("desc", lambda x, i: x * (i + 1)), F.lit(0.0), lambda t, x: t + x)
    return made.select("map_id", "lin", F.size(F.filter("desc", lambda x: x > 1e-12)).cast("long").alias("n_nonzero"), F.round(add(lambda x: x), 5).alias("total"), F.round(F.sqrt(add(lambda x: x * x)), 5).alias("l2"), F.round(weighted, 4).alias("placed"), "decision")


def half_choice_counts(spark, d):
    return lrp_descriptor(spark, d).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def normalize_cap(spark, d):
    vec = descriptor.normalize_cap(F.col("embedding").cast("array<double>"), 0.15)
    return views.table(spark, d, "embeddings").select("vec_id", vec.alias("v")).select("vec_id", r6(F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)), "l2"), r6(F.array_max("v"), "top"))


def knn2_exact(spark, d):
    return match.knn2(*views.descriptors(spark, d)).select("qid", "rn", "rid", r6("dist", "dist"))


def snn_ratio_match(spark, d):
    return _matches(spark, d).select("qid", "rid")


def matches_per_ref(spark, d):
    return match.matches_per_ref(_matches(spark, d), views.descriptors(spark, d)[1])


def ref_sampling_prob(spark, d):
    return match.sampling_probabilities(_matches(spark, d)).select("ref_id", r6("p", "p"))


def _model_columns() -> list[Column]:
    return [F.round(c, 4).alias(c) if c in ("tx", "ty") else r6(c, c) for c in model.MODEL]


def lstsq_similarity(spark, d):
    return model.fit(_match_rows(spark, d)).select("ref_id", *_model_columns())


def ransac_pair_models(spark, d):
    return model.hypotheses(_match_rows(spark, d)).select("ref_id", "hyp", *_model_columns())


def model_inliers(spark, d):
    rows = _match_rows(spark, d)
    return model.inlier_counts(rows, model.hypotheses(rows), _WIDE)


#: The derived keypoints are random: tolerances that some pairs meet.
_WIDE = MatchConfig(dtol=8.0, atol=0.2)


def best_hypothesis(spark, d):
    rows = _match_rows(spark, d)
    models = model.hypotheses(rows)
    return model.best(models, model.inlier_counts(rows, models, _WIDE)).select("ref_id", "hyp", "n_inliers")


def refined_models(spark, d):
    return model.estimate(_match_rows(spark, d), _WIDE).select("ref_id", "qid", "n_inliers", *_model_columns())


def weighted_inliers(spark, d):
    return identify.weighted_inliers(_match_rows(spark, d)).select("ref_id", r6("w", "w"))


def identify_confidence(spark, d):
    config = MatchConfig(min_inliers=0.5, min_metric=50.0)
    rows = _match_rows(spark, d)
    maps = rows.select("ref_id").distinct().withColumn("metric_scale", F.lit(2.0))
    band = identify.in_metric_band(model.fit(rows), maps, SIDE, config).select("ref_id")
    return identify.confidences(identify.weighted_inliers(rows.join(band, "ref_id", "left_semi")), config).select("ref_id", r6("confidence", "confidence"))


def model_box_corners(spark, d):
    refs = views.segments(spark, d).select(F.col("map_id").alias("ref_id")).distinct()
    models = refs.select("ref_id", *[F.lit(v).alias(n) for v, n in zip(MODEL, model.MODEL)])
    return render.box_corners(models, SIDE, SIDE)


def overlay_inverse_model(spark, d):
    return render.overlay(views.segments(spark, d), *MODEL)


def svg_lines(spark, d):
    whole = views.segments(spark, d).select("map_id", "seg_id", *[F.floor(c).cast("double").alias(c) for c in COORDS])
    return whole.select("map_id", "seg_id", render.svg_line().alias("svg"))


def svg_documents(spark, d):
    whole = views.segments(spark, d).select("map_id", "seg_id", *[F.floor(c).cast("double").alias(c) for c in COORDS])
    return render.svg_document(whole)


def truncated_pixels(spark, d):
    return render.truncated_ends(views.segments(spark, d)).select("map_id", "seg_id", *COORDS)


def _documents(spark, d) -> DataFrame:
    return views.table(spark, d, "events").select("event_id", F.parse_json("props").alias("params"))


def results_filter_json(spark, d):
    rows = results.select(_documents(spark, d), params={"k": 7})
    return rows.select("event_id", results.get(F.col("params"), "k", "bigint").alias("k"))


def results_project_json(spark, d):
    return _documents(spark, d).select("event_id", results.project(F.col("params"), ["k", "a.b"]).alias("doc"))


def fuzz_missing_count(spark, d):
    segs = views.segments(spark, d)
    kept = fuzz.remove(segs, 0.1, 5).groupBy("map_id").agg(F.count(F.lit(1)).alias("n_kept"))
    return segs.groupBy("map_id").agg(F.count(F.lit(1)).alias("n_total")).join(kept, "map_id")


def union_extra_segments(spark, d):
    return fuzz.fuzz(views.segments(spark, d), fuzz.Noise(extra=0.1), SIDE, SIDE, 5).groupBy("map_id").agg(F.count(F.lit(1)).alias("n_total"), F.count_distinct("seg_id").alias("n_ids"))


def removed_segments(spark, d):
    segs = views.segments(spark, d)
    gone = segs.join(fuzz.remove(segs, 0.1, 5), ["map_id", "seg_id"], "left_anti")
    return gone.groupBy("map_id").agg(F.count(F.lit(1)).alias("n_gone"))


def fuzz_missing(spark, d):
    return fuzz.remove(views.segments(spark, d), 0.1, 5).select("map_id", "seg_id")


def fuzz_jitter(spark, d):
    return fuzz.jitter(views.segments(spark, d), 1.0, 5).select("map_id", "seg_id", *_coords())


def fuzz_inaccuracy(spark, d):
    return fuzz.misplace(views.segments(spark, d), 1.0, 5).select("map_id", "seg_id", *_coords())


def fuzz_extra(spark, d):
    segs = views.segments(spark, d)
    maps = segs.groupBy("map_id").agg(F.count(F.lit(1)).alias("n"), (F.max("seg_id") + 1).alias("next_id")).withColumns({"w": F.lit(float(SIDE)), "h": F.lit(float(SIDE))})
    return fuzz.added(maps, 0.1, 40.0, 20.0, 5).select("map_id", "seg_id", *_coords())


def fuzz_all(spark, d):
    """All kinds of noise, one after the other."""
    return fuzz.fuzz(views.segments(spark, d), fuzz.Noise(0.1, 1.0, 2.0, 0.05), SIDE, SIDE, 7).select("map_id", "seg_id", *_coords())


def shift_segments(spark, d):
    return views.segments(spark, d).select("seg_id", *segment.shifted(12.5, -7.25)).select("seg_id", *_coords())


def map_image_pixels(spark, d):
    image = render.map_image(_normal(views.segments(spark, d)), 800, 800, 800, 2, 0.05)
    return image.groupBy("map_id").agg(F.count(F.lit(1)).alias("n_pixels"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


def wide_pixels(spark, d):
    image = raster.drawn_pixels(views.segments(spark, d), SIDE, SIDE, 3)
    return image.groupBy("map_id").agg(F.count(F.lit(1)).alias("n_pixels"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


def match_picture(spark, d):
    return render.match_picture(_match_rows(spark, d), SIDE).fillna(-1)


def npy_round_trip(spark, d):
    """Segments written as .npy files, one a map, and read again."""
    files = arrays.npy_files(views.segments(spark, d))
    back = arrays.segments_of(files).groupBy("map_id")
    return back.agg(F.count(F.lit(1)).alias("n"), F.max("seg_id").alias("last"), *[r6(F.sum(c), c) for c in COORDS])


def _entries() -> list[Column]:
    """How many numbers of a descriptor are not zero, and a digest of all of them in hundred thousandths."""
    each = F.transform("desc", lambda v, k: F.concat(k.cast("string"), F.lit(":"), F.round(v * 100000).cast("long").cast("string")))
    some = F.filter(each, lambda e: ~e.endswith(":0"))
    return [F.size(some).cast("long").alias("n"), F.md5(F.array_join(some, ",").cast("binary")).alias("digest")]


def lrp_descriptor_entries(spark, d):
    """Every number of the descriptors of two octaves and all radii that is not zero."""
    roads = _roads(spark, d)
    octaves = [(k, r) for k in (0, 1) for r in grid.valid_radii(DescriptorConfig())]
    sizes = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(r).alias("radius"), F.lit(SIDE >> k).alias("w"), F.lit(SIDE >> k).alias("h")) for k, r in octaves]))
    levels = roads.select("map_id").distinct().select("map_id", sizes.alias("s")).select("map_id", "s.*")
    made = descriptor.describe(roads, SIDE, SIDE, levels)
    return made.select("map_id", "level", "radius", "lin", *_entries())


def lrp_descriptor_override(spark, d):
    """Descriptors with one reference angle for all keypoints."""
    roads = _roads(spark, d)
    made = descriptor.describe(roads, SIDE, SIDE, _levels(spark, roads), angle=0.5)
    return made.select("map_id", "lin", "decision", *_entries())


def identify_many(spark, d):
    """Two test maps at once, by test_id: how many inliers each hypothesis of each has."""
    rows = _match_rows(spark, d).withColumn("test_id", F.when(F.col("qid") % 10 == 0, "even").otherwise("odd"))
    models = model.hypotheses(rows)
    best = model.best(models, model.inlier_counts(rows, models, _WIDE))
    return best.select("test_id", "ref_id", "hyp", "n_inliers")


def downscaled_roads(spark, d):
    return raster.downscaled_roads(views.segments(spark, d), 2).select("map_id", "seg_id", *_coords(), r6("angle_u", "angle_u"))


def descriptor_budget(spark, d):
    points = grid.grid_points(_levels(spark, views.segments(spark, d)))
    return points.groupBy("map_id").agg(F.count(F.lit(1)).alias("n"))


def multiset_union(spark, d):
    both = raster.union(_pixels(spark, d), _pixels(spark, d))
    return raster.pixel_totals(both).groupBy("map_id").agg(F.count(F.lit(1)).alias("n_pixels"), F.sum("total").alias("total"))


def keypoint_scale(spark, d):
    points = grid.grid_points(_levels(spark, views.segments(spark, d)).withColumn("level", F.lit(2)))
    placed = descriptor.keypoints(points.withColumn("angle", F.lit(0.0)))
    return placed.select("map_id", "lin", F.col("x").cast("long"), F.col("y").cast("long"), F.col("s").cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = (
        parse_wkt_osgb36, parse_wkt_latlong, condition_osgb36, condition_latlong, earth_radius, seg_lengths, seg_angles_oriented, seg_angles_unoriented,
        filter_length, seg_bounds, seg_bounds_large, seg2line, line_intersect_homog, intersect_segments, clip_to_rect, transform_affine,
        transform_perspective, perspective_segments, imager_scaled_described, metric_distance, pixel_distance, rasterize_segments, pixel_multiset,
        downsample_pyramid, map_density, density_optimal_size, grid_points, scale_plan, keypoint_pixel_count, gaussian_weights,
        global_orientation_hist, ref_angle, lrp_descriptor, half_choice_counts, normalize_cap, knn2_exact, snn_ratio_match, matches_per_ref,
        ref_sampling_prob, lstsq_similarity, ransac_pair_models, model_inliers, best_hypothesis, refined_models, weighted_inliers, identify_confidence,
        model_box_corners, overlay_inverse_model, svg_lines, svg_documents, truncated_pixels, results_filter_json, results_project_json,
        fuzz_missing_count, fuzz_missing, union_extra_segments, removed_segments, fuzz_jitter, fuzz_inaccuracy, fuzz_extra, fuzz_all, shift_segments, map_image_pixels,
        wide_pixels, match_picture, npy_round_trip, lrp_descriptor_entries, lrp_descriptor_override, identify_many, downscaled_roads, descriptor_budget, multiset_union, keypoint_scale,
    )
    return {f.__name__: f for f in names}
