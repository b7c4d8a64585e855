"""Formulas against values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strada.functions import planar, segment, transform
from strada.operators import conditioning, descriptor, grid, model, raster, results
from strada.schema import DescriptorConfig
from strada.sources import wkt

SEG = "map_id string, seg_id long, x1 double, y1 double, x2 double, y2 double"


def segs(spark, *rows):
    return spark.createDataFrame([("m", i, *map(float, r)) for i, r in enumerate(rows)], SEG)


@pytest.mark.parametrize("line,name,want", [
    ("LINESTRING(1.5 -2, 3 4)", "latlong", (-2.0, 1.5, 4.0, 3.0)), ("LINESTRING(1.5 -2, 3 4)", "osgb36", None), ("LINESTRING(1 2,3 4)", "osgb36", None),
    ("LINESTRING(1 2, 3 4, 5 6)", "latlong", None), ("  (1 2, 3 4)", "osgb36", (1.0, 2.0, 3.0, 4.0)), ("LINESTRING (1 2, 3 4) rest", "OSGB36", (1.0, 2.0, 3.0, 4.0)),
])
def test_lines(spark, line, name, want):
    got = wkt.parse(spark.createDataFrame([(line,)], "value string"), name).collect()
    assert [tuple(r) for r in got] == ([want] if want else [])


def test_lenient_lines(spark):
    got = wkt.parse_polylines(spark.createDataFrame([("LINESTRING(1 2,3e1 4, +5 .6)",)], "value string"), "osgb36").collect()
    assert [tuple(r) for r in got] == [(1, 2, 30, 4), (30, 4, 5, 0.6)]
    with pytest.raises(wkt.UnknownCoordinateSystem):
        wkt.system("utm")


def test_condition(spark):
    raw = segs(spark, (530000, 180000, 530400, 180300), (530100, 180500, 531000, 180500))
    got = [tuple(r)[2:] for r in conditioning.condition(raw, "osgb36").orderBy("seg_id").collect()]
    assert np.allclose(got, [(0, 0.5, 0.4, 0.2), (0.1, 0, 1, 0)])
    meta = conditioning.scaling(raw, "osgb36").first()
    assert np.isclose(meta["world"], 0.001) and (meta["x_max"], meta["y_max"]) == (1.0, 0.5)
    plain, degrees = (conditioning.scaling(raw.select("map_id", "seg_id", *[(F.col(c) / 10000).alias(c) for c in segment.COORDS]), "latlong", degrees_as_radians=d).first() for d in (False, True))
    assert np.isclose(plain["world"] / degrees["world"], 180 / math.pi)


def test_earth_radius(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 45.0, 51.5, 90.0)], "lat double")
    assert np.allclose([r[0] for r in df.select(conditioning.earth_radius(F.col("lat"))).collect()], [6378137.0, 6367489.537, 6365082.052, 6356752.3], atol=1e-3)


LINES = [
    ((0, 0, 4, 2), [(0, 0), (1, 1), (2, 1), (3, 2), (4, 2)]), ((0, 0, 2, 4), [(0, 0), (1, 1), (1, 2), (2, 3), (2, 4)]), ((0, 2, 4, 0), [(0, 2), (1, 1), (2, 1), (3, 0), (4, 0)]),
    ((0, 0, 6, 1), [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 1)]), ((1, 1, 1, 1), [(1, 1)]), ((-0.5, 0.5, 2.5, 0.5), [(-1, 1), (0, 1), (1, 1), (2, 1), (3, 1)]),
]


def test_raster(spark):
    both = [r for r, _ in LINES] + [(r[2], r[3], r[0], r[1]) for r, _ in LINES]
    got = {}
    for r in raster.line_pixels(segs(spark, *both), "seg_id").collect():
        got.setdefault(r["seg_id"], set()).add((r["x"], r["y"]))
    for k, (_, want) in enumerate(LINES):
        assert got[k] == got[k + len(LINES)] == set(want)


def test_pyramid_composes(spark):
    rng = np.random.default_rng(1)
    pixels = raster.rasterize(segs(spark, *rng.uniform(-10, 110, (40, 4)).tolist()), 100, 100)
    twice = raster.downsample(raster.downsample(pixels, 1), 1)
    assert twice.exceptAll(raster.downsample(pixels, 2)).count() == 0
    levels = raster.pyramid(pixels, [0, 2])
    assert levels.where("level = 2").exceptAll(twice).count() == 0 and levels.where("level = 0").exceptAll(pixels).count() == 0
    assert raster.union(pixels, pixels).agg(F.sum("cnt")).first()[0] == 2 * pixels.count()
    with pytest.raises(ValueError):
        raster.downsample(pixels, -1)


CLIPS = [
    ((0.2, 0.2, 0.8, 0.4), (0.2, 0.2, 0.8, 0.4)), ((0.5, 0.5, 1.5, 0.5), (0.5, 0.5, 1, 0.5)), ((1.5, 0.5, 0.5, 0.5), (0.5, 0.5, 1, 0.5)), ((2, 0.5, -1, 0.5), (0, 0.5, 1, 0.5)),
    ((0, 0.5, 2, 0.5), (0, 0.5, 0, 0.5)), ((-1, 2, 2, -1), (0, 1, 1, 0)), ((-0.5, 0.5, 0.5, 1.5), (0, 1, 0, 1)), ((2, 2, 3, 3), None),
]


def test_clip(spark):
    one = [F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)]
    got = {r["seg_id"]: r for r in conditioning.clip(segs(spark, *[c for c, _ in CLIPS]), *one).collect()}
    for k, (_, want) in enumerate(CLIPS):
        assert (k in got) == (want is not None)
        if want:
            assert np.allclose(tuple(got[k])[2:6], want) and got[k]["is_degenerate"] == (want[:2] == want[2:])


def test_homogeneous(spark):
    p = planar.to_euclidean(planar.cross((F.lit(1.0), F.lit(0.0), F.lit(-2.0)), (F.lit(0.0), F.lit(1.0), F.lit(-3.0))))
    far = planar.to_euclidean(planar.to_homogeneous((F.lit(1.0), F.lit(0.0)))[:2] + (F.lit(0.0),))
    assert tuple(spark.range(1).select(*p, *far).first()) == (2.0, 3.0, None, None)


@pytest.mark.parametrize("low,high,want", [(15, 15, (0, 1, 0, 2)), (16, 100, (0, 1, 3, 2)), (25, 100, (0, 0, 3, 2)), (30, 120, (1, 1, 3, 2)), (50, 500, (1, 0, 5, 2))])
def test_scale_plan(low, high, want):
    plan = grid.scale_plan(low, high)
    assert (plan.smin, plan.rmin_idx, plan.smax, plan.rmax_idx) == want
    assert grid.valid_radii(DescriptorConfig()) == [15, 19, 24]


def test_weights(spark):
    assert np.isclose(descriptor.gaussian_norm(15), 22.764427115983803)
    for r, g0, gr, w in ((15, 0.04392819, 0.01616028, (0.5, 0.642857, 0.785714)), (19, 0.03479381, 0.01279993, (0.5, 0.611111, 0.722222)), (24, 0.02761643, 0.01015952, (0.5, 0.583333, 0.666667))):
        n = F.lit(descriptor.gaussian_norm(r))
        got = spark.range(1).select(*[descriptor.gaussian(F.lit(d), F.lit(d), F.lit(r), n) for d in (0, r)], *[descriptor.cell_position(F.lit(i), F.lit(r), DescriptorConfig())[1] for i in range(3)]).first()
        exact = lambda d: math.exp(-d * d / r**2) / (descriptor.gaussian_norm(r))
        assert np.isclose(got[0], exact(0)) and np.isclose(got[1], exact(r)) and np.allclose(got[2:], w, atol=1e-6)
        assert np.isclose(got[0], g0, atol=1e-8) and np.isclose(got[1], gr, atol=1e-8)


def test_reference_angle(spark):
    df = spark.createDataFrame([([1.0, 2.0, 5.0, 4.0, 1.0, 0.0, 0.0, 0.0, 1.0],), ([1.0] * 9,)], "h array<double>")
    got = [r[0] for r in df.select(descriptor.reference_angle(F.col("h"), 9)).collect()]
    assert np.isclose(got[0], 0.7853981633974483) and got[1] is None


def test_normalize_cap(spark):
    df = spark.createDataFrame([([0.9, 0.3, 0.1, 0.1],), ([0.0, 0.0],)], "v array<double>")
    got = [r[0] for r in df.select(descriptor.normalize_cap(F.col("v"), 0.15)).collect()]
    assert np.allclose(got[0], [0.580632, 0.580632, 0.403567, 0.403567], atol=1e-6) and got[1] == [None, None]


MATCHES = [(100, 50, 30, 10, 20, 15), (140, 110, 38, 40, 40, 19), (90, 130, 60, 50, 15, 30), (60, 70, 48, 20, -2, 24)]


def test_similarity_fit(spark):
    rows = [("all", *map(float, m), 1000.0, 400.0) for m in MATCHES] + [("two", *map(float, m), 1000.0, 400.0) for m in MATCHES[:2]] + [("one", *map(float, MATCHES[0]), 1000.0, 400.0)]
    rows += [("same", *map(float, MATCHES[0]), 1000.0, 400.0)] * 2
    df = spark.createDataFrame(rows, "ref_id string, xr double, yr double, sr double, xt double, yt double, st double, c_ref double, c_test double")
    got = {r["ref_id"]: tuple(r)[1:] for r in model.fit(df).collect()}
    assert set(got) == {"all", "two"}
    assert np.allclose(got["all"], (87.724616, 56.146881, 0.846163, 0.263086), atol=1e-6) and np.allclose(got["two"], (96.923077, 5.384615, 2.0, 0.394791), atol=1e-6)


def test_transforms(spark):
    m = transform.rotation((0.1, 0.2, 0.3))[:3, :3]
    assert np.allclose(m @ m.T, np.eye(3)) and np.isclose(np.linalg.det(m), 1)
    with pytest.raises(ValueError):
        transform.axis_rotation("w", 1.0)
    m, (h, w) = transform.perspective(600, 800, 500, (25, -10, 5))
    got = spark.createDataFrame([(0.0, 0.0, 800.0, 0.0), (0.0, 600.0, 800.0, 600.0)], "x1 double, y1 double, x2 double, y2 double").select(transform.transformed(m)).toPandas()
    x, y = got[["x1", "x2"]].to_numpy(), got[["y1", "y2"]].to_numpy()
    assert np.isclose(x.min(), 0, atol=1e-6) and np.isclose(y.min(), 0, atol=1e-6) and np.isclose(max(np.ptp(x), np.ptp(y)), 500) and abs(h - y.max()) <= 1 and abs(w - x.max()) <= 1
    turned, size = transform.image_rotation(100, 200, 90)
    assert size == (200, 100) and turned.shape == (2, 3)


def test_results(spark, tmp_path):
    path = str(tmp_path / "r")
    results.append(spark, path, {"a": {"b": 1}, "name": "x"}, {"ok": True}, {"host": "one"})
    results.append(spark, path, {"a": 5}, {"ok": False})
    rows = results.read(spark, path)
    assert results.select(rows, {"a.b": 1}, {"ok": True}).count() == 1
    assert results.select(rows, {"a.b": None}).count() == 1 and results.select(rows, {"name": "y"}).count() == 0
    assert sorted(r[0] for r in rows.select(results.project(F.col("params"), ["a.b", "name"])).collect()) == ['{"a":{"b":"1"},"name":"x"}', '{"a":{"b":null},"name":null}']
    merged = results.merged_metadata(rows.withColumn("seq", F.monotonically_increasing_id())).first()["meta"]
    assert merged == {"host": "one"}
