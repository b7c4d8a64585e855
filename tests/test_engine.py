"""Sources, stores, streams, noise, and the whole way from a map to its identification."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strada.operators import fuzz, grid, identify, match, raster, render
from strada.plans import pipeline
from strada.schema import DescriptorConfig, MatchConfig
from strada.sources import arrays, store
from strada.streaming import identify as streaming

SEG = "map_id string, seg_id long, x1 double, y1 double, x2 double, y2 double"


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    df = spark.createDataFrame([("a", 1), ("b", 2)], "map_id string, v int")
    assert not s.exists("x.y")
    with pytest.raises(store.MissingItem):
        s.data("x.y")
    s.put("x.y", df, by=("map_id",))
    assert s.has_data("x.y") and not s.has_meta("x.y")
    s.put("x.y", meta={"kind": "test", "n": [1, 2]})
    assert s.meta("x.y") == {"kind": "test", "n": [1, 2]}
    store.add_references(s, "x.y", df.where("v = 2").withColumn("map_id", F.lit("c")))
    assert s.data("x.y").count() == 3 and s.data("x.y", "b").select("v").first()["v"] == 2
    with pytest.raises(ValueError):
        s.path("../up")


def test_arrays(spark, tmp_path):
    np.save(tmp_path / "one.npy", np.arange(8.0).reshape(2, 1, 4))
    np.save(tmp_path / "none.npy", np.zeros((0, 7)))
    got = arrays.read_segments(spark, str(tmp_path / "*.npy")).orderBy("seg_id").collect()
    assert [tuple(r) for r in got] == [("one", 0, 0.0, 1.0, 2.0, 3.0), ("one", 1, 4.0, 5.0, 6.0, 7.0)]
    values = {r["name"]: r for r in arrays.read_arrays(spark, str(tmp_path / "*.npy")).collect()}
    assert values["one"]["shape"] == [2, 1, 4] and values["none"]["values"] == []
    with pytest.raises(arrays.BadSegments):
        arrays.as_segments(np.zeros((2, 3)))


def test_ingest(spark, tmp_path):
    (tmp_path / "m.txt").write_text("LINESTRING(0 0, 100 50)\nbad line\nLINESTRING(50 50, 300 50)\n")
    (tmp_path / "m.json").write_text(json.dumps({"file": str(tmp_path / "m.txt"), "gcs": "OSGB36", "gcs_params": {"truncate_rect": [0, 0, 200, 100], "altitude": 0}}))
    segs, meta = pipeline.ingest(spark, str(tmp_path / "m.json"))
    got = sorted(tuple(r)[2:] for r in segs.collect())
    assert np.allclose(got, [(0, 0.5, 0.5, 0.25), (0.25, 0.25, 1, 0.25)]) and meta.first()["truncate"]


def test_noise(spark):
    df = spark.createDataFrame([("m", i, float(i), 0.0, float(i), 10.0) for i in range(100)], SEG)
    kept = fuzz.remove(df, 0.25, 1)
    assert kept.count() == 75 and kept.exceptAll(fuzz.remove(df, 0.25, 1)).count() == 0
    moved = fuzz.misplace(df, 2.0, 1).select((F.col("x1") - F.col("x2")).alias("d"), F.round(F.col("y2") - F.col("y1"), 9).alias("l")).distinct().collect()
    assert [tuple(r) for r in moved] == [(0.0, 10.0)]
    noisy = fuzz.fuzz(df, fuzz.Noise(0.1, 1.0, 1.0, 0.5), 100, 100, 3)
    assert noisy.count() == 140 and noisy.select("seg_id").distinct().count() == 140


def test_two_nearest_and_streaming(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    refs = [(f"r{i % 3}", i, rng.normal(size=6).tolist()) for i in range(60)]
    refs += [("r9", 100, refs[0][2])]
    tests = [("t", i, (np.array(refs[i][2]) + rng.normal(size=6) * 0.05).tolist()) for i in range(12)]
    r = spark.createDataFrame(refs, "ref_id string, rid long, desc array<double>").repartition(3)
    t = spark.createDataFrame(tests, "map_id string, qid long, desc array<double>")
    monkeypatch.setattr(match, "TESTS", 5)
    monkeypatch.setattr(match, "REFS", 20)
    monkeypatch.setattr(match, "TILE", 2)
    got = {(x["qid"], x["rn"]): (x["rid"], x["dist"]) for x in match.knn2(t, r).collect()}
    for _, q, v in tests:
        near = sorted((float(np.linalg.norm(np.array(v) - np.array(d))), rid) for _, rid, d in refs)[:2]
        for n, (dist, rid) in enumerate(near, 1):
            assert got[q, n][0] == rid and np.isclose(got[q, n][1], dist)
    t.write.parquet(str(tmp_path / "in"))
    stream = streaming.read_descriptors(spark, str(tmp_path / "in"), t.schema)
    streaming.start(stream, lambda: r, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out"))
    want = match.ratio_matches(match.knn2(t, r))
    assert found.select("qid", "rid").exceptAll(want.select("qid", "rid")).count() == 0 and found.count() == want.count() == 11


def test_visible_share(spark):
    v = [F.lit(float(x)) for x in (10, 20, 15, 400, 300)]
    assert np.isclose(spark.range(1).select(identify.visible_share(*v)).first()[0], 0.805556, atol=1e-6)
    v = [F.lit(float(x)) for x in (100, 50, 30, 1000, 800)]
    assert np.isclose(spark.range(1).select(identify.visible_share(*v)).first()[0], 0.966944, atol=1e-6)


def test_svg(spark):
    df = spark.createDataFrame([("m", 0, 0.0, 0.0, 9.0, 4.0)], SEG)
    lines = [r["line"] for r in render.svg_document(df).orderBy("part").collect()]
    assert lines[0].startswith('<svg height="5" width="10">') and lines[1:] == ['<line x1="0.0" y1="0.0" x2="9.0" y2="4.0" />', "</g></svg>"]


def test_synthetic_descriptors(spark):
    """The integer map whose values were worked out beforehand."""
    rows = [("m", i, float(37 * i % 120), float(53 * i % 100), float(37 * i % 120 + 11 + 29 * i % 50), float(53 * i % 100 - 20 + 17 * i % 45)) for i in range(160)]
    rows = [(m, i, a, b, a + 11 + (29 * i) % 50, b - 20 + (17 * i) % 45) for m, i, a, b, _, _ in rows]
    got = pipeline.describe(spark.createDataFrame(rows, SEG), "m", 120, 100, grid.ScalePlan(0, 0, 0, 0)).collect()
    assert len(got) == 40 and not {0, 35} & {r["lin"] for r in got}
    by = {r["lin"]: r for r in got}
    for lin, angle, decision, nonzero, total, top in ((1, 3.105697755, "switch", 76, 6.748625249, 0.187351278), (2, 3.129469465, "switch", 72, 6.954477768, 0.185852294), (3, 0.028226524, "keep", 81, 7.409722090, 0.180898725), (41, 0.191508634, "switch", 89, 7.484738736, 0.189629795)):
        d = np.array(by[lin]["desc"])
        assert np.isclose(by[lin]["angle"], angle) and by[lin]["decision"] == decision and (d > 0).sum() == nonzero
        assert np.isclose(d.sum(), total) and np.isclose(d.max(), top) and np.isclose((d * d).sum(), 1)


def town(rng, n=260, w=520, h=420):
    """Irregular streets: jittered lattice lines, cut into pieces."""
    out = []
    while len(out) < n:
        x, y, a = rng.uniform(0, w), rng.uniform(0, h), rng.choice([0.15, 0.15 + math.pi / 2, rng.uniform(0, math.pi)])
        length = rng.uniform(25, 90)
        out.append((x, y, x + length * math.cos(a), y + length * math.sin(a)))
    return out


def test_a_turned_and_scaled_crop_is_found(spark, tmp_path):
    w, h = 520, 420
    maps = {f"town{k}": town(np.random.default_rng(k)) for k in range(2)}
    plan = grid.ScalePlan(0, 0, 1, 2)
    held = store.Store(spark, str(tmp_path))
    for name, lines in maps.items():
        df = spark.createDataFrame([(name, i, *map(float, s)) for i, s in enumerate(lines)], SEG)
        store.add_references(held, "refs", pipeline.describe(df, name, w, h, plan))
    refs = held.data("refs")
    s, o, tx, ty = 1.2, 0.25, 90.0, 20.0  # p_ref = s R p_test + t
    cos, sin = math.cos(o), math.sin(o)
    back = lambda x, y: ((cos * (x - tx) + sin * (y - ty)) / s, (cos * (y - ty) - sin * (x - tx)) / s)
    seen = [(*back(*p[:2]), *back(*p[2:])) for p in maps["town1"]]
    seen = [p for p in seen if 0 <= p[0] < 330 and 0 <= p[1] < 300]
    test = fuzz.jitter(spark.createDataFrame([("t", i, *p) for i, p in enumerate(seen)], SEG), 0.3, 7).persist()
    held.put("test", pipeline.describe(test, "t", 330, 300, plan))
    tests = held.data("test")
    sizes = spark.createDataFrame([(k, w, h) for k in maps], "map_id string, w int, h int")
    scales = spark.createDataFrame([(k, 2.0) for k in maps], "ref_id string, metric_scale double")
    found, inliers = pipeline.identify_map(tests, refs, (300, 330), sizes, scales, MatchConfig())
    got = {r["ref_id"]: r["confidence"] for r in found.collect()}
    assert max(got, key=got.get) == "town1" and np.isclose(sum(got.values()), 1)
    m = inliers.where("ref_id = 'town1'").first()
    assert abs(m["s"] / s - 1) < 0.05 and abs(math.remainder(m["o"] - o, math.pi)) < math.radians(4)
    assert DescriptorConfig().length == 144
    # Two test maps in one plan are found as each by itself; half of the keypoints are the other one's.
    half = tests.where("lin % 2 = 0").withColumn("map_id", F.lit("u"))
    alone, _ = pipeline.identify_map(half, refs, (300, 330), sizes, scales, MatchConfig())
    shapes = spark.createDataFrame([("t", 330, 300), ("u", 330, 300), ("v", 9, 9)], "map_id string, w int, h int")
    both, seen = pipeline.identify_maps(tests.unionByName(half), refs, shapes, sizes, scales, MatchConfig())
    want = {("t", k): v for k, v in got.items()} | {("u", r["ref_id"]): r["confidence"] for r in alone.collect()}
    have = {(r["test_id"], r["ref_id"]): r["confidence"] for r in both.collect()}
    assert have.keys() == want.keys() and all(np.isclose(have[k], want[k]) for k in want) and seen.select("test_id").distinct().count() == 2


def test_noise_does_not_depend_on_the_layout(spark):
    df = spark.createDataFrame([(f"m{i % 3}", i, float(i), 0.0, float(i), 10.0) for i in range(9000)], SEG)
    noise = fuzz.Noise(0.3, 1.0, 2.0, 0.1)
    one, two = (sorted(map(tuple, fuzz.fuzz(d, noise, 100, 100, 4).collect())) for d in (df, df.repartition(7, "y1")))
    assert one == two and len(one) == 3 * (2100 + 300)
    z = np.array([tuple(r) for r in spark.range(20_000).select(fuzz.normal(3, "id"), fuzz.uniform(3, "id")).collect()])
    assert abs(z[:, 0].mean()) < 0.03 and abs(z[:, 0].std() - 1) < 0.03 and abs(z[:, 1].mean() - 0.5) < 0.01
    assert [fuzz.remove(df, s, 1).count() for s in (0.0, 1.0, 2.0)] == [9000, 0, 0] and fuzz.remove(df.where("false"), 0.5, 1).count() == 0


def test_wide_lines(spark):
    df = spark.createDataFrame([("m", 0, 2.4, 2.0, 5.6, 2.0), ("m", 1, 0.0, 0.0, 0.0, 0.0)], SEG)
    dots = lambda w, cut=False: {(r["x"], r["y"]) for r in raster.drawn_pixels(df, 8, 8, w, cut).collect()}
    assert dots(1) == {(x, 2) for x in range(2, 7)} | {(0, 0)}
    assert dots(1, True) == {(x, 2) for x in range(2, 6)} | {(0, 0)}
    assert dots(3) == {(x, y) for x in range(1, 8) for y in (1, 2, 3)} | {(0, 0), (1, 0), (0, 1), (1, 1)}


def test_npy_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1.0, 2.0, 3.0, 4.0), ("a", 0, 5.0, 6.0, 7.0, 8.0)], SEG)
    arrays.save_segments(df, f"file://{tmp_path}/a.npy")
    assert np.load(tmp_path / "a.npy").tolist() == [[5, 6, 7, 8], [1, 2, 3, 4]]
    arrays.save_array(spark, f"file://{tmp_path}/b.npy", np.arange(3))
    assert np.load(tmp_path / "b.npy").tolist() == [0, 1, 2]
