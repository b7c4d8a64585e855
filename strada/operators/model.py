"""Similarity transforms from matches: hypotheses, inliers, refits.

A match row has xr, yr, sr, o_r (reference) and xt, yt, st, o_t (test), c_ref and c_test, the longer
sides of the two maps. A model is (tx, ty, s, o): p_ref = s R(o) p_test + t.

Matches of one test map are known by ref_id. Where they have a column test_id too, any number of test
maps go through one plan: whatever is said of a map holds for each (test_id, ref_id), and what is shared
among reference maps (hypotheses, early acceptance) is shared within each test map.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strada.functions.transform import similarity, similarity_inverse
from strada.schema import MatchConfig

MODEL = ("tx", "ty", "s", "o")


def maps_of(rows: DataFrame) -> list[str]:
    """The columns that tell pairs of a test and a reference map apart."""
    return ["test_id", "ref_id"] if "test_id" in rows.columns else ["ref_id"]


def of_tests(rows: DataFrame, keys: list[str], *values: Column) -> DataFrame:
    """Aggregates of each test map, or of all rows if there is one test map only."""
    return rows.groupBy(*keys[:-1]).agg(*values) if len(keys) > 1 else rows.agg(*values)


def with_tests(rows: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the aggregates of their test map."""
    return rows.join(sums, keys[:-1]) if len(keys) > 1 else rows.join(F.broadcast(sums))  # one row


def _weighted(rows: DataFrame, suffix: str = "") -> DataFrame:
    """With the square of the harmonic mean of both sides' precision, as w."""
    wr, wt = F.col("c_ref") / F.col("sr" + suffix), F.col("c_test") / F.col("st" + suffix)
    return rows.withColumn("w" + suffix, F.pow(2 * wr * wt / (wr + wt), 2))


def _terms(suffix: str = "") -> dict[str, Column]:
    """What a match adds to the sums of the weighted fit, as products of complex numbers."""
    w, xr, yr, xt, yt = (F.col(c + suffix) for c in ("w", "xr", "yr", "xt", "yt"))
    return {"w": w, "xr": w * xr, "yr": w * yr, "xt": w * xt, "yt": w * yt, "re": w * (xr * xt + yr * yt), "im": w * (yr * xt - xr * yt), "tt": w * (xt * xt + yt * yt), "rr": w * (xr * xr + yr * yr)}


def _solved(sums: DataFrame, *keys: str) -> DataFrame:
    """(keys, tx, ty, s, o) of sums named __w ... and n: the model of least weighted squares.

    Groups of under two matches, or whose points coincide, have none. In steps of few
    columns, each made once.
    """
    means = sums.where("n >= 2 and __w > 0").withColumns({f"__m{k}": F.col(f"__{k}") / F.col("__w") for k in ("xr", "yr", "xt", "yt")})
    m = {k: F.col(f"__m{k}") for k in ("xr", "yr", "xt", "yt")}
    w = F.col("__w")
    centred = means.withColumns({
        "__ct": F.col("__tt") - w * (m["xt"] * m["xt"] + m["yt"] * m["yt"]), "__cr": F.col("__rr") - w * (m["xr"] * m["xr"] + m["yr"] * m["yr"]),
        "__ce": F.col("__re") - w * (m["xr"] * m["xt"] + m["yr"] * m["yt"]), "__ci": F.col("__im") - w * (m["yr"] * m["xt"] - m["xr"] * m["yt"]),
    })
    apart = centred.where("__ct > 1e-9 * __tt and (n > 2 or __cr > 1e-9 * __rr)")
    turn = apart.withColumns({"__a": F.col("__ce") / F.col("__ct"), "__b": F.col("__ci") / F.col("__ct")}).withColumn("o", F.atan2("__b", "__a"))
    a, b = F.col("__a"), F.col("__b")
    return turn.select(
        *keys, (m["xr"] - (a * m["xt"] - b * m["yt"])).alias("tx"), (m["yr"] - (a * m["yt"] + b * m["xt"])).alias("ty"),
        F.sqrt(a * a + b * b).alias("s"), F.when(F.col("o") >= math.pi, F.col("o") - 2 * math.pi).otherwise(F.col("o")).alias("o"),
    )


def fit(matches: DataFrame, *keys: str) -> DataFrame:
    """(keys, tx, ty, s, o): the weighted least-squares similarity of each group, from plain sums."""
    keys = keys or tuple(maps_of(matches))
    sums = _weighted(matches).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"__{k}") for k, v in _terms().items()])
    return _solved(sums, *keys)


def numbered(matches: DataFrame) -> DataFrame:
    """With k, the match's number in its map from 0, and n, how many there are."""
    by_ref = Window.partitionBy(*maps_of(matches))
    return matches.withColumns({"k": F.row_number().over(by_ref.orderBy("qid")) - 1, "n": F.count(F.lit(1)).over(by_ref)})


def hypotheses(matches: DataFrame, config: MatchConfig | None = None) -> DataFrame:
    """(maps, hyp, tx, ty, s, o): models of sampled pairs of matches.

    A map gets its share of max_hypotheses, by its number of matches. The pairs come from a
    fixed arithmetic sequence instead of a random generator, so runs agree.
    """
    config = config or MatchConfig()
    keys = maps_of(matches)
    some = numbered(matches).where("n >= 2")
    counts = some.groupBy(*keys).agg(F.first("n").alias("n"))
    total = of_tests(counts, keys, F.sum("n").alias("total"))
    budget = F.greatest(F.lit(1), F.floor(config.max_hypotheses * F.col("n") / F.col("total"))).cast("int")
    each = with_tests(counts, total, keys).withColumn("hyp", F.explode(F.sequence(F.lit(0), budget - 1)))
    i = F.pmod(F.col("hyp").cast("long") * 7919 + 13, F.col("n"))
    j = F.pmod(i + 1 + F.pmod(F.col("hyp").cast("long") * 104_729, F.col("n") - 1), F.col("n"))
    pairs = each.select(*keys, "hyp", i.alias("ka"), j.alias("kb"))
    values = ["xr", "yr", "sr", "xt", "yt", "st"]
    side = lambda s: some.select(*keys, F.col("k").cast("long").alias("k" + s), *[F.col(v).alias(v + s) for v in values], *(["c_ref", "c_test"] if s == "a" else []))
    both = pairs.join(side("a"), [*keys, "ka"]).join(side("b"), [*keys, "kb"])
    ta, tb = _terms("a"), _terms("b")
    sums = _weighted(_weighted(both, "a"), "b").select(*keys, "hyp", F.lit(2).alias("n"), *[(ta[k] + tb[k]).alias(f"__{k}") for k in ta])
    return _solved(sums, *keys, "hyp")


def is_inlier(config: MatchConfig | None = None) -> Column:
    """Whether a match agrees with a model in the same row, in angle and in place on both maps."""
    config = config or MatchConfig()
    xr, yr, xt, yt = (F.col(c) for c in ("xr", "yr", "xt", "yt"))
    model = [F.col(c) for c in MODEL]
    turn = F.col("o_r") - F.pmod(F.col("o_t") + F.col("o"), F.lit(math.pi))
    folded = F.when(turn < -math.pi / 2, turn + math.pi).when(turn >= math.pi / 2, turn - math.pi).otherwise(turn)
    fx, fy = similarity(xt, yt, *model)
    bx, by = similarity_inverse(xr, yr, F.col("tx"), F.col("ty"), F.nullif(F.col("s"), F.lit(0.0)), F.col("o"))
    far = ((fx - xr) * (fx - xr) + (fy - yr) * (fy - yr)) / (F.col("c_ref") * F.col("c_ref"))
    near = ((bx - xt) * (bx - xt) + (by - yt) * (by - yt)) / (F.col("c_test") * F.col("c_test"))
    size = F.pow(F.col("sr") / F.col("c_ref"), 2) + F.pow(F.col("st") / F.col("c_test"), 2)
    return (F.abs(folded) / (2 * math.pi) <= config.atol) & F.coalesce(far + near < config.dtol**2 * size, F.lit(False))


#: Parts of a reference map's hypotheses, each of which meets the map's matches in a task of its own.
SALT = 16


def inlier_counts(matches: DataFrame, models: DataFrame, config: MatchConfig | None = None) -> DataFrame:
    """(maps, hyp, n_inliers) of every hypothesis.

    Hypotheses are at most max_hypotheses a test map; a map's matches go to SALT parts of them, so
    that one map which holds most matches is not one task's work.
    """
    keys = maps_of(matches)
    part = F.pmod(F.col("hyp"), F.lit(SALT)).alias("__part")
    own = matches.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    scored = models.select("*", part).join(own, [*keys, "__part"]).withColumn("__in", is_inlier(config))
    return scored.groupBy(*keys, "hyp").agg(F.sum(F.col("__in").cast("long")).alias("n_inliers"))


def best(models: DataFrame, counts: DataFrame) -> DataFrame:
    """The hypothesis of each map with most inliers, the first of equals; none without an inlier."""
    keys = maps_of(models)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n_inliers"), "hyp"))
    return models.join(counts, [*keys, "hyp"]).where("n_inliers > 0").withColumn("__rn", rank).where("__rn = 1").drop("__rn")


def _refit(rows: pd.DataFrame, config: MatchConfig) -> pd.DataFrame:
    """One map: refit on the inliers until they stay the same; no row if none are left."""
    zr, zt = rows["xr"].to_numpy() + 1j * rows["yr"].to_numpy(), rows["xt"].to_numpy() + 1j * rows["yt"].to_numpy()
    sr, st, c_ref, c_test = (rows[c].to_numpy(float) for c in ("sr", "st", "c_ref", "c_test"))
    weight = (2 / (sr / c_ref + st / c_test)) ** 2
    size = (sr / c_ref) ** 2 + (st / c_test) ** 2
    t, scale, angle = rows["tx"].iloc[0] + 1j * rows["ty"].iloc[0], rows["s"].iloc[0], rows["o"].iloc[0]

    def agreeing() -> np.ndarray:
        turn = rows["o_r"].to_numpy() - np.mod(rows["o_t"].to_numpy() + angle, np.pi)
        turn = np.mod(turn + np.pi / 2, np.pi) - np.pi / 2
        a = scale * np.exp(1j * angle)
        far, near = np.abs(a * zt + t - zr) / c_ref, np.abs((zr - t) / a - zt) / c_test
        return (np.abs(turn) / (2 * np.pi) <= config.atol) & (far**2 + near**2 < config.dtol**2 * size)

    good = agreeing()
    for _ in range(config.refits):
        w = weight * good
        total = w.sum()
        if good.sum() < 2 or not total:
            return rows.iloc[:0]
        mr, mt = (w * zr).sum() / total, (w * zt).sum() / total
        spread = (w * np.abs(zt - mt) ** 2).sum()
        if spread <= 0 or not np.abs(a := (w * (zr - mr) * np.conj(zt - mt)).sum() / spread):
            return rows.iloc[:0]
        t, scale, angle = mr - a * mt, abs(a), np.angle(a)
        now = agreeing()
        if not now.any():
            return rows.iloc[:0]
        same, good = (now == good).all(), now
        if same:
            break
    out = rows[good].copy()
    out["tx"], out["ty"], out["s"], out["o"] = t.real, t.imag, scale, angle - 2 * np.pi * (angle >= np.pi)
    out["n_inliers"] = int(good.sum())
    return out


def refine(matches: DataFrame, chosen: DataFrame, config: MatchConfig | None = None) -> DataFrame:
    """The inliers of each map's refitted model: match columns and tx, ty, s, o, n_inliers.

    A group is the matches of one test map with one reference, at most one a test descriptor. If a map
    has reached `accept` inliers only those maps are refined.
    """
    config = config or MatchConfig()
    keys = maps_of(matches)
    sure = of_tests(chosen, keys, F.max("n_inliers").alias("top"))
    some = with_tests(chosen, sure, keys).where((F.col("top") < config.accept) | (F.col("n_inliers") >= config.accept))
    rows = matches.join(some.select(*keys, *MODEL), keys).withColumn("n_inliers", F.lit(0).cast("long"))
    return rows.groupBy(*keys).applyInPandas(lambda g: _refit(g, config), rows.schema)


def estimate(matches: DataFrame, config: MatchConfig | None = None) -> DataFrame:
    """Hypotheses, the best of each map, and its refined inliers."""
    models = hypotheses(matches, config)
    return refine(matches, best(models, inlier_counts(matches, models, config)), config)
