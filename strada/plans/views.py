"""Segments, descriptors and keypoints derived from the test tables, which hold no roads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side of the square maps that the derived segments lie on.
SIDE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _coordinate(k: Column) -> Column:
    return F.lit(500.0) + F.lit(1000.0) * F.col("embedding")[k].cast("double")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 segments of each embedding; the map is its label."""
    rows = table(spark, sf_dir, "embeddings").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return rows.select(F.col("label").cast("string").alias("map_id"), (F.col("vec_id") * 16 + F.col("i")).alias("seg_id"), *[_coordinate(F.col("i") * 4 + k).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


def large_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment of each line item; seg_id is not unique."""
    x, y = F.col("l_quantity") * 20, F.col("l_extendedprice") / 105
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("map_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seg_id"), x.alias("x1"), y.alias("y1"), (x + 1000 * (F.col("l_discount") - 0.05)).alias("x2"), (y + 1000 * (F.col("l_tax") - 0.04)).alias("y2"))


def descriptors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(tests (qid, desc), references (ref_id, rid, desc)): every fifth embedding is a test."""
    rows = table(spark, sf_dir, "embeddings").withColumn("desc", F.col("embedding").cast("array<double>"))
    return rows.where("vec_id % 5 = 0").select(F.col("vec_id").alias("qid"), "desc"), rows.where("vec_id % 5 <> 0").select(F.col("label").cast("string").alias("ref_id"), F.col("vec_id").alias("rid"), "desc")


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, x, y, s, o)."""
    e = lambda k: F.col("embedding")[k].cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", _coordinate(F.lit(0)).alias("x"), _coordinate(F.lit(1)).alias("y"), (F.lit(15.0) + F.abs(e(2)) * 100).alias("s"), F.pmod(e(3) * 10, F.lit(3.141592653589793)).alias("o"))


def match_rows(spark: SparkSession, sf_dir: str, matches: DataFrame) -> DataFrame:
    """Matches with the keypoints of both sides, on square maps."""
    points = keypoints(spark, sf_dir)
    side = lambda a, b: points.select(F.col("vec_id").alias(a), *[F.col(c).alias(d) for c, d in zip("xyso", b)])
    both = matches.join(side("qid", ("xt", "yt", "st", "o_t")), "qid").join(side("rid", ("xr", "yr", "sr", "o_r")), "rid")
    return both.withColumns({n: F.lit(float(SIDE)) for n in ("c_ref", "c_test", "w_ref", "h_ref", "w_test", "h_test")})


def wkt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(map_id, seg_id, value): the segments as text, in whole numbers; some of them negative or in a form that isn't read."""
    segs = segments(spark, sf_dir)
    n = lambda c: (F.floor(F.col(c)) - 400).cast("int").cast("string")
    comma = F.when(F.col("seg_id") % 7 == 0, F.lit(",")).otherwise(F.lit(", "))
    return segs.select("map_id", "seg_id", F.concat(F.lit("LINESTRING("), n("x1"), F.lit(" "), n("y1"), comma, n("x2"), F.lit(" "), n("y2"), F.lit(")")).alias("value"))
