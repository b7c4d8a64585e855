"""Test maps as they arrive, against a catalogue that stands still."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strada.operators import match


def read_descriptors(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the descriptor files that appear in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def matches_of(batch: DataFrame, refs: DataFrame, ratio: float = 0.95) -> DataFrame:
    """(map_id, qid, rid, ref_id, d1, d2) of a batch of (map_id, qid, desc)."""
    # Two maps of a batch may use the same qid: rows are matched by both.
    own = batch.withColumn("__q", F.xxhash64("map_id", "qid"))
    found = match.ratio_matches(match.knn2(own.select(F.col("__q").alias("qid"), "desc"), refs), ratio)
    return found.withColumnRenamed("qid", "__q").join(own.select("map_id", "qid", "__q"), "__q").select("map_id", "qid", "rid", "ref_id", "d1", "d2")


def start(stream: DataFrame, refs: Callable[[], DataFrame], out: str, checkpoint: str, ratio: float = 0.95, once: bool = True) -> StreamingQuery:
    """Match each micro-batch and write it to its own folder, so that a batch run again replaces itself.

    `refs` is called for each batch: maps added to the catalogue meanwhile count from the next on.
    """

    def one(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        matches_of(held, refs(), ratio).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch_id={number}")
        held.unpersist()

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
