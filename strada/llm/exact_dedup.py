"""Operator 1, exact dedup: two-pass Bloom filtering.

Pass one hashes every normalised text and builds the filter of hashes that may be
repeated (`bloom`). Pass two tests each row: a row that the filter does not hold is
certainly unique and passes straight through; only the others shuffle, as (key,
SHA-256) without their text, and are grouped by the digest itself, so the filter's
false positives change nothing.

Texts are equal when identical after each run of ASCII white space became one space.
Of equal texts the row with the smallest key stays; of rows with equal text and equal
key (repeated rows) all have the same keep_id, and `keep_first` keeps one of them.

Skew: groups are counted with map-side aggregation, and the join that gives each row
its group has its own exchanges on both sides, so adaptive execution splits a
group that holds a third of all rows.

Defined results: a null text counts as empty, and all empty texts are equal; a null key
sorts before all others; an empty table gives an empty table; further columns,
whatever their names, are not read by `groups`, and are kept by `keep_first`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import SPACE, parts, scratch, text_or_empty, whole

OUT = ("keep_id", "group_size", "kept", "text_sha256")


def digests(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, hex SHA-256 of the normalised text, first 64 bits of it)."""
    normal = F.regexp_replace(text_or_empty(), f"{SPACE}+", " ")
    sha = docs.select(docs[key].alias("id"), F.sha2(normal.cast("binary"), 256).alias("sha"))
    return sha.select("id", "sha", F.xxhash64("sha").alias("h"))


def groups(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256."""
    rows = scratch(digests(docs, key), "digests")
    bits = bloom.bits_for(rows.count())
    plane = bloom.repeated(rows.select("h"), bits)

    @F.pandas_udf("boolean")
    def may_repeat(h: pd.Series) -> pd.Series:
        return pd.Series(bloom.holds(plane.value, h.to_numpy().astype(np.uint64)))

    tested = rows.withColumn("again", may_repeat("h"))
    alone = tested.where(~F.col("again")).select(F.col("id").alias(key), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    maybe = tested.where("again").select("id", "sha", "h")
    # Grouped by the digest and joined on (digest, h), a function of it: so the join gets exchanges of its own, which can be split.
    found = maybe.groupBy("sha").agg(F.min("h").alias("h"), F.min_by(F.struct("id"), F.struct("id")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    joined = maybe.join(found, ["sha", "h"])
    own = joined.select(F.col("id").alias(key), F.col("first.id").alias("keep_id"), "group_size", F.col("id").eqNullSafe(F.col("first.id")).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(own)


def keep_first(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that stay, all columns; of repeated rows with one key and text, one.

    A row that the filter clears is not shuffled. Of the others only one row a digest
    leaves a map task, the one with the smallest key.
    """
    rows = scratch(digests(docs, key).select("h"), "digests")
    bits = bloom.bits_for(rows.count())
    plane = bloom.repeated(rows, bits)

    @F.pandas_udf("boolean")
    def may_repeat(h: pd.Series) -> pd.Series:
        return pd.Series(bloom.holds(plane.value, h.to_numpy().astype(np.uint64)))

    normal = F.regexp_replace(text_or_empty(), f"{SPACE}+", " ")
    held = docs.select(whole(docs).alias("row"), docs[key].alias("id"), F.sha2(normal.cast("binary"), 256).alias("sha"))
    tested = held.withColumn("again", may_repeat(F.xxhash64("sha")))
    first = tested.where("again").groupBy("sha").agg(F.min_by("row", F.struct("id")).alias("row"))
    every = tested.where(~F.col("again")).select("row").unionByName(first.select("row"))
    return every.select(parts(docs.columns))
