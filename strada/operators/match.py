"""Two nearest neighbours, the ratio test, and matches by reference."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strada.schema import MatchConfig

#: Test and reference descriptors of a block. A task compares one block of each: some 12 MB at 144 numbers.
TESTS, REFS = 2048, 8192
#: Tests that are compared at once with a block's references, so that distances take TILE * REFS * 8 bytes, 32 MB.
TILE = 512
_NEAR = 4


def _values(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _nearest(tests: pa.Table, refs: pa.Table) -> pa.Table:
    """The two nearest of a block of references to each of a block of tests, by (distance, rid)."""
    wanted, known = _values(tests["desc"]), _values(refs["desc"])
    rids, names = refs["rid"].to_numpy(), refs["ref_id"]
    squares, k = (known * known).sum(axis=1), min(_NEAR, len(known)) - 1
    qs, rs, ds = [], [], []
    for at in range(0, len(wanted), TILE):
        some = wanted[at : at + TILE]
        own = (some * some).sum(axis=1)
        rough = own[:, None] + squares[None] - 2 * some @ known.T
        # All within rounding of the fourth smallest are looked at again exactly, so ties are broken by id.
        edge = np.partition(rough, k, axis=1)[:, k] + 1e-9 * (1 + own)
        q, r = np.nonzero(rough <= edge[:, None])
        for part in range(0, len(q), 1 << 15):
            a, b = q[part : part + (1 << 15)], r[part : part + (1 << 15)]
            d = some[a] - known[b]
            qs.append(a + at)
            rs.append(b)
            ds.append(np.sqrt((d * d).sum(axis=1)))
    q, r, d = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (qs, rs, ds))
    order = np.lexsort((rids[r], d, q))
    q, r, d = q[order], r[order], d[order]
    first = np.searchsorted(q, q)
    best = np.arange(len(q)) - first < 2
    return pa.table({"qid": tests["qid"].take(pa.array(q[best])), "rid": pa.array(rids[r[best]]), "ref_id": names.take(pa.array(r[best])), "dist": pa.array(d[best])})


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def knn2(tests: DataFrame, refs: DataFrame) -> DataFrame:
    """(qid, rn, rid, ref_id, dist): the two nearest of all references by Euclidean distance.

    tests (qid, desc), refs (ref_id, rid, desc). Both sides are counted and dealt into blocks of bounded
    size; each pair of blocks is a task's work, which returns two candidates a test, and the two nearest
    of those are kept, on the map side first. Nothing is collected. Exact; ties go to the smaller rid.
    """
    a = tests.select("qid", F.col("desc").cast("array<double>").alias("desc"))
    b = refs.select("rid", "ref_id", F.col("desc").cast("array<double>").alias("desc"))
    n_a, n_b = (max(1, math.ceil(d.count() / n)) for d, n in ((a, TESTS), (b, REFS)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = a.withColumn("i", _block("qid", n_a)).withColumn("j", every(n_b)).groupBy("i", "j")
    right = b.withColumn("j", _block("rid", n_b)).withColumn("i", every(n_a)).groupBy("i", "j")

    def compare(tests: pa.Table, refs: pa.Table) -> pa.Table:
        if not tests.num_rows or not refs.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "rid": pa.array([], pa.int64()), "ref_id": pa.array([], pa.string()), "dist": pa.array([], pa.float64())})
        return _nearest(tests, refs)

    found = left.cogroup(right).applyInArrow(compare, "qid long, rid long, ref_id string, dist double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "rid"))
    return found.withColumn("rn", rank).where("rn <= 2").select("qid", "rn", "rid", "ref_id", "dist")


def ratio_matches(neighbours: DataFrame, ratio: float = MatchConfig.ratio) -> DataFrame:
    """(qid, rid, ref_id, d1, d2): first neighbours clearly nearer than the second, of whatever map."""
    both = neighbours.groupBy("qid").agg(*[F.max(F.when(F.col("rn") == n, F.col(c))).alias(a) for n, c, a in ((1, "rid", "rid"), (1, "ref_id", "ref_id"), (1, "dist", "d1"), (2, "dist", "d2"))])
    return both.where(F.col("d1") < F.col("d2") * ratio)


def matches_per_ref(matches: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref_id, n), maps without a match included."""
    counts = matches.groupBy("ref_id").agg(F.count(F.lit(1)).alias("n"))
    return refs.select("ref_id").distinct().join(counts, "ref_id", "left").select("ref_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def sampling_probabilities(matches: DataFrame) -> DataFrame:
    """(ref_id, p) of maps with two matches or more: their share of all such matches."""
    counts = matches.groupBy("ref_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("ref_id", (F.col("n") / F.col("total")).alias("p"))  # one row
