"""Operator 3, toxicity: non-negative positive-unlabelled learning.

A linear classifier is trained in numpy on confirmed toxic documents and on unlabelled
ones, among which a share `prior` is toxic too. Its risk is the class-prior-corrected
estimate

    prior * R(positive, +) + max(0, R(unlabelled, -) - prior * R(positive, -))

and whenever the corrected part falls below zero, the step goes the other way on it (Kiryo
et al., 2017), so the model cannot fit the unlabelled set by calling everything clean.

Features are hashed words and word beginnings of 4 to 6 bytes, each counted once a
document, weighted by how rare they are among the unlabelled; words are runs of letters in
lower case (ASCII), so marks and digits don't count.

The sample is bounded by two parameters of `learn`: of the labelled rows that aren't held out the
`positive` confirmed ones and, with their labels left out, `unlabelled` of all of them, those with the
smallest hash of their key, as far as they have `entries` features together. So the driver holds 4 bytes an
entry, however long the texts are. The prior is a parameter; by default it is the share of toxic among
the labelled training rows, from which the unlabelled ones are drawn too. Scoring is one scan and
one map over every whole text, without a shuffle.

Defined results: a null or empty text has no features and gets the score of the intercept; with
no confirmed example in the training rows every score is 0; equal rows get equal
scores; a null key is never trained on; further columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, scratch, text_or_empty
from .textblock import TextBlock
from .wordcache import forget

BITS = 18
POSITIVE, UNLABELLED, ENTRIES = 3_000, 9_000, 8_000_000
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.7
#: Confirmed examples that a feature needs to carry weight.
LEAST = 3
LIFT = 2.0
_NO_WORD = bytes(b for b in range(128) if not chr(b).isalpha())
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(column) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs without repetition, in order."""
    block = TextBlock(column, _NO_WORD)
    block.data = _LOWER[block.data]
    start, end = block.starts, block.ends
    held = [block.hashes(start, end)]
    doc = [block.doc_of_word]
    for k in BEGINNINGS:
        long = end - start > k
        held.append(block.hashes(start[long], start[long] + k, k))
        doc.append(block.doc_of_word[long])
    pair = (np.concatenate(doc).astype(np.int64) << BITS) | (np.concatenate(held) >> np.uint64(64 - BITS)).astype(np.int64)
    pair = np.unique(pair)
    return pair >> BITS, pair & ((1 << BITS) - 1)


@dataclass
class Sparse:
    """Rows of 0/1 features."""

    row: np.ndarray
    column: np.ndarray
    n: int

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.column], minlength=self.n)

    def back(self, slope: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=slope[self.row], minlength=1 << BITS)


@dataclass
class Model:
    weights: np.ndarray
    intercept: float

    def score(self, column) -> np.ndarray:
        doc, feature = features(column)
        z = np.bincount(doc, weights=self.weights[feature], minlength=len(column)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(positive: Sparse, unlabelled: Sparse, prior: float, rounds: int = 200, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """Minimise the non-negative risk of the logistic loss by Adam on all rows.

    Features in fewer than LEAST confirmed examples, or not LIFT times as common in them as
    among the unlabelled, carry no weight: they cannot be told from chance.
    """
    n_p, n_u = _counts(positive.column), _counts(unlabelled.column)
    telling = (n_p >= LEAST) & (n_p / positive.n >= LIFT * n_u / unlabelled.n)
    scale = np.where(telling, np.minimum(1.0, np.sqrt(unlabelled.n / (1 + n_u)) / 10), 0.0)
    positive, unlabelled = (Sparse(s.row[used], s.column[used], s.n) for s in (positive, unlabelled) for used in [telling[s.column]])
    w, b = np.zeros(1 << BITS), -1.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0

    def sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    for t in range(1, rounds + 1):
        ws = w * scale
        zp, zu = positive.dot(ws) + b, unlabelled.dot(ws) + b
        clean = np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp))
        p_up, p_down, u_down = (sigmoid(zp) - 1) / positive.n, sigmoid(zp) / positive.n, sigmoid(zu) / unlabelled.n
        if clean >= 0:
            gp, gu = prior * p_up - prior * p_down, u_down
        else:
            gp, gu = prior * p_down, -u_down
        g = (positive.back(gp) + unlabelled.back(gu)) * scale + decay * w * (scale > 0) / 10
        gb = gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return Model((w * scale).astype(np.float32), float(b))


def _featured(batches):
    forget()
    for batch in blocks(batches):
        doc, feature = features(batch.column(2))
        counts = np.bincount(doc, minlength=batch.num_rows)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(feature, pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["toxic", "h", "features"])


def _sparse(lists: pa.ChunkedArray) -> Sparse:
    lists = lists.combine_chunks()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return Sparse(np.repeat(np.arange(len(size), dtype=np.int32), size), lists.flatten().to_numpy(), len(size))


def _counts(column: np.ndarray) -> np.ndarray:
    """How often each feature occurs, in slices, since bincount copies what it counts."""
    out = np.zeros(1 << BITS, np.int64)
    for at in range(0, len(column), 1 << 20):
        out += np.bincount(column[at : at + (1 << 20)], minlength=1 << BITS)
    return out


def learn(
    docs: DataFrame, labels: DataFrame, held_out: Column, prior: float | None = None, key: str = "doc_id",
    positive: int = POSITIVE, unlabelled: int = UNLABELLED, entries: int = ENTRIES,
) -> Model | None:
    """The model of a bounded sample of the rows that aren't held out; None without a confirmed one."""
    # One label a key; of several the toxic one, as a confirmation.
    marks = labels.groupBy(labels[key].alias("k")).agg(F.max(labels["toxic"]).alias("toxic")).where("k is not null")
    known = marks.withColumn("held", F.pmod(F.crc32(F.col("k").cast("string").cast("binary")), F.lit(3)) == 1).where("not held")
    share = known.agg(F.avg("toxic").alias("p"), F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    if not share["t"]:
        return None
    prior = float(share["p"]) if prior is None else prior
    here = known.join(docs.where(~held_out).select(docs[key].alias("k")), "k", "left_semi")
    confirmed = here.where("toxic = 1").select("k").orderBy(F.xxhash64("k")).limit(positive)
    others = here.select("k").orderBy(F.xxhash64("k", F.lit(1))).limit(unlabelled)
    wanted = F.broadcast(confirmed.withColumn("toxic", F.lit(1)).union(others.withColumn("toxic", F.lit(0))))  # positive + unlabelled keys at most
    sample = docs.select(docs[key].alias("k"), text_or_empty().alias("text")).join(wanted, "k").select("toxic", F.xxhash64("k", "text").alias("h"), "text")
    found = scratch(sample.mapInArrow(_featured, "toxic int, h long, features array<int>"), "features")
    so_far = F.sum(F.size("features")).over(Window.partitionBy("toxic").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))  # the sample's rows
    rows = found.withColumn("so_far", so_far).where(F.col("so_far") <= F.when(F.col("toxic") == 1, positive * entries // (positive + unlabelled)).otherwise(unlabelled * entries // (positive + unlabelled)))
    rows = rows.select("toxic", "features").toArrow()
    made = [_sparse(rows.filter(pc.equal(rows["toxic"], label))["features"]) for label in (1, 0)]
    del rows
    if not made[0].n or not made[1].n:
        return None
    return fit(*made, min(0.9, max(0.001, prior)))


def predict(docs: DataFrame, labels: DataFrame, held_out: Column, prior: float | None = None, key: str = "doc_id", **bounds: int) -> DataFrame:
    """One row per document: key, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, held_out, prior, key, **bounds))

    def run(batches):
        model = shared.value
        for batch in blocks(batches):
            score = model.score(batch.column(2)) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    rows = docs.select(docs[key].alias(key), held_out.alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, held_out boolean, score double, predicted int")
