"""Operator 6, substring dedup: what a relative Lempel-Ziv parse against the collection itself would factor.

The reference of a passage is its first occurrence in the order (document, position). A factor is a
run of words that also starts earlier in that order; factors of at least `window` words are
duplicate spans, and every word of them goes. Factors are not parsed greedily: by the contract each
window counts by itself, so anchors (winnowing) and hashes of whole windows stand in for the parse.

Reference blocks are indexed by anchors. Of each window's `gram`-word shingles the one
with the smallest hash, the leftmost of equals, is the window's anchor: equal windows have
equal anchors at the same place in them, so looking up anchors misses no factor, and only
one position in about seven is an anchor. An anchor's occurrence carries the hash of all
words that its windows span, its block.

1. Anchors are counted with map-side aggregation; those that occur once are out. Anchors
   that recur go back to the scan as a Bloom filter of bounded size.
2. The second scan writes the occurrences the filter lets pass. Equal blocks are copies of
   their first one, the reference block: all windows of the copies are factors.
3. A factor may begin or end inside a block. So where one anchor has different blocks,
   their windows are compared one by one, of reference blocks only: the checks at the
   factors' boundaries.
4. Spans are grouped by document and joined with the texts, the only shuffle of texts.

Hot passages cost no hot task: minima are aggregated on the map side, and copies are told
from references by an anti-join on (document, position), which is unique. Equality is by
two independent 64-bit hashes (anchor and block, or anchor and window).

Defined results: a null text has no words; an empty text and one of fewer words than a
window lose none; rows with equal keys (repeated rows) are told apart by their content and
place, the first one by text standing first; further columns are neither read nor returned; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import blocks, numbered, scratch
from .textblock import TextBlock, mix, summed

WINDOW, GRAM = 20, 8


def anchors(block: TextBlock, words: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Of each window: (its first word, its hash, its anchor's first word, the anchor's hash)."""
    at, shingle = block.grams(words, gram)
    first, whole = block.grams(words, window)
    if not len(first):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none.astype(np.uint64)
    dense = np.full(len(words), np.iinfo(np.uint64).max, np.uint64)
    dense[at] = shingle
    # Leftmost minimum of window - gram + 1 shingles by doubling: (value, place) of 1, 2, 4 ... in a row.
    n, value, place, have = window - gram + 1, dense, np.arange(len(dense)), 1
    while have < n:
        step = min(have, n - have)
        left_value, left_place, right_value, right_place = value[:-step], place[:-step], value[step:], place[step:]
        left = left_value <= right_value
        value = np.where(left, left_value, right_value)
        place = np.where(left, left_place, right_place)
        have += step
    return first, whole, place[first], value[first]


def _counted(batches):
    """Distinct anchors of a slice, with 1 or, where it has several occurrences, 2."""
    for batch in blocks(batches):
        block = TextBlock(batch.column(1))
        _, _, place, key = anchors(block, block.word_hashes())
        new = np.ones(len(place), bool)
        new[1:] = place[1:] != place[:-1]
        distinct, n = np.unique(key[new], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(np.minimum(n, 2), pa.int64())], names=["anchor", "n"])


def _occurrences(plane):
    def run(batches):
        for batch in blocks(batches):
            block = TextBlock(batch.column(1))
            words = block.word_hashes()
            first, whole, place, key = anchors(block, words)
            kept = bloom.holds(plane.value, key)
            first, whole, place, key = first[kept], whole[kept], place[kept], key[kept]
            if not len(first):
                continue
            edge = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (first[1:] != first[:-1] + 1)))
            end = np.append(edge[1:], len(first))
            start, last = first[edge], first[end - 1] + WINDOW
            spanned = summed(words, start, last - start)
            held = mix(spanned + (place[edge] - start).astype(np.uint64))
            doc = block.doc_of_word[start]
            ids = batch.column(0).to_numpy(zero_copy_only=False)[doc]
            windows = pa.ListArray.from_arrays(pa.array(np.append(edge, len(first)), pa.int32()), pa.array(whole.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(start - block.first_word[doc], pa.int32()), pa.array(end - edge, pa.int32()), pa.array(key[edge].view(np.int64)), pa.array(held.view(np.int64)), windows],
                names=["row", "start", "n", "anchor", "held", "windows"],
            )

    return run


def spans(rows: DataFrame) -> DataFrame:
    """For (row, text), whose row numbers are unique and in order: (row, list of
    (start, end) in words) of every document that has duplicate spans."""
    spark = rows.sparkSession
    counts = rows.mapInArrow(_counted, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    again = scratch(counts.where("n > 1").select("anchor"), "anchors")
    plane = bloom.members(again, bloom.bits_for(again.count()))
    found = scratch(rows.mapInArrow(_occurrences(plane), "row long, start int, n int, anchor long, held long, windows array<long>"), "occurrences")

    first = F.min(F.struct("row", "start")).alias("first")
    reference = scratch(found.groupBy("anchor", "held").agg(first).select("anchor", "held", "first.*"), "references")
    copies = found.select("row", "start", "n").join(reference.select("row", "start"), ["row", "start"], "left_anti")
    whole = copies.select("row", F.struct("start", (F.col("start") + F.col("n") + F.lit(WINDOW - 1)).alias("end")).alias("span"))

    differing = reference.groupBy("anchor").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1").select("anchor", F.xxhash64("anchor").alias("x"))
    edges = reference.withColumn("x", F.xxhash64("anchor")).join(differing, ["anchor", "x"], "left_semi").select("row", "start")
    windows = found.select("row", "start", "anchor", "windows").join(edges, ["row", "start"], "left_semi")
    single = scratch(windows.select("row", "anchor", "start", F.posexplode("windows").alias("at", "window")).select("row", (F.col("start") + F.col("at")).alias("start"), "anchor", "window"), "windows")
    earliest = single.groupBy("anchor", "window").agg(first).select("first.*")
    later = single.select("row", "start").join(earliest, ["row", "start"], "left_anti")
    parts = later.select("row", F.struct("start", (F.col("start") + F.lit(WINDOW)).alias("end")).alias("span"))
    return whole.unionByName(parts).groupBy("row").agg(F.collect_list("span").alias("spans"))


def _covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps[:-1]) > 0


def _apply(keep_text: bool):
    def run(batches):
        for batch in blocks(batches):
            names = batch.schema.names
            block = TextBlock(batch.column(names.index("text")))
            lists = batch.column(names.index("spans"))
            n_removed, digest, texts = [], [], []
            for d in range(block.n_docs):
                a, b = int(block.first_word[d]), int(block.first_word[d + 1])
                gone = np.zeros(b - a, bool)
                held = lists[d].values
                if held is not None and len(held):
                    gone = _covered(b - a, held.field(0).to_numpy(), held.field(1).to_numpy())
                raw = block.data[block.offsets[d] : block.offsets[d + 1]].tobytes()
                words = raw.split()
                if gone.any():
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                kept = b" ".join(words)
                n_removed.append(int(gone.sum()))
                digest.append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    texts.append(kept.decode())
            carried = [n for n in names if n not in ("text", "spans")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(names.index(n)) for n in carried], pa.array(block.n_words.astype(np.int64)), pa.array(n_removed, pa.int64()), pa.array(digest), *([pa.array(texts, pa.string())] if keep_text else [])],
                names=[*carried, "n_words", "n_removed", "kept_sha256", *(["kept_text"] if keep_text else [])],
            )

    return run


def remove(docs: DataFrame, key: str = "doc_id", keep_text: bool = True) -> DataFrame:
    """One row per document: key, n_words, n_removed, kept_sha256, and the text that is left."""
    rows, _ = numbered(docs, key)
    found = spans(rows.select("row", "text"))
    joined = rows.join(found, "row", "left").select(key, "text", "spans")
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    return joined.mapInArrow(_apply(keep_text), schema)
