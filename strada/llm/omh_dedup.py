"""Operator 2, near-dedup: Order MinHash, verified by banded alignment.

A document's k-mers are its shingles of five words, each labelled with its occurrence
number, so that all of a document are distinct. For each of FUNCTIONS hash functions the
PICKED k-mers of smallest hash are sampled and put back in the order of the text; two
documents agree on a sample with about the square of their similarity if the order
agrees too, so the sketch is sensitive to edit similarity. Runs of ROWS samples are
band keys; at similarity 0.8 a pair shares one of the 16 with probability 0.9998.

A pair is verified by an alignment: shingles of one are matched to equal ones of the
other within a band of diagonals, and the longest chain that runs forward in both
is the alignment (a sparse longest common subsequence). With c shingles in it the
similarity is c / (a + b - c), at least 0.8. Words, labelled shingles and rows of words are compared by
64-bit hashes (whole texts by two of them); no hash is a polynomial. The band is not a cut-off: at that
similarity at most (a + b) / 9 shingles are not common, so no wider diagonal can matter.

Copies are collapsed to representatives first. In each bucket of a band all members are
compared with one centre; some rounds with other centres follow for those whose class is
not the centre's. Then, so that no link is lost, the members of a bucket that are not in
its largest class are compared with all others: both sides are dealt into chunks of bounded
size, a task compares two chunks in arrays and returns only links that join classes, so
no pairs become rows. Pairs within a class are not compared: they change nothing.
Classes are connected components, found with DataFrames; what is returned is one row per document with the id of
its class, and the first of its exact copies, not its links.

Defined results: a null text counts as empty; texts of equal words are copies, all
empty ones of each other; a text of under five words has copies only; rows with one key
are rows of their own; an empty table gives an empty table; further columns are
not read by `classes` and are kept by `keep_one`. The class is named by its smallest key,
or null if a null key is in it, since null comes first.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import blocks, discard, fresh, numbered, release, scratch, settle, text_or_empty
from .components import components
from .textblock import TextBlock, mix, repeats, summed
from .wordcache import forget

SHINGLE, SIMILARITY = 5, 0.8
FUNCTIONS, ROWS, PICKED = 32, 2, 2
#: Further rounds of one centre a bucket before chunks are compared.
CENTRES = 2
#: Members, and shingles, of a chunk.
CHUNK, CHUNK_SHINGLES = 512, 1 << 20
_FACTORS = np.random.default_rng(20_240_229).integers(1 << 62, 1 << 63, FUNCTIONS, np.uint64) | np.uint64(1)


def labelled(block: TextBlock, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash of shingle and occurrence number) in the order of the text."""
    at, key = block.grams(words, SHINGLE)
    doc = block.doc_of_word[at]
    _, number = repeats(doc, key)
    return doc, mix(key + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def samples(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents that have shingles, a row of FUNCTIONS sample hashes for each)."""
    begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(doc)))
    out = np.empty((len(begin), FUNCTIONS), np.uint64)
    for f in range(FUNCTIONS if len(begin) else 0):
        value = key * _FACTORS[f]
        picked = []
        for _ in range(PICKED):
            least = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, begin), size))
            picked.append(least)
            value[least] = np.uint64(0xFFFFFFFFFFFFFFFF)
        # a document of one shingle has all its places marked alike, and picks it again
        first, *others = (p if len(p) == len(begin) else p[np.unique(doc[p], return_index=True)[1]] for p in picked)
        order = np.sort(np.stack([first, *others]), axis=0)
        held = np.zeros(len(begin), np.uint64)
        for place in order:
            held = mix(held * np.uint64(31) + key[place])
        out[:, f] = held
    return doc[begin], out


def _sketch(batches):
    forget()
    for batch in blocks(batches):
        block = TextBlock(batch.column(1))
        words = block.word_hashes()
        a, b = block.first_word[:-1], block.first_word[1:]
        doc, sample = samples(*labelled(block, words))
        keys = sample[:, ::ROWS].copy()
        for r in range(1, ROWS):
            keys = mix(keys * np.uint64(31) + sample[:, r::ROWS])
        keys += np.arange(keys.shape[1], dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        count = np.zeros(block.n_docs, np.int64)
        count[doc] = keys.shape[1]
        bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(keys.ravel().view(np.int64)))
        n = np.maximum(block.n_words - SHINGLE + 1, 0).astype(np.int32)
        one, two = (summed(block.word_hashes(seed), a, b - a, seed).view(np.int64) for seed in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(one), pa.array(two), pa.array(n), bands], names=["row", "one", "two", "n", "bands"])


def _contents(plane):
    def run(batches):
        forget()
        for batch in blocks(batches):
            held = bloom.holds(plane.value, mix(batch.column(0).to_numpy().astype(np.uint64)))
            batch = batch.filter(pa.array(held))
            if not batch.num_rows:
                continue
            block = TextBlock(batch.column(1))
            doc, key = labelled(block, block.word_hashes())
            offsets = np.append(0, np.cumsum(np.bincount(doc, minlength=block.n_docs)))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(key.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["row", "shingles"])

    return run


def aligned(a: np.ndarray, b: np.ndarray) -> int:
    """Shingles in the longest chain of matches within the band."""
    _, i, j = np.intersect1d(a, b, return_indices=True)
    near = np.abs(i - j) <= (len(a) + len(b)) // 9 + 1
    order = np.argsort(i[near])
    j = j[near][order]
    if len(j) < 2 or (j[1:] > j[:-1]).all():
        return len(j)
    tails: list[int] = []
    for x in j.tolist():
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
    return len(tails)


def _verify(batches):
    forget()
    for batch in batches:
        release()
        a, b = batch.column(2), batch.column(3)
        good = []
        for k in range(batch.num_rows):
            x, y = a[k].values.to_numpy(), b[k].values.to_numpy()
            c = aligned(x, y)
            good.append(c >= SIMILARITY * (len(x) + len(y) - c))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _linked(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """The pairs (a, b) that the alignment confirms."""
    left = contents.select(F.col("row").alias("a"), F.col("shingles").alias("x"))
    right = contents.select(F.col("row").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return scratch(both.mapInArrow(_verify, "a long, b long"), "links")


def classes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: key, class_id, copy_of (the first of its exact copies), kept."""
    rows, same = numbered(docs, key)
    found = _classes(rows)
    kept = (F.col("row") == F.col("label")).alias("kept")
    if same:
        return found.select(F.col("row").alias(key), F.col("label").alias("class_id"), F.col("first").alias("copy_of"), kept)
    names = rows.select("row", key)
    own = found.join(names, "row")
    for column, name in (("label", "class_id"), ("first", "copy_of")):
        own = own.join(names.select(F.col("row").alias(column), F.col(key).alias(name)), column)
    return own.select(key, "class_id", "copy_of", kept)


def _classes(rows: DataFrame, between=lambda: None) -> DataFrame:
    """(row, first, label) of (row, text); between is called after each part of the work."""
    sketches = scratch(rows.select("row", "text").mapInArrow(_sketch, "row long, one long, two long, n int, bands array<long>"), "sketches")
    same = sketches.groupBy("one", "two").agg(F.min("row").alias("first"), F.xxhash64("one", "two").alias("x"))
    copies = scratch(sketches.select("row", "one", "two", F.xxhash64("one", "two").alias("x")).join(same, ["one", "two", "x"]).select("row", "first"), "copies")
    firsts = copies.where("row = first").select("row")
    members = scratch(sketches.select("row", "n", F.explode("bands").alias("band")).join(firsts, "row", "left_semi"), "members")

    def centred(labels: DataFrame | None, turn: int) -> DataFrame:
        """Distinct pairs of each bucket's member and its centre whose classes differ and whose lengths allow the similarity."""
        own = members if labels is None else members.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))
        own = own if labels is not None else own.withColumn("label", F.col("row"))
        rank = F.struct("row") if not turn else F.struct(F.xxhash64("row", F.lit(turn)).alias("r"), "row")
        centre = F.min_by(F.struct(F.col("row").alias("c"), F.col("n").alias("m"), F.col("label").alias("l")), rank)
        tops = own.groupBy("band").agg(centre.alias("top"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band", "top.*", F.xxhash64("band").alias("x"))
        both = own.withColumn("x", F.xxhash64("band")).join(tops, ["band", "x"]).where("label <> l")
        alike = both.where(f"least(n, m) >= {SIMILARITY} * greatest(n, m)")
        return alike.select(F.least("row", "c").alias("a"), F.greatest("row", "c").alias("b")).distinct()

    first_pairs = scratch(centred(None, 0), "pairs")
    # Contents of documents that any bucket holds with another, told by a filter of bounded size.
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.xxhash64("band").alias("x")).where("k > 1")
    candidates = scratch(members.withColumn("x", F.xxhash64("band")).join(shared.select("band", "x"), ["band", "x"], "left_semi").select("row").distinct(), "candidates")
    plane = bloom.members(candidates.select("row").mapInArrow(_mixed, "h long"), bloom.bits_for(candidates.count()))
    contents = scratch(rows.select("row", "text").mapInArrow(_contents(plane), "row long, shingles array<long>"), "contents")
    between()

    links = _linked(first_pairs, contents)
    discard(first_pairs, candidates)
    labels = components(links)
    for turn in range(1, CENTRES + 2):
        between()
        more = _linked(centred(labels, turn), contents) if turn <= CENTRES else _joining(members, labels, contents)
        if more.limit(1).count():
            links = scratch(links.union(more), "links")
            labels = components(links)
    named = copies.join(labels.select(F.col("node").alias("first"), "label"), "first", "left")
    return named.select("row", "first", F.coalesce("label", "first").alias("label"))


def _mixed(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(mix(batch.column(0).to_numpy().astype(np.uint64)).view(np.int64))], names=["h"])


def _joining(members: DataFrame, labels: DataFrame, contents: DataFrame) -> DataFrame:
    """Links between members of one bucket that are in different classes, enough to join what is linked."""
    own = members.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))
    classes_ = own.groupBy("band", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
    most = F.max_by("label", F.struct("k", "label"))
    totals = classes_.groupBy("band").agg(most.alias("main"), F.max("k").alias("main_k"), F.max_by("s", F.struct("k", "label")).alias("main_s"), F.sum("k").alias("k"), F.sum("s").alias("s"))
    chunks = lambda k, s: F.ceil(F.greatest(k / CHUNK, s / CHUNK_SHINGLES)).cast("int")
    open_ = totals.where("k > main_k").select("band", "main", chunks(F.col("k") - F.col("main_k"), F.col("s") - F.col("main_s")).alias("few"), chunks(F.col("main_k"), F.col("main_s")).alias("many"), F.xxhash64("band").alias("x"))
    some = own.withColumn("x", F.xxhash64("band")).join(open_, ["band", "x"])
    held = some.withColumn("small", F.col("label") != F.col("main")).withColumn("at", F.pmod(F.xxhash64("row"), F.when(F.col("small"), F.col("few")).otherwise(F.col("many"))).cast("int"))
    # A cell is (chunk of the small classes, whether of the main class, the other chunk).
    to_main = F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda j: F.struct(F.col("at").alias("i"), F.lit(True).alias("main"), j.alias("j")))
    to_small = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda j: F.struct(F.least("at", j).alias("i"), F.lit(False).alias("main"), F.greatest("at", j).alias("j")))
    from_main = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda i: F.struct(i.alias("i"), F.lit(True).alias("main"), F.col("at").alias("j")))
    cells = F.explode(F.when(F.col("small"), F.concat(to_main, to_small)).otherwise(from_main)).alias("cell")
    dealt = held.select("band", "row", "label", "at", "small", cells).join(contents, "row")
    got = dealt.select("band", F.col("cell.i").alias("i"), F.col("cell.main").alias("main"), F.col("cell.j").alias("j"), "row", "label", "at", "small", "shingles")
    return scratch(got.groupBy("band", "i", "main", "j").applyInArrow(_compare, "a long, b long").distinct(), "joining")


def _compare(key, table):
    """Links between two chunks, or within one, that join classes not joined before."""
    forget()
    release()
    _, i, main, j = (k.as_py() for k in key)
    row, label, at = (table.column(c).to_numpy() for c in ("row", "label", "at"))
    lists = table.column("shingles").combine_chunks()
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    offsets, flat = offsets - offsets[0], flat[offsets[0] : offsets[-1]]
    small = table.column("small").to_numpy(zero_copy_only=False)
    left = np.flatnonzero(small & (at == i))
    right = np.flatnonzero(~small) if main else np.flatnonzero(at == j)
    links: list[tuple[int, int]] = []
    if len(left) and len(right):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                x = up
            return x

        vocabulary, code = np.unique(flat, return_inverse=True)
        size = np.diff(offsets)
        others = np.concatenate([code[offsets[r] : offsets[r + 1]] for r in right])
        begin = np.cumsum(size[right]) - size[right]
        mark = np.zeros(len(vocabulary), bool)
        for a in left.tolist():
            mine = code[offsets[a] : offsets[a + 1]]
            mark[mine] = True
            common = np.add.reduceat(mark[others], begin, dtype=np.int64)
            mark[mine] = False
            # no alignment is longer than what the two have in common
            near = (label[right] != label[a]) & (common >= SIMILARITY * (size[a] + size[right] - common))
            for b in right[near].tolist():
                x, y = root(int(label[a])), root(int(label[b]))
                if x == y:
                    continue
                c = aligned(flat[offsets[a] : offsets[a + 1]], flat[offsets[b] : offsets[b + 1]])
                if c >= SIMILARITY * (size[a] + size[b] - c):
                    parent[x] = y
                    links.append((int(row[a]), int(row[b])))
    first, second = [min(p) for p in links], [max(p) for p in links]
    return pa.table({"a": pa.array(first, pa.int64()), "b": pa.array(second, pa.int64())})


def keep_one(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first document of each class, all columns.

    Rows are known by a hash of their key and text. A filter of the hashes that go lets
    most rows pass without a shuffle; the others are checked by a join.
    """
    rows, _ = numbered(docs, key)
    hashed = rows.select("row", F.xxhash64(key, "text").alias("h"))
    found = scratch(_classes(rows, lambda: settle(docs.sparkSession)).join(hashed, "row").select("h", (F.col("row") == F.col("label")).alias("kept")), "kept")
    gone, stay = found.where("not kept").select("h"), found.where("kept").select("h")
    plane = bloom.members(gone, bloom.bits_for(gone.count()))

    @F.pandas_udf("boolean")
    def may_go(h: pd.Series) -> pd.Series:
        return pd.Series(bloom.holds(plane.value, h.to_numpy().astype(np.uint64)))

    h, maybe = fresh(docs, "__h"), fresh(docs, "__maybe")
    tested = docs.withColumn(h, F.xxhash64(docs[key], text_or_empty())).withColumn(maybe, may_go(F.col(h)))
    again = tested.where(maybe).join(stay.select(F.col("h").alias(h)), h, "left_semi")
    if stay.join(gone, "h", "left_semi").limit(1).count():  # repeated rows: one of them stays
        again = again.dropDuplicates([h])
    return tested.where(f"not {maybe}").drop(h, maybe).unionByName(again.drop(h, maybe))
