"""Operator 8, mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Targets. Sources share all words of the corpus by weight; a target stops at REPEAT times
its source's size, and the excess is shared among the others by weight until no target is
above.

Blocks. A hash deals each source's documents into at most BLOCKS blocks, of about
DOCS_A_BLOCK documents in small sources. A source takes each block as often as its target
holds its size, and of the rest, in an order permuted by the seed, every whole block that
fits. The room that then remains is filled with documents of the left blocks: of the first,
then of all others that have a document small enough. Another hash deals these
blocks into cells; of each cell the documents that are no longer than the room are added up, the cells
are taken in order while they fit, and only the one cell that doesn't is looked at by document, after which the
next cells follow with the room that is left. So no task and no list grows with the corpus but by its
65,536th part, and what is taken misses the target by less than the smallest document with
words that the source has left (rows of one key looked at together being one document).

Tree. The quota of a source is its number of taken blocks, repeats counted. A node
that stands for some output shards holds a vector of quotas; its left half draws its share
of the blocks without replacement, a multivariate-hypergeometric vector, and the right
half keeps the rest, down to single shards, so the shards' quotas add up exactly. A
node's generator is seeded by the seed and the node, so any node can be drawn again. Each
source then deals its blocks in permuted order: the shards get disjoint runs. Inside a
shard rows are ordered by a hash.

The driver holds some BLOCKS numbers a source, and the documents taken from cells that were looked at by document.
Documents are read once for their sizes and once to be written; texts are shuffled only to their shard.

Defined results: a null text has no words and is taken with its block; a null source is a
source of its own, the last; rows with one key in one source are taken together; a corpus
without words takes nothing; an empty table gives an empty table; further columns are not
read by `plan` and are kept by `mix`.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, local_rows, parts, scratch, small, text_or_empty, whole

WEIGHTS = (1.0, 2.0, 3.0)
REPEAT = 3
DOCS_A_BLOCK, BLOCKS = 64, 4096
#: Cells of each block when all that are left are looked at; of a single block there are BLOCKS.
CELLS = 16
SHARDS = 32
SEED = 11


def targets(sizes: list[int], weights: list[float]) -> list[float]:
    """What each source is to give, in words."""
    out = [0.0] * len(sizes)
    left, free = float(sum(sizes)), [i for i in range(len(sizes))]
    while free:
        total = sum(weights[i] for i in free)
        share = {i: left * weights[i] / total for i in free}
        above = [i for i in free if share[i] > REPEAT * sizes[i]]
        if not above:
            for i in free:
                out[i] = share[i]
            break
        for i in above:
            out[i] = float(REPEAT * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(above)]
    return out


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard: (shards, sources), drawn down the tree."""
    out = np.zeros((shards, len(quotas)), np.int64)
    nodes = [(0, shards, np.asarray(quotas, np.int64))]
    while nodes:
        low, high, have = nodes.pop()
        if high - low == 1:
            out[low] = have
            continue
        mid = (low + high) // 2
        some = int(have.sum()) * (mid - low) // (high - low)
        left = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(have, some, method="marginals") if len(have) else have
        nodes += [(low, mid, left), (mid, high, have - left)]
    return out


def _source(docs: DataFrame) -> Column:
    """"0" and the name, or "1" for null, which so comes last; the order is that of code points."""
    return F.coalesce(F.concat(F.lit("0"), docs["source"].cast("string")), F.lit("1"))


def _hash(docs: DataFrame, key: str, seed: int) -> Column:
    return F.xxhash64(docs[key], F.lit(seed))


def _size() -> Column:
    return F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")


def _block(blocks: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(F.col("h"), 7), blocks)


def _cell(cells: Column | int) -> Column:
    """Where in its block a document is; a hash of the hash that dealt the blocks."""
    return F.pmod(F.xxhash64("h", F.lit(1)), F.lit(cells) if isinstance(cells, int) else cells)


class Plan:
    """Which blocks and documents of each source go where."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", weights=WEIGHTS, shards: int = SHARDS, seed: int = SEED):
        spark = docs.sparkSession
        self.key, self.seed, self.shards = key, seed, shards
        rows = docs.select(docs[key].alias("key"), _source(docs).alias("source"), _size().alias("size"), _hash(docs, key, seed).alias("h"))
        self.sizes = scratch(rows, "sizes")
        totals = sorted(tuple(r) for r in self.sizes.groupBy("source").agg(F.sum("size"), F.count(F.lit(1))).collect())
        names = [s for s, _, _ in totals]
        target = targets([n for _, n, _ in totals], [weights[i % len(weights)] for i in range(len(totals))])
        blocks = {s: max(1, min(BLOCKS, n // DOCS_A_BLOCK)) for s, _, n in totals}
        held = [(s, n, t, blocks[s]) for (s, n, _), t in zip(totals, target)]
        self.sources = small(local_rows(spark, held, "source string, source_size long, target double, blocks int"), len(held))
        placed = self.sizes.join(self.sources, "source").withColumn("block", _block(F.col("blocks")))
        sums: dict[str, dict[int, int]] = {s: {} for s in names}
        least: dict[str, dict[int, int]] = {s: {} for s in names}
        some = F.min(F.when(F.col("size") > 0, F.col("size")))
        for s, b, n, low in placed.groupBy("source", "block").agg(F.sum("size"), some).collect():  # BLOCKS rows a source at most
            sums[s][b] = n
            least[s][b] = low
        units: dict[str, list[int]] = {}
        room: dict[str, int] = {}
        left: dict[str, list[int]] = {}
        for (s, size, _), t in zip(totals, target):
            order = sorted(sums[s])
            rng = np.random.default_rng([seed, zlib.crc32(s.encode()), len(order)])
            rng.shuffle(order)
            whole = int(t // size) if size else 0
            taken = [b for _ in range(whole) for b in order]
            rest = t - whole * size
            left[s] = []
            for b in order:
                if sums[s][b] > rest:
                    left[s].append(b)
                elif rest > 0:
                    taken.append(b)
                    rest -= sums[s][b]
            room[s] = int(rest)
            units[s] = taken
        cells, filled = self._fill(placed, left, room, least)
        # What fills a source's room is a unit of its own, dealt last.
        cut = {s for s, *_ in cells} | {s for s, _ in filled}
        dealt = {s: [*units[s], -1] if s in cut else units[s] for s in names}
        share = split(np.array([len(dealt[s]) for s in names]), shards, seed)
        where: dict[tuple[str, int], list[int]] = {}
        short: dict[str, int] = {}
        for i, s in enumerate(names):
            shard = np.repeat(np.arange(shards), share[:, i])
            mixed = np.random.default_rng([seed, 1, zlib.crc32(s.encode())]).permutation(len(dealt[s]))
            for place, unit in zip(shard.tolist(), mixed.tolist()):
                if s in cut and unit == len(dealt[s]) - 1:
                    short[s] = place
                else:
                    where.setdefault((s, dealt[s][unit]), []).append(place)
        held = [(s, b, sorted(w)) for (s, b), w in where.items()]
        self.blocks = small(local_rows(spark, held, "source string, block long, shards array<int>"), len(held))
        self.extra = small(local_rows(spark, [(s, h, short[s]) for s, h in filled], "source string, h long, shard int"), len(filled))
        dealt_cells: dict[tuple[str, int], list[tuple[int, int, int]]] = {}
        for s, b, n, c, most in cells:
            dealt_cells.setdefault((s, b, n), []).append((c, most))
        held = [(s, b, n, dict(of), short[s]) for (s, b, n), of in dealt_cells.items()]
        self.cells = small(local_rows(spark, held, "source string, block long, n_cells int, most map<int,long>, cell_shard int"), len(held))

    def _fill(self, placed: DataFrame, left: dict[str, list[int]], room: dict[str, int], least: dict[str, dict[int, int]]):
        """What fills the room: cells (source, block, number of cells, cell, longest size taken) and documents (source, h)."""
        spark, cells, single, many = placed.sparkSession, [], [], 1
        while True:
            left = {s: [b for b in blocks if (least[s][b] or room[s] + 1) <= room[s]] for s, blocks in left.items()}
            held = {s: blocks[:many] for s, blocks in left.items() if blocks}
            if not held:
                return cells, single
            n_cells, after = BLOCKS if many == 1 else CELLS, {s: (-1, -1) for s in held}
            while after:
                rows = [(s, b, i, room[s], *after[s]) for s in after for i, b in enumerate(held[s])]
                these = small(local_rows(spark, rows, "source string, block long, place int, room long, at_place int, at_cell int"), len(rows))
                units = placed.join(these, ["source", "block"]).withColumn("cell", _cell(n_cells))
                begun = "(place > at_place or place = at_place and cell > at_cell)"
                sums: dict[str, list[tuple[int, int, int, int]]] = {s: [] for s in after}
                found = units.where(f"size > 0 and size <= room and {begun}").groupBy("source", "place", "cell").agg(F.sum("size"), F.count(F.lit(1)))
                for s, *cell in sorted(map(tuple, found.collect())):
                    sums[s].append(tuple(cell))
                # Of sources that have few documents left to look at all are looked at, in the same order.
                few = [s for s in after if sum(m for *_, m in sums[s]) <= BLOCKS]
                if any(sums[s] for s in few):
                    each = units.where(F.col("source").isin(few) & F.expr(begun)).groupBy("source", "place", "cell", "h", "room").agg(F.sum("size").alias("size")).where("size > 0 and size <= room")
                    for s, _, _, h, n in sorted(map(tuple, each.select("source", "place", "cell", "h", "size").collect())):
                        if n <= room[s]:
                            single.append((s, h))
                            room[s] -= n
                crossing = []
                for s in list(after):
                    if s in few:
                        del after[s]
                        continue
                    rest = room[s]
                    for i, c, n, _ in sums[s]:
                        if n > rest:
                            crossing.append((s, i, c, rest))
                            after[s] = (i, c)
                            break
                        cells.append((s, held[s][i], n_cells, c, room[s]))
                        rest -= n
                    else:
                        del after[s]
                    room[s] = rest
                if crossing:
                    one = small(local_rows(spark, crossing, "source string, place int, cell long, rest long"), len(crossing))
                    fits = units.select("source", "place", "cell", "h", "size").join(one, ["source", "place", "cell"]).groupBy("source", "rest", "h").agg(F.sum("size").alias("size"))
                    fits = fits.where("size > 0 and size <= rest").groupBy("source").applyInPandas(_fitting, "source string, h long, size long")
                    for s, h, n in sorted(map(tuple, fits.collect())):
                        single.append((s, h))
                        room[s] -= n
            left = {s: blocks[many:] for s, blocks in left.items()}
            many = BLOCKS

    def of(self, rows: DataFrame, size: Column) -> DataFrame:
        """rows (source, h, ...) with source_size, target and the list of shards each goes to."""
        own = rows.join(self.sources, "source").withColumn("block", _block(F.col("blocks")))
        own = own.join(self.blocks, ["source", "block"], "left").join(self.extra, ["source", "h"], "left").join(self.cells, ["source", "block"], "left")
        none = F.array().cast("array<int>")
        most = F.col("most")[_cell(F.col("n_cells")).cast("int")]
        filling = F.when(F.col("shard").isNotNull(), F.array("shard")).when(most.isNotNull() & (size > 0) & (size <= most), F.array("cell_shard")).otherwise(none)
        return own.withColumn("shards", F.concat(F.coalesce("shards", none), filling)).drop("block", "blocks", "shard", "n_cells", "most", "cell_shard")


def _fitting(rows):
    """Of a cell's documents, those that fit one after the other, in the order of their hashes."""
    rows = rows.sort_values("h", kind="stable")
    room, took = int(rows["rest"].iloc[0]) if len(rows) else 0, []
    for n in rows["size"].tolist():
        took.append(n <= room)
        room -= n if took[-1] else 0
    return rows.loc[np.array(took, bool), ["source", "h", "size"]]


def plan(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row per document: key, size, source_size, target, taken, and the shards it goes to."""
    made = Plan(docs, key, **options)
    out = made.of(made.sizes, F.col("size"))
    return out.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mix(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The mixed documents, a row for each time one is taken, shard by shard, in mixed order; all columns."""
    return _mixed(docs, Plan(docs, key, **options))


def _mixed(docs: DataFrame, made: Plan) -> DataFrame:
    rows = docs.select(whole(docs).alias("row"), _source(docs).alias("source"), _hash(docs, made.key, made.seed).alias("h"))
    # Only documents of cells that fill a source's room are measured again.
    text = F.col("row")[f"c{docs.columns.index('text')}"].cast("string")
    each = made.of(rows, F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")).select("row", "h", F.posexplode("shards").alias("copy", "shard"))
    each = each.withColumn("order", F.xxhash64("h", "copy", F.lit(made.seed)))
    # A shard is a run of the order (shard, order); range partitioning splits a shard that outgrows a task.
    sorted_ = each.repartitionByRange("shard", "order").sortWithinPartitions("shard", "order")
    return sorted_.select(parts(docs.columns))


def report(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """As `plan` without the shards, but the documents are mixed and written, and taken is counted in what was written."""
    made = Plan(docs, key, **options)
    return counted(made, scratch(_mixed(docs, made), "mixed"))


def counted(made: Plan, written: DataFrame) -> DataFrame:
    """One row per document: key, size, source_size, target, and taken, the words of it that are in written."""
    same = ["source", "h", "size"]
    rows = written.select(_source(written).alias("source"), _hash(written, made.key, made.seed).alias("h"), _size().alias("size"))
    n = rows.groupBy(same).agg(F.count(F.lit(1)).alias("n"))
    # Rows that are the same in key, source and size share what was written of them.
    times = made.sizes.groupBy(same).agg(F.count(F.lit(1)).alias("m")).join(n, same).selectExpr(*same, "size * n div m as taken")
    out = made.sizes.join(times, same, "left").join(made.sources, "source")
    return out.select(F.col("key").alias(made.key), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
