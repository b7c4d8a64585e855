"""Operator 10, packing: deficit round-robin over the sources' queues.

Each source's documents, tokenised and with an end id, form one queue of tokens. In
every window a source is owed tokens in proportion to its target; the tokens owed and not yet
served are its deficit, and the next token always comes from the source whose next token is due
first, ties in the order of the sources. With a target rate q (the given target, or else the
source's number of tokens) token i of a source is due at (i + 1/2) / q; a queue that is empty is
passed over, so the others then share windows by their targets. What a source has been served
when w windows are full, `served(w)`, follows from totals and rates alone: the counters of every
deficit at any window are known in closed form, and each task takes up the round where its
own documents lie. Deficits carry over windows and partitions without a serial pass; in every
window each source that is not empty is within about a token of its target.

Without targets all queues end together, so every window has the corpus's own proportions. Given targets
hold until the first queue is empty, as every id is packed once.

Every window is full but the last tokens of the whole corpus, which are laid out in
sequences whose lengths are powers of two, so that nothing is padded. The plan is one
scan that tokenises to a table in the shared folder, a small sum per (partition, source),
and one map over that table; texts are never shuffled, and ids only if the table of sums,
whose rows are counted, is too long to be broadcast.

A task lays out one run of documents that follow each other in one queue at a time, and only the windows
that hold tokens of it, in slices of CELLS counters; what it holds does not depend on the corpus's size.
The driver holds two numbers a source.

Defined results: a null text counts as empty and has its end id only; a null source is
a source of its own, the last; repeated rows are packed each by itself; an empty table
gives an empty table; the key may be of any type; further columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, scratch, small, text_or_empty
from .sst_tokens import Vocabulary
from .tokenise import encoder
from .wordcache import forget

WINDOW = 2048
#: Documents that a task lays out at once, and counters (windows by sources) that it holds.
ROWS, CELLS = 512, 1 << 19
#: Bytes of text that are tokenised at once.
BYTES = 1 << 18


class Rounds:
    """The round-robin of queues with these totals and target rates."""

    def __init__(self, totals: np.ndarray, rates: np.ndarray | None = None, size: int = WINDOW):
        self.totals, self.size = np.asarray(totals, np.int64), size
        self.rates = self.totals.astype(float) if rates is None else np.asarray(rates, float)
        self.every = int(self.totals.sum())
        self.windows = -(-self.every // size)
        # Tokens served by a time grow along straight lines between the times at which queues end.
        self.ends = np.append(0.0, np.sort(self.totals / self.rates))
        self.by_end = np.array([np.minimum(self.totals, t * self.rates).sum() for t in self.ends])

    def served(self, windows: np.ndarray) -> np.ndarray:
        """Tokens served of each source when so many windows are full; a row a window count.

        It is the set of the size * w tokens that are due first in the order (due, source),
        so it grows with w and sums to size * w, or to all tokens.
        """
        goal = np.minimum(windows * self.size, self.every)
        totals, rates, n = self.totals, self.rates, len(self.totals)
        time = np.interp(goal, self.by_end, self.ends)
        a = np.clip(np.floor(time[:, None] * rates + 0.5), 0, totals).astype(np.int64)

        def next_due(rows):
            return np.where(a[rows] < totals, (a[rows] + 0.5) / rates, np.inf)

        def last_due(rows):
            return np.where(a[rows] > 0, (a[rows] - 0.5) / rates, -np.inf)

        lack = goal - a.sum(axis=1)
        while (rows := np.flatnonzero(lack > 0)).size:
            a[rows, next_due(rows).argmin(axis=1)] += 1
            lack[rows] -= 1
        while (rows := np.flatnonzero(lack < 0)).size:
            a[rows, n - 1 - last_due(rows)[:, ::-1].argmax(axis=1)] -= 1
            lack[rows] += 1
        rows = np.arange(len(a))
        while rows.size:  # rounding may have let in a token that is due after one that it left out
            up, down = next_due(rows), last_due(rows)
            i, j = up.argmin(axis=1), n - 1 - down[:, ::-1].argmax(axis=1)
            first, last = up[np.arange(len(rows)), i], down[np.arange(len(rows)), j]
            wrong = (last > first) | ((last == first) & (j > i))
            rows, i, j = rows[wrong], i[wrong], j[wrong]
            a[rows, i] += 1
            a[rows, j] -= 1
        return a

    def _touched(self, source: int, low: int, high: int) -> np.ndarray:
        """Windows that may hold tokens [low, high) of a source's queue, in order."""
        slack = 2 + len(self.totals) // self.size  # a token's place differs by a token a source at most from its time's
        ends = np.interp((np.array([low, high]) + 0.5) / self.rates[source], self.ends, self.by_end) // self.size
        first, last = max(0, int(ends[0]) - slack), min(self.windows - 1, int(ends[1]) + slack)
        if last - first <= 2 * (high - low) * slack:
            return np.arange(first, last + 1)
        at = np.interp((np.arange(low, high) + 0.5) / self.rates[source], self.ends, self.by_end) // self.size
        near = (at.astype(np.int64)[:, None] + np.arange(-slack, slack + 1)).ravel()
        return np.unique(np.clip(near, 0, self.windows - 1))

    def pieces(self, source: int, start: np.ndarray, n: np.ndarray):
        """Where documents lie that take [start, start + n) of a source's queue, one after the other:
        arrays (document, start in it, length, sequence, offset)."""
        low, high = int(start[0]), int(start[-1] + n[-1])
        found, step = [], max(1, CELLS // len(self.totals))
        windows = self._touched(source, low, high)
        for at in range(0, len(windows), step):
            w = windows[at : at + step]
            both = np.unique(np.append(w, w + 1))
            held = self.served(both)
            a, b = held[np.searchsorted(both, w)], held[np.searchsorted(both, w + 1)]
            before = (b - a)[:, :source].sum(axis=1)
            first, last = np.maximum(a[:, source], low), np.minimum(b[:, source], high)
            some = last > first
            w, before, edge, first, last = w[some], before[some], a[some, source], first[some], last[some]
            from_doc = np.searchsorted(start, first, "right") - 1
            count = np.searchsorted(start, last, "left") - from_doc
            which = np.repeat(np.arange(len(w)), count)
            doc = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(from_doc, count)
            begin, end = np.maximum(start[doc], first[which]), np.minimum(start[doc] + n[doc], last[which])
            found.append((doc, begin - start[doc], end - begin, w[which], before[which] + begin - edge[which]))
        out = [np.concatenate(x) for x in zip(*found)]
        return self._tail(*out)

    def _tail(self, doc, at, length, sequence, offset):
        """With the last tokens of all in sequences whose lengths are powers of two."""
        full = self.every // self.size
        tail = self.every - full * self.size
        whole = sequence < full
        if not tail or whole.all():
            return [doc, at, length, sequence, offset]
        steps = [1 << k for k in range(tail.bit_length() - 1, -1, -1) if tail >> k & 1]
        edges = np.cumsum([0, *steps])
        more = []
        for d, s, m, o in zip(*(x[~whole].tolist() for x in (doc, at, length, offset))):
            while m:
                k = int(np.searchsorted(edges, o, "right")) - 1
                take = min(m, int(edges[k + 1]) - o)
                more.append((d, s, take, full + k, o - int(edges[k])))
                s, o, m = s + take, o + take, m - take
        return [np.concatenate([x[whole], np.array(y, np.int64)]) for x, y in zip((doc, at, length, sequence, offset), zip(*more))]


def runs(whose: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The rows in groups of one source that follow each other in its queue without a gap."""
    order = np.lexsort((start, whose))
    w, s = whose[order], start[order]
    new = (w[1:] != w[:-1]) | (s[1:] != s[:-1] + n[order][:-1])
    return np.split(order, np.flatnonzero(new) + 1) if len(order) else []


def tokenised(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id") -> DataFrame:
    """(key, source, part, position in the source's queue of this part, number of ids, ids), kept in the shared folder."""

    def run(batches):
        from pyspark import TaskContext

        encode = encoder(vocabulary.path, vocabulary.end, vocabulary.spaces, vocabulary.places).encode
        part, queue = TaskContext.get().partitionId(), {}
        for batch in blocks(batches, size=BYTES):
            flat, offsets = encode(batch.column(1))
            raw = flat.astype(f"<u{vocabulary.width}").tobytes()
            n, at = np.diff(offsets), []
            for s, m in zip(batch.column(2).to_pylist(), n.tolist()):
                at.append(queue.get(s, 0))
                queue[s] = at[-1] + m
            ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((offsets * vocabulary.width).astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(n), ids], names=["key", "source", "part", "at", "n", "ids"])

    # "0" and the name, or "1" for null, which so comes last
    source = F.coalesce(F.concat(F.lit("0"), docs["source"].cast("string")), F.lit("1"))
    rows = docs.select(docs[key].alias("key"), text_or_empty().alias("text"), source.alias("source"))
    return scratch(rows.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, source string, part int, at long, n long, ids binary"), "tokens")


def pack(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", targets: dict[str | None, float] | None = None) -> DataFrame:
    """One row a piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, ids.

    targets: a positive weight for each source; a source's own number of tokens where it has none.
    """
    rows = tokenised(docs, vocabulary, key)
    sums = scratch(rows.groupBy("source", "part").agg(F.sum("n").alias("n")), "sums")
    order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source", "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    per_source = sorted((r["source"], r["n"]) for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect())
    number = {s: k for k, (s, _) in enumerate(per_source)}
    totals = np.array([n for _, n in per_source], np.int64)
    given = {"1" if s is None else "0" + s: q for s, q in (targets or {}).items()}
    if any(q <= 0 for q in given.values()):
        raise ValueError("a target is a positive number")
    every, shared = sum(n for s, n in per_source if s in given), sum(q for s, q in given.items() if s in number)
    # Targets are weights among the sources that have one: these keep their own share together.
    rounds = Rounds(totals, np.array([given[s] * every / shared if s in given else float(n) for s, n in per_source]))
    width, kind = vocabulary.width, docs.schema[key].dataType.simpleString()

    def run(batches):
        forget()
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            names = batch.schema.names
            keys = batch.column(names.index("key"))
            source, ids = (batch.column(names.index(c)).to_pylist() for c in ("source", "ids"))
            n, start = (batch.column(names.index(c)).to_numpy() for c in ("n", "start"))
            whose = np.array([number[s] for s in source])
            for at in runs(whose, start, n):
                doc, begin, length, sequence, offset = rounds.pieces(int(whose[at[0]]), start[at], n[at])
                doc = at[doc]
                wide = {i: np.frombuffer(ids[i], f"<u{width}").astype("<u4").tobytes() for i in at.tolist()}
                raw = [wide[d][4 * b : 4 * (b + m)] for d, b, m in zip(doc.tolist(), begin.tolist(), length.tolist())]
                name = source[at[0]][1:] if source[at[0]][0] == "0" else None
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(doc)), pa.array(begin), pa.array(length), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(n[doc]), pa.array(sequence), pa.array(offset), pa.array([name] * len(doc), pa.string()), pa.array(raw, pa.binary())],
                    names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"],
                )

    placed = rows.join(small(bases, sums.count()), ["source", "part"]).select("key", "source", "n", (F.col("base") + F.col("at")).alias("start"), "ids")
    return placed.mapInArrow(run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids binary")
