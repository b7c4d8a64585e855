"""Operator 9, language identification: cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A document is parsed
against it from left to right into phrases, each the longest match that the labelled
text holds anywhere; where no match goes on, a phrase ends and the next begins there. A
text in the automaton's language needs few phrases. With n labelled symbols a phrase
costs log2(n) bits, so the language with the lowest phrases * log2(n) / length wins.

The parse only ever follows transitions from the root and restarts at a mismatch, so
thousands of segments of SEGMENT symbols step through the automata at once, all languages side by
side; phrases end at segments' ends too, in every language alike. Every symbol of every text
is parsed. All automata's transitions are in one comb: state s goes on with symbol c to `to[base[s] + c]`
if `owner[base[s] + c]` is s. States' rows overlap where they leave places free, so its size goes with
the number of transitions, at most three a labelled symbol, and the number of letters is added
once, not once a state.

Labelled text is a bounded sample: of the training rows of each language the `rows` with
the smallest hash of their key, and of these `symbols` characters, in equal shares: a text longer
than its share gives PARTS pieces from all along it, a shorter one is taken whole and leaves the
rest to the others. Symbols are letters in lower case; any run of other characters is one symbol.

Defined results: `und` with score 0 if a text is null, empty or has no letter, or if
there is nothing to learn from; of equally good languages the first by name; repeated
rows each get a result; further columns are ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, local_rows, scratch, small, text_offsets, text_or_empty

#: Labelled rows and characters a language; symbols that are parsed in one go; pieces of a long text.
ROWS, SYMBOLS, SEGMENT, PARTS = 40, 24_000, 256, 4
OTHER, UNKNOWN = 0, 1


@lru_cache(1)
def _folds() -> np.ndarray:
    """Lower-case letter of each code point, 0 for what is no letter."""
    out = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Automaton:
    """The suffix automaton of a sequence of symbols, as lists of transitions."""

    def __init__(self, symbols):
        self.next, self.link, self.length = [{}], [-1], [0]
        last = 0
        for c in symbols:
            now = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = now
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[now] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    self.link[q] = self.link[now] = twin
            last = now


class Comb:
    """The transitions of automata whose states are numbered through: arrays base, owner and to."""

    def __init__(self, nexts: list[dict[int, int]], width: int):
        # The first and last `width` places stay empty, as a row is looked up beyond both its ends.
        free = bytearray(width) + bytearray(b"\1") * (sum(map(len, nexts)) + width)
        base, at, single = [0] * len(nexts), width, False
        for s in sorted((s for s, n in enumerate(nexts) if n), key=lambda s: -len(nexts[s])):
            symbols = sorted(nexts[s])
            if len(symbols) == 1 and not single:
                at, single = width, True
            place = free.find(1, at)
            if single:
                at = place
            else:
                offsets, tries = [c - symbols[0] for c in symbols[1:]], 0
                while True:
                    if place < 0 or place + offsets[-1] >= len(free):
                        free += bytearray(b"\1") * width
                        place = max(place, free.find(1, at))
                    if all(map(free.__getitem__, map(place.__add__, offsets))):
                        break
                    place, tries = free.find(1, place + 1), tries + 1
                if tries > 64:  # what lies before is nearly full; single transitions fill it
                    at = (at + place) // 2
            base[s] = place - symbols[0]
            for c in symbols:
                free[base[s] + c] = 0
        size = len(free) + width
        kind = np.int32 if size < 1 << 31 else np.int64
        self.base = np.array(base, kind)
        self.owner, self.to = np.full(size, -1, kind), np.zeros(size, kind)
        edges = np.array([(s, c, t) for s, n in enumerate(nexts) for c, t in n.items()], np.int64).reshape(-1, 3)
        place = self.base[edges[:, 0]] + edges[:, 1]
        self.owner[place], self.to[place] = edges[:, 0], edges[:, 2]

    def go(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether there is a transition, where it leads)."""
        at = self.base[state] + symbol
        return self.owner[at] == state, self.to[at]


class Model:
    """The automata of all languages, their states numbered through."""

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        folds = _folds()
        raw = {k: _collapse(folds[np.frombuffer(texts[k].encode("utf-32-le", "replace"), np.uint32)]) for k in self.languages}
        letters = np.unique(np.concatenate([*raw.values(), [0]]))
        self.letters = letters[letters > 0]
        nexts: list[dict[int, int]] = []
        self.roots = []
        for k in self.languages:
            root = len(nexts)
            self.roots.append(root)
            nexts += [{c: root + t for c, t in to.items()} for to in Automaton(self.classes(raw[k]).tolist()).next]
        self.comb = Comb(nexts, len(self.letters) + 2)
        self.bits = np.array([math.log2(max(2, len(raw[k]))) for k in self.languages])

    def classes(self, folded: np.ndarray) -> np.ndarray:
        """0 no letter, 1 a letter not learned, from 2 on the learned letters."""
        at = np.searchsorted(self.letters, folded)
        known = self.letters[np.minimum(at, len(self.letters) - 1)] == folded if len(self.letters) else np.zeros(len(folded), bool)
        return np.where(folded == 0, OTHER, np.where(known, at + 2, UNKNOWN)).astype(np.int32)


def _collapse(folded: np.ndarray) -> np.ndarray:
    """Without the second and further of a run of non-letters."""
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] > 0) | (folded[:-1] > 0)
    return folded[keep]


def phrases(model: Model, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Phrases that each text needs in each language: (texts, languages)."""
    n = np.diff(offsets)
    count = -(-n // SEGMENT)
    text = np.repeat(np.arange(len(n)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][text] + number * SEGMENT
    size = np.minimum(SEGMENT, offsets[1:][text] - start)
    order = np.argsort(-size, kind="stable")
    start, size, text = start[order], size[order], text[order]
    roots = np.array(model.roots, model.comb.base.dtype)
    state = np.repeat(roots[:, None], len(start), axis=1)
    ended = np.zeros(state.shape, np.int32)
    live = len(start)
    for t in range(int(size.max()) if len(size) else 0):
        while live and size[live - 1] <= t:
            live -= 1
        symbol = symbols[start[:live] + t]
        own = state[:, :live]
        goes, to = model.comb.go(own, symbol[None, :])
        k, i = np.nonzero(~goes)
        # A mismatch ends a phrase; a symbol that the labelled text never has is one by itself.
        begun = own[k, i] != roots[k]
        again, first = model.comb.go(roots[k], symbol[i])
        ended[k, i] += begun.astype(np.int32) + ~again
        to[k, i] = np.where(again, first, roots[k])
        state[:, :live] = to
    out = np.zeros((len(n), len(roots)), np.int64)
    for k in range(len(roots)):
        out[:, k] = np.bincount(text, weights=ended[k] + (state[k] != roots[k]), minlength=len(n))
    return out


def identify(model: Model, column) -> tuple[list[str], np.ndarray]:
    data, offsets = text_offsets(column)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    offsets = lead[offsets]
    folded = _folds()[points]
    first = np.zeros(len(points) + 1, bool)
    first[offsets] = True
    keep = np.ones(len(points), bool)
    keep[1:] = (folded[1:] > 0) | (folded[:-1] > 0)
    keep |= first[:-1]
    letters = np.concatenate([[0], np.cumsum(folded > 0)])
    some = np.diff(letters[offsets]) > 0
    held = np.concatenate([[0], np.cumsum(keep)])[offsets]
    n = np.diff(held)
    if not model.languages:
        return ["und"] * len(n), np.zeros(len(n))
    cost = phrases(model, model.classes(folded[keep]), held) * model.bits
    best = cost.argmin(axis=1)
    # The posterior of the winner if each language's text had that many bits, at most 40 a text so that it says something.
    over = (cost - cost.min(axis=1, keepdims=True)) * np.minimum(1, 40 / np.maximum(1, cost.min(axis=1, keepdims=True)))
    score = 1 / np.exp2(-over).sum(axis=1)
    return [model.languages[b] if s else "und" for b, s in zip(best.tolist(), some.tolist())], np.where(some, score, 0.0)


def shares(lengths: list[int], total: int) -> list[int]:
    """total dealt equally to texts of these lengths, none more than its length."""
    out, left = [0] * len(lengths), total
    order = sorted(range(len(lengths)), key=lambda k: lengths[k])
    for place, k in enumerate(order):
        out[k] = min(lengths[k], left // (len(order) - place))
        left -= out[k]
    return out


def learn(docs: DataFrame, held_out: Column, key: str = "doc_id", rows: int = ROWS, symbols: int = SYMBOLS) -> Model:
    """The model of a bounded sample of the rows that aren't held out: `rows` rows and `symbols` characters a language."""
    spark = docs.sparkSession
    known = docs.where(~held_out & docs["lang"].isNotNull() & docs["text"].isNotNull()).select(docs["lang"].cast("string").alias("lang"), docs["text"].alias("text"), F.xxhash64(docs[key].cast("string")).alias("h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    sample = scratch(known.withColumn("rank", rank).where(f"rank <= {int(rows)}").select("lang", "rank", "text"), "sample")
    lengths: dict[str, list[tuple[int, int]]] = {}
    for lang, number, n in sorted(map(tuple, sample.select("lang", "rank", F.length("text")).collect())):
        lengths.setdefault(lang, []).append((number, n))
    quota = [(lang, number, q) for lang, held in lengths.items() for (number, _), q in zip(held, shares([n for _, n in held], symbols)) if q]
    dealt = sample.join(small(local_rows(spark, quota, "lang string, rank int, quota int"), len(quota)), ["lang", "rank"])
    size = F.ceil(F.col("quota") / PARTS).cast("int")
    begin = [F.floor((F.length("text") - size) * F.lit(j / (PARTS - 1))).cast("int") + 1 for j in range(PARTS)]
    some = F.when(F.length("text") <= F.col("quota"), F.col("text")).otherwise(F.concat_ws(" ", *[F.substring(F.col("text"), b, size) for b in begin]))
    texts: dict[str, list[str]] = {}
    for lang, _, text in sorted(map(tuple, dealt.select("lang", "rank", some).collect())):
        texts.setdefault(lang, []).append(text)
    return Model({lang: " ".join(held) for lang, held in texts.items()})


def predict(docs: DataFrame, held_out: Column, key: str = "doc_id", rows: int = ROWS, symbols: int = SYMBOLS) -> DataFrame:
    """One row per document: key, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, held_out, key, rows, symbols))

    def run(batches):
        for batch in blocks(batches):
            names, score = identify(shared.value, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score)], names=[key, "held_out", "lang_pred", "score"])

    texts = docs.select(docs[key].alias(key), held_out.alias("held_out"), text_or_empty().alias("text"))
    return texts.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
