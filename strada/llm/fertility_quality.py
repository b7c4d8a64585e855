"""Operator 7, quality rules: tokeniser fertility.

A public vocabulary with byte fallback is a yardstick of how text-like a text
is. Its words are encoded one by one (pieces never span white space, so a word's
pieces do not depend on its neighbours), which gives per document

* characters per token,
* the share of byte-fallback tokens,
* the entropy of the document's token distribution, in bits per token.

Each script has its own rejection bands. Latin is set by measurement: of the 53,775 prose texts of
sf0.1 and check_h that pass the base rules, all Latin, none is under 1.654 characters per token or
4.77 bits; random letters in 50 to 2,000 words reach 1.613, consonants 1.51, base64 1.24, printable
characters 1.16. Symbols (at most 1.25) and decimals (0.88) have no script. A Latin text with many marked letters, as
Vietnamese, is cut finely by nature (1.21 measured), which no ASCII noise resembles, so it has
a band of its own. The tables have no other script: for Cyrillic the end lies between a sentence (2.1)
and random letters (1.19), and Greek, which this vocabulary spells (0.84), and the rest keep wide bands,
in which only byte fallback tells noise. Entropy has no upper end: long real
texts have more of it than random letters. Rows out depend on nothing but their
own text: the plan is one scan and one map, without a shuffle.

Defined results: a null text counts as empty; an empty text has zero words, fails
the base rules and is not kept; equal rows get equal results, each its own;
further columns are ignored by `measure` and carried along by `keep_good`; an
empty table gives an empty table.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import blocks, bounded, parts, text_or_empty, whole
from .textblock import TextBlock, mix, repeats
from .wordcache import WordCache, only

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_tokens long, chars_per_token double, byte_share double, token_entropy double, script string, kept boolean"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Band:
    """What a text may measure and be kept. Entropy counts from `entropy_tokens` tokens on."""

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy: float
    entropy_tokens: int = 64


@dataclass(frozen=True)
class Bands:
    """By script of most letters: fixed parameters, so that a row's verdict depends on its own text only."""

    by_script: dict[str, Band] = field(
        default_factory=lambda: {
            "latin": Band((1.62, 12.0), 0.20, 4.0),
            "latin_marked": Band((1.1, 12.0), 0.20, 4.0),
            "cyrillic": Band((1.3, 8.0), 0.40, 2.5),
            "greek": Band((0.8, 8.0), 0.40, 2.5),
            "other": Band((0.3, 6.0), 0.85, 2.0),
            "none": Band((1.3, 8.0), 0.20, 3.6),
        }
    )


def _script_of_lead() -> np.ndarray:
    """Script class by a character's first UTF-8 byte: 0 none, 1 latin, 2 cyrillic, 3 greek, 4 other."""
    out = np.zeros(256, np.int8)
    for b in range(128):
        out[b] = 1 if chr(b).isalpha() else 0
    for lead in range(0xC3, 0xE0):
        name = unicodedata.name(bytes([lead, 0x91]).decode(), "")
        out[lead] = 1 if name.startswith("LATIN") else 2 if name.startswith("CYRILLIC") else 3 if name.startswith("GREEK") else 4
    out[0xE0:0xE2] = 4
    out[0xE3:0xF5] = 4
    return out


_LEAD = _script_of_lead()
_SCRIPTS = np.array(["none", "latin", "cyrillic", "greek", "other", "latin_marked"])
# Marked Latin letters by first byte (E1 has those of Vietnamese), and the share of a text's letters from which they count as many.
_MARKED = (_LEAD == 1) & (np.arange(256) >= 0x80) | (np.arange(256) == 0xE1)
MARKED = 0.15


class Vocabulary:
    """Pieces of single words."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.known = WordCache(self.model.get_piece_size(), 1 << 20)

    def encode(self, block: TextBlock, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all words in order, number of pieces of each word)."""
        check = block.word_hashes(1)
        distinct, first, which = np.unique(words, return_index=True, return_inverse=True)
        if (check != check[first][which]).any():  # two words with one hash: both hashes tell them apart
            distinct, first, which = np.unique(words + mix(check), return_index=True, return_inverse=True)
        raw = block.data.tobytes()

        def learn(new):
            at = first[new]
            texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(block.starts[at].tolist(), block.ends[at].tolist())]
            ids = self.model.encode(texts, num_threads=1)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            return size, np.fromiter((x for one in ids for x in one), np.int32, size.sum())

        begin, size, flat = self.known.pieces(distinct, check[first], learn)
        begin, n = begin[which], size[which]
        to = np.cumsum(n)
        return flat[np.arange(n.sum()) + np.repeat(begin - (to - n), n)], n


def measure_block(block: TextBlock, vocabulary: Vocabulary, bands: Bands) -> dict[str, np.ndarray]:
    words = block.word_hashes()
    lead = (block.data & 0xC0) != 0x80
    n_words = block.n_words.astype(np.int64)
    word_chars = block.in_docs(lead & ~block.space)

    start, end, doc = block.lines()
    with_word = np.searchsorted(block.starts, end) > np.searchsorted(block.starts, start)
    start, end, doc = start[with_word], end[with_word], doc[with_word]
    _, number = repeats(doc, block.hashes(start, end))
    n_dup_lines = np.bincount(doc[number > 0], minlength=block.n_docs)

    at, key = block.grams(words, 3)
    many, _ = repeats(block.doc_of_word[at], key)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[at[many] + k] = True
    n_repeat = block.in_words(covered)
    base_failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)

    pieces, each = vocabulary.encode(block, words)
    owner = np.repeat(block.doc_of_word, each)
    n_tokens = np.bincount(owner, minlength=block.n_docs)
    some = np.maximum(n_tokens, 1)
    byte_share = np.bincount(owner, weights=vocabulary.is_byte[pieces], minlength=block.n_docs) / some
    pairs = np.sort(owner * np.int64(len(vocabulary.is_byte)) + pieces)
    edge = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, np.int64)
    count = np.diff(np.append(edge, len(pairs)))
    held = pairs[edge] // len(vocabulary.is_byte)
    p = count / some[held]
    entropy = np.bincount(held, weights=-p * np.log2(p), minlength=block.n_docs)
    per_token = word_chars / some

    scripts = np.stack([block.in_docs(lead & (_LEAD[block.data] == k)) for k in (1, 2, 3, 4)])
    script = np.where(scripts.max(axis=0) > 0, scripts.argmax(axis=0) + 1, 0)
    marked = block.in_docs(lead & _MARKED[block.data]) > MARKED * scripts.sum(axis=0)
    script = np.where((script == 1) & marked, len(_SCRIPTS) - 1, script)
    lowest, highest, bytes_most, least, from_n = (
        np.array([f(bands.by_script[s]) for s in _SCRIPTS])[script]
        for f in (lambda b: b.chars_per_token[0], lambda b: b.chars_per_token[1], lambda b: b.byte_share, lambda b: b.entropy, lambda b: b.entropy_tokens)
    )
    bad = (per_token < lowest) | (per_token > highest) | (byte_share > bytes_most) | ((n_tokens >= from_n) & (entropy < least))
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": block.in_docs(_SYMBOL[block.data]), "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat, "base_failed": base_failed, "n_tokens": n_tokens, "chars_per_token": per_token, "byte_share": byte_share,
        "token_entropy": entropy, "script": _SCRIPTS[script], "kept": ~base_failed & ~bad,
    }


def _mapper(path: str, bands: Bands, carry: bool):
    def run(batches):
        vocabulary = only(("vocabulary", path), lambda: Vocabulary(path))
        for batch in blocks(batches):
            got = measure_block(TextBlock(batch.column(1)), vocabulary, bands)
            if carry:
                yield batch.select([0]).filter(pa.array(got["kept"]))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, got.values())], names=[batch.schema.names[0], *got])

    return run


def measure(docs: DataFrame, model: str, key: str = "doc_id", bands: Bands | None = None) -> DataFrame:
    """One row per document: its key, the base counts, the measures and the verdict."""
    bounded(docs.sparkSession)
    rows = docs.select(docs[key].alias(key), text_or_empty().alias("text"))
    return rows.mapInArrow(_mapper(model, bands or Bands(), False), f"`{key}` {docs.schema[key].dataType.simpleString()}, {SCHEMA}")


def keep_good(docs: DataFrame, model: str, bands: Bands | None = None) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    bounded(docs.sparkSession)
    rows = docs.select(whole(docs).alias("row"), text_or_empty().alias("text"))
    kept = rows.mapInArrow(_mapper(model, bands or Bands(), True), T.StructType([rows.schema["row"]]))
    return kept.select(parts(docs.columns))
