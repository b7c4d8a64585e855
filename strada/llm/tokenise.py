"""Token ids of whole texts by the tokenizers library, word by word where that is the same.

The patterns of both vocabularies never join characters across a single space between
words, so a word (for byte-level vocabularies with the space before it) has the same
ids wherever it stands. Nor do they join a letter and a mark or digit after it, or
what is beside a single line break. Texts of plain Latin letters with single spaces are
therefore cut there, and only pieces not met before go to the library, many in one call.
Every other text goes to the library whole.
"""

from __future__ import annotations

import os

import numpy as np

from .textblock import TextBlock, mix
from .wordcache import WordCache, only

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def _plain_bytes() -> np.ndarray:
    """First or only bytes of characters up to U+024F that aren't controls; continuation bytes too."""
    ok = np.zeros(256, bool)
    ok[[0x09, 0x0A, 0x0D, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC2, 0xCA)]] = True
    return ok


_PLAIN = _plain_bytes()
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = ~_LETTER
_MARK[[*range(0x21), *range(0x7F, 256)]] = False
_BLANK = np.zeros(256, bool)
_BLANK[[0x09, 0x0A, 0x0D, 0x20]] = True


def _odd(block: TextBlock, edges: bool) -> np.ndarray:
    """Documents for which the cut is not known to be exact; with edges, those too where a space stands beside white space or at an end."""
    data, after = block.data, np.append(block.data[1:], np.uint8(0)) if len(block.data) else block.data
    bad = ~_PLAIN[data]
    bad |= (data == 0xC2) & ((after <= 0xA0) | (after == 0xAD))  # controls, the hard space and the soft hyphen
    bad |= (data == 0xC9) & (after > 0x8F)
    bad |= (data == ord("<")) & (after == ord("|"))  # may be the name of a special token
    if edges:
        space = data == 0x20
        bad |= (space & _BLANK[after]) | (_BLANK[data] & (after == 0x20))
        full = np.flatnonzero(np.diff(block.offsets))
        bad[block.offsets[full]] |= space[block.offsets[full]]
        bad[block.offsets[full + 1] - 1] |= space[block.offsets[full + 1] - 1]
    return block.in_docs(bad) > 0


def _cut(block: TextBlock) -> None:
    """Cut words further: between a letter and a mark or digit, and around single tabs and line breaks."""
    data = block.data
    if len(data) < 2:
        return
    blank = _BLANK[data]
    at = _LETTER[data[:-1]] & _MARK[data[1:]]
    at |= ~blank[:-1] & blank[1:]
    at[1:] |= ~blank[:-2] & blank[1:-1] & ~blank[2:]
    at &= ~block.space[1:] & ~block.space[:-1]
    at = np.flatnonzero(at) + 1
    inside = np.ones(len(data) + 1, bool)
    inside[block.offsets] = False
    at = at[inside[at]]
    block.cut(at)


#: Words of one call of the library; its cost a word grows with their number.
CALL = 2048
#: Places of a worker's table of known words, a power of two: 33 bytes each; fewer cost calls of the library, never results.
PLACES = 1 << 21


class Encoder:
    def __init__(self, path: str, end: int, spaces: bool, places: int = PLACES):
        """end: the id put after each text. spaces: whether white space gets ids (byte-level) or is dropped."""
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.end, self.spaces = end, spaces
        self.known = WordCache(self.library.get_vocab_size(), places)

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; where each text begins in them, and the end)."""
        block = TextBlock(column, b" ") if self.spaces else TextBlock(column)
        odd = _odd(block, self.spaces)
        _cut(block)
        keys, checks = block.word_hashes(), block.word_hashes(1)
        head = np.zeros(len(keys), bool)
        if self.spaces:  # what no space stands before
            head = (block.starts == block.offsets[:-1][block.doc_of_word]) | (block.data[block.starts - 1] != 0x20)
            keys = np.where(head, mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)), keys)
            checks = np.where(head, mix(checks), checks)
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        odd[block.doc_of_word[checks != checks[first][which]]] = True  # another word has this hash
        own = np.flatnonzero(~odd[block.doc_of_word])
        doc = block.doc_of_word[own]
        if len(own) < len(keys):
            distinct, first, which = np.unique(keys[own], return_index=True, return_inverse=True)
            first = own[first]
        raw = block.data.tobytes()

        def learn(new):
            at = first[new]
            before = np.where(head[at], "", " ") if self.spaces else np.full(len(at), "")
            words = [b + raw[s:e].decode() for b, s, e in zip(before.tolist(), block.starts[at].tolist(), block.ends[at].tolist())]
            sizes, ids = [], []
            for k in range(0, len(words), CALL):
                got = self.library.encode(words[k : k + CALL], is_pretokenized=True, add_special_tokens=False)
                sizes.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(words[k : k + CALL])))
                ids.append(np.array(got.ids, np.int32))
            return np.concatenate(sizes), np.concatenate(ids)

        begin, n, flat = self.known.pieces(distinct, checks[first], learn)
        begin, n = begin[which], n[which]
        sizes = np.bincount(doc, weights=n, minlength=block.n_docs).astype(np.int64) + 1
        whole = {}
        for d in np.flatnonzero(odd).tolist():
            text = block.data[block.offsets[d] : block.offsets[d + 1]].tobytes().decode()
            whole[d] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
            sizes[d] = len(whole[d]) + 1
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(offsets[-1], np.uint32)
        out[offsets[1:] - 1] = self.end
        before = np.concatenate([[0], np.cumsum(n)])
        in_doc = before[:-1] - before[np.searchsorted(doc, doc)]
        step = np.arange(before[-1]) - np.repeat(before[:-1], n)
        out[np.repeat(offsets[doc] + in_doc, n) + step] = flat[np.repeat(begin, n) + step]
        for d, ids in whole.items():
            out[offsets[d] : offsets[d + 1] - 1] = ids
        return out, offsets


def encoder(path: str, end: int, spaces: bool, places: int = PLACES) -> Encoder:
    """One encoder a worker and vocabulary."""
    return only(("encoder", path, end, places), lambda: Encoder(path, end, spaces, places))
