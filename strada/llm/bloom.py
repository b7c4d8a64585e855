"""A Bloom filter of the hashes that occur more than once, built in two bits a slot.

Each task marks slots in two planes: `once`, and `more` for slots met again with
the same hash. Planes merge by (A1|A2, B1|B2|A1&A2), block by block, so a hash that
two rows share has all its slots in `more`: there are no false negatives. A task
sends, for each block that it touched, a sparse or a dense block, whichever is
shorter; so its output is bounded by the filter's size and by its own rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .wordcache import forget

BLOCK_BITS = 1 << 16
SLOTS = 2
TAKEN = 1 << 20
#: The filter never exceeds this, whatever the corpus; a fuller filter lets more rows
#: through to the exact pass and changes no result.
MOST_BITS = 1 << 29


def bits_for(rows: int) -> int:
    """A power of two with about 12 bits a row, within [2**16, MOST_BITS]."""
    return min(MOST_BITS, max(BLOCK_BITS, 1 << int(np.ceil(np.log2(max(rows, 1) * 12)))))


def slots(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """SLOTS bit positions of each 64-bit hash; bits is a power of two."""
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
    return [((low + np.uint64(i) * high) & np.uint64(bits - 1)).astype(np.int64) for i in range(SLOTS)]


def _pack(values: np.ndarray) -> bytes:
    """Sorted offsets in a block, as 16-bit numbers or as a bitmap."""
    if 2 * len(values) < BLOCK_BITS // 8:
        return b"s" + values.astype("<u2").tobytes()
    plane = np.zeros(BLOCK_BITS, bool)
    plane[values] = True
    return b"d" + np.packbits(plane).tobytes()


def _plane(packed: bytes) -> np.ndarray:
    if packed[:1] == b"d":
        return np.unpackbits(np.frombuffer(packed, np.uint8, offset=1)).astype(bool)
    plane = np.zeros(BLOCK_BITS, bool)
    plane[np.frombuffer(packed, "<u2", offset=1)] = True
    return plane


def _per_block(positions: np.ndarray) -> dict[int, bytes]:
    positions = np.unique(positions)
    block = positions // BLOCK_BITS
    edges = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else []
    parts = np.split(positions, edges[1:]) if len(block) else []
    return {int(p[0] // BLOCK_BITS): _pack(p % BLOCK_BITS) for p in parts}


def _taken(batches):
    """The hashes of a task, some TAKEN at a time: blocks of a task merge as those of two tasks do."""
    forget()
    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64))
        n += len(held[-1])
        if n >= TAKEN:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def _build(bits: int):
    def run(batches):
        for taken in _taken(batches):
            distinct, count = np.unique(taken, return_counts=True)
            once = _per_block(np.concatenate(slots(distinct, bits)))
            twice = distinct[count > 1]
            more = _per_block(np.concatenate(slots(twice, bits)))
            names = list(once)
            for at in range(0, len(names), 512):
                some = names[at : at + 512]
                yield pa.RecordBatch.from_pydict({"block": pa.array(some, pa.int32()), "once": [once[b] for b in some], "more": pa.array([more.get(b) for b in some], pa.binary())})

    return run


def _merge(key, table):
    once, more = np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
    for a, b in zip(table.column("once").to_pylist(), table.column("more").to_pylist()):
        own = _plane(a)
        more |= once & own
        once |= own
        if b is not None:
            more |= _plane(b)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "more": pa.array([_pack(np.flatnonzero(more))], pa.binary())})


def repeated(hashes: DataFrame, bits: int):
    """The packed `more` plane of a one-column DataFrame of longs, as a Spark broadcast of at most bits / 8 bytes and a little."""
    parts = hashes.mapInArrow(_build(bits), "block int, once binary, more binary")
    merged = parts.groupBy("block").applyInArrow(_merge, "block int, more binary")
    return _broadcast(merged, bits)


def _set(bits: int):
    def run(batches):
        for taken in _taken(batches):
            own = _per_block(np.concatenate(slots(taken, bits)))
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(own), pa.int32()), "plane": list(own.values())})

    return run


def _join(key, table):
    plane = np.zeros(BLOCK_BITS, bool)
    for packed in table.column("plane").to_pylist():
        plane |= _plane(packed)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "plane": pa.array([_pack(np.flatnonzero(plane))], pa.binary())})


def members(hashes: DataFrame, bits: int):
    """A plain filter of a one-column DataFrame of longs, as a Spark broadcast of at most bits / 8 bytes and a little."""
    merged = hashes.mapInArrow(_set(bits), "block int, plane binary").groupBy("block").applyInArrow(_join, "block int, plane binary")
    return _broadcast(merged, bits)


def _broadcast(merged: DataFrame, bits: int):
    plane = np.zeros(bits // 8, np.uint8)
    for block, packed in merged.toLocalIterator():
        plane[block * (BLOCK_BITS // 8) : (block + 1) * (BLOCK_BITS // 8)] = np.packbits(_plane(bytes(packed)))
    return merged.sparkSession.sparkContext.broadcast(plane)


def holds(plane: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have all their slots set."""
    found = np.ones(len(hashes), bool)
    for at in slots(hashes, len(plane) * 8):
        found &= (plane[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return found
