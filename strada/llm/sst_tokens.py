"""Operator 4, token ids in binary files: sorted-string-table shards.

A shard holds the documents of one range of keys, in ascending order:

    data blocks | index | Bloom filter | footer

A data block is a run of entries `shared, unshared, length (varints), key suffix, ids`;
a key shares a prefix with the one before it, and the first of a block shares none.
The index has for each block its first key, its place and its CRC-32; a lookup bisects
it and reads one block (more only where a repeated key runs on), after the Bloom filter
let the key pass. Keys are one byte (0 for a null, else 1) and the sign-flipped
big-endian 64-bit identifier, so that byte order is numeric order with null first. Ids
take 2 bytes where the vocabulary allows it, else 4. The footer is of fixed size.

Writing is one range shuffle of (key, text); each task then streams its rows to a file
named by partition and attempt, and only files of the tasks that were committed are in
the manifest, so a task that is run again or lost leaves nothing that is read. The
driver holds one manifest row a shard.

Defined results: a null text counts as empty and gets the end id only; rows with equal
keys are all kept, ordered by their text; an empty table gives no shard and an empty
table; further columns are not read. The format's keys are 64-bit integers: a key of another type
is cast, and one that cannot be is an error (Spark's, before anything is written). Shards are written by
Arrow's file systems, to stores that these know; s3a, s3n, wasb and wasbs are taken for Arrow's names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, local_rows, scratch_path, text_or_empty
from .tokenise import PLACES, encoder

MAGIC = b"STRDSST1"
#: magic, width, entries, tokens, places of the index and of the filter
FOOTER = struct.Struct("<8sIQQQQQQ")
BLOCK_BYTES = 64 << 10
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7


def encode_key(key: int | None) -> bytes:
    return b"\x00" if key is None else b"\x01" + struct.pack(">Q", (key + (1 << 63)) & 0xFFFFFFFFFFFFFFFF)


def decode_key(raw: bytes) -> int | None:
    return None if raw == b"\x00" else struct.unpack(">Q", raw[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_slots(key: bytes, bits: int) -> Iterator[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return ((a + i * b) % bits for i in range(BLOOM_HASHES))


class Writer:
    """Streams entries in ascending key order to a file object."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.block, self.before, self.index, self.keys = bytearray(), b"", [], []
        self.first, self.at, self.entries, self.tokens = b"", 0, 0, 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if len(self.block) >= BLOCK_BYTES:
            self._flush()
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.before)) and key[shared] == self.before[shared]:
                shared += 1
        else:
            self.first = key
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.before = key
        self.entries += 1
        self.tokens += len(ids)

    def _flush(self) -> None:
        raw = bytes(self.block)
        self.out.write(raw)
        self.index.append((self.first, self.at, len(raw), zlib.crc32(raw)))
        self.at += len(raw)
        self.block.clear()

    def close(self) -> None:
        if self.block:
            self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQI", *rest) for k, *rest in self.index)
        bits = max(64, len(self.keys) * BLOOM_BITS_PER_KEY)
        plane = bytearray((bits + 7) // 8)
        for key in self.keys:
            for s in _bloom_slots(key, bits):
                plane[s >> 3] |= 1 << (s & 7)
        bloom = struct.pack("<Q", bits) + bytes(plane)
        self.out.write(index)
        self.out.write(bloom)
        self.out.write(FOOTER.pack(MAGIC, self.width, self.entries, self.tokens, self.at, len(index), self.at + len(index), len(bloom)))


class Reader:
    """Reads a shard from a seekable file object: all of it in order, or single keys."""

    def __init__(self, source):
        self.source = source
        size = source.size() if callable(getattr(source, "size", None)) else source.seek(0, 2)
        magic, self.width, self.entries, self.tokens, at, n, bloom_at, bloom_n = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        raw, self.index, k = self._read(at, n), [], 0
        while k < n:
            m, k = _read_varint(raw, k)
            self.index.append((raw[k : k + m], *struct.unpack_from("<QQI", raw, k + m)))
            k += m + 20
        raw = self._read(bloom_at, bloom_n)
        self.bits, self.plane = struct.unpack_from("<Q", raw)[0], raw[8:]

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, number: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, n, crc = self.index[number]
        raw, k, key = self._read(at, n), 0, b""
        if zlib.crc32(raw) != crc:
            raise ValueError(f"block {number} is damaged")
        while k < n:
            shared, k = _read_varint(raw, k)
            own, k = _read_varint(raw, k)
            size, k = _read_varint(raw, k)
            key = key[:shared] + raw[k : k + own]
            k += own
            yield key, np.frombuffer(raw, f"<u{self.width}", size // self.width, k)
            k += size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for number in range(len(self.index)):
            for key, ids in self._block(number):
                yield decode_key(key), ids

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of every document with this key."""
        raw = encode_key(key)
        if not all(self.plane[s >> 3] >> (s & 7) & 1 for s in _bloom_slots(raw, self.bits)):
            return []
        low, high = 0, len(self.index)
        while low < high:  # the first block whose first key is not below this one
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < raw else (low, mid)
        found = []
        for number in range(max(0, low - 1), len(self.index)):
            if self.index[number][0] > raw:
                break
            found += [ids.copy() for k, ids in self._block(number) if k == raw]
        return found


@dataclass(frozen=True)
class Vocabulary:
    """path of a tokenizers file; the id after each document; whether white space gets ids; the number of ids; places of a worker's table of known words."""

    path: str
    end: int
    spaces: bool
    size: int
    places: int = PLACES

    @property
    def width(self) -> int:
        return 2 if self.size <= 1 << 16 else 4


#: Hadoop's names of stores that have another one in Arrow.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def place(path: str):
    """(file system, path in it) of a URI as Hadoop writes it."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    return fs.FileSystem.from_uri(_SCHEMES.get(scheme, scheme) + colon + rest)


def open_shard(path: str):
    where, at = place(path)
    return where.open_input_file(at)


def write(docs: DataFrame, vocabulary: Vocabulary, folder: str | None = None, key: str = "doc_id") -> list[dict]:
    """Write shards to a shared folder; the manifest, in ascending order of keys."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "sst")

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        encode = encoder(vocabulary.path, vocabulary.end, vocabulary.spaces, vocabulary.places).encode
        path = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.sst"
        out = writer = None
        for batch in blocks(batches, size=2 << 20):
            if writer is None:
                where, at = place(path)
                where.create_dir(at.rpartition("/")[0])
                out = where.open_output_stream(at)
                writer = Writer(out, vocabulary.width)
            ids, offsets = encode(batch.column(1))
            for k, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                writer.add(encode_key(k), ids[a:b])
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "path": [path], "entries": pa.array([writer.entries], pa.int64()), "tokens": pa.array([writer.tokens], pa.int64())})

    rows = docs.select(docs[key].cast("long").alias("key"), text_or_empty().alias("text"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    return [r.asDict() for r in sorted(ordered.mapInArrow(run, "shard int, path string, entries long, tokens long").collect())]


def read(spark: SparkSession, manifest: list[dict], key: str = "doc_id") -> DataFrame:
    """One row a document, from the files: key, start, n_tokens, ids_crc32."""
    shards, before = [], 0
    for m in manifest:
        shards.append((m["path"], before))
        before += m["tokens"]

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_shard(path) as source:
                    keys, sizes, sums = [], [], []
                    for k, ids in Reader(source):
                        keys.append(k)
                        sizes.append(len(ids))
                        sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    ends = start + np.cumsum(np.array(sizes, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    rows = local_rows(spark, shards, "path string, start long")
    return rows.repartition(max(1, len(shards))).mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")
