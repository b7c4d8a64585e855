"""Files of NumPy arrays and images, read where they lie by Spark's own readers."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = r"([^/]+?)(?:\.[^./]*)?$"


class BadSegments(ValueError):
    pass


def as_segments(array: np.ndarray) -> np.ndarray:
    """(n, 4) doubles of an (n, 4) or (n, 1, 4) array, or none of an empty one."""
    if array.shape[:1] == (0,):
        return np.zeros((0, 4))
    if array.ndim == 3 and array.shape[1:] == (1, 4):
        array = array[:, 0]
    if array.ndim != 2 or array.shape[1] != 4:
        raise BadSegments(f"shape {array.shape}")
    return array.astype(np.float64)


def _binary(spark: SparkSession, path) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", _NAME, 1).alias("name"), "content")


def segments_of(files: DataFrame) -> DataFrame:
    """(map_id, seg_id, x1..y2) of (name, content of a .npy file), in the order of the rows."""

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = as_segments(np.load(io.BytesIO(raw), allow_pickle=False))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(np.arange(len(rows))), *[pa.array(rows[:, k]) for k in range(4)]], names=["map_id", "seg_id", "x1", "y1", "x2", "y2"])

    return files.mapInArrow(run, "map_id string, seg_id long, x1 double, y1 double, x2 double, y2 double")


def read_segments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(map_id, seg_id, x1..y2) of .npy files, a map a file, in the order of the rows."""
    return segments_of(_binary(spark, path))


def read_arrays(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(name, shape, values) of .npy files, values in row order as doubles."""

    def run(batches):
        for batch in batches:
            loaded = [np.load(io.BytesIO(raw), allow_pickle=False) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(a.shape) for a in loaded], pa.list_(pa.int64())), pa.array([a.ravel().astype(np.float64) for a in loaded], pa.list_(pa.float64()))], names=["name", "shape", "values"])

    return _binary(spark, path).mapInArrow(run, "name string, shape array<long>, values array<double>")


def read_images(spark: SparkSession, path: str | list[str], colour: bool = False) -> DataFrame:
    """(name, height, width, channels, data) of PNG or JPEG files: blue, green, red bytes, or grey ones."""

    def run(batches):
        for batch in batches:
            out = []
            for h, w, n, raw in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                pixels = np.frombuffer(raw, np.uint8).reshape(h, w, n)
                if n == 1 and colour:
                    pixels = np.repeat(pixels, 3, axis=2)
                elif n >= 3 and not colour:
                    pixels = np.rint(pixels[:, :, :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)[:, :, None]
                out.append((pixels.shape[2], pixels.tobytes()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], pa.array([c for c, _ in out], pa.int32()), pa.array([d for _, d in out], pa.binary())], names=["name", "height", "width", "channels", "data"])

    rows = spark.read.format("image").option("dropInvalid", False).load(path).select(F.regexp_extract("image.origin", _NAME, 1).alias("name"), "image.height", "image.width", "image.nChannels", "image.data")
    return rows.mapInArrow(run, "name string, height int, width int, channels int, data binary")


def write_segments(segs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, a folder a map."""
    segs.write.mode(mode).partitionBy("map_id").parquet(path)


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def save_array(spark: SparkSession, path: str, array: np.ndarray) -> None:
    """One array to a .npy file of exactly this name, by Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(npy_bytes(array)))
    finally:
        stream.close()


def save_segments(segs: DataFrame, path: str) -> None:
    """The segments of one map, in the order of seg_id, to a .npy file; a map that one process can draw."""
    rows = segs.select("seg_id", "x1", "y1", "x2", "y2").orderBy("seg_id").toPandas()
    save_array(segs.sparkSession, path, rows[["x1", "y1", "x2", "y2"]].to_numpy(np.float64))


def npy_files(segs: DataFrame) -> DataFrame:
    """(map_id, content): the .npy file of each map, made where its segments are."""

    def one(key, table):
        t = table.sort_by("seg_id")
        values = np.stack([t[c].to_numpy() for c in ("x1", "y1", "x2", "y2")], axis=1)
        return pa.table({"map_id": pa.array([key[0].as_py()], pa.string()), "content": pa.array([npy_bytes(values)], pa.binary())})

    return segs.groupBy("map_id").applyInArrow(one, "map_id string, content binary")
