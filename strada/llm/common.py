"""Input, scratch tables and bounded broadcasts shared by the operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Class of the white space that separates words, for Java and Python patterns.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _context_dir(spark)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strada-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _context_dir(spark: SparkSession) -> str | None:
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get() if found.isDefined() else None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    bounded(spark)
    path = f"{shared_dir(spark)}/strada-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


#: Bytes of one Arrow batch: the JVM and a worker each hold it, and texts are taken in blocks of about half a MB anyway.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Bound the bytes of the session's Arrow batches, where it sets no bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: this cuts the
    lineage, and a lost executor costs no recomputation of what came before."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove scratch tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Have the executors' JVMs collect their garbage, in a task a core: a heap grown by one stage shrinks only at a full collection, and Python needs the room."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def local_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """The driver's rows as a DataFrame, through Arrow: rows given as Python objects would start a second daemon with workers on each executor."""
    fields = to_arrow_schema(T.StructType.fromDDL(ddl))
    columns = [[list(v.items()) if isinstance(v, dict) else v for v in c] for c in zip(*rows)] or [[]] * len(fields)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields), ddl)


#: Rows up to which a table of a few narrow columns is broadcast; a longer one is joined by a shuffle.
SMALL = 200_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if its counted rows allow it."""
    return F.broadcast(df) if rows <= SMALL else df


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def whole(docs: DataFrame) -> Column:
    """All columns as one struct, whatever their names are; `parts` takes it apart."""
    return F.struct(*[docs[f"`{n}`"].alias(f"c{i}") for i, n in enumerate(docs.columns)])


def parts(names: list[str], row: str = "row") -> list[Column]:
    return [F.col(row)[f"c{i}"].alias(n) for i, n in enumerate(names)]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def numbered(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, bool]:
    """(key, text, row), and whether row is the key: row is unique and in the order of the key.

    It is the key itself where that is an integer, unique and never null; else a sort by
    (key, text) numbers the rows, so that repeated rows stay apart.
    """
    rows = docs.select(docs[key].alias(key), text_or_empty().alias("text"))
    if docs.schema[key].dataType.typeName() in ("long", "integer"):
        counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(key).isNull().cast("long")).alias("nulls")).first()
        again = rows.groupBy(key).count().where("count > 1").limit(1).count()
        if not counts["nulls"] and not again:
            return rows.withColumn("row", F.col(key).cast("long")), True
    ordered = rows.repartitionByRange(key, "text").sortWithinPartitions(key, "text")
    return scratch(ordered.withColumn("row", F.monotonically_increasing_id()), "rows"), False


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def release() -> None:
    """Give memory that was freed back to the system: an executor's workers share its limit with the JVM."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def blocks(batches, text: str = "text", size: int = 1 << 19):
    """Slices of Arrow batches with about `size` bytes of text each; a longer text stands alone."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        offsets = text_offsets(batch.column(batch.schema.get_field_index(text)))[1]
        release()
        at = 0
        while at < n:
            to = at + 1
            while to < n and offsets[to + 1] - offsets[at] <= size:
                to += 1
            yield batch.slice(at, to - at)
            at = to
    release()


def text_offsets(column):
    """(bytes, offsets) of an Arrow string column, without copies; null counts as empty."""
    import numpy as np
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
