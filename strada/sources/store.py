"""Named items in a warehouse folder: a table and its metadata under a dotted name.

`a.b.c` is the folder `<root>/a/b/c`, with `data` (Parquet, optionally partitioned by map) and `meta`
(one JSON line). Paths are Hadoop paths, so the root may be in any store that Spark reads.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class MissingItem(KeyError):
    pass


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        if not re.fullmatch(r"[\w-]+(\.[\w-]+)*", name):
            raise ValueError(f"not a dotted name: {name!r}")
        return f"{self.root.rstrip('/')}/{name.replace('.', '/')}"

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def has_data(self, name: str) -> bool:
        return self._exists(f"{self.path(name)}/data")

    def has_meta(self, name: str) -> bool:
        return self._exists(f"{self.path(name)}/meta")

    def exists(self, name: str) -> bool:
        return self.has_data(name) or self.has_meta(name)

    def put(self, name: str, data: DataFrame | None = None, meta: dict | None = None, by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
        """Replace (or with mode="append" add to) what is given, and leave the rest."""
        if data is not None:
            writer = data.write.mode(mode)
            (writer.partitionBy(*by) if by else writer).parquet(f"{self.path(name)}/data")
        if meta is not None:
            self.spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path(name)}/meta")

    def data(self, name: str, map_id: str | None = None) -> DataFrame:
        """The table; of one map only if asked, which prunes partitions."""
        if not self.has_data(name):
            raise MissingItem(name)
        rows = self.spark.read.parquet(f"{self.path(name)}/data")
        return rows if map_id is None else rows.where(F.col("map_id") == map_id)

    def meta(self, name: str) -> dict:
        if not self.has_meta(name):
            raise MissingItem(name)
        return json.loads(self.spark.read.text(f"{self.path(name)}/meta").first()["value"])


def add_references(store: Store, name: str, descriptors: DataFrame) -> None:
    """More maps for a catalogue of reference descriptors."""
    store.put(name, descriptors, by=("map_id",), mode="append")
