"""Experiment results: rows of nested parameters and results, as VARIANT or JSON text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get(document: Column, path: str, kind: str = "string") -> Column:
    """The value under a dotted path, null where there is none or where the way leads through a scalar."""
    return F.try_variant_get(document, "$." + path, kind)


def select(rows: DataFrame, params: dict | None = None, results: dict | None = None) -> DataFrame:
    """Rows whose values under all the paths are equal; None asks for unset or null."""
    for column, wanted in (("params", params or {}), ("result", results or {})):
        for path, value in wanted.items():
            if value is None:
                rows = rows.where(get(F.col(column), path).isNull())
            else:
                kind = {bool: "boolean", int: "bigint", float: "double"}.get(type(value), "string")
                rows = rows.where(get(F.col(column), path, kind).eqNullSafe(F.lit(value)))
    return rows


def project(document: Column, paths: list[str]) -> Column:
    """JSON text with only the dotted paths, objects on the way made; everything if there are none."""
    if not paths:
        return F.to_json(document)
    tree: dict = {}
    for path in paths:
        *way, leaf = path.split(".")
        node = tree
        for step in way:
            node = node.setdefault(step, {})
        node[leaf] = get(document, path)

    def made(node) -> Column:
        return F.struct(*[(made(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()])

    return F.to_json(made(tree), {"ignoreNullFields": "false"})


def read(spark: SparkSession, path: str) -> DataFrame:
    """(params, result, meta) VARIANTs of JSON lines."""
    rows = spark.read.text(path)
    doc = rows.select(F.parse_json("value").alias("d"))
    return doc.select(*[F.try_variant_get("d", f"$.{c}", "variant").alias(c) for c in ("params", "result", "meta")])


def append(spark: SparkSession, path: str, params: dict, result: dict, meta: dict | None = None) -> None:
    """One more result; rows are only ever added."""
    line = json.dumps({"params": params, "result": result, "meta": meta or {}})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(path)


def merged_metadata(rows: DataFrame) -> DataFrame:
    """One row: all metadata keys (text values), later ones replacing earlier; needs `seq` to tell which is later."""
    pairs = rows.select("seq", F.explode(F.from_json(F.to_json("meta"), "map<string,string>")).alias("key", "value"))
    last = pairs.groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    return last.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("meta"))
