"""Writers of exports; every part is written by the executors, only counts reach the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON texts, the others as they are."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


def delimited(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with a header, in a fixed order of columns."""
    flat(df.select(*columns) if columns else df).write.mode("overwrite").csv(path, header=True, escape='"')


def graph_files(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge files for a bulk import into a graph database: node id, label; src, dst, type."""
    named = nodes.withColumnsRenamed({"id": ":ID", "label": ":LABEL"})
    delimited(named, f"{path}/nodes")
    delimited(edges.withColumnsRenamed({"src": ":START_ID", "dst": ":END_ID", "type": ":TYPE"}), f"{path}/edges")


def manifest(path: str, **parts: DataFrame) -> dict:
    """Rows of each part, written as one JSON line below ``path``; dangling edges are a warning."""
    counts = {name: df.count() for name, df in sorted(parts.items())}
    warnings = [f"{name} is empty" for name, n in counts.items() if not n]
    out = {"counts": counts, "total": sum(counts.values()), "warnings": warnings}
    spark = next(iter(parts.values())).sparkSession
    spark.createDataFrame([(json.dumps(out),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return out
