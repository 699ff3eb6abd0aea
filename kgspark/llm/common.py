"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

#: Text handed to one step of a Python task at a time, in bytes.
BLOCK_BYTES = 8 << 20
#: Edges of a graph that one task joins when no more are left.
TAIL = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where none is set, tests in one local process get a temporary one; on a
    cluster that is an error, since executors can't see the driver's folders.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if known is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return known or tempfile.mkdtemp(prefix="checkpoints-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder is that of ``shared_folder``.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def blocks(batch: pa.RecordBatch, column: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``column`` holds about ``limit`` bytes (one row at least)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def map_blocks(
    df: DataFrame,
    step: Callable[[pa.RecordBatch], dict[str, list] | None],
    schema: str | StructType,
    text: int = 1,
    limit: int = BLOCK_BYTES,
) -> DataFrame:
    """Run ``step`` on blocks of ``df``; it returns columns by name.

    ``text`` is the position of the column whose bytes bound a block.
    """
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, text, limit):
                columns = step(block)
                if columns is not None:
                    yield pa.RecordBatch.from_arrays(
                        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, columns[f.name]) for f in arrow)],
                        schema=arrow,
                    )

    return df.mapInArrow(run, schema)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; for many integers a sort is much faster than numpy's hashing ``unique``."""
    ordered = np.sort(values)
    return ordered[np.append(True, ordered[1:] != ordered[:-1])] if len(ordered) else ordered


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def extended(df: DataFrame, fields: str) -> StructType:
    """The columns of ``df`` and ``fields`` behind them."""
    return StructType([*df.schema.fields, *_parse_datatype_string(fields).fields])


def _arrow_schema(spark: SparkSession, schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)


def _crc_table() -> list[int]:
    """Checksums of single bytes, by which SQL computes CRC-32."""
    table_ = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table_.append(value)
    return table_


#: For SQL that has no CRC-32: a row with the array ``crc``.
SQL_CRC_TABLE = f"SELECT CAST({_crc_table()} AS BIGINT[]) AS crc"


def sql_crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII string, where the row of ``SQL_CRC_TABLE`` is joined."""
    bytes_ = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce({bytes_}, lambda c, b: xor(c >> 8, crc[CAST(xor(c, b) & 255 AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


class Forest:
    """Union-find over what one task sees; it only saves repeated links, so it may forget when full."""

    def __init__(self, room: int = 1 << 19):
        self.room, self.parent = room, {}

    def root(self, node: int) -> int:
        parent = self.parent
        while (above := parent.get(node, node)) != node:
            parent[node] = node = parent.get(above, above)
        return node

    def joins(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` weren't connected yet; now they are."""
        if len(self.parent) > self.room:
            self.parent.clear()
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 64) -> DataFrame:
    """Smallest node reachable from each node of an undirected edge list.

    Distributed union-find by contraction.  In a round each node that still has
    an edge points at that of it and its neighbours which comes first in the
    round's order (the first is by value, which suits stars, then they are
    mixed); edges move to what their ends point at, and those that become loops
    or equal go.  A settled node so never comes up again, no join makes more
    rows than there are edges left, and these shrink by a constant factor a
    round.  The last TAIL edges, a number that doesn't depend on the input, are
    joined in one task instead of many more rounds.  Then the pointers are
    followed back, last round first.  Returns (node, component) for each node
    that has an edge to another.  Edges with a null end and loops are ignored.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    # equal edges do no harm to the first round, and are few: a shuffle would not pay
    left = checkpointed(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    kind = left.schema["u"].dataType.simpleString()
    pointers: list[DataFrame] = []
    for turn in range(max_rounds):
        if left.count() <= TAIL:
            pointers.append(left.coalesce(1).mapInArrow(_joined, f"u {kind}, to {kind}"))
            break
        order, node = _mixed(turn, kind)
        both = left.union(left.select("v", "u").toDF("u", "v"))
        first = both.groupBy("u").agg(F.min(order("v")).alias("first"))
        to = first.select("u", node(F.least(order("u"), "first")).alias("to"))
        pointers.append(to)
        moved = left.join(to, "u").select(F.col("to").alias("p"), F.col("v").alias("u")).join(to, "u").select("p", F.col("to").alias("q"))
        moved = moved.where("p <> q").select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v"))
        left = checkpointed(moved.distinct())
    else:
        raise RuntimeError("components did not settle")
    root = pointers[-1].withColumnRenamed("to", "root")
    for to in reversed(pointers[:-1]):
        # what a node points at is settled, or has gone on to a root of its own
        later = root.select(F.col("u").alias("to"), "root")
        root = to.join(later, "to", "left").select("u", F.coalesce("root", "to").alias("root"))
    root = checkpointed(root)
    least = root.groupBy("root").agg(F.min("u").alias("component"))
    return root.join(least, "root").select(F.col("u").alias("node"), "component")


def _mixed(turn: int, kind: str) -> tuple[Callable[[str], Column], Callable[[Column], Column]]:
    """An order of nodes for a round, and the node that stands at a place in it."""
    if kind in ("bigint", "int"):
        salt = 0 if turn == 0 else int(np.random.default_rng(turn).integers(1, 1 << (62 if kind == "bigint" else 30)))
        salted = F.lit(salt).cast(kind)
        return (lambda c: F.col(c).bitwiseXOR(salted)), (lambda o: o.bitwiseXOR(salted))
    return (lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)), F.col(c).alias("node"))), (lambda o: o["node"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, smallest of its component) of at most TAIL edges."""
    forest, nodes, kind = Forest(3 * TAIL), {}, None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.joins(a, b)
            nodes[a] = nodes[b] = None
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(list(nodes), kind), pa.array([forest.root(n) for n in nodes], kind)], ["u", "to"])
