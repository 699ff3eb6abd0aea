"""Near-duplicate vectors by an exact metric range join.

Unit vectors and their angles form a metric space.  Pivots partition it: each
vector is at home at its nearest pivot.  By the triangle inequality a vector
can only have partners in a cell if its angle to the pivot is at most the
cell's radius plus the range, at most two ranges more than the angle to its own
pivot, and if it lies within the range of the half-space nearer to that pivot.
It visits each such cell; then the cells join independently, each member at
home with all members and visitors, by blocks of exact dot products.

Equal vectors are one row with a weight.  Small cells travel in company: a tile
is some cells of about TILE members together, or a piece of a larger cell, so a
vector goes once to a tile however many of its cells it visits, and no task
holds more than a tile and a block of its visitors.  Inside a tile each cell is
joined with its own visitors.  Cells hand on counts and a spanning forest of
links, never pairs.  Where vectors have no structure, every tile is visited by
all, and the rows sent are the square of the vectors divided by TILE.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _arrow_schema, checkpointed, connected_components, table

COSINE = 0.9
#: Vectors for each pivot, pivots at most (they are sent to all tasks), and members of a tile.
PIECE, PIVOTS, TILE = 1024, 512, 16384
#: Room for rounding where angles bound a search.
SLACK = 1e-6


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, key binary, unit binary) of each row; null key and unit: links with nothing.

    ``unit`` is the vector divided by its length in double precision, ``key`` a
    digest of the components.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, key binary, unit binary"
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes | None] = []
            units: list[bytes | None] = []
            for value in batch.column(1):
                unit = None
                if value.is_valid and len(value) and value.values.null_count == 0:
                    x = value.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                    top = np.abs(x).max()
                    if np.isfinite(top) and top > 0:
                        scaled = x / top
                        unit = (scaled / np.sqrt((scaled * scaled).sum())).tobytes()
                keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if unit is not None else None)
                units.append(unit)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], schema=arrow)

    return df.select(id_col, F.col(vector_col).cast("array<double>")).mapInArrow(run, schema)


def _matrix(column: pa.Array | pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist() if isinstance(column, pa.Array) else column), np.float64).reshape(-1, dim)


def choose_pivots(units: DataFrame, count: int, angle: float) -> np.ndarray:
    """Up to ``count`` of a bounded sample of vectors, no two within ``angle``.

    The sample, 4 * PIVOTS vectors at most, is that with the smallest hashes.
    """
    rows = units.orderBy(F.xxhash64("key"), "key").limit(4 * PIVOTS).select("unit").collect()
    chosen: list[np.ndarray] = []
    for row in rows:
        x = np.frombuffer(row["unit"], np.float64)
        if len(chosen) < count and all(abs(float(x @ p)) < 1 and math.acos(max(-1.0, min(1.0, float(x @ p)))) > angle for p in chosen if len(p) == len(x)):
            chosen.append(x)
    return np.array(chosen)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept) of each row.

    Vectors link where their cosine, in double precision, is at least
    ``cosine``; n_links counts other rows linked directly, equal ones too.
    Null or zero vectors and those with null or non-finite components link
    with nothing and are their own component; so are rows with a null id,
    whose component is null and which aren't kept.  Vectors link only with
    vectors of as many components.
    """
    rows = checkpointed(vectors(df, id_col, vector_col))
    valid = rows.where("key is not null and id is not null")
    distinct = checkpointed(valid.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("unit").alias("unit")).withColumn("dim", (F.octet_length("unit") / 8).cast("int")))
    found = None
    for dim in sorted(r["dim"] for r in distinct.select("dim").distinct().collect()):
        one = _range_join(distinct.where(F.col("dim") == dim), dim, cosine)
        found = one if found is None else found.union(one)
    if found is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    found = checkpointed(found)
    forest = connected_components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = distinct.select("key", "rep", "weight").join(counted, "rep", "left").join(forest.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = rows.withColumn("key", F.when(F.col("id").isNotNull(), F.col("key"))).join(classes, "key", "left")
    component = F.coalesce("c", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")
    )


def _range_join(distinct: DataFrame, dim: int, cosine: float) -> DataFrame:
    """(rep, links, other): links to other vectors, by weight, and edges of a spanning forest."""
    theta = math.acos(cosine)
    total = distinct.count()
    pivots = choose_pivots(distinct, max(1, min(PIVOTS, total // PIECE)), theta)
    spread = np.linalg.norm(pivots[:, None] - pivots[None], axis=2)

    def angles(unit: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(unit @ pivots.T, -1, 1))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angle = angles(_matrix(batch.column(0), dim))
                home = angle.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(angle[np.arange(len(home)), home])], ["home", "angle"])

    stats = distinct.select("unit").mapInArrow(settle, "home int, angle double").groupBy("home").agg(F.max("angle").alias("r"), F.count(F.lit(1)).alias("n")).collect()
    radius, members = np.full(len(pivots), -1.0), np.zeros(len(pivots), np.int64)
    for s in stats:
        radius[s["home"]], members[s["home"]] = s["r"], s["n"]
    first_tile, pieces = _tiles(pivots, members)

    def visits(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each vector has to go to each cell, and its home."""
        dot = unit @ pivots.T
        angle = np.arccos(np.clip(dot, -1, 1))
        every = np.arange(len(unit))
        home = angle.argmin(axis=1)
        own = angle[every, home]
        near = (angle <= radius[None] + theta + SLACK) & (angle <= own[:, None] + 2 * theta + SLACK)
        near &= dot[every, home][:, None] - dot <= math.sin(theta) * spread[home] + SLACK
        near &= radius[None] >= 0
        near[every, home] = True
        return near, home

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near, home = visits(_matrix(batch.column(2), dim))
            who, cell = np.nonzero(near)
            fan = pieces[cell]
            who, tile = np.repeat(who, fan), np.repeat(first_tile[cell], fan)
            tile += np.arange(len(who)) - np.repeat(np.cumsum(fan) - fan, fan)
            who, tile = np.divmod(np.unique(who * (int(tile.max()) + 1) + tile), int(tile.max()) + 1)
            at = np.array([int.from_bytes(k[:7], "big") for k in batch.column(0).to_pylist()], np.int64) % pieces[home] + first_tile[home]
            columns = [pa.array(tile), pa.array(at[who] == tile)] + [batch.column(k).take(pa.array(who)) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays(columns, ["tile", "home", "rep", "unit", "weight"])

    kind = distinct.schema["rep"].dataType.simpleString()
    dealt = distinct.select("key", "rep", "unit", "weight").mapInArrow(deal, f"tile long, home boolean, rep {kind}, unit binary, weight long")
    # visitors of a tile come in blocks of bounded size, each with the tile's own members
    blocks = max(1, -(-total // TILE))
    block = F.when(F.col("home"), F.sequence(F.lit(-1), F.lit(blocks - 1))).otherwise(F.array(F.lit(-1)))
    marked = dealt.withColumn("block", F.explode(block)).withColumn("home", F.col("block") >= 0)
    marked = marked.withColumn("block", F.when(F.col("home"), F.col("block")).otherwise(F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")))

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        base, other = rows[rows["home"]], rows[~rows["home"]]
        if not len(base) or not len(other):
            return _found(base["rep"].to_numpy()[:0], [], [], [])
        homes, near = visits(_matrix(base["unit"], dim))[1], visits(_matrix(other["unit"], dim))[0]
        return pd.concat([_piece(base[homes == c], other[near[:, c]], dim, cosine) for c in np.unique(homes).tolist()], ignore_index=True)

    return marked.groupBy("tile", "block").applyInPandas(join, f"rep {kind}, links long, other {kind}")


def _tiles(pivots: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first tile of each cell, and how many it has; cells of neighbouring pivots share one."""
    first, pieces = np.zeros(len(members), np.int64), np.maximum(1, -(-members // TILE))
    left, tile, room = list(range(len(members))), 0, TILE
    at = 0
    while left:
        # the cell whose pivot is nearest to the last one's
        at = left.pop(int((pivots[left] @ pivots[at]).argmax()))
        if members[at] > room or pieces[at] > 1:
            tile, room = tile + (room < TILE), TILE
        first[at] = tile
        room -= int(members[at])
        if pieces[at] > 1:
            tile, room = tile + int(pieces[at]), TILE
    return first, pieces


def _found(like: np.ndarray, rep: list, links: list, other: list) -> pd.DataFrame:
    """Rows (rep, links, other) with ids of the kind of ``like``; numbers stay whole beside nulls."""
    kind = "Int64" if like.dtype.kind in "iu" else object
    return pd.DataFrame({"rep": pd.array(rep, kind), "links": np.array(links, np.int64), "other": pd.array(other, kind)})


def _piece(base: pd.DataFrame, other: pd.DataFrame, dim: int, cosine: float, rows: int = 512) -> pd.DataFrame:
    """Counts of links of ``base`` with ``other``, and edges of a forest of them."""
    a, b = _matrix(base["unit"], dim), _matrix(other["unit"], dim)
    ids, others, weight = base["rep"].to_numpy(), other["rep"].to_numpy(), other["weight"].to_numpy()
    links = np.zeros(len(a), np.int64)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(0, len(a), rows):
        near = a[k : k + rows] @ b.T >= cosine
        near &= ids[k : k + rows, None] != others[None]
        some = np.flatnonzero(near.any(axis=1))
        if not len(some):
            continue
        near = near[some]
        links[k + some] = near @ weight
        cols = np.flatnonzero(near.any(axis=0))
        kept.append((k + some, cols, near[:, cols]))
    left, right = np.arange(len(a)), len(a) + np.arange(len(b))
    label = np.concatenate([left, right])
    # labels sink to the smallest of each component
    while True:
        before = label.copy()
        for some, cols, near in kept:
            low = np.where(near, label[right[cols]][None], len(label)).min(axis=1)
            label[some] = np.minimum(label[some], low)
            low = np.where(near, label[some][:, None], len(label)).min(axis=0)
            label[right[cols]] = np.minimum(label[right[cols]], low)
        if (label == before).all():
            break
    names = np.concatenate([ids, others])
    moved = np.flatnonzero(label != np.arange(len(label)))
    edges = [(x, y) for x, y in zip(names[moved].tolist(), names[label[moved]].tolist()) if x != y]
    linked = np.flatnonzero(links)
    rep = ids[linked].tolist() + [x for x, _ in edges]
    return _found(ids, rep, links[linked].tolist() + [0] * len(edges), [None] * len(linked) + [y for _, y in edges])


def op10_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
