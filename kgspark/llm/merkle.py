"""Merkle manifest of a dataset: leaves, subtrees by superblock, proofs and their folding.

Rows become leaves; the leaves of a group (a source) are, in order of their
key, the lowest level of a tree of FANOUT; the groups' roots, in order, are the
lowest level of a tree above.  A superblock is what SPAN levels turn into one
node: WIDTH neighbours of a level, never more, so no task holds a whole group.
Up the tree a superblock is reduced by itself; down the tree its nodes are
cogrouped with what it needs from outside, the siblings on the way from its
own node to the root, and local reduction, proof and folding end there.

Nulls count as ``-``, the null group comes first, null keys come first in
their group; equal keys stand by leaf, equal rows are leaves of their own.
An empty table gives an empty manifest.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import SQL_CRC_TABLE, checkpointed, sql_crc32, table

FANOUT = 16
#: Levels that a superblock is reduced by, and its nodes at most.
SPAN = 2
WIDTH = FANOUT**SPAN

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: What a node has from outside its superblock: siblings, nearest level first.
OUTER = "tree long, idx long, left array<string>, right array<string>, subroot string, root string"
PROVEN = "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, left array<string>, right array<string>"


def digest(parts: str) -> str:
    return sha256(parts.encode()).hexdigest()


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The leaf's digest as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]), 256))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, which of its groups a row is in, and its place there."""
    part, nth, place, last, any_yet = TaskContext.get().partitionId(), -1, 0, None, False
    for batch in batches:
        nths, places = [], []
        for unit in batch.column("unit").to_pylist():
            if not any_yet or unit != last:
                nth, place, last, any_yet = nth + 1, 0, unit, True
            nths.append(nth)
            places.append(place)
            place += 1
        new = [pa.array([part] * batch.num_rows, pa.int64()), pa.array(nths, pa.int64()), pa.array(places, pa.int64())]
        names = [*batch.schema.names, "part", "nth", "place"]
        yield pa.RecordBatch.from_arrays([*batch.columns, *new], names)


def _indexed(leaves: DataFrame) -> tuple[DataFrame, int, int]:
    """``leaves`` with tree (number of the group) and idx (place in it), the number of groups and a bound on their size.

    Rows are dealt by ranges of all their columns, so neither a large group nor
    many equal rows meet in one task.  What the driver gets is one row for each
    partition: its first and last group may go on in the next.
    """
    order = [F.col(c).asc_nulls_first() for c in ("unit", "key", "leaf", "salt")]
    ranged = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    longs = [StructField(c, LongType()) for c in ("part", "nth", "place")]
    dealt = checkpointed(ranged.mapInArrow(_number, StructType([*ranged.schema.fields, *longs])))
    parts = dealt.groupBy("part").agg(
        (F.max("nth") + 1).alias("units"),
        F.min_by(F.struct("unit"), "nth").alias("first"),
        F.max_by(F.struct("unit"), "nth").alias("last"),
        (F.max_by("place", F.struct("nth", "place")) + 1).alias("ending"),
        (F.max("place") + 1).alias("longest"),
    )
    starts, trees, held, last, most = [], 0, 0, None, 0
    for p in sorted(parts.collect(), key=lambda r: r["part"]):
        goes_on = trees > 0 and p["first"]["unit"] == last
        before = held if goes_on else 0
        base = trees - 1 if goes_on else trees
        starts.append((p["part"], base, before))
        held = p["ending"] + (before if p["units"] == 1 else 0)
        trees, last, most = base + p["units"], p["last"]["unit"], max(most, before + p["longest"])
    known = dealt.sparkSession.createDataFrame(starts, "part long, base long, before long")
    # one row for each partition of a shuffle: bounded whatever the table holds
    placed = dealt.join(F.broadcast(known), "part")
    idx = F.col("place") + F.when(F.col("nth") == 0, F.col("before")).otherwise(0)
    return placed.withColumn("tree", F.col("base") + F.col("nth")).withColumn("idx", idx), trees, most


def levels(nodes: list[str], whole: bool) -> list[list[str]]:
    """``nodes`` and the levels above: up to one node if they are a whole tree, else SPAN of them."""
    out = [nodes]
    while len(out[-1]) > 1 if whole else len(out) <= SPAN:
        below = out[-1]
        out.append([digest("".join(below[k : k + FANOUT])) for k in range(0, len(below), FANOUT)])
    return out


def _is_whole(nodes: pd.DataFrame) -> bool:
    """A tree's first superblock that isn't full has no other beside it."""
    return len(nodes) < WIDTH and int(nodes["idx"].iloc[0]) < WIDTH


def _reduced(nodes: pd.DataFrame) -> pd.DataFrame:
    nodes = nodes.sort_values("idx")
    top = levels([bytes(d).hex() for d in nodes["digest"]], _is_whole(nodes))[-1][0]
    return pd.DataFrame({"tree": [nodes["tree"].iloc[0]], "idx": [nodes["idx"].iloc[0] // WIDTH], "digest": [bytes.fromhex(top)]})


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("idx") / WIDTH))


def _ascend(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Nodes (tree, idx, digest) of every SPAN-th level; the last has one node for each tree, of at most ``most`` leaves."""
    out = [nodes]
    while most > 1:
        raised = _blocked(out[-1]).groupBy("tree", "block").applyInPandas(_reduced, "tree long, idx long, digest binary")
        out.append(checkpointed(raised))
        most = -(-most // WIDTH)
    return out


def paths(nodes: list[str], whole: bool) -> Iterator[tuple[list[str], list[str]]]:
    """For each node the siblings to the left and to the right of its way up, level by level, joined."""
    tree = levels(nodes, whole)[:-1]
    for at in range(len(nodes)):
        left, right = [], []
        for level in tree:
            run = at - at % FANOUT
            left.append("".join(level[run:at]))
            right.append("".join(level[at + 1 : run + FANOUT]))
            at //= FANOUT
        yield left, right


def _exchanged(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """What each node of a superblock has from outside of itself, from its neighbours and what the superblock has."""
    nodes = nodes.sort_values("idx")
    above = outer.iloc[0]
    lefts, rights = list(above["left"]), list(above["right"])
    digests = [bytes(d).hex() for d in nodes["digest"]]
    own = list(paths(digests, _is_whole(nodes)))
    return pd.DataFrame(
        {
            "tree": nodes["tree"],
            "idx": nodes["idx"],
            "left": [left + lefts for left, _ in own],
            "right": [right + rights for _, right in own],
            "subroot": above["subroot"],
            "root": above["root"],
        }
    )


def _descend(steps: list[DataFrame], outer: DataFrame) -> DataFrame:
    """``outer`` of the last of ``steps`` brought down to the first."""
    for nodes in reversed(steps[:-1]):
        outer = _blocked(nodes).groupBy("tree", "block").cogroup(outer.groupBy("tree", "idx")).applyInPandas(_exchanged, OUTER)
    return outer


def fold(node: str, left: list[str], right: list[str]) -> str:
    """The root that a leaf's digest and its proof lead to."""
    for before, behind in zip(left, right):
        node = digest(before + node + behind)
    return node


def _proven(proofs: bool):
    def prove(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("idx")
        above = outer.iloc[0]
        lefts, rights = list(above["left"]), list(above["right"])
        outside = "".join(a + b for a, b in zip(lefts, rights))
        digests = [bytes(d).hex() for d in leaves["leaf"]]
        altered = [bytes(d).hex() if d is not None else own for d, own in zip(leaves["altered"], digests)]
        sums, folded, left, right = [], [], [], []
        for node, (before, behind) in zip(altered, paths(digests, _is_whole(leaves))):
            sums.append(digest("".join(a + b for a, b in zip(before, behind)) + outside))
            before, behind = before + lefts, behind + rights
            folded.append(fold(node, before, behind))
            left.append(before if proofs else None)
            right.append(behind if proofs else None)
        root = above["root"]
        return pd.DataFrame(
            {
                "key": leaves["key"],
                "leaf": digests,
                "subroot": above["subroot"],
                "root": root,
                "proof_sha256": sums,
                "folded_root": folded,
                "verified": [f == root for f in folded],
                "left": left,
                "right": right,
            }
        )

    return prove


def manifest(rows: DataFrame, key: str, group: str, leaf_of: Column, altered: Column | None = None, proofs: bool = False) -> DataFrame:
    """One row for each of ``rows``: its key, leaf, the root of its group and of all, and its proof.

    ``leaf_of`` is its digest (32 bytes); ``altered`` one that is folded in its
    place where it isn't null, as a verifier would find it later.  The proof's
    siblings are ``left`` and ``right`` of each level, with ``proofs``, and
    ``proof_sha256`` their digest.  Other columns of ``rows`` are not looked at.
    Null keys and groups and repeated rows are leaves like all others.
    """
    other = altered if altered is not None else F.lit(None).cast("binary")
    kind = rows.schema[key].dataType
    leaves = rows.select(F.col(group).alias("unit"), F.col(key).alias("key"), leaf_of.alias("leaf"), other.alias("altered"), F.monotonically_increasing_id().alias("salt"))
    placed, trees, most = _indexed(checkpointed(leaves))
    columns = [c for c in PROVEN.split(", ") if proofs or c.split()[0] not in ("left", "right")]
    if trees == 0:
        out = rows.sparkSession.createDataFrame([], PROVEN)
    else:
        up = _ascend(placed.select("tree", "idx", F.col("leaf").alias("digest")), most)
        subroots = up[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest")
        top = _ascend(subroots, trees)
        nothing = F.array().cast("array<string>")
        root = top[-1].select("tree", "idx", nothing.alias("left"), nothing.alias("right"), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
        outer = _descend(top, root).drop("tree", "subroot").withColumnRenamed("idx", "tree")
        below = up[-1].select("tree", F.lower(F.hex("digest")).alias("subroot"))
        outer = _descend(up[1:] or up, outer.join(below, "tree").select("tree", F.lit(0).cast("long").alias("idx"), "left", "right", "subroot", "root"))
        named = _blocked(placed.select("tree", "idx", F.col("key").cast("string").alias("key"), "leaf", "altered"))
        # where every group is one leaf, a leaf is its own superblock
        out = named.groupBy("tree", "block").cogroup(outer.groupBy("tree", "idx")).applyInPandas(_proven(proofs), PROVEN)
    names = [c.split()[0] for c in columns]
    return out.select(F.col("key").cast(kind).alias(key), *names[1:])


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of documents, roots, digests of proofs, and what verification says where text was lower-cased.

    Null ids are never tampered with; null texts stay null.
    """
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    plain = [F.col(c) for c in FIELDS]
    lowered = [F.translate("text", UPPER, UPPER.lower()) if c == "text" else F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(docs, "doc_id", "source", leaf(*plain), F.when(hit, leaf(*lowered)))


def oracle_sql(levels_: int = 6) -> str:
    """The query in SQL, level by level, for groups of at most FANOUT ** ``levels_`` leaves, and as many groups."""
    encode = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    plain = " || ".join(encode(c) for c in FIELDS)
    lowered = " || ".join(encode(f"translate(text, '{UPPER}', '{UPPER.lower()}')" if c == "text" else c) for c in FIELDS)
    crc = sql_crc32("CAST(doc_id AS VARCHAR)")
    parts = [
        f"t AS ({SQL_CRC_TABLE})",
        f"leaf AS (SELECT doc_id, source, sha256({plain}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({lowered}) ELSE sha256({plain}) END AS now FROM documents, t)",
        "d AS (SELECT *, coalesce('s' || source, 'n') AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaf)",
        "a0 AS (SELECT grp, i, leaf AS h, count(*) OVER (PARTITION BY grp) AS n FROM d)",
    ]

    def climb(name: str) -> None:
        for k in range(levels_):
            frame = f"string_agg(h, '') OVER (PARTITION BY grp, i // {FANOUT} ORDER BY i ROWS BETWEEN "
            parts.append(
                f"{name}{k}s AS (SELECT grp, i, n, coalesce({frame}UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce({frame}1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WHERE n > 1)"
            )
            parts.append(
                f"{name}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM (SELECT grp, i // {FANOUT} AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}{k} WHERE n > 1 GROUP BY ALL UNION ALL SELECT grp, i, h FROM {name}{k} WHERE n = 1))"
            )

    def ways(name: str, frm: str, grp: str, i: str) -> tuple[str, str, list[str]]:
        joins = " ".join(f"LEFT JOIN {name}{k}s {name}x{k} ON {name}x{k}.grp = {grp} AND {name}x{k}.i = {i} // {FANOUT**k}" for k in range(levels_))
        return frm, joins, [f"{name}x{k}" for k in range(levels_)]

    climb("a")
    parts.append(f"b0 AS (SELECT 0 AS grp, row_number() OVER (ORDER BY grp <> 'n', grp) - 1 AS i, h, count(*) OVER () AS n, grp AS source_grp FROM a{levels_})")
    climb("b")
    _, low, own = ways("a", "d", "d.grp", "d.i")
    _, high, above = ways("b", "b0", "0", "b0.i")
    proof, folded, steps = [], "now", []
    for k, x in enumerate([*own, *above]):
        proof.append(f"coalesce({x}.l || {x}.r, '')")
        steps.append(f"f{k} AS (SELECT * EXCLUDE now, CASE WHEN l{k} IS NULL THEN now ELSE sha256(l{k} || now || r{k}) END AS now FROM f{k - 1})")
    sides = ", ".join(f"{x}.l AS l{k}, {x}.r AS r{k}" for k, x in enumerate([*own, *above]))
    parts.append(f"path AS (SELECT doc_id, leaf, b0.h AS subroot, b{levels_}.h AS root, sha256({' || '.join(proof)}) AS proof_sha256, {folded}, {sides} FROM d {low} JOIN b0 ON b0.source_grp = d.grp {high} JOIN b{levels_} ON true)")
    steps[0] = steps[0].replace("FROM f-1", "FROM path")
    parts += steps
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, proof_sha256, now AS folded_root, now = root AS verified FROM f{2 * levels_ - 1}"
