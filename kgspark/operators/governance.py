"""What may be promoted, what is to be reviewed, what a merge of terms would touch, members folded onto one target."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .graph import written

# --- fixed values: states and reasons ---
APPROVED, REVIEWED, BLOCKED, PROMOTED, FINAL = "human_approved", "approved", "blocked", "promoted", "promoted_to_final"
SEVERITIES = ("blocker", "error", "warning", "info")
SCOPE = ("resource", "atlas", "level", "type", "direction")


def validation_summary(results: DataFrame, most: int = 200) -> DataFrame:
    """(target_type, id, results, blockers, errors, warnings, infos) of each target's ``most`` newest results.

    ``results``: target_type, id, severity, created_at, result_id.  What is no
    blocker, error or warning counts as info, null as well.
    """
    rank = F.row_number().over(W.partitionBy("target_type", "id").orderBy(F.col("created_at").desc_nulls_last(), F.col("result_id").desc()))
    recent = results.withColumn("_k", rank).where(F.col("_k") <= most)
    n = lambda severity: F.count_if(F.col("severity") == severity)
    counted = recent.groupBy("target_type", "id").agg(F.count(F.lit(1)).alias("results"), n("blocker").alias("blockers"), n("error").alias("errors"), n("warning").alias("warnings"))
    return counted.withColumn("infos", F.col("results") - F.col("blockers") - F.col("errors") - F.col("warnings"))


def endpoint_key(src: Column, dst: Column, direction: Column) -> Column:
    """Both ends, in order where the connection is undirected; null ends count as empty."""
    a, b = (F.coalesce(c.cast("string"), F.lit("")) for c in (src, dst))
    turned = (direction == "undirected") & (b < a)
    return F.concat_ws(">", F.when(turned, b).otherwise(a), F.when(turned, a).otherwise(b))


def promotion_eligibility(rows: DataFrame, approvals: DataFrame, summaries: DataFrame, never: DataFrame, final: DataFrame) -> DataFrame:
    """(id, eligible, reason): whether a connection may be promoted, with the first reason against it.

    ``rows``: id, mirror_status, review_status, promotion_status, resource,
    atlas, level, type, direction, src, dst; ``approvals``: id; ``summaries``
    as from ``validation_summary`` (id, blockers, errors); ``never``: id;
    ``final``: active connections with the same scope and ends.  All looks into
    other tables are semi-joins on keys; scopes match null-safely.
    """
    mark = lambda df, key, name: df.select(*key).distinct().withColumn(name, F.lit(True))
    key = endpoint_key(F.col("src"), F.col("dst"), F.col("direction"))
    # nulls are equal in a scope: they are spelled out for the join
    scoped = lambda df: df.select(*df.columns, F.to_json(F.struct(*SCOPE, key.alias("ends"))).alias("_scope"))
    on = scoped(rows).join(mark(approvals, ["id"], "_approved"), "id", "left").join(mark(summaries.where("blockers > 0 or errors > 0"), ["id"], "_bad"), "id", "left")
    on = on.join(mark(never, ["id"], "_never"), "id", "left").join(mark(scoped(final), ["_scope"], "_there"), "_scope", "left")
    is_ = lambda column, value: F.coalesce(F.col(column) == value, F.lit(False))
    empty = lambda column: F.coalesce(F.col(column), F.lit("")) == ""
    reason = (
        F.when(~is_("mirror_status", APPROVED), "NOT_HUMAN_APPROVED")
        .when(~is_("review_status", REVIEWED), "REVIEW_STATUS_NOT_APPROVED")
        .when(is_("promotion_status", BLOCKED), "PROMOTION_BLOCKED")
        .when(is_("promotion_status", PROMOTED) | is_("mirror_status", FINAL), "ALREADY_PROMOTED")
        .when(F.col("_approved").isNull(), "NO_APPROVE_REVIEW_RECORD")
        .when(F.col("_bad").isNotNull(), "HAS_VALIDATION_BLOCKER")
        .when(empty("atlas"), "MISSING_SOURCE_ATLAS")
        .when(empty("level"), "MISSING_GRANULARITY")
        .when(F.col("_never").isNotNull(), "GOVERNANCE_SKIP_NEVER_PROMOTE")
        .when(F.col("_there").isNotNull(), "DUPLICATE_FINAL_EXISTS")
    )
    return on.withColumn("reason", reason).select("id", F.col("reason").isNull().alias("eligible"), "reason")


def _newest(items: DataFrame, most: int) -> DataFrame:
    """Of each partition's items (target_type, id, state, updated_at) the first ``most`` of each type, those held and a batch at a time."""
    arrow = to_arrow_schema(items.schema)

    def first(rows: pa.Table) -> pa.Table:
        # null ids come before others, null times behind them
        keyed = pa.table({"t": rows.column("target_type"), "u": rows.column("updated_at"), "n": pc.cast(pc.is_null(rows.column("id")), pa.int8()), "i": rows.column("id")})
        rows = rows.take(pc.sort_indices(keyed, [("t", "ascending"), ("u", "descending"), ("n", "descending"), ("i", "ascending")]))
        codes = pc.fill_null(pc.cast(rows.column("target_type").combine_chunks().dictionary_encode().indices, pa.int64()), -1).to_numpy()
        begins = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        at = np.arange(len(codes)) - np.repeat(begins, np.diff(np.append(begins, len(codes))))
        return rows.filter(pa.array(at < most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = arrow.empty_table()
        for batch in batches:
            if batch.num_rows:
                held = first(pa.concat_tables([held, pa.Table.from_batches([batch]).cast(arrow)]).combine_chunks())
        yield from held.to_batches()

    return items.mapInArrow(run, items.schema)


def review_queue(items: DataFrame, results: DataFrame, evidence: DataFrame, most: int = 2000) -> DataFrame:
    """The ``most`` newest items (target_type, id, state, updated_at) of each type with their newest validation and their evidence.

    ``evidence``: target_type, id.  Adds results, blockers, errors, warnings,
    infos (0 where not validated), validated, evidence and place.  Items are
    cut in each partition before they are ranked, batch by batch, so that no
    task sorts a partition; they are written and joined when they are few.
    """
    place = F.row_number().over(W.partitionBy("target_type").orderBy(F.col("updated_at").desc_nulls_last(), "id"))
    queue = written(_newest(items.select("target_type", "id", "state", "updated_at"), most).withColumn("place", place).where(F.col("place") <= most))
    wanted = queue.select("target_type", "id")
    of_queue = lambda df: df.join(wanted, ["target_type", "id"], "left_semi")
    counted = of_queue(evidence).groupBy("target_type", "id").agg(F.count(F.lit(1)).alias("evidence"))
    both = queue.join(validation_summary(of_queue(results)), ["target_type", "id"], "left").join(counted, ["target_type", "id"], "left")
    numbers = ["results", "blockers", "errors", "warnings", "infos", "evidence"]
    filled = both.withColumn("validated", F.col("results").isNotNull()).withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in numbers})
    return filled.select("target_type", "id", "state", "validated", *numbers, "place")


def merge_preview(merges: DataFrame, **tables: DataFrame) -> DataFrame:
    """What merging a term into another would move, and what would then stand twice: (source, target, part, to_move, conflicts).

    ``merges``: source, target, which differ.  Each of ``tables`` has ``term``
    and its own key columns; a row conflicts where the target has one with
    the same key.  Tables without key columns have no conflicts.
    """
    out = None
    asked = merges.select("source", "target").where("source <> target").distinct()
    for name, rows in sorted(tables.items()):
        key = [c for c in rows.columns if c != "term"]
        own = asked.join(rows.withColumnRenamed("term", "source"), "source")
        if key:
            there = rows.withColumnRenamed("term", "target").distinct().withColumn("_there", F.lit(True))
            own = own.join(there, ["target", *key], "left")
        else:
            own = own.withColumn("_there", F.lit(None).cast("boolean"))
        counted = own.groupBy("source", "target").agg(F.count(F.lit(1)).alias("to_move"), F.count_if(F.col("_there")).alias("conflicts"))
        part = asked.join(counted, ["source", "target"], "left").select("source", "target", F.lit(name).alias("part"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("to_move", "conflicts")])
        out = part if out is None else out.unionByName(part)
    return out


def folded(members: DataFrame, key: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Members that share a target folded onto the first: those that are kept, with ``folded`` (how many), and (key, kept, id) of the others.

    ``members`` has ``id``; the order is ``order``, then ``id``.  Which ones
    were folded is a row each, however many share a target.
    """
    first = members.groupBy(*key).agg(F.min_by("id", F.struct(*order, "id")).alias("kept"), (F.count(F.lit(1)) - 1).alias("folded"))
    rows = members.join(first, key)
    return rows.where("id = kept").drop("kept"), rows.where("id <> kept").select(*key, "kept", "id")
