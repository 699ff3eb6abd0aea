"""Decision tables as expressions of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp

#: What a paper's evidence can raise a confidence to, by direction.
CAPS = {"supports": 0.85, "partial": 0.75}
UNSURE = ("uncertain", "insufficient_information", "unknown")
PRIORITIES = ("low", "normal", "high", "urgent")


def adjusted_confidence(direction: Column, current: Column, reviewer: Column) -> tuple[Column, Column]:
    """(confidence, status): raised up to a cap by evidence at least as strong, unchanged by weaker, pending where it contradicts.

    Other directions can't be stored and fail the query.
    """
    now, seen = F.coalesce(current, F.lit(0.0)), clamp(reviewer, 0.0, 1.0)
    cap = F.when(direction == "supports", CAPS["supports"]).when(direction == "partial", CAPS["partial"])
    open_ = direction.isin("contradicts", "mixed")
    applied = cap.isNotNull() & (seen >= now)
    failed = F.raise_error(F.lit("evidence of this direction can't be stored"))
    status = F.when(applied, "applied").when(cap.isNotNull(), "no_change_weak_evidence").when(open_, "pending").otherwise(failed)
    return F.when(applied, F.least(cap, seen)).otherwise(now), status


def consensus(a: Column, b: Column, ca: Column, cb: Column) -> tuple[Column, Column]:
    """(status, score) of two models' decisions and confidences; a missing decision is null."""
    mean = F.when(ca.isNotNull() & cb.isNotNull(), (ca + cb) / 2).otherwise(F.coalesce(ca, cb))
    agreed = F.least(F.lit(0.95), F.coalesce(mean, F.lit(0.5)) + 0.10)
    missing, opposed = a.isNull() | b.isNull(), ((a == "support") & (b == "reject")) | ((a == "reject") & (b == "support"))
    status = (
        F.when(missing, "insufficient_information")
        .when((a == "support") & (b == "support"), "consensus_supported")
        .when((a == "reject") & (b == "reject"), "consensus_rejected")
        .when(opposed, "model_conflict")
        .when(a.isin(*UNSURE) & b.isin(*UNSURE) & ~((a == "support") | (b == "support")), "insufficient_information")
        .otherwise("needs_human_review")
    )
    score = F.when(missing, F.lit(None).cast("double")).when((a == b) & a.isin("support", "reject"), agreed).when(opposed, F.least(ca, cb)).otherwise(mean)
    return status, F.round(score, 3)


def rollback_plan(counts: DataFrame, target_rank: int) -> DataFrame:
    """(relation, layer, n, remove, keep) of a rollback to a layer: what lies above it goes."""
    above = F.col("layer") > target_rank
    return counts.withColumn("remove", F.when(above, F.col("n")).otherwise(0)).withColumn("keep", F.when(above, 0).otherwise(F.col("n")))


def rollback_risk(plan: DataFrame, critical: list[str], high: list[str], medium: list[str]) -> DataFrame:
    """One row: the highest risk of the relations that lose rows."""
    rank = F.when(F.col("relation").isin(*critical), 3).when(F.col("relation").isin(*high), 2).when(F.col("relation").isin(*medium), 1).otherwise(0)
    top = plan.agg(F.coalesce(F.max(F.when(F.col("remove") > 0, rank)), F.lit(0)).alias("rank"), F.coalesce(F.sum("remove"), F.lit(0)).alias("removed"))
    return top.select(F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), F.col("rank") + 1).alias("risk"), "removed")
