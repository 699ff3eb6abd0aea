"""Circuits and projections that speak for each other: agreement of both ways, and what planned merges would close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: which memberships go from projection to circuit, weights, labels ---
REVERSE_METHOD, FORWARD_METHOD = "projection_to_circuit", "circuit_to_projection"
REVERSE_STATUS, FORWARD_STATUS = "projection_supported", "circuit_supported"
BOTH_WAYS, SAME_CIRCUIT, SAME_PROJECTION, EACH, MISMATCH_CAP = 0.4, 0.15, 0.15, 0.1, 0.3


def both_ways(memberships: DataFrame) -> DataFrame:
    """(circuit, projection, forward, reverse): the first membership of each way, by ``order``.

    ``memberships``: circuit, projection, order, method, verification,
    source_step, target_step, source_region, target_region, scope.  What doesn't
    say that it is reverse is forward; what says both is forward.  One pass
    with partial sums, so a pair with many memberships is small before it travels.
    """
    says = lambda method, status: F.coalesce(F.col("method") == method, F.lit(False)) | F.coalesce(F.col("verification") == status, F.lit(False))
    reverse = says(REVERSE_METHOD, REVERSE_STATUS) & ~says(FORWARD_METHOD, FORWARD_STATUS)
    own = F.struct("source_step", "target_step", "source_region", "target_region", "scope")
    first = lambda which: F.min_by(F.when(which, own), F.when(which, F.col("order")))
    return memberships.groupBy("circuit", "projection").agg(first(~reverse).alias("forward"), first(reverse).alias("reverse"))


def cross_validated(memberships: DataFrame, circuits: DataFrame, projections: DataFrame) -> DataFrame:
    """How both ways agree on each pair: status, support, agreement and reason, by the first rule that applies.

    ``circuits``: circuit; ``projections``: projection, src, dst.  Agreements
    of what is null on a side are null and add nothing.
    """
    there = lambda df, key: df.select(key, *[c for c in df.columns if c != key], F.lit(True).alias(f"has_{key}")).dropDuplicates([key])
    rows = both_ways(memberships).join(there(circuits.select("circuit"), "circuit"), "circuit", "left").join(there(projections.select("projection", "src", "dst"), "projection"), "projection", "left")
    f, r = F.col("forward"), F.col("reverse")
    circuit, projection = F.col("has_circuit").isNotNull(), F.col("has_projection").isNotNull()
    two = f.isNotNull() & r.isNotNull()
    source, target = f["source_step"] == r["source_step"], f["target_step"] == r["target_step"]
    scope = f["scope"].eqNullSafe(r["scope"])
    ends_known = F.col("src").isNotNull() & F.col("dst").isNotNull() & f["source_step"].isNotNull() & f["target_step"].isNotNull()
    direction = F.when(ends_known, f["source_region"].eqNullSafe(F.col("src")) & f["target_region"].eqNullSafe(F.col("dst")))
    seen = circuit & projection & two
    rows = rows.select("circuit", "projection", f.isNotNull().alias("fwd"), r.isNotNull().alias("rev"), circuit.alias("c"), projection.alias("p"), *[F.when(seen, x).alias(n) for n, x in (("source_agrees", source), ("target_agrees", target), ("scope_agrees", scope), ("direction_agrees", direction))])
    # direction and steps aren't compared where scopes differ, but still count
    no = lambda c: F.coalesce(~F.col(c), F.lit(False))
    missing = ~F.col("c") | ~F.col("p")
    single = F.col("fwd") != F.col("rev")
    both_steps, a_step = no("source_agrees") & no("target_agrees"), no("source_agrees") | no("target_agrees")
    table: list[tuple[Column, str, str, str | None]] = [
        (~F.col("c"), "insufficient_evidence", "unknown", "MISSING_CIRCUIT_OR_PROJECTION"),
        (~F.col("p"), "insufficient_evidence", "unknown", "MISSING_PROJECTION"),
        (~F.col("fwd"), "projection_supported_only", "weak", None),
        (~F.col("rev"), "circuit_supported_only", "weak", None),
        (no("scope_agrees"), "conflict", "conflicting", "SCOPE_MISMATCH"),
        (no("direction_agrees"), "conflict", "conflicting", "DIRECTION_STEP_CONFLICT"),
        (both_steps, "bidirectionally_supported", "weak", "STEP_MISMATCH"),
        (a_step, "bidirectionally_supported", "moderate", "STEP_MISMATCH"),
        (F.lit(True), "bidirectionally_supported", "strong", None),
    ]
    outcome = F.lit(None)
    for when, status, support, reason in reversed(table):
        outcome = F.when(when, F.struct(F.lit(status).alias("status"), F.lit(support).alias("support"), F.lit(reason).cast("string").alias("reason"))).otherwise(outcome)
    points = F.lit(SAME_CIRCUIT + SAME_PROJECTION) + F.when(single, 0.0).otherwise(BOTH_WAYS)
    for c in ("source_agrees", "target_agrees", "scope_agrees", "direction_agrees"):
        points = points + F.when(F.col(c), EACH).otherwise(0.0)
    score = F.when(missing, None).when(no("scope_agrees"), F.least(points, F.lit(MISMATCH_CAP))).otherwise(F.least(points, F.lit(1.0)))
    return rows.withColumn("o", outcome).select("circuit", "projection", "o.status", "o.support", F.round(score, 2).alias("agreement"), "source_agrees", "target_agrees", "direction_agrees", "scope_agrees", "o.reason")


def closure_forecast(memberships: DataFrame, canonical: DataFrame, planned: DataFrame, members: DataFrame) -> DataFrame:
    """What happens to circuits if ``planned`` projections became canonical too; nothing is changed.

    ``memberships``: circuit, projection; ``canonical`` and ``planned``:
    projection; ``members``: circuit, role, grounded.  A circuit is closed when
    all its projections are canonical; one that is open now and would be closed
    is closable, and fully aligned if no member's role is unknown and all are
    grounded.  Circuits without projections are not open.
    """
    flag = lambda df, name: df.select("projection").where("projection is not null").distinct().withColumn(name, F.lit(True))
    own = memberships.select("circuit", "projection").join(flag(canonical, "now"), "projection", "left").join(flag(planned, "then"), "projection", "left")
    now, then = F.coalesce("now", F.lit(False)), F.coalesce("then", F.lit(False))
    counts = own.groupBy("circuit").agg(F.count(F.lit(1)).alias("projections"), F.count_if(now).alias("resolved_before"), F.count_if(then & ~now).alias("newly_resolved"), F.bool_and(now | then).alias("all_then"))
    people = members.groupBy("circuit").agg(F.bool_or((F.col("role") == "unknown") | ~F.coalesce("grounded", F.lit(False))).alias("unclear"))
    open_ = F.col("resolved_before") < F.col("projections")
    told = counts.join(people, "circuit", "left").withColumn("closable", open_ & F.col("all_then"))
    return told.select("circuit", "projections", "resolved_before", "newly_resolved", "closable", (F.col("closable") & ~F.coalesce("unclear", F.lit(False))).alias("fully_aligned"))
