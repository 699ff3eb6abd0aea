"""Circuits over a graph: validation, pre-scores, containment and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STARTS, ENDS = ("origin", "source", "start", "input"), ("terminus", "target", "end", "output")
STEP_TYPES = ("region", "region_group", "relay", "hub", "modulator", "functional_stage", "unknown")


def violations(circuits: DataFrame, members: DataFrame, steps: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(circuit, rule, n) of each rule that a circuit breaks.

    ``circuits``: circuit, closed.  ``members``: circuit, pos, region.
    ``steps``: circuit, pos, edge_id, src, dst, in order of ``pos``.  ``nodes``:
    node.  ``edges``: edge_id, src, dst, each id once.  Only the first use of
    an edge is held against the graph; null ends agree with everything.
    """
    region = members.where(F.coalesce("region", F.lit("")) != "").join(nodes.select(F.col("node").alias("region")), "region", "left_anti")
    blank = members.where(F.coalesce("region", F.lit("")) == "")
    use = W.partitionBy("circuit", "edge_id").orderBy("pos")
    named = steps.where(F.coalesce("edge_id", F.lit("")) != "").withColumn("_use", F.row_number().over(use))
    known = named.where("_use = 1").join(edges.select("edge_id", F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.lit(True).alias("_known")), "edge_id", "left")
    order = W.partitionBy("circuit").orderBy("pos")
    chained = steps.withColumn("_next", F.lead("src").over(order))
    ends = steps.groupBy("circuit").agg(F.min_by("src", "pos").alias("_first"), F.max_by("dst", "pos").alias("_last"))
    parts = {
        "missing_region_id": blank,
        "unknown_region": region,
        "missing_edge_id": steps.where(F.coalesce("edge_id", F.lit("")) == ""),
        "duplicate_edge": named.where("_use > 1"),
        "missing_edge": known.where("_known is null"),
        "direction_mismatch": known.where("src <> _src or dst <> _dst"),
        "discontinuous_order": chained.where("dst <> _next"),
        "loop_not_closed": circuits.where("closed").join(ends, "circuit").where("_last <> _first"),
    }
    out = None
    for rule, rows in parts.items():
        part = rows.select("circuit", F.lit(rule).alias("rule"))
        out = part if out is None else out.union(part)
    return out.groupBy("circuit", "rule").agg(F.count(F.lit(1)).alias("n"))


def pre_score(candidates: DataFrame, edges: DataFrame, domains: DataFrame, hubs: DataFrame, digits: int = 6) -> DataFrame:
    """(key, score): completeness .25, confidence .25, evidence .20, typed edges .15, shared domains .10, less .05 for hubs.

    ``candidates``: key, closed, path (array of different nodes).  A closed
    path returns to its start.  ``edges``: src, dst, confidence, n (evidence),
    type; each pair once.  ``domains``: node, domain.  ``hubs``: node.
    """
    ring = F.when(F.col("closed"), F.concat("path", F.slice("path", 1, 1))).otherwise(F.col("path"))
    hops = F.transform(F.sequence(F.lit(1), F.size("_ring") - 1), lambda k: F.struct(F.get("_ring", k - 1).alias("src"), F.get("_ring", k).alias("dst")))
    walked = candidates.select("key", ring.alias("_ring")).where(F.size("_ring") > 1).select("key", F.explode(hops).alias("e")).select("key", "e.src", "e.dst")
    typed = F.avg(F.when(F.coalesce("type", F.lit("unknown")) != "unknown", 1.0).otherwise(0.0))
    by_edge = walked.join(edges, ["src", "dst"], "left").groupBy("key").agg(F.avg("confidence").alias("_c"), F.sum("n").alias("_n"), typed.alias("_t"))
    on = candidates.select("key", F.explode("path").alias("node"))
    # how many nodes of a candidate have a domain at all, and how many have each
    with_any = on.join(domains.select("node").distinct(), "node", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("_m"))
    each = on.join(domains.distinct(), "node").groupBy("key", "domain").agg(F.count(F.lit(1)).alias("_k"))
    shared = each.join(with_any, "key").groupBy("key").agg(F.first("_m").alias("_m"), F.count_if(F.col("_k") == F.col("_m")).alias("_both"), F.count(F.lit(1)).alias("_all"))
    crowded = on.join(hubs.select("node").distinct(), "node", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("_h"))
    joined = candidates.join(by_edge, "key", "left").join(shared, "key", "left").join(crowded, "key", "left")
    coherence = F.when(F.col("_m").isNull(), 0.5).when(F.col("_m") == 1, 0.7).otherwise(F.col("_both") / F.col("_all"))
    score = (
        0.25 * F.when(F.col("closed"), 1.0).otherwise(0.7)
        + 0.25 * F.coalesce("_c", F.lit(0.0))
        + 0.20 * F.least(F.lit(1.0), F.coalesce("_n", F.lit(0)) / 10)
        + 0.15 * F.coalesce("_t", F.lit(0.0))
        + 0.10 * coherence
        - 0.05 * 0.5 * F.coalesce("_h", F.lit(0)) / F.size("path")
    )
    return joined.select("key", F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), digits).alias("score"))


def contained(candidates: DataFrame) -> DataFrame:
    """Candidates (key, kind, path) with ``parent``: the first key of a longer one of the kind that has the path as a part, else null.

    Every shorter stretch of a path that has the length of some candidate is
    looked up by equality, so the cost follows the paths' own length.
    """
    lengths = candidates.select("kind", F.size("path").alias("_l")).distinct().groupBy("kind").agg(F.collect_set("_l").alias("_lengths"))
    # at most as many lengths as a path has nodes
    long = candidates.join(lengths, "kind").withColumn("_lengths", F.filter("_lengths", lambda n: n < F.size("path")))
    long = long.select("kind", F.col("key").alias("_parent"), "path", F.explode("_lengths").alias("_l"))
    stretch = F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - F.col("_l") + 1), lambda k: F.slice("path", k, F.col("_l"))))
    parents = long.select("kind", "_parent", stretch.alias("path")).groupBy("kind", "path").agg(F.min("_parent").alias("parent"))
    return candidates.join(parents, ["kind", "path"], "left").select(*candidates.columns, "parent")


def quality(circuits: DataFrame, steps: DataFrame) -> DataFrame:
    """(circuit, score 0 to 100): fields 30, provenance 20, topology 20, evidence 20, regions 10.

    ``circuits``: circuit, name, type, atlas, evidence, description, resource,
    batch, run.  ``steps``: circuit, pos, role, step_type, evidence, region.
    A circuit without steps gets the ten points for steps with evidence.
    """
    long_enough = F.length("evidence") >= 10
    valid = F.coalesce(F.lower("step_type").isin(*STEP_TYPES), F.lit(False))
    s = steps.groupBy("circuit").agg(
        F.count(F.lit(1)).alias("_n"),
        F.lower(F.min_by("role", "pos")).alias("_first"),
        F.lower(F.max_by("role", "pos")).alias("_last"),
        F.bool_and(valid).alias("_valid"),
        F.count_if(long_enough).alias("_proved"),
        F.count_distinct("region").alias("_regions"),
    )
    full = lambda c, n=1: F.when(F.length(c) >= n, 1).otherwise(0)
    fields = full("name") + full("type") + full("atlas") + full("evidence", 10) + full("description", 10)
    provenance = F.when(F.col("resource").isNotNull(), 7).otherwise(0) + F.when(F.col("batch").isNotNull(), 7).otherwise(0) + F.when(F.col("run").isNotNull(), 6).otherwise(0)
    n = F.coalesce("_n", F.lit(0))
    five = lambda hit: F.when(hit, 5).otherwise(0)
    topology = five(n >= 2) + five(F.col("_first").isin(*STARTS)) + five(F.col("_last").isin(*ENDS)) + five(F.col("_valid"))
    size, proved = F.coalesce(F.length("evidence"), F.lit(0)), F.coalesce("_proved", F.lit(0))
    evidence = F.when(size >= 50, 10).when(size >= 10, 5).otherwise(0) + F.when(proved >= n * 0.5, 10).when(proved > 0, 5).otherwise(0)
    regions = F.when(F.col("_regions") >= 2, 10).when(F.col("_regions") == 1, 5).otherwise(0)
    score = fields / 5 * 30 + provenance + topology + evidence + regions
    return circuits.join(s, "circuit", "left").select("circuit", F.round(F.least(score, F.lit(100.0)), 1).alias("score"))
