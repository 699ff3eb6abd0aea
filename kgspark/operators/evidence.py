"""Consolidation of evidence: clusters, roll-ups, scores and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("src", "dst", "type", "direction", "species")


def split_reports(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(usable, self-loops, unresolved): a partition of the reports."""
    unresolved = F.col("src").isNull() | F.col("dst").isNull()
    loop = ~unresolved & (F.col("src") == F.col("dst"))
    return rows.where(~unresolved & ~loop), rows.where(loop), rows.where(unresolved)


def clusters(rows: DataFrame, key: tuple[str, ...] = KEY, digits: int = 4) -> DataFrame:
    """One row for each key of the usable reports, with its evidence summed up."""
    usable, _, _ = split_reports(rows)
    pattern = F.concat_ws("-", "src_side", "dst_side")
    out = usable.groupBy(*key).agg(
        F.count(F.lit(1)).alias("evidence_count"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
        F.round(F.avg("confidence"), digits).alias("avg_confidence"),
        F.count_distinct("run_id").alias("run_count"),
        F.count_distinct(pattern).alias("pattern_count"),
    )
    reason = F.when(F.col("pattern_count") > 1, "hemisphere_specific").when(F.col("evidence_count") > 1, "duplicate_evidence").otherwise("single")
    return out.withColumn("merge_reason", reason)


def conservation(rows: DataFrame) -> DataFrame:
    """Counts that must add up: clustered evidence, self-loops, unresolved, all."""
    unresolved = F.col("src").isNull() | F.col("dst").isNull()
    loop = ~unresolved & (F.col("src") == F.col("dst"))
    return rows.agg(
        F.count_if(~unresolved & ~loop).alias("clustered"), F.count_if(loop).alias("self_loops"), F.count_if(unresolved).alias("unresolved"), F.count(F.lit(1)).alias("total")
    )


def hemisphere_groups(rows: DataFrame) -> DataFrame:
    """Counts by side pattern within each pair, as sorted ``pattern=count`` entries."""
    usable, _, _ = split_reports(rows)
    counted = usable.groupBy("src", "dst", F.concat_ws("-", "src_side", "dst_side").alias("pattern")).count()
    entries = F.sort_array(F.collect_list(F.concat_ws("=", "pattern", "count")))
    return counted.groupBy("src", "dst").agg(F.array_join(entries, ";").alias("patterns"), F.sum("count").alias("evidence_count"))


def confidence_buckets(rows: DataFrame, by: str) -> DataFrame:
    """Histogram of confidences in tenths; halves go to the even tenth."""
    bucket = (F.bround(F.col("confidence") * 10) / 10 + F.lit(0.0)).alias("bucket")
    return rows.groupBy(by, bucket).agg(F.count(F.lit(1)).alias("n"))


def roll_up(parts: DataFrame, key: tuple[str, ...] = ("src", "dst"), digits: int = 4) -> DataFrame:
    """Clusters merged to canonical connections: mean weighted by evidence, extremes, distinct sets."""
    weighted = F.sum(F.col("avg_confidence") * F.col("evidence_count")) / F.sum("evidence_count")
    return parts.groupBy(*key).agg(
        F.sum("evidence_count").alias("evidence_count"),
        F.round(weighted, digits).alias("avg_confidence"),
        F.min("min_confidence").alias("min_confidence"),
        F.max("max_confidence").alias("max_confidence"),
        F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"),
        F.array_join(F.array_sort(F.collect_set("species")), ",").alias("species"),
        F.count(F.lit(1)).alias("cluster_count"),
    )


def directionality(rows: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """Resolved direction of each ordered pair (and ``key``), with a look at the reverse pair.

    The first rule that holds decides: any bidirectional report; this pair and
    its reverse all directed (bidirectional); one value throughout; of a mixture
    the most definite value, directed before undirected before unspecified.
    """
    usable, _, _ = split_reports(rows)
    n = lambda value: F.count_if(F.col("direction") == value)
    own = usable.groupBy("src", "dst", *key).agg(n("bidirectional").alias("both_ways"), n("directed").alias("directed"), n("undirected").alias("undirected"), F.count(F.lit(1)).alias("total"))
    back = own.select(F.col("src").alias("dst"), F.col("dst").alias("src"), *key, (F.col("directed") == F.col("total")).alias("back_directed"))
    joined = own.join(back, ["src", "dst", *key], "left")
    resolved = (
        F.when(F.col("both_ways") > 0, "bidirectional")
        .when((F.col("directed") == F.col("total")) & F.col("back_directed"), "bidirectional")
        .when(F.col("directed") > 0, "directed")
        .when(F.col("undirected") > 0, "undirected")
        .otherwise("unspecified")
    )
    return joined.select("src", "dst", *key, "directed", "total", resolved.alias("direction"))


def source_groups(rows: DataFrame) -> DataFrame:
    """Evidence by run and species."""
    return rows.groupBy("run_id", "species").agg(
        F.count(F.lit(1)).alias("n"), F.min("confidence").alias("low"), F.max("confidence").alias("high"), F.round(F.avg("confidence"), 4).alias("mean")
    )


def consistency(mean: Column, deviation: Column, count: Column, any_value: Column) -> Column:
    """1, 0.6 or 0.3 by coefficient of variation; 0.5 for one value, 0 for none."""
    cv = deviation / F.nullif(mean, F.lit(0.0))
    return F.when(~any_value, 0.0).when(count < 2, 0.5).when(cv <= 0.3, 1.0).when(cv <= 0.6, 0.6).otherwise(0.3)


def quality_v1(rows: DataFrame) -> DataFrame:
    """Score of each pair from amount, number of runs and consistency of its evidence."""
    usable, _, _ = split_reports(rows)
    g = usable.groupBy("src", "dst").agg(
        F.count("confidence").alias("n"), F.count_distinct("run_id").alias("runs"), F.avg("confidence").alias("mean"), F.stddev_pop("confidence").alias("sd")
    )
    steady = consistency(F.col("mean"), F.col("sd"), F.col("n"), F.col("n") > 0)
    score = 0.45 * F.least(F.col("n"), F.lit(10)) / 10 + 0.35 * F.least(F.col("runs"), F.lit(3)) / 3 + 0.2 * steady
    out = g.select("src", "dst", "n", "runs", steady.alias("consistency"), F.round(score, 4).alias("score"))
    return out.withColumn("level", level(F.col("score")))


def level(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.45, "medium").otherwise("low")


def provenance_completeness(records: Column, traced: Column, runs: Column, groups: Column, keys: Column) -> Column:
    """0.4 for supporting records (half where not all of them are traced), 0.3 for runs (3 suffice), 0.15 for source groups (2), 0.15 for the share of keys."""
    whole = F.when(records == 0, 0.0).when(traced == records, 1.0).otherwise(0.5)
    return F.round(F.least(F.lit(1.0), 0.4 * whole + 0.3 * F.least(runs, F.lit(3)) / 3 + 0.15 * F.least(groups, F.lit(2)) / 2 + 0.15 * keys), 4)


def quality_v2(canonical: DataFrame, sources: Column, provenance: Column, valid: Column, digits: int = 4) -> DataFrame:
    """Final-layer score and level: evidence .30, sources .20, confidence .15, provenance .15, validation .20.

    ``valid``: passed counts 1, failed 0.3, no record (null) 0.5.
    """
    validation = F.when(valid.isNull(), 0.5).when(valid, 1.0).otherwise(0.3)
    mean = F.least(F.greatest(F.coalesce("avg_confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    score = 0.30 * F.least("evidence_count", F.lit(10)) / 10 + 0.20 * F.least(sources, F.lit(3)) / 3 + 0.15 * mean + 0.15 * provenance + 0.20 * validation
    return canonical.withColumn("score", F.round(score, digits)).withColumn("level", level(F.col("score")))


def enrichment_tier(evidence: Column, confidence: Column, provenance: Column, quality: Column) -> Column:
    """A: single, weak and poorly traced evidence; B: other single evidence, or a low level; else C."""
    weak = (F.coalesce(confidence, F.lit(0.0)) < 0.5) & (provenance < 0.8)
    return F.when((evidence == 1) & weak, "A").when((evidence == 1) | (quality == "low"), "B").otherwise("C")


def pair_ranking(reports: DataFrame) -> DataFrame:
    """Unordered pairs by papers, source weight, proximity and keywords.

    ``reports``: src, dst, paper, weight, proximity, keyword.
    """
    pairs = reports.where("src <> dst").withColumn("lo", F.least("src", "dst")).withColumn("hi", F.greatest("src", "dst"))
    g = pairs.groupBy("lo", "hi").agg(
        F.count_distinct("paper").alias("papers"), F.max("weight").alias("weight"), F.max("proximity").alias("proximity"), F.count_distinct("keyword").alias("keywords")
    )
    support = F.when(F.col("papers") > 0, F.pow(F.lit(2.0), F.least("papers", F.lit(6)) - 1)).otherwise(0.0)
    score = support * F.col("weight") * F.col("proximity") * (1 + 0.1 * F.least("keywords", F.lit(5)))
    near, worded, several = F.col("proximity") >= 0.8, F.col("keywords") > 0, F.col("papers") >= 2
    tier = F.when(several & near & worded, "A").when(several | near | worded, "B").otherwise("C")
    return g.withColumn("score", F.round(score, 4)).withColumn("tier", tier)


def experiment_statistics(rows: DataFrame, by: str, value: str) -> DataFrame:
    """min, median, max and the entries at 75 and 90 percent of the sorted values (null for one value)."""
    whole = W.partitionBy(by)
    placed = rows.select(by, value).withColumns({"_k": F.row_number().over(whole.orderBy(F.asc_nulls_last(value))), "_n": F.count(value).over(whole)})

    def at(share: float) -> Column:
        return F.max(F.when((F.col("_n") > 1) & (F.col("_k") == F.floor(F.col("_n") * share) + 1), F.col(value)))

    return placed.groupBy(by).agg(
        F.count(value).alias("n"), F.min(value).alias("low"), F.round(F.median(value), 6).alias("median"), F.max(value).alias("high"), at(0.75).alias("p75"), at(0.9).alias("p90")
    )


def sigma_classes(rows: DataFrame, value: str) -> DataFrame:
    """high and low beyond one population standard deviation of the mean, else normal."""
    stats = rows.agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    label = F.when(F.col(value) > F.col("_mean") + F.col("_sd"), "high").when(F.col(value) < F.col("_mean") - F.col("_sd"), "low").otherwise("normal")
    # one row of statistics
    return rows.crossJoin(F.broadcast(stats)).withColumn("level", label).drop("_mean", "_sd")


def final_audit(canonical: DataFrame) -> DataFrame:
    """How often each combination of missing evidence flags occurs."""
    flags = F.array_compact(
        F.array(
            F.when(F.col("evidence_count") < 2, "single_evidence"), F.when(F.col("avg_confidence") < 0.5, "low_confidence"), F.when(~F.contains("types", F.lit("projection")), "no_projection")
        )
    )
    return canonical.groupBy(F.array_join(flags, "+").alias("flags")).agg(F.count(F.lit(1)).alias("n"), F.sum("evidence_count").alias("evidence"))


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, and how many rows are too many."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("extra", F.col("n") - 1)


def latest_per_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which has to be total."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")
