"""Queries over the evidence operators, with the SQL that they compare with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..sources.adapters import CONN, connections, table

USABLE = f"WITH {CONN}, usable AS (SELECT * FROM conn WHERE src <> dst)"
CLUSTERS = (
    USABLE
    + """, clusters AS (
  SELECT src, dst, type, direction, species, count(*) AS evidence_count, min(confidence) AS min_confidence, max(confidence) AS max_confidence,
    round(avg(confidence), 9) AS avg_confidence, count(DISTINCT run_id) AS run_count, count(DISTINCT src_side || '-' || dst_side) AS pattern_count
  FROM usable GROUP BY ALL)"""
)
CANONICAL = (
    CLUSTERS
    + """, canonical AS (
  SELECT src, dst, CAST(sum(evidence_count) AS BIGINT) AS evidence_count, round(sum(avg_confidence * evidence_count) / sum(evidence_count), 6) AS avg_confidence,
    min(min_confidence) AS min_confidence, max(max_confidence) AS max_confidence, string_agg(DISTINCT type, ',' ORDER BY type) AS types,
    string_agg(DISTINCT species, ',' ORDER BY species) AS species, count(*) AS cluster_count
  FROM clusters GROUP BY src, dst)"""
)


def _canonical(spark: SparkSession, d: str) -> DataFrame:
    return ev.roll_up(ev.clusters(connections(spark, d), digits=9), digits=6)


def quality_v2(spark: SparkSession, d: str) -> DataFrame:
    canonical = _canonical(spark, d)
    records, traced = F.col("evidence_count"), F.when(F.col("min_confidence") > 0, F.col("evidence_count")).otherwise(0)
    traced_share = ev.provenance_completeness(records, traced, F.col("cluster_count"), F.lit(1), F.lit(0.75))
    valid = F.when(F.col("cluster_count") > 1, F.col("max_confidence") > 0.5)
    scored = ev.quality_v2(canonical.withColumn("provenance", traced_share), F.col("cluster_count"), F.col("provenance"), valid, digits=6)
    tier = ev.enrichment_tier(F.col("evidence_count"), F.col("avg_confidence"), F.col("provenance"), F.col("level"))
    return scored.select("src", "dst", "provenance", "score", "level", tier.alias("tier"))


def pair_ranking(spark: SparkSession, d: str) -> DataFrame:
    rows = connections(spark, d)
    reports = rows.select(
        "src",
        "dst",
        F.col("run_id").alias("paper"),
        F.when(F.col("type") == "projection", 1.0).otherwise(0.7).alias("weight"),
        F.when(F.col("direction") == "directed", 0.8).otherwise(0.6).alias("proximity"),
        F.col("evidence").alias("keyword"),
    )
    return ev.pair_ranking(reports)


def latest_event(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("user_id is not null")
    return ev.latest_per_key(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


def sigma_classes(spark: SparkSession, d: str) -> DataFrame:
    counts = connections(spark, d).where("src <> dst").groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return ev.sigma_classes(counts, "n")


QUERIES = {
    "evidence_clusters": lambda s, d: ev.clusters(connections(s, d), digits=9),
    "evidence_conservation": lambda s, d: ev.conservation(connections(s, d)),
    "hemisphere_groups": lambda s, d: ev.hemisphere_groups(connections(s, d)),
    "confidence_buckets": lambda s, d: ev.confidence_buckets(connections(s, d), "type"),
    "canonical_roll_up": _canonical,
    "directionality_rules": lambda s, d: ev.directionality(connections(s, d)),
    "source_groups": lambda s, d: ev.source_groups(connections(s, d)),
    "evidence_quality_v1": lambda s, d: ev.quality_v1(connections(s, d)),
    "evidence_quality_v2": quality_v2,
    "pair_ranking": pair_ranking,
    "experiment_statistics": lambda s, d: ev.experiment_statistics(connections(s, d), "l_suppkey", "confidence"),
    "sigma_classes": sigma_classes,
    "final_evidence_audit": lambda s, d: ev.final_audit(_canonical(s, d)),
    "duplicate_reports": lambda s, d: ev.duplicates(connections(s, d), "src", "dst", "run_id", "evidence"),
    "latest_per_key": latest_event,
}

_REASON = "CASE WHEN pattern_count > 1 THEN 'hemisphere_specific' WHEN evidence_count > 1 THEN 'duplicate_evidence' ELSE 'single' END AS merge_reason"
ORACLE_SQL = {
    "evidence_clusters": f"{CLUSTERS} SELECT *, {_REASON} FROM clusters",
    "evidence_conservation": f"WITH {CONN} SELECT count(*) FILTER (src <> dst) AS clustered, count(*) FILTER (src = dst) AS self_loops, count(*) FILTER (src IS NULL OR dst IS NULL) AS unresolved, count(*) AS total FROM conn",
    "hemisphere_groups": f"{USABLE} SELECT src, dst, string_agg(pattern || '=' || n, ';' ORDER BY pattern || '=' || n) AS patterns, CAST(sum(n) AS BIGINT) AS evidence_count FROM (SELECT src, dst, src_side || '-' || dst_side AS pattern, count(*) AS n FROM usable GROUP BY ALL) GROUP BY src, dst",
    "confidence_buckets": f"WITH {CONN} SELECT type, round_even(confidence * 10, 0) / 10 + 0.0 AS bucket, count(*) AS n FROM conn GROUP BY ALL",
    "canonical_roll_up": f"{CANONICAL} SELECT * FROM canonical",
    "directionality_rules": f"""{USABLE}, own AS (SELECT src, dst, count(*) FILTER (direction = 'directed') AS directed, count(*) FILTER (direction = 'undirected') AS undirected, count(*) AS total FROM usable GROUP BY ALL)
      SELECT a.src, a.dst, a.directed, a.total, CASE WHEN a.directed = a.total AND b.total = b.directed THEN 'bidirectional' WHEN a.directed > 0 THEN 'directed' WHEN a.undirected > 0 THEN 'undirected' ELSE 'unspecified' END AS direction
      FROM own a LEFT JOIN own b ON a.src = b.dst AND a.dst = b.src""",
    "source_groups": f"WITH {CONN} SELECT run_id, species, count(*) AS n, min(confidence) AS low, max(confidence) AS high, round(avg(confidence), 4) AS mean FROM conn GROUP BY ALL",
    "evidence_quality_v1": f"""{USABLE}, g AS (SELECT src, dst, count(confidence) AS n, count(DISTINCT run_id) AS runs, avg(confidence) AS mean, stddev_pop(confidence) AS sd FROM usable GROUP BY ALL),
      c AS (SELECT *, CAST(CASE WHEN n = 0 THEN 0.0 WHEN n < 2 THEN 0.5 WHEN sd / nullif(mean, 0) <= 0.3 THEN 1.0 WHEN sd / nullif(mean, 0) <= 0.6 THEN 0.6 ELSE 0.3 END AS DOUBLE) AS consistency FROM g),
      s AS (SELECT src, dst, n, runs, consistency, round(CAST(0.45 AS DOUBLE) * least(n, 10) / 10 + CAST(0.35 AS DOUBLE) * least(runs, 3) / 3 + CAST(0.2 AS DOUBLE) * consistency, 4) AS score FROM c)
      SELECT *, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS level FROM s""",
    "evidence_quality_v2": f"""{CANONICAL}, t AS (SELECT *, round(least(1.0::DOUBLE, 0.4::DOUBLE * CASE WHEN min_confidence > 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END + 0.3::DOUBLE * least(cluster_count, 3) / 3 + 0.15::DOUBLE / 2 + 0.15::DOUBLE * 0.75::DOUBLE), 4) AS provenance,
        CASE WHEN cluster_count > 1 THEN max_confidence > 0.5 END AS valid FROM canonical),
      s AS (SELECT *, round(0.3::DOUBLE * least(evidence_count, 10) / 10 + 0.2::DOUBLE * least(cluster_count, 3) / 3 + 0.15::DOUBLE * least(avg_confidence, 1.0::DOUBLE) + 0.15::DOUBLE * provenance + 0.2::DOUBLE * CASE WHEN valid IS NULL THEN 0.5::DOUBLE WHEN valid THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END, 6) AS score FROM t),
      l AS (SELECT *, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS level FROM s)
      SELECT src, dst, provenance, score, level, CASE WHEN evidence_count = 1 AND avg_confidence < 0.5 AND provenance < 0.8 THEN 'A' WHEN evidence_count = 1 OR level = 'low' THEN 'B' ELSE 'C' END AS tier FROM l""",
    "pair_ranking": f"""WITH {CONN}, g AS (SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, count(DISTINCT run_id) AS papers, max(CASE WHEN type = 'projection' THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END) AS weight,
        max(CASE WHEN direction = 'directed' THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END) AS proximity, count(DISTINCT evidence) AS keywords FROM conn WHERE src <> dst GROUP BY ALL)
      SELECT *, round(pow(2.0::DOUBLE, least(papers, 6) - 1) * weight * proximity * (1 + 0.1::DOUBLE * least(keywords, 5)), 4) AS score,
        CASE WHEN papers >= 2 AND proximity >= 0.8 AND keywords > 0 THEN 'A' WHEN papers >= 2 OR proximity >= 0.8 OR keywords > 0 THEN 'B' ELSE 'C' END AS tier FROM g""",
    "experiment_statistics": f"""WITH {CONN}, g AS (SELECT l_suppkey, list_sort(list(confidence)) AS v, median(confidence) AS m FROM conn GROUP BY l_suppkey)
      SELECT l_suppkey, len(v) AS n, v[1] AS low, round(m, 6) AS median, v[-1] AS high, CASE WHEN len(v) > 1 THEN v[CAST(floor(len(v) * 0.75::DOUBLE) AS INTEGER) + 1] END AS p75, CASE WHEN len(v) > 1 THEN v[CAST(floor(len(v) * 0.9::DOUBLE) AS INTEGER) + 1] END AS p90 FROM g""",
    "sigma_classes": f"{USABLE}, g AS (SELECT src, count(*) AS n FROM usable GROUP BY src), s AS (SELECT avg(n) AS m, stddev_pop(n) AS d FROM g) SELECT src, n, CASE WHEN n > m + d THEN 'high' WHEN n < m - d THEN 'low' ELSE 'normal' END AS level FROM g, s",
    "final_evidence_audit": f"""{CANONICAL} SELECT concat_ws('+', CASE WHEN evidence_count < 2 THEN 'single_evidence' END, CASE WHEN avg_confidence < 0.5 THEN 'low_confidence' END, CASE WHEN NOT contains(types, 'projection') THEN 'no_projection' END) AS flags,
      count(*) AS n, CAST(sum(evidence_count) AS BIGINT) AS evidence FROM canonical GROUP BY 1""",
    "duplicate_reports": f"WITH {CONN} SELECT src, dst, run_id, evidence, count(*) AS n, count(*) - 1 AS extra FROM conn GROUP BY ALL HAVING count(*) > 1",
    "latest_per_key": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE user_id IS NOT NULL) WHERE k = 1",
}
