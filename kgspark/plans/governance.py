"""Queries over promotion, review and merges, with the SQL that they compare with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import governance as v
from ..sources.adapters import table


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders as raw connections from a customer's nation to another, in all states."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"),
        F.when(k % 11 == 0, "draft").when(k % 13 == 0, v.FINAL).otherwise(v.APPROVED).alias("mirror_status"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(v.REVIEWED).alias("review_status"),
        F.when(k % 17 == 0, v.BLOCKED).when(k % 19 == 0, v.PROMOTED).alias("promotion_status"),
        F.substring("o_orderpriority", 1, 1).alias("resource"),
        F.when(k % 23 > 0, F.col("c_mktsegment")).alias("atlas"),
        F.when(k % 29 > 0, "macro").otherwise("").alias("level"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("type"),
        F.when(k % 2 == 0, "undirected").otherwise("directed").alias("direction"),
        F.col("c_nationkey").alias("src"),
        (k % 25).cast("int").alias("dst"),
    )


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Lines as validation results of their orders."""
    severity = F.when(F.col("l_tax") > 0.075, "blocker").when(F.col("l_tax") > 0.065, "error").when(F.col("l_returnflag") == "R", "warning")
    return table(spark, d, "lineitem").select(F.lit("connection").alias("target_type"), F.col("l_orderkey").alias("id"), severity.alias("severity"), F.col("l_shipdate").alias("created_at"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax", "l_returnflag").alias("result_id"))


def _eligible(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    approvals = table(spark, d, "orders").where("o_totalprice > 20000").select(F.col("o_orderkey").alias("id"))
    never = table(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_orderkey").alias("id"))
    # what stands in the final layer has its ends the other way round
    final = rows.where("id % 5 = 1").select("resource", "atlas", "level", "type", "direction", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return v.promotion_eligibility(rows, approvals, v.validation_summary(_results(spark, d), 3), never, final)


def _queue(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.lit("connection").alias("target_type"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("updated_at"))
    parts = table(spark, d, "part").select(F.lit("function"), F.col("p_partkey"), F.col("p_type"), F.lit(None).cast("timestamp"))
    line = table(spark, d, "lineitem")
    evidence = line.where("l_discount > 0.05").select(F.lit("connection").alias("target_type"), F.col("l_orderkey").alias("id")).union(line.select(F.lit("function"), F.col("l_partkey")))
    return v.review_queue(orders.union(parts), _results(spark, d), evidence)


def _merges(spark: SparkSession, d: str) -> DataFrame:
    """Every part would be merged into the one before it."""
    part, line = table(spark, d, "part"), table(spark, d, "lineitem")
    merges = part.select(F.col("p_partkey").alias("source"), F.greatest(F.col("p_partkey") - 1, F.lit(0)).alias("target"))
    return v.merge_preview(merges, synonyms=line.select(F.col("l_partkey").alias("term"), "l_suppkey"), mappings=line.select(F.col("l_partkey").alias("term"), "l_returnflag", "l_linestatus"), groundings=line.where("l_tax > 0.04").select(F.col("l_partkey").alias("term")))


def _folded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    members = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("circuit"), F.col("o_orderstatus").alias("target"), "o_orderdate")
    return v.folded(members, ["circuit", "target"], ["o_orderdate"])


QUERIES = {
    "promotion_eligibility": _eligible,
    "review_queue": _queue,
    "merge_preview": _merges,
    "folded_members": lambda s, d: _folded(s, d)[0].select("circuit", "target", "id", "folded"),
    "folded_away": lambda s, d: _folded(s, d)[1],
}

_SUMMARY = """res AS (SELECT l_orderkey AS id, CASE WHEN l_tax > 0.075 THEN 'blocker' WHEN l_tax > 0.065 THEN 'error' WHEN l_returnflag = 'R' THEN 'warning' END AS severity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_tax DESC, l_returnflag DESC) AS k FROM lineitem),
  summary AS (SELECT id, count(*) AS results, count(*) FILTER (severity = 'blocker') AS blockers, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity IS NULL) AS infos FROM res WHERE k <= {0} GROUP BY id)"""
ORACLE_SQL = {
    "promotion_eligibility": f"""WITH {_SUMMARY.format(3)}, raw AS (SELECT o_orderkey AS id, o_totalprice AS price, left(o_orderpriority, 1) AS resource, CASE WHEN o_orderkey % 23 > 0 THEN c_mktsegment END AS atlas, CASE WHEN o_orderkey % 29 > 0 THEN 'macro' ELSE '' END AS level, nullif(o_orderstatus, 'P') AS type, o_orderkey % 2 = 0 AS und, c_nationkey || '' AS src, o_orderkey % 25 || '' AS dst FROM orders JOIN customer ON o_custkey = c_custkey),
      keyed AS (SELECT *, CASE WHEN und AND dst < src THEN dst || '>' || src ELSE src || '>' || dst END AS ends, CASE WHEN und AND src < dst THEN src || '>' || dst ELSE dst || '>' || src END AS back FROM raw),
      r AS (SELECT k.id, CASE WHEN k.id % 11 = 0 OR k.id % 13 = 0 THEN 'NOT_HUMAN_APPROVED' WHEN k.id % 7 = 0 THEN 'REVIEW_STATUS_NOT_APPROVED' WHEN k.id % 17 = 0 THEN 'PROMOTION_BLOCKED' WHEN k.id % 19 = 0 THEN 'ALREADY_PROMOTED' WHEN NOT price > 20000 THEN 'NO_APPROVE_REVIEW_RECORD' WHEN blockers > 0 OR errors > 0 THEN 'HAS_VALIDATION_BLOCKER' WHEN atlas IS NULL THEN 'MISSING_SOURCE_ATLAS' WHEN level = '' THEN 'MISSING_GRANULARITY'
        WHEN price > 450000 THEN 'GOVERNANCE_SKIP_NEVER_PROMOTE' WHEN EXISTS (SELECT 1 FROM keyed f WHERE f.id % 5 = 1 AND f.resource = k.resource AND f.atlas IS NOT DISTINCT FROM k.atlas AND f.level = k.level AND f.type IS NOT DISTINCT FROM k.type AND f.und = k.und AND f.back = k.ends) THEN 'DUPLICATE_FINAL_EXISTS' END AS reason FROM keyed k LEFT JOIN summary USING (id))
      SELECT id, reason IS NULL AS eligible, reason FROM r""",
    "review_queue": f"""WITH {_SUMMARY.format(200)}, item AS (SELECT 'connection' AS target_type, o_orderkey AS id, o_orderstatus AS state, o_orderdate AS updated FROM orders UNION ALL SELECT 'function', p_partkey, p_type, NULL FROM part),
      ev AS (SELECT target_type, id, count(*) AS evidence FROM (SELECT 'connection' AS target_type, l_orderkey AS id FROM lineitem WHERE l_discount > 0.05 UNION ALL SELECT 'function', l_partkey FROM lineitem) GROUP BY ALL)
      SELECT * FROM (SELECT target_type, id, state, results IS NOT NULL AS validated, coalesce(results, 0) AS results, coalesce(blockers, 0) AS blockers, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(infos, 0) AS infos, coalesce(evidence, 0) AS evidence, CAST(row_number() OVER (PARTITION BY target_type ORDER BY updated DESC NULLS LAST, id) AS INTEGER) AS place
      FROM item LEFT JOIN (SELECT 'connection' AS target_type, * FROM summary) USING (target_type, id) LEFT JOIN ev USING (target_type, id)) WHERE place <= 2000""",
    "merge_preview": """WITH m AS (SELECT p_partkey AS source, p_partkey - 1 AS target FROM part WHERE p_partkey > 0), s AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), x AS (SELECT DISTINCT l_partkey, l_returnflag, l_linestatus FROM lineitem)
      SELECT source, target, 'synonyms' AS part, (SELECT count(*) FROM lineitem WHERE l_partkey = source) AS to_move, (SELECT count(*) FROM lineitem l JOIN s ON s.l_partkey = target AND s.l_suppkey = l.l_suppkey WHERE l.l_partkey = source) AS conflicts FROM m
      UNION ALL SELECT source, target, 'mappings', (SELECT count(*) FROM lineitem WHERE l_partkey = source), (SELECT count(*) FROM lineitem l JOIN x ON x.l_partkey = target AND x.l_returnflag = l.l_returnflag AND x.l_linestatus = l.l_linestatus WHERE l.l_partkey = source) FROM m
      UNION ALL SELECT source, target, 'groundings', (SELECT count(*) FROM lineitem WHERE l_partkey = source AND l_tax > 0.04), 0 FROM m""",
    "folded_members": "SELECT o_custkey AS circuit, o_orderstatus AS target, arg_min(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS id, count(*) - 1 AS folded FROM orders GROUP BY ALL",
    "folded_away": "SELECT circuit, target, kept, id FROM (SELECT o_custkey AS circuit, o_orderstatus AS target, o_orderkey AS id, first_value(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS kept FROM orders) WHERE id <> kept",
}
