"""Queries over the building blocks of listings, with the SQL that they compare with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import mapped
from ..operators import listings as x
from ..sources.adapters import CONN, connections, table

TYPES = list(x.CANONICAL_TYPES)


def _excerpts(spark: SparkSession, d: str) -> DataFrame:
    words = F.array_join(x.first_items(F.split("text", " ")), " ")
    return table(spark, d, "documents").select("doc_id", x.excerpt("text").alias("head"), words.alias("first_words"))


def _type_maps(spark: SparkSession, d: str) -> DataFrame:
    """Lines dealt to the types by their numbers."""
    label = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("l_linenumber") % len(TYPES) + 1).cast("int"))
    kinds = table(spark, d, "lineitem").groupBy(label.alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.select("type", "n", mapped(F.col("type"), x.CLUSTER_TYPES).alias("cluster_type"), mapped(F.col("type"), x.CANONICAL_TYPES).alias("canonical_type"))


def _orders_of(spark: SparkSession, d: str) -> DataFrame:
    """Customers with the numbers of a day's orders as a JSON array."""
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderdate").agg(F.to_json(F.sort_array(F.collect_list("o_orderkey"))).alias("ids"))


def _holding(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their few parts as a JSON array."""
    parts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_set("l_partkey")).alias("parts"))
    return parts.select("l_orderkey", x.json_holds("parts", F.lit(42)).alias("holds"))


def _latest(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return x.with_latest(table(spark, d, "customer").select("c_custkey"), orders, "c_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


def _sources(spark: SparkSession, d: str) -> DataFrame:
    counted = x.source_counts(connections(spark, d), ["src", "dst"], "evidence")
    return counted.select("src", "dst", F.array_join(F.transform(F.map_entries("sources"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("sources"))


def _peers(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return x.peer_counts(orders, "o_custkey", F.col("o_orderstatus") == "F").select("o_orderkey", "peers")


def _unresolved(spark: SparkSession, d: str) -> DataFrame:
    open_ = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderpriority").alias("reason"), "o_orderdate", "o_orderkey")
    return x.report(open_, "reason", "o_orderdate", "o_orderkey", 100).select("reason", "o_orderkey")


QUERIES = {
    "excerpts": _excerpts,
    "type_maps": _type_maps,
    "json_containment": _holding,
    "latest_order": _latest,
    "group_size_histogram": lambda s, d: x.group_sizes(table(s, d, "orders"), "o_custkey"),
    "merge_reasons": lambda s, d: x.merge_reasons(connections(s, d), ["src", "dst", "type", "run_id"], ["src_side", "dst_side"]),
    "source_distribution": _sources,
    "similar_prefixes": lambda s, d: x.similar_prefixes(table(s, d, "part"), "p_name"),
    "peer_counts": _peers,
    "coverage_back_fill": lambda s, d: x.back_filled(_orders_of(s, d), "ids", "o_custkey", table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), "o_orderkey"),
    "unresolved_report": _unresolved,
}

ORACLE_SQL = {
    "excerpts": "SELECT doc_id, substr(text, 1, 200) AS head, array_to_string(string_split(text, ' ')[1:10], ' ') AS first_words FROM documents",
    "type_maps": f"""WITH t AS (SELECT ({TYPES})[l_linenumber % {len(TYPES)} + 1] AS type FROM lineitem) SELECT type, count(*) AS n,
      CASE type WHEN 'structural_connection' THEN 'structural' WHEN 'functional_connectivity' THEN 'functional' WHEN 'uncertain_connection' THEN 'uncertain' WHEN 'projection' THEN 'projection' WHEN 'association' THEN 'association' END AS cluster_type,
      CASE WHEN type IN ('structural_connection', 'projection') THEN 'structural' WHEN type IN ('functional_connectivity', 'effective_connectivity') THEN 'functional' WHEN type IN ('uncertain_connection', 'unknown') THEN 'uncertain' ELSE type END AS canonical_type
      FROM t GROUP BY type""",
    "json_containment": "SELECT l_orderkey, bool_or(l_partkey = 42) AS holds FROM lineitem GROUP BY l_orderkey",
    "latest_order": """SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
      ON o_custkey = c_custkey AND k = 1""",
    "group_size_histogram": "SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM orders GROUP BY o_custkey) GROUP BY size",
    "merge_reasons": f"""WITH {CONN}, g AS (SELECT src, dst, type, run_id, count(DISTINCT src_side || dst_side) AS patterns, count(*) AS n FROM conn GROUP BY ALL)
      SELECT *, CASE WHEN patterns > 1 THEN 'hemisphere_specific' WHEN n > 1 THEN 'duplicate_evidence' ELSE 'single' END AS reason FROM g""",
    "source_distribution": f"""WITH {CONN}, g AS (SELECT src, dst, evidence, count(*) AS n FROM conn WHERE evidence IS NOT NULL GROUP BY ALL)
      SELECT src, dst, string_agg(evidence || '=' || n, ';' ORDER BY evidence) AS sources FROM g GROUP BY src, dst""",
    "similar_prefixes": """WITH n AS (SELECT DISTINCT p_name AS x FROM part WHERE length(p_name) >= 2),
      p AS (SELECT a.x AS a, b.x AS b, round(len(list_filter(range(1, least(length(a.x), length(b.x)) + 1), lambda i: substr(a.x, 1, i) = substr(b.x, 1, i))) / greatest(length(a.x), length(b.x)), 2) AS similarity
        FROM n a JOIN n b ON a.x < b.x AND substr(a.x, 1, 2) = substr(b.x, 1, 2)) SELECT * FROM p WHERE similarity >= 0.5""",
    "peer_counts": "SELECT o_orderkey, count(*) FILTER (o_orderstatus = 'F') OVER (PARTITION BY o_custkey) - CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS peers FROM orders",
    "coverage_back_fill": "SELECT l_orderkey AS o_orderkey, l_linenumber, o_custkey FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey",
    "unresolved_report": "SELECT o_orderpriority AS reason, o_orderkey FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey LIMIT 100",
}
