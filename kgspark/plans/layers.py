"""Queries over rules, merges, reviews and listings, with the SQL that they compare with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge as m
from ..operators import review as v
from ..operators import rules as u
from ..sources.adapters import CONN, EDGES, connections, regions, sparse_edges, table


def _checked(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    names = part.groupBy("p_name").agg(F.count(F.lit(1)).alias("_same"))
    rows = part.join(names, "p_name")
    return u.check(
        rows,
        [
            u.Rule("EMPTY_NAME", "blocked", F.trim("p_name") == ""),
            u.Rule("DUPLICATE_NAME", "warning", F.col("_same") > 30),
            u.Rule("ODD_TYPE", "failed", ~F.col("p_type").isin("ECONOMY", "STANDARD", "PROMO", "SMALL")),
            u.Rule("PRICE_RANGE", "blocked", F.col("p_retailprice") > 1080),
            u.Rule("SIZE_RANGE", "warning", F.col("p_size") > 45),
        ],
    )


def _integrity(spark: SparkSession, d: str) -> DataFrame:
    orders, line, customer = (table(spark, d, t) for t in ("orders", "lineitem", "customer"))
    some = customer.where("c_acctbal > 0")
    return (
        u.orphans(orders, "o_custkey", some, "c_custkey", "order_without_customer")
        .union(u.orphans(line, "l_partkey", table(spark, d, "part").where("p_size > 2"), "p_partkey", "line_without_part"))
        .union(u.repeated(line, ["l_orderkey", "l_linenumber"], "duplicate_line"))
    )


def _anomalies(spark: SparkSession, d: str) -> DataFrame:
    return u.outside(table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"], "priority").union(
        u.outside(table(spark, d, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"], "segment")
    )


def _kept(spark: SparkSession, d: str) -> DataFrame:
    rows = connections(spark, d).where("src <> dst").select("src", "dst", "type", "confidence", "evidence", "l_orderkey", "l_linenumber", "l_suppkey")
    return m.keep_best(rows, ["src", "dst", "type"], [F.desc("confidence"), "l_orderkey", "l_linenumber", "l_suppkey", "evidence"]).select("src", "dst", "type", "confidence", "l_orderkey", "merged")


def _year(spark: SparkSession, d: str, run: str) -> DataFrame:
    rows = connections(spark, d).where(run).where("src <> dst")
    return rows.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))


def _upsert(spark: SparkSession, d: str) -> DataFrame:
    return m.upsert(_year(spark, d, "run_id < 1998"), _year(spark, d, "run_id = 1999"), ["src", "dst"])


def _insert_missing(spark: SparkSession, d: str) -> DataFrame:
    return m.insert_missing(_year(spark, d, "run_id = 1997"), _year(spark, d, "run_id = 1999"), ["src", "dst"])


def _difference(spark: SparkSession, d: str) -> DataFrame:
    return m.difference(_year(spark, d, "run_id = 1999"), _year(spark, d, "run_id = 1998"), ["src", "dst"], "confidence")


def _triples(spark: SparkSession, d: str) -> DataFrame:
    rows = connections(spark, d).where("src <> dst")
    return m.triples(
        rows.where("direction = 'directed'").select("src", F.concat(F.lit("projects_"), "type"), "dst"),
        rows.where("confidence > 0.7").select("src", F.concat(F.lit("projects_"), "type"), "dst"),
        regions(spark, d).select("name", F.lit("part_of"), "parent"),
    )


def _codes(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return m.numbered_codes(part.select("p_partkey", "p_name"), F.regexp_replace("p_name", " ", "_"), [F.col("p_partkey")]).select("p_partkey", "code")


def _overlay(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    fixes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment"))
    return m.overlay(customer, fixes, "c_custkey", ["c_name", "c_mktsegment"])


def _lineage(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    canonical = orders.where("o_custkey is not null").groupBy(F.col("o_custkey").alias("canonical_id"), "o_orderdate").agg(F.collect_list("o_orderkey").alias("ids"))
    source = orders.select("o_orderkey", "o_orderstatus")
    return m.lineage(canonical, source, "ids", "o_orderkey").groupBy("canonical_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("o_orderstatus").alias("statuses"))


def _adjudication(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    ca, cb = F.col("doc_id") % 10 / 10, F.col("doc_id") % 7 / 10
    outcome = v.adjudicate(F.col("quality"), 1 - F.col("toxic"), ca, cb)
    return labels.select(outcome.alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def _work(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderpriority") == "1-URGENT", "running").when(F.col("o_orderpriority") == "2-HIGH", "waiting").otherwise("failed")
    return v.work_status(table(spark, d, "orders").withColumn("state", state), "o_custkey", "state")


def _listing(spark: SparkSession, d: str) -> DataFrame:
    rows = v.filtered(table(spark, d, "part"), {"p_type": "PROMO", "p_brand": None}, "ring", ("p_name", "p_brand"))
    return v.page(rows.select("p_partkey", "p_name", "p_retailprice"), [F.desc_nulls_last("p_retailprice"), F.col("p_partkey")], 5, 20)


def _subgraph(spark: SparkSession, d: str) -> DataFrame:
    nodes = regions(spark, d).where("parent in ('ASIA', 'EUROPE')").select(F.col("name").alias("node"))
    return v.subgraph(nodes, sparse_edges(spark, d)).select("src", "dst", "n")


def _claims(spark: SparkSession, d: str) -> DataFrame:
    direction = F.when(F.col("event_type") == "click", "supports").when(F.col("event_type") == "error", "contradicts").otherwise("neutral")
    return v.claim_coverage(table(spark, d, "events").select(F.col("user_id").alias("claim"), (F.col("event_id") % 5).alias("component"), direction.alias("direction")))


def _usage(spark: SparkSession, d: str) -> DataFrame:
    return v.usage_average(table(spark, d, "events").withColumn("pairs", (F.col("event_id") % 4).cast("int")), "event_type", "value", "pairs")


def _dashboard(spark: SparkSession, d: str) -> DataFrame:
    by = lambda name, key: table(spark, d, name).groupBy(key).agg(F.count(F.lit(1)))
    return v.dashboard(orders=by("orders", "o_orderstatus"), segments=by("customer", "c_mktsegment"), roles=by("conversations", "role"), events=by("events", "event_type"))


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return m.manifest(nodes=regions(spark, d), edges=sparse_edges(spark, d), reports=connections(spark, d))


QUERIES = {
    "rule_summary": lambda s, d: u.summary(_checked(s, d)),
    "rule_status": lambda s, d: u.status_counts(_checked(s, d)),
    "integrity_checks": _integrity,
    "enum_anomalies": _anomalies,
    "keep_best": _kept,
    "upsert": _upsert,
    "insert_missing": _insert_missing,
    "difference": _difference,
    "triples": _triples,
    "hierarchy_candidates": lambda s, d: m.token_parents(table(s, d, "part").select(F.col("p_name").alias("term")).union(table(s, d, "part").select(F.element_at(F.split("p_name", " "), -1)))),
    "numbered_codes": _codes,
    "effective_view": _overlay,
    "lineage": _lineage,
    "export_manifest": _manifest,
    "adjudication": _adjudication,
    "work_status": _work,
    "filtered_listing": _listing,
    "subgraph": _subgraph,
    "step_pairs": lambda s, d: v.step_pairs(table(s, d, "conversations"), "conv_id", "turn", "role"),
    "sessions": lambda s, d: v.sessions(table(s, d, "events"), "user_id", "ts", 600),
    "event_windows": lambda s, d: v.windowed(table(s, d, "events"), 360),
    "rolling_context": lambda s, d: v.rolling(table(s, d, "events"), "user_id", 3),
    "claim_coverage": _claims,
    "usage_average": _usage,
    "dashboard": _dashboard,
    "json_field": lambda s, d: v.json_field(table(s, d, "events"), "props", "$.k"),
}

_RULES = """WITH c AS (SELECT *, count(*) OVER (PARTITION BY p_name) AS same FROM part), f AS (SELECT p_partkey, trim(p_name) = '' AS a, same > 30 AS b, p_type NOT IN ('ECONOMY', 'STANDARD', 'PROMO', 'SMALL') AS c, p_retailprice > 1080 AS d, p_size > 45 AS e FROM c)"""
_YEARS = f"WITH {CONN}, a AS (SELECT src, dst, max(confidence) AS confidence FROM conn WHERE src <> dst AND {{0}} GROUP BY ALL), b AS (SELECT src, dst, max(confidence) AS confidence FROM conn WHERE src <> dst AND {{1}} GROUP BY ALL)"
ORACLE_SQL = {
    "rule_summary": f"{_RULES} SELECT * FROM (SELECT unnest(['EMPTY_NAME', 'DUPLICATE_NAME', 'ODD_TYPE', 'PRICE_RANGE', 'SIZE_RANGE']) AS code, unnest([count(*) FILTER (a), count(*) FILTER (b), count(*) FILTER (c), count(*) FILTER (d), count(*) FILTER (e)]) AS n FROM f) WHERE n > 0",
    "rule_status": f"{_RULES} SELECT CASE WHEN a OR d THEN 'blocked' WHEN c THEN 'failed' WHEN b OR e THEN 'warning' ELSE 'passed' END AS status, count(*) AS n FROM f GROUP BY 1",
    "integrity_checks": "SELECT 'order_without_customer' AS issue, CAST(o_custkey AS VARCHAR) AS key FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'line_without_part', CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2) UNION ALL SELECT 'duplicate_line', l_orderkey || ':' || l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "enum_anomalies": "SELECT 'priority' AS issue, o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 2 UNION ALL SELECT 'segment', c_mktsegment, count(*) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') GROUP BY 2",
    "keep_best": f"WITH {CONN} SELECT src, dst, type, confidence, l_orderkey, merged FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, type ORDER BY confidence DESC, l_orderkey, l_linenumber, l_suppkey, evidence) AS k, count(*) OVER (PARTITION BY src, dst, type) AS merged FROM conn WHERE src <> dst) WHERE k = 1",
    "upsert": f"{_YEARS.format('run_id < 1998', 'run_id = 1999')} SELECT coalesce(b.src, a.src) AS src, coalesce(b.dst, a.dst) AS dst, coalesce(b.confidence, a.confidence) AS confidence FROM a FULL JOIN b ON a.src = b.src AND a.dst = b.dst",
    "insert_missing": f"{_YEARS.format('run_id = 1997', 'run_id = 1999')} SELECT * FROM a UNION ALL SELECT b.* FROM b ANTI JOIN a ON a.src = b.src AND a.dst = b.dst",
    "difference": f"{_YEARS.format('run_id = 1999', 'run_id = 1998')} SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, CASE WHEN b.src IS NULL THEN 'insert' WHEN a.src IS NULL THEN 'delete' WHEN a.confidence IS DISTINCT FROM b.confidence THEN 'update' ELSE 'keep' END AS action FROM a FULL JOIN b ON a.src = b.src AND a.dst = b.dst",
    "triples": f"WITH {CONN}, s AS (SELECT DISTINCT src, 'projects_' || type AS p, dst, 1 AS k FROM conn WHERE src <> dst AND direction = 'directed' UNION SELECT src, 'projects_' || type, dst, 2 FROM conn WHERE src <> dst AND confidence > 0.7 UNION SELECT n_name, 'part_of', r_name, 3 FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT src AS subject, p AS predicate, dst AS object, count(*) AS sources FROM s GROUP BY ALL",
    "hierarchy_candidates": "WITH t AS (SELECT DISTINCT unnest([p_name, split_part(p_name, ' ', -1)]) AS term FROM part), w AS (SELECT term, list_distinct(string_split(term, ' ')) AS w FROM t), p AS (SELECT a.term AS child, b.term AS parent, round(len(b.w) / len(a.w), 4) AS score FROM w a, w b WHERE len(b.w) < len(a.w) AND list_has_all(a.w, b.w)), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY child ORDER BY score DESC, parent) AS INTEGER) AS k FROM p) SELECT * FROM k WHERE k <= 10",
    "numbered_codes": "SELECT p_partkey, CASE WHEN k = 1 THEN b ELSE b || '_' || k END AS code FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS b, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)",
    "effective_view": "SELECT c_custkey, coalesce(s_name, c_name) AS c_name, c_mktsegment FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey",
    "lineage": "SELECT o_custkey AS canonical_id, count(*) AS rows, count(DISTINCT o_orderstatus) AS statuses FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1",
    "export_manifest": f"WITH {EDGES} SELECT 'nodes' AS part, count(*) AS rows FROM nation UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'reports', count(*) FROM conn",
    "adjudication": "WITH x AS (SELECT quality AS a, 1 - toxic AS b, CAST(doc_id % 10 AS DOUBLE) / 10 AS ca, CAST(doc_id % 7 AS DOUBLE) / 10 AS cb FROM labels) SELECT CASE WHEN a IS NULL OR b IS NULL THEN 'insufficient' WHEN ca < 0.4::DOUBLE OR cb < 0.4::DOUBLE THEN 'low_evidence' WHEN a = 1 AND b = 1 AND abs(ca - cb) < 0.3::DOUBLE THEN 'consensus' WHEN a <> b THEN 'conflict' ELSE 'insufficient' END AS outcome, count(*) AS n FROM x GROUP BY 1",
    "work_status": "WITH s AS (SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderpriority = '1-URGENT' THEN 'running' WHEN o_orderpriority = '2-HIGH' THEN 'waiting' ELSE 'failed' END AS state FROM orders), g AS (SELECT o_custkey, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'waiting') AS waiting, count(*) AS total FROM s GROUP BY 1) SELECT *, CASE WHEN running > 0 THEN 'processing' WHEN waiting > 0 THEN 'awaiting_review' WHEN failed = total THEN 'failed' WHEN failed > 0 THEN 'partially_failed' ELSE 'completed' END AS status FROM g",
    "filtered_listing": "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_type = 'PROMO' AND (p_name ILIKE '%ring%' OR p_brand ILIKE '%ring%') ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 20 OFFSET 5",
    "subgraph": f"WITH {EDGES}, k AS (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')) SELECT src, dst, n FROM edges WHERE src IN (SELECT * FROM k) AND dst IN (SELECT * FROM k)",
    "step_pairs": "SELECT * FROM (SELECT conv_id, turn, role AS step, lead(role) OVER w AS next, lead(turn) OVER w - turn AS gap FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE next IS NOT NULL",
    "sessions": "WITH a AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 36000000000 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM a) SELECT user_id, session, count(*) AS events, min(ts) AS start, max(ts) AS \"end\" FROM b GROUP BY ALL",
    "event_windows": "SELECT time_bucket(INTERVAL 360 MINUTE, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "rolling_context": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS mean FROM events",
    "claim_coverage": "WITH e AS (SELECT user_id AS claim, event_id % 5 AS component, CASE event_type WHEN 'click' THEN 'supports' WHEN 'error' THEN 'contradicts' ELSE 'neutral' END AS direction FROM events), g AS (SELECT claim, CAST(count(DISTINCT component) AS INTEGER) AS required, CAST(count(DISTINCT component) FILTER (direction = 'supports') AS INTEGER) AS supported, CAST(count(DISTINCT component) FILTER (direction = 'contradicts') AS INTEGER) AS contradicted FROM e GROUP BY claim) SELECT *, round(supported / required, 4) AS ratio, supported > 0 AND contradicted > 0 AS conflict, CASE WHEN supported = 0 AND contradicted = 0 THEN 'not_found' WHEN supported > 0 AND contradicted > 0 THEN 'mixed' WHEN supported = required THEN 'supports' WHEN contradicted > 0 THEN 'contradicts' ELSE 'partial' END AS overall FROM g",
    "usage_average": "SELECT event_type, round(avg(value / greatest(event_id % 4, 1)), 4) AS average, count(*) AS n FROM events GROUP BY 1",
    "dashboard": "SELECT 'orders' AS metric, o_orderstatus AS key, count(*) AS value FROM orders GROUP BY 2 UNION ALL SELECT 'segments', c_mktsegment, count(*) FROM customer GROUP BY 2 UNION ALL SELECT 'roles', role, count(*) FROM conversations GROUP BY 2 UNION ALL SELECT 'events', event_type, count(*) FROM events GROUP BY 2",
    "json_field": "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS field, count(*) AS n FROM events GROUP BY 1",
}
