"""Queries over circuits and decision tables, with the SQL that they compare with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import circuits as k
from ..operators import decisions as dec
from ..operators import graph as g
from ..operators import rules as u
from ..sources.adapters import CONN, EDGES, connections, regions, sparse_edges, table
from ..sources.readers import matrix_edges

DIRECTIONS = {"A": "supports", "N": "partial", "R": "contradicts"}
LAYERS = [("region", 0), ("nation", 0), ("customer", 1), ("supplier", 1), ("part", 2), ("orders", 3), ("lineitem", 4)]


def _violations(spark: SparkSession, d: str) -> DataFrame:
    """Orders as circuits, their lines as steps along parts, the parts as edges from brand to type."""
    line, part, supplier, orders = (table(spark, d, t) for t in ("lineitem", "part", "supplier", "orders"))
    pos = F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_returnflag").alias("pos")
    on = line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey)
    on = on.join(regions(spark, d), F.col("s_nationkey") == F.col("region_id"))
    dst = F.when(F.col("l_returnflag") == "R", "PROMO").otherwise(F.col("p_type"))
    steps = on.select(F.col("l_orderkey").alias("circuit"), pos, F.col("l_partkey").cast("string").alias("edge_id"), F.col("p_brand").alias("src"), dst.alias("dst"))
    members = on.select(F.col("l_orderkey").alias("circuit"), pos, F.col("name").alias("region"))
    edges = part.where("p_size > 2").select(F.col("p_partkey").cast("string").alias("edge_id"), F.col("p_brand").alias("src"), F.col("p_type").alias("dst"))
    nodes = regions(spark, d).where("parent <> 'ASIA'").select(F.col("name").alias("node"))
    circuits = orders.select(F.col("o_orderkey").alias("circuit"), (F.col("o_orderstatus") == "F").alias("closed"))
    return k.violations(circuits, members, steps, nodes, edges)


def _pre_scores(spark: SparkSession, d: str) -> DataFrame:
    edges = sparse_edges(spark, d)
    cycles = g.three_cycles(edges).select("key", F.lit(True).alias("closed"), F.array("a", "b", "c").alias("path"))
    typed = edges.withColumn("type", F.when(F.col("n") > 3, "projection").otherwise("unknown"))
    customers = table(spark, d, "customer").join(regions(spark, d), F.col("c_nationkey") == F.col("region_id"))
    domains = customers.where("c_acctbal > 9000").select(F.col("name").alias("node"), F.col("c_mktsegment").alias("domain"))
    return k.pre_score(cycles, typed, domains, g.hubs(edges, 10).select("node"))


def _contained(spark: SparkSession, d: str) -> DataFrame:
    edges = sparse_edges(spark, d)
    paths = g.simple_paths(edges, 3).union(g.simple_paths(edges, 4))
    return k.contained(paths.select(F.array_join("path", ">").alias("key"), F.lit("relay").alias("kind"), "path")).select("key", "parent")


def _quality(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as circuits, their turns as steps."""
    turns = table(spark, d, "conversations").withColumn("pos", F.struct("turn", "role", "text"))
    none = F.lit(None).cast("string")
    circuits = turns.groupBy(F.col("conv_id").alias("circuit")).agg(F.min_by("text", "pos").alias("evidence"), F.max_by("text", "pos").alias("description"), F.count(F.lit(1)).alias("n"))
    circuits = circuits.select(
        "circuit", "evidence", "description", F.lit("talk").alias("name"), F.when(F.col("n") > 2, "long").alias("type"), none.alias("atlas"), F.col("circuit").alias("resource"), F.when(F.col("n") > 3, F.col("n")).alias("batch"), none.alias("run")
    )
    role = F.when(F.col("role") == "user", "Origin").otherwise("Output")
    steps = turns.select(F.col("conv_id").alias("circuit"), "pos", role.alias("role"), F.when(F.col("turn") < 4, "region").alias("step_type"), F.col("text").alias("evidence"), F.col("role").alias("region"))
    return k.quality(circuits, steps)


def _adjusted(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    direction = F.element_at(F.create_map(*[F.lit(x) for p in DIRECTIONS.items() for x in p]), F.col("l_returnflag"))
    current = F.when(F.col("l_linenumber") > 1, F.col("l_discount") * 10)
    final, status = dec.adjusted_confidence(direction, current, F.col("l_tax") * 12.5)
    return line.groupBy(direction.alias("direction"), status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(final), 6).alias("mean"), F.max(final).alias("high"))


def _consensus(spark: SparkSession, d: str) -> DataFrame:
    a = F.when(F.col("l_returnflag") == "A", "support").when(F.col("l_returnflag") == "N", "reject").otherwise("uncertain")
    b = F.when(F.col("l_linestatus") == "O", "support").when(F.col("l_linenumber") == 2, "unknown").when(F.col("l_linenumber") > 1, "reject")
    status, score = dec.consensus(a, b, F.col("l_discount") * 10, F.when(F.col("l_linenumber") > 3, F.col("l_tax") * 10))
    rows = table(spark, d, "lineitem").select(status.alias("status"), score.alias("score"))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("scored"), F.round(F.avg("score"), 6).alias("mean"))


def _plan(spark: SparkSession, d: str) -> DataFrame:
    counts = None
    for name, layer in LAYERS:
        part = table(spark, d, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), F.lit(layer).alias("layer"), "n")
        counts = part if counts is None else counts.union(part)
    return dec.rollback_plan(counts, 2)


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    """A square matrix of evidence counts, as a file would hold it, back as edges."""
    names = [f"NATION_{n}" for n in range(25)]
    square = sparse_edges(spark, d).groupBy("src").pivot("dst", names).agg(F.first("n"))
    return matrix_edges(square, "src", least=20)


def _checked_connections(spark: SparkSession, d: str) -> DataFrame:
    rows = connections(spark, d).withColumn("species", F.when(F.col("species") == "EUROPE", "rodent").otherwise("human"))
    key = ["src", "dst", "type", "direction", "species"]
    rows = rows.where("src <> dst").withColumn("id", F.concat_ws(":", *key))
    canonical = rows.groupBy("id", *key).agg(F.count(F.lit(1)).alias("evidence_count"), F.count_if(F.col("confidence") > 0).alias("confidence_count"), F.min("evidence").alias("provenance"))
    canonical = canonical.withColumn("granularity", F.when(F.col("src") == "NATION_3", "meso").otherwise("macro"))
    lineage = rows.where("confidence > 0").groupBy("id", "run_id", "l_orderkey").agg(F.count(F.lit(1)).alias("cluster_size"), F.array("l_orderkey").alias("report_ids"))
    known = regions(spark, d).where("parent <> 'ASIA'").select(F.col("name").alias("region"))
    return u.check_connections(canonical, known, lineage, table(spark, d, "orders").where("o_totalprice > 1000").select(F.col("o_orderkey").alias("report_id")))


def _checked_candidates(spark: SparkSession, d: str) -> DataFrame:
    side = F.when(F.col("p_type") == "PROMO", "left").when(F.col("p_type") == "SMALL", "unknown").when(F.col("p_type") == "ECONOMY", "sideways").otherwise("right")
    none = F.lit(None).cast("string")
    return u.check_candidates(
        table(spark, d, "part").select(
            "p_partkey", F.lit(1).alias("run"), F.col("p_name").alias("raw_name"), none.alias("base_name"), F.when(F.col("p_size") > 5, F.col("p_brand")).alias("std_name"), side.alias("side"),
            F.when(F.col("p_size") > 2, "macro").alias("level"), F.lit("atlas").alias("family"), none.alias("label_id"), F.when(F.col("p_size") < 45, F.floor("p_retailprice")).alias("label_value"),
        )
    )


def _found(checked: DataFrame) -> DataFrame:
    """Counts of statuses and of broken rules."""
    return u.status_counts(checked).toDF("code", "n").union(u.summary(checked))


QUERIES = {
    "connection_rules": lambda s, d: _found(_checked_connections(s, d)),
    "candidate_rules": lambda s, d: _found(_checked_candidates(s, d)),
    "circuit_violations": _violations,
    "topology_pre_score": _pre_scores,
    "contained_paths": _contained,
    "circuit_quality": _quality,
    "adjusted_confidence": _adjusted,
    "model_consensus": _consensus,
    "rollback_plan": _plan,
    "rollback_risk": lambda s, d: dec.rollback_risk(_plan(s, d), ["lineitem"], ["orders"], ["part", "supplier"]),
    "matrix_edges": _matrix,
}

W = f"WITH {EDGES}"
_PLAN = " UNION ALL ".join(f"SELECT '{n}' AS relation, {layer} AS layer, count(*) AS n FROM {n}" for n, layer in LAYERS)
ORACLE_SQL = {
    "connection_rules": f"""WITH {CONN}, r AS (SELECT * REPLACE (CASE species WHEN 'EUROPE' THEN 'rodent' ELSE 'human' END AS species) FROM conn WHERE src <> dst),
      c AS (SELECT src, dst, type, direction, species, count(*) AS n, count(*) FILTER (confidence > 0) AS k, count(*) FILTER (confidence > 0 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 1000)) AS lost FROM r GROUP BY ALL),
      known AS (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'),
      x AS (SELECT src NOT IN (SELECT * FROM known) AS a, dst NOT IN (SELECT * FROM known) AS b, type = 'anatomical' AS t, direction = 'undirected' AS dd, species <> 'human' AS sp, src = 'NATION_3' AS g, k = 0 AS l, n <> k AS e, count(*) OVER (PARTITION BY src, dst, type) > 1 AS dup, lost > 0 AS m FROM c),
      s AS (SELECT *, CASE WHEN a OR b OR t OR dd OR sp OR g OR dup THEN 'failed' WHEN l OR e OR m THEN 'warning' ELSE 'passed' END AS status FROM x),
      u AS (SELECT status AS code FROM s UNION ALL SELECT 'src_region_exists' FROM s WHERE a UNION ALL SELECT 'tgt_region_exists' FROM s WHERE b UNION ALL SELECT 'connection_type_valid' FROM s WHERE t UNION ALL SELECT 'direction_valid' FROM s WHERE dd UNION ALL SELECT 'species_human' FROM s WHERE sp
        UNION ALL SELECT 'granularity_macro' FROM s WHERE g UNION ALL SELECT 'lineage_exists' FROM s WHERE l UNION ALL SELECT 'confidence_exists' FROM s WHERE l UNION ALL SELECT 'evidence_count_correct' FROM s WHERE e UNION ALL SELECT 'no_duplicate_key' FROM s WHERE dup UNION ALL SELECT 'traceable_to_mirror' FROM s WHERE m)
      SELECT code, count(*) AS n FROM u GROUP BY code""",
    "candidate_rules": """WITH p AS (SELECT *, CASE p_type WHEN 'PROMO' THEN 'left' WHEN 'SMALL' THEN 'unknown' WHEN 'ECONOMY' THEN 'sideways' ELSE 'right' END AS side, CASE WHEN p_size < 45 THEN floor(p_retailprice) END AS label FROM part),
      x AS (SELECT side = 'sideways' AS a, p_size <= 2 AS b, p_size <= 5 AS c, side = 'unknown' AS d, label IS NULL AS e, label IS NOT NULL AND count(*) OVER (PARTITION BY label) > 1 AS f, count(*) OVER (PARTITION BY lower(trim(p_name)), side) > 1 AS g FROM p),
      u AS (SELECT CASE WHEN a OR b THEN 'failed' WHEN c OR d OR e OR f OR g THEN 'warning' ELSE 'passed' END AS code FROM x UNION ALL SELECT 'laterality_validity' FROM x WHERE a UNION ALL SELECT 'granularity_coverage' FROM x WHERE b UNION ALL SELECT 'std_name_coverage' FROM x WHERE c
        UNION ALL SELECT 'laterality_coverage' FROM x WHERE d UNION ALL SELECT 'source_id_coverage' FROM x WHERE e UNION ALL SELECT 'duplicate_label_value' FROM x WHERE f UNION ALL SELECT 'duplicate_name_laterality' FROM x WHERE g)
      SELECT code, count(*) AS n FROM u GROUP BY code""",
    "circuit_violations": """WITH s AS (SELECT l_orderkey AS circuit, l_linenumber, l_suppkey, l_partkey, l_returnflag, p_brand AS src, CASE l_returnflag WHEN 'R' THEN 'PROMO' ELSE p_type END AS dst, p_type, p_size, r_name
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
      o AS (SELECT *, row_number() OVER (PARTITION BY circuit, l_partkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_returnflag) AS use, lead(src) OVER w AS next, first_value(src) OVER w AS head, row_number() OVER w AS nth, count(*) OVER (PARTITION BY circuit) AS steps
        FROM s WINDOW w AS (PARTITION BY circuit ORDER BY l_linenumber, l_suppkey, l_partkey, l_returnflag)),
      f AS (SELECT circuit, 'unknown_region' AS rule FROM s WHERE r_name = 'ASIA' UNION ALL SELECT circuit, 'duplicate_edge' FROM o WHERE use > 1 UNION ALL SELECT circuit, 'missing_edge' FROM o WHERE use = 1 AND p_size <= 2
        UNION ALL SELECT circuit, 'direction_mismatch' FROM o WHERE use = 1 AND p_size > 2 AND dst <> p_type UNION ALL SELECT circuit, 'discontinuous_order' FROM o WHERE dst <> next
        UNION ALL SELECT circuit, 'loop_not_closed' FROM o JOIN orders ON o_orderkey = circuit WHERE o_orderstatus = 'F' AND nth = steps AND dst <> head)
      SELECT circuit, rule, count(*) AS n FROM f GROUP BY ALL""",
    "topology_pre_score": f"""{W}, t AS (SELECT DISTINCT n_name AS node, c_mktsegment AS domain FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000),
      h AS (SELECT node FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node ORDER BY count(*) DESC, node LIMIT 10),
      c AS (SELECT x.src || '::' || x.dst || '::' || y.dst AS key, [x.src, x.dst, y.dst] AS p, (x.confidence + y.confidence + z.confidence) / 3 AS conf, x.n + y.n + z.n AS ev, (CASE WHEN x.n > 3 THEN 1 ELSE 0 END + CASE WHEN y.n > 3 THEN 1 ELSE 0 END + CASE WHEN z.n > 3 THEN 1 ELSE 0 END) / 3 AS typed
        FROM edges x JOIN edges y ON x.dst = y.src JOIN edges z ON y.dst = z.src AND z.dst = x.src WHERE x.src < x.dst AND x.src < y.dst),
      m AS (SELECT key, unnest(p) AS node FROM c), e AS (SELECT key, domain, count(*) AS k FROM m JOIN t USING (node) GROUP BY ALL), a AS (SELECT key, count(DISTINCT node) AS m FROM m JOIN t USING (node) GROUP BY key),
      s AS (SELECT key, a.m, count(*) FILTER (k = a.m) / count(*) AS share FROM e JOIN a USING (key) GROUP BY ALL), x AS (SELECT key, count(*) AS hubs FROM m JOIN h USING (node) GROUP BY key)
      SELECT key, round(least(greatest(0.25::DOUBLE + 0.25::DOUBLE * conf + 0.2::DOUBLE * least(1, ev / 10) + 0.15::DOUBLE * typed + 0.1::DOUBLE * CASE WHEN s.m IS NULL THEN 0.5::DOUBLE WHEN s.m = 1 THEN 0.7::DOUBLE ELSE share END - 0.05::DOUBLE * 0.5::DOUBLE * coalesce(hubs, 0) / 3, 0.0::DOUBLE), 1.0::DOUBLE), 6) AS score
      FROM c LEFT JOIN s USING (key) LEFT JOIN x USING (key)""",
    "contained_paths": f"""{W}, a AS (SELECT [x.src, x.dst, y.dst] AS p FROM edges x JOIN edges y ON x.dst = y.src WHERE y.dst <> x.src),
      b AS (SELECT [x.src, x.dst, y.dst, z.dst] AS p FROM edges x JOIN edges y ON x.dst = y.src JOIN edges z ON y.dst = z.src WHERE y.dst <> x.src AND z.dst <> x.src AND z.dst <> x.dst),
      l AS (SELECT s, min(array_to_string(p, '>')) AS parent FROM (SELECT p[1:3] AS s, p FROM b UNION ALL SELECT p[2:4], p FROM b) GROUP BY s)
      SELECT array_to_string(p, '>') AS key, parent FROM a LEFT JOIN l ON l.s = a.p UNION ALL SELECT array_to_string(p, '>'), NULL FROM b""",
    "circuit_quality": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
      c AS (SELECT conv_id AS circuit, max(n) AS n, max(text) FILTER (k = 1) AS ev, max(text) FILTER (k = n) AS de, max(role) FILTER (k = 1) AS fi, max(role) FILTER (k = n) AS la, bool_and(turn < 4) AS valid, count(*) FILTER (length(text) >= 10) AS proved, count(DISTINCT role) AS regions FROM o GROUP BY conv_id)
      SELECT circuit, round(least(100, (1 + CASE WHEN n > 2 THEN 1 ELSE 0 END + CASE WHEN length(ev) >= 10 THEN 1 ELSE 0 END + CASE WHEN length(de) >= 10 THEN 1 ELSE 0 END) / 5 * 30 + 7 + CASE WHEN n > 3 THEN 7 ELSE 0 END
        + CASE WHEN n >= 2 THEN 5 ELSE 0 END + CASE WHEN fi = 'user' THEN 5 ELSE 0 END + CASE WHEN la <> 'user' THEN 5 ELSE 0 END + CASE WHEN valid THEN 5 ELSE 0 END
        + CASE WHEN length(ev) >= 50 THEN 10 WHEN length(ev) >= 10 THEN 5 ELSE 0 END + CASE WHEN proved >= n * 0.5 THEN 10 WHEN proved > 0 THEN 5 ELSE 0 END + CASE WHEN regions >= 2 THEN 10 WHEN regions = 1 THEN 5 ELSE 0 END), 1) AS score FROM c""",
    "adjusted_confidence": """WITH x AS (SELECT CASE l_returnflag WHEN 'A' THEN 'supports' WHEN 'N' THEN 'partial' ELSE 'contradicts' END AS direction, coalesce(CASE WHEN l_linenumber > 1 THEN l_discount * 10 END, 0) AS cur, least(greatest(l_tax * 12.5::DOUBLE, 0), 1) AS rev FROM lineitem),
      y AS (SELECT direction, CASE WHEN direction = 'contradicts' THEN 'pending' WHEN rev >= cur THEN 'applied' ELSE 'no_change_weak_evidence' END AS status, CASE WHEN direction = 'supports' AND rev >= cur THEN least(0.85::DOUBLE, rev) WHEN direction = 'partial' AND rev >= cur THEN least(0.75::DOUBLE, rev) ELSE cur END AS f FROM x)
      SELECT direction, status, count(*) AS n, round(avg(f), 6) AS mean, max(f) AS high FROM y GROUP BY ALL""",
    "model_consensus": """WITH x AS (SELECT CASE l_returnflag WHEN 'A' THEN 'support' WHEN 'N' THEN 'reject' ELSE 'uncertain' END AS a, CASE WHEN l_linestatus = 'O' THEN 'support' WHEN l_linenumber = 2 THEN 'unknown' WHEN l_linenumber > 1 THEN 'reject' END AS b, l_discount * 10 AS ca, CASE WHEN l_linenumber > 3 THEN l_tax * 10 END AS cb FROM lineitem),
      y AS (SELECT *, CASE WHEN ca IS NOT NULL AND cb IS NOT NULL THEN (ca + cb) / 2 ELSE coalesce(ca, cb) END AS m FROM x),
      z AS (SELECT CASE WHEN b IS NULL THEN 'insufficient_information' WHEN a = 'support' AND b = 'support' THEN 'consensus_supported' WHEN a = 'reject' AND b = 'reject' THEN 'consensus_rejected' WHEN a IN ('support', 'reject') AND b IN ('support', 'reject') THEN 'model_conflict'
          WHEN a = 'uncertain' AND b = 'unknown' THEN 'insufficient_information' ELSE 'needs_human_review' END AS status,
        round(CASE WHEN b IS NULL THEN NULL WHEN a = b THEN least(0.95::DOUBLE, coalesce(m, 0.5::DOUBLE) + 0.1::DOUBLE) WHEN a IN ('support', 'reject') AND b IN ('support', 'reject') THEN least(ca, cb) ELSE m END, 3) AS score FROM y)
      SELECT status, count(*) AS n, count(score) AS scored, round(avg(score), 6) AS mean FROM z GROUP BY status""",
    "rollback_plan": f"SELECT *, CASE WHEN layer > 2 THEN n ELSE 0 END AS remove, CASE WHEN layer > 2 THEN 0 ELSE n END AS keep FROM ({_PLAN})",
    "rollback_risk": f"SELECT CASE WHEN sum(n) FILTER (relation = 'lineitem') > 0 THEN 'critical' WHEN sum(n) FILTER (relation = 'orders') > 0 THEN 'high' ELSE 'low' END AS risk, CAST(sum(n) AS BIGINT) AS removed FROM ({_PLAN}) WHERE layer > 2",
    "matrix_edges": f"{W} SELECT src, dst, CAST(n AS DOUBLE) AS weight FROM edges WHERE n >= 20",
}
