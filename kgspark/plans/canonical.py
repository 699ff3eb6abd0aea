"""Queries over grounding and canonicalization, with the SQL that they compare with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import canonical as c
from ..sources.adapters import table

FOREIGN = ["1-URGENT"]


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Orders as raw connections from a customer to a supplier; names are spelled in several ways."""
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dst_candidate"), F.concat(F.lit("NATION-"), F.col("s_nationkey")).alias("dst_cn"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("dst_en"))
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    line = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("dst_candidate"), F.max("l_discount").alias("confidence"))
    on = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(line, "o_orderkey").join(suppliers, "dst_candidate")
    name = F.concat(F.lit("NATION_"), F.col("c_nationkey"))
    spelled = F.when(F.col("o_custkey") % 4 == 0, F.lower(name)).when(F.col("o_custkey") % 4 == 1, F.replace(name, F.lit("_"), F.lit(" - "))).when(F.col("o_custkey") % 4 == 2, F.concat(F.lit("N"), F.col("c_nationkey")))
    return on.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("src_candidate"),
        "dst_candidate",
        spelled.alias("src_en"),
        F.lit(None).cast("string").alias("src_cn"),
        "dst_en",
        "dst_cn",
        F.col("o_orderpriority").alias("atlas"),
        F.when(F.col("o_orderstatus") == "F", "projection").when(F.year("o_orderdate") < 1996, "weak_link").when(F.col("o_orderstatus") == "O", "coactivation").alias("type"),
        F.when(F.month("o_orderdate") < 5, "source_to_target").when(F.month("o_orderdate") == 5, "bidirectional").when(F.month("o_orderdate") < 8, "undirected").otherwise("").alias("direction"),
        "confidence",
    )


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Customers of a good balance are grounded by themselves."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("candidate"), F.when(F.col("c_acctbal") > 5000, F.col("c_nationkey")).alias("region"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    regions = nation.where("n_nationkey <> 3").select(F.col("n_nationkey").alias("region"), F.col("n_name").alias("en"), F.replace("n_name", F.lit("_"), F.lit(" ")).alias("cn"))
    return c.name_keys(regions, nation.select(F.col("n_nationkey").alias("region"), F.concat(F.lit("N"), F.col("n_nationkey")).alias("alias")))


def _grounded(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    coverage = orders.where("o_orderkey % 50 = 7").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), F.col("o_custkey")).alias("canonical"))
    pairs = table(spark, d, "nation").select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).cast("int").alias("dst"))
    canonical = pairs.select("src", "dst", F.lit("structural").alias("type"), F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string")).alias("canonical"))
    return c.grounded(_raw(spark, d), coverage, _candidates(spark, d), _names(spark, d), canonical, FOREIGN)


def _ends(spark: SparkSession, d: str) -> DataFrame:
    """The same rows between the nations of both ends."""
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dst_candidate"), F.col("s_nationkey").alias("dst"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("src_candidate"), F.col("c_nationkey").alias("src"))
    return _raw(spark, d).join(suppliers, "dst_candidate").join(customers, "src_candidate")


QUERIES = {
    "connection_grounding": _grounded,
    "canonical_connections": lambda s, d: c.canonicalized(_ends(s, d)).withColumn("atlases", F.array_join("atlases", ",")),
    "connections_set_aside": lambda s, d: c.set_aside(_ends(s, d)),
    "connection_lineage": lambda s, d: c.lineage(_ends(s, d)),
}

_TYPE = "CASE WHEN coalesce({0}, '') = '' THEN 'uncertain' ELSE map_extract(MAP {{" + ", ".join(f"'{k}': '{v}'" for k, v in c.TYPES.items()) + "}}, {0})[1] END"
_WAY = "CASE WHEN coalesce({0}, '') = '' THEN 'unspecified' ELSE map_extract(MAP {{" + ", ".join(f"'{k}': '{v}'" for k, v in c.DIRECTIONS.items()) + "}}, {0})[1] END"
_RAW = f"""WITH line AS (SELECT l_orderkey, min(l_suppkey) AS dst_candidate, max(l_discount) AS confidence FROM lineitem GROUP BY 1),
  raw AS (SELECT o_orderkey AS id, o_custkey AS src_candidate, dst_candidate, CASE o_custkey % 4 WHEN 0 THEN 'nation_' || c_nationkey WHEN 1 THEN 'NATION - ' || c_nationkey WHEN 2 THEN 'N' || c_nationkey END AS src_en, 'n' || s_nationkey AS dst_en, 'NATION-' || s_nationkey AS dst_cn,
    o_orderpriority AS atlas, CASE WHEN o_orderstatus = 'F' THEN 'projection' WHEN year(o_orderdate) < 1996 THEN 'weak_link' WHEN o_orderstatus = 'O' THEN 'coactivation' END AS raw_type, CASE WHEN month(o_orderdate) < 5 THEN 'source_to_target' WHEN month(o_orderdate) = 5 THEN 'bidirectional' WHEN month(o_orderdate) < 8 THEN 'undirected' ELSE '' END AS raw_direction,
    confidence, c_acctbal, c_nationkey, s_nationkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN line ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = dst_candidate),
  typed AS (SELECT *, {_TYPE.format('raw_type')} AS type, {_WAY.format('raw_direction')} AS direction FROM raw)"""
_JUDGED = f"{_RAW}, judged AS (SELECT id, c_nationkey AS src, s_nationkey AS dst, atlas, type, direction, raw_type, raw_direction, confidence, CASE WHEN type IS NULL OR direction IS NULL THEN 'unmapped' WHEN c_nationkey = s_nationkey THEN 'self_loop' END AS problem FROM typed)"
ORACLE_SQL = {
    # customers resolve by themselves, or by exact name, by flattened name, by alias; suppliers by flattened name or alias
    "connection_grounding": f"""{_RAW}, cand AS (SELECT c_custkey AS k, CASE WHEN c_acctbal > 5000 THEN c_nationkey END AS region FROM customer),
      ends AS (SELECT t.*, a.region AS sg, b.region AS dg, atlas = '1-URGENT' AS far, CASE WHEN o4 = 0 AND c_nationkey <> 3 THEN 'name_canonical_exact' WHEN o4 = 1 AND c_nationkey <> 3 THEN 'name_normalized_exact' WHEN o4 = 2 THEN 'name_alias_exact' END AS sn, CASE WHEN s_nationkey <> 3 THEN 'name_normalized_exact' ELSE 'name_alias_exact' END AS dn
        FROM (SELECT *, src_candidate % 4 AS o4 FROM typed) t LEFT JOIN cand a ON a.k = src_candidate LEFT JOIN cand b ON b.k = dst_candidate),
      got AS (SELECT id, src_candidate, dst_candidate, type, direction, confidence, atlas, coalesce(sg, CASE WHEN NOT far AND sn IS NOT NULL THEN c_nationkey END) AS src, coalesce(dg, CASE WHEN NOT far THEN s_nationkey END) AS dst, CASE WHEN sg IS NOT NULL THEN 'candidate_grounded' WHEN NOT far THEN sn END AS src_method, CASE WHEN dg IS NOT NULL THEN 'candidate_grounded' WHEN NOT far THEN dn END AS dst_method, sg, dg FROM ends),
      judged AS (SELECT *, CASE WHEN src_candidate = dst_candidate THEN 'self_loop' WHEN src IS NULL OR dst IS NULL THEN CASE WHEN atlas = '1-URGENT' THEN 'species_mismatch' ELSE 'no_name_match' END WHEN src = dst THEN 'self_loop' WHEN type IS NULL OR direction IS NULL THEN 'mapping_error' END AS reason FROM got),
      open AS (SELECT j.*, CASE WHEN type = 'structural' AND dst = (src * 7 + 3) % 25 THEN src || '>' || dst END AS canonical FROM judged j WHERE id % 50 <> 7 AND reason IS NULL),
      new AS (SELECT *, CASE WHEN canonical IS NULL THEN min(id) FILTER (canonical IS NULL) OVER (PARTITION BY src, dst, type) END AS created_by FROM open)
      SELECT id, 'grounded' AS kind, 'c' || src_candidate AS canonical, NULL::BIGINT AS created_by, sg AS src, dg AS dst, 'candidate_grounded' AS src_method, 'candidate_grounded' AS dst_method, NULL AS type, NULL AS direction, NULL AS reason, confidence FROM judged WHERE id % 50 = 7
      UNION ALL SELECT id, CASE WHEN created_by = id THEN 'create' ELSE 'grounded' END, canonical, created_by, src, dst, src_method, dst_method, type, direction, NULL, confidence FROM new
      UNION ALL SELECT id, 'unresolved', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, reason, NULL FROM judged WHERE id % 50 <> 7 AND reason IS NOT NULL""",
    "canonical_connections": f"""{_JUDGED}, own AS (SELECT src, dst, type, max(confidence) AS confidence, count(*) AS rows, string_agg(DISTINCT coalesce(atlas, ''), ',' ORDER BY coalesce(atlas, '')) AS atlases, bool_or(direction = 'bidirectional') AS b, bool_and(direction = 'directed') AS d, bool_or(direction = 'directed') AS anyd, bool_or(direction = 'undirected') AS anyu FROM judged WHERE problem IS NULL GROUP BY ALL)
      SELECT x.src, x.dst, x.type, CASE WHEN x.b OR (x.d AND y.d) THEN 'bidirectional' WHEN x.anyd THEN 'directed' WHEN x.anyu THEN 'undirected' ELSE 'unspecified' END AS policy, x.confidence, x.rows, x.atlases, x.d AND coalesce(y.d, false) AS reciprocal FROM own x LEFT JOIN own y ON x.src = y.dst AND x.dst = y.src AND x.type = y.type""",
    "connections_set_aside": f"{_JUDGED} SELECT id, problem FROM judged WHERE problem IS NOT NULL",
    "connection_lineage": f"{_JUDGED} SELECT src, dst, type, id, raw_type, raw_direction FROM judged WHERE problem IS NULL",
}
