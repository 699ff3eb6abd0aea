"""Queries over circuit endpoints, references and candidate pairs, with the SQL that they compare with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import endpoints as e
from ..sources.adapters import table


def _bought(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    on = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(part, "l_partkey")
    return on.select(F.col("o_custkey").alias("circuit"), F.col("p_name").alias("region"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), F.when(F.col("l_returnflag") == "R", "Source ").when(F.col("l_linestatus") == "F", "sink").alias("role"))


def _endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Customers as circuits; what tells of them depends on their number; part names are the regions."""
    bought = _bought(spark, d)
    kind = F.col("circuit") % 5
    regions = table(spark, d, "part").select(F.col("p_name").alias("region"), F.concat(F.upper("p_name"), F.lit(" area")).alias("label")).distinct()
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("circuit"), "c_mktsegment", (F.col("c_custkey") % 64).alias("n"))
    named = customers.join(table(spark, d, "part").select(F.col("p_partkey").alias("n"), "p_name", "p_type"), "n")
    circuits = named.select(
        "circuit",
        F.when(kind == 3, F.concat_ws("_", F.lit("loop of"), "p_name", "c_mktsegment")).otherwise("the circuit").alias("name"),
        F.when(kind == 4, F.concat(F.lit("From "), F.reverse(F.split("p_name", " "))[0], F.lit("/"), F.lit("small, the nuclei"))).alias("description"),
        F.when(kind == 2, F.array("p_name", F.lit(None).cast("string"), "p_type")).alias("involved"),
    )
    return e.circuit_endpoints(circuits, bought.where((kind == 0) & (F.col("place") % 7 == 0)), bought.where((kind < 2) & (F.col("place") % 3 == 0)), regions)


def _refs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as references; some have a DOI, some another id, some a title only."""
    key, n = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        key.alias("id"),
        F.when(key % 4 == 0, F.concat(F.lit("https://doi.org/10.1/A"), n)).when(key % 4 == 1, "").alias("doi"),
        F.when(key % 4 == 1, n.cast("string")).when(key % 8 == 2, " ").alias("pmid"),
        F.when(key % 8 == 2, F.concat(F.lit("h"), n % 100)).alias("citation_hash"),
        F.concat(F.lit("On  Customer-"), n % 50).alias("title"),
        F.year("o_orderdate").alias("year"),
        F.substring("o_orderpriority", 1, 1).alias("priority"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("text "), key)).when(F.col("o_orderstatus") == "P", "").alias("text"),
        F.when(key % 6 > 0, (key % 900).cast("string")).alias("evidence"),
    )


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pairs of a customer's nation and another, with names and levels that break rules."""
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pairs = orders.select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("src"), (F.col("o_orderkey") % 26).cast("int").alias("dst"), F.when(F.col("o_orderstatus") == "P", "wire").when(F.col("o_orderstatus") == "F", "projection").alias("type"), F.when(F.month("o_orderdate") < 10, "A_to_B").when(F.month("o_orderdate") < 12, "left").alias("direction"))
    key = F.col("n_nationkey")
    regions = table(spark, d, "nation").select(key.alias("region"), F.when(key == 4, "Left NATION").when(key == 5, "").when(key == 6, "a.b").otherwise(F.col("n_name")).alias("name"), F.when(key == 7, "fine").when(key > 9, "macro").alias("level"), F.when(key == 8, "retired").otherwise("active").alias("status"))
    known = table(spark, d, "supplier").select(F.col("s_nationkey").alias("src"), (F.col("s_suppkey") % 25).cast("int").alias("dst"))
    return e.check_pairs(pairs, regions, known).withColumn("findings", F.array_join("findings", ","))


QUERIES = {
    "circuit_endpoints": _endpoints,
    "merged_references": lambda s, d: e.merged_references(_refs(s, d))[0],
    "reference_links": lambda s, d: e.merged_references(_refs(s, d))[1],
    "pair_rules": _pairs,
}

_GENERIC = ", ".join(f"'{w}'" for w in e.GENERIC)
_TOKENS = f"list_filter(regexp_split_to_array(regexp_replace(lower({{0}}), '[_-]', ' ', 'g'), '[\\s,;/]+'), lambda x: length(x) > 2 AND x NOT IN ({_GENERIC}))"
_KEYED = """WITH refs AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'https://doi.org/10.1/A' || o_custkey WHEN 1 THEN '' END AS doi, CASE WHEN o_orderkey % 4 = 1 THEN o_custkey || '' WHEN o_orderkey % 8 = 2 THEN ' ' END AS pmid, CASE WHEN o_orderkey % 8 = 2 THEN 'h' || o_custkey % 100 END AS hash,
    'On  Customer-' || o_custkey % 50 AS title, CAST(year(o_orderdate) AS INTEGER) AS year, left(o_orderpriority, 1) AS priority, CASE o_orderstatus WHEN 'F' THEN 'text ' || o_orderkey WHEN 'P' THEN '' END AS text, CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey % 900 || '' END AS evidence FROM orders),
  keyed AS (SELECT *, CASE WHEN id % 4 = 0 THEN 'doi:' || replace(lower(doi), 'https://doi.org/', '') WHEN id % 4 = 1 THEN 'pmid:' || pmid WHEN hash IS NOT NULL THEN 'hash:' || hash ELSE 'title_year:' || replace(replace(lower(title), '  ', ' '), '-', ' ') || '|' || year END AS key FROM refs)"""


def _match(text: str, of: str) -> str:
    """Circuits' two best regions by tokens, pair by pair."""
    return f"""(SELECT circuit, first, last FROM (SELECT circuit, arg_min(region, k) AS first, arg_max(region, k) AS last, count(*) AS n FROM (SELECT circuit, region, row_number() OVER (PARTITION BY circuit ORDER BY len(list_filter(t, lambda x: contains(lower(label), x))) DESC, label, region) AS k
      FROM (SELECT circuit, {_TOKENS.format(text)} AS t FROM {of}) JOIN area ON len(list_filter(t, lambda x: contains(lower(label), x))) > 0 WHERE len(t) > 1) WHERE k <= 2 GROUP BY circuit) WHERE n = 2)"""


ORACLE_SQL = {
    "circuit_endpoints": f"""WITH bought AS (SELECT o_custkey AS circuit, p_name AS region, l_orderkey * 10 + l_linenumber AS place, CASE WHEN l_returnflag = 'R' THEN 'source' WHEN l_linestatus = 'F' THEN 'sink' ELSE '' END AS role FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
      area AS (SELECT DISTINCT p_name AS region, upper(p_name) || ' area' AS label FROM part), circuit AS (SELECT c_custkey AS circuit, CASE WHEN c_custkey % 5 = 3 THEN 'loop of_' || p_name || '_' || c_mktsegment ELSE 'the circuit' END AS name,
        CASE WHEN c_custkey % 5 = 4 THEN 'From ' || split_part(p_name, ' ', -1) || '/small, the nuclei' END AS description, CASE WHEN c_custkey % 5 = 2 THEN [p_name, p_type] END AS involved FROM customer JOIN part ON p_partkey = c_custkey % 64),
      a AS (SELECT circuit, arg_min(region, {{'p': place, 'r': region}}) AS first, arg_max(region, {{'p': place, 'r': region}}) AS last FROM bought WHERE circuit % 5 = 0 AND place % 7 = 0 GROUP BY 1 HAVING count(*) > 1),
      s AS (SELECT circuit, count(*) AS n, arg_min(region, {{'p': place, 'r': region}}) AS low, arg_max(region, {{'p': place, 'r': region}}) AS high, arg_min(region, {{'p': place, 'r': region}}) FILTER (role = 'source') AS source, arg_max(region, {{'p': place, 'r': region}}) FILTER (role = 'sink') AS sink FROM bought WHERE circuit % 5 < 2 AND place % 3 = 0 AND circuit NOT IN (SELECT circuit FROM a) GROUP BY 1),
      p AS (SELECT circuit, coalesce(source, low) AS x, coalesce(sink, high) AS y, low, high FROM s WHERE n > 1), b AS (SELECT circuit, CASE WHEN x = y THEN low ELSE x END AS first, CASE WHEN x = y THEN high ELSE y END AS last FROM p WHERE CASE WHEN x = y THEN low <> high ELSE true END),
      i AS (SELECT circuit, involved[1] AS first, involved[-1] AS last FROM circuit WHERE len(involved) > 1), n AS {_match('name', 'circuit')}, t AS {_match('description', "(SELECT * FROM circuit WHERE circuit NOT IN (SELECT circuit FROM n))")},
      every AS (SELECT *, 'candidate_region_canonical_id' AS method, 0.85 AS confidence FROM a UNION ALL SELECT *, 'circuit_step_regions', 0.80 FROM b UNION ALL SELECT *, 'involved_region_candidate_ids', 0.75 FROM i UNION ALL SELECT *, 'name_match', 0.65 FROM n UNION ALL SELECT *, 'description_match', 0.55 FROM t)
      SELECT circuit, first, last, coalesce(method, 'unresolved') AS method, CAST(coalesce(confidence, 0) AS DOUBLE) AS confidence FROM circuit LEFT JOIN every USING (circuit)""",
    "merged_references": f"""{_KEYED} SELECT key, arg_min(id, {{'p': priority, 'i': id}}) AS id, min(priority) AS priority, arg_min(title, {{'p': priority, 'i': id}}) AS title, arg_min(year, {{'p': priority, 'i': id}}) AS year, coalesce(arg_min(text, {{'p': priority, 'i': id}}) FILTER (text <> ''), '') AS text, count(*) AS refs FROM keyed GROUP BY key""",
    "reference_links": f"{_KEYED} SELECT DISTINCT key, evidence FROM keyed WHERE evidence IS NOT NULL",
    "pair_rules": """WITH area AS (SELECT n_nationkey AS k, CASE n_nationkey WHEN 4 THEN 'Left NATION' WHEN 5 THEN '' WHEN 6 THEN 'a.b' ELSE n_name END AS name FROM nation),
      pair AS (SELECT o_orderkey AS id, c_nationkey AS src, o_orderkey % 26 AS dst, o_orderstatus AS s, month(o_orderdate) AS m FROM orders JOIN customer ON o_custkey = c_custkey), known AS (SELECT DISTINCT least(s_nationkey, s_suppkey % 25) AS lo, greatest(s_nationkey, s_suppkey % 25) AS hi FROM supplier WHERE s_nationkey <> s_suppkey % 25),
      f AS (SELECT id, list_filter([CASE WHEN src = 5 OR dst = 5 OR dst = 25 THEN 'R1' END, CASE WHEN src = dst THEN 'R2' END, CASE WHEN s = 'P' THEN 'R3' END, CASE WHEN m IN (10, 11) THEN 'R4' END, CASE WHEN (least(src, dst), greatest(src, dst)) IN (SELECT (lo, hi) FROM known) THEN 'R5' END,
        CASE WHEN src IN (4, 6, 7, 8) OR dst IN (4, 6, 7, 8) THEN 'R6' END], lambda x: x IS NOT NULL) AS v FROM pair) SELECT id, CASE WHEN list_contains(v, 'R5') THEN 'blocked' WHEN len(v) > 0 THEN 'failed' ELSE 'passed' END AS status, array_to_string(v, ',') AS findings FROM f""",
}
