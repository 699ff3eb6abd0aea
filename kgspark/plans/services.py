"""Queries over hierarchies, chains of versions, projections and the resolver, with the SQL that they compare with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import normal_name
from ..operators import hierarchy as h
from ..operators import projections as p
from ..operators import resolve as r
from ..sources.adapters import regions, table


def _functions(spark: SparkSession, d: str) -> DataFrame:
    """Regions and their nations; suppliers as circuits of nations, which have the types of what they supply as functions."""
    places = regions(spark, d)
    asked = places.select(F.col("name").alias("region")).union(places.select("parent"))
    members = table(spark, d, "supplier").join(places, F.col("s_nationkey") == F.col("region_id")).select(F.col("name").alias("region"), F.col("s_suppkey").alias("circuit"))
    sold = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    functions = sold.groupBy(F.col("l_suppkey").alias("circuit"), F.col("p_type").alias("term"), F.col("l_returnflag").alias("relation")).agg(F.max("l_discount").alias("confidence"))
    terms = table(spark, d, "part").select(F.col("p_type").alias("term"), F.lower("p_type").alias("term_code")).distinct().where("term <> 'PROMO'")
    children = places.select(F.col("parent"), F.col("name").alias("child"), (F.col("region_id") % 4 != 3).alias("active"))
    return h.region_functions(asked, members, functions, terms, children)


def _multiscale(spark: SparkSession, d: str) -> DataFrame:
    """Letters over words over names over parts; brands as cells, types as molecules of names and parts."""
    part = table(spark, d, "part")
    word = F.element_at(F.split("p_name", " "), -1)
    key, letter = F.concat(F.lit("P"), F.col("p_partkey")), F.upper(F.substring(word, 1, 1))
    pairs = part.select(F.explode(F.array(*[F.struct(a.alias("child"), b.alias("parent")) for a, b in ((key, F.col("p_name")), (F.col("p_name"), word), (word, letter))])).alias("x")).select("x.*").distinct()
    nodes = part.select(F.explode(F.array(*[F.struct(a.alias("region"), F.lit(b).alias("level")) for a, b in ((letter, "macro"), (word, "meso"), (F.col("p_name"), "subregion"), (key, "fine"))])).alias("x")).select("x.*").distinct()
    cells = part.groupBy(F.col("p_name").alias("region"), F.col("p_brand").alias("item")).agg(F.max(F.when(F.col("p_size") > 10, F.col("p_size") / 50)).alias("confidence")).withColumn("code", F.lower("item"))
    molecules = part.select(key.alias("region"), F.col("p_type").alias("item"), F.lower("p_type").alias("code"), (F.col("p_size") / 50).alias("confidence"))
    return h.multiscale(nodes.withColumn("code", F.lower("region")), pairs, cells, molecules)


def _chains(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders by date, each superseding the one before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return h.version_chains(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(w).alias("supersedes")))


def _validated(spark: SparkSession, d: str) -> DataFrame:
    """Nations as circuits and parts as projections; lines are memberships, returned ones the other way."""
    on = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    memberships = on.select(
        F.col("c_nationkey").alias("circuit"),
        F.col("l_partkey").alias("projection"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_tax", "l_discount", "l_shipdate").alias("order"),
        F.when(F.col("l_returnflag") == "R", p.REVERSE_METHOD).alias("method"),
        F.when(F.col("l_linestatus") == "F", p.FORWARD_STATUS).alias("verification"),
        F.nullif(F.col("l_linenumber"), F.lit(7)).alias("source_step"),
        F.nullif((F.col("l_suppkey") % 3).cast("int"), F.lit(2)).alias("target_step"),
        (F.col("l_suppkey") % 2).alias("source_region"),
        (F.col("l_quantity") % 2).cast("int").alias("target_region"),
        (F.col("l_tax") > 0.06).alias("scope"),
    )
    projections = table(spark, d, "part").where("p_size < 45").select(F.col("p_partkey").alias("projection"), (F.col("p_partkey") % 2).alias("src"), F.when(F.col("p_size") > 5, F.col("p_size") % 2).alias("dst"))
    return p.cross_validated(memberships, table(spark, d, "nation").where("n_nationkey <> 7").select(F.col("n_nationkey").alias("circuit")), projections)


def _forecast(spark: SparkSession, d: str) -> DataFrame:
    """Orders as circuits of parts; some parts are canonical, more are planned."""
    line, part = table(spark, d, "lineitem"), table(spark, d, "part").select(F.col("p_partkey").alias("projection"), "p_size")
    memberships = line.select(F.col("l_orderkey").alias("circuit"), F.col("l_partkey").alias("projection"))
    role = F.when(F.col("l_tax") > 0.07, "unknown").otherwise("member")
    members = line.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left").select(F.col("l_orderkey").alias("circuit"), role.alias("role"), (F.col("s_acctbal") > 0).alias("grounded"))
    return p.closure_forecast(memberships, part.where("p_size > 20"), part.where("p_size between 8 and 25"), members)


LEVELS = ["cn", "en", "alias", "atlas", "synonym"]


def _resolver(spark: SparkSession, d: str) -> DataFrame:
    """Names of benchmark items at five levels; what documents begin with, and altered names, are to be resolved."""
    w = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("region"), w.alias("w"))
    join = lambda start, n: normal_name(F.array_join(F.slice("w", start, n), " "))
    levels = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(k).alias("priority"), key.alias("key"), F.lit(c).alias("confidence")) for m, k, key, c in (("cn", 0, join(1, 2), 1.0), ("en", 1, join(1, 3), 1.0), ("alias", 2, join(4, 1), 0.9), ("alias", 2, join(5, 2), 0.8), ("atlas", 3, join(7, 1), 0.9), ("synonym", 4, join(9, 1), 0.85))])
    index = items.select("region", F.explode(levels).alias("l")).select("l.*", "region").where("key <> ''")
    names = index.where("method in ('cn', 'en', 'alias')").select("region", F.col("key").alias("norm"))
    begin = table(spark, d, "documents").select(F.array_join(F.slice(F.split("text", r"\s+", 4), 1, 3), " ").alias("query"))
    altered = index.select(F.explode(F.array(F.upper("key"), F.concat("key", F.lit("x")), F.expr("left(key, length(key) - 2)"))).alias("query"))
    asked = begin.union(altered).where("query is not null").distinct().select("query", normal_name(F.col("query")).alias("norm"))
    told = r.resolve_levels(asked, index, ["cn", "en", "synonym"], names)
    shown = F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["region"].cast("string"), F.format_number(c["confidence"], 2))), ",")
    return told.withColumn("candidates", shown)


QUERIES = {
    "region_functions": _functions,
    "multiscale_view": _multiscale,
    "version_chains": _chains,
    "cross_validation": _validated,
    "closure_forecast": _forecast,
    "levels_resolver": _resolver,
}

_NORMAL = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_WORDS = ", ".join(f"{{'method': '{m}', 'priority': {k}, 'key': {_NORMAL.format(f'''array_to_string(w[{a}:{b}], ' ')''')}, 'confidence': {c}}}" for m, k, a, b, c in (("cn", 0, 1, 2, "1.0::DOUBLE"), ("en", 1, 1, 3, "1.0::DOUBLE"), ("alias", 2, 4, 4, "0.9::DOUBLE"), ("alias", 2, 5, 6, "0.8::DOUBLE"), ("atlas", 3, 7, 7, "0.9::DOUBLE"), ("synonym", 4, 9, 9, "0.85::DOUBLE")))
ORACLE_SQL = {
    "region_functions": """WITH place AS (SELECT n_nationkey AS k, n_name AS name, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey), asked AS (SELECT name AS region FROM place UNION SELECT parent FROM place),
      member AS (SELECT name AS region, s_suppkey AS circuit FROM supplier JOIN place ON s_nationkey = k), fn AS (SELECT l_suppkey AS circuit, p_type AS term, l_returnflag AS relation, max(l_discount) AS confidence, lower(p_type) AS term_code FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type <> 'PROMO' GROUP BY ALL),
      own AS (SELECT region, circuit, fn.* EXCLUDE circuit FROM asked JOIN member USING (region) JOIN fn USING (circuit)),
      kid AS (SELECT DISTINCT a.region, m.circuit FROM asked a JOIN place ON parent = a.region AND k % 4 <> 3 JOIN member m ON m.region = name WHERE a.region NOT IN (SELECT region FROM own))
      SELECT region, false AS via_children, circuit, term, relation, confidence, term_code FROM own UNION ALL SELECT region, true, circuit, term, relation, confidence, term_code FROM kid JOIN fn USING (circuit)""",
    "multiscale_view": """WITH RECURSIVE base AS (SELECT 'P' || p_partkey AS key, p_name AS name, split_part(p_name, ' ', -1) AS word, upper(left(split_part(p_name, ' ', -1), 1)) AS letter FROM part),
      pair AS (SELECT key AS child, name AS parent FROM base UNION SELECT name, word FROM base UNION SELECT word, letter FROM base),
      node AS (SELECT letter AS region, 'macro' AS level FROM base UNION SELECT word, 'meso' FROM base UNION SELECT name, 'subregion' FROM base UNION SELECT key, 'fine' FROM base),
      up AS (SELECT child, parent, 1 AS depth FROM pair UNION SELECT u.child, p.parent, u.depth + 1 FROM up u JOIN pair p ON u.parent = p.child), near AS (SELECT child, parent, min(depth) AS depth FROM up GROUP BY ALL),
      part_of AS (SELECT child AS region, 'parents' AS section, parent AS item, depth, NULL::DOUBLE AS confidence FROM near UNION ALL SELECT parent, 'children', child, depth, NULL FROM near WHERE depth = 1
        UNION ALL SELECT parent, CASE level WHEN 'meso' THEN 'meso_regions' WHEN 'subregion' THEN 'subregions' ELSE 'fine_regions' END, child, depth, NULL FROM near JOIN node ON region = child WHERE level <> 'macro'
        UNION ALL SELECT p_name, 'cell_types', p_brand, 0, max(CASE WHEN p_size > 10 THEN p_size / 50 END) FROM part GROUP BY p_name, p_brand UNION ALL SELECT 'P' || p_partkey, 'molecules', p_type, 0, p_size / 50 FROM part)
      SELECT *, CAST(row_number() OVER (PARTITION BY region, section ORDER BY depth, confidence DESC NULLS LAST, lower(item), item) AS INTEGER) AS place FROM part_of""",
    "version_chains": """SELECT o_orderkey AS id, first_value(o_orderkey) OVER w AS root, row_number() OVER w AS revision, CASE WHEN lead(o_orderkey) OVER w IS NULL THEN 0 ELSE 1 END::BIGINT AS successors, lead(o_orderkey) OVER w IS NULL AS is_current, false AS in_cycle
      FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "cross_validation": """WITH m AS (SELECT c_nationkey AS circuit, l_partkey AS projection, l_returnflag = 'R' AND l_linestatus <> 'F' AS rev, nullif(l_linenumber, 7) AS ss, nullif(l_suppkey % 3, 2) AS ts, l_suppkey % 2 AS sr, CAST(l_quantity AS BIGINT) % 2 AS tr, l_tax > 0.06 AS scope,
        row_number() OVER (PARTITION BY c_nationkey, l_partkey, l_returnflag = 'R' AND l_linestatus <> 'F' ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_tax, l_discount, l_shipdate) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
      f AS (SELECT * FROM m WHERE k = 1 AND NOT rev), r AS (SELECT * FROM m WHERE k = 1 AND rev), part2 AS (SELECT p_partkey, p_partkey % 2 AS src, CASE WHEN p_size > 5 THEN p_size % 2 END AS dst FROM part WHERE p_size < 45),
      j AS (SELECT coalesce(f.circuit, r.circuit) AS circuit, coalesce(f.projection, r.projection) AS projection, f.k IS NOT NULL AS fwd, r.k IS NOT NULL AS rv, f.ss = r.ss AS s0, f.ts = r.ts AS t0, f.scope = r.scope AS c0, f.ss AS fs, f.ts AS ft, f.sr AS fsr, f.tr AS ftr FROM f FULL JOIN r ON f.circuit = r.circuit AND f.projection = r.projection),
      x AS (SELECT j.*, circuit <> 7 AS hc, p_partkey IS NOT NULL AS hp, circuit <> 7 AND p_partkey IS NOT NULL AND fwd AND rv AS seen, CASE WHEN src IS NOT NULL AND dst IS NOT NULL AND fs IS NOT NULL AND ft IS NOT NULL THEN fsr = src AND ftr = dst END AS d0 FROM j LEFT JOIN part2 ON p_partkey = projection),
      y AS (SELECT circuit, projection, fwd, rv, hc, hp, CASE WHEN seen THEN s0 END AS source_agrees, CASE WHEN seen THEN t0 END AS target_agrees, CASE WHEN seen THEN d0 END AS direction_agrees, CASE WHEN seen THEN c0 END AS scope_agrees FROM x)
      SELECT circuit, projection, CASE WHEN NOT hc OR NOT hp THEN 'insufficient_evidence' WHEN NOT fwd THEN 'projection_supported_only' WHEN NOT rv THEN 'circuit_supported_only' WHEN NOT scope_agrees OR NOT direction_agrees THEN 'conflict' ELSE 'bidirectionally_supported' END AS status,
        CASE WHEN NOT hc OR NOT hp THEN 'unknown' WHEN NOT fwd OR NOT rv THEN 'weak' WHEN NOT scope_agrees OR NOT direction_agrees THEN 'conflicting' WHEN NOT source_agrees AND NOT target_agrees THEN 'weak' WHEN NOT source_agrees OR NOT target_agrees THEN 'moderate' ELSE 'strong' END AS support,
        CASE WHEN NOT hc OR NOT hp THEN NULL WHEN NOT scope_agrees THEN 0.3 ELSE least(1.0, round(0.3 + CASE WHEN fwd AND rv THEN 0.4 ELSE 0 END + (coalesce(source_agrees, false)::INT + coalesce(target_agrees, false)::INT + coalesce(scope_agrees, false)::INT + coalesce(direction_agrees, false)::INT) * 0.1, 2)) END::DOUBLE AS agreement,
        source_agrees, target_agrees, direction_agrees, scope_agrees, CASE WHEN NOT hc THEN 'MISSING_CIRCUIT_OR_PROJECTION' WHEN NOT hp THEN 'MISSING_PROJECTION' WHEN NOT fwd OR NOT rv THEN NULL WHEN NOT scope_agrees THEN 'SCOPE_MISMATCH' WHEN NOT direction_agrees THEN 'DIRECTION_STEP_CONFLICT' WHEN NOT source_agrees OR NOT target_agrees THEN 'STEP_MISMATCH' END AS reason FROM y""",
    "closure_forecast": """WITH c AS (SELECT l_orderkey AS circuit, count(*) AS projections, count(*) FILTER (p_size > 20) AS resolved_before, count(*) FILTER (p_size BETWEEN 8 AND 20) AS newly_resolved, bool_or(l_tax > 0.07 OR NOT coalesce(s_acctbal > 0, false)) AS unclear FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
      SELECT circuit, projections, resolved_before, newly_resolved, resolved_before < projections AND resolved_before + newly_resolved = projections AS closable, resolved_before < projections AND resolved_before + newly_resolved = projections AND NOT unclear AS fully_aligned FROM c""",
    "levels_resolver": f"""WITH w AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark), idx AS (SELECT * FROM (SELECT item_id AS region, unnest([{_WORDS}], recursive := true) FROM w) WHERE key <> ''),
      q AS (SELECT DISTINCT query, {_NORMAL.format('query')} AS norm FROM (SELECT array_to_string(regexp_split_to_array(text, '\\s+')[1:3], ' ') AS query FROM documents UNION ALL SELECT unnest([upper(key), key || 'x', left(key, greatest(length(key) - 2, 0))]) FROM idx) WHERE query IS NOT NULL),
      hit AS (SELECT query, priority, method, region, max(confidence) AS confidence FROM q JOIN idx ON norm = key GROUP BY ALL), low AS (SELECT * FROM hit QUALIFY priority = min(priority) OVER (PARTITION BY query)),
      best AS (SELECT query, any_value(method) AS method, count(*) AS n, min(region) AS region, arg_min(confidence, region) AS confidence, string_agg(region || ':' || printf('%.2f', confidence), ',' ORDER BY confidence DESC, region) AS several FROM low GROUP BY query),
      pair AS (SELECT query, region, norm, key, len(list_filter(range(1, least(length(norm), length(key)) + 1), lambda i: norm[:i] = key[:i])) AS s FROM q JOIN idx ON method IN ('cn', 'en', 'alias') AND norm <> key AND norm[:2] = key[:2] AND length(norm) > 1 AND length(key) > 1 WHERE query NOT IN (SELECT query FROM best)),
      fz AS (SELECT query, region, max(score) AS score FROM (SELECT query, region, round(s / greatest(length(norm), length(key)), 2) AS score FROM pair) WHERE score >= 0.5 GROUP BY ALL),
      offer AS (SELECT query, string_agg(region || ':' || printf('%.2f', score), ',' ORDER BY score DESC, region) AS offers FROM (SELECT * FROM fz QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, region) <= 5) GROUP BY query)
      SELECT query, CASE WHEN n = 1 OR method IN ('cn', 'en', 'synonym') THEN 'resolved' WHEN several IS NOT NULL OR offers IS NOT NULL THEN 'candidates' ELSE 'unresolved' END AS status, coalesce(method, CASE WHEN offers IS NOT NULL THEN 'fuzzy' END) AS method,
        CASE WHEN n = 1 OR method IN ('cn', 'en', 'synonym') THEN region END AS region, CASE WHEN n = 1 OR method IN ('cn', 'en', 'synonym') THEN confidence END AS confidence, CASE WHEN n > 1 AND method NOT IN ('cn', 'en', 'synonym') THEN several ELSE offers END AS candidates FROM q LEFT JOIN best USING (query) LEFT JOIN offer USING (query)""",
}
