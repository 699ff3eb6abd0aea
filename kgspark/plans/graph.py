"""Queries over the graph operators, with the SQL that they compare with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as g
from ..sources.adapters import EDGES, connections, regions, sparse_edges, table


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return regions(spark, d).select(F.col("name").alias("node"))


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return g.coverage(_nodes(spark, d), sparse_edges(spark, d))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").join(regions(spark, d), F.col("c_nationkey") == F.col("region_id"))
    return customers.where("c_acctbal > 9000").select(F.col("name").alias("node"), F.col("c_mktsegment").alias("term"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """A hierarchy: names under their last word, words under the first letter, brands under types."""
    part = table(spark, d, "part")
    word = F.element_at(F.split("p_name", " "), -1)
    up = part.select(F.col("p_name").alias("src"), word.alias("dst"))
    top = part.select(word.alias("src"), F.upper(F.substring(word, 1, 1)).alias("dst"))
    return up.union(top).distinct()


def _symmetry(spark: SparkSession, d: str) -> DataFrame:
    return g.symmetry_gaps(connections(spark, d).where("confidence >= 1.0"))


def _missing(spark: SparkSession, d: str) -> DataFrame:
    return g.missing_pairs(_matrix(spark, d), regions(spark, d).select(F.col("name").alias("node"), "parent"), sparse_edges(spark, d))


def _repointed(spark: SparkSession, d: str) -> DataFrame:
    names = regions(spark, d).where("region_id % 5 = 3 or region_id % 5 = 4")
    replaced = names.select(F.col("name").alias("node"), F.concat(F.lit("NATION_"), (F.col("region_id") - 1).cast("string")).alias("by"))
    return g.repointed(sparse_edges(spark, d), replaced)


def _joined(paths: DataFrame) -> DataFrame:
    return paths.select(F.array_join("path", ">").alias("path"))


def _relays(spark: SparkSession, d: str) -> DataFrame:
    paths = g.paths_by_length(sparse_edges(spark, d), 7, most=10)
    return _joined(reduce(DataFrame.union, [paths[n] for n in range(4, 8)]))


def _all_loops(spark: SparkSession, d: str) -> DataFrame:
    edges = g.written(sparse_edges(spark, d).select("src", "dst"))
    return _joined(g.loops_in_components(edges, g.strong_components(edges)))


QUERIES = {
    "sparse_edges": sparse_edges,
    "coverage_matrix": _matrix,
    "node_coverage": lambda s, d: g.node_coverage(_matrix(s, d)),
    "degrees": lambda s, d: g.degrees(sparse_edges(s, d)),
    "symmetry_gaps": _symmetry,
    "functional_gaps": lambda s, d: g.functional_gaps(_terms(s, d), sparse_edges(s, d), 2),
    "missing_pairs": _missing,
    "hubs": lambda s, d: g.hubs(sparse_edges(s, d), 10),
    "two_hop": lambda s, d: g.two_hop(sparse_edges(s, d), _nodes(s, d)),
    "motif_three_cycles": lambda s, d: g.three_cycles(sparse_edges(s, d)),
    "motif_feed_forward": lambda s, d: g.feed_forward(sparse_edges(s, d)),
    "motif_reciprocal": lambda s, d: g.reciprocal_chains(sparse_edges(s, d)),
    "motif_convergent": lambda s, d: g.pairs_at_hub(sparse_edges(s, d), "dst", "src"),
    "motif_divergent": lambda s, d: g.pairs_at_hub(sparse_edges(s, d), "src", "dst"),
    "relay_paths": lambda s, d: _joined(g.simple_paths(sparse_edges(s, d), 4, most=10)),
    "closed_loops": lambda s, d: _joined(g.closed_loops(sparse_edges(s, d), 4)),
    "relay_paths_4_to_7": _relays,
    "closed_loops_4_to_8": _all_loops,
    "transitive_closure": lambda s, d: g.reachable(_parts(s, d)),
    "on_cycles": lambda s, d: g.on_cycles(sparse_edges(s, d)),
    "weak_components": lambda s, d: g.components(sparse_edges(s, d).where("confidence > 0.51")),
    "strong_components": lambda s, d: g.strong_components(sparse_edges(s, d).where("n > 2")),
    "shortest_paths": lambda s, d: g.shortest_paths(sparse_edges(s, d), "NATION_0", 6).select("node", "depth"),
    "repointed_edges": _repointed,
    "shared_neighbours": lambda s, d: g.shared_neighbours(sparse_edges(s, d)),
}

W = f"WITH RECURSIVE {EDGES}"
_LINK = ", link AS (SELECT DISTINCT least(src, dst) AS lo, greatest(src, dst) AS hi FROM edges), near AS (SELECT lo AS a, hi AS b FROM link UNION ALL SELECT hi, lo FROM link)"
_MATRIX = f"{W}{_LINK}, counted AS (SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, count(*) AS edges FROM edges GROUP BY ALL), matrix AS (SELECT x.n_name AS lo, y.n_name AS hi, coalesce(c.edges, 0) AS edges, c.edges IS NOT NULL AS covered FROM nation x JOIN nation y ON x.n_name < y.n_name LEFT JOIN counted c ON c.lo = x.n_name AND c.hi = y.n_name)"
_REACH = "reach AS (SELECT src, dst, 1 AS depth FROM {0} UNION SELECT r.src, e.dst, r.depth + 1 FROM reach r JOIN {0} e ON r.dst = e.src WHERE r.depth < 26), closure AS (SELECT src, dst, min(depth) AS depth FROM reach GROUP BY ALL)"
_MUTUAL = ", mutual AS (SELECT DISTINCT a.src AS lo, a.dst AS hi FROM edges a JOIN edges b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst), mboth AS (SELECT lo AS a, hi AS b FROM mutual UNION ALL SELECT hi, lo FROM mutual)"
_PAIRS = "SELECT hub, a, b FROM (SELECT x.{0} AS hub, x.{1} AS a, y.{1} AS b, row_number() OVER (PARTITION BY x.{0} ORDER BY x.{1}, y.{1}) AS k FROM edges x JOIN edges y ON x.{0} = y.{0} AND x.{1} < y.{1}) WHERE k <= 20"
_FIRST = "SELECT *, row_number() OVER (PARTITION BY p[1] ORDER BY p) AS k FROM"
_RELAY = f", p3 AS ({_FIRST} (SELECT [x.src, x.dst, y.dst] AS p FROM edges x JOIN edges y ON x.dst = y.src WHERE y.dst <> x.src))" + "".join(
    f", p{n} AS ({_FIRST} (SELECT list_append(p, e.dst) AS p FROM p{n - 1} JOIN edges e ON p[{n - 1}] = e.src WHERE k <= 10 AND NOT list_contains(p, e.dst)))" for n in range(4, 8)
)
_LOOPS = ", c2 AS (SELECT [src, dst] AS p FROM edges WHERE src < dst)" + "".join(
    f", c{n} AS (SELECT list_append(p, e.dst) AS p FROM c{n - 1} JOIN edges e ON p[{n - 1}] = e.src WHERE e.dst > p[1] AND NOT list_contains(p, e.dst))" for n in range(3, 9)
)
ORACLE_SQL = {
    "sparse_edges": f"{W} SELECT * FROM edges",
    "coverage_matrix": f"{_MATRIX} SELECT * FROM matrix",
    "node_coverage": f"{_MATRIX} SELECT node, count(*) FILTER (covered) AS covered, count(*) AS pairs, round(count(*) FILTER (covered) / count(*) * 100, 2) AS percent FROM (SELECT lo AS node, covered FROM matrix UNION ALL SELECT hi, covered FROM matrix) GROUP BY node",
    "degrees": f"{W} SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, count(*) AS degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY node",
    "symmetry_gaps": f"{W}, t AS (SELECT src, dst, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM conn WHERE src <> dst AND confidence >= 1.0 GROUP BY ALL) SELECT a.src, a.dst, a.types, CASE WHEN b.types IS NULL THEN 'missing_mirror' ELSE 'type_mismatch' END AS gap FROM t a LEFT JOIN t b ON a.src = b.dst AND a.dst = b.src WHERE b.types IS NULL OR a.types <> b.types",
    "functional_gaps": f"{W}{_LINK}, t AS (SELECT DISTINCT n_name AS node, c_mktsegment AS term FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000) SELECT a.node AS lo, b.node AS hi, count(*) AS shared FROM t a JOIN t b ON a.term = b.term AND a.node < b.node ANTI JOIN link ON link.lo = a.node AND link.hi = b.node GROUP BY ALL HAVING count(*) >= 2",
    "missing_pairs": f"{_MATRIX}, c AS (SELECT m.lo, m.hi, count(x.a) AS neighbours FROM matrix m LEFT JOIN (SELECT p.a AS lo, q.a AS hi, p.a FROM near p JOIN near q ON p.b = q.b) x ON x.lo = m.lo AND x.hi = m.hi WHERE NOT m.covered GROUP BY ALL) SELECT c.lo, c.hi, neighbours, CASE WHEN x.n_regionkey = y.n_regionkey THEN 'C' WHEN neighbours >= 2 THEN 'A' ELSE 'B' END AS class FROM c JOIN nation x ON x.n_name = c.lo JOIN nation y ON y.n_name = c.hi",
    "hubs": f"{W} SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, count(*) AS degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY node ORDER BY degree DESC, node LIMIT 10",
    "two_hop": f"{W} SELECT node, count(*) AS two_hop FROM (SELECT a.src AS node, b.dst AS far FROM edges a JOIN edges b ON a.dst = b.src UNION SELECT b.dst, a.src FROM edges a JOIN edges b ON a.dst = b.src) WHERE node <> far GROUP BY node",
    "motif_three_cycles": f"{W} SELECT x.src || '::' || x.dst || '::' || y.dst AS key, x.src AS a, x.dst AS b, y.dst AS c FROM edges x JOIN edges y ON x.dst = y.src JOIN edges z ON y.dst = z.src AND z.dst = x.src WHERE x.src < x.dst AND x.src < y.dst",
    "motif_feed_forward": f"{W} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM edges x JOIN edges y ON x.dst = y.src JOIN edges z ON z.src = x.src AND z.dst = y.dst",
    "motif_reciprocal": f"{W}{_MUTUAL} SELECT x.a, x.b, y.b AS c FROM mboth x JOIN mboth y ON x.b = y.a AND x.a < y.b ANTI JOIN mutual m ON m.lo = x.a AND m.hi = y.b",
    "motif_convergent": f"{W} {_PAIRS.format('dst', 'src')}",
    "motif_divergent": f"{W} {_PAIRS.format('src', 'dst')}",
    "relay_paths": f"""{W}, p3 AS (SELECT *, row_number() OVER (PARTITION BY p[1] ORDER BY p) AS k FROM (SELECT [x.src, x.dst, y.dst] AS p FROM edges x JOIN edges y ON x.dst = y.src WHERE y.dst <> x.src)),
      p4 AS (SELECT *, row_number() OVER (PARTITION BY p[1] ORDER BY p) AS k FROM (SELECT list_append(p3.p, e.dst) AS p FROM p3 JOIN edges e ON p3.p[3] = e.src WHERE p3.k <= 10 AND NOT list_contains(p3.p, e.dst)))
      SELECT array_to_string(p, '>') AS path FROM p4 WHERE k <= 10""",
    "closed_loops": f"{W} SELECT w.src || '>' || x.src || '>' || y.src || '>' || z.src AS path FROM edges w JOIN edges x ON w.dst = x.src JOIN edges y ON x.dst = y.src JOIN edges z ON y.dst = z.src AND z.dst = w.src WHERE w.src < x.src AND w.src < y.src AND w.src < z.src AND x.src <> z.src AND x.src <> y.src AND y.src <> z.src",
    "relay_paths_4_to_7": f"{W}{_RELAY} " + " UNION ALL ".join(f"SELECT array_to_string(p, '>') AS path FROM p{n} WHERE k <= 10" for n in range(4, 8)),
    "closed_loops_4_to_8": f"{W}{_LOOPS} " + " UNION ALL ".join(f"SELECT array_to_string(p, '>') AS path FROM c{n} JOIN edges e ON p[{n}] = e.src AND p[1] = e.dst" for n in range(4, 9)),
    "transitive_closure": f"WITH RECURSIVE up AS (SELECT DISTINCT p_name AS src, split_part(p_name, ' ', -1) AS dst FROM part UNION SELECT DISTINCT split_part(p_name, ' ', -1), upper(left(split_part(p_name, ' ', -1), 1)) FROM part), {_REACH.format('up')} SELECT * FROM closure",
    "on_cycles": f"{W}, {_REACH.format('edges')} SELECT src AS node, depth FROM closure WHERE src = dst",
    "weak_components": f"{W}, e AS (SELECT src, dst FROM edges WHERE confidence > 0.51 UNION SELECT dst, src FROM edges WHERE confidence > 0.51), {_REACH.format('e')} SELECT src AS node, least(src, min(dst)) AS component FROM closure GROUP BY src",
    "strong_components": f"{W}, e AS (SELECT src, dst FROM edges WHERE n > 2), {_REACH.format('e')}, nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node, least(node, coalesce(min(a.dst), node)) AS component FROM nodes LEFT JOIN (SELECT x.src, x.dst FROM closure x JOIN closure y ON x.src = y.dst AND x.dst = y.src) a ON a.src = node GROUP BY node",
    "shortest_paths": f"{W}, {_REACH.format('edges')} SELECT dst AS node, depth FROM closure WHERE src = 'NATION_0' AND dst <> 'NATION_0' AND depth <= 6 UNION ALL SELECT 'NATION_0', 0",
    "repointed_edges": f"{W}, f AS (SELECT n_name AS node, 'NATION_' || CASE n_nationkey % 5 WHEN 3 THEN n_nationkey - 1 WHEN 4 THEN n_nationkey - 2 ELSE n_nationkey END AS final FROM nation) SELECT DISTINCT a.final AS src, b.final AS dst FROM edges JOIN f a ON a.node = src JOIN f b ON b.node = dst WHERE a.final <> b.final",
    "shared_neighbours": f"{W}{_LINK}, l AS (SELECT a, list(DISTINCT b) AS v FROM near GROUP BY a) SELECT lo, hi, round(len(list_intersect(x.v, y.v)) / len(list_distinct(list_concat(x.v, y.v))), 4) AS overlap FROM link JOIN l x ON x.a = lo JOIN l y ON y.a = hi",
}
