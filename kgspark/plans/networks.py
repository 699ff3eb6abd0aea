"""Queries over larger networks and the modules of their nodes, with the SQL that they compare with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import modules as m
from ..sources.adapters import table

#: Stand for the functional modules and for their keywords, in words of the tables.
WORDS = {"economy_ring": ["ring", "rod"], "hot_metal": ["hot", "anvil"], "cold": ["COLD", "blue"], "small_gear": ["gear", "gizmo"], "standard": ["plate"]}


def returned_links(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): parts that were returned from neighbouring lines of an order; many parts, few links each."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag")
    seq = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.col("l_returnflag").alias("f"), F.lead("l_returnflag").over(w).alias("g"))
    return seq.where("f = 'R' and g = 'R' and src <> dst").select("src", "dst").distinct()


def _regions(spark: SparkSession, d: str) -> DataFrame:
    """Parts as regions: two names, a domain and a payload to tell their modules by."""
    part = table(spark, d, "part")
    domains = F.when(F.col("p_size") % 3 == 0, F.array(F.col("p_type")))
    payload = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("group: small "), F.element_at(F.split("p_name", " "), -1)))
    return part.select(F.col("p_partkey").alias("node"), m.labels(F.array("p_name", F.nullif("p_brand", F.lit("Brand#1"))), domains, payload, WORDS).alias("modules"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Orders as candidates, their parts as nodes."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("candidate"), F.col("l_partkey").alias("node"))


def _loops(links: DataFrame) -> DataFrame:
    return g.loops_in_components(links, g.strong_components(links))


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    """Two classes of parts, and parts of neither, as cortical and subcortical regions are."""
    name = F.col("p_name")
    kind = F.when(name.rlike("small|old"), "cortical").when(name.rlike("large|new|hot"), "subcortical")
    return table(spark, d, "part").select(F.col("p_partkey").alias("node"), kind.alias("group")).where("group is not null")


def _text(paths: DataFrame) -> DataFrame:
    return paths.select(*[F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path") if c == "path" else F.col(c) for c in paths.columns])


def _flat(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, F.array_join(column, ","))


def _between_kinds(spark: SparkSession, d: str) -> DataFrame:
    links = g.written(returned_links(spark, d))
    return _flat(_text(g.spanning(_loops(links), _kinds(spark, d), 2, g.hubs(links, 50))), "groups")


def _between_modules(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_text(g.spanning(_loops(g.written(returned_links(spark, d))), m.known(_regions(spark, d)).withColumnRenamed("module", "group"), 2)), "groups")


def _packs(spark: SparkSession, d: str) -> DataFrame:
    links = returned_links(spark, d)
    return g.neighbourhood_packs(links.withColumn("id", F.col("src") * 100_000_000 + F.col("dst")), 20)


QUERIES = {
    "returned_links": returned_links,
    "link_components": lambda s, d: g.strong_components(returned_links(s, d)),
    "link_loops_4_to_8": lambda s, d: _text(_loops(g.written(returned_links(s, d)))),
    "loops_between_kinds": _between_kinds,
    "loops_between_modules": _between_modules,
    "link_packs": _packs,
    "region_modules": lambda s, d: _flat(_regions(s, d), "modules"),
    "module_hubs": lambda s, d: m.module_hubs(_regions(s, d), returned_links(s, d).select(F.col("src").alias("node"))),
    "cross_module_candidates": lambda s, d: _flat(m.cross_module(_candidates(s, d), _regions(s, d)), "modules_involved"),
    "module_coherence": lambda s, d: m.coherence(_candidates(s, d), _regions(s, d)),
}

_LINK = """WITH RECURSIVE seq AS (SELECT l_partkey AS src, lead(l_partkey) OVER w AS dst, l_returnflag AS f, lead(l_returnflag) OVER w AS g FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag)),
  link AS (SELECT DISTINCT src, dst FROM seq WHERE f = 'R' AND g = 'R' AND src <> dst)"""
_SCC = (
    _LINK
    + """, reach AS (SELECT src, dst FROM link UNION SELECT r.src, l.dst FROM reach r JOIN link l ON r.dst = l.src), node AS (SELECT src AS node FROM link UNION SELECT dst FROM link),
  scc AS (SELECT node, least(node, coalesce(min(a.dst), node)) AS component FROM node LEFT JOIN (SELECT x.src, x.dst FROM reach x JOIN reach y ON x.src = y.dst AND x.dst = y.src) a ON a.src = node GROUP BY node)"""
)
# loops by walking on from the smallest node, to eight nodes
_WALK = _SCC + ", w2 AS (SELECT x.component, [src, dst] AS p FROM link JOIN scc x ON x.node = src JOIN scc y ON y.node = dst AND y.component = x.component WHERE src < dst)" + "".join(
    f", w{n} AS (SELECT component, list_append(p, dst) AS p FROM w{n - 1} JOIN link ON src = p[{n - 1}] WHERE dst > p[1] AND NOT list_contains(p, dst))" for n in range(3, 9)
) + ", loops AS (" + " UNION ALL ".join(f"SELECT component, p FROM w{n} JOIN link ON src = p[{n}] AND dst = p[1]" for n in range(4, 9)) + ")"
_PATH = "array_to_string(list_transform(p, lambda x: CAST(x AS VARCHAR)), '>') AS path"
_EVERY = "[" + ", ".join(f"'{k}'" for k in WORDS) + "]"
_NAMED = ", ".join(f"CASE WHEN {' OR '.join(f'''contains(names, '{w.lower()}')''' for w in ws)} THEN '{k}' END" for k, ws in WORDS.items())
_MODULES = f"""regions AS (SELECT p_partkey AS node, CASE WHEN len(found) = 0 THEN ['module_uncertain'] ELSE found[1:3] END AS modules FROM (
    SELECT p_partkey, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(list_concat(told, list_filter(named, lambda x: x IS NOT NULL), hinted), lambda x: [x])), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE list_concat(a, x) END) AS found FROM (
    SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN list_filter({_EVERY}, lambda k: contains(lower(p_type), k) OR contains(k, lower(p_type))) ELSE [] END AS told,
      [{_NAMED}] AS named, CASE WHEN p_size % 7 = 0 THEN list_filter({_EVERY}, lambda k: contains('group:_small_' || split_part(p_name, ' ', -1), k)) ELSE [] END AS hinted
    FROM (SELECT *, lower(p_name || chr(10) || CASE WHEN p_brand = 'Brand#1' THEN '' ELSE p_brand END) AS names FROM part)))),
  module AS (SELECT DISTINCT node, module FROM (SELECT node, unnest(modules) AS module FROM regions) WHERE module <> 'module_uncertain')"""
_SPAN = "SELECT {0}, string_agg(DISTINCT grp, ',' ORDER BY grp) AS groups FROM (SELECT p, unnest(p) AS node FROM loops) JOIN {1} USING (node) GROUP BY p HAVING count(DISTINCT grp) > 1"
ORACLE_SQL = {
    "returned_links": f"{_LINK} SELECT * FROM link",
    "link_components": f"{_SCC} SELECT * FROM scc",
    "link_loops_4_to_8": f"{_WALK} SELECT component, {_PATH} FROM loops",
    "loops_between_kinds": f"""{_WALK}, kind AS (SELECT p_partkey AS node, CASE WHEN regexp_matches(p_name, 'small|old') THEN 'cortical' WHEN regexp_matches(p_name, 'large|new|hot') THEN 'subcortical' END AS grp FROM part),
      hub AS (SELECT node FROM (SELECT src AS node FROM link UNION ALL SELECT dst FROM link) GROUP BY node ORDER BY count(*) DESC, node LIMIT 50) SELECT * FROM (SELECT {_PATH}, groups FROM ({_SPAN.format('p', '(SELECT * FROM kind WHERE grp IS NOT NULL)')}) WHERE list_has_any(p, (SELECT list(node) FROM hub)))""",
    "loops_between_modules": f"{_WALK}, {_MODULES} {_SPAN.format(_PATH, '(SELECT node, module AS grp FROM module)')}",
    "region_modules": f"WITH {_MODULES} SELECT node, array_to_string(modules, ',') AS modules FROM regions",
    "module_hubs": f"{_LINK}, {_MODULES} SELECT module, node FROM module WHERE node IN (SELECT src FROM link) AND node IN (SELECT node FROM module GROUP BY node HAVING count(*) > 1)",
    "cross_module_candidates": f"WITH {_MODULES}, c AS (SELECT l_orderkey AS candidate, coalesce(string_agg(DISTINCT module, ',' ORDER BY module), '') AS modules_involved, count(DISTINCT module) > 1 AS cross_module FROM lineitem LEFT JOIN module ON node = l_partkey GROUP BY 1) SELECT * FROM c",
    # pair by pair
    "module_coherence": f"""WITH {_MODULES}, own AS (SELECT l_orderkey AS c, row_number() OVER () AS i, list_filter(modules, lambda x: x <> 'module_uncertain') AS s FROM lineitem JOIN regions ON node = l_partkey),
      whole AS (SELECT c, count(*) AS nodes, bool_and(len(s) = 1) AS single, bool_and(len(s) = 0) AS unknown FROM own GROUP BY c),
      shared AS (SELECT c, count(*) AS common FROM (SELECT c, m, count(*) AS k FROM (SELECT c, unnest(s) AS m FROM own) GROUP BY ALL) JOIN whole USING (c) WHERE k = nodes GROUP BY c),
      pair AS (SELECT a.c, avg(CASE WHEN len(a.s) = 0 AND len(b.s) = 0 THEN 1.0 WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0.3 ELSE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) END) AS mean FROM own a JOIN own b ON a.c = b.c AND a.i < b.i GROUP BY a.c)
      SELECT c AS candidate, nodes, CASE WHEN unknown THEN 0.0 WHEN common = 1 AND single THEN 1.0 WHEN common > 0 THEN 0.8 WHEN nodes > 1 THEN round(mean * 0.6 + 0.1, 4) ELSE 0.1 END AS coherence FROM whole LEFT JOIN shared USING (c) LEFT JOIN pair USING (c)""",
}
