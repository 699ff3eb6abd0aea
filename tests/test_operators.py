"""Small cases of the knowledge-graph operators, and comparisons with plain loops."""

import random

from pyspark.sql import functions as F

import __spark_entry__
from kgspark.plans import catalog
from kgspark.functions import columns as c
from kgspark.operators import evidence, graph, merge, resolve, rules, text


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _reports(spark, rows):
    schema = "src string, dst string, type string, direction string, species string, confidence double, run_id int, src_side string, dst_side string"
    return spark.createDataFrame(rows, schema)


def test_clusters_conserve_evidence(spark):
    rows = [
        ("a", "b", "t", "d", "s", 0.5, 1, "left", "left"),
        ("a", "b", "t", "d", "s", 0.7, 1, "left", "right"),
        ("b", "a", "t", "d", "s", 0.7, 2, "left", "left"),
        ("a", "a", "t", "d", "s", 0.9, 1, "left", "left"),
        (None, "a", "t", "d", "s", 0.9, 1, "left", "left"),
        ("c", "d", "t", "d", "s", None, 1, "left", "left"),
        ("c", "d", "t", "d", "s", 0.2, 1, "left", "left"),
    ]
    df = _reports(spark, rows)
    got = {(r.src, r.dst): r for r in evidence.clusters(df).collect()}
    assert got["a", "b"].merge_reason == "hemisphere_specific" and got["a", "b"].avg_confidence == 0.6
    assert got["c", "d"].merge_reason == "duplicate_evidence" and got["b", "a"].merge_reason == "single"
    total = evidence.conservation(df).first()
    assert total.clustered + total.self_loops + total.unresolved == total.total == sum(r.evidence_count for r in got.values()) + 2
    assert evidence.clusters(_reports(spark, [])).count() == 0


def test_directions(spark):
    rows = [("a", "b", "t", "directed", "s", 0.5, 1, "l", "l"), ("b", "a", "t", "directed", "s", 0.5, 1, "l", "l"), ("a", "c", "t", "directed", "s", 0.5, 1, "l", "l")]
    rows += [("c", "d", "t", x, "s", 0.5, 1, "l", "l") for x in ("directed", "undirected")]
    rows += [("e", "f", "t", x, "s", 0.5, 1, "l", "l") for x in ("bidirectional", "undirected")] + [("g", "h", "t", "unspecified", "s", 0.5, 1, "l", "l"), ("g", "i", "t", "undirected", "s", 0.5, 1, "l", "l")]
    got = {(r.src, r.dst): r.direction for r in evidence.directionality(_reports(spark, rows)).collect()}
    assert got == {("a", "b"): "bidirectional", ("b", "a"): "bidirectional", ("a", "c"): "directed", ("c", "d"): "directed", ("e", "f"): "bidirectional", ("g", "h"): "unspecified", ("g", "i"): "undirected"}


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_graph_against_loops(spark):
    random.seed(5)
    pairs = sorted({(f"n{random.randrange(14):02}", f"n{random.randrange(14):02}") for _ in range(26)})
    pairs = [(a, b) for a, b in pairs if a != b]
    reach = {(a, b): 1 for a, b in pairs}
    while True:
        more = {(a, d): n + 1 for (a, b), n in reach.items() for c2, d in pairs if b == c2 and (a, d) not in reach}
        if not more:
            break
        for k, n in more.items():
            reach[k] = min(n, reach.get(k, n))
    edges = _edges(spark, pairs)
    got = {(r.src, r.dst): r.depth for r in graph.reachable(edges).collect()}
    assert got == reach
    nodes = {x for p in pairs for x in p}
    strong = {x: min([x] + [y for y in nodes if (x, y) in reach and (y, x) in reach]) for x in nodes}
    assert {r.node: r.component for r in graph.strong_components(edges).collect()} == strong
    weak = {x: x for x in nodes}
    for _ in nodes:
        for a, b in pairs:
            weak[a] = weak[b] = min(weak[a], weak[b])
    assert {r.node: r.component for r in graph.components(edges).collect()} == weak
    links = set(pairs)
    cycles = {(a, b, d) for a, b in links for x, d in links if x == b and (d, a) in links and a < b and a < d}
    assert {(r.a, r.b, r.c) for r in graph.three_cycles(edges).collect()} == cycles


def test_cycles_end(spark):
    assert {r.node for r in graph.on_cycles(_edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])).collect()} == {"a", "b", "c"}


def test_repointed(spark):
    replaced = spark.createDataFrame([("b", "c"), ("c", "d")], "node string, by string")
    got = graph.repointed(_edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("x", "y")]), replaced)
    assert {(r.src, r.dst) for r in got.collect()} == {("a", "d"), ("x", "y")}


def test_resolver_never_chooses(spark):
    level = spark.createDataFrame([("k", 1), ("k", 2), ("m", 3)], "key string, entity int")
    low = spark.createDataFrame([("k", 9), ("z", 9)], "key string, entity int")
    index = resolve.name_index(("first", level), ("second", low))
    asked = spark.createDataFrame([("q1", "k"), ("q2", "m"), ("q3", "z"), ("q4", "none")], "query string, key string")
    got = {r["query"]: (r.status, r.entity) for r in resolve.resolve(asked, index).collect()}
    assert got == {"q1": ("ambiguous", None), "q2": ("resolved", 3), "q3": ("resolved", 9), "q4": ("unresolved", None)}
    assert {r["query"]: r.method for r in resolve.cascade(asked, index).collect()}["q1"] == "first"


def test_rules(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None), (3, "")], "id int, name string")
    checked = rules.check(rows, [rules.Rule("EMPTY", "blocked", F.col("name") == ""), rules.Rule("NULL", "warning", F.col("name").isNull())])
    assert {r.id: r.status for r in checked.collect()} == {1: "passed", 2: "warning", 3: "blocked"}


def test_merges_can_run_again(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w"), (1, None)], "k int, v string")
    once = merge.upsert(a, b, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "x"), (2, "z"), (3, "w")] == sorted(map(tuple, merge.upsert(once, b, ["k"]).collect()))
    new = merge.insert_missing(a, b, ["k"])
    assert new.count() == 3 == merge.insert_missing(new, b, ["k"]).count()
    assert {r.k: r.action for r in merge.difference(once, a, ["k"], "v").collect()} == {1: "keep", 2: "update", 3: "insert"}


def test_text(spark):
    docs = spark.createDataFrame([(1, 'He said. "No!" Then  left? yes'), (2, ""), (3, None)], "doc_id int, text string")
    assert [r.sentence for r in text.sentences(docs).orderBy("sentence_id").collect()] == ["He said.", '"No!" Then  left?', "yes"]
    row = spark.range(1).select(c.least_rotation(F.array(*map(F.lit, "cab"))).alias("r"), c.path_key(F.array(*map(F.lit, "zya"))).alias("p"), F.size(c.trigrams(F.lit("ab"))).alias("t"))
    assert row.first() == (["a", "b", "c"], ["a", "y", "z"], 3)


def test_paths_and_loops_of_all_surveyed_sizes(spark, data):
    """The queries reach 7 and 8 nodes, not 4 only."""
    for name, sizes in (("relay_paths_4_to_7", {4, 5, 6, 7}), ("closed_loops_4_to_8", {4, 5, 6, 7, 8})):
        paths = [r["path"].split(">") for r in catalog.QUERIES[name](spark, data).collect()]
        assert {len(p) for p in paths} == sizes and all(len(set(p)) == len(p) for p in paths)
