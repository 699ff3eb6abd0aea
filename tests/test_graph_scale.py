"""Strong components, loops and packs against plain walks over small random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from kgspark.operators import graph as g


def reach(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    out = {}
    for start in {n for e in edges for n in e}:
        seen, todo = set(), [start]
        while todo:
            for b in near.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[start] = seen
    return out


def plain_components(edges):
    r = reach(edges)
    return {n: min([n, *(m for m in r[n] if n in r[m])]) for n in r}


def plain_loops(edges, low, high):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
    out = set()

    def walk(path):
        for b in near.get(path[-1], ()):
            if b == path[0] and low <= len(path):
                out.add(tuple(path))
            if b > path[0] and b not in path and len(path) < high:
                walk([*path, b])

    for start in near:
        walk([start])
    return out


def graph(rng, nodes, edges):
    return [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)]


def shuffled_chain(rng, n):
    ids = rng.sample(range(10 * n), n)
    return list(zip(ids, ids[1:]))


CASES = {
    "sparse": lambda rng: graph(rng, 60, 70),
    "dense": lambda rng: graph(rng, 40, 160),
    "loops only": lambda rng: [(1, 1), (2, 2), (2, 2)],
    "chain": lambda rng: shuffled_chain(rng, 24),
    "rings": lambda rng: [(10 * k + j, 10 * k + (j + 1) % 5) for k in range(8) for j in range(5)] + [(10 * k, 10 * k + 10) for k in range(7)],
}


@pytest.mark.parametrize("name", CASES)
def test_strong_components(spark, name):
    edges = CASES[name](random.Random(name))
    df = spark.createDataFrame([*edges, (None, 3), (3, None)], "src long, dst long")
    got = {r["node"]: r["component"] for r in g.strong_components(df).collect()}
    assert got == plain_components(edges)


def test_components_of_no_edges(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert g.strong_components(none).collect() == []
    assert g.loops_in_components(none, g.strong_components(none)).collect() == []


def test_long_chains_take_few_rounds(spark):
    """A ring of 600 nodes in any order: labels need few rounds, not as many as there are nodes."""
    rng = random.Random(7)
    chain = shuffled_chain(rng, 600)
    df = spark.createDataFrame([*chain, (chain[-1][1], chain[0][0])], "src long, dst long")
    labels = g._extremes(df, 40)
    least = min(a for a, _ in chain)
    assert labels.where((F.col("low") == least) & (F.col("high") == least)).count() == 600


@pytest.mark.parametrize("name", ["sparse", "dense", "rings"])
def test_loops_equal_plain_walks(spark, name):
    edges = CASES[name](random.Random(name))
    df = spark.createDataFrame(edges, "src long, dst long")
    got = [tuple(r["path"]) for r in g.loops_in_components(df, g.strong_components(df)).collect()]
    want = plain_loops(edges, 4, 8)
    assert len(got) == len(set(got)) and set(got) == want and want
    groups = spark.createDataFrame([(n, f"g{n % 3}") for n in range(100) if n % 4], "node long, group string")
    hubs = spark.createDataFrame([(n,) for n in range(0, 100, 5)], "node long")
    paths = spark.createDataFrame([(list(p),) for p in want], "path array<long>")
    spans = {tuple(r["path"]): r["groups"] for r in g.spanning(paths, groups, 2, hubs).collect()}
    plain = {p: sorted({f"g{n % 3}" for n in p if n % 4}) for p in want if any(n % 5 == 0 for n in p)}
    assert spans == {p: v for p, v in plain.items() if len(v) > 1}


def plain_packs(edges, size):
    """Edges (id, src, dst) of one block in the order of ids."""
    packs, done = [[]], set()
    for k, a, b in sorted(edges):
        if k in done:
            continue
        if len(packs[-1]) == size:
            packs.append([])
        for near in [k, *(j for j, c, d in sorted(edges) if {a, b} & {c, d})]:
            if near not in done and len(packs[-1]) < size:
                packs[-1].append(near)
                done.add(near)
    return packs


@pytest.mark.parametrize("block", [10_000, 30])
def test_packs_equal_a_plain_loop_in_each_block(spark, block):
    rng = random.Random(block)
    edges = [(k, a, b) for k, (a, b) in enumerate(graph(rng, 60, 45) + [(100, 200 + j) for j in range(90)] + graph(rng, 12, 60))]
    df = spark.createDataFrame(edges, "id long, src long, dst long")
    rows = g.neighbourhood_packs(df, 7, block).collect()
    assert sorted(r["id"] for r in rows) == [k for k, _, _ in edges]
    blocks = {}
    for r in rows:
        blocks.setdefault(r["block"], []).append(r)
    assert len(blocks) == 1 if block > 1000 else len(blocks) > 5
    for own in blocks.values():
        ids = {r["id"] for r in own}
        want = {(k, n, p) for n, pack in enumerate(plain_packs([e for e in edges if e[0] in ids], 7)) for p, k in enumerate(pack)}
        assert {(r["id"], r["pack"], r["place"]) for r in own} == want
    assert max(map(len, blocks.values())) <= 3 * block
