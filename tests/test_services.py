"""Modules, hierarchies, version chains, cross-validation and the resolver on small cases, nulls and ties among them."""

import itertools
import random

from pyspark.sql import functions as F

from kgspark.operators import hierarchy as h
from kgspark.operators import listings
from kgspark.operators import modules as m
from kgspark.operators import projections as p
from kgspark.operators import resolve as r


def plain_labels(names, domains, payload):
    out = []
    for d in domains or []:
        flat = d.lower().replace(" ", "_")
        out += [k for k in m.MODULES if k in flat or flat in k]
    out += [k for k, words in m.MODULES.items() if any(w.lower() in n.lower() for n in names if n for w in words)]
    if payload:
        out += [k for k in m.MODULES if k in payload.lower().replace(" ", "_")]
    return list(dict.fromkeys(out))[:3] or [m.UNCERTAIN]


def test_module_labels(spark):
    rows = [
        (["Primary Visual Cortex", None], None, None),
        (["Orbitofrontal cortex", "area"], ["Emotion Reward", "Motor"], None),
        (["Nothing"], [], "the sleep arousal system"),
        (["Posterior cingulate", "memory"], None, None),
        ([None, None], None, None),
        (["CA1", "hippocampus"], ["Memory"], "motor"),
        (["parahippocampal gyrus of the insula near raphe"], ["unknown"], ""),
    ]
    df = spark.createDataFrame(rows, "names array<string>, domains array<string>, payload string")
    got = [x[0] for x in df.select(m.labels(F.col("names"), F.col("domains"), F.col("payload"))).collect()]
    assert got == [plain_labels(*row) for row in rows]


def plain_coherence(sets):
    if all(not s for s in sets):
        return 0.0
    common = set.intersection(*sets)
    if common:
        return 1.0 if len(common) == 1 and all(len(s) == 1 for s in sets) else 0.8
    pairs = [1.0 if not a and not b else 0.3 if not a or not b else len(a & b) / len(a | b) for a, b in itertools.combinations(sets, 2)]
    return round(sum(pairs) / len(pairs) * 0.6 + 0.1, 4) if pairs else 0.1


def test_coherence_by_sets_equals_all_pairs(spark):
    rng = random.Random(6)
    own = {n: set(rng.sample("abcde", rng.choice([0, 1, 1, 2, 3]))) for n in range(40)}
    cands = {c: rng.choices(range(45), k=rng.choice([1, 2, 3, 8, 60])) for c in range(120)}
    regions = spark.createDataFrame([(n, sorted(s) or [m.UNCERTAIN]) for n, s in own.items()], "node long, modules array<string>")
    nodes = spark.createDataFrame([(c, n) for c, ns in cands.items() for n in ns], "candidate long, node long")
    got = {x["candidate"]: (x["nodes"], round(x["coherence"], 3)) for x in m.coherence(nodes, regions).collect()}
    assert got == {c: (len(ns), round(plain_coherence([own.get(n, set()) for n in ns]), 3)) for c, ns in cands.items()}
    crossed = {x["candidate"]: (x["modules_involved"], x["cross_module"]) for x in m.cross_module(nodes, regions).collect()}
    want = {c: sorted(set().union(*[own.get(n, set()) for n in ns])) for c, ns in cands.items()}
    assert crossed == {c: (v, len(v) > 1) for c, v in want.items()}


def test_version_chains_with_forks_cycles_and_gaps(spark):
    long = [(1000 + k, 999 + k if k else None) for k in range(300)]
    odd = [(1, None), (2, 1), (3, 2), (4, 2), (5, 77), (6, 5), (10, 12), (11, 10), (12, 11), (13, 10), (20, 20)]
    df = spark.createDataFrame([*long, *odd], "id long, supersedes long")
    got = {x["id"]: (x["root"], x["revision"], x["successors"], x["is_current"], x["in_cycle"]) for x in h.version_chains(df).collect()}
    assert all(got[1000 + k] == (1000, k + 1, int(k < 299), k == 299, False) for k in range(300))
    assert got[1] == (1, 1, 1, False, False) and got[3] == (1, 3, 0, True, False) and got[4] == (1, 3, 0, True, False)
    assert got[2][2] == 2 and got[5] == (5, 1, 1, False, False) and got[6] == (5, 2, 0, True, False)
    assert all(got[k][:2] == (None, None) and got[k][4] for k in (10, 11, 12, 13, 20))
    assert h.version_chains(df.limit(0)).collect() == []


def test_functions_fall_back_to_active_children_only_where_there_are_none(spark):
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    regions = of([("top",), ("own",), ("none",), ("own",)], "region string")
    members = of([("own", 1), ("own", 1), ("kid", 1), ("kid", 2), ("old kid", 3), ("top", 9)], "region string, circuit long")
    functions = of([(1, "t1", "r", 0.5), (2, "t2", "r", None), (2, "gone", "r", 0.1), (3, "t1", "r", 0.2), (9, "gone", "r", 0.9)], "circuit long, term string, relation string, confidence double")
    terms = of([("t1", "T1"), ("t2", "T2")], "term string, term_code string")
    children = of([("top", "kid", True), ("top", "old kid", False), ("own", "kid", True)], "parent string, child string, active boolean")
    got = sorted((x["region"], x["via_children"], x["circuit"], x["term_code"]) for x in h.region_functions(regions, members, functions, terms, children).collect())
    assert got == [("own", False, 1, "T1"), ("top", True, 1, "T1"), ("top", True, 2, "T2")]


def test_cross_validation_rules(spark):
    schema = "circuit long, projection long, order long, method string, verification string, source_step long, target_step long, source_region string, target_region string, scope string"
    fwd, rev = (None, None), (p.REVERSE_METHOD, None)
    rows = [
        (1, 1, 1, *fwd, 1, 2, "a", "b", "s"), (1, 1, 2, *rev, 1, 2, "a", "b", "s"), (1, 1, 3, *rev, 9, 9, "x", "x", "other"),
        (1, 2, 1, *fwd, 1, 2, "a", "b", "s"),
        (1, 3, 1, None, p.REVERSE_STATUS, 1, 2, "a", "b", "s"),
        (1, 4, 1, *fwd, 1, 2, "a", "b", None), (1, 4, 2, *rev, 1, 2, "a", "b", "s"),
        (1, 5, 1, *fwd, 1, 2, "b", "b", None), (1, 5, 2, *rev, 1, 2, "a", "b", None),
        (1, 6, 1, *fwd, 1, 2, "a", "b", "s"), (1, 6, 2, *rev, 1, 3, "a", "b", "s"),
        (1, 7, 1, *fwd, 1, 2, "a", "b", "s"), (1, 7, 2, *rev, 2, 3, "a", "b", "s"),
        (1, 8, 1, *fwd, None, 2, "a", "b", "s"), (1, 8, 2, *rev, 1, 2, "a", "b", "s"),
        (2, 1, 1, *fwd, 1, 2, "a", "b", "s"), (1, 99, 1, *fwd, 1, 2, "a", "b", "s"),
        (1, 9, 1, p.REVERSE_METHOD, p.FORWARD_STATUS, 1, 2, "a", "b", "s"),
    ]
    projections = spark.createDataFrame([(k, "a", "b") for k in range(1, 10)], "projection long, src string, dst string")
    got = {(x["circuit"], x["projection"]): (x["status"], x["support"], x["agreement"], x["reason"]) for x in p.cross_validated(spark.createDataFrame(rows, schema), spark.createDataFrame([(1,)], "circuit long"), projections).collect()}
    assert got == {
        (1, 1): ("bidirectionally_supported", "strong", 1.0, None),
        (1, 2): ("circuit_supported_only", "weak", 0.3, None),
        (1, 3): ("projection_supported_only", "weak", 0.3, None),
        (1, 4): ("conflict", "conflicting", 0.3, "SCOPE_MISMATCH"),
        (1, 5): ("conflict", "conflicting", 1.0, "DIRECTION_STEP_CONFLICT"),
        (1, 6): ("bidirectionally_supported", "moderate", 1.0, "STEP_MISMATCH"),
        (1, 7): ("bidirectionally_supported", "weak", 0.9, "STEP_MISMATCH"),
        (1, 8): ("bidirectionally_supported", "strong", 0.9, None),
        (2, 1): ("insufficient_evidence", "unknown", None, "MISSING_CIRCUIT_OR_PROJECTION"),
        (1, 99): ("insufficient_evidence", "unknown", None, "MISSING_PROJECTION"),
        (1, 9): ("circuit_supported_only", "weak", 0.3, None),
    }


def test_forecast_closes_what_only_planned_projections_keep_open(spark):
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    memberships = of([("open", 1), ("open", 2), ("open", 2), ("shut", 1), ("far", 1), ("far", 3), ("odd", 2), ("null", None)], "circuit string, projection long")
    members = of([("open", "seed", True), ("odd", "unknown", True), ("far", "seed", None)], "circuit string, role string, grounded boolean")
    got = {x["circuit"]: tuple(x)[1:] for x in p.closure_forecast(memberships, of([(1,), (1,)], "projection long"), of([(2,), (1,), (None,)], "projection long"), members).collect()}
    assert got == {"open": (3, 1, 2, True, True), "shut": (1, 1, 0, False, False), "far": (2, 1, 0, False, False), "odd": (1, 0, 1, True, False), "null": (1, 0, 0, False, False)}


def test_resolver_offers_similar_names_only_where_levels_fail(spark):
    index = spark.createDataFrame([("cn", 0, "hippocampus", 1, 1.0), ("cn", 0, "hippocampus", 2, 1.0), ("alias", 2, "hc", 3, 0.7), ("alias", 2, "hc", 1, 0.9), ("alias", 2, "hc", 1, 0.2)], "method string, priority int, key string, region long, confidence double")
    names = spark.createDataFrame([(k, n) for k, n in enumerate(["hippocampus", "hippo", "hippocampal formation", "hip", "h", "amygdala"])], "region long, norm string")
    asked = spark.createDataFrame([(q, q) for q in ["hippocampus", "hc", "hippocamp", "x", ""]] + [("null", None)], "query string, norm string")
    got = {x["query"]: (x["status"], x["method"], x["region"], [tuple(c) for c in x["candidates"] or []]) for x in r.resolve_levels(asked, index, ["cn"], names).collect()}
    assert got["hippocampus"] == ("resolved", "cn", 1, []) and got["hc"] == ("candidates", "alias", None, [(1, 0.9), (3, 0.7)])
    assert got["hippocamp"] == ("candidates", "fuzzy", None, [(0, 0.82), (1, 0.56)])
    assert got["x"] == got[""] == got["null"] == ("unresolved", None, None, [])


def test_peers_of_null_anchors_are_kept(spark):
    df = spark.createDataFrame([(None, True, 1), (None, None, 2), ("a", True, 3), ("a", False, 4)], "anchor string, done boolean, id long")
    got = {x["id"]: x["peers"] for x in listings.peer_counts(df, "anchor", F.col("done")).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1}
