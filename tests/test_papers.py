"""Citations, papers, circuits and decisions on small cases, against plain loops where SQL can't help."""

import random

import pytest
from pyspark.sql import functions as F

from kgspark.operators import circuits, decisions, papers
from kgspark.plans import catalog


CITING = {
    "As Goldman-Rakic et al. (1984) say (Habas et al., 2009; Buckner and Hu, 2008b), and Petrides & Pandya (2002). Mesulam, M.M. (1995) too.": [
        ("As Goldman-Rakic et al.", "1984"),
        ("Buckner and Hu", "2008b"),
        ("Habas et al.", "2009"),
        ("Petrides & Pandya", "2002"),
        ("Mesulam, M.M.", "1995"),
    ],
    "the Von Der Heide (2013a) fibres": [("Von Der Heide", "2013a")],
    "O'Reilly,\nR. C. (2006)": [("O'Reilly, R. C.", "2006")],
    "(2006) only a year; (see Hu, 1999) no authors; (Hu, 99) (Hu 1999) (Hu, 1999; no) x et al. (1999)": [],
    "and Hu (1990) (Hu, 1990": [("Hu", "1990")],
    "(A. Hu, 1990)": [],
    "(Hu, 1990; Li et al., 1991; Wu & Xu, 1992; Yu, 1993)": [("Hu", "1990"), ("Li et al.", "1991"), ("Wu & Xu", "1992"), ("Yu", "1993")],
    "": [],
}


def test_citation_shapes(spark):
    rows = [(k, t) for k, t in enumerate(CITING)] + [(99, None)]
    got = {k: [] for k, _ in rows}
    for r in papers.citations(spark.createDataFrame(rows, "doc_id int, text string")).orderBy("doc_id", "pos", "author").collect():
        assert r.original in rows[r.doc_id][1] and rows[r.doc_id][1].index(r.original) == r.pos
        got[r.doc_id].append((r.author, r.year))
    assert [got[k] for k, _ in rows] == [*CITING.values(), []]


def test_surnames(spark):
    cases = {"Goldman-Rakic et al.": ["goldman-rakic"], "Petrides & Pandya": ["petrides", "pandya"], "Von Der Heide et al.": ["von", "der", "heide"], "Mesulam, M.M.": ["mesulam"], "": []}
    df = spark.createDataFrame([(k,) for k in cases], "a string").select("a", papers.surnames(F.col("a")).alias("s"))
    assert {r.a: r.s for r in df.collect()} == cases


def test_citations_are_graded(spark):
    cited = spark.createDataFrame([(1, "Hu et al.", "2008b"), (2, "Petrides & Pandya", "2002"), (3, "Nobody", "1999"), (4, "Hu", "1990")], "id int, author string, year string")
    library = spark.createDataFrame([(10, "Hu, X.", 2008), (11, "Pandya, D.", 2002), (12, "Petrides", 2002), (13, "Hu", 1991)], "paper int, authors string, year int")
    got = {r.id: (r.matches, r.grade, r.paper) for r in papers.match_citations(cited, library).collect()}
    assert got == {1: (1, "A_unique", 10), 2: (2, "B_multiple", None), 3: (0, "C_local_unmatched", None), 4: (0, "C_local_unmatched", None)}


def kept_in_turn(rows):
    seen, out = set(), []
    for at, *keys in sorted(rows):
        named = {(k, str(v).lower()) for k, v in enumerate(keys) if v not in (None, "")}
        if not named & seen:
            seen |= named
            out.append(at)
    return out


def test_papers_go_in_turn(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.choice([None, "", *(f"P{x}" for x in range(25))]), rnd.choice([None, *(f"d{x}" for x in range(25))])) for k in range(120)]
    chain = [(200 + k, f"c{k // 2}", f"e{(k + 1) // 2}") for k in range(12)]
    df = spark.createDataFrame(rows + chain, "at int, pmid string, doi string")
    assert sorted(r["at"] for r in papers.first_papers(df, "at").collect()) == kept_in_turn(rows + chain)
    assert papers.first_papers(df.limit(0), "at").count() == 0


def test_paper_query_against_loop(spark, data):
    from kgspark.plans.papers import _papers

    rows = [tuple(r) for r in _papers(spark, data).collect()]
    assert sorted(r.event_id for r in catalog.QUERIES["paper_dedup"](spark, data).collect()) == kept_in_turn(rows)


def test_screening_levels(spark):
    rows = [
        (1, 0, 0, "the source links the target"), (1, 0, 1, "nothing"), (2, 0, 0, "the source here"), (2, 0, 1, "target links there"), (3, 0, 0, "target"), (3, 0, 1, "filler links"),
        (3, 0, 2, "x"), (3, 0, 3, "source"), (4, 0, 0, "source and target"), (5, 0, 0, "target links source"),
    ]
    df = spark.createDataFrame(rows, "doc_id int, paragraph_id int, sentence_id int, sentence string")
    got = {(r.doc_id, r.sentence_id): (r.level, r.proximity, r.confidence) for r in papers.screen(df, r"\bsource\b", r"\btarget\b", r"\blinks\b").collect()}
    assert got == {(1, 0): ("strong", "same_sentence", 0.9), (2, 0): ("medium", "adjacent_sentence", 0.65), (3, 3): ("medium", "same_paragraph", 0.58), (5, 0): ("strong", "same_sentence", 0.86)}


def test_circuit_rules(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    edges = spark.createDataFrame([("e1", "a", "b"), ("e2", "b", "c"), ("e3", "c", "a")], "edge_id string, src string, dst string")
    steps = [(1, 1, "e1", "a", "b"), (1, 2, "e2", "b", "c"), (1, 3, "e3", "c", "a"), (2, 1, "e1", "a", "b"), (2, 2, "e1", "a", "b"), (2, 3, "e9", "c", "a"), (2, 4, "", "x", "y"), (3, 1, "e2", "c", "b")]
    members = [(1, 1, "a"), (1, 2, "b"), (2, 1, "z"), (2, 2, None)]
    got = circuits.violations(
        spark.createDataFrame([(1, True), (2, True), (3, False)], "circuit int, closed boolean"),
        spark.createDataFrame(members, "circuit int, pos int, region string"),
        spark.createDataFrame(steps, "circuit int, pos int, edge_id string, src string, dst string"),
        nodes,
        edges,
    )
    want = {(2, "missing_region_id"): 1, (2, "unknown_region"): 1, (2, "missing_edge_id"): 1, (2, "duplicate_edge"): 1, (2, "missing_edge"): 1, (2, "discontinuous_order"): 3, (2, "loop_not_closed"): 1, (3, "direction_mismatch"): 1}
    assert {(r.circuit, r.rule): r.n for r in got.collect()} == want


def test_containment(spark):
    rows = [("k1", "r", ["a", "b", "c"]), ("k2", "r", ["x", "a", "b", "c"]), ("k3", "s", ["a", "b"]), ("k4", "r", ["b", "c", "x"]), ("k5", "r", ["a", "c"])]
    got = {r.key: r.parent for r in circuits.contained(spark.createDataFrame(rows, "key string, kind string, path array<string>")).collect()}
    assert got == {"k1": "k2", "k2": None, "k3": None, "k4": None, "k5": None}


def test_decisions(spark):
    df = spark.createDataFrame([(1, "supports", 0.5, 0.9), (2, "partial", None, 0.9), (3, "supports", 0.9, 0.2), (4, "mixed", 0.3, 0.9)], "id int, d string, c double, r double")
    final, status = decisions.adjusted_confidence(F.col("d"), F.col("c"), F.col("r"))
    assert {r.id: (r.f, r.s) for r in df.select("id", final.alias("f"), status.alias("s")).collect()} == {1: (0.85, "applied"), 2: (0.75, "applied"), 3: (0.9, "no_change_weak_evidence"), 4: (0.3, "pending")}
    with pytest.raises(Exception, match="can't be stored"):
        df.select(decisions.adjusted_confidence(F.lit("not_found"), F.col("c"), F.col("r"))[1]).collect()
    pairs = [("support", "support", 0.9, 0.9), ("reject", "reject", None, None), ("support", "reject", 0.8, 0.3), ("support", None, 0.8, None), ("unknown", "uncertain", None, 0.4), ("support", "uncertain", 0.8, 0.4)]
    rows = spark.createDataFrame(pairs, "a string, b string, ca double, cb double")
    state, score = decisions.consensus(*map(F.col, ("a", "b", "ca", "cb")))
    assert [tuple(r) for r in rows.select(state, score).collect()] == [
        ("consensus_supported", 0.95), ("consensus_rejected", 0.6), ("model_conflict", 0.3), ("insufficient_information", None), ("insufficient_information", 0.4), ("needs_human_review", 0.6),
    ]
