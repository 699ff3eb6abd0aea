"""Promotion, previews and folding on small cases: nulls, either direction, ties."""

from pyspark.sql import functions as F

from kgspark.operators import canonical as c
from kgspark.operators import endpoints as e
from kgspark.operators import governance as v

SCHEMA = "id long, mirror_status string, review_status string, promotion_status string, resource string, atlas string, level string, type string, direction string, src long, dst long"


def test_the_first_reason_decides_and_null_scopes_are_equal(spark):
    good = (v.APPROVED, v.REVIEWED, None)
    rows = [
        (1, *good, None, "a", "macro", "t", "undirected", 2, 1),
        (2, *good, None, "a", "macro", "t", "directed", 2, 1),
        (3, *good, "r", "a", "macro", "t", "directed", None, 1),
        (4, None, None, None, None, "a", "macro", "t", "directed", 2, 1),
        (5, v.APPROVED, v.REVIEWED, v.BLOCKED, None, None, None, "t", "directed", 2, 1),
        (6, *good, None, "", "macro", "t", "directed", 2, 1),
        (7, *good, None, "a", "macro", "t", "directed", 9, 9),
        (8, *good, None, "a", "macro", "t", "directed", 9, 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    summaries = spark.createDataFrame([(7, 0, 1), (8, 0, 0)], "id long, blockers long, errors long")
    final = spark.createDataFrame([(None, "a", "macro", "t", "undirected", 1, 2), (None, "a", "macro", "t", "directed", 1, 2), ("r", "a", "macro", "t", "directed", None, 1)], "resource string, atlas string, level string, type string, direction string, src long, dst long")
    got = {r["id"]: r["reason"] for r in v.promotion_eligibility(df, ids(1, 2, 3, 5, 6, 7), summaries, ids(99), final).collect()}
    assert got == {1: "DUPLICATE_FINAL_EXISTS", 2: None, 3: "DUPLICATE_FINAL_EXISTS", 4: "NOT_HUMAN_APPROVED", 5: "PROMOTION_BLOCKED", 6: "MISSING_SOURCE_ATLAS", 7: "HAS_VALIDATION_BLOCKER", 8: "NO_APPROVE_REVIEW_RECORD"}


def test_folding_keeps_the_first_and_tells_of_the_others(spark):
    df = spark.createDataFrame([(3, "a", 1), (1, "a", 1), (2, "a", 0), (4, "b", 5)], "id long, target string, sort int")
    kept, gone = v.folded(df, ["target"], ["sort"])
    assert sorted((r["id"], r["folded"]) for r in kept.collect()) == [(2, 2), (4, 0)]
    assert sorted((r["kept"], r["id"]) for r in gone.collect()) == [(2, 1), (2, 3)]


def test_grounding_levels(spark):
    regions = spark.createDataFrame([(1, "Left Area-1", "左"), (2, "left area 1", None), (3, "Other", "其他")], "region long, en string, cn string")
    names = c.name_keys(regions, spark.createDataFrame([(3, "OT"), (1, None)], "region long, alias string"))
    schema = "id long, src_candidate long, dst_candidate long, src_en string, src_cn string, dst_en string, dst_cn string, atlas string, type string, direction string, confidence double"
    rows = [
        (1, 10, None, None, None, "left area-1", None, "x", "projection", "directed", 0.5),
        (2, None, None, "LEFT  AREA 1!", None, "ot", None, "x", None, "", 0.1),
        (3, None, None, None, "左", "nowhere", None, "x", "projection", "directed", None),
        (4, None, None, "left area-1", None, "ot", None, "far", "projection", "directed", None),
        (5, 10, 10, None, None, None, None, "x", "projection", "directed", None),
        (6, None, None, "Other", None, "OT", None, "x", "projection", "directed", None),
        (7, 10, None, None, None, "left area-1", None, None, "odd", "directed", 0.5),
        (8, 10, None, None, None, "left area-1", None, None, "structural_connection", "unknown", 0.6),
        (9, 10, None, None, None, None, None, "x", "odd", "odd", 0.7),
    ]
    candidates = spark.createDataFrame([(10, 3), (11, None)], "candidate long, region long")
    coverage = spark.createDataFrame([(9, "old")], "id long, canonical string")
    canonical = spark.createDataFrame([], "src long, dst long, type string, canonical string")
    got = {r["id"]: (r["kind"], r["src"], r["dst"], r["src_method"], r["dst_method"], r["type"], r["created_by"], r["canonical"], r["reason"]) for r in c.grounded(spark.createDataFrame(rows, schema), coverage, candidates, names, canonical, ["far"]).collect()}
    assert got == {
        1: ("create", 3, 1, c.CANDIDATE, c.EXACT, "structural", 1, None, None),
        2: ("create", 1, 3, c.NORMALIZED, c.ALIAS, "uncertain", 2, None, None),
        3: ("unresolved", None, None, None, None, None, None, None, c.NO_NAME),
        4: ("unresolved", None, None, None, None, None, None, None, c.SPECIES),
        5: ("unresolved", None, None, None, None, None, None, None, c.SELF_LOOP),
        6: ("unresolved", None, None, None, None, None, None, None, c.SELF_LOOP),
        7: ("unresolved", None, None, None, None, None, None, None, c.MAPPING),
        8: ("grounded", 3, 1, c.CANDIDATE, c.EXACT, "structural", 1, None, None),
        9: ("grounded", 3, None, c.CANDIDATE, c.CANDIDATE, None, None, "old", None),
    }


def test_names_of_circuits_match_regions_by_the_words_that_tell(spark):
    texts = spark.createDataFrame([(1, "Hippocampal_CA1-subiculum pathway"), (2, "the cortex"), (3, None), (4, "hippocampal hippocampal x")], "circuit long, text string")
    regions = spark.createDataFrame([(1, "CA1 of the hippocampal formation"), (2, "Subiculum"), (3, "Parahippocampal area"), (4, None)], "region long, label string")
    got = {(r["circuit"], r["place"]): (r["region"], r["score"]) for r in e.regions_by_name(texts, regions).collect()}
    assert got == {(1, 1): (1, 2), (1, 2): (3, 1), (4, 1): (1, 2), (4, 2): (3, 2)}


def test_preview_of_a_merge_into_itself_is_empty(spark):
    merges = spark.createDataFrame([(1, 1), (1, 2), (1, 2)], "source long, target long")
    words = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "b")], "term long, word string")
    got = [tuple(r) for r in v.merge_preview(merges, words=words, rows=words.select("term")).orderBy("part").collect()]
    assert got == [(1, 2, "rows", 2, 0), (1, 2, "words", 2, 1)]
    assert v.merge_preview(merges.where(F.lit(False)), words=words).collect() == []
