"""Passages in texts against a plain search of every pair."""

import random
import re
import unicodedata
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from kgspark.operators import passages as ps

rng = random.Random(12)
WORDS = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]


def text(n):
    return " ".join(rng.choices(WORDS, k=n))


def edited(passage, edits):
    words = passage.split()
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.choice(["swap", "drop", "add"])
        if kind == "swap":
            words[at] = "edited"
        elif kind == "drop":
            del words[at]
        else:
            words.insert(at, "added")
    return " ".join(words)


def test_near_copies_are_found_wherever_they_were_edited(spark):
    passages = [(k, text(rng.choice([12, 20, 45]))) for k in range(30)]
    docs, planted = [], {}
    for n in range(200):
        k, passage = rng.choice(passages)
        kind = rng.choice(["exact", "space", "unicode", "first", "near", "none"])
        inside = {
            "exact": passage,
            "space": passage.replace(" ", "\n ", 3).upper(),
            "unicode": passage.replace("fi", "ﬁ").replace(" ", "​ ", 2),
            "first": " ".join(["changed", *passage.split()[1:3], "too", *passage.split()[4:]]),
            "near": edited(passage, max(1, len(passage.split()) // 12)),
            "none": text(20),
        }[kind]
        docs.append((n, f"{text(rng.randint(0, 80))} {inside} {text(rng.randint(0, 80))}"))
        planted[n] = (k, kind)
    docs += [(900, None), (901, ""), (902, passages[0][1][3:-2])]
    passages += [(99, None), (98, ""), (97, " ")]
    b = spark.createDataFrame(passages, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["item_id"], r["doc_id"]): r for r in ps.passage_matches(b, d).collect()}
    for n, (k, kind) in planted.items():
        if kind == "none":
            continue
        row = got[k, n]
        assert row["status"] in {"exact": ["exact"], "space": ["normalized_whitespace"], "unicode": ["normalized_unicode", "normalized_whitespace"], "first": ["similarity"], "near": ["similarity"]}[kind], (kind, row)
    assert all(i == planted[n][0] for i, n in got if n in planted)
    # the stretch holds the copy
    for (_, n), row in got.items():
        if n in planted and planted[n][1] == "exact":
            words = ps.normalized(docs[n][1]).split(" ")
            assert " ".join(words[row["first_word"] : row["last_word"] + 1]) == passages[planted[n][0]][1]


def test_candidates_miss_no_pair_that_a_search_of_all_pairs_verifies(spark):
    common = text(6)
    passages = [(k, f"{text(5)} {common} {text(rng.randint(2, 12))}") for k in range(25)]
    docs = [(n, f"{text(30)} {common} {edited(rng.choice(passages)[1], rng.randint(0, 3))} {common} {text(10)}") for n in range(120)]
    b = spark.createDataFrame(passages, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["item_id"], r["doc_id"]) for r in ps.passage_matches(b, d).collect()}
    want = {(k, n) for k, p in passages for n, t in docs if ps.verified(p, t)[0] != "none"}
    assert got == want and len(want) >= 100


def test_similarity_is_the_larger_of_words_and_characters():
    for _ in range(50):
        a, b = text(12), edited(text(12), 2)
        x, y = set(re.findall("[a-z0-9]+", a)), set(re.findall("[a-z0-9]+", b))
        score, words = ps.similarity(a, b)
        assert words == len(x & y) / len(x | y) and score == max(words, SequenceMatcher(None, a, b).ratio())
    assert ps.normalized(" Ａ—ﬁ \n x ") == unicodedata.normalize("NFKC", "A-fi x").lower()
    assert ps.verified("one two three", "zero\n\nmore one TWO  three\n\nend")[::5] == ("normalized_whitespace", 1)


def test_given_pairs_keep_those_that_are_none(spark):
    b = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    d = spark.createDataFrame([(1, "something else"), (2, "one two three four five")], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "item_id long, doc_id long")
    assert {r["doc_id"]: r["status"] for r in ps.passage_matches(b, d, pairs).collect()} == {1: "none", 2: "exact"}
    assert ps.passage_matches(b.limit(0), d).collect() == [] and ps.passage_matches(b, d.limit(0)).collect() == []


def test_recall_puts_the_best_and_its_neighbours_first(spark):
    rows = [(1, k, t) for k, t in enumerate(["alpha", "x", "alpha BETA", "beta", "y", "alpha beta"])] + [(2, 0, "none")]
    df = spark.createDataFrame(rows, "doc_id long, paragraph_id int, paragraph string")
    got = [(r["doc_id"], r["paragraph_id"], r["hits"]) for r in ps.recalled(df, "Alpha, a beta", 5).orderBy("doc_id", "place").collect()]
    assert got == [(1, 2, 2), (1, 1, 0), (1, 3, 1), (1, 5, 2), (1, 0, 1), (2, 0, 0)]
    assert ps.recalled(df.where(F.lit(False)), "x y").collect() == []
