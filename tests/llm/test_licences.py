"""Licence scan: the automaton against plain matching, phrases against plain search, planted notices."""

import random
import re

import pytest

from kgspark.llm import licences, queries

DATA = "/root/testdata/sf0.001"


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def base(text):
    """n_words, places (first word, label) of phrases, by looking at each word."""
    words = words_of(text)
    found = [(k, label) for k in range(len(words)) for phrase, label in licences.PHRASES.items() if words[k : k + len(phrase.split())] == phrase.split()]
    return len(words), found


def row(text, labels):
    n, found = base(text)
    starts = [k for k, _ in found]
    return n, len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in found})), labels


def stretches(words, notices):
    """Stretches of words that stand in a notice and can't grow at either side."""
    there = {tuple(n[a:b]) for n in notices for a in range(len(n)) for b in range(a + 1, len(n) + 1)}
    out = set()
    for a in range(len(words)):
        b = a
        while b < len(words) and tuple(words[a : b + 1]) in there:
            b += 1
        if b > a and (a == 0 or tuple(words[a - 1 : b]) not in there):
            out.add((b, b - a))
    return out


@pytest.mark.parametrize("block", [7, 64, licences.BLOCK])
def test_matching_statistics_and_ends(block):
    rng = random.Random(block)
    for _ in range(60):
        notices = [("n", " ".join(rng.choices("abcd", k=rng.randint(3, 9)))) for _ in range(3)]
        scanner = licences.Scanner(notices, {"a b": "ab", "c": "c"}, long=1)
        text = " ".join(rng.choices("abcdef", k=60))
        got = []
        scanner._spans = lambda s: got.extend(s) or []
        n, places, _ = scanner.read(text, block)
        words = text.split()
        plain = [n.split() for _, n in notices]
        # phrases are sequences of the automaton too
        longest = stretches(words, [*plain, ["a", "b"], ["c"]])
        assert longest <= {(end, length) for end, length, _ in got}
        assert n == 60
        for end, length, state in got:
            if length:
                part = words[end - length : end]
                assert scanner.net.ends[state] == {(k, e) for k, own in enumerate(plain) for e in range(length, len(own) + 1) if own[e - length : e] == part}
        want = [(0, k, 2) for k in range(59) if words[k : k + 2] == ["a", "b"]] + [(1, k, 1) for k in range(60) if words[k] == "c"]
        assert sorted(places) == sorted(want)


def test_chains_survive_edits_and_notices_stay_apart():
    rng = random.Random(1)
    scanner = licences.Scanner(licences.NOTICES, licences.PHRASES)
    other = ["".join(rng.choices("qxzj", k=5)) for _ in range(200)]
    for notice, (label, text) in enumerate(licences.NOTICES):
        words = text.split()
        if len(words) > 30:
            for k in range(15, len(words), 24):
                words[k] = "changed"
        held = [*rng.choices(other, k=30), *words, *rng.choices(other, k=30)]
        _, _, spans = scanner.read(" ".join(held))
        found = [s for s in spans if s[1] == notice]
        assert len(found) == 1 and found[0][0] == label and 0.8 <= found[0][5] <= 1
        # hyphens and addresses are several words
        before, inside = len(words_of(" ".join(held[:30]))), len(words_of(" ".join(words)))
        assert before <= found[0][2] and found[0][3] < before + inside
    twice = " ".join([licences.NOTICES[2][1], *rng.choices(other, k=80), licences.NOTICES[2][1]])
    assert [s[0] for s in scanner.read(twice)[2]] == ["mit", "mit"]
    assert scanner.read(" ".join(rng.choices(other, k=3000)))[2] == []
    # half a notice is none
    assert scanner.read(" ".join(licences.NOTICES[2][1].split()[:30]))[2] == []


def test_spans_of_words_of_licences_only():
    """Very long texts of nothing but such words take time in proportion."""
    scanner = licences.Scanner(licences.NOTICES, licences.PHRASES)
    n, places, spans = scanner.read("Released under the MIT License. " * 20_000)
    assert (n, len(places), len(spans)) == (100_000, 20_000, 20_000)


def test_nulls_blocks_and_extra_columns(spark):
    long = "word " * 50_000 + "CC BY" + " — mit  LICENSE?" * 3 + "x" * 100_000
    texts = [None, "", "…", "CC-BY 4.0\x7bmit{license", "ccby cc by gnu general public licenses", long, long, "Été sous CC BY"]
    df = spark.createDataFrame([(k // 2 if k else None, t, "mine", 7) for k, t in enumerate(texts)], "doc_id long, text string, Places string, label int")
    got = licences.scan(df).orderBy("doc_id").collect()
    assert len(got) == len(texts) and all(r["label"] == 7 for r in got)
    assert sorted((r["n_words"], [(p["first_word"], p["label"]) for p in r["places"]]) for r in got) == sorted((n, sorted(f)) for n, f in map(base, texts))
    assert licences.scan(df.limit(0)).collect() == []


def test_op13_equals_plain_search(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.QUERIES["op13_license_scan"](spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")) == row(docs[r["doc_id"]], r["labels"])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1 or not r["n_base"])
    assert any("apache-2.0" in r["labels"] and "apache" in r["base_labels"] for r in got)
