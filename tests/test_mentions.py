"""The dictionary scan against a plain loop over sentences and terms."""

import random
import re

import pytest

from kgspark.operators import mentions as m


def plain_lexicon(names):
    best = {}
    for region, term, kind in names:
        term = (term or "").strip()
        if len(term) < 2:
            continue
        if re.fullmatch("[A-Za-z]{2,3}", term) and kind != "canonical":
            kind = "alias_abbr"
        if m.CONFIDENCE[kind] > m.CONFIDENCE.get(best.get((term, region)), 0):
            best[term, region] = kind
    return best


def plain_hits(sentence, best):
    """Places of all terms, then one after the other against what has been kept."""
    cased = {t for (t, _), k in best.items() if k == "alias_abbr" or re.fullmatch("[A-Za-z]{2,3}", t)}
    hits = []
    for (term, region), kind in best.items():
        text, word = (sentence, term) if term in cased else (sentence.lower(), term.lower())
        for at in range(len(text)):
            if text.startswith(word, at):
                around = text[max(at - 1, 0) : at], text[at + len(word) : at + len(word) + 1]
                if term in cased and any(re.fullmatch("[A-Za-z0-9]", c) for c in around):
                    continue
                hits.append((at, -len(word), -m.CONFIDENCE[kind], region, term.lower(), kind))
    kept = []
    for hit in sorted(hits):
        over = [k for k, old in enumerate(kept) if hit[0] < old[0] - old[1] and old[0] < hit[0] - hit[1]]
        if not over:
            kept.append(hit)
        elif hit[1] < kept[over[0]][1]:
            kept[over[0]] = hit
    return [(at, at - size, term, region, kind) for at, size, _, region, term, kind in kept]


def near(sentence, pos, end):
    found = re.search(r"\b(left|right)s?\-?(hemisphere|sided|side)?\b", sentence[max(0, pos - 30) : end + 30])
    return found[1] if found else "unspecified"


@pytest.mark.parametrize("letters", [10**6, 40])
def test_scan_equals_a_plain_loop(spark, letters, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_ROWS", 50)
    rng = random.Random(letters)
    syllables = ["am", "yg", "dala", "hip", "po", "IT", "CSF", "left", "right", "righted", "left-sided", "é", "杏仁", "Hipp", " ", " ", " ", "-", "A"]
    text = lambda n: "".join(rng.choices(syllables, k=n))
    names = [(k % 12, rng.choice([text(1), text(2), text(4), text(7)]), rng.choice(["canonical", "alias_en", "alias_cn"])) for k in range(60)]
    names += [(1, "Hipp", "alias_abbr"), (2, "Hipp", "canonical"), (3, "杏仁", "alias_cn"), (3, None, "alias_en"), (4, " ", "alias_en"), (5, "amyg", "alias_en"), (6, "ygdala", "alias_en"), (7, "amygdala hip", "alias_en")]
    lexicon = m.region_lexicon(spark.createDataFrame(names, "region_id long, term string, kind string"))
    best = plain_lexicon(names)
    assert {(r["term"], r["region_id"]): r["kind"] for r in lexicon.collect()} == best
    sents = [(k, k % 3, None if k == 7 else "" if k == 8 else text(rng.randint(1, 60))) for k in range(200)]
    monkeypatch.setattr(m.raw_hits, "__defaults__", (letters,))
    df = spark.createDataFrame(sents, "doc_id long, sentence_id long, sentence string")
    got = sorted((r["doc_id"], r["pos"], r["end"], r["term"], r["region_id"], r["kind"], r["laterality"]) for r in m.scanned(df, lexicon, ["doc_id", "sentence_id"]).collect())
    want = sorted((k, *hit, near(s, hit[0], hit[1])) for k, _, s in sents if s for hit in plain_hits(s, best))
    assert got == want and len(got) > 500
    first = {}
    for k, pos, end, term, region, kind, lat in sorted(want, key=lambda r: (r[0], -m.CONFIDENCE[r[5]], r[1])):
        first.setdefault((k, region), (pos, end, term, kind, lat))
    mentions = m.region_mentions(df, lexicon, ["doc_id", "sentence_id"]).collect()
    assert {(r["doc_id"], r["region_id"]): (r["pos"], r["end"], r["term"], r["kind"], r["laterality"]) for r in mentions} == first and len(mentions) == len(first)


def test_no_sentences_and_no_terms(spark):
    names = spark.createDataFrame([(1, "amygdala", "canonical")], "region_id long, term string, kind string")
    none = spark.createDataFrame([], "doc_id long, sentence_id long, sentence string")
    some = spark.createDataFrame([(1, 0, "The amygdala.")], none.schema)
    keys = ["doc_id", "sentence_id"]
    assert m.scanned(none, m.region_lexicon(names), keys).collect() == []
    assert m.scanned(some, m.region_lexicon(names.limit(0)), keys).collect() == []
    assert len(m.scanned(some, m.region_lexicon(names), keys).collect()) == 1


@pytest.mark.parametrize("letters", [10**6, 4])
def test_a_long_sentence_is_resolved_where_it_is_scanned(spark, letters, monkeypatch):
    monkeypatch.setattr(m.raw_hits, "__defaults__", (letters,))
    names = [(1, "amygdala", "canonical"), (1, "amygdala left", "alias_en"), (None, "left", "alias_cn"), (2, "CA1", "canonical"), (2, "CA", "alias_en")]
    lexicon = m.region_lexicon(spark.createDataFrame(names, "region_id long, term string, kind string"))
    df = spark.createDataFrame([(1, 0, "amygdala left, CA CA1 xCA. " * 2000)], "doc_id long, sentence_id long, sentence string")
    hits = m.scanned(df, lexicon, ["doc_id", "sentence_id"])
    # no list of hits goes to the JVM, whose copies grow with the square of its length
    if letters > 4:
        assert "Generate" not in hits._jdf.queryExecution().toString()
    got = hits.groupBy("term", "region_id").count().collect()
    assert {(r["term"], r["region_id"]): r["count"] for r in got} == {("amygdala left", 1): 2000, ("ca", 2): 2000, ("ca1", 2): 2000}
    mentions = {(r["region_id"], r["term"], r["pos"], r["laterality"]) for r in m.region_mentions(df, lexicon, ["doc_id", "sentence_id"]).collect()}
    assert mentions == {(1, "amygdala left", 0, "left"), (2, "ca1", 18, "left")}
