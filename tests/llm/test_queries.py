"""The registered queries against plain versions over a whole small table."""

import os
import zlib

import base64

import numpy as np
import pytest

from kgspark.llm import linededup, passages, queries

from . import brute

DATA = os.environ.get("LLM_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name, *columns):
    df = queries.QUERIES[name](spark, DATA)
    return df.select(*columns).collect() if columns else df.collect()


def test_op1_ranks_held_out_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = queries.QUERIES["op1_quality_gam"](spark, "/root/testdata/sf0.01").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    pairs = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None]
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    right = np.mean([(s >= 0.5) == bool(y) for s, y in pairs])
    print("held out", len(pairs), "auc", auc, "right", right)
    assert auc > 0.9 and right > 0.85


def test_op2_counts_as_the_library(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows(spark, "op2_token_counts")
    assert len(got) == len(docs)
    for r in got:
        text = docs[r["doc_id"]] or ""
        n = len(coder.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)


def test_op3_finds_similar_lines(spark, docs):
    want = brute.line_groups(list(docs.items()), linededup.SHINGLE, linededup.SIMILARITY)
    got = {(r["doc_id"], r["line_no"]): ((r["first_id"], r["first_line_no"]), r["kept"]) for r in rows(spark, "op3_fuzzy_lines")}
    assert got.keys() == want.keys()
    assert all(kept == (first == at) for at, (first, kept) in got.items())
    wrong = [at for at in want if got[at][0] != want[at]]
    print("lines", len(want), "missed", len(wrong))
    assert len(wrong) <= 0.002 * len(want)


def test_op4_links_all_near_fingerprints(spark, docs):
    want = brute.simhash_groups(docs)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, "op4_simhash_anchors")}
    assert got == want


def test_op5_removes_what_stood_before(spark, docs):
    want = brute.substring_removal(docs)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(spark, "op5_induced_suffixes")}
    assert got == want


def test_op6_covers_repeated_passages(spark, docs):
    want = brute.repeated_words(docs, passages.LEAST_WORDS)
    covered = total = 0
    for r in rows(spark, "op6_compact_windows"):
        mark = want[r["doc_id"]]
        own = np.zeros(len(mark), bool)
        for s in r["repeats"]:
            assert 0 <= s["start"] < s["end"] <= len(mark)
            own[s["start"] : s["end"]] = True
        assert r["n_removed_words"] == own.sum()
        covered += (own & mark).sum()
        total += mark.sum()
    print("repeated words", total, "covered", covered)
    assert total and covered >= 0.99 * total


def test_op7_encodes_as_the_library(spark, docs):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(spark, "op7_bpe_merge_replay")
    assert len(got) == len(docs)
    for r in got:
        text = docs[r["doc_id"]] or ""
        ids = coder.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), brute.sha(" ".join(map(str, ids)).encode()), brute.sha(text.encode()))


def test_op8_packs_every_token_once(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows(spark, "op8_best_fit_packing")
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == docs.keys()
    tokens = 0
    for i, parts in by_doc.items():
        ids = coder.encode(docs[i] or "", add_special_tokens=False).ids + [0]
        tokens += len(ids)
        parts.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts))) and len(parts) == -(-len(ids) // 2048)
        assert all(r["length"] == 2048 for r in parts[1:])
        at = 0
        for r in parts:
            own = ids[at : at + r["length"]]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    least = -(-tokens // 2048)
    print("sequences", len(by_sequence), "at least", least)
    assert len(by_sequence) <= 1.02 * least + 1


def test_op9_reads_back_what_it_stored(spark, docs):
    got = rows(spark, "op9_transport_stream")
    assert len(got) == len(docs)
    by_text = {}
    for r in got:
        text = docs[r["doc_id"]] or ""
        raw = text.encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert (r["payload_sha256"], r["tail_crc32"]) == (brute.sha(payload), zlib.crc32(payload[-32:]))
        assert r["media_bytes"] % 188 == 0 and r["feature"].endswith("errors=0")
        assert by_text.setdefault(text, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def test_op10_links_all_near_vectors(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    want = brute.vector_groups(vectors)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows(spark, "op10_metric_range_join")}
    assert got == want
