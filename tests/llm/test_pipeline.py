"""Each stage of the pipeline against a plain version, on what the stage before it kept."""

from pyspark.sql import functions as F

import corpus_pipeline
from kgspark.llm import classifier, linededup, passages

from . import brute
from .test_queries import DATA


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "best_fit_packing" or docs.columns == columns
        kept[name] = docs
    raw = spark.read.parquet(f"{DATA}/documents.parquet")
    text = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}

    model = classifier.train(raw, spark.read.parquet(f"{DATA}/labels.parquet"))
    good = {r["doc_id"] for r in classifier.score(raw, model).collect() if r["score"] >= 0.5}
    first = text(kept["quality_classifier"])
    assert first.keys() == good and 0 < len(good) < raw.count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert sum(labels[i] == 1 for i in good if i in labels) >= 0.98 * sum(1 for i, q in labels.items() if q == 1)

    groups = brute.line_groups(list(first.items()), linededup.SHINGLE, linededup.SIMILARITY)
    want = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if groups.get((i, k), (i, k)) == (i, k)) for i, t in first.items()}
    second = text(kept["line_dedup"])
    assert second.keys() == want.keys() and sum(second[i] != t for i, t in want.items()) <= 1
    assert all(r["n_chars"] == len(r["text"]) for r in kept["line_dedup"].where("text is not null").collect())

    third = text(kept["simhash_near_dedup"])
    assert third == {i: second[i] for i, (_, c) in brute.simhash_groups(second).items() if c == i}

    fourth = text(kept["substring_dedup"])
    assert fourth.keys() == third.keys()
    repeats = brute.repeated_words(third, passages.LEAST_WORDS)
    for i, mark in repeats.items():
        assert len(brute.word_list(fourth[i])) <= len(mark) - mark.sum()

    packed = kept["best_fit_packing"].collect()
    assert {r["doc_id"] for r in packed} == fourth.keys()
    ran = corpus_pipeline.run(spark, DATA)
    place = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(place, ran.collect())) == sorted(map(place, packed))


def test_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_repeated_rows_and_clashing_columns(spark, tmp_path):
    """End to end: such rows and columns change nothing for the others and get through to the end."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    raw = spark.read.parquet(f"{DATA}/documents.parquet").select(*columns)
    some = raw.orderBy("doc_id").limit(80).cache()
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a text of nobody", "en", "x", 1), (9001, None, None, None, None), (9002, "", "", "", 0), (9003, " \n\t", "en", "x", 3), (9004, "word " * 60_000, "en", "x", None)], raw.schema)
    clashing = ("id", "key", "line", "fp", "component", "row", "group", "sequence_id", "offset", "_row", "_a", "_asked", "_heard", "_marks", "spans", "score", "piece", "start", "length", "kept", "near", "visits")

    def ran(name, docs):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        held = {}
        for r in rows:
            held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for places in held.values():
            ends = 0
            for offset, length in sorted(places):
                assert offset == ends
                ends += length
            assert ends <= 2048
        return sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in rows)

    all_rows = some.unionByName(odd).unionByName(some.limit(20))
    plain = ran("plain", all_rows)
    wide = ran("wide", all_rows.select(*columns, *[F.lit(c).alias(c) for c in clashing]))
    assert plain == wide
    known = {r["doc_id"] for r in some.collect()} | {None, *range(9001, 9005)}
    assert {eval(x)[0] for x in plain} <= known and len(plain) > 40
