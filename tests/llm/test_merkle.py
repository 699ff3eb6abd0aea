"""Merkle manifest against a plain version that builds each tree whole."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from kgspark.llm import merkle, queries

DATA = "/root/testdata/sf0.001"
LOWER = {ord(c): c.lower() for c in merkle.UPPER}
FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def digest(parts):
    return sha256(parts.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, at):
    for level in levels[:-1]:
        run = at // 16 * 16
        yield level[run:at], level[at + 1 : run + 16]
        at //= 16


def manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = own, tree([leaf(r) for r in own])
    top = tree([trees[g][1][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        own, levels = trees[g]
        for at, row in enumerate(own):
            steps = [*way(levels, at), *way(top, k)]
            node = leaf(row)
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                node = leaf((*row[:4], row[4].translate(LOWER)))
            for before, behind in steps:
                node = digest("".join(before) + node + "".join(behind))
            proof = digest("".join("".join(before + behind) for before, behind in steps))
            out.append((row[0], levels[0][at], levels[-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def made(spark, folder, rows, **extra):
    df = spark.createDataFrame(rows, FIELDS)
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    df.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return sorted(map(str, (tuple(r) for r in queries.QUERIES["op12_merkle_manifest"](spark, str(folder)).collect())))


def case(name):
    rng = random.Random(name)
    text = lambda: rng.choice([None, "", "Words And more", "lower only", "Éa A\U0001f600"]) and f"{rng.random()} Text"
    sizes = {
        "sources": [rng.choice([1, 1, 2, 15, 16, 17]) for _ in range(300)],
        "blocks": [255, 256, 257, 512, 4097],
        "alone": [1],
        "singles": [1] * 20,
    }[name]
    rows, n = [], 0
    for k, size in enumerate(sizes):
        for _ in range(size):
            n += 1
            rows.append((n, f"s{k}" if k else "", rng.choice([None, "en"]), rng.choice([None, 7]), text()))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("name", ["sources", "blocks", "alone", "singles"])
def test_sizes_of_trees(spark, tmp_path, name):
    rows = case(name)
    assert made(spark, tmp_path, rows) == sorted(map(str, manifest(rows)))


def test_nulls_ties_repeated_rows_and_extra_columns(spark, tmp_path):
    rows = [(None, None, None, None, None)] * 3 + [(7, None, "en", 1, "Same")] * 400 + [(7, "a", "en", 1, "B"), (7, "a", "en", 1, "A"), (None, "a", "", 0, "")]
    rows += [(k, "ä", None, k, None) for k in range(20)] + [(-k, "z", "de", None, "Long " * 200_000) for k in range(2)] + [(2**60 + 1, "z", "x", 2**60, "T")]
    extra = {c: "mine" for c in ("unit", "key", "leaf", "altered", "salt", "part", "nth", "place", "tree", "idx", "block", "left", "root")}
    assert made(spark, tmp_path, rows, **extra) == sorted(map(str, manifest(rows)))


def test_empty_table(spark, tmp_path):
    assert made(spark, tmp_path, []) == []


def test_proofs_lead_to_the_root_and_other_leaves_do_not(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = merkle.manifest(docs, "doc_id", "source", merkle.leaf(*[F.col(c) for c in merkle.FIELDS]), proofs=True).collect()
    assert len(rows) == docs.count() and len({r["root"] for r in rows}) == 1
    for r in rows:
        assert r["verified"] and merkle.fold(r["leaf"], r["left"], r["right"]) == r["root"]
        assert merkle.fold("0" * 64, r["left"], r["right"]) != r["root"]
        assert digest("".join(a + b for a, b in zip(r["left"], r["right"]))) == r["proof_sha256"]


def test_op12_equals_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select(*merkle.FIELDS).collect()]
    got = [tuple(r) for r in queries.QUERIES["op12_merkle_manifest"](spark, DATA).collect()]
    assert sorted(got) == sorted(manifest(rows))
    assert 0 < sum(not r[6] for r in got) < len(got)


@pytest.mark.parametrize("name", ["sources", "blocks", "alone", "singles"])
def test_sql_equals_plain_version(tmp_path, name):
    import duckdb
    import pandas as pd

    rows = case(name) + [(None, None, None, None, None), (-3, "ä", "x", 2**60, "É A")]
    frame = pd.DataFrame(rows, columns=["doc_id", "source", "lang", "n_chars", "text"]).astype({"doc_id": "Int64", "n_chars": "Int64"}).astype({"source": object, "lang": object, "text": object})
    frame = frame.where(frame.notna(), None)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, source varchar, lang varchar, n_chars bigint, text varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows) if len(rows) < 1000 else con.execute("insert into documents select * from frame")
    assert sorted(map(str, con.execute(merkle.oracle_sql()).fetchall())) == sorted(map(str, manifest(rows)))
