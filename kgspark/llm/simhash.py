"""SimHash near-duplicates by anchor-point covering.

Fingerprints that differ in few bits are found through anchors: the words of a
covering code, here two blocks of the perfect binary Golay code over 46 of the
64 bits (the other bits stay free), so that every fingerprint has one anchor
within radius 3 of each block, its home.  A fingerprint at distance ``t`` from
another lies, block by block, within 3 plus its share of ``t`` of the other's
home.  Each fingerprint is therefore replicated to every anchor within covering
radius plus threshold, and at each anchor those at home are compared with all
that came.

Equal fingerprints are one row.  Where many different fingerprints are at home
at one anchor, the comparison there goes over common neighbours instead:
fingerprints within two bits of each other share a word at one bit from either,
so a minimum for each such word links them without making pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, fresh, map_blocks, table

WORDS, SEED, DISTANCE = 3, 42, 2
BLOCK_BITS, RADIUS = 23, 3
#: Fingerprints at home at one anchor that are compared one by one.
CROWD = 32
# Fixed value: a generator polynomial of the binary Golay code.
GOLAY = 0b101011100011


def fingerprint(text: str | None, words: int = WORDS) -> int:
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    if len(parts) <= words:
        spans = [(0, len(line))]
    else:
        starts = np.append(0, ends[:-1] + 1)
        spans = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in spans], "<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp long) of each row: the fingerprint's 64 bits as a signed number.

    A-Z are lower-cased, words end at ASCII white space, shingles of ``words``
    words are hashed by XXH64.  Texts with fewer words are one shingle; texts
    without words (null or empty ones too) have fingerprint 0.
    """

    def step(block: pa.RecordBatch) -> dict[str, list]:
        marks = np.array([fingerprint(t, words) for t in block.column(1).to_pylist()], np.uint64)
        return {"id": block.column(0), "fp": pa.array(marks.view(np.int64))}

    kind = df.schema[id_col].dataType.simpleString()
    return map_blocks(df.select(id_col, text_col), step, f"id {kind}, fp long").withColumnRenamed("id", id_col)


@functools.cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of at most RADIUS + DISTANCE bits: by syndrome, with where each syndrome's begin."""
    from itertools import combinations

    single = np.array([_remainder(1 << b) for b in range(BLOCK_BITS)])
    errors, syndromes = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for weight in range(1, RADIUS + DISTANCE + 1):
        picked = np.array(list(combinations(range(BLOCK_BITS), weight)))
        errors.append((np.int64(1) << picked).sum(axis=1))
        syndromes.append(np.bitwise_xor.reduce(single[picked], axis=1))
    error, syndrome = np.concatenate(errors), np.concatenate(syndromes)
    order = np.argsort(syndrome, kind="stable")  # lightest first within each
    begin = np.searchsorted(syndrome[order], np.arange((1 << 11) + 1))
    return error[order], begin, single


def _remainder(word: int) -> int:
    while word.bit_length() > 11:
        word ^= GOLAY << word.bit_length() - 12
    return word


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor, whether it is its home) for each anchor in reach."""
    error, begin, single = _golay()
    weight = np.bitwise_count(error)
    blocks = []
    for shift in (0, BLOCK_BITS):
        word = (fps.view(np.uint64) >> np.uint64(shift) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
        syndrome = np.zeros(len(fps), np.int64)
        for b in range(BLOCK_BITS):
            syndrome ^= np.where(word >> b & 1, single[b], 0)
        fan = begin[syndrome + 1] - begin[syndrome]
        own = np.repeat(np.arange(len(fps)), fan)
        at = np.arange(len(own)) - np.repeat(np.cumsum(fan) - fan, fan) + begin[syndrome][own]
        blocks.append((fan, at, word))
    (fan0, at0, word0), (fan1, at1, word1) = blocks
    first0, first1 = np.cumsum(fan0) - fan0, np.cumsum(fan1) - fan1
    both = fan0 * fan1
    own = np.repeat(np.arange(len(fps)), both)
    k = np.arange(len(own)) - np.repeat(np.cumsum(both) - both, both)
    x, y = at0[first0[own] + k // fan1[own]], at1[first1[own] + k % fan1[own]]
    over0, over1 = np.maximum(weight[x].astype(np.int64) - RADIUS, 0), np.maximum(weight[y].astype(np.int64) - RADIUS, 0)
    near = over0 + over1 <= DISTANCE
    own, x, y = own[near], x[near], y[near]
    anchor = (word0[own] ^ error[x]) | (word1[own] ^ error[y]) << BLOCK_BITS
    return own, anchor, (over0 + over1 == 0)[near]


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that join all fingerprints within two bits; ``distinct`` has each fp once.

    Every edge is a true link, and any two linked fingerprints are connected.
    """

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                fps = batch.column(0).slice(k, 1024).to_numpy()
                own, anchor, home = anchors(fps)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[own]), pa.array(home)], ["anchor", "fp", "home"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.append(np.uint64(0), np.uint64(1) << np.arange(64, dtype=np.uint64))
        for batch in batches:
            for k in range(0, batch.num_rows, 8192):
                fps = batch.column(0).slice(k, 8192).to_numpy()
                words = fps.view(np.uint64)[:, None] ^ flips[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(words.ravel().view(np.int64)), pa.array(np.repeat(fps, 65))], ["word", "fp"])

    spread = distinct.select("fp").mapInArrow(replicate, "anchor long, fp long, home boolean")
    home = checkpointed(spread.where("home").select("anchor", F.col("fp").alias("a")))
    size = home.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    crowded = size.where(F.col("n") > CROWD).select("anchor")
    calm = home.join(crowded, "anchor", "left_anti")
    came = spread.select("anchor", F.col("fp").alias("b"))
    near = calm.join(came, "anchor").where("a <> b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).select("a", "b")
    packed = came.join(crowded, "anchor", "left_semi").select(F.col("b").alias("fp")).distinct()
    common = checkpointed(packed.mapInArrow(neighbours, "word long, fp long"))
    least = common.groupBy("word").agg(F.min("fp").alias("b"))
    star = common.join(least, "word").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return near.union(star)


def components(marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, fp, component_id) of rows (id, fp); links at two or fewer differing bits.

    ``component_id`` is the smallest id that links lead to, the row's own
    included; null ids are no candidates for it.  Each input row gives one row.
    """
    marked = checkpointed(marked.select(id_col, "fp"))
    distinct = marked.groupBy("fp").agg(F.min(id_col).alias("rep"))
    found = connected_components(links(distinct))
    joined = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    joined = checkpointed(joined)
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_fp = joined.join(least, "component").select("fp", "component_id")
    return marked.join(by_fp, "fp").select(id_col, "fp", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with only the smallest id of each group of near-duplicates; rows with a null id stay."""
    groups = components(fingerprints(docs, id_col, text_col), id_col)
    gone = fresh(docs, "_dropped")
    dropped = groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone)).distinct()
    return docs.join(dropped, docs[id_col] == dropped[gone], "left_anti")


def op4_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = components(fingerprints(table(spark, sf_dir, "documents")))
    return done.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
