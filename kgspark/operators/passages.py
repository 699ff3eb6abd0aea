"""Passages looked up in texts: where they stand as they are, and where something much like them stands."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.slices import map_slices
from .graph import written

# --- fixed values: characters read as a hyphen and as white space; thresholds ---
HYPHENS = "[\u2010-\u2015\u2212\u00ad\u2018\u2019\u201c\u201d\u3001\u3002\uff0c\uff0e]"
SPACES = "[\\s\u200b\u200c\u200d]+"
BY_WORDS, BY_CHARACTERS = 0.75, 0.8

#: Words of a shingle, and share of a passage's shingles that a text must hold to be looked at.
SHINGLE, LEAST_SHARE = 3, 0.25

FOUND = StructType(
    [StructField("status", StringType()), StructField("score", DoubleType()), StructField("jaccard", DoubleType())]
    + [StructField(c, IntegerType()) for c in ("first_word", "last_word", "paragraph")]
)


def normalized(text: str | None) -> str:
    """NFKC, hyphens and quotes as one sign, white space as single spaces, lower case."""
    t = unicodedata.normalize("NFKC", text or "")
    return re.sub(SPACES, " ", re.sub(HYPHENS, "-", t)).strip().lower()


def normal(rows: DataFrame, key: str) -> DataFrame:
    """(key, norm) of rows (key, text) whose normalized text isn't empty."""

    def step(part: pa.RecordBatch) -> list:
        return [part.column(0), [normalized(t) for t in part.column(1).to_pylist()]]

    return map_slices(rows.select(key, "text"), ["text"], step, StructType([rows.schema[key], StructField("norm", StringType())])).where("norm <> ''")


def _spaced(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip().lower()


def similarity(passage: str, source: str) -> tuple[float, float]:
    """(largest of word and character similarity, word similarity) of normalized strings."""
    if not passage or not source:
        return 0.0, 0.0
    a, b = set(re.findall("[a-z0-9]+", passage)), set(re.findall("[a-z0-9]+", source))
    words = len(a & b) / len(a | b) if a and b else 0.0
    return max(words, SequenceMatcher(None, passage, source).ratio()), words


def stretch(passage: list[str], source: list[str], least: int) -> tuple[int, int] | None:
    """Words of the source from where the passage would begin to where it would end, by shingles in about its order.

    None where fewer than ``least`` different shingles are shared there.
    """
    k = min(SHINGLE, len(passage))
    at: dict[tuple, list[int]] = {}
    for i in range(len(passage) - k + 1):
        at.setdefault(tuple(passage[i : i + k]), []).append(i)
    met = [(j, i) for j in range(len(source) - k + 1) for i in at.get(tuple(source[j : j + k]), ())]
    if not met:
        return None
    votes = Counter(j - i for j, i in met)
    slack = max(2, len(passage) // 4)
    best = min(votes, key=lambda d: (-sum(votes.get(d + e, 0) for e in range(-slack, slack + 1)), -votes[d], d))
    near = [(j, i) for j, i in met if abs(j - i - best) <= slack]
    if len({i for _, i in near}) < least:
        return None
    (j0, i0), (j1, i1) = min(near), max(near)
    return max(0, j0 - i0), min(len(source), j1 + len(passage) - i1)


def verified(passage: str, source: str) -> tuple:
    """Tier, similarity and place of a passage: exact, normalized_whitespace, normalized_unicode, similarity, or none.

    The last tier compares it with the stretch of the source that it is aligned with.
    """
    flat, text = normalized(passage), normalized(source)
    words = flat.split(" ")
    paragraph = next((k for k, p in enumerate(re.split(r"\n\s*\n", source)) if passage in p or flat in normalized(p)), None) if flat else None
    tier = None
    if passage and passage in source:
        tier = "exact"
    elif _spaced(passage) and _spaced(passage) in _spaced(source):
        tier = "normalized_whitespace"
    elif flat and flat in text:
        tier = "normalized_unicode"
    if tier:
        start = text.find(flat)
        first = text[: max(start, 0)].count(" ")
        return tier, 1.0, 1.0, first, first + len(words) - 1, paragraph
    there = text.split(" ")
    found = stretch(words, there, needed(len(words)))
    if found is None:
        return "none", 0.0, 0.0, None, None, None
    score, by_words = similarity(flat, " ".join(there[found[0] : found[1]]))
    good = by_words >= BY_WORDS or score >= BY_CHARACTERS
    return "similarity" if good else "none", score, by_words, found[0], found[1] - 1, None


def needed(words: int) -> int:
    """Different shingles that a text must share with a passage of so many words."""
    return max(1, int((max(1, words - SHINGLE + 1)) * LEAST_SHARE))


def _verified(part: pa.RecordBatch) -> list:
    """Columns item_id, doc_id and those of FOUND of rows (item_id, doc_id, passage, source)."""
    rows = [verified(p or "", s or "") for p, s in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
    return [part.column(0), part.column(1), *(list(c) for c in zip(*rows))]


def _shingles(words: Column) -> Column:
    """Digests of a text's different runs of SHINGLE words; of fewer words one of all."""
    n = F.size(words)
    starts = F.sequence(F.lit(1), F.greatest(n - SHINGLE + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " "))))


def passage_candidates(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id) of passages and texts that may share enough shingles.

    A passage is looked for by its rarest shingles only, as many as make sure
    that a text which shares enough of all shares one of these; so common
    phrases lead nowhere.  Passages are few beside texts and travel to them.
    The passage's first and last word may be parts of words in the text and are not asked for where it has five or more.
    """
    w = F.split("norm", " ")
    inner = F.when(F.size("w") >= SHINGLE + 2, F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0)))).otherwise(F.col("w"))
    asked = normal(passages, "item_id").withColumn("w", w)
    asked = asked.select("item_id", F.size("w").alias("n"), F.explode(_shingles(inner)).alias("shingle"))
    there = normal(docs, "doc_id").withColumn("w", w).select("doc_id", F.explode(_shingles(F.col("w"))).alias("shingle"))
    # written, since it is counted and met: texts are read and cut once
    there = written(there.join(asked.select("shingle").distinct(), "shingle", "left_semi"))
    common = there.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    # shingles that stand nowhere cost nothing but count
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.coalesce("df", F.lit(0)), "shingle"))
    total = F.count(F.lit(1)).over(W.partitionBy("item_id"))
    need = F.greatest(F.floor(F.greatest(F.col("n") - SHINGLE + 1, F.lit(1)) * LEAST_SHARE) - 2, F.lit(1))
    rare = asked.join(common, "shingle", "left").withColumn("k", rank).withColumn("m", total).where(F.col("k") <= F.col("m") - need + 1)
    return rare.select("item_id", "shingle").join(there, "shingle").select("item_id", "doc_id").distinct()


def passage_matches(passages: DataFrame, docs: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """How passages (item_id, text) stand in texts (doc_id, text): a row for each pair that isn't none, or of ``pairs``, for each.

    Empty passages and texts verify as none; null texts count as empty.
    """
    asked = pairs if pairs is not None else passage_candidates(passages, docs)
    joined = asked.select("item_id", "doc_id").join(passages.select("item_id", F.col("text").alias("passage")), "item_id").join(docs.select("doc_id", F.col("text").alias("source")), "doc_id")
    joined = joined.select("item_id", "doc_id", "passage", "source")
    told = map_slices(joined, ["passage", "source"], _verified, StructType([joined.schema["item_id"], joined.schema["doc_id"], *FOUND.fields]))
    return told if pairs is not None else told.where("status <> 'none'")


def recalled(paragraphs: DataFrame, term: str, limit: int = 30, window: int = 1) -> DataFrame:
    """Paragraphs (doc_id, paragraph_id, paragraph) of each document by hits of a term's words: (doc_id, paragraph_id, hits, place).

    The best comes first, then those within ``window`` of it in their order,
    then the others by hits, ``limit`` in all.  Words of one letter count for
    nothing; ``paragraph_id`` counts from 0 without gaps.
    """
    tokens = [t.lower() for t in re.split("[^a-zA-Z0-9\u4e00-\u9fff]+", term) if len(t) > 1]
    low = F.lower("paragraph")
    hits = sum((F.contains(low, F.lit(t)).cast("int") for t in tokens), F.lit(0))
    rows = paragraphs.select("doc_id", "paragraph_id", hits.alias("hits"))
    best = rows.groupBy("doc_id").agg(F.min_by("paragraph_id", F.struct(-F.col("hits"), F.col("paragraph_id"))).alias("best"))
    away = F.col("paragraph_id") - F.col("best")
    turn = F.when(away == 0, 0).when(F.abs(away) <= window, 1).otherwise(2)
    ordered = rows.join(best, "doc_id").withColumn("turn", turn)
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("turn", F.when(F.col("turn") == 1, 0).otherwise(-F.col("hits")), "paragraph_id"))
    return ordered.withColumn("place", place).where(F.col("place") <= limit).select("doc_id", "paragraph_id", "hits", "place")
