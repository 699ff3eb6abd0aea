"""Papers and citations: parsing, matching, deduplication, blocks and screening."""

from __future__ import annotations

import re
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions.slices import map_slices
from .graph import checkpointed

#: Words, years and single signs of a text.
_TOKEN = re.compile(r"[^\W\d_][\w.'\-]*|\d+[a-z]?|\S")
#: Names that one author, or the second of two, may have.
_NAMES = 3


def _kind(token: str) -> str:
    """What a token may be in a citation: name, initial, et, al, and, year, or the sign itself."""
    bare = token.replace(".", "")
    if token in ("&", "and"):
        return "and"
    if token in ("et", "al", "al."):
        return token.rstrip(".")
    if token[0].isdigit():
        return "year" if 1800 <= int(token.rstrip("abcdefghijklmnopqrstuvwxyz") or 0) <= 2099 and len(token.rstrip("abcdefghijklmnopqrstuvwxyz")) == 4 else "word"
    if token[0].isalpha():
        if bare.isupper() and (len(bare) == 1 or "." in token):
            return "initial"
        return "name" if token[0].isupper() and "." not in token else "word"
    return token


def _authors_start(kinds: list[str], end: int, floor: int) -> int | None:
    """Where the authors that end before token ``end`` begin: names [and names], then initials and "et al."."""
    at = end
    while at > floor and (kinds[at - 1] in ("initial", ",") or (kinds[at - 1] == "al" and at - 1 > floor and kinds[at - 2] == "et")):
        at -= 2 if kinds[at - 1] == "al" else 1
    for side in range(2):
        first = at
        while at > floor and kinds[at - 1] == "name" and first - at < _NAMES:
            at -= 1
        if at == first:
            # no name where one must be: after "and" the authors begin behind it
            return at + 1 if side else None
        if side or at - 1 <= floor or kinds[at - 1] != "and" or kinds[at - 2] != "name":
            break
        at -= 1
    return at


def citations_of(text: str | None) -> list[dict]:
    """Citations of a text, by place: author group, year, the words as they stand, place.

    A citation is authors before a year in parentheses of its own, or one of
    several "authors, year" that fill parentheses, parted by semicolons.
    """
    text = text or ""
    tokens = list(_TOKEN.finditer(text))
    kinds = [_kind(t[0]) for t in tokens]
    found: list[dict] = []

    def add(first: int, last: int, year: int, begin: int, end: int) -> None:
        author = " ".join(text[tokens[first].start() : tokens[last].end()].split()).rstrip(",")
        found.append({"author": author, "year": tokens[year][0], "original": text[begin:end], "pos": begin})

    for k, kind in enumerate(kinds):
        if kind != "(":
            continue
        close = next((j for j in range(k + 1, len(kinds)) if kinds[j] in "()"), None)
        if close is None or kinds[close] != ")":
            continue
        if close == k + 2 and kinds[k + 1] == "year":
            start = _authors_start(kinds, k, 0)
            if start is not None:
                add(start, k - 1, k + 1, tokens[start].start(), tokens[close].end())
            continue
        marks = [k, *(j for j in range(k + 1, close) if kinds[j] == ";"), close]
        parts = [(a + 1, b - 1) for a, b in zip(marks, marks[1:])]
        # every part is authors, a comma and a year
        if all(y - a >= 2 and kinds[y] == "year" and kinds[y - 1] == "," and _authors_start(kinds, y - 1, a) == a for a, y in parts):
            for a, y in parts:
                add(a, y - 2, y, tokens[k].start(), tokens[close].end())
    once = {(c["pos"], c["author"], c["year"]): c for c in found}
    return [once[c] for c in sorted(once)]


def citations(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, author, year, original, pos) of all citations; null and empty texts have none."""

    @F.pandas_udf("array<struct<author:string,year:string,original:string,pos:int>>")
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(citations_of)

    return docs.select(key, F.explode(parse(text)).alias("c")).select(key, "c.*")


def surnames(authors: Column) -> Column:
    """Lower-case surnames of an author string; "et al" and initials of up to three capitals go."""
    plain = F.regexp_replace(authors, r"\bet al\.?", "")
    parts = F.split(F.regexp_replace(plain, r"&| and |,", " "), r"\s+")
    bare = lambda w: F.regexp_replace(w, r"\.", "")
    return F.transform(F.filter(parts, lambda w: (w != "") & ~bare(w).rlike(r"^\P{Ll}{0,3}$")), lambda w: F.lower(w))


def match_citations(cited: DataFrame, library: DataFrame) -> DataFrame:
    """(id, matches, grade, paper): A for one paper of the year that shares a surname, B for several, C for none.

    ``cited``: id, author, year.  ``library``: paper, authors, year.  Joined by
    (surname, year), so no citation meets all papers; citations that ask for
    the same names and year are matched as one.
    """
    year = F.regexp_extract("year", r"^(\d{4})", 1).cast("int")
    named = F.when(F.col("id").isNotNull(), F.transform(surnames(F.col("author")), lambda s: F.struct(year.alias("year"), s.alias("surname"))))
    # dealt before they are grouped, so no task holds what one file has; a null id asks for nothing
    of = cited.select("id", named.alias("w")).repartition("id").groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("w")))).alias("wants"))
    asked = of.select("wants").distinct().select("wants", F.inline("wants"))
    known = library.select("paper", F.col("year").cast("int").alias("year"), F.explode(F.array_distinct(surnames(F.col("authors")))).alias("surname"))
    hits = asked.join(known, ["year", "surname"]).groupBy("wants").agg(F.count_distinct("paper").alias("matches"), F.min("paper").alias("paper"))
    n = F.coalesce("matches", F.lit(0))
    grade = F.when(n == 1, "A_unique").when(n > 1, "B_multiple").otherwise("C_local_unmatched")
    return of.join(hits, "wants", "left").select("id", n.alias("matches"), grade.alias("grade"), F.when(n == 1, F.col("paper")).alias("paper"))


def first_papers(papers: DataFrame, order: str, keys: tuple[str, ...] = ("pmid", "doi"), max_rounds: int = 100) -> DataFrame:
    """Papers that share no key with an earlier one that is itself kept; empty keys match nothing.

    ``order`` is unique.  A paper is settled once no open paper before it
    shares a key: it is kept, and those after it that share one go.  Each round
    settles the first of every group of keys.
    """
    named = papers.select(F.col(order).alias("at"), *[F.when(F.lower(F.trim(F.col(k).cast("string"))) != "", F.lower(F.trim(F.col(k).cast("string")))).alias(k) for k in keys])
    open_, kept = checkpointed(named), None
    for _ in range(max_rounds):
        marked = open_
        for k in keys:
            least = open_.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("at").alias(f"_{k}"))
            marked = marked.join(least, k, "left")
        first = F.lit(True)
        for k in keys:
            first = first & (F.coalesce(f"_{k}", "at") == F.col("at"))
        marked = checkpointed(marked.select("at", *keys, first.alias("first")))
        now = marked.where("first").drop("first")
        kept = now if kept is None else kept.union(now)
        rest = marked.where("not first").drop("first")
        for k in keys:
            rest = rest.join(now.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")
        open_ = checkpointed(rest)
        if open_.isEmpty():
            return papers.join(kept.select(F.col("at").alias(order)), order, "left_semi")
    raise RuntimeError("papers did not settle")


def longest_passages(passages: DataFrame, group: list[str], text: str, order: str) -> DataFrame:
    """Of each group the longest passage, of equally long ones the first."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(F.desc(F.coalesce(F.length(text), F.lit(0))), order))
    return passages.withColumn("_k", rank).where("_k = 1").drop("_k")


def block_numbers(sizes: list[int], target: int = 800) -> list[int]:
    """Block of each paragraph: a block closes before the next one once it holds ``target`` characters."""
    out, block, held = [], 0, 0
    for k, size in enumerate(sizes):
        if k and held >= target:
            block, held = block + 1, 0
        out.append(block)
        held += size
    return out


def semantic_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", target: int = 800, most: int | None = None) -> DataFrame:
    """(key, block, first, paragraphs, chars) of whole paragraphs in order; ``most``, where given, is how many blocks of a text a reviewer is handed."""

    names = ["block", "first", "paragraphs", "chars"]

    def cut(part: pa.RecordBatch) -> list:
        row, out = [], []
        for k, t in enumerate(part.column(1).to_pylist()):
            sizes = [len(p) for p in (t or "").split("\n") if p.strip()]
            first = 0
            for b, held in groupby(zip(block_numbers(sizes, target), sizes), key=lambda x: x[0]):
                held = [n for _, n in held]
                row.append(k)
                out.append((b, first, len(held), sum(held)))
                first += len(held)
        return [part.column(0).take(pa.array(row, pa.int64())), *(list(c) for c in zip(*out))] if out else [[]] * 5

    schema = StructType([docs.schema[key], *(StructField(c, IntegerType() if c in names[:2] else LongType()) for c in names)])
    rows = map_slices(docs.select(key, text), [text], cut, schema)
    rows = rows if most is None else rows.where(F.col("block") < most)
    # rows with an equal key count together
    return rows.groupBy(key, "block").agg(F.min("first").alias("first"), F.sum("paragraphs").alias("paragraphs"), F.sum("chars").alias("chars"))


def screen(sentences: DataFrame, source: str, target: str, relation: str, bonus: float = 0.0) -> DataFrame:
    """Evidence for two terms (patterns) in a paragraph: (doc_id, paragraph_id, sentence_id, level, proximity, confidence).

    ``sentences``: doc_id, paragraph_id, sentence_id, sentence.  strong: both
    terms and a relation word in one sentence, more where the source stands
    first; medium: the target in the sentence before or behind, with a relation
    word in either, or (only where there is nothing else) in the paragraph.
    """
    w = W.partitionBy("doc_id", "paragraph_id").orderBy("sentence_id")
    whole = W.partitionBy("doc_id", "paragraph_id")
    at = lambda p: F.regexp_instr(F.lower("sentence"), F.lit(p))
    s = sentences.withColumns({"_s": at(source), "_t": at(target), "_r": at(relation) > 0})
    near = F.lit(False)
    for side in (F.lag, F.lead):
        near = near | ((F.coalesce(side("_t").over(w), F.lit(0)) > 0) & (F.col("_r") | F.coalesce(side("_r").over(w), F.lit(False))))
    marked = s.withColumns(
        {"_strong": (F.col("_s") > 0) & (F.col("_t") > 0) & F.col("_r"), "_near": (F.col("_s") > 0) & (F.col("_t") == 0) & near}
    ).withColumns(
        {
            "_any": F.max(F.col("_strong") | F.col("_near")).over(whole),
            "_rel": F.max("_r").over(whole),
            "_has_t": F.max(F.col("_t") > 0).over(whole),
            "_first": F.min(F.when(F.col("_s") > 0, F.col("sentence_id"))).over(whole),
        }
    )
    far = ~F.col("_any") & F.col("_rel") & F.col("_has_t") & (F.col("sentence_id") == F.col("_first"))
    proximity = F.when(F.col("_strong"), "same_sentence").when(F.col("_near"), "adjacent_sentence").when(far, "same_paragraph")
    score = F.when(F.col("_strong") & (F.col("_s") < F.col("_t")), 0.90).when(F.col("_strong"), 0.86).when(F.col("_near"), 0.65).otherwise(0.58)
    return marked.where(proximity.isNotNull()).select(
        "doc_id", "paragraph_id", "sentence_id", F.when(F.col("_strong"), "strong").otherwise("medium").alias("level"), proximity.alias("proximity"), F.least(F.lit(0.92), score + bonus).alias("confidence")
    )
