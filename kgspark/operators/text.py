"""Text mining: sentences, lexicon scans, co-occurrence, support and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import jaccard, trigrams, words

PROXIMITY = {"same_sentence": 0.8, "same_section": 0.6, "same_paper": 0.4}


def sentences(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, or doc_id; sentence_id from 0, sentence): texts cut behind a stop, question or exclamation mark and white space."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    return docs.select(*(keys or ["doc_id"]), F.posexplode(parts).alias("sentence_id", "sentence"))


def lexicon(docs: DataFrame, pattern: str, low: int, high: int, top: int) -> DataFrame:
    """The ``top`` words by document frequency, of those in [low, high]: (term, df)."""
    found = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({pattern})"), 1))).alias("term"))
    counted = found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df").between(low, high))
    return counted.orderBy(F.desc("df"), "term").limit(top)


def scan(sents: DataFrame, terms: DataFrame, pattern: str) -> DataFrame:
    """Mentions (sentence keys, term, hits): terms of the lexicon that stand as words in a sentence.

    Sentences are cut to words once and joined by equality, so the cost follows
    the text and not the text times the lexicon.
    """
    found = sents.select("doc_id", "sentence_id", F.explode(F.regexp_extract_all("sentence", F.lit(f"({pattern})"), 1)).alias("term"))
    return found.join(terms.select("term"), "term").groupBy("doc_id", "sentence_id", "term").agg(F.count(F.lit(1)).alias("hits"))


def cooccurrence(mentions: DataFrame, section_size: int) -> DataFrame:
    """For each document and unordered pair of terms the strongest level of co-occurrence.

    Sections are runs of ``section_size`` sentences.  The first sentence of the
    smaller term at that level is the evidence.
    """
    section = (F.col("sentence_id") / section_size).cast("int")
    m = mentions.select("doc_id", "sentence_id", section.alias("section"), "term")
    pairs = None
    # each level pairs the different terms of a sentence, a section, a document, not their mentions
    for level, place in enumerate((["doc_id", "sentence_id"], ["doc_id", "section"], ["doc_id"])):
        terms = m.groupBy(*place, "term").agg(F.min("sentence_id").alias("s"))
        a, b = terms.withColumnRenamed("term", "lo"), terms.drop("s").withColumnRenamed("term", "hi")
        met = a.join(b, place).where("lo < hi").select("doc_id", "lo", "hi", F.struct(F.lit(level).alias("level"), F.col("s")).alias("at"))
        pairs = met if pairs is None else pairs.union(met)
    best = pairs.groupBy("doc_id", "lo", "hi").agg(F.min("at").alias("best"))
    names = F.when(F.col("best.level") == 0, "same_sentence").when(F.col("best.level") == 1, "same_section").otherwise("same_paper")
    score = F.when(F.col("best.level") == 0, PROXIMITY["same_sentence"]).when(F.col("best.level") == 1, PROXIMITY["same_section"]).otherwise(PROXIMITY["same_paper"])
    return best.select("doc_id", "lo", "hi", names.alias("level"), score.alias("score"), F.col("best.s").alias("sentence_id"))


def support_sentences(mentions: DataFrame, pairs: DataFrame) -> DataFrame:
    """The first sentence of each document that mentions both terms of a pair (lo, hi)."""
    a = mentions.select("doc_id", "sentence_id", F.col("term").alias("lo"))
    b = mentions.select("doc_id", "sentence_id", F.col("term").alias("hi"))
    both = pairs.select("lo", "hi").join(a, "lo").join(b, ["doc_id", "sentence_id", "hi"])
    return both.groupBy("doc_id", "lo", "hi").agg(F.min("sentence_id").alias("sentence_id"))


def neighbours(sents: DataFrame) -> DataFrame:
    """Each sentence's length with that of the one before and behind it in its document."""
    w = W.partitionBy("doc_id").orderBy("sentence_id")
    size = F.length("sentence")
    return sents.select("doc_id", "sentence_id", size.alias("size"), F.lag(size).over(w).alias("before"), F.lead(size).over(w).alias("behind"))


def paragraph_scores(docs: DataFrame, source: str, target: str, relation: str) -> DataFrame:
    """Rule score of a paragraph (doc_id, paragraph) for two terms and a relation word, with proximity in it."""

    def hits(word: str) -> Column:
        return F.regexp_count(F.lower("paragraph"), F.lit(rf"\b{word}\b"))

    s, t, r = hits(source), hits(target), hits(relation)
    score = F.when(s > 0, 20).otherwise(0) + F.when(t > 0, 20).otherwise(0) + F.least(r * 6, F.lit(18)) + F.when((s > 0) & (t > 0), 30).otherwise(0)
    return docs.select("doc_id", "paragraph_id", score.cast("int").alias("score")).where("score > 0")


def paragraphs(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph_id", "paragraph")).where("paragraph <> ''")


def verify_passages(passages: DataFrame, docs: DataFrame, cited: DataFrame) -> DataFrame:
    """How each cited passage (item_id, doc_id) stands in its document.

    exact, whitespace (equal but for white space), similar (word sets at 0.8 or
    more of the passage's), else none.
    """
    joined = cited.join(passages.select("item_id", F.col("text").alias("passage")), "item_id").join(docs.select("doc_id", "text"), "doc_id")

    def flat(c: str) -> Column:
        return F.trim(F.regexp_replace(c, r"\s+", " "))

    own = words(F.col("passage"))
    share = F.size(F.array_intersect(own, words(F.col("text")))) / F.greatest(F.size(own), F.lit(1))
    label = F.when(F.contains("text", F.col("passage")), "exact").when(F.contains(flat("text"), flat("passage")), "whitespace").when(share >= 0.8, "similar").otherwise("none")
    return joined.select("item_id", "doc_id", label.alias("status"))


def similar_names(names: DataFrame, least: float) -> DataFrame:
    """Pairs of different names whose trigram sets reach a similarity.

    Pairs meet by a name's rarer trigrams only, as many as make sure that names
    so alike share one of them, and only where neither set is too small for the other.
    """
    own = names.select("name").distinct().withColumn("grams", F.array_distinct(trigrams(F.col("name")))).where(F.size("grams") > 0)
    posted = own.select("name", F.explode("grams").alias("gram"))
    common = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    ranked = F.array_sort(F.collect_list(F.struct("df", "gram")))
    sets = posted.join(common, "gram").groupBy("name").agg(F.transform(ranked, lambda g: g["gram"]).alias("grams")).withColumn("n", F.size("grams"))
    # what is rounded up to the least counts as well
    bound = least - 0.00005
    rare = sets.withColumn("gram", F.explode(F.expr(f"slice(grams, 1, n - cast(ceil({bound!r} * n) as int) + 1)")))
    met = rare.select("gram", F.col("name").alias("lo"), F.col("n").alias("n_lo"), F.col("grams").alias("a")).join(rare.select("gram", F.col("name").alias("hi"), F.col("n").alias("n_hi"), F.col("grams").alias("b")), "gram")
    met = met.where(F.col("lo") < F.col("hi")).where((F.col("n_lo") >= F.col("n_hi") * bound) & (F.col("n_hi") >= F.col("n_lo") * bound))
    # a pair counts where its rarest shared trigram is met
    both = met.withColumn("shared", F.array_intersect("a", "b")).where(F.get("shared", F.lit(0)) == F.col("gram"))
    score = F.size("shared") / (F.col("n_lo") + F.col("n_hi") - F.size("shared"))
    return both.withColumn("similarity", F.round(score, 4)).where(F.col("similarity") >= least).select("lo", "hi", "similarity")


def title_similarity(rows: DataFrame, a: str, b: str) -> Column:
    return F.round(jaccard(words(F.col(a)), words(F.col(b))), 4)


def term_recommendations(queries: DataFrame, terms: DataFrame, least: float = 0.4, top: int = 3) -> DataFrame:
    """Terms by shared words over the longer word list: the best ``top`` of each query (query, term columns of names)."""

    def posted(df: DataFrame, name: str, size: str) -> DataFrame:
        w = words(F.col(name))
        return df.select(name).distinct().select(name, F.size(w).alias(size), F.explode(w).alias("word"))

    shared = posted(queries, "query", "nq").join(posted(terms, "term", "nt"), "word").groupBy("query", "term", "nq", "nt").agg(F.count(F.lit(1)).alias("n"))
    score = F.round(F.col("n") / F.greatest("nq", "nt"), 4)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "term"))
    return shared.withColumn("score", score).where(F.col("score") >= least).withColumn("k", rank).where(F.col("k") <= top).select("query", "term", "score", "k")


def page_titles(pages: DataFrame) -> DataFrame:
    """Title and language of raw pages, and how many links and paragraphs they have."""
    return pages.select(
        "page_id",
        F.trim(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)).alias("title"),
        F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("lang"),
        F.regexp_count("html", F.lit("<a href=")).cast("long").alias("links"),
        F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"),
    )
