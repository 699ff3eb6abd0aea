"""Movement between layers: merges, upserts, differences, triples, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_best(rows: DataFrame, key: list[str], better: list[Column]) -> DataFrame:
    """One row for each key, the first in the given order, with the number of rows that it stands for."""
    ordered = W.partitionBy(*key).orderBy(*better)
    marked = rows.withColumn("_k", F.row_number().over(ordered)).withColumn("merged", F.count(F.lit(1)).over(W.partitionBy(*key)))
    return marked.where("_k = 1").drop("_k")


def insert_missing(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Existing rows, and new ones whose key isn't there yet; of new rows with one key the first by all columns."""
    first = new.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(*new.columns))).where("_k = 1").drop("_k")
    return existing.unionByName(first.join(existing.select(*key), key, "left_anti"))


def upsert(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Existing rows overlaid with new values that aren't null, and new rows; ``new`` has each key once."""
    values = [c for c in existing.columns if c not in key]
    fresh = new.select(*key, *[F.col(c).alias(f"_new_{c}") for c in values])
    joined = existing.join(fresh, key, "full_outer")
    return joined.select(*key, *[F.coalesce(f"_new_{c}", c).alias(c) for c in values])


def difference(desired: DataFrame, existing: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, action): insert, update, keep or delete to come from the existing rows to the desired ones."""
    a = desired.select(*key, F.col(value).alias("_want"), F.lit(True).alias("_a"))
    b = existing.select(*key, F.col(value).alias("_have"), F.lit(True).alias("_b"))
    action = F.when(F.col("_b").isNull(), "insert").when(F.col("_a").isNull(), "delete").when(~F.col("_want").eqNullSafe(F.col("_have")), "update").otherwise("keep")
    return a.join(b, key, "full_outer").select(*key, action.alias("action"))


def triples(*sources: DataFrame) -> DataFrame:
    """(subject, predicate, object) of all sources, each once, with the number of sources."""
    out = None
    for k, s in enumerate(sources):
        part = s.toDF("subject", "predicate", "object").where("subject is not null and object is not null").withColumn("_s", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("subject", "predicate", "object").agg(F.count_distinct("_s").alias("sources"))


def overlay(rows: DataFrame, corrections: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with approved corrections laid over them where those aren't null."""
    fresh = corrections.select(key, *[F.col(c).alias(f"_fix_{c}") for c in columns])
    joined = rows.join(fresh, key, "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(f"_fix_{c}", c)).drop(f"_fix_{c}")
    return joined


def token_parents(terms: DataFrame, top: int = 10) -> DataFrame:
    """For each term the terms whose words are a proper part of its own: (child, parent, score)."""
    cut = terms.select("term").distinct().withColumn("w", F.array_distinct(F.split("term", " ")))
    posted = cut.select("term", F.size("w").alias("n"), F.explode("w").alias("word"))
    a, b = posted.toDF("child", "n_child", "word"), posted.toDF("parent", "n_parent", "word")
    shared = a.join(b, "word").where("n_parent < n_child").groupBy("child", "parent", "n_child", "n_parent").agg(F.count(F.lit(1)).alias("n"))
    score = F.round(F.col("n_parent") / F.col("n_child"), 4)
    found = shared.where("n = n_parent").withColumn("score", score)
    rank = F.row_number().over(W.partitionBy("child").orderBy(F.desc("score"), "parent"))
    return found.withColumn("k", rank).where(F.col("k") <= top).select("child", "parent", "score", "k")


def numbered_codes(rows: DataFrame, base: Column, order: list[Column]) -> DataFrame:
    """``code``: the base, with a number behind it from the second row of one base on."""
    k = F.row_number().over(W.partitionBy("_base").orderBy(*order))
    out = rows.withColumn("_base", base).withColumn("_k", k)
    return out.withColumn("code", F.when(F.col("_k") == 1, F.col("_base")).otherwise(F.concat_ws("_", "_base", F.col("_k").cast("string")))).drop("_base", "_k")


def lineage(canonical: DataFrame, source: DataFrame, ids: str, key: str) -> DataFrame:
    """Source rows of each canonical row, from its list of ids."""
    return canonical.select("canonical_id", F.explode(ids).alias(key)).join(source, key)


def manifest(**parts: DataFrame) -> DataFrame:
    """(part, rows) of an export."""
    out = None
    for name, df in sorted(parts.items()):
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("part"), "rows")
        out = row if out is None else out.union(row)
    return out
