"""Resolution of names to entities over an index of keys in order of priority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import written


def name_index(*levels: tuple[str, DataFrame]) -> DataFrame:
    """(key, method, priority, entity) of all levels, the first of highest priority; each is (key, entity)."""
    out = None
    for k, (method, keys) in enumerate(levels):
        part = keys.toDF("key", "entity").where("key is not null and key <> ''").select("key", F.lit(method).alias("method"), F.lit(k).alias("priority"), "entity").distinct()
        out = part if out is None else out.unionByName(part)
    return out


def cascade(queries: DataFrame, index: DataFrame) -> DataFrame:
    """The first hit of each query (query, key) by priority: entity, method; unresolved ones keep nulls.

    Of several entities at the deciding level the smallest is taken.
    """
    hits = queries.join(index, "key").groupBy("query").agg(F.min(F.struct("priority", "entity", "method")).alias("hit"))
    return queries.select("query").distinct().join(hits, "query", "left").select("query", F.col("hit.entity").alias("entity"), F.coalesce("hit.method", F.lit("unresolved")).alias("method"))


def resolve(queries: DataFrame, index: DataFrame) -> DataFrame:
    """As ``cascade``, but where the deciding level has several entities none is chosen: they are candidates."""
    hits = queries.join(index, "key").groupBy("query", "priority", "method").agg(F.count_distinct("entity").alias("n"), F.min("entity").alias("entity"))
    best = hits.groupBy("query").agg(F.min(F.struct("priority", "method", "n", "entity")).alias("b"))
    all_ = queries.select("query").distinct().join(best, "query", "left")
    status = F.when(F.col("b").isNull(), "unresolved").when(F.col("b.n") > 1, "ambiguous").otherwise("resolved")
    return all_.select(
        "query", status.alias("status"), F.col("b.method").alias("method"), F.coalesce("b.n", F.lit(0)).alias("candidates"), F.when(F.col("b.n") == 1, F.col("b.entity")).alias("entity")
    )


#: Least similarity and shared letters of a name that is offered, and how many are.
FUZZY, SHARED, OFFERED = 0.5, 2, 5


def prefix_matches(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query, region, score): shared prefix over the longer length, at least FUZZY; the best of each region.

    ``queries``: query, norm; ``names``: region, norm.  Who is longer must share
    a prefix of a length that follows from its own, so both sides meet by
    equality of that prefix, and only names as short or shorter are asked: their
    prefixes that no longer name asks for are left out.  Queries of one norm ask once.
    """
    need = lambda size: F.greatest(F.ceil(size * (FUZZY - 0.005)).cast("int"), F.lit(SHARED))

    def led(df: DataFrame) -> DataFrame:
        """Each name with the prefix that a match with it as the longer one needs."""
        return df.where(F.length("norm") >= SHARED).withColumn("k", need(F.length("norm"))).withColumn("head", F.expr("substring(norm, 1, k)"))

    def cut(df: DataFrame) -> DataFrame:
        """Each name with its prefixes that one as long or longer may need."""
        return df.where(F.length("norm") >= SHARED).withColumn("k", F.explode(F.sequence(need(F.length("norm")), F.length("norm")))).withColumn("head", F.expr("substring(norm, 1, k)"))

    q, n = queries.select("norm").distinct(), names.select("region", "norm").distinct()
    longer = led(n).withColumnRenamed("norm", "name").join(cut(q), ["head", "k"]).where("length(norm) <= length(name)")
    shorter = led(q).join(cut(n).withColumnRenamed("norm", "name"), ["head", "k"]).where("length(norm) > length(name)")
    both = longer.select("norm", "region", "name").unionByName(shorter.select("norm", "region", "name")).where("norm <> name")
    common = F.expr("size(filter(sequence(1, least(length(norm), length(name))), i -> substring(norm, 1, i) = substring(name, 1, i)))")
    scored = both.withColumn("score", F.round(common / F.greatest(F.length("norm"), F.length("name")), 2))
    best = scored.where(F.col("score") >= FUZZY).groupBy("norm", "region").agg(F.max("score").alias("score"))
    return queries.select("query", "norm").distinct().join(best, "norm").groupBy("query", "region").agg(F.max("score").alias("score"))


def resolve_levels(queries: DataFrame, index: DataFrame, chosen: list[str], names: DataFrame) -> DataFrame:
    """Names (query, norm) through levels of exact keys, then by similar prefixes.

    ``index``: method, priority, key, region, confidence.  The first level with
    a hit decides.  One region there resolves the name; several are candidates,
    surest first, and none is chosen, but at the levels in ``chosen``, where the
    smallest is.  Names without a hit get the OFFERED most similar of
    ``names`` (region, norm) as candidates, which are only looked for where the levels fail.
    Empty and null names stay unresolved.
    """
    # every step below asks the same, and would read what the names come from anew
    asked = written(queries.select("query", "norm").distinct())
    hits = asked.join(index, F.col("norm") == F.col("key")).groupBy("query", "priority", "method", "region").agg(F.max("confidence").alias("confidence"))
    entry = F.struct((-F.col("confidence")).alias("order"), "region")
    level = hits.groupBy("query", "priority", "method").agg(F.array_sort(F.collect_list(entry)).alias("found"))
    best = level.groupBy("query").agg(F.min_by(F.struct("method", "found"), "priority").alias("b"))
    offered = prefix_matches(asked.where("norm <> ''").join(best, "query", "left_anti"), names)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "region"))
    fuzzy = offered.withColumn("k", rank).where(F.col("k") <= OFFERED).groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "region"))).alias("offers"))
    told = asked.select("query").distinct().join(best, "query", "left").join(fuzzy, "query", "left")
    single = (F.size("b.found") == 1) | F.col("b.method").isin(*chosen)
    listed = lambda c: F.transform(c, lambda x: F.struct(x["region"].alias("region"), (-x["order"]).alias("confidence")))
    smallest = F.array_min(F.transform("b.found", lambda x: F.struct(x["region"].alias("region"), (-x["order"]).alias("confidence"))))
    several = F.when(F.col("b").isNotNull() & ~single, listed("b.found")).when(F.col("offers").isNotNull(), listed("offers"))
    return told.select(
        "query",
        F.when(F.col("b").isNotNull() & single, "resolved").when(several.isNotNull(), "candidates").otherwise("unresolved").alias("status"),
        F.when(F.col("b").isNotNull(), F.col("b.method")).when(F.col("offers").isNotNull(), "fuzzy").alias("method"),
        F.when(F.col("b").isNotNull() & single, smallest["region"]).alias("region"),
        F.when(F.col("b").isNotNull() & single, smallest["confidence"]).alias("confidence"),
        several.alias("candidates"),
    )


def unordered_match(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) that are known in either order, by one equality join on ordered ends."""
    return pairs.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b")).join(
        known.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), ["lo", "hi"], "left_semi"
    )
