"""Small building blocks of listings and reports: excerpts, histograms, reasons, latest rows, back-fill, peers, prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Two maps of relation types that are in use side by side; they differ and are never one.
CLUSTER_TYPES = {
    "structural_connection": "structural",
    "functional_connectivity": "functional",
    "uncertain_connection": "uncertain",
    "projection": "projection",
    "association": "association",
}
CANONICAL_TYPES = {
    "structural_connection": "structural",
    "projection": "structural",
    "functional_connectivity": "functional",
    "effective_connectivity": "functional",
    "coactivation": "coactivation",
    "association": "association",
    "uncertain_connection": "uncertain",
    "unknown": "uncertain",
}


def excerpt(text: Column | str, chars: int = 200) -> Column:
    """The first ``chars`` characters of a text."""
    return F.substring(text, 1, chars)


def first_items(items: Column, most: int = 10) -> Column:
    """The first ``most`` items of an array."""
    return F.slice(items, 1, most)


def json_holds(ids: Column | str, wanted: Column) -> Column:
    """Whether a JSON array of whole numbers holds ``wanted``; anything else holds nothing."""
    return F.coalesce(F.array_contains(F.from_json(ids, "array<bigint>"), wanted), F.lit(False))


def with_latest(rows: DataFrame, others: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of the last of ``others`` by ``order`` under the same key; nulls where there is none.

    One aggregation with map-side maximum and a left join, instead of a query for each row.
    """
    last = others.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
    return rows.join(last, key, "left").select(*rows.columns, *[F.col("_last")[c].alias(c) for c in columns])


def group_sizes(rows: DataFrame, *keys: str) -> DataFrame:
    """(size, groups): how many groups have how many rows."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def merge_reasons(rows: DataFrame, keys: list[str], pattern: list[str]) -> DataFrame:
    """Why the rows of a group are one: several side patterns, several rows, or neither: (keys, patterns, n, reason)."""
    g = rows.groupBy(*keys).agg(F.count_distinct(*pattern).alias("patterns"), F.count(F.lit(1)).alias("n"))
    reason = F.when(F.col("patterns") > 1, "hemisphere_specific").when(F.col("n") > 1, "duplicate_evidence").otherwise("single")
    return g.withColumn("reason", reason)


def source_counts(rows: DataFrame, keys: list[str], source: str) -> DataFrame:
    """(keys, sources): a map from each source of a group to its count; sources are few."""
    counted = rows.where(F.col(source).isNotNull()).groupBy(*keys, source).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(source, "n")))).alias("sources"))


def similar_prefixes(names: DataFrame, name: str, least: float = 0.5, shared: int = 2) -> DataFrame:
    """(a, b, similarity) of names a < b: length of the common prefix over the longer length, two decimals.

    Pairs meet by their first ``shared`` characters and, since the longer name
    may have at most 1 / ``least`` times the prefix, by the prefix that a
    similarity of ``least`` asks of the longer one.
    """
    n = F.col(name)
    once = names.where(F.length(n) >= shared).select(n.alias("x")).distinct()
    # the prefix that a pair whose longer name has this length has to share
    need = F.greatest(F.ceil(F.length("x") * (least - 0.005)).cast("int"), F.lit(shared))
    longer = once.select(F.col("x").alias("p"), need.alias("k")).withColumn("head", F.expr("substring(p, 1, k)"))
    # any name that begins like it and isn't longer
    heads = once.select(F.col("x").alias("q"), F.explode(F.sequence(F.lit(shared), F.length("x"))).alias("k")).withColumn("head", F.expr("substring(q, 1, k)"))
    pairs = longer.join(heads, ["head", "k"]).where("q <> p and (length(q) < length(p) or (length(q) = length(p) and q < p))")
    common = F.expr("size(filter(sequence(1, length(q)), i -> substring(p, 1, i) = substring(q, 1, i)))")
    scored = pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.round(common / F.length("p"), 2).alias("similarity"))
    return scored.where(F.col("similarity") >= least)


def peer_counts(rows: DataFrame, anchor: str, terminal: Column) -> DataFrame:
    """``rows`` with ``peers``: how many other rows at the same anchor are terminal; null anchors are one, null counts as not terminal."""
    done = F.coalesce(terminal, F.lit(False)).cast("int")
    total = rows.groupBy(F.col(anchor).alias("_anchor")).agg(F.sum(done).alias("_done"))
    joined = rows.join(total, F.col(anchor).eqNullSafe(F.col("_anchor")))
    return joined.withColumn("peers", F.col("_done") - done).drop("_done", "_anchor")


def back_filled(canonical: DataFrame, ids: str, key: str, originals: DataFrame, original: str) -> DataFrame:
    """``originals`` with the ``key`` of the canonical row whose JSON array ``ids`` names them; null where none does."""
    named = canonical.select(F.col(key), F.explode(F.from_json(ids, "array<bigint>")).alias(original)).groupBy(original).agg(F.min(key).alias(key))
    return originals.join(named, original, "left")


def report(rows: DataFrame, reason: str, newest: str, key: str, most: int) -> DataFrame:
    """The first ``most`` rows by reason, newest first; ``key`` settles ties."""
    return rows.orderBy(reason, F.desc(newest), key).limit(most)
