"""Raw connections to canonical ones: endpoints grounded through levels, rows grouped under keys, nothing misclassified in silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import mapped
from .evidence import directionality

# --- fixed values: canonical types and directions by raw ones; methods and reasons ---
TYPES = {
    "structural_connection": "structural",
    "projection": "structural",
    "functional_connectivity": "functional",
    "effective_connectivity": "functional",
    "coactivation": "coactivation",
    "association": "association",
    "uncertain_connection": "uncertain",
    "unknown": "uncertain",
}
DIRECTIONS = {"directed": "directed", "source_to_target": "directed", "bidirectional": "bidirectional", "undirected": "undirected", "unknown": "unspecified"}
CANDIDATE, EXACT, NORMALIZED, ALIAS = "candidate_grounded", "name_canonical_exact", "name_normalized_exact", "name_alias_exact"
SPECIES, NO_NAME, SELF_LOOP, MAPPING = "species_mismatch", "no_name_match", "self_loop", "mapping_error"


def raw_mapped(value: Column, to: dict[str, str]) -> Column:
    """The canonical value; null and empty count as unknown, null where there is none."""
    return mapped(F.when(F.coalesce(value, F.lit("")) == "", "unknown").otherwise(value), to)


def flat_name(name: Column) -> Column:
    """Lower case, punctuation and runs of white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9\u4e00-\u9fff ]+", " "), " +", " "))


def name_keys(regions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(kind, key, region) of canonical names (region, en, cn) and aliases (region, alias); of equal keys the smallest region."""
    keys = F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in (("en", F.lower("en")), ("cn", F.col("cn")), ("en_flat", flat_name(F.col("en"))), ("cn_flat", flat_name(F.col("cn"))))])
    own = regions.select("region", F.explode(keys).alias("k")).select("k.kind", "k.key", "region")
    every = own.unionByName(aliases.select(F.lit("alias").alias("kind"), F.lower("alias").alias("key"), "region"))
    return every.where("key is not null and key <> ''").groupBy("kind", "key").agg(F.min("region").alias("region"))


def _by_name(rows: DataFrame, side: str, names: DataFrame) -> DataFrame:
    """(id, region, method) by the first level that knows a name: exact English, exact Chinese, both flattened, aliases."""
    en, cn = F.col(f"{side}_en"), F.col(f"{side}_cn")
    levels = [(EXACT, "en", F.lower(en)), (EXACT, "cn", cn), (NORMALIZED, "en_flat", flat_name(en)), (NORMALIZED, "cn_flat", flat_name(cn)), (ALIAS, "alias", F.lower(en)), (ALIAS, "alias", F.lower(cn))]
    probes = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(method).alias("method"), F.lit(kind).alias("kind"), key.alias("key")) for k, (method, kind, key) in enumerate(levels)])
    found = rows.select("id", F.explode(probes).alias("p")).select("id", "p.*").where("key <> ''").join(names, ["kind", "key"])
    return found.groupBy("id").agg(F.min_by(F.struct("region", "method"), "level").alias("n")).select("id", "n.region", "n.method")


def _endpoint(rows: DataFrame, side: str, candidates: DataFrame, names: DataFrame, foreign: list[str]) -> DataFrame:
    """(id, region, method) of one end: its candidate's region, else by name where the atlas is of the same species."""
    grounded = rows.select("id", F.col(f"{side}_candidate").alias("candidate")).join(candidates.where("region is not null").select("candidate", "region"), "candidate")
    own = grounded.select("id", "region", F.lit(CANDIDATE).alias("method"))
    rest = rows.where(~F.coalesce(F.col("atlas").isin(*foreign), F.lit(False))).join(own.select("id"), "id", "left_anti")
    return own.unionByName(_by_name(rest, side, names))


def grounded(rows: DataFrame, coverage: DataFrame, candidates: DataFrame, names: DataFrame, canonical: DataFrame, foreign: list[str]) -> DataFrame:
    """What becomes of each raw row: (id, kind, canonical, created_by, src, dst, src_method, dst_method, type, direction, reason, confidence).

    ``rows``: id (unique), src_candidate, dst_candidate, src_en, src_cn,
    dst_en, dst_cn, atlas, type, direction, confidence; ``coverage``: id,
    canonical; ``candidates``: candidate, region; ``names`` as from
    ``name_keys``; ``canonical``: src, dst, type, canonical.  Rows that a
    canonical connection's provenance covers are grounded there.  Others need
    both ends, two different regions and known values; their key is an
    existing canonical connection's, or the row of smallest id creates one
    (``created_by``) and the others of that key are grounded there.  All else is unresolved, with the first reason.
    """
    covered = rows.join(coverage.select("id", "canonical"), "id")
    named = lambda side: candidates.select(F.col("candidate").alias(f"{side}_candidate"), F.col("region").alias(side))
    back = covered.join(named("src"), "src_candidate", "left").join(named("dst"), "dst_candidate", "left").select(
        "id", F.lit("grounded").alias("kind"), "canonical", F.lit(None).cast(rows.schema["id"].dataType).alias("created_by"), "src", "dst", F.lit(CANDIDATE).alias("src_method"), F.lit(CANDIDATE).alias("dst_method"),
        F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("direction"), F.lit(None).cast("string").alias("reason"), "confidence",
    )
    left = rows.join(coverage.select("id"), "id", "left_anti")
    ends = left
    for side in ("src", "dst"):
        ends = ends.join(_endpoint(left, side, candidates, names, foreign).toDF("id", side, f"{side}_method"), "id", "left")
    kind, way = raw_mapped(F.col("type"), TYPES), raw_mapped(F.col("direction"), DIRECTIONS)
    reason = (
        F.when(F.col("src_candidate") == F.col("dst_candidate"), SELF_LOOP)
        .when(F.col("src").isNull() | F.col("dst").isNull(), F.when(F.col("atlas").isin(*foreign), SPECIES).otherwise(NO_NAME))
        .when(F.col("src") == F.col("dst"), SELF_LOOP)
        .when(kind.isNull() | way.isNull(), MAPPING)
    )
    judged = ends.select("id", "src", "dst", "src_method", "dst_method", kind.alias("type"), way.alias("direction"), reason.alias("reason"), "confidence")
    key = ["src", "dst", "type"]
    good, bad = judged.where("reason is null"), judged.where("reason is not null")
    known = good.join(canonical.select(*key, "canonical"), key, "left")
    first = known.where("canonical is null").groupBy(*key).agg(F.min("id").alias("created_by"))
    placed = known.join(first, key, "left").withColumn("created_by", F.when(F.col("canonical").isNull(), F.col("created_by")))
    placed = placed.withColumn("kind", F.when(F.col("created_by") == F.col("id"), "create").otherwise("grounded"))
    nothing = bad.select("id", *[F.lit(None).cast(judged.schema[c].dataType).alias(c) for c in (*key, "src_method", "dst_method", "direction", "confidence")], "reason", F.lit("unresolved").alias("kind"))
    return back.unionByName(placed).unionByName(nothing, allowMissingColumns=True)


def canonicalized(rows: DataFrame) -> DataFrame:
    """Canonical connections of grounded rows (id, src, dst, atlas, type, direction, confidence): a row for each key.

    Key: source, target and canonical type; with the resolved direction (which
    looks at the reverse key, too), the largest confidence, the number of rows
    and the atlas labels.  Rows of unknown values and loops are in no group;
    ``set_aside`` has them.
    """
    good = _judged(rows).where("problem is null")
    ways = directionality(good.select("src", "dst", "type", "direction", "species", "confidence"), ("type",)).select("src", "dst", "type", F.col("direction").alias("policy"), (F.col("direction") == "bidirectional").alias("both"), (F.col("directed") == F.col("total")).alias("directed"))
    groups = good.groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_set(F.coalesce("atlas", F.lit("")))).alias("atlases"))
    return groups.join(ways, ["src", "dst", "type"]).select("src", "dst", "type", "policy", "confidence", "rows", "atlases", (F.col("both") & F.col("directed")).alias("reciprocal"))


def set_aside(rows: DataFrame) -> DataFrame:
    """(id, problem): rows that go into no canonical connection; unmapped comes before self_loop."""
    return _judged(rows).where("problem is not null").select("id", "problem")


def lineage(rows: DataFrame) -> DataFrame:
    """(src, dst, type, id, raw_type, raw_direction): which rows a canonical connection stands for, a row each."""
    return _judged(rows).where("problem is null").select("src", "dst", "type", "id", "raw_type", "raw_direction")


def _judged(rows: DataFrame) -> DataFrame:
    kind, way = raw_mapped(F.col("type"), TYPES), raw_mapped(F.col("direction"), DIRECTIONS)
    problem = F.when(kind.isNull() | way.isNull(), "unmapped").when(F.col("src") == F.col("dst"), "self_loop")
    return rows.select("id", "src", "dst", "atlas", kind.alias("type"), way.alias("direction"), F.col("type").alias("raw_type"), F.col("direction").alias("raw_direction"), "confidence", F.lit("").alias("species"), problem.alias("problem"))
