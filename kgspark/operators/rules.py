"""Rules that rows have to meet, and checks of integrity between relations."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import written

SEVERITIES = ("passed", "warning", "failed", "blocked")


class Rule(NamedTuple):
    """``broken`` says where the rule fails; null counts as met."""

    code: str
    severity: str
    broken: Column


def check(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows`` with ``findings`` (code, severity of each broken rule) and ``status``, the worst severity."""
    found = F.array_compact(
        F.array(*[F.when(F.coalesce(r.broken, F.lit(False)), F.struct(F.lit(r.code).alias("code"), F.lit(SEVERITIES.index(r.severity)).alias("rank"))) for r in rules])
    )
    worst = F.coalesce(F.array_max(F.transform("findings", lambda f: f["rank"])), F.lit(0))
    return rows.withColumn("findings", found).withColumn("status", F.element_at(F.array(*map(F.lit, SEVERITIES)), worst + 1))


def summary(checked: DataFrame) -> DataFrame:
    """Broken rules with their counts."""
    return checked.select(F.explode("findings.code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def status_counts(checked: DataFrame) -> DataFrame:
    return checked.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, issue: str) -> DataFrame:
    """(issue, key as text) of rows whose key has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti").select(F.lit(issue).alias("issue"), F.col(key).cast("string").alias("key"))


def repeated(rows: DataFrame, key: list[str], issue: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.lit(issue).alias("issue"), F.concat_ws(":", *key).alias("key"))


def outside(rows: DataFrame, column: str, vocabulary: list[str], issue: str) -> DataFrame:
    """Values that the vocabulary doesn't have, with their counts."""
    odd = rows.where(~F.col(column).isin(*vocabulary))
    return odd.groupBy(column).agg(F.count(F.lit(1)).alias("n")).select(F.lit(issue).alias("issue"), F.col(column).cast("string").alias("value"), "n")


# What canonical connections and candidate regions may hold.
CONNECTION_TYPES = ["structural", "functional", "projection", "association", "uncertain"]
POLICIES = ["unspecified", "directed", "bidirectional"]
GRANULARITIES = ["clinical", "macro"]
SIDES = ["left", "right", "midline", "bilateral", "unknown"]


def check_connections(canonical: DataFrame, regions: DataFrame, lineage: DataFrame, reports: DataFrame) -> DataFrame:
    """Canonical connections against the thirteen rules: ``failed`` for hard ones, ``warning`` where a review is due.

    ``canonical``: id, src, dst, type, direction, species, granularity,
    evidence_count, provenance, confidence_count.  ``regions``: region.
    ``lineage``: id, cluster_size, report_ids.  ``reports``: report_id.
    """
    # each is asked twice: written, what makes them runs once
    canonical, lineage = written(canonical), written(lineage)
    known = regions.select("region").distinct()
    traced = lineage.groupBy("id").agg(F.count(F.lit(1)).alias("_rows"), F.sum("cluster_size").alias("_size"))
    asked = lineage.select("id", F.explode("report_ids").alias("report_id"))
    lost = asked.join(reports.select("report_id").distinct(), "report_id", "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("_lost"))
    same = canonical.groupBy("src", "dst", "type").agg(F.count(F.lit(1)).alias("_same"))
    rows = canonical.join(same, ["src", "dst", "type"], "left").join(traced, "id", "left").join(lost, "id", "left")
    for end in ("src", "dst"):
        rows = rows.join(known.select(F.col("region").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    absent = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    outside_of = lambda c, names: ~F.coalesce(F.col(c).isin(names), F.lit(False))
    checked = check(
        rows,
        [
            Rule("src_region_exists", "failed", F.col("_src").isNull()),
            Rule("tgt_region_exists", "failed", F.col("_dst").isNull()),
            Rule("src_ne_tgt", "failed", F.col("src") == F.col("dst")),
            Rule("connection_type_valid", "failed", outside_of("type", CONNECTION_TYPES)),
            Rule("direction_valid", "failed", outside_of("direction", POLICIES)),
            Rule("species_human", "failed", outside_of("species", ["human"])),
            Rule("granularity_macro", "failed", outside_of("granularity", GRANULARITIES)),
            Rule("lineage_exists", "warning", absent("_rows")),
            Rule("evidence_count_correct", "warning", F.col("evidence_count") != F.coalesce("_size", F.lit(0))),
            Rule("provenance_json_nonempty", "warning", F.coalesce("provenance", F.lit("")) == ""),
            Rule("confidence_exists", "warning", absent("confidence_count")),
            Rule("no_duplicate_key", "failed", F.col("_same") > 1),
            Rule("traceable_to_mirror", "warning", ~absent("_lost")),
        ],
    )
    return checked.drop("_same", "_rows", "_size", "_lost", "_src", "_dst")


def check_candidates(rows: DataFrame) -> DataFrame:
    """Candidate regions against the eight rules; repeated labels and names are warnings, and nothing is merged.

    ``rows``: run, raw_name, base_name, std_name, side, level, family, label_id, label_value.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    base = F.lower(F.when(text("base_name") != "", text("base_name")).otherwise(text("raw_name")))
    named = rows.withColumn("_base", F.when(base != "", base))
    labels = named.where("label_value is not null").groupBy("run", "label_value").agg(F.count(F.lit(1)).alias("_labels"))
    names = named.where("_base is not null").groupBy("run", "_base", "side").agg(F.count(F.lit(1)).alias("_names"))
    joined = named.join(labels, ["run", "label_value"], "left")
    joined = joined.join(names.withColumnsRenamed({"run": "_run", "_base": "_b", "side": "_side"}), F.expr("run = _run and _base = _b and side <=> _side"), "left").drop("_run", "_b", "_side")
    checked = check(
        joined,
        [
            Rule("empty_name", "failed", text("raw_name") == ""),
            Rule("laterality_validity", "failed", ~F.coalesce(F.col("side").isin(SIDES), F.lit(False))),
            Rule("granularity_coverage", "failed", (text("level") == "") | (text("family") == "")),
            Rule("std_name_coverage", "warning", text("std_name") == ""),
            Rule("laterality_coverage", "warning", F.col("side") == "unknown"),
            Rule("source_id_coverage", "warning", (text("label_id") == "") & F.col("label_value").isNull()),
            Rule("duplicate_label_value", "warning", F.col("_labels") > 1),
            Rule("duplicate_name_laterality", "warning", F.col("_names") > 1),
        ],
    )
    return checked.drop("_base", "_labels", "_names")
