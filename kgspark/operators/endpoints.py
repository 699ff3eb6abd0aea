"""Where circuits begin and end, references that are one paper, and rules for candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import doi_key, normal_name
from .graph import written
from .mentions import raw_hits
from .rules import Rule, check

# --- fixed values: words that tell regions little, roles of first and last steps, confidence by method ---
GENERIC = (
    "pathway circuit loop network tract projection projections connection connections system from and via the of in into onto between layer part "
    "region regions area areas nucleus nuclei cortex cortical subcortical zone division complex dorsal ventral medial lateral anterior posterior "
    "superior inferior rostral caudal left right deep superficial input output relay hub primary secondary association"
).split()
FIRST_ROLES = ("source", "start", "input", "origin", "afferent")
LAST_ROLES = ("target", "output", "end", "sink", "efferent", "terminal")
CONFIDENCE = {"candidate_region_canonical_id": 0.85, "circuit_step_regions": 0.80, "involved_region_candidate_ids": 0.75, "name_match": 0.65, "description_match": 0.55}


def name_tokens(text: Column) -> Column:
    """Words of three letters or more that aren't generic, as often as they stand."""
    flat = F.regexp_replace(F.lower(text), "[_-]", " ")
    return F.filter(F.split(flat, r"[\s,;/]+"), lambda t: (F.length(t) > 2) & ~t.isin(GENERIC))


def regions_by_name(texts: DataFrame, regions: DataFrame, top: int = 2) -> DataFrame:
    """(circuit, region, score, place) of texts (circuit, text): the ``top`` regions whose labels hold most of its tokens.

    Texts of fewer than two tokens match nothing.  Tokens may lie within a
    label's words; the different tokens are looked for in each label at once,
    and texts meet regions by the tokens found: texts of the same tokens once,
    however many circuits have them.
    """
    told = texts.select("circuit", name_tokens(F.col("text")).alias("t")).where(F.size("t") > 1)
    told = told.repartition("circuit").groupBy("circuit").agg(F.array_sort(F.flatten(F.collect_list("t"))).alias("t"))
    asked = told.select("t").distinct()
    tokens = asked.select("t", F.explode("t").alias("term"))
    lexicon = tokens.select("term").distinct().select("term", F.col("term").alias("region_id"), F.lit("alias_en").alias("kind"), F.lit(1.0).alias("confidence"), F.lit(False).alias("cased"))
    labels = regions.select("region", F.coalesce("label", F.lit("")).alias("sentence"))
    held = raw_hits(labels, lexicon, ["region"]).select("region", F.col("sentence").alias("label"), F.explode(F.array_distinct(F.transform("hits", lambda h: h["term"]))).alias("term"))
    scored = tokens.join(held, "term").groupBy("t", "region", "label").agg(F.count(F.lit(1)).alias("score"))
    place = F.row_number().over(W.partitionBy("t").orderBy(F.desc("score"), "label", "region"))
    best = scored.withColumn("place", place).where(F.col("place") <= top)
    return told.join(best, "t").select("circuit", "region", "score", "place")


def circuit_endpoints(circuits: DataFrame, members: DataFrame, steps: DataFrame, regions: DataFrame) -> DataFrame:
    """(circuit, first, last, method, confidence): where a circuit begins and ends, by the first source that tells.

    ``circuits``: circuit, name, description, involved (array of regions);
    ``members``: circuit, region, place; ``steps``: circuit, region, place,
    role; ``regions``: region, label.  Sources: two or more members, by place;
    steps, by marked roles where these give two regions, else by place; the
    list of involved regions; tokens of the name; of the description.  Each is
    only asked for circuits that those before it leave open.  Equal places go
    by region, null places last; null regions are no source.
    """
    asked = circuits.select("circuit", "name", "description", "involved")
    done: list[DataFrame] = []

    def settle(method: str, found: DataFrame) -> None:
        # written, or each source would find all those before it anew
        done.append(written(found.select("circuit", "first", "last", F.lit(method).alias("method"), F.lit(CONFIDENCE[method]).alias("confidence"))))

    def left() -> DataFrame:
        out = asked
        for part in done:
            out = out.join(part.select("circuit"), "circuit", "left_anti")
        return out

    # numbers sort before null in this order
    order = F.struct(F.col("place").isNull(), F.col("place"), F.col("region"))
    own = members.where("region is not null").groupBy("circuit").agg(F.count(F.lit(1)).alias("n"), F.min_by("region", order).alias("first"), F.max_by("region", order).alias("last"))
    settle("candidate_region_canonical_id", left().join(own.where("n > 1"), "circuit"))

    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    rows = steps.where("region is not null").withColumn("role", role).join(left().select("circuit"), "circuit", "left_semi")
    at = lambda which, roles: which(F.when(F.col("role").isin(*roles), F.col("region")), F.when(F.col("role").isin(*roles), order))
    told = rows.groupBy("circuit").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("region", order).alias("low"), F.max_by("region", order).alias("high"), at(F.min_by, FIRST_ROLES).alias("source"), at(F.max_by, LAST_ROLES).alias("target")
    )
    pair = told.where("n > 1").withColumn("a", F.coalesce("source", "low")).withColumn("b", F.coalesce("target", "high"))
    same = F.col("a") == F.col("b")
    pair = pair.select("circuit", F.when(same, F.col("low")).otherwise(F.col("a")).alias("first"), F.when(same, F.col("high")).otherwise(F.col("b")).alias("last")).where("first <> last")
    settle("circuit_step_regions", pair)

    listed = left().withColumn("i", F.array_compact("involved")).where(F.size("i") > 1)
    settle("involved_region_candidate_ids", listed.select("circuit", F.element_at("i", 1).alias("first"), F.element_at("i", -1).alias("last")))

    for method, column in (("name_match", "name"), ("description_match", "description")):
        best = regions_by_name(left().select("circuit", F.col(column).alias("text")), regions)
        two = best.groupBy("circuit").agg(F.count(F.lit(1)).alias("n"), F.min_by("region", "place").alias("first"), F.max_by("region", "place").alias("last")).where("n > 1")
        settle(method, two)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    told = circuits.select("circuit").join(out, "circuit", "left")
    return told.select("circuit", "first", "last", F.coalesce("method", F.lit("unresolved")).alias("method"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def reference_key(doi: Column, pmid: Column, digest: Column, title: Column, year: Column) -> Column:
    """What tells a reference: DOI, else PubMed id, else the citation's digest, else title and year."""
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    named = F.concat(F.lit("title_year:"), normal_name(F.coalesce(title, F.lit(""))), F.lit("|"), F.coalesce(year.cast("string"), F.lit("")))
    return F.coalesce(F.concat(F.lit("doi:"), filled(doi_key(doi))), F.concat(F.lit("pmid:"), filled(pmid)), F.concat(F.lit("hash:"), filled(digest)), named)


def merged_references(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References that are one paper, and what they are evidence of.

    ``refs``: id, doi, pmid, citation_hash, title, year, priority, text,
    evidence.  First: (key, id, priority, title, year, text, refs) with the
    reference of the best (smallest) priority as base, and the first text that
    isn't empty in that order.  Second: (key, evidence), each once; a paper
    that half of the evidence cites stays many rows.
    """
    keyed = refs.withColumn("key", reference_key(F.col("doi"), F.col("pmid"), F.col("citation_hash"), F.col("title"), F.col("year")))
    order = F.struct("priority", "id")
    said = F.col("text") != ""
    base = keyed.groupBy("key").agg(F.min_by(F.struct("id", "priority", "title", "year"), order).alias("b"), F.min_by(F.when(said, F.col("text")), F.when(said, order)).alias("text"), F.count(F.lit(1)).alias("refs"))
    links = keyed.where("evidence is not null").select("key", "evidence").distinct()
    return base.select("key", "b.id", "b.priority", "b.title", "b.year", F.coalesce("text", F.lit("")).alias("text"), "refs"), links


# --- fixed values: what pairs may be, and names that aren't those of whole regions ---
PAIR_TYPES = ("structural_connection", "functional_connectivity", "projection", "association", "unknown")
PAIR_DIRECTIONS = ("A_to_B", "B_to_A", "bidirectional", "unknown")
PAIR_LEVELS = ("macro", "clinical")
PART_OF_A_REGION = r"(?i)(^|\s)(layer|subregion|sub-region|division|left|right)\b|[./,]"


def check_pairs(pairs: DataFrame, regions: DataFrame, known: DataFrame) -> DataFrame:
    """Candidate pairs (id, src, dst, type, direction) against six rules: id, status (blocked, failed, passed), findings.

    ``regions``: region, name, level, status; ``known``: src, dst of
    connections in any layer; a pair that is there in either order is blocked.
    Null types and directions are not ready yet and fail nothing, nor do null levels and states.
    """
    there = known.where("src <> dst").select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct().withColumn("known", F.lit(True))
    rows = pairs.withColumn("lo", F.least("src", "dst")).withColumn("hi", F.greatest("src", "dst")).join(there, ["lo", "hi"], "left")
    for end in ("src", "dst"):
        rows = rows.join(regions.select(F.col("region").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("name", "level", "status")], F.lit(True).alias(f"{end}_there")), end, "left")
    odd = lambda end: ~F.col(f"{end}_level").isin(*PAIR_LEVELS) | (F.col(f"{end}_status") != "active") | F.col(f"{end}_name").rlike(PART_OF_A_REGION)
    nameless = lambda end: F.col(f"{end}_there").isNull() | (F.coalesce(f"{end}_name", F.lit("")) == "")
    told = lambda c: F.coalesce(c, F.lit(False))
    rules = [
        Rule("R1", "failed", nameless("src") | nameless("dst")),
        Rule("R2", "failed", F.col("src") == F.col("dst")),
        Rule("R3", "failed", ~F.col("type").isin(*PAIR_TYPES)),
        Rule("R4", "failed", ~F.col("direction").isin(*PAIR_DIRECTIONS)),
        Rule("R5", "blocked", F.col("known")),
        Rule("R6", "failed", told(odd("src")) | told(odd("dst"))),
    ]
    return check(rows, rules).select("id", "status", F.col("findings.code").alias("findings"))
