"""What hangs together over several tables: functions reached through circuits, views over all scales, chains of versions."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import reachable, written

#: Levels that descendants are shown by.
LEVELS = ("meso", "subregion", "fine")


def region_functions(regions: DataFrame, members: DataFrame, functions: DataFrame, terms: DataFrame, children: DataFrame) -> DataFrame:
    """Function terms of regions by their circuits: (region, via_children, circuit, term, relation, confidence, term_code).

    A region without any gets those of its direct active children's circuits.
    ``members``: region, circuit; ``functions``: circuit, term, relation,
    confidence; ``terms``: term, term_code; ``children``: parent, child, active.
    Circuits that lead to no term are dropped before regions are looked at, so
    whether the first way is empty is known without walking it; the second is
    only walked for those where it is.  Each circuit counts once for a region.
    """
    known = functions.join(terms.select("term", "term_code"), "term")
    live = members.join(known.select("circuit").distinct(), "circuit", "left_semi").select("region", "circuit").distinct()
    asked = regions.select("region").distinct()
    own = asked.join(live, "region").withColumn("via_children", F.lit(False))
    rest = asked.join(live, "region", "left_anti")
    kids = children.where("active").select(F.col("parent").alias("region"), F.col("child"))
    below = rest.join(kids, "region").join(live.toDF("child", "circuit"), "child").select("region", "circuit").distinct()
    return own.unionByName(below.withColumn("via_children", F.lit(True))).join(known, "circuit").select("region", "via_children", "circuit", "term", "relation", "confidence", "term_code")


def multiscale(regions: DataFrame, parents: DataFrame, cells: DataFrame, molecules: DataFrame) -> DataFrame:
    """All that a region is seen with, a row each: (region, section, item, depth, confidence, place).

    Sections: parents (nearest first), children, the descendants of each level,
    cells and molecules (surest first, unknown confidence last).  ``regions``:
    region, level, code; ``parents``: child, parent; ``cells`` and
    ``molecules``: region, item, code, confidence.  The hierarchy is closed
    once, by frontiers that are only added to; regions of other levels are in no bucket.
    """
    up = written(reachable(parents.select(F.col("child").alias("src"), F.col("parent").alias("dst"))))
    code = regions.select(F.col("region").alias("item"), "level", "code")
    nothing = F.lit(None).cast("double")
    above = up.select(F.col("src").alias("region"), F.col("dst").alias("item"), "depth")
    below = up.select(F.col("dst").alias("region"), F.col("src").alias("item"), "depth").join(code, "item")
    above = above.join(code, "item").withColumn("section", F.lit("parents"))
    direct = below.where("depth = 1").withColumn("section", F.lit("children"))
    bucket = below.where(F.col("level").isin(*LEVELS)).withColumn("section", F.concat(F.when(F.col("level") == "subregion", "subregion").otherwise(F.concat("level", F.lit("_region"))), F.lit("s")))
    tree = above.unionByName(direct).unionByName(bucket).select("region", "section", "item", "depth", nothing.alias("confidence"), "code")
    for name, part in (("cell_types", cells), ("molecules", molecules)):
        own = part.join(regions.select("region"), "region", "left_semi")
        tree = tree.unionByName(own.select("region", F.lit(name).alias("section"), F.col("item"), F.lit(0).alias("depth"), F.col("confidence").cast("double").alias("confidence"), "code"))
    order = W.partitionBy("region", "section").orderBy("depth", F.col("confidence").desc_nulls_last(), "code", "item")
    return tree.withColumn("place", F.row_number().over(order)).drop("code")


def version_chains(reviews: DataFrame) -> DataFrame:
    """(id, root, revision, successors, is_current, in_cycle) of reviews (id, supersedes).

    The root is the first version, found by pointers that double, so a chain of
    any length takes as many rounds as its length has binary digits.  A review
    that supersedes one that isn't there, or none, is a root; forks share it.
    What never gets to a root is in a cycle or hangs on one: no root, no number.
    ``id`` is unique and not null.
    """
    rows = reviews.select("id", "supersedes")
    there = rows.select(F.col("id").alias("supersedes"), F.lit(True).alias("there"))
    first = rows.join(there, "supersedes", "left").select("id", F.when(F.col("there"), F.col("supersedes")).alias("up"))
    first = written(first.select("id", F.coalesce("up", "id").alias("at"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("up").isNull().alias("ended")))
    # who points at a root has ended, too
    roots = first.where("ended").select(F.col("id").alias("at"), F.lit(True).alias("root"))
    chain = written(first.join(roots, "at", "left").select("id", "at", "steps", (F.col("ended") | F.coalesce("root", F.lit(False))).alias("ended")))
    for _ in range(ceil(log2(max(chain.count(), 2))) + 1):
        open_ = chain.where("not ended")
        if open_.isEmpty():
            break
        far = chain.select(F.col("id").alias("at"), F.col("at").alias("further"), F.col("steps").alias("more"), F.col("ended").alias("done"))
        jumped = open_.join(far, "at").select("id", F.col("further").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.col("done").alias("ended"))
        chain = written(chain.where("ended").unionByName(jumped))
    after = rows.where("supersedes is not null").groupBy(F.col("supersedes").alias("id")).agg(F.count(F.lit(1)).alias("successors"))
    told = chain.join(after, "id", "left").withColumn("successors", F.coalesce("successors", F.lit(0).cast("long")))
    return told.select(
        "id",
        F.when(F.col("ended"), F.col("at")).alias("root"),
        F.when(F.col("ended"), F.col("steps") + 1).alias("revision"),
        "successors",
        (F.col("successors") == 0).alias("is_current"),
        (~F.col("ended")).alias("in_cycle"),
    )
