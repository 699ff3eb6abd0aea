"""Functional modules of regions: labels, regions between modules, and how well the modules of a set of regions agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: modules in order, with the parts of names that speak for them ---
MODULES = {
    "sensory": ["visual", "auditory", "somatosensory", "gustatory", "olfactory", "sensory", "V1", "V2", "V4", "A1", "S1", "barrel"],
    "motor": ["motor", "premotor", "supplementary motor", "cerebell", "basal ganglia", "striatum", "pallidum", "substantia nigra", "red nucleus"],
    "attention_salience": ["cingulate", "insula", "frontal eye", "parietal", "intraparietal", "salience"],
    "executive_control": ["prefrontal", "dorsolateral", "frontal pole", "orbitofrontal", "working memory"],
    "learning_memory": ["hippocamp", "entorhinal", "perirhinal", "parahippocamp", "subiculum", "dentate", "CA1", "CA2", "CA3", "memory"],
    "emotion_reward": ["amygdal", "nucleus accumbens", "ventral tegmental", "ventral striatum", "orbitofrontal", "reward", "emotion", "fear", "anxiety", "stress"],
    "language_social": ["broca", "wernicke", "temporal pole", "superior temporal", "middle temporal", "inferior frontal", "language", "semantic"],
    "interoception_autonomic": ["hypothalam", "brainstem", "autonomic", "visceral", "interoception", "solitary", "parabrachial", "periaqueductal"],
    "sleep_arousal": ["reticular", "raphe", "locus coeruleus", "tuberomammillary", "pedunculopontine", "laterodorsal tegmental", "basal forebrain", "sleep", "arousal", "wake"],
    "multimodal_default": ["default mode", "posterior cingulate", "precuneus", "angular gyrus", "medial prefrontal", "multisensory", "polymodal"],
}
UNCERTAIN = "module_uncertain"
MOST = 3
#: Coherence: one module for all and no other, a common one; weight and floor of the mean overlap; overlap of a known with an unknown node.
SAME, COMMON, WEIGHT, FLOOR, HALF_KNOWN = 1.0, 0.8, 0.6, 0.1, 0.3


def labels(names: Column, domains: Column, payload: Column, modules: dict[str, list[str]] = MODULES) -> Column:
    """Up to three modules of a region, or ``module_uncertain``.

    First those that ``domains`` name, in their order (a module's name within
    the domain's or the other way round), then those of which a keyword stands
    in one of ``names``, then those named in ``payload``; each once.  Nulls name nothing.
    """
    every = F.array(*[F.lit(m) for m in modules])
    flat = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    told = F.flatten(F.transform(F.coalesce(domains, F.array().cast("array<string>")), lambda d: F.filter(every, lambda m: F.coalesce(F.contains(flat(d), m) | F.contains(m, flat(d)), F.lit(False)))))
    lowered = F.lower(F.array_join(names, "\x00"))
    named = F.array_compact(F.array(*[F.when(lowered.rlike("|".join(k.lower() for k in keys)), m) for m, keys in modules.items()]))
    hinted = F.filter(every, lambda m: F.coalesce(F.contains(flat(payload), m), F.lit(False)))
    found = F.slice(F.array_distinct(F.concat(told, named, hinted)), 1, MOST)
    return F.when(F.size(found) == 0, F.array(F.lit(UNCERTAIN))).otherwise(found)


def known(regions: DataFrame) -> DataFrame:
    """(node, module) of regions (node, modules), without what is uncertain."""
    return regions.select("node", F.explode("modules").alias("module")).where(F.col("module") != UNCERTAIN).distinct()


def module_hubs(regions: DataFrame, graph: DataFrame, least: int = 2) -> DataFrame:
    """(module, node) of nodes of the graph (node) that belong to ``least`` or more modules."""
    own = known(regions.join(graph.select("node").distinct(), "node", "left_semi"))
    hubs = own.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return own.join(hubs.select("node"), "node").select("module", "node")


def cross_module(candidates: DataFrame, regions: DataFrame) -> DataFrame:
    """(candidate, modules_involved, cross_module) of candidates (candidate, node).

    Nodes that no region row tells of are uncertain; candidates without any
    known module have an empty list.
    """
    own = candidates.select("candidate", "node").distinct().join(known(regions), "node", "left")
    found = own.groupBy("candidate").agg(F.array_sort(F.collect_set("module")).alias("modules_involved"))
    return found.withColumn("cross_module", F.size("modules_involved") > 1)


def coherence(candidates: DataFrame, regions: DataFrame) -> DataFrame:
    """(candidate, nodes, coherence) of candidates (candidate, node): how well the modules of their nodes agree.

    1 if all share one module and have no other, 0.8 if some module is common
    to all, 0 if none is known, else by the mean overlap of pairs.  Pairs are not formed: nodes with
    the same modules count together, and there are few different sets of at
    most three modules, however many nodes a candidate has.
    """
    sets = known(regions).groupBy("node").agg(F.array_sort(F.collect_set("module")).alias("set"))
    nothing = F.array().cast("array<string>")
    own = candidates.select("candidate", "node").join(sets, "node", "left").withColumn("set", F.coalesce("set", nothing))
    kinds = own.groupBy("candidate", "set").agg(F.count(F.lit(1)).alias("n"))
    all_of = kinds.groupBy("candidate").agg(
        F.sum("n").alias("nodes"),
        F.array_sort(F.collect_list(F.struct("set", "n"))).alias("kinds"),
    )
    common = F.aggregate(F.slice("kinds", 2, F.greatest(F.size("kinds") - 1, F.lit(0))), F.get("kinds", F.lit(0))["set"], lambda c, k: F.array_intersect(c, k["set"]))
    # a known set's common module can't be in an empty one, so uncertain nodes leave nothing in common
    single = F.forall("kinds", lambda k: F.size(k["set"]) == 1)
    unknown = F.forall("kinds", lambda k: F.size(k["set"]) == 0)
    pairs = F.col("nodes") * (F.col("nodes") - 1) / 2
    within = F.aggregate("kinds", F.lit(0.0), lambda s, k: s + k["n"] * (k["n"] - 1) / 2)

    def overlap(a: Column, b: Column) -> Column:
        either, both = F.size(F.array_union(a["set"], b["set"])), F.size(F.array_intersect(a["set"], b["set"]))
        alone = (F.size(a["set"]) == 0) | (F.size(b["set"]) == 0)
        return a["n"] * b["n"] * F.when(alone, F.lit(HALF_KNOWN)).otherwise(both / either)

    rest = lambda k, i: F.slice("kinds", i + 2, F.greatest(F.size("kinds") - i - 1, F.lit(0)))
    between = F.aggregate(F.flatten(F.transform("kinds", lambda k, i: F.transform(rest(k, i), lambda o: overlap(k, o)))), F.lit(0.0), lambda s, x: s + x)
    mean = F.when(F.col("nodes") > 1, F.round((within + between) / pairs * WEIGHT + FLOOR, 4)).otherwise(FLOOR)
    score = F.when(unknown, 0.0).when((F.size(common) == 1) & single, SAME).when(F.size(common) > 0, COMMON).otherwise(mean)
    return all_of.select("candidate", "nodes", score.alias("coherence"))
