"""Graph operators over edge lists (src, dst, ...)."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from heapq import merge

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import least_rotation


def _shared(df: DataFrame) -> str:
    """The checkpoint folder, that of ``spark.checkpoint.dir``; only one local process may do without that setting."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage in the checkpoint folder."""
    _shared(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage by a table in the checkpoint folder.

    A checkpoint keeps Catalyst's estimate of its size, and what is joined with
    itself round after round squares it each time, to numbers of millions of
    digits; a table has the size of its files.
    """
    path = f"{_shared(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unordered(edges: DataFrame) -> DataFrame:
    """Edges with their ends in order as (lo, hi), without loops."""
    return edges.where("src <> dst").withColumn("lo", F.least("src", "dst")).withColumn("hi", F.greatest("src", "dst"))


def coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every unordered pair of nodes (column ``node``) with the number of its edges and whether it is covered.

    The pool of nodes is a vocabulary, not data; its pairs are the answer's size.
    """
    a, b = nodes.select(F.col("node").alias("lo")), nodes.select(F.col("node").alias("hi"))
    pairs = a.join(b, F.col("lo") < F.col("hi"))
    found = unordered(edges).groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("edges"))
    return pairs.join(found, ["lo", "hi"], "left").select("lo", "hi", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"), F.col("edges").isNotNull().alias("covered"))


def node_coverage(matrix: DataFrame) -> DataFrame:
    """Share of each node's pairs that are covered."""
    ends = matrix.select(F.explode(F.array("lo", "hi")).alias("node"), "covered")
    share = F.count_if("covered") / F.count(F.lit(1))
    return ends.groupBy("node").agg(F.count_if("covered").alias("covered"), F.count(F.lit(1)).alias("pairs"), F.round(share * 100, 2).alias("percent"))


def degrees(edges: DataFrame) -> DataFrame:
    """In, out and total degree of each node; an edge counts at both ends in one pass."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"), F.count(F.lit(1)).alias("degree"))


def symmetry_gaps(edges: DataFrame) -> DataFrame:
    """Ordered pairs that lack their mirror (missing_mirror), or whose mirror has other types (type_mismatch)."""
    types = edges.where("src <> dst").groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))
    mirror = types.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("types").alias("mirror_types"))
    gap = F.when(F.col("mirror_types").isNull(), "missing_mirror").when(F.col("types") != F.col("mirror_types"), "type_mismatch")
    return types.join(mirror, ["src", "dst"], "left").withColumn("gap", gap).where("gap is not null").select("src", "dst", "types", "gap")


def functional_gaps(terms: DataFrame, edges: DataFrame, least: int = 1) -> DataFrame:
    """Pairs of nodes that share ``least`` terms (node, term) or more and have no edge.

    Pairs meet by a node's rarer terms only: of two that share so many, one at
    least is not among the ``least`` - 1 most common of either.
    """
    own = terms.select("node", "term").distinct()
    common = own.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ranked = F.array_sort(F.collect_list(F.struct("df", "term")))
    nodes = own.join(common, "term").groupBy("node").agg(F.transform(ranked, lambda t: t["term"]).alias("terms")).where(F.size("terms") >= least)
    rare = nodes.select("node", "terms", F.explode(F.expr(f"slice(terms, 1, size(terms) - {least - 1})")).alias("term"))
    met = rare.select("term", F.col("node").alias("lo"), F.col("terms").alias("a")).join(rare.select("term", F.col("node").alias("hi"), F.col("terms").alias("b")), "term").where("lo < hi")
    # a pair counts where its rarest shared term is met
    both = met.withColumn("shared", F.array_intersect("a", "b")).where((F.size("shared") >= least) & (F.get("shared", F.lit(0)) == F.col("term")))
    shared = both.select("lo", "hi", F.size("shared").cast("long").alias("shared"))
    return shared.join(unordered(edges).select("lo", "hi").distinct(), ["lo", "hi"], "left_anti")


def missing_pairs(matrix: DataFrame, parents: DataFrame, edges: DataFrame) -> DataFrame:
    """Uncovered pairs in classes: C same parent, A common neighbours in number, B the rest.

    ``parents``: node, parent.  ``neighbours`` counts nodes linked to both.
    """
    missing = matrix.where(~F.col("covered")).select("lo", "hi")
    link = unordered(edges).select("lo", "hi").distinct()
    both = link.union(link.select(F.col("hi").alias("lo"), F.col("lo").alias("hi"))).toDF("node", "neighbour")
    common = missing.join(both.toDF("lo", "via"), "lo").join(both.toDF("hi", "via"), ["hi", "via"]).groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("neighbours"))
    of = lambda end: parents.select(F.col("node").alias(end), F.col("parent").alias(f"{end}_parent"))
    out = missing.join(common, ["lo", "hi"], "left").join(of("lo"), "lo").join(of("hi"), "hi").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)).cast("long"))
    label = F.when(F.col("lo_parent") == F.col("hi_parent"), "C").when(F.col("neighbours") >= 2, "A").otherwise("B")
    return out.select("lo", "hi", "neighbours", label.alias("class"))


def hubs(edges: DataFrame, top: int) -> DataFrame:
    """The nodes of highest degree; equal ones by name."""
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(top)


def two_hop(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Number of nodes two steps ahead, or two steps back, of each node in ``nodes``."""
    e = edges.select("src", "dst").distinct()
    ahead = nodes.select(F.col("node").alias("src")).join(e, "src").select(F.col("src").alias("node"), F.col("dst").alias("via")).join(e.toDF("via", "far"), "via")
    back = nodes.select(F.col("node").alias("dst")).join(e, "dst").select(F.col("dst").alias("node"), F.col("src").alias("via")).join(e.toDF("far", "via"), "via")
    both = ahead.select("node", "far").union(back.select("node", "far")).where("node <> far").distinct()
    return both.groupBy("node").agg(F.count(F.lit(1)).alias("two_hop"))


def three_cycles(edges: DataFrame) -> DataFrame:
    """Directed cycles of three, each once, from its smallest node on."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    ab, bc, ca = e.toDF("a", "b"), e.toDF("b", "c"), e.toDF("c", "a")
    out = ab.where("a < b").join(bc, "b").where("a < c").join(ca, ["c", "a"])
    return out.select(F.array_join(least_rotation(F.array("a", "b", "c")), "::").alias("key"), "a", "b", "c")


def feed_forward(edges: DataFrame) -> DataFrame:
    """a to b, b to c and a to c."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    return e.toDF("a", "b").join(e.toDF("b", "c"), "b").where("a <> c").join(e.toDF("a", "c"), ["a", "c"]).select("a", "b", "c")


def mutual(edges: DataFrame) -> DataFrame:
    """Unordered pairs with edges both ways."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    return e.toDF("lo", "hi").where("lo < hi").join(e.toDF("hi", "lo"), ["lo", "hi"])


def reciprocal_chains(edges: DataFrame) -> DataFrame:
    """a and c both in mutual exchange with b, but not with each other."""
    m = mutual(edges)
    both = m.union(m.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
    chains = both.toDF("a", "b").join(both.toDF("b", "c"), "b").where("a < c")
    return chains.join(m.toDF("a", "c"), ["a", "c"], "left_anti").select("a", "b", "c")


def pairs_at_hub(edges: DataFrame, hub: str, end: str, most: int = 20) -> DataFrame:
    """Pairs of ends that share a hub (convergent: hub is dst), the first ``most`` of each hub.

    These lie among the first ``most`` + 1 ends, so a hub makes no more pairs
    than those of a bounded number of ends.
    """
    e = edges.where("src <> dst").select(hub, end).distinct()
    e = e.withColumn("_k", F.row_number().over(W.partitionBy(hub).orderBy(end))).where(F.col("_k") <= most + 1).drop("_k")
    pairs = e.toDF("hub", "a").join(e.toDF("hub", "b"), "hub").where("a < b")
    rank = F.row_number().over(W.partitionBy("hub").orderBy("a", "b"))
    return pairs.withColumn("k", rank).where(F.col("k") <= most).drop("k")


def simple_paths(edges: DataFrame, nodes: int, most: int | None = None) -> DataFrame:
    """Simple paths of a number of nodes; of each start the first ``most`` by their nodes, at each length."""
    return paths_by_length(edges, nodes, most)[nodes]


def paths_by_length(edges: DataFrame, nodes: int, most: int | None = None) -> dict[int, DataFrame]:
    """Simple paths by number of nodes, up to ``nodes``; each length is grown from the one before and written once."""
    e = checkpointed(edges.where("src <> dst").select("src", "dst").distinct())
    paths = {2: e.select(F.array("src", "dst").alias("path"))}
    if most is not None and nodes == 2:
        paths[2] = _first_of_start(paths[2], most)
    for n in range(3, nodes + 1):
        grown = paths[n - 1].withColumn("src", F.element_at("path", -1)).join(e, "src").where(~F.array_contains("path", F.col("dst")))
        grown = grown.select(F.concat("path", F.array("dst")).alias("path"))
        paths[n] = checkpointed(_first_of_start(grown, most) if most is not None else grown)
    return paths


def _first_of_start(paths: DataFrame, most: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(F.element_at("path", 1)).orderBy("path"))
    return paths.withColumn("k", rank).where(F.col("k") <= most).drop("k")


def closed_loops(edges: DataFrame, nodes: int) -> DataFrame:
    """Directed cycles of a number of nodes, each once, from its smallest node on."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    paths = e.where("src < dst").select(F.array("src", "dst").alias("path"))
    for _ in range(nodes - 2):
        grown = paths.withColumn("src", F.element_at("path", -1)).join(e, "src")
        grown = grown.where(~F.array_contains("path", F.col("dst")) & (F.col("dst") > F.element_at("path", 1)))
        paths = grown.select(F.concat("path", F.array("dst")).alias("path"))
    back = e.select(F.col("src").alias("_end"), F.col("dst").alias("_start"))
    return paths.withColumn("_end", F.element_at("path", -1)).withColumn("_start", F.element_at("path", 1)).join(back, ["_end", "_start"]).select("path")


def reachable(edges: DataFrame, max_depth: int = 32) -> DataFrame:
    """(src, dst, depth): all that can be reached, with the least number of steps.

    Step by step from the frontier, without what has been seen, so cycles end;
    what has been seen is the union of the frontiers, each written once.
    Deeper chains than ``max_depth`` raise.
    """
    e = checkpointed(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    frontier = e.withColumn("depth", F.lit(1))
    seen = [frontier]
    for depth in range(2, max_depth + 2):
        step = frontier.select("src", F.col("dst").alias("via")).join(e.toDF("via", "dst"), "via").select("src", "dst").distinct()
        frontier = checkpointed(step.join(reduce(DataFrame.union, seen), ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return reduce(DataFrame.union, seen)
        seen.append(frontier)
    raise RuntimeError("the hierarchy is deeper than max_depth")


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves, with the length of the shortest way."""
    return reachable(edges).where("src = dst").select(F.col("src").alias("node"), "depth")


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component): weakly connected components named by their smallest node."""
    # written, or every round would make the edges anew
    e = written(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    label = checkpointed(e.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")))
    for _ in range(max_rounds):
        heard = e.join(label.toDF("src", "c"), "src").groupBy("dst").agg(F.min("c").alias("c"))
        grown = label.join(heard.withColumnRenamed("dst", "node"), "node", "left").select("node", F.least("component", "c").alias("component"), (F.col("c") < F.col("component")).alias("moved"))
        # a label may itself have a smaller one: take the pointer's pointer
        hop = grown.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = grown.join(hop, "component", "left").select("node", F.least(F.col("component"), F.col("next")).alias("component"), F.coalesce("moved", F.lit(False)).alias("moved"))
        jumped = checkpointed(jumped)
        if jumped.where("moved").isEmpty():
            return jumped.select("node", "component")
        label = jumped.select("node", "component")
    raise RuntimeError("components did not settle")


def strong_components(edges: DataFrame, max_rounds: int = 256) -> DataFrame:
    """(node, component): strongly connected components named by their smallest node.

    Each node learns the smallest node that reaches it and the smallest that it
    reaches, by its edges and by asking those two themselves, so ways of any
    length take few steps.  Where both are the same node, that is the component.
    Edges between nodes that differ in either can't lie in a component and go;
    the rest is told apart in another round.  All tables have at most as many
    rows as there are edges and nodes, whatever can be reached from where.
    Rows with a null end are ignored; a node with loops only is its own component.
    """
    # written, since nodes and edges are made of it: what makes the edges runs once
    ends = written(edges.select("src", "dst").where("src is not null and dst is not null"))
    nodes = ends.select("src").union(ends.select("dst")).distinct().toDF("node")
    left = written(ends.where("src <> dst").distinct())
    settled: list[DataFrame] = []
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        label = _extremes(left, max_rounds)
        settled.append(label.where("low = high").select("node", F.col("low").alias("component")))
        of = lambda end: label.where("low <> high").select(F.col("node").alias(end), F.struct("low", "high").alias(f"{end}_class"))
        left = written(left.join(of("src"), "src").join(of("dst"), "dst").where("src_class = dst_class").select("src", "dst"))
    else:
        raise RuntimeError("components did not settle")
    if not settled:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(reduce(DataFrame.union, settled), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _extremes(edges: DataFrame, max_rounds: int) -> DataFrame:
    """(node, low, high): the smallest node that reaches each node, and the smallest that it reaches."""
    asked = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(True).alias("up"))
    asked = asked.union(edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(False).alias("up")))
    label = written(asked.select("node").distinct().select("node", F.col("node").alias("low"), F.col("node").alias("high")))
    for _ in range(max_rounds):
        # what a node knows is asked, too: who reaches that, or is reached from it
        known = label.where("low <> node").select("node", F.col("low").alias("other"), F.lit(True).alias("up"))
        known = known.union(label.where("high <> node").select("node", F.col("high").alias("other"), F.lit(False).alias("up")))
        told = asked.union(known).join(label.select(F.col("node").alias("other"), "low", "high"), "other")
        heard = told.select("node", F.when(F.col("up"), F.col("low")).alias("l"), F.when(~F.col("up"), F.col("high")).alias("h"), F.lit(False).alias("own"))
        both = heard.union(label.select("node", "low", "high", F.lit(True))).groupBy("node")
        grown = both.agg(F.min("l").alias("low"), F.min("h").alias("high"), F.max(F.when(F.col("own"), F.col("l"))).alias("l"), F.max(F.when(F.col("own"), F.col("h"))).alias("h"))
        grown = grown.select("node", "low", "high", ((F.col("low") < F.col("l")) | (F.col("high") < F.col("h"))).alias("moved"))
        grown = written(grown)
        if grown.where("moved").isEmpty():
            return grown.drop("moved")
        label = grown.drop("moved")
    raise RuntimeError("labels did not settle")


def loops_in_components(edges: DataFrame, components: DataFrame, low: int = 4, high: int = 8) -> DataFrame:
    """(component, path): directed cycles of ``low`` to ``high`` nodes, each once, from its smallest node on.

    Cycles stay in strong components, so only edges within one are walked.  A
    cycle is a way of half its edges ahead of its smallest node and one of the
    other half back to it: both are grown, no longer than half of ``high``, and
    meet where they end at the same node and share no other.
    """
    e = edges.where("src <> dst").select("src", "dst").distinct()
    at = lambda end: components.select(F.col("node").alias(end), F.col("component").alias(f"{end}_c"))
    e = checkpointed(e.join(at("src"), "src").join(at("dst"), "dst").where("src_c = dst_c").select(F.col("src_c").alias("component"), "src", "dst"))
    ahead = _half_ways(e, "src", "dst", (high + 1) // 2)
    back = _half_ways(e, "dst", "src", high // 2)
    met = []
    for n in range(low, high + 1):
        a = ahead[(n + 1) // 2].select("component", "start", "end", F.col("way").alias("a"))
        b = back[n // 2].select("component", "start", "end", F.col("way").alias("b"))
        # both ways have the start first and the meeting place last
        whole = a.join(b, ["component", "start", "end"]).where(F.size(F.array_intersect("a", "b")) == 2)
        met.append(whole.select("component", F.concat("a", F.slice(F.reverse("b"), 2, n // 2 - 1)).alias("path")))
    return reduce(DataFrame.union, met)


def _half_ways(e: DataFrame, frm: str, to: str, most: int) -> dict[int, DataFrame]:
    """Simple ways by number of edges, from a start over nodes that come behind it; written length by length."""
    step = e.select("component", F.col(frm).alias("end"), F.col(to).alias("next"))
    ways = {1: step.where(F.col("next") > F.col("end")).select("component", F.col("end").alias("start"), F.col("next").alias("end"), F.array("end", "next").alias("way"))}
    for n in range(2, most + 1):
        grown = ways[n - 1].join(step, ["component", "end"]).where((F.col("next") > F.col("start")) & ~F.array_contains("way", F.col("next")))
        ways[n] = checkpointed(grown.select("component", "start", F.col("next").alias("end"), F.concat("way", F.array("next")).alias("way")))
    return ways


def spanning(loops: DataFrame, groups: DataFrame, least: int = 2, through: DataFrame | None = None) -> DataFrame:
    """Loops (path) whose nodes are in ``least`` or more groups (node, group), with those; ``through``: and hold one of these nodes.

    Nodes in no group count for none.
    """
    if through is not None:
        # asked for twice: loops are walked once
        loops = written(loops)
    own = loops.select("path", F.explode("path").alias("node"))
    found = own.join(groups.select("node", "group"), "node").groupBy("path").agg(F.array_sort(F.collect_set("group")).alias("groups")).where(F.size("groups") >= least)
    if through is not None:
        found = found.join(own.join(through.select("node").distinct(), "node", "left_semi").select("path").distinct(), "path", "left_semi")
    return found


def neighbourhood_packs(edges: DataFrame, size: int, block: int = 5000) -> DataFrame:
    """Edges (id, src, dst) in packs of ``size``: (id, block, pack, place).

    In the order of ids an edge that is in no pack yet goes to the open one and
    draws edges that share a node with it behind it, until the pack is full.
    This goes on within blocks of about ``block`` edges, in whole components
    where they are small; a larger component is dealt by the smaller node of its
    edges, and a node of more edges than that by the edges.  All ends of a
    block share the open pack, so only a block's last one isn't full.
    """
    edges = written(edges.select("id", "src", "dst"))
    component = components(edges)
    e = edges.select("id", "src", "dst", F.least("src", "dst").alias("node")).join(component, "node")
    counted = checkpointed(e.groupBy("component", "node").agg(F.count(F.lit(1)).alias("at_node")))
    whole = counted.groupBy("component").agg(F.sum("at_node").alias("n"))
    small = whole.where(F.col("n") < block).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    part = lambda c, n: F.pmod(F.xxhash64(c), F.ceil(n / F.lit(block)))
    place = F.when(F.col("n") < block, F.array(F.lit(0), part("component", F.lit(small)), F.lit(0))).otherwise(
        F.array(F.xxhash64("component"), part("node", F.col("n")), F.when(F.col("at_node") > block, F.xxhash64("node") + part("id", F.col("at_node"))).otherwise(F.lit(0)))
    )
    dealt = e.join(counted.join(whole, "component"), ["component", "node"]).select("id", "src", "dst", F.concat_ws(":", F.transform(place, lambda x: x.cast("string"))).alias("block"))
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", ignore_index=True)
        touching: dict = {}
        for k, ends in enumerate(zip(rows["src"], rows["dst"])):
            for node in set(ends):
                touching.setdefault(node, []).append(k)
        packs, places, packed, number = [0] * len(rows), [0] * len(rows), [False] * len(rows), 0
        held = 0
        for k, ends in enumerate(zip(rows["src"], rows["dst"])):
            if packed[k]:
                continue
            if held == size:
                number, held = number + 1, 0
            for near in [k, *merge(*(touching[n] for n in set(ends)))]:
                if held == size:
                    break
                if not packed[near]:
                    packed[near], packs[near], places[near] = True, number, held
                    held += 1
            for n in set(ends):  # those in packs needn't be looked at again
                touching[n] = [x for x in touching[n] if not packed[x]]
        return pd.DataFrame({"id": rows["id"], "block": rows["block"], "pack": packs, "place": places})

    return dealt.groupBy("block").applyInPandas(pack, f"id {kinds['id']}, block string, pack long, place long")


def shortest_paths(edges: DataFrame, start: Column | str, max_depth: int) -> DataFrame:
    """Breadth-first from one node: each node once, with its depth and the first path by name."""
    e = edges.select("src", "dst").distinct()
    start = F.lit(start)
    seen = e.limit(1).select(start.alias("node"), F.lit(0).alias("depth"), F.array(start).alias("path"))
    seen = frontier = checkpointed(seen)
    for depth in range(1, max_depth + 1):
        step = frontier.select(F.col("node").alias("src"), "path").join(e, "src").select(F.col("dst").alias("node"), F.lit(depth).alias("depth"), F.concat("path", F.array("dst")).alias("path"))
        first = step.groupBy("node").agg(F.first("depth").alias("depth"), F.min("path").alias("path"))
        frontier = checkpointed(first.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = checkpointed(seen.union(frontier))
    return seen


def repointed(edges: DataFrame, replaced: DataFrame) -> DataFrame:
    """Edges with deprecated nodes (``replaced``: node, by) resolved to the end of their chain; no loops, each edge once."""
    chain = reachable(replaced.select(F.col("node").alias("src"), F.col("by").alias("dst")))
    ends = chain.join(replaced.select(F.col("node").alias("dst")), "dst", "left_anti").select(F.col("src").alias("node"), F.col("dst").alias("final"))
    out = edges.select("src", "dst")
    for end in ("src", "dst"):
        out = out.join(ends.toDF(end, f"{end}_final"), end, "left").withColumn(end, F.coalesce(f"{end}_final", end)).drop(f"{end}_final")
    return out.select("src", "dst").where("src <> dst").distinct()


def shared_neighbours(edges: DataFrame) -> DataFrame:
    """Jaccard of the neighbourhoods of the ends of each unordered edge, from counts of neighbours and of those in common."""
    e = unordered(edges).select("lo", "hi").distinct()
    near = e.union(e.select("hi", "lo")).toDF("node", "via")
    size = near.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    common = e.join(near.toDF("lo", "via"), "lo").join(near.toDF("hi", "via"), ["hi", "via"]).groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("both"))
    joined = e.join(common, ["lo", "hi"], "left").join(size.toDF("lo", "a"), "lo").join(size.toDF("hi", "b"), "hi")
    both = F.coalesce("both", F.lit(0))
    return joined.select("lo", "hi", F.round(both / (F.col("a") + F.col("b") - both), 4).alias("overlap"))
