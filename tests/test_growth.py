"""Work that must not grow with copies, with filters behind it or with rounds, counted in rows."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kgspark.functions.slices import map_slices
from kgspark.operators import endpoints, governance, graph, papers, passages, resolve, rules


def join_rows(df):
    """Rows that the joins of an executed query put out."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            if "Join" in name:
                total += node.metrics().apply("numOutputRows").value()
            todo += [node.children().apply(k) for k in range(node.children().size())]
    return total


def counted(spark, df):
    """``df`` and how many of its rows have been read so far."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), seen


def test_slices_bound_what_is_held(spark):
    df = spark.range(0, 200, numPartitions=1).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    out = map_slices(df, ["text"], lambda part: [pa.array([part.num_rows])], StructType([StructField("n", LongType())]), limit=10_000)
    sizes = [r.n for r in out.collect()]
    assert sum(sizes) == 200 and max(sizes) <= 10


def test_texts_are_read_once_for_candidates(spark):
    docs, seen = counted(spark, spark.createDataFrame([(k, f"one two three four five six {k}") for k in range(50)], "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "two three four five six 7")], "item_id long, text string")
    assert passages.passage_candidates(asked, docs).where("doc_id = 7").count() == 1
    assert seen.value == 50


def test_blocks_leave_python_whole(spark):
    docs = spark.createDataFrame([(1, "aa\n\n b \nccc"), (1, "dddd"), (2, None), (3, " \n")], "doc_id long, text string")
    out = papers.semantic_blocks(docs, target=3)
    got = sorted(map(tuple, out.collect()))
    # rows with an equal id count together
    assert got == [(1, 0, 0, 3, 9), (1, 1, 2, 1, 3)]
    assert "Generate" not in out._jdf.queryExecution().toString()


def test_citations_that_ask_for_the_same_are_matched_as_one(spark):
    cited = spark.range(300).select("id", F.lit("Hu & Li").alias("author"), F.lit("2008").alias("year"))
    library = spark.range(200).select((F.col("id") + 10).alias("paper"), F.lit("Hu").alias("authors"), F.lit(2008).alias("year"))
    out = papers.match_citations(cited, library)
    assert join_rows(out) <= 300 + 200
    assert {(r.matches, r.grade, r.paper) for r in out.collect()} == {(200, "B_multiple", None)}
    # rows of one id ask together, a null id for nothing
    cited = spark.createDataFrame([(1, "Hu", "2008"), (1, "Li", "2009"), (2, "Li", "2009a"), (None, "Li", "2009")], "id int, author string, year string")
    library = spark.createDataFrame([(10, "Hu", 2008), (11, "Li", 2009)], "paper int, authors string, year int")
    got = {r.id: (r.matches, r.paper) for r in papers.match_citations(cited, library).collect()}
    assert got == {1: (2, None), 2: (1, 11), None: (0, None)}


def test_circuits_of_one_text_meet_the_regions_once(spark):
    texts = spark.range(300).select(F.col("id").alias("circuit"), F.lit("alpha beta").alias("text"))
    regions = spark.range(100).select(F.col("id").alias("region"), F.concat(F.lit("alpha beta "), "id").alias("label"))
    out = endpoints.regions_by_name(texts, regions)
    assert join_rows(out) <= 2 * 300 + 2 * 100
    assert {(r.region, r.score, r.place) for r in out.collect()} == {(0, 2, 1), (1, 2, 2)}
    # rows of one circuit count together
    twice = spark.createDataFrame([(1, "alpha beta"), (1, "beta gamma")], "circuit long, text string")
    regions = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "gamma")], "region long, label string")
    assert sorted(tuple(r) for r in endpoints.regions_by_name(twice, regions).collect()) == [(1, 1, 1, 2), (1, 2, 2, 1)]


def test_rounds_do_not_read_the_edges_again(spark):
    edges, seen = counted(spark, spark.createDataFrame([(k, k + 1) for k in range(40)], "src long, dst long"))
    assert graph.components(edges).where("component = 0").count() == 41
    assert seen.value <= 2 * 40


def test_a_queue_is_cut_before_anything_is_sorted(spark):
    items = spark.range(0, 5000, numPartitions=2).select(F.when(F.col("id") % 5 > 0, "a").alias("target_type"), F.when(F.col("id") != 77, F.col("id")).alias("id"), F.lit("s").alias("state"), F.when(F.col("id") % 3 > 0, F.timestamp_seconds(F.col("id") % 7)).alias("updated_at"))
    cut = governance._newest(items, 10)
    assert cut.count() <= 2 * 2 * 10
    none = spark.createDataFrame([], "target_type string, id long, severity string, created_at timestamp, result_id long")
    got = governance.review_queue(items, none, none.select("target_type", "id"), 10).select("target_type", "id", "place").collect()
    rows = sorted(items.collect(), key=lambda r: (r.updated_at is None, -(r.updated_at.timestamp() if r.updated_at else 0), r.id is not None, r.id or 0))
    want = {(t, r.id, k + 1) for t in ("a", None) for k, r in enumerate([r for r in rows if r.target_type == t][:10])}
    assert {tuple(r) for r in got} == want


def test_components_and_packs_make_their_edges_once(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(6)] + [(3, 0)], "src long, dst long")
    edges, seen = counted(spark, links)
    assert graph.strong_components(edges).where("component = 0").count() == 4
    assert seen.value == 7
    edges, seen = counted(spark, links.withColumn("id", F.col("src") * 100 + F.col("dst")))
    assert graph.neighbourhood_packs(edges, 3).count() == 7
    assert seen.value == 7


def test_loops_are_walked_once_where_hubs_are_asked_for(spark):
    loops, seen = counted(spark, spark.createDataFrame([([1, 2, 3],), ([2, 4, 5],)], "path array<long>"))
    groups = spark.createDataFrame([(1, "a"), (2, "b"), (4, "a")], "node long, group string")
    got = graph.spanning(loops, groups, 2, spark.createDataFrame([(5,)], "node long")).collect()
    assert [(r.path, r.groups) for r in got] == [([2, 4, 5], ["a", "b"])]
    assert seen.value == 2


def test_rules_make_connections_and_lineage_once(spark):
    row = ("x", "r", "s", "functional", "directed", "human", "macro", 1, "p", 1)
    canonical, read = counted(spark, spark.createDataFrame([row], "id string, src string, dst string, type string, direction string, species string, granularity string, evidence_count long, provenance string, confidence_count long"))
    lineage, traced = counted(spark, spark.createDataFrame([("x", 1, [1])], "id string, cluster_size long, report_ids array<long>"))
    regions, reports = spark.createDataFrame([("r",), ("s",)], "region string"), spark.createDataFrame([(1,)], "report_id long")
    assert [r.status for r in rules.check_connections(canonical, regions, lineage, reports).collect()] == ["passed"]
    assert (read.value, traced.value) == (1, 1)


def test_names_to_resolve_are_read_once_and_only_ask_names_that_may_do(spark):
    asked, seen = counted(spark, spark.range(300).select(F.concat(F.lit("Alpha-beta gamma"), F.repeat(F.lit("."), F.col("id").cast("int"))).alias("query"), F.lit("alpha beta gamma").alias("norm")))
    names = spark.range(100).select(F.col("id").alias("region"), F.concat(F.lit("al"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("norm")).union(spark.createDataFrame([(100, "alpha beta")], "region long, norm string"))
    # of 101 names that begin alike one is long enough; queries of one norm meet it as one
    offered = resolve.prefix_matches(asked, names)
    assert join_rows(offered) <= 1 + 300
    assert {(r.region, r.score) for r in offered.collect()} == {(100, 0.63)} and offered.count() == 300
    index = names.select(F.lit("cn").alias("method"), F.lit(0).alias("priority"), F.col("norm").alias("key"), "region", F.lit(1.0).alias("confidence"))
    before = seen.value
    told = resolve.resolve_levels(asked, index, [], names).collect()
    assert len(told) == 300 and {r.method for r in told} == {"fuzzy"}
    assert seen.value - before == 300
