"""Readers, writers and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from kgspark.sources import readers, sinks
from kgspark.streaming import events


def test_label_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<atlas><data><label index="1" x="1.5" y="2" z="3">Precentral_L</label><label><index>2</index><name>Insula_R</name></label><label index="3">Vermis</label></data></atlas>')
    got = {r["index"]: (r["name"], r["x"], r["hemisphere"]) for r in readers.read(spark, "label_xml", str(tmp_path / "a.xml")).collect()}
    assert got == {1: ("Precentral_L", 1.5, "left"), 2: ("Insula_R", None, "right"), 3: ("Vermis", None, "midline")}
    (tmp_path / "a.txt").write_text("# names\n1  alpha\n\n 2\tbeta 0\n3\n")
    assert [tuple(r) for r in readers.label_text(spark, str(tmp_path / "a.txt")).collect()] == [("1", "alpha"), ("2", "beta"), ("3", None)]
    (tmp_path / "a.tsv").write_text("name\tid\nx\t1\ny\t2\n")
    assert {tuple(r) for r in readers.delimited(spark, str(tmp_path / "a.tsv"), "name string, id int").collect()} == {("x", 1), ("y", 2)}
    with pytest.raises(ValueError):
        readers.read(spark, "unknown", "x")


def test_region_tree(spark, tmp_path):
    tree = {"id": "1", "name": "root", "children": [{"id": "2", "name": "a", "acronym": "A", "children": [{"id": "4", "name": "deep"}]}, {"id": "3", "name": "b", "children": []}]}
    (tmp_path / "t.json").write_text(json.dumps(tree) + "\n")
    got = {(r.id, r.parent, r.depth) for r in readers.region_tree(spark, str(tmp_path / "t.json")).where("id is not null").collect()}
    assert got == {("1", None, 0), ("2", "1", 1), ("3", "1", 1), ("4", "2", 2)}
    with pytest.raises(Exception, match="deeper"):
        readers.region_tree(spark, str(tmp_path / "t.json"), max_depth=1).collect()


def test_articles(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<article><body><sec id="s1"><title>Intro <i>x</i></title><p>One <b>bold</b>\n word.</p><p/></sec><sec><title>Methods</title><p>Two.</p><p>Three.</p></sec></body></article>')
    got = [(r.section, r.paragraph_id, r.text) for r in readers.jats(spark, str(tmp_path / "p.xml")).orderBy("section_id", "paragraph_id").collect()]
    assert got == [("Intro x", 0, "One bold word."), ("Methods", 0, "Two."), ("Methods", 1, "Three.")]


def test_matrix_and_inventory(spark, tmp_path):
    square = spark.createDataFrame([("a", None, 2.0), ("b", 0.5, 3.0)], "row string, a double, b double")
    assert {tuple(r) for r in readers.matrix_edges(square, "row", 1.0).collect()} == {("a", "b", 2.0), ("b", "b", 3.0)}
    for name in ("x.csv", "y.nii", "z.weird"):
        (tmp_path / name).write_text("12")
    assert {r.kind for r in readers.inventory(spark, str(tmp_path)).collect()} == {"tabular_data", "nifti_metadata", "unsupported"}


def test_exports_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("n1", "Region", ["a", "b"], 'quote "x", comma'), ("n2", "Region", [], None)], "id string, label string, tags array<string>, note string")
    sinks.json_lines(rows, f"{tmp_path}/j")
    assert spark.read.schema(rows.schema).json(f"{tmp_path}/j").exceptAll(rows).isEmpty()
    edges = spark.createDataFrame([("n1", "n2", "LINKS")], "src string, dst string, type string")
    sinks.graph_files(rows, edges, f"{tmp_path}/g")
    nodes = spark.read.csv(f"{tmp_path}/g/nodes", header=True, escape='"')
    assert nodes.columns == [":ID", ":LABEL", "tags", "note"] and {r["tags"] for r in nodes.collect()} == {'["a","b"]', "[]"}
    assert spark.read.csv(f"{tmp_path}/g/edges", header=True).columns == [":START_ID", ":END_ID", ":TYPE"]
    out = sinks.manifest(f"{tmp_path}/m", nodes=rows, edges=edges, none=edges.limit(0))
    assert out["total"] == 3 and out["warnings"] == ["none is empty"] and json.loads(spark.read.text(f"{tmp_path}/m").first().value) == out


def _batches(spark, folder, parts):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{folder}/b{k}")


def test_streams(spark, tmp_path):
    day = "2024-01-01 "
    parts = [
        [(1, day + "10:00:00", 7, "click", 1.0, None), (2, day + "10:04:00", 7, "click", 2.0, None), (1, day + "10:00:00", 7, "click", 1.0, None)],
        [(3, day + "10:30:00", 7, "view", 5.0, None), (4, day + "12:00:00", 8, "view", 1.0, None)],
    ]
    _batches(spark, f"{tmp_path}/in", parts)
    stream = events.read_events(spark, f"{tmp_path}/in/*", files=1)
    (tmp_path / "out").mkdir()

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/c-{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    distinct = events.once(stream, "1 hour", "event_id")
    assert sorted(r.event_id for r in run(distinct, "distinct_events")) == [1, 2, 3, 4]
    closed = {(str(r.start)[11:16], r.event_type): (r.n, r.total) for r in run(events.windowed(stream, "10 minutes", "5 minutes"), "windows")}
    assert closed[("10:00", "click")] == (3, 4.0) and closed[("10:30", "view")] == (1, 5.0)
    assert {(r.user_id, r.n) for r in run(events.sessions(stream, "10 minutes", "5 minutes"), "runs")} >= {(7, 3), (7, 1)}
    merge = events.merge_into(f"{tmp_path}/out", ["user_id"], "ts")
    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{tmp_path}/c-merge").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.user_id, r.event_id) for r in spark.read.parquet(f"{tmp_path}/out/version=1").collect()} == {(7, 3), (8, 4)}
