"""Readers of the domain's file formats, each a DataFrame from a path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hemisphere(name: F.Column) -> F.Column:
    """left, right or midline, from the end of a label."""
    side = F.lower(F.regexp_extract(name, r"[_\-. ]([LlRr])(?:eft|ight)?$", 1))
    return F.when(side == "l", "left").when(side == "r", "right").otherwise("midline")


def label_xml(spark: SparkSession, path: str, row_tag: str = "label") -> DataFrame:
    """(index, name, x, y, z, hemisphere) of an atlas's label elements, by attributes or child elements."""
    schema = "_index string, index string, name string, _VALUE string, _x double, _y double, _z double, x double, y double, z double"
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    name = F.trim(F.coalesce("name", "_VALUE"))
    return raw.select(F.coalesce("_index", "index").cast("int").alias("index"), name.alias("name"), *[F.coalesce(f"_{c}", c).alias(c) for c in "xyz"], hemisphere(name).alias("hemisphere"))


def label_text(spark: SparkSession, path: str, columns: tuple[str, ...] = ("index", "name")) -> DataFrame:
    """White-space separated lines; blank lines and those that begin with a hash are left out, missing fields are null."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")
    parts = F.split("line", r"\s+")
    return lines.select(*[F.get(parts, k).alias(c) for k, c in enumerate(columns)])


def delimited(spark: SparkSession, path: str, schema: str, separator: str | None = None) -> DataFrame:
    """CSV, or TSV by the path's end, with a header line; columns are taken by the header's names."""
    separator = separator or ("\t" if path.lower().endswith((".tsv", ".tab")) else ",")
    return spark.read.csv(path, schema=schema, sep=separator, header=True, enforceSchema=False, multiLine=False)


def region_tree(spark: SparkSession, path: str, max_depth: int = 16) -> DataFrame:
    """(id, name, acronym, parent, depth) of JSON lines that hold nested regions; ``max_depth`` levels, deeper ones fail."""
    node = "id string, name string, acronym string, children array<string>"
    level = spark.read.text(path).select(F.col("value").alias("json"), F.lit(None).cast("string").alias("parent"))
    out = None
    for depth in range(max_depth + 1):
        parsed = level.select(F.from_json("json", node).alias("n"), "parent")
        rows = parsed.select("n.id", "n.name", "n.acronym", "parent", F.lit(depth).alias("depth"))
        if depth == max_depth:
            rows = rows.where(F.raise_error(F.concat(F.lit("the tree is deeper than max_depth: "), "id")).isNull())
        out = rows if out is None else out.union(rows)
        level = parsed.select(F.explode("n.children").alias("json"), F.col("n.id").alias("parent"))
    return out


def matrix_edges(matrix: DataFrame, row: str, least: float = 0.0) -> DataFrame:
    """(src, dst, weight) of the cells of a square matrix that reach ``least``; its columns are the targets."""
    targets = [c for c in matrix.columns if c != row]
    cells = matrix.select(row, *[F.col(f"`{c}`").cast("double").alias(c) for c in targets]).unpivot(row, targets, "dst", "weight")
    return cells.where(F.col("weight") >= least).select(F.col(row).alias("src"), "dst", "weight")


def jats(spark: SparkSession, path: str) -> DataFrame:
    """(path, section, paragraph_id, text) of the paragraphs of JATS articles, one article for each file.

    Sections are cut at their start, paragraphs within them; inline marks go.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    body = F.regexp_replace("value", r"(?s)<!--.*?-->|<\?.*?\?>", "")
    sections = whole.select("path", F.posexplode(F.split(body, r"<(?:\w+:)?sec\b[^>]*>")).alias("k", "part"))
    title = F.trim(F.regexp_extract("part", r"(?s)^\s*<(?:\w+:)?title[^>]*>(.*?)</(?:\w+:)?title>", 1))
    found = F.regexp_extract_all("part", F.lit(r"(?s)<(?:\w+:)?p(?:\s[^>]*)?>(.*?)</(?:\w+:)?p>"), 1)
    rows = sections.select("path", "k", title.alias("section"), F.posexplode(found).alias("paragraph_id", "text"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("text", r"<[^>]*>", " "), r"\s+", " "))
    return rows.select("path", F.col("k").alias("section_id"), F.regexp_replace("section", r"<[^>]*>", "").alias("section"), "paragraph_id", plain.alias("text")).where("text <> ''")


#: Readers by kind of resource.
READERS: dict[str, Callable[..., DataFrame]] = {
    "label_xml": label_xml,
    "label_text": label_text,
    "delimited": delimited,
    "region_tree": region_tree,
    "jats": jats,
}

KINDS = {"xml": "text", "csv": "tabular_data", "tsv": "tabular_data", "json": "json_document", "txt": "text", "png": "image_metadata", "jpg": "image_metadata", "nii": "nifti_metadata", "gz": "nifti_metadata"}


def read(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"no reader for {kind}")
    return READERS[kind](spark, path, **options)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, kind) of the files below a folder; only their names and sizes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return files.select("path", "bytes", F.coalesce(F.element_at(table, ending), F.lit("unsupported")).alias("kind"))
