"""Views that give the star-schema tables the roles of the domain's relations.

Each has a twin in SQL (``CONN``, ``EDGES``), a common table expression that
the comparison queries begin with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import mapped

TYPES = {"A": "anatomical", "N": "functional", "R": "projection"}
DIRECTIONS = {"O": "directed", "F": "undirected"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region_id, name, parent): the regions of one atlas with their parents."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return joined.select(F.col("n_nationkey").alias("region_id"), F.col("n_name").alias("name"), F.col("r_name").alias("parent"))


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each reported connection between two regions."""
    line, orders, customer, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    src = regions(spark, sf_dir).select(F.col("region_id").alias("s_id"), F.col("name").alias("src"), F.col("parent").alias("species"))
    dst = regions(spark, sf_dir).select(F.col("region_id").alias("d_id"), F.col("name").alias("dst"))
    joined = (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(src, F.col("c_nationkey") == F.col("s_id"))
        .join(dst, F.col("s_nationkey") == F.col("d_id"))
    )
    return joined.select(
        "src",
        "dst",
        "species",
        mapped(F.col("l_returnflag"), TYPES).alias("type"),
        mapped(F.col("l_linestatus"), DIRECTIONS).alias("direction"),
        (F.round(F.col("l_discount") * 10, 4) + F.lit(0.0)).alias("confidence"),
        F.year("l_shipdate").alias("run_id"),
        F.col("o_orderpriority").alias("evidence"),
        _side(F.col("l_linenumber")).alias("src_side"),
        _side(F.col("l_suppkey")).alias("dst_side"),
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
    )


def _side(number: Column) -> Column:
    return F.when(number % 2 == 0, "left").otherwise("right")


def sparse_edges(spark: SparkSession, sf_dir: str, out_degree: int = 4) -> DataFrame:
    """(src, dst, n, confidence): the strongest edges out of each region."""
    pairs = connections(spark, sf_dir).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))
    best = W.partitionBy("src").orderBy(F.desc("n"), "dst")
    return pairs.withColumn("k", F.row_number().over(best)).where(F.col("k") <= out_degree).drop("k")


CONN = """
conn AS (
  SELECT sn.n_name AS src, dn.n_name AS dst, r.r_name AS species,
    CASE l_returnflag WHEN 'A' THEN 'anatomical' WHEN 'N' THEN 'functional' WHEN 'R' THEN 'projection' END AS type,
    CASE l_linestatus WHEN 'O' THEN 'directed' WHEN 'F' THEN 'undirected' END AS direction,
    round(l_discount * 10, 4) + 0.0 AS confidence, CAST(year(l_shipdate) AS INTEGER) AS run_id, o_orderpriority AS evidence,
    CASE WHEN l_linenumber % 2 = 0 THEN 'left' ELSE 'right' END AS src_side,
    CASE WHEN l_suppkey % 2 = 0 THEN 'left' ELSE 'right' END AS dst_side,
    l_orderkey, l_linenumber, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON c_nationkey = sn.n_nationkey
  JOIN nation dn ON s_nationkey = dn.n_nationkey JOIN region r ON sn.n_regionkey = r.r_regionkey)"""

EDGES = (
    CONN
    + """,
edges AS (
  SELECT src, dst, n, confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS k FROM (
      SELECT src, dst, count(*) AS n, round(avg(confidence), 6) AS confidence FROM conn WHERE src <> dst GROUP BY src, dst)) WHERE k <= 4)"""
)
