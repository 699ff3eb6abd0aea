"""Reviews, adjudication, work status, listings and batch views of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def adjudicate(a: Column, b: Column, ca: Column, cb: Column) -> Column:
    """Outcome of two reviewers: support (1) or reject (0), with confidences."""
    return (
        F.when(a.isNull() | b.isNull(), "insufficient")
        .when((ca < 0.4) | (cb < 0.4), "low_evidence")
        .when((a == 1) & (b == 1) & (F.abs(ca - cb) < 0.3), "consensus")
        .when(a != b, "conflict")
        .otherwise("insufficient")
    )


def work_status(items: DataFrame, key: str, state: str) -> DataFrame:
    """Status of a task from the states of its items (done, failed, running, waiting), worst and most open first."""
    n = lambda s: F.count_if(F.col(state) == s)
    g = items.groupBy(key).agg(n("done").alias("done"), n("failed").alias("failed"), n("running").alias("running"), n("waiting").alias("waiting"), F.count(F.lit(1)).alias("total"))
    status = (
        F.when(F.col("running") > 0, "processing")
        .when(F.col("waiting") > 0, "awaiting_review")
        .when(F.col("failed") == F.col("total"), "failed")
        .when(F.col("failed") > 0, "partially_failed")
        .otherwise("completed")
    )
    return g.withColumn("status", status)


def filtered(rows: DataFrame, equal: dict[str, object], keyword: str | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """Equality for each parameter that isn't None, and a keyword in any of some columns, whatever its case."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if keyword:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.col(c).ilike(f"%{keyword}%"), F.lit(False))
        rows = rows.where(hit)
    return rows


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of an ordered listing; the order has to be total."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def subgraph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (node)."""
    return edges.join(nodes.toDF("src"), "src", "left_semi").join(nodes.toDF("dst"), "dst", "left_semi")


def step_pairs(steps: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Consecutive steps and the gap in their order."""
    w = W.partitionBy(key).orderBy(order)
    out = steps.select(key, F.col(order), F.col(value).alias("step"), F.lead(value).over(w).alias("next"), (F.lead(order).over(w) - F.col(order)).alias("gap"))
    return out.where("next is not null")


def sessions(events: DataFrame, key: str, time: str, gap_minutes: int) -> DataFrame:
    """Sessions of each key, closed by a pause longer than the gap."""
    w = W.partitionBy(key).orderBy(time, "event_id")
    at = F.col(time).cast("timestamp")
    pause = F.unix_micros(at) - F.unix_micros(F.lag(at).over(w)) > gap_minutes * 60_000_000
    marked = events.withColumn("_s", F.sum(F.coalesce(pause.cast("int"), F.lit(0))).over(w))
    return marked.groupBy(key, F.col("_s").alias("session")).agg(F.count(F.lit(1)).alias("events"), F.min(time).alias("start"), F.max(time).alias("end"))


def windowed(events: DataFrame, minutes: int) -> DataFrame:
    """Counts and sums by tumbling window and type."""
    out = events.groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def rolling(events: DataFrame, key: str, rows: int) -> DataFrame:
    """Each event's value with the mean of it and the ``rows`` before it, of its key."""
    w = W.partitionBy(key).orderBy("ts", "event_id").rowsBetween(-rows, 0)
    return events.select("event_id", F.round(F.avg("value").over(w), 4).alias("mean"))


def claim_coverage(evidence: DataFrame) -> DataFrame:
    """Of each claim (claim, component, direction): supported and contradicted components, ratio and conflict."""
    g = evidence.groupBy("claim").agg(
        F.collect_set("component").alias("required"),
        F.collect_set(F.when(F.col("direction") == "supports", F.col("component"))).alias("supported"),
        F.collect_set(F.when(F.col("direction") == "contradicts", F.col("component"))).alias("contradicted"),
    )
    s, c, r = F.size("supported"), F.size("contradicted"), F.size("required")
    overall = F.when((s == 0) & (c == 0), "not_found").when((s > 0) & (c > 0), "mixed").when((s == r), "supports").when(c > 0, "contradicts").otherwise("partial")
    return g.select("claim", r.alias("required"), s.alias("supported"), c.alias("contradicted"), F.round(s / r, 4).alias("ratio"), ((s > 0) & (c > 0)).alias("conflict"), overall.alias("overall"))


def usage_average(rows: DataFrame, key: str, tokens: str, pairs: str) -> DataFrame:
    """Mean of tokens for each pair, a pair at least."""
    return rows.groupBy(key).agg(F.round(F.avg(F.col(tokens) / F.greatest(F.col(pairs), F.lit(1))), 4).alias("average"), F.count(F.lit(1)).alias("n"))


def dashboard(**counts: DataFrame) -> DataFrame:
    """(metric, key, value) of several groupings: frames of (key, value)."""
    out = None
    for metric, df in sorted(counts.items()):
        part = df.toDF("key", "value").select(F.lit(metric).alias("metric"), F.col("key").cast("string").alias("key"), F.col("value").cast("long").alias("value"))
        out = part if out is None else out.union(part)
    return out


def json_field(rows: DataFrame, column: str, path: str) -> DataFrame:
    """Counts by a field of a JSON payload; rows without it count as null."""
    return rows.groupBy(F.get_json_object(column, path).cast("long").alias("field")).agg(F.count(F.lit(1)).alias("n"))
