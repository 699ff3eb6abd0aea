"""Quality classifier: a generalised additive model with pairwise interactions.

Features are statistics of a whole text.  Cyclic boosting visits the features
in turn; each visit fits a shallow tree on one feature's bins and adds it,
shrunk, to that feature's lookup table.  The pairs whose grids explain most of
the remaining error are then boosted the same way with trees on two features.
A score is the logistic of a sum of table entries, added for whole blocks of
rows at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, map_blocks, table

#: Labelled rows that a fit takes at most: those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS = 48, 12
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.1
PAIRS = 8
#: Least rows in a leaf, and the ridge on leaf values.
LEAF_ROWS, RIDGE = 20, 2.0

FEATURES = (
    "log_bytes", "log_words", "mean_word", "distinct_words", "top_word", "same_as_previous", "same_pair", "upper", "digit",
    "sign", "comma_stop", "odd_sign", "blank", "line_breaks", "mean_line", "distinct_lines", "high_bytes", "sign_ends", "packed",
    "longest_word", "capital_words", "sign_words",
)

_KIND = np.zeros(256, np.uint8)  # 0 odd sign, 1 lower, 2 upper, 3 digit, 4 blank, 5 line break, 6 comma or stop, 7 high byte
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[9, 11, 12, 13, 32]] = 4
_KIND[10] = 5
_KIND[[ord(c) for c in ",.;:'\"?-()"]] = 6
_KIND[128:] = 7


def features(text: str | None) -> list[float]:
    """Values of FEATURES; a null text is an empty one, all zeros."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    odd, lower, upper, digit, blank, breaks, stops, high = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=8).tolist()
    words = raw.split()
    m = len(words) or 1
    number: dict[bytes, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words] or [0], np.int64)
    counts = np.bincount(codes)
    pairs = codes[1:] * len(counts) + codes[:-1]
    sizes = np.array([len(w) for w in words] or [0])
    last = np.frombuffer(bytes([w[-1] for w in words] or [0]), np.uint8)
    lead = np.frombuffer(bytes([w[0] for w in words] or [0]), np.uint8)
    lines = [x for x in raw.split(b"\n") if x]
    return [
        float(np.log1p(n)),
        float(np.log1p(len(words))),
        float(sizes.mean()),
        len(number) / m,
        counts.max() / m,
        float((codes[1:] == codes[:-1]).mean()) if m > 1 else 0.0,
        1 - len(np.unique(pairs)) / len(pairs) if len(pairs) else 0.0,
        upper / (upper + lower + 1),
        digit / n,
        (odd + stops) / n,
        stops / m,
        odd / n,
        blank / n,
        breaks / m,
        float(np.log1p(n / (len(lines) or 1))),
        len(set(lines)) / (len(lines) or 1),
        high / n,
        float((_KIND[last] == 0).mean()),
        len(zlib.compress(raw, 1)) / n,
        float(np.log1p(sizes.max())),
        float((_KIND[lead] == 2).mean()),
        float((_KIND[lead] == 0).mean()),
    ]


class Model(NamedTuple):
    """Bin edges and lookup tables; ``pair_edges`` are the coarser ones of the pairs."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, (edges, values) in enumerate(zip(self.edges, self.tables)):
            out += values[np.searchsorted(edges, x[:, k], side="right")]
        for (i, j), values in zip(self.pairs, self.pair_tables):
            out += values[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of a run of bins (0: none)."""
    if len(g) < 2:
        return 0.0, 0
    a, b, c = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = _gain(a, b) + _gain(g.sum() - a, h.sum() - b) - _gain(g.sum(), h.sum())
    gain[(c < LEAF_ROWS) | (n.sum() - c < LEAF_ROWS)] = 0
    at = int(gain.argmax())
    return (float(gain[at]), at + 1) if gain[at] > 1e-9 else (0.0, 0)


def _shallow(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Values of a tree of at most ``leaves`` leaves on ordered bins."""
    runs = [(0, len(g))]
    while len(runs) < leaves:
        cuts = [_best_cut(g[a:b], h[a:b], n[a:b]) for a, b in runs]
        k = max(range(len(runs)), key=lambda i: cuts[i][0])
        if not cuts[k][1]:
            break
        a, b = runs[k]
        runs[k : k + 1] = [(a, a + cuts[k][1]), (a + cuts[k][1], b)]
    out = np.empty(len(g))
    for a, b in runs:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _shallow_pair(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts one feature once, then the other on either side."""
    best, out = 0.0, np.full(g.shape, -g.sum() / (h.sum() + RIDGE))
    for turned in (False, True):
        u, v, w = (g.T, h.T, n.T) if turned else (g, h, n)
        for cut in range(1, len(u)):
            value, total = np.zeros(u.shape), 0.0
            for part in (slice(0, cut), slice(cut, None)):
                a, b, c = u[part].sum(axis=0), v[part].sum(axis=0), w[part].sum(axis=0)
                gain, at = _best_cut(a, b, c)
                total += gain + float(_gain(a.sum(), b.sum()))
                for side in (slice(0, at), slice(at, None)) if at else (slice(None),):
                    value[part, side] = -a[side].sum() / (b[side].sum() + RIDGE)
            total -= float(_gain(g.sum(), h.sum()))
            if total > best:
                best, out = total, value.T if turned else value
    return best, out


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS) -> Model:
    """Boost the tables on features ``x`` and labels ``y``; without both labels a constant."""
    width = len(FEATURES)
    if not len(y) or y.min() == y.max():
        base = 0.0 if not len(y) else (4.0 if y.min() else -4.0)
        return Model(base, [np.zeros(0)] * width, [np.zeros(1)] * width, [np.zeros(0)] * width, [], [])
    base = float(np.log(y.mean() / (1 - y.mean())))
    edges = [_edges(x[:, k], BINS) for k in range(width)]
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    rows = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, tables)]
    margin = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(width):
            g, h = slopes()
            size = len(tables[k])
            step = RATE * _shallow(np.bincount(bins[k], g, size), np.bincount(bins[k], h, size), rows[k])
            tables[k] += step
            margin += step[bins[k]]
    coarse = [_edges(x[:, k], PAIR_BINS) for k in range(width)]
    own = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse)]

    def grids(i: int, j: int) -> list[np.ndarray]:
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        g, h = slopes()
        cell = own[i] * shape[1] + own[j]
        return [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h, np.ones(len(y)))]

    ranked = sorted(((_shallow_pair(*grids(i, j))[0], i, j) for i in range(width) for j in range(i)), reverse=True)[:pairs]
    chosen = [(i, j) for gain, i, j in ranked if gain > 0]
    pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in chosen]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(chosen):
            step = RATE * _shallow_pair(*grids(i, j))[1]
            pair_tables[k] += step
            margin += step[own[i], own[j]]
    return Model(base, edges, tables, coarse, chosen, pair_tables)


def in_training(id_column: F.Column) -> F.Column:
    """Rows that labels may be learnt from: crc32 of the id as text, modulo 3, isn't 1."""
    return F.crc32(id_column.cast("string").cast("binary")) % 3 != 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample`` labelled rows, never on held-out ones.

    Labels other than 0 and 1, and null ids, are left out; of several labels
    of an id the smallest counts.  Ids without a text are left out.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & in_training(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)

    def step(block: pa.RecordBatch) -> dict[str, list]:
        return {"id": block.column(0), "x": [features(t) for t in block.column(1).to_pylist()], "y": block.column(2)}

    # at most ``sample`` ids: small enough to send to every task
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").select("id", "text", F.col("y").cast("int").alias("y"))
    got = map_blocks(rows, step, f"id {rows.schema['id'].dataType.simpleString()}, x array<double>, y int").orderBy("id").toArrow()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array(got.column("y").to_pylist(), np.float64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", kept: tuple[str, ...] = ()) -> DataFrame:
    """(id, score double[, kept columns]) of every row; null and empty texts are scored too."""

    def step(block: pa.RecordBatch) -> dict[str, list]:
        x = np.array([features(t) for t in block.column(1).to_pylist()]).reshape(-1, len(FEATURES))
        return {"id": block.column(0), "score": pa.array(model.score(x))} | {c: block.column(2 + k) for k, c in enumerate(kept)}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"), *kept)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, score double" + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return map_blocks(rows, step, schema).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, whose text scores ``least`` or more."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, at):
                x = np.array([features(t) for t in block.column(at).to_pylist()]).reshape(-1, len(FEATURES))
                yield block.filter(pa.array(model.score(x) >= least))

    return docs.mapInArrow(run, docs.schema)


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(~in_training(F.col("doc_id")), F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
