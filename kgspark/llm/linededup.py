"""Fuzzy line deduplication by MinHash.

Lines are compared as sets of character shingles.  Equal lines are one; each
distinct line gets a signature of minimum hashes, whose bands bring together
lines that are likely alike.  Buckets stream by in order.  In one of bounded
size all lines are held against each other by exact Jaccard similarity.  In a
larger one each line is held against the bucket's first; where that leaves
lines of more than one component, they are compared across components, in
chunks of bounded size.  So no similar pair of a bucket is lost and none is
written out but for a forest of links.  Distributed union-find then gives the
components, and the first line of each stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, blocks, checkpointed, connected_components, distinct, fresh, map_blocks, table

SHINGLE, SIMILARITY = 9, 0.8
#: Hashes of a band and bands: a pair at 0.8 shares a band with probability 0.997.
BAND_HASHES, BANDS = 3, 8
#: Lines of a bucket, and their bytes, that are compared with each other in one step.
CHUNK, CHUNK_BYTES = 256, 1 << 20
#: Up to so many lines, a bucket's pairs are looked up one by one.
FEW = 24
#: Characters hashed at a time: the arrays stay in the processor's cache.
HASH_CHARS = 1 << 16
#: Equal minimum hashes that a pair has to have to be compared; of a pair at 0.8 they are so many with probability 0.9999.
LIKELY = 11
_SEEDS = np.random.default_rng(7).integers(1, 1 << 32, (2, BAND_HASHES * BANDS), dtype=np.uint64)
_ROW, _LOW = 40, (1 << 40) - 1


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line) of every line that isn't blank; null texts have none."""
    parts = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))
    return parts.where(F.col("line").rlike(r"[^ \t\r\f\x0B]"))


def line_key(line: str | Column) -> Column:
    """64-bit name of a line's text."""
    return F.xxhash64(line)


def _shingle_hashes(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the shingle that begins at each place."""
    h = np.zeros(len(points), np.uint64)
    padded = np.append(points, np.zeros(SHINGLE, np.uint32)).astype(np.uint64)
    padded += np.uint64(1)
    for k in range(SHINGLE):
        h *= np.uint64(0x100000001B3)
        h += padded[k : k + len(points)]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h


def _whole_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of lines of SHINGLE characters or more, one line after the other, and their numbers."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    hashes = _shingle_hashes(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32))
    inside = np.ones(len(hashes), bool)
    ends = np.cumsum(sizes)
    for k in range(1, SHINGLE):
        inside[ends - k] = False
    return hashes[inside], sizes - SHINGLE + 1


def band_keys(texts: list[str]) -> np.ndarray:
    """BANDS keys for each line of SHINGLE characters or more; the last bits of a key number its band."""
    signature = signatures(texts).astype(np.uint64)
    keys = np.empty((len(texts), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(texts), b + 1, np.uint64)
        for k in range(b * BAND_HASHES, (b + 1) * BAND_HASHES):
            key = (key ^ signature[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
        keys[:, b] = key >> np.uint64(3) << np.uint64(3) | np.uint64(b)
    return keys.view(np.int64)


def signatures(texts: list[str]) -> np.ndarray:
    """Minimum hashes of each line of SHINGLE characters or more."""
    out = np.empty((len(texts), _SEEDS.shape[1]), np.uint32)
    first = 0
    while first < len(texts):
        last, held = first, 0
        while last < len(texts) and (held == 0 or held + len(texts[last]) <= HASH_CHARS):
            held += len(texts[last])
            last += 1
        whole, count = _whole_shingles(texts[first:last])
        hashes, starts = (whole >> np.uint64(32)).astype(np.uint32), np.cumsum(count) - count
        mixed = np.empty_like(hashes)
        for k in range(_SEEDS.shape[1]):
            np.multiply(hashes, np.uint32(_SEEDS[0, k] | 1), out=mixed)
            np.add(mixed, np.uint32(_SEEDS[1, k]), out=mixed)
            out[first:last, k] = np.minimum.reduceat(mixed, starts)
        first = last
    return out


class Sets:
    """Shingle sets of some lines: sorted entries of a line's number and 40 bits of a hash."""

    def __init__(self, texts: list[str]):
        hashes, count = _whole_shingles(texts)
        entries = np.repeat(np.arange(len(texts), dtype=np.int64), count) << _ROW | (hashes >> np.uint64(64 - _ROW)).astype(np.int64)
        self.entries = distinct(entries)
        self.size = np.bincount(self.entries >> _ROW, minlength=len(texts))
        self.begin = np.cumsum(self.size) - self.size

    def alike(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the lines of each pair have a Jaccard similarity of SIMILARITY or more."""
        out = np.zeros(len(x), bool)
        near = np.flatnonzero(np.minimum(self.size[x], self.size[y]) >= SIMILARITY * np.maximum(self.size[x], self.size[y]))
        x, y = x[near], y[near]
        cuts = np.flatnonzero(np.diff(np.cumsum(self.size[x]) >> 20, prepend=-1)).tolist() + [len(x)]
        for a, b in zip(cuts, cuts[1:]):
            n = self.size[x[a:b]]
            own = np.repeat(np.arange(b - a), n)
            at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + self.begin[x[a:b]][own]
            asked = self.entries[at] & _LOW | y[a:b][own] << _ROW
            spot = np.minimum(np.searchsorted(self.entries, asked), len(self.entries) - 1)
            both = np.bincount(own[self.entries[spot] == asked], minlength=b - a)
            out[near[a:b]] = both / (n + self.size[y[a:b]] - both) >= SIMILARITY
        return out

    def matrix(self, rows: np.ndarray) -> np.ndarray:
        """Whether each two of ``rows`` (which follow one another) are alike, by products of membership matrices."""
        first, last = self.begin[rows[0]], self.begin[rows[-1]] + self.size[rows[-1]]
        part = self.entries[first:last]
        _, code = np.unique(part & _LOW, return_inverse=True)
        row = (part >> _ROW) - rows[0]
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        both = np.zeros((len(rows), len(rows)), np.float32)
        for low in range(0, int(code[-1]) + 1, 4096):
            a, b = np.searchsorted(code, [low, low + 4096])
            member = np.zeros((len(rows), 4096), np.float32)
            member[row[a:b], code[a:b] - low] = 1
            both += member @ member.T
        n = self.size[rows].astype(np.float64)
        return both / (n[:, None] + n[None, :] - both) >= SIMILARITY


def _forest(near: np.ndarray) -> np.ndarray:
    """Smallest member of each row's component in a symmetric matrix of links."""
    label = np.arange(len(near))
    while True:
        low = np.where(near, label[None, :], len(near)).min(axis=1)
        low = np.minimum(label, low)[np.minimum(label, low)]
        if (low == label).all():
            return label
        label = low


def bucket_links(texts: list[str], starts: np.ndarray, number: np.ndarray) -> list[tuple[int, int]]:
    """Links (a forest of numbers) between the similar lines of each of the buckets that begin at ``starts``; ``number``: each line's band."""
    ends = np.append(starts[1:], len(texts))
    size = ends - starts
    out: list[tuple[int, int]] = []
    few = np.flatnonzero((size > 1) & (size <= FEW))
    # pairs of each bucket: every line with those before it
    row = np.concatenate([np.arange(a, b) for a, b in zip(starts[few].tolist(), ends[few].tolist())] or [np.zeros(0, np.int64)])
    fan = row - np.repeat(starts[few], size[few])
    x = np.repeat(row, fan)
    y = x - 1 - (np.arange(len(x)) - np.repeat(np.cumsum(fan) - fan, fan))
    if len(x):
        # a pair is compared in the first bucket that both lines are in
        signature = signatures(texts)
        same = signature[x] == signature[y]
        bands = same.reshape(len(x), BANDS, BAND_HASHES).all(axis=2)
        likely = np.flatnonzero((same.sum(axis=1) >= LIKELY) & (bands.argmax(axis=1) == number[x]))
        x, y = x[likely], y[likely]
    used, place = np.unique(np.concatenate([x, y]), return_inverse=True)
    good = Sets([texts[k] for k in used.tolist()]).alike(place[: len(x)], place[len(x) :]) if len(x) else np.zeros(0, bool)
    parent: dict[int, int] = {}

    def root(n: int) -> int:
        while n in parent:
            n = parent[n]
        return n

    for p, q in zip(x[good].tolist(), y[good].tolist()):
        p, q = root(p), root(q)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((max(p, q), min(p, q)))
    for k in np.flatnonzero(size > FEW).tolist():
        rows = np.arange(starts[k], ends[k])
        label = _forest(Sets([texts[j] for j in rows.tolist()]).matrix(np.arange(len(rows))))
        out += [(int(starts[k]) + i, int(starts[k]) + j) for i, j in enumerate(label.tolist()) if i != j]
    return out


def shingles(line: str) -> frozenset[str]:
    return frozenset(line[k : k + SHINGLE] for k in range(max(1, len(line) - SHINGLE + 1)))


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) >= least


def _across(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the components of lines in (a pair of chunks of) one bucket."""
    rows = rows.drop_duplicates("key").sort_values("key")
    component = rows["component"].to_numpy()
    near = Sets(rows["line"].tolist()).matrix(np.arange(len(rows)))
    near |= component[:, None] == component[None, :]
    label = _forest(near)
    moved = np.flatnonzero(label != np.arange(len(label)))
    moved = moved[component[moved] != component[label[moved]]]
    return pd.DataFrame({"a": component[moved], "b": component[label[moved]]}, dtype="int64").drop_duplicates()


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, key, line) in order of band and key give links (a, b), and (band) of each bucket too large for one step."""
    bands: list[int] = []  # what is open: rows of the last bucket seen
    keys: list[int] = []
    texts: list[str] = []
    center: tuple[int, int, str] | None = None  # band, key and line that a large bucket is held against

    forest = Forest()  # two lines meet in up to BANDS buckets; one link is enough

    def batch_of(links: list[tuple[int, int]], large: list[int]) -> pa.RecordBatch:
        links = [x for x in links if forest.joins(*x)]
        none = [None] * len(links)
        columns = [[a for a, _ in links] + [None] * len(large), [b for _, b in links] + [None] * len(large), none + large]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "band"])

    def against_center() -> list[tuple[int, int]]:
        with_center = [center[2], *texts]
        other = np.arange(1, len(with_center))
        good = Sets(with_center).alike(other, np.zeros(len(texts), np.int64))
        return [(keys[k], center[1]) for k in np.flatnonzero(good).tolist() if keys[k] != center[1]]

    for batch in batches:
        for block in blocks(batch, 2, CHUNK_BYTES // 4):
            bands += block.column(0).to_pylist()
            keys += block.column(1).to_pylist()
            texts += block.column(2).to_pylist()
            links: list[tuple[int, int]] = []
            large: list[int] = []
            if center is not None:  # the large bucket goes on, or is over
                n = next((k for k, b in enumerate(bands) if b != center[0]), len(bands))
                rest = bands[n:], keys[n:], texts[n:]
                bands, keys, texts = bands[:n], keys[:n], texts[:n]
                links += against_center() if n else []
                bands, keys, texts = rest
                center = center if not bands else None
            if bands:
                band = np.array(bands)
                starts = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
                tail = int(starts[-1])
                if tail:
                    links += [(keys[a], keys[b]) for a, b in bucket_links(texts[:tail], starts[:-1], band[:tail] & 7)]
                    bands, keys, texts = bands[tail:], keys[tail:], texts[tail:]
                if len(texts) > CHUNK or sum(map(len, texts)) > CHUNK_BYTES:
                    center = bands[0], keys[0], texts[0]
                    large.append(bands[0])
                    links += against_center()
                    bands, keys, texts = [], [], []
            yield batch_of(links, large)
    if texts:
        yield batch_of([(keys[a], keys[b]) for a, b in bucket_links(texts, np.zeros(1, np.int64), np.array(bands) & 7)], [])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (band, key) in order of band those that aren't alone in theirs."""
    held, joined = None, False  # the last row seen, and whether it has the one before it for company
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(k).to_numpy() for k in (0, 1)], axis=1)
        if held is not None:
            rows = np.concatenate([held, rows])
        same = rows[1:, 0] == rows[:-1, 0]
        company = np.append(joined, same)
        company[:-1] |= same
        held, joined = rows[-1:], bool(company[-1])
        kept = rows[:-1][company[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array(kept[:, 0]), pa.array(kept[:, 1])], ["band", "key"])
    if held is not None and joined:
        yield pa.RecordBatch.from_arrays([pa.array(held[:, 0]), pa.array(held[:, 1])], ["band", "key"])


def line_classes(parts: DataFrame) -> DataFrame:
    """(node, component) of each distinct line, by its key, that is linked to another; ``parts`` is (id, line_no, line)."""
    # shorter lines are one shingle each: they are like equal ones only
    whole = parts.where(F.length("line") >= SHINGLE)
    lines_once = whole.select(line_key("line").alias("key"), "line").groupBy("key").agg(F.min("line").alias("line"))

    def step(block: pa.RecordBatch) -> dict[str, list]:
        keys = band_keys(block.column(1).to_pylist())
        return {"band": pa.array(keys.ravel()), "key": pa.array(np.repeat(block.column(0).to_numpy(), BANDS))}

    bands = map_blocks(lines_once.select("key", "line"), step, "band long, key long", limit=1 << 20)
    met = bands.repartition("band").sortWithinPartitions("band").mapInArrow(_met, "band long, key long")
    # each line is in BANDS buckets at most
    buckets = met.groupBy("key").agg(F.collect_list("band").alias("bands"))
    known = checkpointed(buckets.join(lines_once, "key").select("key", "line", "bands"))
    placed = known.select(F.explode("bands").alias("band"), "key", "line")
    found = checkpointed(placed.repartition("band").sortWithinPartitions("band", "key").mapInArrow(_compared, "a long, b long, band long"))
    first = connected_components(found.where("a is not null"))
    large = found.where("band is not null").select("band")
    if large.isEmpty():
        return first

    # which buckets hold several components is told without their lines; those are fetched for such buckets alone
    labelled = known.select("key", "bands", F.length("line").alias("chars")).join(first.withColumnRenamed("node", "key"), "key", "left")
    labelled = labelled.select(F.explode("bands").alias("band"), "key", "chars", F.coalesce("component", "key").alias("component"))
    inside = labelled.join(large, "band")
    size = inside.groupBy("band").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")
    )
    chunks = F.ceil(F.greatest(F.col("n") / CHUNK, F.col("chars") / CHUNK_BYTES)).cast("int")
    mixed = size.where("low < high").select("band", chunks.alias("chunks"))
    spread = checkpointed(inside.select("band", "key", "component").join(mixed, "band"))
    if spread.isEmpty():
        return first
    own = F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")
    lined = spread.join(known.select("key", "line"), "key")
    open_ = lined.select("band", "key", "line", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    open_ = open_.select("band", "key", "line", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    second = open_.groupBy("band", "i", "j").applyInPandas(_across, "a long, b long")
    # a line without links of the first kind is its own component
    joined = connected_components(second).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    moved = first.join(joined, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
    alone = joined.select(F.col("component").alias("node"), F.col("joined").alias("component")).join(first.select("node"), "node", "left_anti")
    return moved.union(alone)


def line_fates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, first_id, first_line_no, kept) of each line that isn't blank.

    ``first_...`` is the place of the first line, by id and number, of the
    line's component (equal or similar lines, transitively); only that one is
    kept.  Lines of rows with a null id are never dropped for others, nor kept
    in place of others: they have no place in the order.  A line that stands
    twice in one place (repeated rows) counts as one.
    """
    parts = lines(docs, id_col, text_col)
    classes = line_classes(parts)
    keyed = parts.select("id", "line_no", line_key("line").alias("key"))
    place = keyed.where("id is not null").groupBy("key").agg(F.min(F.struct("id", "line_no")).alias("first"))
    merged = place.join(classes.withColumnRenamed("node", "key"), "key", "left")
    merged = checkpointed(merged.withColumn("component", F.coalesce("component", "key")))
    least = merged.groupBy("component").agg(F.min("first").alias("first"))
    by_key = merged.select("key", "component").join(least, "component").select("key", "first")
    out = keyed.join(by_key, "key", "left")
    mine = F.struct("id", "line_no") == F.col("first")
    return out.select(
        F.col("id").alias(id_col), "line_no", F.col("first.id").alias("first_id"), F.col("first.line_no").alias("first_line_no"), F.coalesce(mine, F.lit(True)).alias("kept")
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with only the first of similar lines; blank lines stay.

    All columns stay.  Null texts stay null; rows whose lines all go have an
    empty text, or the blank lines that they had.
    """
    fates = line_fates(docs, id_col, text_col).where(~F.col("kept"))
    gone_id, gone_lines = fresh(docs, "_gone_id"), fresh(docs, "_gone")
    gone = fates.groupBy(F.col(id_col).alias(gone_id)).agg(F.collect_set("line_no").alias(gone_lines))
    kept = docs.join(gone, docs[id_col] == gone[gone_id], "left")
    split = F.split(F.col(text_col), "\n", -1)
    left = F.filter(split, lambda line, k: ~F.array_contains(gone_lines, k))
    text = F.when(F.col(gone_lines).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    return kept.withColumn(text_col, text).select(*[docs[f"`{c}`"] if c != text_col else F.col(text_col) for c in docs.columns])


def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fate of every line of every document."""
    return line_fates(table(spark, sf_dir, "documents"))
