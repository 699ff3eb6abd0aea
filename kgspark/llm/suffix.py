"""Repeated substrings by externally induced suffix sorting.

All windows of a fixed length that are equal have to meet in one shard.  In
each window the gram with the least hash is its anchor, so equal windows have
equal anchors, and a run of windows with one anchor is a context: a stretch of
text little longer than a window.  Contexts are shuffled by anchor as hashes.
An anchor that stands in one place has no repeat; equal contexts are one, of
which the first place stays and the others repeat it.  Where an anchor has
different contexts, their texts are shuffled by anchor.  A window reaches SIDE
bytes beyond its anchor to the left or to the right, so a context that shares
neither stretch with another has no repeat.  Every shard of the others is
sorted by external induction with common-prefix lengths (``induced``): runs of
suffixes that share a window's length are equal windows, all but the first of
which are repeats.  A shard is closed at the next anchor when it is full, and
the sorter's queues go to disk, so the size of a shard is no bound on anything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _arrow_schema, blocks, extended, fresh, table
from .induced import equal_starts
from .pretokens import powers

WINDOW, GRAM = 100, 28
SIDE = (WINDOW - GRAM) // 2
#: Text hashed at a time: the arrays stay in the processor's cache.
BLOCK = 1 << 17
#: Bytes of contexts after which a shard is sorted.
SHARD_BYTES = 4 << 20


def _digests(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that gives 64-bit hashes of the bytes from each place to another."""
    power, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * power[: len(data)], out=total[1:])

    def digest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (total[b] - total[a]) * inverse[a]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ h >> np.uint64(32)

    return digest


def _contexts(ids: np.ndarray, texts: list[bytes]) -> list[np.ndarray]:
    """Columns anchor, ctx, doc, at, n: runs of ``n`` windows from byte ``at`` on with one anchor."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    if n < WINDOW:
        return [np.zeros(0, np.int64)] * 5
    span = WINDOW - GRAM + 1
    digest = _digests(data)
    at = np.arange(n - GRAM + 1)
    gram = digest(at, at + GRAM)
    ranked = np.full(-(-len(gram) // span) * span + span, np.uint64(0xFFFFFFFFFFFFFFFF))
    ranked[: len(gram)] = gram >> np.uint64(32) << np.uint64(32) | at.astype(np.uint64)
    square = ranked.reshape(-1, span)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - WINDOW + 1)
    least = np.minimum(behind[starts], ahead[starts + span - 1])
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[starts] == owner[starts + WINDOW - 1]
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)[inside]
    starts = starts[inside]
    if not len(starts):
        return [np.zeros(0, np.int64)] * 5
    own = owner[starts]
    opens = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (own[1:] != own[:-1])]))
    low = starts[opens]
    count = np.diff(np.append(opens, len(starts)))
    ctx = digest(low, low + count + WINDOW - 1)
    ctx = (ctx ^ (count << 20 | place[opens] - low).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    first = np.cumsum(sizes) - sizes
    doc = own[opens]
    return [gram[place[opens]].view(np.int64), ctx.view(np.int64), ids[doc], low - first[doc], count]


class _Decider:
    """Takes rows (anchor, ctx, doc, at, n) in order; gives rows (doc, at, n, anchor, open).

    Rows that aren't open repeat an equal context; open ones are the first of
    their context, where the anchor has several.  Of an anchor that may go on,
    one row is kept.
    """

    def __init__(self) -> None:
        self.row: np.ndarray | None = None
        self.told = False  # the kept row's context has been given as open, or its anchor has several

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        told = self.told and self.row is not None
        if self.row is not None:
            rows = np.concatenate([self.row, rows])
        anchor, ctx = rows[:, 0], rows[:, 1]
        new_anchor = np.append(True, anchor[1:] != anchor[:-1])
        new_ctx = new_anchor | np.append(True, ctx[1:] != ctx[:-1])
        group = np.cumsum(new_anchor) - 1
        head = np.flatnonzero(new_ctx)[np.cumsum(new_ctx) - 1]
        several = np.bincount(group[new_ctx]) > 1
        if told:
            several[0] = True
        open_ = new_ctx & several[group]
        gone = ~new_ctx & ((rows[:, 2] != rows[head, 2]) | (rows[:, 3] != rows[head, 3]))
        if told:
            open_[0] = False
        out = np.flatnonzero(open_ | gone)
        result = np.stack([rows[out, 2], rows[out, 3], rows[out, 4], anchor[out], open_[out]], axis=1)
        self.told = bool(several[-1])
        self.row = rows[head[-1]][None]
        return result


def _decisions(contexts: DataFrame) -> DataFrame:
    schema = "doc long, at int, n int, anchor long, open boolean"
    arrow = _arrow_schema(contexts.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = _Decider()
        for batch in batches:
            if batch.num_rows:
                rows = decide(np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)], axis=1))
                columns = [pa.array(rows[:, k].astype(bool) if f.name == "open" else rows[:, k], f.type) for k, f in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return contexts.repartition("anchor").sortWithinPartitions("anchor", "ctx", "doc", "at").mapInArrow(run, schema)


def may_repeat(anchor: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Which contexts share a stretch of SIDE bytes beside their anchor with another of the shard."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    digest = _digests(data)
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(data) - GRAM + 1)
    own = owner[at]
    hit = np.flatnonzero((digest(at, at + GRAM).view(np.int64) == anchor[own]) & (at + GRAM <= ends[own]))
    own = own[hit]
    # where the anchor's bytes stand more than once, the context is taken as it is
    keep = np.bincount(own, minlength=len(texts)) != 1
    for before, behind in ((SIDE, GRAM), (0, GRAM + SIDE)):
        fits = (hit - before >= ends[own] - sizes[own]) & (hit + behind <= ends[own])
        _, name, count = np.unique(digest(hit[fits] - before, hit[fits] + behind), return_inverse=True, return_counts=True)
        keep[own[fits][count[name] > 1]] = True
    return keep


def shard_repeats(docs: np.ndarray, at: np.ndarray, n: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of what repeats an earlier window, from the contexts of a shard."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(x for t in texts for x in (t, b"\xff")), np.uint8) + np.uint8(1)  # UTF-8 has no byte 255
    runs, number = [], []
    for run in equal_starts(text, WINDOW):
        runs.append(run)
        number.append(len(run))
    if not runs:
        return (np.zeros(0, np.int64),) * 3
    place, run = np.concatenate(runs), np.repeat(np.arange(len(runs)), number)
    of = np.searchsorted(begins, place, side="right") - 1
    offset = place - begins[of]
    valid = offset < n[of]
    of, offset, run = of[valid], offset[valid], run[valid]
    doc, start = docs[of], at[of] + offset
    order = np.lexsort((start, doc, run))
    doc, start, run = doc[order], start[order], run[order]
    opens = np.append(True, run[1:] != run[:-1])
    head = np.flatnonzero(opens)[np.cumsum(opens) - 1] if len(run) else np.zeros(0, np.int64)
    again = (doc != doc[head]) | (start != start[head])
    doc, start = doc[again], start[again]
    return merged(doc, start, start + WINDOW)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the intervals of each document; those that touch are one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    # each document's places behind those of the one before it, so that one running maximum serves all
    shift = (np.cumsum(np.append(False, doc[1:] != doc[:-1]))) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    opens = np.flatnonzero(np.append(True, (start + shift)[1:] > reach[:-1]))
    last = np.append(opens[1:], len(doc)) - 1
    return doc[opens], start[opens], (reach - shift)[last]


def _sorted_shards(contexts: DataFrame) -> DataFrame:
    schema = "doc long, lo int, hi int"
    arrow = _arrow_schema(contexts.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            anchors, docs, at, n = (np.concatenate([h[k] for h in held]) for k in range(4))
            texts = [t for h in held for t in h[4]]
            some = np.flatnonzero(may_repeat(anchors, texts))
            found = shard_repeats(docs[some], at[some], n[some], [texts[k] for k in some.tolist()]) if len(some) else (np.zeros(0, np.int64),) * 3
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, arrow)], schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])).tolist() + [len(anchor)]
            columns = [batch.column(k).to_numpy().astype(np.int64) for k in range(4)]
            texts = batch.column(4).to_pylist()
            begin = 0
            for a, b in zip(cuts, cuts[1:]):
                # a full shard is closed where an anchor begins
                if size >= SHARD_BYTES and anchor[a] != last:
                    if a > begin:
                        held.append(tuple(c[begin:a] for c in columns) + (texts[begin:a],))
                    yield flush()
                    held, size, begin = [], 0, a
                last = anchor[a]
                size += sum(map(len, texts[a:b]))
            held.append(tuple(c[begin:] for c in columns) + (texts[begin:],))
        if held:
            yield flush()

    return contexts.repartition("anchor").sortWithinPartitions("anchor", "doc", "at").mapInArrow(run, schema)


def mark_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``removed`` (byte spans start, end) and ``kept`` (the other bytes).

    A byte is removed if a string of WINDOW bytes covers it that also starts
    earlier: in a document of smaller id, or before in the same one.  Texts are
    UTF-8 bytes, null ones empty, and strings don't cross documents.  Rows with
    a null id are left whole and don't count.  Ids are a document's name: rows
    of one id with one text are one document and get the same result.  Columns
    that are named removed or kept already are replaced.
    """
    docs = docs.drop("removed", "kept")
    names = docs.columns
    text_at, marked, sorted_ = names.index(text_col), fresh(docs, "_doc"), fresh(docs, "_sorted")
    session = docs.sparkSession
    context_schema = _arrow_schema(session, "anchor long, ctx long, doc long, at int, n int")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, 1, BLOCK):
                columns = _contexts(block.column(0).to_numpy(zero_copy_only=False), [(t or "").encode() for t in block.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, context_schema)], schema=context_schema)

    hashed = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), text_col).mapInArrow(contexts, "anchor long, ctx long, doc long, at int, n int")
    decided = _decisions(hashed).groupBy("doc").agg(F.collect_list(F.struct("at", "n", "anchor", "open")).alias(fresh(docs, "_marks"))).withColumnRenamed("doc", marked)
    with_marks = docs.join(decided, docs[id_col] == decided[marked], "left")
    marks_at = len(names) + 1
    open_schema = _arrow_schema(session, "anchor long, doc long, at int, n int, context binary")

    def open_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            row, (at, n, anchor, is_open) = _exploded(batch.column(marks_at))
            wanted = np.flatnonzero(is_open)
            last, raw, doc = -1, b"", 0
            for k, start, size, name in zip(row[wanted].tolist(), at[wanted].tolist(), n[wanted].tolist(), anchor[wanted].tolist()):
                if k != last:
                    last, raw, doc = k, batch.column(text_at)[k].as_py().encode(), batch.column(marks_at - 1)[k].as_py()
                rows.append((name, doc, start, size, raw[start : start + size + WINDOW - 1]))
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, open_schema)], schema=open_schema)

    opened = with_marks.mapInArrow(open_contexts, "anchor long, doc long, at int, n int, context binary")
    spans = _sorted_shards(opened).groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias(fresh(docs, "_spans"))).withColumnRenamed("doc", sorted_)
    joined = with_marks.join(spans, docs[id_col] == spans[sorted_], "left")
    schema = extended(docs, "removed array<struct<start:int,end:int>>, kept binary")
    arrow = _arrow_schema(session, schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                removed, kept = [], []
                row, (at, n, _, is_open) = _exploded(part.column(marks_at))
                row2, (lo, hi) = _exploded(part.column(marks_at + 2))
                gone = ~is_open
                start, end = np.append(at[gone], lo).astype(np.int64), np.append(at[gone] + n[gone] + WINDOW - 1, hi).astype(np.int64)
                row, start, end = merged(np.append(row[gone], row2), start, end)
                first = np.searchsorted(row, np.arange(part.num_rows + 1)).tolist()
                start, end = start.tolist(), end.tolist()
                for j, text in enumerate(part.column(text_at).to_pylist()):
                    raw = (text or "").encode()
                    runs = list(zip(start[first[j] : first[j + 1]], end[first[j] : first[j + 1]]))
                    removed.append([{"start": a, "end": b} for a, b in runs])
                    edges = [0, *(x for r in runs for x in r), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                columns = [part.column(j) for j in range(len(names))] + [pa.array(removed, arrow.field("removed").type), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return joined.mapInArrow(apply, schema)


def _exploded(lists: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row that each struct of a column of lists stands in, and the structs' fields."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), [f.to_numpy(zero_copy_only=False) for f in lists.flatten().flatten()]


def op5_induced_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without repeated strings of 100 bytes."""
    done = mark_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return done.select(
        "doc_id", size.alias("n_bytes"), (size - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("removed")
    )
