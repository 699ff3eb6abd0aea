"""Near-duplicate passages by compact windows.

A text is the sequence of its five-word shingles.
For one hash function, the Cartesian tree over the hashes cuts it into compact
windows: all subsequences that begin and end around a node, within the node's
reach, have their minimum hash at that node.  Only windows that can hold a
passage of the least length count, about two in that many words; of windows of
one text with one minimum (repetitive text) the widest counts.  Windows of
one hash function with the same minimum are grouped over the corpus.  Equal
windows of a group are one: the earliest document's stands for all, and what
the others hold repeats it.

A passage reaches REACH shingles to one side of its minimum at least, so each
window carries a sketch of either side, and two windows meet only where the
sketches of a side agree.  Pairs of documents that meet under enough hash
functions are verified: where the later one's shingles run through the earlier
one's region, the Jaccard similarity of the two passages is taken exactly, and
a passage that reaches it is a repeat.  One such finding settles a window, so
verification goes in two rounds: first each window meets the first and the last
of its group that agree with it; then every window that isn't settled and that
has more of them meets all others of its group, in bounded cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _arrow_schema, blocks, checkpointed, distinct, extended, fresh, table
from .pretokens import powers

SHINGLE_WORDS, SIMILARITY, LEAST_WORDS = 5, 0.8, 50
#: Hash functions, and how many of them have to bring two documents together.
HASHES, ENOUGH = 6, 2
#: Shingles missing in a row that one passage may span: an edit spoils SHINGLE_WORDS.
GAP = 2 * SHINGLE_WORDS
BLOCK = 1 << 19
#: Shingles on a side of a minimum that a sketch covers, its parts of four bits, and how many have to agree.
REACH, PARTS, AGREE = (LEAST_WORDS - SHINGLE_WORDS) // 2, 7, 3
#: In the second round: places on a side of a minimum that are compared, and how far off a shingle may be.
SIDE, SHIFT = LEAST_WORDS - SHINGLE_WORDS, 8
#: Places on a side of a minimum that tell whether a passage can be alike at all.
WIDE = 3 * SIDE
#: The bit of a shingle's sixteen that tells that it isn't settled.
NEW = 2
#: Part of a window's shingles around its minimum that settles it, and how many others it meets at a time.
NEARLY, FIRST = 0.9, 64
#: Windows in a block of a group in the first round and in the second, partners listed in one row, pairs made at a time; they bound memory only.
GROUP_ROWS, CELL_ROWS, LISTED, PAIRS = 128, 2048, 64, 1 << 16
_SPREAD = 0x5851F42D
_SKETCH = np.random.default_rng(13).integers(1, 1 << 32, (2, PARTS), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_MIX = np.random.default_rng(11).integers(1, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends; words end at ASCII white space."""
    data = np.frombuffer(raw, np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[1], blank.view(np.int8), [1]]))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def shingle_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of SHINGLE_WORDS words from each word on, as far as the array of words goes; A-Z count as a-z."""
    data = np.frombuffer(raw, np.uint8).astype(np.uint64)
    data += np.where((data >= 65) & (data <= 90), np.uint64(32), np.uint64(0))
    power, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * power[: len(data)], out=total[1:])
    word = (total[ends] - total[starts]) * inverse[starts]
    word ^= word >> np.uint64(32)
    word *= np.uint64(0xD6E8FEB86659FD93)
    word ^= word >> np.uint64(29)
    n = len(word) - SHINGLE_WORDS + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE_WORDS):
        out = out * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n]
        out ^= out >> np.uint64(31)
    return out


def document_shingles(text: str | None) -> np.ndarray:
    raw = (text or "").encode()
    return shingle_hashes(raw, *word_spans(raw))


def block_shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``document_shingles`` of many texts one behind the other, and how many each has."""
    raws = [(text or "").encode() for text in texts]
    raw = b" ".join(raws)
    starts, ends = word_spans(raw)
    # a blank stands between two texts, so no word belongs to both
    owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raws]), starts, side="right")
    whole = owner[: max(len(owner) - SHINGLE_WORDS + 1, 0)] == owner[SHINGLE_WORDS - 1 :]
    return shingle_hashes(raw, starts, ends)[whole], np.bincount(owner[: len(whole)][whole], minlength=len(texts))


def short(hashes: np.ndarray) -> np.ndarray:
    """32 bits of each hash, which tell the shingles of two texts apart and make half the shuffle."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


def compact_windows(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r), all inclusive, of the windows at least ``least`` wide in each run [start, end).

    Level by level down the Cartesian trees of all runs at once.
    """
    n = len(values)
    if n >= 1 << 31:
        raise ValueError("a block has too many shingles")
    # of equal values any may be the least; places in mixed order keep the trees of repetitive texts low
    mixed = np.arange(n, dtype=np.uint64) * np.uint64(_SPREAD) & np.uint64((1 << 31) - 1)
    ranked = np.append(values >> np.uint64(31) << np.uint64(31) | mixed, np.uint64(0))
    left, right = starts.astype(np.int64), ends.astype(np.int64)
    out = []
    while True:
        wide = right - left >= least
        left, right = left[wide], right[wide]
        if not len(left):
            break
        low = np.minimum.reduceat(ranked, np.stack([left, right], axis=1).ravel())[::2]
        center = ((low & np.uint64((1 << 31) - 1)) * np.uint64(pow(_SPREAD, -1, 1 << 31)) & np.uint64((1 << 31) - 1)).astype(np.int64)
        out.append((left, center, right - 1))
        left, right = np.stack([left, center + 1], axis=1).ravel(), np.stack([center, right], axis=1).ravel()
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(part) for part in zip(*out))


def _hashed(hashes: np.ndarray, f: int) -> np.ndarray:
    """Values of hash function ``f``."""
    value = hashes * _MIX[f]
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xFF51AFD7ED558CCD)
    return value ^ value >> np.uint64(29)


def _sketches(hashes: np.ndarray) -> np.ndarray:
    """For each place a sketch of the REACH shingles from it on; what there is of them at the end."""
    n = len(hashes)
    short_hash = (hashes >> np.uint64(32)).astype(np.uint32)
    square = np.full(-(-n // REACH) * REACH + REACH, 0xFFFFFFFF, np.uint32)
    out = np.zeros(n, np.int64)
    for k in range(PARTS):
        square[:n] = short_hash * _SKETCH[0, k] + _SKETCH[1, k]
        rows = square.reshape(-1, REACH)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[REACH - 1 : REACH - 1 + n])
        out = out << 4 | (least * np.uint32(0x9E3779B1) >> np.uint32(28))
    return out


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of sketches (left, right) agree on a side that both have whole."""
    out = np.zeros(len(a), bool)
    ones = int("1" * PARTS, 16)
    for side in (0, 1):
        x, y = a[:, side], b[:, side]
        apart = x ^ y
        apart |= apart >> 2
        apart |= apart >> 1
        apart &= ones
        out |= (x >= 0) & (y >= 0) & (np.bitwise_count(apart) <= PARTS - AGREE)
    return out


def _block_windows(ids: np.ndarray, texts: list[str | None]) -> list[np.ndarray]:
    """Columns of all windows of a block of documents: key, doc, l, r (word numbers), digest, sketches of both sides (-1: not whole)."""
    h, counts = block_shingles(texts)
    if not len(h):
        return [np.zeros(0, np.int64)] * 7
    own = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    ends = np.append(starts[1:], len(own))
    power, inverse = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum((h | np.uint64(1)) * power[: len(h)], out=total[1:])
    sketch = np.append(_sketches(h), 0)
    parts = []
    for f in range(HASHES):
        value = _hashed(h, f)
        left, center, right = compact_windows(value, starts, ends, LEAST_WORDS - SHINGLE_WORDS + 1)
        widest = np.argsort(left - right, kind="stable")
        left, center, right = left[widest], center[widest], right[widest]
        key = value[center] >> np.uint64(3) << np.uint64(3) | np.uint64(f)
        _, first = np.unique(key + own[center].astype(np.uint64) * np.uint64(0xA0761D6478BD642F), return_index=True)
        left, center, right, key = left[first], center[first], right[first], key[first]
        digest = (total[right + 1] - total[left]) * inverse[left]
        digest ^= digest >> np.uint64(32)
        digest *= np.uint64(0xD6E8FEB86659FD93)
        before = np.where(center - left >= REACH, sketch[np.maximum(center - REACH, 0)], -1)
        behind = np.where(right - center >= REACH, sketch[center + 1], -1)
        parts.append((key.view(np.int64), ids[own[center]], at[left], at[right], digest.view(np.int64) >> 32, before, behind))
    return [np.concatenate(c) for c in zip(*parts)]


def _windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    schema = "key long, doc long, l int, r int, digest int, before int, behind int"
    arrow = _arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, 1, BLOCK):
                columns = _block_windows(block.column(0).to_numpy(zero_copy_only=False), block.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), text_col).mapInArrow(run, schema)


def _met(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Columns a, b, f, l, r of the meetings of rows (key, doc, l, r, ...); the window is the earlier document's."""
    apart = x[:, 1] != y[:, 1]
    x, y = x[apart], y[apart]
    swap = (x[:, 1] > y[:, 1])[:, None]
    a, b = np.where(swap, y, x), np.where(swap, x, y)
    return [a[:, 1], b[:, 1], a[:, 0] & 7, a[:, 2], a[:, 3]]


def _grouped(windows: DataFrame) -> DataFrame:
    """Rows (kind, key, a, b, l, r, before, behind), which hold, by kind:

    0  a meeting of windows of documents a < b with a common key
    1  a window of document b that is equal to an earlier document's
    2  a window of document a that agrees with more of its key than it has met, or may do so

    The rows of a key come in order; one block of its windows is held.
    """
    schema = "kind int, key long, a long, b long, l int, r int, before int, behind int"
    arrow = _arrow_schema(windows.sparkSession, schema)

    def batch_of(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        columns = [np.full(len(columns[0]), kind), *columns]
        columns += [np.zeros(len(columns[0]), np.int64)] * (len(arrow) - len(columns))
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the open block, which of its rows have more to meet, its number, the last window that stands for others
        held, more, number, last = np.zeros((0, 7), np.int64), np.zeros(0, bool), 0, None

        def kept(rows: np.ndarray) -> pa.RecordBatch:
            return batch_of(2, rows[:, 0], rows[:, 1], rows[:, 1], rows[:, 2], rows[:, 3], rows[:, 5], rows[:, 6])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(7)], axis=1)
            seen = 0 if last is None else 1
            if seen:
                rows = np.concatenate([last[None], rows])
            new_key = np.append(True, rows[1:, 0] != rows[:-1, 0])
            heads = new_key | np.append(True, (rows[1:, 4:] != rows[:-1, 4:]).any(axis=1) | (rows[1:, 3] - rows[1:, 2] != rows[:-1, 3] - rows[:-1, 2]))
            head = np.flatnonzero(heads)[np.cumsum(heads) - 1]
            again = np.flatnonzero(~heads & (rows[:, 1] != rows[head, 1]))
            if len(again):
                g = rows[again]
                yield batch_of(1, g[:, 0], g[:, 1], g[:, 1], g[:, 2], g[:, 3])
            last = rows[head[-1]]
            fresh_rows = rows[seen:][heads[seen:]]
            if not len(fresh_rows):
                continue
            rows = np.concatenate([held, fresh_rows])
            more = np.append(more, np.zeros(len(fresh_rows), bool))
            opens = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
            sides = rows[:, 5:].astype(np.int32)
            # the place of a row among its key's; the rows held begin a block and have met one another
            first = np.repeat(opens, np.diff(np.append(opens, len(rows))))
            place = np.arange(len(rows)) - first
            block = place // GROUP_ROWS + np.where(first == 0, number, 0)
            earlier = np.where(np.arange(len(rows)) < len(held), 0, place % GROUP_ROWS)
            todo = np.flatnonzero(earlier)
            bounds = np.append(0, np.cumsum(earlier[todo]))
            k = 0
            while k < len(todo):
                m = max(k + 1, int(np.searchsorted(bounds, bounds[k] + PAIRS, side="right")) - 1)
                y = np.repeat(todo[k:m], earlier[todo[k:m]])
                x = y - 1 - (np.arange(len(y)) - np.repeat(bounds[k:m] - bounds[k], earlier[todo[k:m]]))
                good = np.flatnonzero(_agree(sides[x], sides[y]) & (rows[x, 1] != rows[y, 1]))
                x, y = x[good], y[good]
                change = y[1:] != y[:-1]
                chosen = np.append(True, change)[: len(y)] | np.append(change, True)[: len(y)]
                more[x[~chosen]] = more[y[~chosen]] = True
                a, b, _, l, r = _met(rows[x[chosen]], rows[y[chosen]])  # noqa: E741
                yield batch_of(0, rows[y[chosen], 0], a, b, l, r)
                k = m
            same_key = rows[1:, 0] == rows[:-1, 0]
            begin = np.flatnonzero(np.append(True, ~same_key | (block[1:] != block[:-1])))
            for a, z in zip(begin[:-1].tolist(), begin[1:].tolist()):
                if block[a] or same_key[z - 1]:
                    more[a:z] = True
            done = rows[: begin[-1]][more[: begin[-1]]]
            if len(done):
                yield kept(done)
            held, more, number = rows[begin[-1] :], more[begin[-1] :], int(block[-1])
        if number:
            more[:] = True
        if more.any():
            yield kept(held[more])

    order = ("key", "digest", "before", "behind", "doc", "l")
    return windows.repartition("key").sortWithinPartitions(*order).mapInArrow(run, schema)


def _signed(docs: DataFrame, windows: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``windows`` (key, doc, l, r, ...) with ``near``: 16 bits for each shingle up to WIDE places from the minimum, 0 beyond the window.

    One bit of them tells that the shingle lies in none of the ``known``
    (doc, spans) repeats.
    """
    names, extra = docs.columns, windows.columns
    mine, listed = fresh(docs, "_a"), fresh(docs, "_asked")
    by_doc = windows.groupBy("doc").agg(F.collect_list(F.struct(*extra)).alias(listed)).join(known, "doc", "left")
    by_doc = by_doc.select(F.col("doc").alias(mine), listed, F.col("spans").alias(fresh(docs, "_heard")))
    schema = extended(windows, "near binary")
    arrow = _arrow_schema(docs.sparkSession, schema)
    text_at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.filter(pa.compute.and_(batch.column(len(names) + 1).is_valid(), batch.column(text_at).is_valid()))
            for block in blocks(asked, text_at, BLOCK):
                listed = block.column(len(names) + 1)
                part, sizes = listed.flatten(), listed.value_lengths().to_numpy()
                key, left, right = (part.field(extra.index(c)).to_numpy().astype(np.int64) for c in ("key", "l", "r"))
                h, counts = block_shingles(block.column(text_at).to_pylist())
                begin = np.cumsum(counts) - counts
                bits = (h >> np.uint64(48)).astype(np.uint16) | np.uint16(NEW | 1)
                for start, count, spans in zip(begin.tolist(), counts.tolist(), block.column(len(names) + 2).to_pylist()):
                    for span in spans or []:
                        known_end = min(max(span["start"], span["end"] - SHINGLE_WORDS + 1), count)
                        bits[start + span["start"] : start + known_end] &= np.uint16(0xFFFF ^ NEW)
                bits = np.pad(bits, WIDE)
                left, right = (x + np.repeat(begin, sizes) for x in (left, right))
                center = np.zeros(len(key), np.int64)
                for f in range(HASHES):
                    value, mine_ = _hashed(h, f), np.flatnonzero(key & 7 == f)
                    center[mine_] = [a + int(value[a : b + 1].argmin()) for a, b in zip(left[mine_].tolist(), right[mine_].tolist())]
                for k in range(0, len(key), PAIRS // 8):
                    here = slice(k, k + PAIRS // 8)
                    at = center[here, None] + np.arange(-WIDE, WIDE + 1)
                    near = np.where((at >= left[here, None]) & (at <= right[here, None]), bits[at + WIDE], np.uint16(0))
                    width = near.shape[1] * near.itemsize
                    offsets = pa.py_buffer(np.arange(0, (len(near) + 1) * width, width, dtype=np.int32))
                    binary = pa.Array.from_buffers(pa.binary(), len(near), [None, offsets, pa.py_buffer(near)])
                    columns = [part.field(c).slice(k, PAIRS // 8) for c in range(len(extra))] + [binary]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.join(by_doc, docs[id_col] == by_doc[mine], "left").mapInArrow(run, schema)


def _stretches(found: np.ndarray, least: float) -> np.ndarray:
    """Which places lie in a stretch as long as the least passage of which ``least`` places are ``found``."""
    width = LEAST_WORDS - SHINGLE_WORDS + 1
    out = np.zeros(found.shape, bool)
    some = np.flatnonzero(np.count_nonzero(found, axis=1) >= least)
    if not len(some):
        return out
    total = np.zeros((len(some), found.shape[1] + 1), np.int16)
    np.cumsum(found[some], axis=1, out=total[:, 1:])
    begun = np.zeros((len(some), found.shape[1] + width), np.int16)
    good = total[:, width:] - total[:, :-width] >= least
    np.cumsum(good, axis=1, out=begun[:, width : width + good.shape[1]])
    begun[:, width + good.shape[1] :] = begun[:, [width + good.shape[1] - 1]]
    out[some] = begun[:, width:] > begun[:, :-width]
    return out


def _held(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which shingles of rows ``y`` around their minimum lie in a passage that ``x`` surely holds.

    So many of a stretch of the least length stand in ``x`` in line with the
    minimum that the two stretches, which are equally long, are alike.  Where
    that leaves none that is new, longer stretches are looked at.
    """
    in_line = ((x | np.uint16(NEW)) == (y | np.uint16(NEW))) & (y > 0)
    out = _stretches(in_line, 2 * SIMILARITY / (1 + SIMILARITY) * (LEAST_WORDS - SHINGLE_WORDS + 1)) & (y > 0)
    if y.shape[1] > 2 * SIDE + 1:
        some = np.flatnonzero(~(out & (y & np.uint16(NEW) > 0)).any(axis=1))
        out[some] = _likely(in_line[some], None)
    return out


def _possible(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which shingles of rows ``y`` around their minimum stand in those of ``x``, up to SHIFT places off, where that may make a passage; and whether nearly all stand there.

    A long passage has a part as long as the least one in SIMILARITY of whose
    shingles stand in ``x``, and one of up to 86 words has them in all such
    parts; so what lies in none can't count.
    """
    padded, asked = np.pad(x | np.uint16(NEW), ((0, 0), (SHIFT, SHIFT))), y | np.uint16(NEW)
    hit = np.zeros(y.shape, bool)
    for k in range(2 * SHIFT + 1):
        hit |= padded[:, k : k + y.shape[1]] == asked
    hit &= y > 0
    whole = np.count_nonzero(y, axis=1)
    nearly = (np.count_nonzero(hit, axis=1) >= NEARLY * whole) & (whole > SIDE)
    return hit & _stretches(hit, SIMILARITY * (LEAST_WORDS - SHINGLE_WORDS + 1)), nearly


def _matched(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which shingles of rows ``y`` stand in those of ``x`` up to SHIFT places off, and how far off, the least of several."""
    padded, asked = np.pad(x | np.uint16(NEW), ((0, 0), (SHIFT, SHIFT))), y | np.uint16(NEW)
    hit, off = np.zeros(y.shape, bool), np.zeros(y.shape, np.int16)
    for k in sorted(range(-SHIFT, SHIFT + 1), key=abs, reverse=True):
        same = padded[:, k + SHIFT : k + SHIFT + y.shape[1]] == asked
        hit |= same
        off[same] = k
    return hit & (y > 0), off


def _likely(hit: np.ndarray, off: np.ndarray | None, credit: np.ndarray | int = 0, first: np.ndarray | int = 0, last: np.ndarray | int = 0) -> np.ndarray:
    """Which places lie between two ``hit`` ones, as far apart as the ends of the least passage, that may bound a passage alike.

    Of p places and q of the other text's, the c that are hit are enough if
    9 c >= 4 (p + q); q is p and what the ends' ``off`` differ, or p where that
    is None.  No passage spans GAP places without a hit.  ``credit``
    is what the left side may lack for each row, ``first`` and ``last`` what it
    may lack besides for a passage that begins or ends at the rim, since it may
    go on beyond it.
    """
    n, width = hit.shape
    least = LEAST_WORDS - SHINGLE_WORDS
    out = np.zeros((n, width + 1), np.int16)
    count = np.zeros((n, width + 1), np.int16)
    np.cumsum(hit, axis=1, dtype=np.int16, out=count[:, 1:])
    end = 9 * count[:, 1:] - 8 * np.arange(1, width + 1, dtype=np.int16)
    gap = hit[:, :-GAP] & (count[:, GAP + 1 :] == count[:, 1:-GAP])
    gaps = np.flatnonzero(gap.any(axis=1))
    end[gaps, GAP:] -= np.cumsum(gap[gaps], axis=1, dtype=np.int16) * np.int16(width)
    rim, lowest = end[:, -1].copy(), end + np.int16(8)
    lowest[hit] -= 9
    if off is not None:
        lowest -= 4 * off
        end -= 4 * off
    far = np.int16(1 << 14)
    lowest[~hit], end[~hit] = far, -far
    credit, first, last = (np.minimum(v, 1 << 12).astype(np.int16) for v in (credit, first, last))
    end += np.reshape(credit, (-1, 1))
    lowest[:, 0] = np.minimum(lowest[:, 0], np.where(first > 0, -first, far))
    end[:, -1] = np.maximum(end[:, -1], np.where(last > 0, rim + credit + last, -far))
    np.minimum.accumulate(lowest, axis=1, out=lowest)
    some = np.flatnonzero((end[:, least:] >= lowest[:, : width - least]).any(axis=1))
    low, high = lowest[some], end[some]
    row, at = np.nonzero(high[:, least:] >= low[:, : width - least])
    # the first place from which a passage may reach each of these; the lowest only falls
    for k in range(0, len(row), PAIRS // 8):
        r, z = row[k : k + PAIRS // 8], at[k : k + PAIRS // 8] + least
        np.add.at(out, (some[r], np.count_nonzero(low[r] > high[r, z][:, None], axis=1)), 1)
        np.add.at(out, (some[r], z + 1), -1)
    out[some] = np.cumsum(out[some], axis=1, dtype=np.int16)
    return out[:, :-1] > 0


def _cell_meetings(
    cell: np.ndarray,
    doc: np.ndarray,
    width: np.ndarray,
    sides: np.ndarray,
    near: np.ndarray,
    base: np.ndarray,
    guest: np.ndarray,
    holds: Callable[[np.ndarray, np.ndarray], np.ndarray] = _held,
) -> np.ndarray:
    """Columns base, guest, sure of the meetings of the rows of some cells, which come by cell and document.

    ``near`` is written on: what a guest has met is no longer new.  ``holds``
    tells which shingles of a guest lie in a passage that a base surely holds.
    """
    inner = near[:, WIDE - SIDE : WIDE + SIDE + 1]
    bases = np.flatnonzero(base)
    before = np.cumsum(base) - base
    heads = np.append(True, cell[1:] != cell[:-1])[: len(cell)]
    docs = heads | np.append(True, doc[1:] != doc[:-1])[: len(cell)]
    # the bases of a guest's cell that are earlier documents'
    first, upto = (before[np.flatnonzero(h)[np.cumsum(h) - 1]] for h in (heads, docs))
    guests = np.flatnonzero(guest & (upto > first))
    left = np.count_nonzero(inner & np.uint16(NEW), axis=1)
    met = [np.zeros((0, 3), np.int64)]

    def candidates() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for wave in range(0, int((upto - first)[guests].max(initial=0)), FIRST):
            some = guests[(left[guests] > GAP) & (first[guests] + wave < upto[guests])]
            start = first[some] + wave
            bounds = np.append(0, np.cumsum(np.minimum(FIRST, upto[some] - start)))
            k = 0
            while k < len(some):
                m = max(k + 1, int(np.searchsorted(bounds, bounds[k] + PAIRS, side="right")) - 1)
                times = np.diff(bounds[k : m + 1])
                y = np.repeat(some[k:m], times)
                x = bases[np.repeat(start[k:m] - (bounds[k:m] - bounds[k]), times) + np.arange(len(y))]
                good = np.flatnonzero(_agree(sides[x], sides[y]))
                for c in range(0, len(good), 1 << 12):
                    yield x[good[c : c + (1 << 12)]], y[good[c : c + (1 << 12)]]
                k = m

    def added(y: np.ndarray, places: np.ndarray) -> np.ndarray:
        return np.count_nonzero(places & (inner[y] & np.uint16(NEW) > 0), axis=1)

    def tell(x: np.ndarray, y: np.ndarray, sure: bool) -> None:
        met.append(np.stack([x, y, np.full(len(x), sure, np.int64)], axis=1))

    def best_told(x: np.ndarray, y: np.ndarray, held: np.ndarray, asked: np.ndarray) -> None:
        """Meetings that add some of what is ``asked``: for each guest the one that adds most, the earliest of equals, and so on."""
        while len(y):
            adds = added(y, held & asked)
            some = np.flatnonzero(adds > GAP)
            x, y, held, asked, adds = x[some], y[some], held[some], asked[some], adds[some]
            by_guest = np.lexsort((doc[x], -adds, y))
            best = by_guest[np.append(True, y[by_guest[1:]] != y[by_guest[:-1]])[: len(y)]]
            tell(x[best], y[best], True)
            inner[y[best]] &= np.where(held[best], np.uint16(0xFFFF ^ NEW), np.uint16(0xFFFF))
            left[y[best]] = np.count_nonzero(inner[y[best]] & np.uint16(NEW), axis=1)

    for x, y in candidates():
        held = holds(inner[x], inner[y])
        best_told(x, y, held, held)
    again_ = np.full(len(near), -1)

    def repeats(rows: np.ndarray) -> np.ndarray:
        """How many shingles of each row come again in it."""
        asked = distinct(rows[again_[rows] < 0])
        ordered = np.sort(near[asked] & np.uint16(0xFFFF ^ NEW), axis=1)
        again_[asked] = np.count_nonzero((ordered[:, 1:] == ordered[:, :-1]) & (ordered[:, 1:] > 0), axis=1)
        return again_[rows]

    for x, y in candidates():
        hit, nearly = _possible(inner[x], inner[y])
        rest = added(y, hit) > GAP
        settled = np.flatnonzero(nearly & rest)
        y2, one = np.unique(y[settled], return_index=True)
        tell(x[settled[one]], y2, True)
        inner[y2] &= np.uint16(0xFFFF ^ NEW)
        left[y2] = 0
        rest &= ~np.isin(y, y2)
        x, y, hit = x[rest], y[rest], hit[rest]
        if not len(y):
            continue
        ours = near[y]
        # as far as any of these windows goes
        reach = max(SIDE + 1, *np.abs(np.flatnonzero(ours.any(axis=0))[[0, -1]] - WIDE).tolist())
        reached, middle = slice(WIDE - reach, WIDE + reach + 1), slice(reach - SIDE, reach + SIDE + 1)
        ours, theirs = ours[:, reached], near[x, reached]
        found, off = _matched(theirs, ours)
        # what no passage in reach holds can't be verified; beyond it, all may be alike, and shingles may come again
        beyond = np.minimum(width[x] - np.count_nonzero(near[x], axis=1), width[y] - np.count_nonzero(ours, axis=1))
        again = 4 * (repeats(x) + repeats(y))
        rims = [np.where((near[x, k] > 0) & (near[y, k] > 0), beyond, 0) for k in (0, -1)]
        may = _likely(found, None, again, *rims)[:, middle]
        moved = np.flatnonzero((off != 0).any(axis=1))
        may[moved] |= _likely(found[moved], off[moved], again[moved], *(rim[moved] for rim in rims))[:, middle]
        some = np.flatnonzero(added(y, hit & may) > GAP)
        x, y, hit, may = x[some], y[some], hit[some], may[some]
        best_told(x, y, holds(theirs[some], ours[some])[:, middle], hit)
        rest = added(y, hit & may) > GAP
        tell(x[rest], y[rest], False)
    return np.concatenate(met)


def _across(docs: DataFrame, grouped: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Meetings (key, a, b, al, ar) of the windows of kind 2 that ``spans`` (doc, start, end) don't settle with the others of their key.

    A window is settled if a span leaves no more than GAP words of it on either
    side.  Two windows meet if they agree, and share enough shingles around
    their minimum to hold a passage, some of them outside of ``spans``.  What an
    earlier window surely holds of one counts as known from then on, and such a
    meeting (``sure``) is enough for verification without a second hash
    function; of a cell's meetings those that add most come first, then, for
    what is left, all others that may hold a passage, as far as the shingles up
    to WIDE places from the minimum tell.  A key's windows meet in cells of two
    blocks each; the rows of a cell come in order.
    """
    rows = grouped.where("kind = 2").select("key", F.col("a").alias("doc"), "l", "r", "before", "behind")
    known = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    settled = F.exists("spans", lambda s: (s["start"] <= F.col("l") + GAP) & (s["end"] >= F.col("r") - GAP + SHINGLE_WORDS))
    flagged = rows.join(known, "doc", "left").withColumn("open", ~F.coalesce(settled, F.lit(False))).drop("spans").repartition("key")
    size = flagged.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("blocks"), F.max("open").alias("any")).where("any")
    signed = _signed(docs, flagged.join(size.drop("any"), "key"), known, id_col, text_col)
    # a row is at home in the cells (its block, any), and a guest, if it is open, in the cells (any, its block)
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    placed = signed.withColumn("block", F.pmod(F.xxhash64("doc", "l"), "blocks").cast("int"))
    home = F.transform(every, lambda k: F.struct(F.col("block").alias("i"), k.alias("j"), F.lit(True).alias("base"), (F.col("open") & (k == F.col("block"))).alias("guest")))
    visits = F.transform(F.filter(every, lambda k: F.col("open") & (k != F.col("block"))), lambda k: F.struct(k.alias("i"), F.col("block").alias("j"), F.lit(False).alias("base"), F.lit(True).alias("guest")))
    dealt = placed.withColumn("cell", F.explode(F.concat(home, visits))).select("key", "cell.i", "cell.j", "doc", "l", "r", "before", "behind", "near", "cell.base", "cell.guest")
    schema = "key long, a long, b long, al int, ar int, sure boolean"
    arrow = _arrow_schema(grouped.sparkSession, schema)

    def meet(part: pa.Table) -> pa.RecordBatch:
        key, i, j, doc, l, r = (part.column(k).to_numpy() for k in range(6))  # noqa: E741
        cell = np.cumsum(np.append(False, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        sides = np.stack([part.column(k).to_numpy() for k in (6, 7)], axis=1)
        near = np.frombuffer(b"".join(part.column(8).to_pylist()), np.uint16).reshape(len(key), -1).copy()
        base, guest = (part.column(k).to_numpy() for k in (9, 10))
        x, y, sure = _cell_meetings(cell, doc, r - l + 1, sides, near, base, guest, _held).T
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((key[x], doc[x], doc[y], l[x], r[x], sure.astype(bool)), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last cell may go on in the next batch
            cells = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            other = np.flatnonzero((cells != cells[-1]).any(axis=1))
            cut = int(other[-1]) + 1 if len(other) else 0
            if held and not cut and any(held[-1].column(k)[held[-1].num_rows - 1] != batch.column(k)[0] for k in range(3)):
                yield meet(pa.Table.from_batches(held))
                held = []
            if cut:
                yield meet(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield meet(pa.Table.from_batches(held))

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "doc", "l").mapInArrow(run, schema)


def _hits(order: np.ndarray, ranked: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which shingles of a text (``ranked``: sorted, ``order``: where each stands) stand in ``other``."""
    asked = distinct(other)
    low, high = (np.searchsorted(ranked, asked, side=side) for side in ("left", "right"))
    times = high - low
    return np.sort(order[np.repeat(low - np.cumsum(times) + times, times) + np.arange(int(times.sum()))])


def _places(own: np.ndarray, hit: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Where the shingles ``hit`` of ``own`` stand in ``other``; of several places that which goes on from its neighbour's."""
    order = np.argsort(other, kind="stable")
    ranked = other[order]
    low = np.searchsorted(ranked, own[hit])
    place = order[low]
    if not (ranked[1:] == ranked[:-1]).any():
        return place
    high = np.searchsorted(ranked, own[hit], side="right")
    many = np.flatnonzero(high - low > 1).tolist()
    for turn, step in ((many, -1), (reversed(many), 1)):
        for j in turn:
            if 0 <= j + step < len(hit):
                wanted = place[j + step] + hit[j] - hit[j + step]
                if step == 1 and abs(place[j] - wanted) <= GAP:
                    continue
                spots = order[low[j] : high[j]]
                k = int(np.searchsorted(spots, wanted))
                near = spots[max(k - 1, 0) : k + 1]
                place[j] = near[np.abs(near - wanted).argmin()]
    return place


def verified_spans(own: np.ndarray, others: list[np.ndarray], known: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Word spans [start, end) of ``own`` shingles' text that repeat a passage of one of ``others``.

    What lies within a span that is found or ``known`` already isn't looked at
    again, since it adds nothing to them all.
    """
    found: list[tuple[int, int]] = []
    width = LEAST_WORDS - SHINGLE_WORDS + 1
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    # how many shingles up to a place stand further ahead, too
    again = np.zeros(len(own) + 1, np.int64)
    again[order[1:] + 1] = ranked[1:] == ranked[:-1]
    again = np.cumsum(again)
    settled = np.zeros(len(own) + SHINGLE_WORDS, bool)
    for start, end in known:
        settled[start:end] = True
    for other in others:
        hit = _hits(order, ranked, other)
        edge = np.flatnonzero(np.diff(hit) > GAP) + 1
        first, last = np.append(0, edge), np.append(edge, len(hit))
        if not len(hit):
            continue
        wide = (last - first >= 2 * width // 3) & (hit[last - 1] - hit[first] + 1 >= width)
        stack = [(i, j) for i, j in zip(first[wide].tolist(), last[wide].tolist()) if not settled[hit[i] : hit[j - 1] + SHINGLE_WORDS].all()]
        if not stack:
            continue
        place = _places(own, hit, other)
        steps, jumps = np.diff(hit), np.abs(np.diff(place))
        while stack:
            i, j = stack.pop()
            if j - i < 2 * width // 3:
                continue
            start, end = int(hit[i]), int(hit[j - 1]) + 1
            if end - start < width or settled[start : end + SHINGLE_WORDS - 1].all():
                continue
            # no more shingles than the hits can be shared
            if j - i >= SIMILARITY * (end - start - int(again[end] - again[start])) and _alike(own[start:end], other, start, hit[i:j], place[i:j]):
                found.append((start, end + SHINGLE_WORDS - 1))
                settled[start : end + SHINGLE_WORDS - 1] = True
                continue
            # cut where the other text jumps, else take the longest passages that can be alike
            step, jump = steps[i : j - 1], jumps[i : j - 1]
            at = int(jump.argmax())
            if jump[at] <= GAP:
                plain = again[end] == again[start]
                for a, z in _longest(hit[i:j], place[i:j]):
                    start, end = int(hit[i + a]), int(hit[i + z]) + 1
                    if settled[start : end + SHINGLE_WORDS - 1].all():
                        continue
                    if _alike(own[start:end], other, start, hit[i + a : i + z + 1], place[i + a : i + z + 1]):
                        found.append((start, end + SHINGLE_WORDS - 1))
                        settled[start : end + SHINGLE_WORDS - 1] = True
                    else:
                        plain = False
                if plain:
                    continue
                # where shingles come again, what is told by counts needn't hold: cut where this text has most that is its own
                by_step = int(step.argmax())
                if max(step[by_step], jump[at]) <= 1:
                    continue
                at = by_step
            stack += [(i, i + at + 1), (i + at + 1, j)]
    found.sort()
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _longest(hits: np.ndarray, places: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of hits that bound passages of LEAST_WORDS which can be alike, none within another, the longest first.

    Of p shingles and q of the other text's, the c that are hit are enough if
    9 c >= 4 (p + q), as SIMILARITY asks; q is what the ends' places differ, or p.
    """
    turn, bounds = np.arange(len(hits)), []
    for value in (9 * turn - 4 * (hits + places), 9 * turn - 8 * hits):
        # the first hit from which a passage reaches each; the lowest only falls
        first = np.searchsorted(-np.minimum.accumulate(value), -(value + 1))
        last = np.flatnonzero(hits - hits[first] >= LEAST_WORDS - SHINGLE_WORDS)
        bounds.append(np.stack([first[last], last], axis=1))
    first, last = np.concatenate(bounds).T
    order = np.lexsort((-last, first))
    first, last = first[order], last[order]
    outer = last > np.maximum.accumulate(np.append(-1, last))[:-1]
    first, last = first[outer], last[outer]
    longest = np.argsort(hits[first] - hits[last], kind="stable")
    return list(zip(first[longest].tolist(), last[longest].tolist()))


def _alike(mine: np.ndarray, other: np.ndarray, start: int, hits: np.ndarray, places: np.ndarray) -> bool:
    """Whether the shingles of a passage and those of the other text's stretch that it meets are alike.

    The stretch is all that the passage meets, or (where some of its shingles
    also stand elsewhere) as long as the passage, at the most common shift.
    """
    a = distinct(mine)
    shifts = places - hits
    least = int(shifts.min())
    low = max(start + least + int(np.bincount(shifts - least).argmax()), 0)
    for x, y in dict.fromkeys([(int(places.min()), int(places.max()) + 1), (low, low + len(mine))]):
        if min(y, len(other)) - x < SIMILARITY * (LEAST_WORDS - SHINGLE_WORDS + 1):
            continue
        b = distinct(other[x:y])
        at = np.searchsorted(b, a)
        both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
        if both >= SIMILARITY * (len(a) + len(b) - both):
            return True
    return False


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    raw = text.encode()
    starts, _ = word_spans(raw)
    bounds = np.append(starts, len(raw))
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at : bounds[a]])
        at = int(bounds[b])
    return b"".join([*parts, raw[at:]]).decode()


def _enough(met: DataFrame) -> DataFrame:
    """(a, b, late, al, ar) of pairs of documents that meet under ENOUGH hash functions, or surely."""
    functions = F.bit_count(F.bit_or(F.expr("shiftleft(1, cast(key & 7 as int))")))
    return met.groupBy("a", "b").agg(functions.alias("n"), F.max("sure").alias("sure"), F.max("late").alias("late"), F.min("al").alias("al"), F.max("ar").alias("ar")).where((F.col("n") >= ENOUGH) | F.col("sure")).drop("n", "sure")


def _verified(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, known: DataFrame | None = None) -> DataFrame:
    """Spans (doc, start, end) of words of documents b that repeat a passage of the region al to ar of their document a.

    Those that lie within ``known`` (doc, start, end) may be left out.
    """
    # partners are listed in parts, so that no row grows with a group
    part_a, part_b = (F.floor((F.row_number().over(Window.partitionBy(x).orderBy(y)) - 1) / LISTED) for x, y in (("a", "b"), ("b", "a")))
    found = found.withColumn("pb", part_b).withColumn("pa", part_a).select("a", "b", "pa", "pb", "al", "ar")
    names = docs.columns
    text_at, mine, theirs = names.index(text_col), fresh(docs, "_a"), fresh(docs, "_b")
    asked = found.groupBy("a", "pa").agg(F.collect_list(F.struct("b", "pb", "al", "ar")).alias(fresh(docs, "_asked"))).drop("pa").withColumnRenamed("a", mine)
    excerpt_schema = _arrow_schema(docs.sparkSession, "b long, pb long, shingles binary")

    def excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.filter(pa.compute.and_(batch.column(len(names) + 1).is_valid(), batch.column(text_at).is_valid()))
            for block in blocks(asked, text_at, BLOCK):
                rows, size = [], 0
                h, counts = block_shingles(block.column(text_at).to_pylist())
                for start, count, listed in zip((np.cumsum(counts) - counts).tolist(), counts.tolist(), block.column(len(names) + 1)):
                    for w in listed.as_py():
                        rows.append((w["b"], w["pb"], short(h[start + w["al"] : start + min(w["ar"] + 1, count)]).tobytes()))
                        size += len(rows[-1][2])
                    if size > BLOCK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), excerpt_schema)], schema=excerpt_schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), excerpt_schema)], schema=excerpt_schema)

    # all joins take all columns from the left, so that they share one shuffle of the documents
    sent = docs.join(asked, docs[id_col] == asked[mine], "left").mapInArrow(excerpts, "b long, pb long, shingles binary")
    heard = sent.repartition("b").groupBy("b", "pb").agg(F.collect_list("shingles").alias(fresh(docs, "_heard"))).drop("pb").withColumnRenamed("b", theirs)
    knows = known is not None
    if knows:
        spans = known.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("_known"))
        heard = heard.join(spans, heard[theirs] == spans["doc"], "left").drop("doc")
    span_schema = _arrow_schema(docs.sparkSession, "doc long, start int, end int")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            batch = batch.filter(pa.compute.and_(batch.column(len(names) + 1).is_valid(), batch.column(text_at).is_valid()))
            for k, (text, doc, got) in enumerate(zip(batch.column(text_at), batch.column(len(names)), batch.column(len(names) + 1))):
                before = (batch.column(len(names) + 2)[k].as_py() or []) if knows else []
                # copies send the same; long excerpts settle most
                others = sorted(set(got.as_py()), key=lambda g: (-len(g), g))
                spans = verified_spans(short(document_shingles(text.as_py())), [np.frombuffer(g, np.uint32) for g in others], [(s["start"], s["end"]) for s in before])
                rows += [(doc.as_py(), a, b) for a, b in spans]
            columns = zip(*rows) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, span_schema)], schema=span_schema)

    return docs.join(heard, docs[id_col] == heard[theirs], "left").mapInArrow(verify, "doc long, start int, end int")


def mark_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "repeats") -> DataFrame:
    """``docs`` with a column ``out``: word spans (start, end) that repeat an earlier document's passage.

    A passage has at least LEAST_WORDS words; two are alike if the Jaccard
    similarity of their five-word shingles is at least SIMILARITY.  Only the
    earliest document by id keeps it.  Passages are judged on the input, not on
    what is left of it.  Null, empty and short texts and rows with a null id
    have no repeats; rows with an equal id don't repeat each other.  A column
    that is named ``out`` already is replaced.
    """
    docs = docs.drop(out)
    grouped = checkpointed(_grouped(_windows(docs, id_col, text_col)))
    equal = grouped.where("kind = 1").select(F.col("b").alias("doc"), F.col("l").alias("start"), (F.col("r") + SHINGLE_WORDS).alias("end"))
    near = grouped.where("kind = 0").select("key", "a", "b", F.col("l").alias("al"), F.col("r").alias("ar"), F.lit(False).alias("sure"), F.lit(False).alias("late"))
    early = _verified(docs, _enough(near).drop("late"), id_col, text_col).union(equal).distinct().repartition("doc")
    late = _across(docs, grouped, early, id_col, text_col).withColumn("late", F.lit(True))
    both = early.union(_verified(docs, _enough(near.union(late)).where("late").drop("late"), id_col, text_col, early)).repartition("doc")
    names = docs.columns
    text_at, theirs = names.index(text_col), fresh(docs, "_b")
    spans = both.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(fresh(docs, "_heard"))).withColumnRenamed("doc", theirs)
    joined = docs.join(spans, docs[id_col] == spans[theirs], "left")
    schema = extended(docs, f"`{out}` array<struct<start:int,end:int>>")
    arrow = _arrow_schema(docs.sparkSession, schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            got = batch.column(len(names) + 1)
            starts, ends = (got.flatten().field(k).to_pylist() for k in range(2))
            at = 0
            for valid, size in zip(batch.column(text_at).is_valid().to_pylist(), got.value_lengths().to_pylist()):
                runs: list[dict[str, int]] = []
                for a, b in zip(starts[at : at + (size or 0)], ends[at : at + (size or 0)]) if valid else []:
                    if runs and a <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], b)
                    else:
                        runs.append({"start": a, "end": b})
                rows.append(runs)
                at += size or 0
            columns = [batch.column(k) for k in range(len(names))] + [pa.array(rows, arrow.field(out).type)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return joined.mapInArrow(merge, schema)


def _rewritten(marked: DataFrame, text_col: str, spans_col: str) -> DataFrame:
    names = marked.columns
    text_at, spans_at = names.index(text_col), names.index(spans_col)
    arrow = _arrow_schema(marked.sparkSession, marked.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            spans = batch.column(spans_at).to_pylist()
            new = [_cut(t, [(s["start"], s["end"]) for s in x]) if x and t else t for t, x in zip(texts, spans)]
            columns = [batch.column(k) for k in range(len(names))]
            columns[text_at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return marked.mapInArrow(run, marked.schema)


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without repeated passages; every row and column stays."""
    spans = fresh(docs, "_passages")
    return _rewritten(mark_repeats(docs, id_col, text_col, spans), text_col, spans).drop(spans)


def op6_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of every document, and a digest of what is left of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = _rewritten(mark_repeats(docs), "text", "repeats")
    removed = F.aggregate("repeats", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", F.size("repeats").alias("n_spans"), removed.alias("n_removed_words"), "repeats", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
