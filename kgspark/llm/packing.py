"""Best-fit packing of documents into sequences, improved by swaps.

Items are dealt at random into groups of bounded size.  In a group, each item
goes, longest first, to the fullest bin that holds it; then a local search
moves an item, exchanges one for one, or two for one between underfull bins
whenever that makes a fuller bin fuller still, so the sum of squared fills
rises until bins run empty.  A group loses at most a fraction of one bin to
the lack of other groups' items, whatever the size of the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_block, tokenizer_path
from .common import _arrow_schema, blocks, checkpointed, fresh, table
from .tokencount import VOCABULARY, CountTransducer, transducer

CAPACITY = 2048
#: Items of a group, on average.
GROUP_ITEMS = 8192
#: Text encoded at a time, in bytes.
ENCODE_BYTES = 2 << 20


def encode_with_special(texts: list[str | None], coder: CountTransducer) -> list[bytes]:
    """As ``encode_block``; special strings inside texts become their ids."""
    parts, spread = [], []
    for text in texts:
        pieces: list[str | int] = [text or ""]
        for mark, number in coder.special_ids.items():
            if any(isinstance(p, str) and mark in p for p in pieces):
                cut: list[str | int] = []
                for p in pieces:
                    if isinstance(p, int):
                        cut.append(p)
                        continue
                    for k, plain in enumerate(p.split(mark)):
                        cut += [number, plain] if k else [plain]
                pieces = cut
        spread.append(len(pieces))
        parts += pieces
    done = iter(encode_block([p for p in parts if isinstance(p, str)], coder))
    encoded = [next(done) if isinstance(p, str) else int(p).to_bytes(4, "little") for p in parts]
    out, at = [], 0
    for n in spread:
        out.append(encoded[at] if n == 1 else b"".join(encoded[at : at + n]))
        at += n
    return out


def token_pieces(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: (id, piece, start, length, ids_crc32[, ids]).

    A document is its ids and ``end_id``; null and empty texts have just that.
    Longer ones are cut so that only the first piece may be shorter.  Every
    input row gives its own pieces, also where ids are null or repeated.
    """
    path = tokenizer_path(VOCABULARY)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    arrow = _arrow_schema(df.sparkSession, schema)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, 1, ENCODE_BYTES):
                rows: list[tuple] = []
                owner: list[int] = []
                for k, ids in enumerate(encode_with_special(block.column(1).to_pylist(), transducer(path))):
                    ids += end
                    total = len(ids) // 4
                    bounds = [0, *range((total - 1) % capacity + 1, total + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        part = ids[4 * a : 4 * b]
                        rows.append((piece, a, b - a, zlib.crc32(part), part) if with_ids else (piece, a, b - a, zlib.crc32(part)))
                        owner.append(k)
                columns = [block.column(0).take(pa.array(owner, pa.int64()))]
                columns += [pa.array(c, f.type) for c, f in zip(zip(*rows), list(arrow)[1:])]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


class Bins:
    """Bins of one group; items are numbers, ``sizes`` their lengths."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.held: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin with room."""
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        rooms = 0  # bit r: some bin has room r
        for item in sorted(range(len(self.sizes)), key=lambda k: -self.sizes[k]):
            size = self.sizes[item]
            above = rooms >> size
            if above:
                room = size + (above & -above).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms ^= 1 << room
                self.held[b].append(item)
            else:
                room, b = self.capacity, len(self.held)
                self.held.append([item])
                self.fill.append(0)
            self.fill[b] += size
            left = room - size
            by_room[left].append(b)
            rooms |= 1 << left

    def improve(self) -> None:
        """Raise the sum of squared fills by exchanges between underfull bins, until none is left.

        The fullest bin that hasn't had its turn takes from the others that
        haven't, which are no fuller, as long as that fills it; so every step
        raises the sum and the search ends.  What bins hold is indexed by size: single items and pairs
        of one bin, each once for its sizes, with a set of the sizes that occur;
        the best exchange of a bin is found without going through the other
        bins, nor through its items of one size.
        """
        self.by_size: list[dict[int, list[int]]] = []
        for held in self.held:
            own: dict[int, list[int]] = {}
            for i in held:
                own.setdefault(self.sizes[i], []).append(i)
            self.by_size.append(own)
        while self._pass():
            pass
        kept = [b for b, own in enumerate(self.by_size) if own]
        self.held = [[i for items in self.by_size[b].values() for i in items] for b in kept]
        self.fill = [self.fill[b] for b in kept]

    def _pass(self) -> bool:
        loose = sorted((b for b in range(len(self.by_size)) if 0 < self.fill[b] < self.capacity), key=lambda b: -self.fill[b])
        self.open = set(loose)
        self.offers: tuple[dict[int, list[tuple[int, ...]]], ...] = ({}, {})
        self.offered = [0, 0]  # bit s: an item (a pair) of size s may be there
        self.turns = [(-self.fill[b], b) for b in loose]  # ascending, so it is a heap
        for b in loose:
            known: list[int] = []
            for size, items in self.by_size[b].items():
                self._offer(b, size, len(items), known)
                known.append(size)
        changed = False
        while self.turns:
            fill, b = heappop(self.turns)
            if b in self.open and -fill == self.fill[b]:
                self.open.discard(b)
                while self.by_size[b] and self._fuller(b):
                    changed = True
        return changed

    def _offer(self, b: int, size: int, count: int, others: Iterable[int]) -> None:
        """Index a size that is new in bin ``b``, and its pairs with other sizes there."""
        self._put(0, size, (b, size))
        for other in others:
            self._put(1, size + other, (b, size, other))
        if count > 1:
            self._put(1, 2 * size, (b, size, size))

    def _put(self, kind: int, size: int, entry: tuple[int, ...]) -> None:
        self.offers[kind].setdefault(size, []).append(entry)
        self.offered[kind] |= 1 << size

    def _stands(self, entry: tuple[int, ...]) -> bool:
        b, *sizes = entry
        own = self.by_size[b]
        return b in self.open and all(len(own.get(s, ())) >= sizes.count(s) for s in sizes)

    def _largest(self, kind: int, most: int) -> tuple[int, tuple[int, ...]] | None:
        """The largest single or pair of an open bin of a size up to ``most``; outdated entries go."""
        while at := self.offered[kind] & (1 << most + 1) - 1:
            size = at.bit_length() - 1
            entries = self.offers[kind][size]
            while entries:
                if self._stands(entries[-1]):
                    return size, entries[-1]
                entries.pop()
            self.offered[kind] ^= 1 << size
        return None

    def _fuller(self, b: int) -> bool:
        """The exchange that fills ``b`` most, at the cost of a bin no fuller: up to three items, two on a side at most."""
        room, own, best = self.capacity - self.fill[b], self.by_size[b], None
        if not room:
            return False
        sizes = list(own)
        give: list[tuple[int, tuple[int, ...]]] = [(0, ())] + [(s, (s,)) for s in sizes]
        give += [(s + t, (s, t)) for x, s in enumerate(sizes) for t in sizes[:x]] + [(2 * s, (s, s)) for s in sizes if len(own[s]) > 1]
        for given, mine in give:
            for kind in (0, 1) if len(mine) < 2 else (0,):
                found = self._largest(kind, room + given)
                if found and found[0] > given and (best is None or found[0] - given > best[0]):
                    best = found[0] - given, found[1], mine
            if best is not None and best[0] == room:
                break
        if best is None:
            return False
        gain, (c, *taken), mine = best
        assert gain > 0 and self.fill[b] >= self.fill[c]
        # out of both first: a size may go either way
        items, back = [self._out(c, s) for s in taken], [self._out(b, s) for s in mine]
        for i in items:
            own.setdefault(self.sizes[i], []).append(i)
        for i in back:
            self._into(c, i)
        self.fill[b] += gain
        self.fill[c] -= gain
        if self.fill[c]:
            heappush(self.turns, (-self.fill[c], c))
        return True

    def _out(self, b: int, size: int) -> int:
        items = self.by_size[b][size]
        item = items.pop()
        if not items:
            del self.by_size[b][size]
        return item

    def _into(self, b: int, item: int) -> None:
        """Put an item into an open bin; what its size makes possible anew is offered."""
        size, own = self.sizes[item], self.by_size[b]
        items = own.setdefault(size, [])
        items.append(item)
        if len(items) == 1:
            self._offer(b, size, 1, [s for s in own if s != size])
        elif len(items) == 2:
            self._put(1, 2 * size, (b, size, size))


def pack(items: DataFrame, length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to items of a length of at most ``capacity``.

    Offsets in a sequence run without gaps from 0.  Rows with a null length
    get nulls; longer items raise.  Items that are equal stay separate.  Columns
    that have the two names already are replaced.
    """
    items = items.drop("sequence_id", "offset")
    row = fresh(items, "_row")
    numbered = checkpointed(items.withColumn(row, F.monotonically_increasing_id()))
    groups = max(1, -(-numbered.count() // GROUP_ITEMS))
    dealt = numbered.where(F.col(length_col).isNotNull()).select(
        F.col(row).alias("row"), F.col(length_col).cast("long").alias("length"), F.pmod(F.xxhash64(row), F.lit(groups)).alias("group")
    )

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        sizes = rows["length"].tolist()
        if max(sizes) > capacity:
            raise ValueError("an item is longer than a sequence")
        bins = Bins(sizes, capacity)
        bins.best_fit()
        bins.improve()
        sequence, offset = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        for b, held in enumerate(bins.held):
            at = 0
            for item in sorted(held):
                sequence[item], offset[item] = key[0] << 32 | b, at
                at += sizes[item]
        return pd.DataFrame({row: rows["row"].to_numpy(), "sequence_id": sequence, "offset": offset})

    # as many partitions as groups: they must not be put together in a few tasks
    placed = dealt.repartition(groups, "group").groupBy("group").applyInPandas(place, f"{row} long, sequence_id long, offset long")
    return numbered.join(placed, row, "left").drop(row)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(table(spark, sf_dir, "documents")))
