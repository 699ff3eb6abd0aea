"""External induced sorting of suffixes, with common-prefix lengths.

Suffixes are sorted by their types: a suffix is of type S if it is smaller than
the one after it, else of type L; an S suffix after an L one begins a piece.
The pieces are sorted by induction and named, the string of names is sorted in
turn (pairs of names are renamed until the names tell apart all that lies
within the cap), and from the pieces in order the L and then the S suffixes
are induced.  What is induced waits in a priority queue: its keys are the
first characters, and since the sweep only ever adds at or behind its own
place, a queue is one first-in-first-out lane for each character.  A lane
holds tuples of a position and the length of the common prefix with the tuple
before it, and goes to disk when the lanes together grow beyond their room.

Common prefixes go through the induction as well: two suffixes that are induced
one after the other into a lane share one character more than the least common
prefix of the tuples swept between their causes.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples that the lanes of one queue keep in memory.
ROOM = 1 << 21
BATCH = 1 << 15


class Lanes:
    """A monotone priority queue of (position, prefix length), a lane for each first character."""

    def __init__(self, room: int = ROOM):
        self.room, self.held = room, 0
        self.memory: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(256)]
        self.spilled: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        self.file = None

    def push(self, lane: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.memory[lane].append((at, lcp))
        self.held += len(at)
        if self.held > self.room:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for lane, parts in enumerate(self.memory):
            if parts:
                at, lcp = (np.concatenate(p) for p in zip(*parts))
                self.spilled[lane].append((self.file.tell(), len(at)))
                self.file.write(at.astype(np.int64).tobytes())
                self.file.write(lcp.astype(np.uint8).tobytes())
                parts.clear()
        self.held = 0

    def drain(self, lane: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Tuples of a lane in order, also those that are pushed meanwhile."""
        while self.spilled[lane] or self.memory[lane]:
            if self.spilled[lane]:
                where, n = self.spilled[lane].pop(0)
                for k in range(0, n, BATCH):
                    m = min(BATCH, n - k)
                    self.file.seek(where + 8 * k)
                    at = np.frombuffer(self.file.read(8 * m), np.int64)
                    self.file.seek(where + 8 * n + k)
                    yield at, np.frombuffer(self.file.read(m), np.uint8)
            else:
                parts, self.memory[lane] = self.memory[lane], []
                self.held -= sum(len(p[0]) for p in parts)
                at, lcp = (np.concatenate(p) for p in zip(*parts))
                for k in range(0, len(at), BATCH):
                    yield at[k : k + BATCH], lcp[k : k + BATCH]

    def backwards(self, lane: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Tuples of a finished lane, last first; the lengths stay with the tuple that they were pushed with."""
        for at, lcp in reversed(self.memory[lane]):
            yield at[::-1], lcp[::-1]
        for where, n in reversed(self.spilled[lane]):
            for k in reversed(range(0, n, BATCH)):
                m = min(BATCH, n - k)
                self.file.seek(where + 8 * k)
                at = np.frombuffer(self.file.read(8 * m), np.int64)
                self.file.seek(where + 8 * n + k)
                yield at[::-1], np.frombuffer(self.file.read(m), np.uint8)[::-1]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Sweep:
    """Induces the suffixes one place to the left of those swept, of one type."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, cap: int, lanes: Lanes):
        self.text, self.wanted, self.cap, self.lanes = text, wanted, cap, lanes
        self.least = np.full(256, cap, np.uint8)  # least prefix since the last push into each lane
        self.used = np.zeros(256, bool)

    def __call__(self, at: np.ndarray, lcp: np.ndarray) -> None:
        before = at - 1
        causes = np.flatnonzero((at > 0) & self.wanted[before])
        if not len(causes):
            np.minimum(self.least, lcp.min(), out=self.least)
            return
        to = self.text[before[causes]]
        order = np.argsort(to, kind="stable")
        to, causes = to[order], causes[order]
        opens = np.append(True, to[1:] != to[:-1])
        start = np.append(0, causes[:-1] + 1)
        start[opens] = 0
        low = _range_least(lcp, start, causes)
        heads = np.flatnonzero(opens)
        lanes = to[heads]
        low[heads] = np.minimum(low[heads], self.least[lanes])
        new = np.minimum(low.astype(np.int64) + 1, self.cap).astype(np.uint8)
        new[heads[~self.used[lanes]]] = 0
        self.used[lanes] = True
        ends = np.append(heads[1:], len(to))
        after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], self.cap).astype(np.uint8)
        np.minimum(self.least, after[0], out=self.least)
        self.least[lanes] = after[causes[ends - 1] + 1]
        moved = before[causes]
        for lane, a, b in zip(lanes.tolist(), heads.tolist(), ends.tolist()):
            self.lanes.push(lane, moved[a:b], new[a:b])


def _range_least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of values[first..last] for each pair, by a sparse table."""
    table = [values]
    while 2 << len(table) - 1 <= len(values):
        step, below = 1 << len(table) - 1, table[-1]
        level = below.copy()
        np.minimum(below[: len(below) - step], below[step:], out=level[: len(below) - step])
        table.append(level)
    stacked = np.stack(table)
    size = last - first + 1
    k = np.log2(size).astype(np.int64)
    return np.minimum(stacked[k, first], stacked[k, last - (1 << k) + 1])


def types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S."""
    n = len(text)
    rises, falls = text[:-1] < text[1:], text[:-1] > text[1:]
    decided = np.where(rises | falls, np.arange(n - 1), n)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    out = np.ones(n, bool)
    inner = decided < n
    out[:-1][inner] = rises[decided[inner]]
    return out


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: np.ndarray | int) -> np.ndarray:
    """Length of the common prefix of each pair of suffixes, up to ``cap``."""
    n = len(text)
    cap = np.minimum(np.broadcast_to(cap, a.shape), n - np.maximum(a, b))
    padded = np.append(text, np.zeros(8, np.uint8))
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(cap > 0)
    span = np.arange(8)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        same = padded[x[:, None] + span] == padded[y[:, None] + span]
        run = np.where(same.all(axis=1), 8, same.argmin(axis=1))
        out[live] += run
        live = live[(run == 8) & (out[live] < cap[live])]
    return np.minimum(out, cap)


def _induce(text: np.ndarray, is_s: np.ndarray, pieces: np.ndarray, prefix: np.ndarray, cap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes but the last, largest first, each with its common prefix with the one before it."""
    lower, upper = Lanes(), Lanes()
    grow = Sweep(text, ~is_s, cap, lower)
    done = Lanes()
    bounds = np.searchsorted(text[pieces], np.arange(257))
    tops = np.full(256, -1, np.int64)  # the largest L suffix of each lane
    for lane in range(256):
        for at, lcp in lower.drain(lane):
            done.push(lane, at, lcp)
            tops[lane] = at[-1]
            grow(at, lcp)
        a, b = bounds[lane], bounds[lane + 1]
        if a < b:
            lcp = prefix[a:b].copy()
            lcp[0] = common_prefix(text, tops[lane : lane + 1], pieces[a : a + 1], cap)[0] if tops[lane] >= 0 else 0
            for k in range(a, b, BATCH):
                grow(pieces[k : min(b, k + BATCH)], lcp[k - a : k - a + BATCH])
    lower.close()
    shrink = Sweep(text, is_s, cap, upper)
    for lane in reversed(range(256)):
        bottom = -1  # the smallest S suffix of the lane
        for at, lcp in upper.drain(lane):
            bottom = int(at[-1])
            shrink(at, lcp)
            yield at, lcp
        held = common_prefix(text, tops[lane : lane + 1], np.array([bottom]), cap)[0] if bottom >= 0 and tops[lane] >= 0 else 0
        for at, lcp in done.backwards(lane):
            turned = np.append(held, lcp[:-1]).astype(np.uint8)
            held = lcp[-1]
            shrink(at, turned)
            yield at, turned
    upper.close()
    done.close()


def _sorted_pieces(text: np.ndarray, is_s: np.ndarray, cap: int) -> np.ndarray:
    """Places where pieces begin, in the order of their suffixes as far as ``cap`` characters tell."""
    begins = np.append(False, is_s[1:] & ~is_s[:-1])
    places = np.flatnonzero(begins)
    if len(places) < 2:
        return places
    # pieces in the order of their first characters induce the order of whole pieces
    rough = places[np.argsort(text[places], kind="stable")]
    found = [at[begins[at]] for at, _ in _induce(text, is_s, rough, np.zeros(len(rough), np.uint8), 1)]
    ranked = np.append(np.concatenate([places[-1:][:0], *found])[::-1], np.zeros(0, np.int64))
    ranked = np.concatenate([places[-1:], ranked[ranked != places[-1]]])
    number = np.empty(len(text), np.int64)
    number[places] = np.arange(len(places))
    size = np.append(np.diff(places) + 1, 1)
    own = number[ranked]
    x, y = ranked[:-1], ranked[1:]
    length = size[own[:-1]]
    same = length == size[own[1:]]
    same &= common_prefix(text, x, y, np.minimum(length, size[own[1:]])) == length
    name = np.empty(len(places), np.int64)
    name[own] = np.append(0, np.cumsum(~same))
    reach = 1
    # a piece has two characters at least, so names of ``cap`` characters lie within cap / 2 pieces
    while reach <= cap and name.max() + 1 < len(name):
        following = np.append(name[reach:] + 1, np.zeros(min(reach, len(name)), np.int64))[: len(name)]
        _, name = np.unique(name * (len(name) + 1) + following, return_inverse=True)
        reach *= 2
    return places[np.argsort(name, kind="stable")]


def equal_starts(text: np.ndarray, cap: int) -> Iterator[np.ndarray]:
    """Runs of places from which the next ``cap`` characters are the same.

    ``text`` ends in a 0.  Zeros separate texts: what runs into one matches
    nothing of interest, and callers leave such places out.
    """
    if len(text) < 2:
        return
    is_s = types(text)
    pieces = _sorted_pieces(text, is_s, cap)
    prefix = np.append(0, common_prefix(text, pieces[:-1], pieces[1:], cap)).astype(np.uint8)
    open_: list[np.ndarray] = []
    for at, lcp in _induce(text, is_s, pieces, prefix, cap):
        cuts = np.flatnonzero(lcp < cap)
        if not len(cuts):
            open_.append(at)
            continue
        run = np.concatenate([*open_, at[: cuts[0]]]) if open_ else at[: cuts[0]]
        if len(run) > 1:
            yield run
        sizes = np.diff(cuts)
        for k in np.flatnonzero(sizes > 1).tolist():
            yield at[cuts[k] : cuts[k + 1]]
        open_ = [at[cuts[-1] :]]
    if open_ and sum(map(len, open_)) > 1:
        yield np.concatenate(open_)
