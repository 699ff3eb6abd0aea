"""Token counts by compiled finite-state transducers.

Counting runs on two deterministic transducers.  The first reads classes of
characters and marks the ends of words.  The second reads the bytes of a word;
each of its transitions carries the number of tokens that the byte adds, which
may be negative, since a byte can close a longer token.  Its states are
compiled when a word first needs them: a state knows the last token of the
encoding of the bytes so far, and that is enough to find the last token after
one byte more, so no encoding is ever replayed.

A text is read in chunks.  A chunk's state map says what it does to whatever
state precedes it: read ``head`` from that state, add ``count``, leave off in
the state after ``tail``.  Maps compose associatively, so a parallel prefix
scan over the chunks of a text gives the count at each chunk's end.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pretokens
from .bpe import tokenizer_path
from .common import map_blocks, table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Characters of a chunk.
CHUNK = 1 << 16
#: Bytes of a word up to which words are read side by side; longer ones are few and read one by one.
SIDE_BY_SIDE = 256
#: Token before a word's first, and the rank of a pair that no merge takes.
START, NEVER = 1 << 19, 1 << 30


def _byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class CountTransducer:
    """Reads bytes of words, emits token counts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        sign = _byte_signs()
        self.special_ids = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        self.special = sorted(self.special_ids, key=len, reverse=True)
        special = set(self.special)
        self.tokens = {bytes(sign[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in spec["model"]["merges"]]
        merged = [tuple(bytes(sign[c] for c in part) for part in pair) for pair in merges]
        size = max(self.tokens.values()) + 1
        #: When a token comes to be, and the two that it is made of (itself: a byte).
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        keys = np.empty(len(merged), np.int64)
        for rank, (a, b) in enumerate(merged):
            left, right, token = self.tokens[a], self.tokens[b], self.tokens[a + b]
            keys[rank] = left << 32 | right
            if self.rank[token] < 0:
                self.rank[token], self.left[token], self.right[token] = rank, left, right
        self.pair_rank = np.argsort(keys)
        self.pair_key = np.append(keys[self.pair_rank], np.int64(-1))
        self.pair_rank = np.append(self.pair_rank, -1)
        # a trie of all tokens: edges by node and byte
        step: dict[int, int] = {}
        name = [-1]
        for token, number in self.tokens.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = step.setdefault(key, len(name))
                if node == len(name):
                    name.append(-1)
            name[node] = number
        edges = np.array(sorted(step), np.int64)
        self.child = np.append(np.array([step[k] for k in edges.tolist()], np.int64), -1)
        self.edge = np.append(edges, np.int64(-1))
        self.name = np.array(name, np.int64)
        self.whole = np.zeros(size, bool)
        known = np.array(list(self.tokens.values()))
        split = self.rank[known] >= 0
        self.whole[known] = ~split
        made = known[split]
        for token in made[np.argsort(self.rank[made])].tolist():
            a, b = self.left[token], self.right[token]
            self.whole[token] = self.whole[a] and self.whole[b]
        inner = self.apart(self.left[made], self.right[made], self.rank[made])
        self.whole[made] &= inner
        # the trie and known transitions for words that are read alone
        self.step: dict[int, int] | None = None
        self.token_at: list[int] = []
        self.fits: dict[int, bool] = {}

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node << 8 | byte
        at = np.searchsorted(self.edge[:-1], key)
        return np.where(self.edge[at] == key, self.child[at], -1)

    def apart(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge before time ``until`` joins tokens that stand side by side.

        Seen backwards in time, the right edge of ``a`` and the left edge of
        ``b`` fall into the parts they were made of.  The two stay apart if no
        merge takes such a pair of edges while both are there.
        """
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), NEVER) if until is None else until.copy()
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x << 32 | y
            at = np.searchsorted(self.pair_key[:-1], key)
            rank = np.where(self.pair_key[at] == key, self.pair_rank[at], NEVER)
            met = rank < limit[live]
            out[live[met]] = False
            rx, ry = self.rank[x], self.rank[y]
            stay = ~met & ((rx >= 0) | (ry >= 0))
            older = rx > ry  # the left one was made last, else the right one
            new = live[stay]
            x, y, rx, ry, older = x[stay], y[stay], rx[stay], ry[stay], older[stay]
            # of merges of one rank the left one comes first
            limit[new] = np.where(older, rx, ry + 1)
            a[new] = np.where(older, self.right[x], x)
            b[new] = np.where(older, y, self.left[y])
            live = new
        return out

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word: the sum of what its transitions emit.

        The words are read side by side, a byte at a time.  A state stands for
        all words that began alike; it and its transition are compiled when
        they are first reached.  ``own, start, node`` list for each state the
        tokens that may end later: where they began and their place in the trie.
        """
        return self._read([w.encode() for w in words])[0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and where each word starts (with the end).

        From its last state, a word's tokens follow backwards from state to state.
        """
        counts, state, last, start = self._read(words)
        begin = np.zeros(len(words) + 1, np.int64)
        np.cumsum(counts, out=begin[1:])
        ids = np.empty(int(begin[-1]), np.int32)
        place = begin[1:] - 1
        live = np.flatnonzero(counts)
        state, place = state[live], place[live]
        while len(state):
            ids[place] = last[state]
            state, place = start[state], place - 1
            more = state > 0
            state, place = state[more], place[more]
        return ids, begin

    def _read(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(count of each word, its last state; last token of each state, state before that token)."""
        long = [k for k, w in enumerate(raw) if len(w) > SIDE_BY_SIDE]
        whole_raw = raw
        raw = [b"" if len(w) > SIDE_BY_SIDE else w for w in raw] if long else raw
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        out = np.zeros(len(raw), np.int64)
        final, finals = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        order = np.argsort(-sizes, kind="stable")
        spot = np.append(0, np.cumsum(sizes))[:-1][order]
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        longest = int(sizes.max(initial=0))
        active = len(raw) - np.searchsorted(np.sort(sizes), np.arange(1, longest + 1))
        state, first = np.zeros(len(raw), np.int64), 0  # of each word; number of the level's first state
        level_total = np.zeros(1, np.int64)
        own = start = node = np.zeros(0, np.int64)
        every_total, every_last, every_start = Grown(level_total), Grown(np.array([START])), Grown(np.zeros(1, np.int64))
        emitted = np.zeros(len(raw), np.int64)
        for depth in range(longest):
            n = int(active[depth])
            key, of = np.unique(state[:n] << 8 | data[spot[:n] + depth], return_inverse=True)
            parent, byte = key >> 8, key & 255
            new = len(key)
            # tokens under way: those of the parent, and one that begins here
            fan = np.bincount(own, minlength=len(level_total)) if len(own) else np.zeros(len(level_total), np.int64)
            begin = np.append(0, np.cumsum(fan))[:-1]
            many = fan[parent] + 1
            ends = np.cumsum(many)
            own2 = np.repeat(np.arange(new), many)
            place = np.arange(int(ends[-1])) - np.repeat(ends - many, many)
            fresh = ends - 1
            source = begin[parent][own2] + place
            source[fresh] = 0
            if not len(own):
                own, start, node = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
            start, node = start[source], node[source]
            start[fresh] = first + parent
            node[fresh] = 0
            node = self._step(node, byte[own2])
            alive = node >= 0
            own, start, node = own2[alive], start[alive], node[alive]
            token = self.name[node]
            ending = np.flatnonzero(token >= 0)
            before, last_token = every_last.held[start[ending]], token[ending]
            pairs, back = np.unique(before << 32 | last_token, return_inverse=True)
            x, y = pairs >> 32, pairs & 0xFFFFFFFF
            fits = self.whole[y]
            inside = np.flatnonzero(fits & (x != START))
            fits[inside] = self.apart(x[inside], y[inside])
            good = ending[fits[back]]
            found, at = np.unique(own[good], return_index=True)
            assert len(found) == new, "a state has no last token"
            chosen = good[at]
            new_total = every_total.held[start[chosen]] + 1
            emit = new_total - level_total[parent]
            first += len(level_total)
            level_total = new_total
            every_total.add(new_total)
            every_last.add(token[chosen])
            every_start.add(start[chosen])
            state[:n] = of
            final[:n] = first + of
            emitted[:n] += emit[of]
        out[order] = emitted
        finals[order] = final
        for k in long:
            out[k], last, start = self._read_one(whole_raw[k], every_last.size)
            every_last.add(last)
            every_start.add(start)
            finals[k] = every_last.size - 1
        return out, finals, every_last.held, every_start.held

    def _read_one(self, word: bytes, base: int) -> tuple[int, np.ndarray, np.ndarray]:
        """As ``_read``, of one word whose first state gets number ``base``; what a transition gives is kept for later ones."""
        if self.step is None:
            self.step = dict(zip(self.edge[:-1].tolist(), self.child[:-1].tolist()))
            self.token_at = self.name.tolist()
        step, token_at, fits = self.step, self.token_at, self.fits
        last, total, start = [START], [0], [0]
        under_way: list[tuple[int, int]] = []
        for at, byte in enumerate(word):
            under_way.append((at, 0))
            going, chosen = [], None
            for begun, node in under_way:
                node = step.get(node << 8 | byte)
                if node is None:
                    continue
                going.append((begun, node))
                token = token_at[node]
                if token < 0 or chosen is not None:
                    continue
                key = last[begun] << 32 | token
                good = fits.get(key)
                if good is None:
                    if len(fits) > 1 << 20:
                        fits.clear()
                    good = bool(self.whole[token]) and (not begun or bool(self.apart(np.array([last[begun]]), np.array([token]))[0]))
                    fits[key] = good
                if good:
                    chosen = begun, token
            assert chosen is not None, "a state has no last token"
            under_way = going
            last.append(chosen[1])
            total.append(total[chosen[0]] + 1)
            start.append(base + chosen[0] - 1 if chosen[0] else 0)
        return total[-1], np.array(last[1:]), np.array(start[1:])


class Grown:
    """An array that grows by doubling."""

    def __init__(self, values: np.ndarray):
        self.size, self.room = len(values), values.copy()

    @property
    def held(self) -> np.ndarray:
        return self.room[: self.size]

    def add(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.room):
            room = np.empty(max(end, 2 * len(self.room)), self.room.dtype)
            room[: self.size] = self.held
            self.room = room
        self.room[self.size : end] = values
        self.size = end


@functools.cache
def transducer(path: str) -> CountTransducer:
    return CountTransducer(path)


class StateMap(NamedTuple):
    """What a chunk does to the state before it.

    ``head`` is read from that state; if ``closed`` (a word ends in the chunk),
    ``count`` tokens follow and ``tail`` is read from the start state.
    """

    head: str
    closed: bool
    count: int
    tail: str


def compose(a: StateMap, b: StateMap, count: Callable[[str], int]) -> StateMap:
    """First ``a``, then ``b``; ``count`` gives the tokens of a finished word."""
    if not a.closed:
        return StateMap(a.head + b.head, b.closed, b.count, b.tail)
    if not b.closed:
        return StateMap(a.head, True, a.count, a.tail + b.head)
    return StateMap(a.head, True, a.count + count(a.tail + b.head) + b.count, b.tail)


def prefix_scan(maps: list[StateMap], count: Callable[[str], int]) -> list[StateMap]:
    """All compositions of the first 1, 2, ... maps, by doubling distances."""
    out, reach = list(maps), 1
    while reach < len(out):
        out = [compose(out[k - reach], out[k], count) if k >= reach else out[k] for k in range(len(out))]
        reach *= 2
    return out


def count_block(texts: list[str | None], coder: CountTransducer) -> list[int]:
    """Tokens of each text."""
    plain, spread, extra = [], [], []
    for text in texts:
        pieces, found = [text or ""], 0
        for mark in coder.special:
            cut = [p for piece in pieces for p in piece.split(mark)]
            found += len(cut) - len(pieces)
            pieces = cut
        spread.append(len(pieces))
        extra.append(found)
        plain += pieces
    short = [k for k, p in enumerate(plain) if len(p) <= CHUNK]
    lexicon = pretokens.Lexicon()
    numbered = lexicon.numbers([plain[k] for k in short])
    sizes = coder.counts(list(lexicon.number))
    sums = [0] * len(plain)
    for k, words in zip(short, numbered):
        sums[k] = int(sizes[words].sum())
    for k, piece in enumerate(plain):
        if len(piece) > CHUNK:
            sums[k] = count_long(piece, coder)
    out, at = [], 0
    for n, more in zip(spread, extra):
        out.append(sum(sums[at : at + n]) + more)
        at += n
    return out


def count_long(text: str, coder: CountTransducer) -> int:
    """Tokens of a text of many chunks, by their state maps."""

    def one(word: str) -> int:
        return int(coder.counts([word])[0]) if word else 0

    maps = []
    for a in range(0, len(text), CHUNK):
        b = min(len(text), a + CHUNK)
        low, high = max(0, a - pretokens.REACH), min(len(text), b + pretokens.REACH)
        edges = pretokens.cuts(text[low:high]) + low
        # what the excerpt's own ends add is no boundary of the text
        edges = edges[(edges >= a) & (edges < b) & ((edges > low) | (low == 0))].tolist()
        if not edges:
            maps.append(StateMap(text[a:b], False, 0, ""))
            continue
        number: dict[str, int] = {}
        which = [number.setdefault(text[x:y], len(number)) for x, y in zip(edges, edges[1:])]
        inner = int(coder.counts(list(number))[which].sum()) if which else 0
        maps.append(StateMap(text[a : edges[0]], True, inner, text[edges[-1] : b]))
    whole = prefix_scan(maps, one)[-1]
    return one(whole.head) + whole.count + one(whole.tail)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each text.

    Special strings inside a text count as one token each; none are added.
    Null and empty texts have no tokens.  Each input row, ids null or repeated
    too, gives one row; other columns are left behind.
    """
    path = path or tokenizer_path(VOCABULARY)

    def step(block: pa.RecordBatch) -> dict[str, list]:
        return {"id": block.column(0), "n_tokens": count_block(block.column(1).to_pylist(), transducer(path)), "n_bytes": _bytes(block.column(1))}

    kind = df.schema[id_col].dataType.simpleString()
    out = map_blocks(df.select(id_col, text_col), step, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _bytes(column: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()).to_pylist()


def op2_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
