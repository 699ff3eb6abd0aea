"""Word boundaries of the byte-level BPE split pattern, found with array steps.

The pattern takes, in this order: an English contraction, an optional blank
and letters, an optional blank and digits, an optional blank and other signs,
white space up to the last sign of a run before a word, white space.  Whether
a boundary stands before a character depends on at most four characters to the
left and one to the right, so all boundaries of a text come from a fixed number
of passes over its character classes.
"""

from __future__ import annotations

import functools

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Characters that a boundary can depend on, to the left and to the right.
REACH = 4
#: Stands between texts; no text can hold it.
END, END_CLASS = 0x110000, 4
#: Characters hashed at a time: the arrays stay in the processor's cache.
GROUP_CHARS = 1 << 17

# Code points with the property White_Space.
WHITE_SPACE = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004,
    0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point."""
    import regex

    kinds = np.zeros(0x110001, np.uint8)
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    every = "".join(map(chr, points))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        found = "".join(regex.findall(pattern + "+", every))
        kinds[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    kinds[WHITE_SPACE] = SPACE
    kinds[END] = END_CLASS
    return kinds


def cuts(text: str) -> np.ndarray:
    """Sorted character offsets of all boundaries, 0 and the length included."""
    if not text:
        return np.zeros(1, np.int64)
    return cuts_of(np.frombuffer(text.encode("utf-32-le"), np.uint32))


def cuts_of(points: np.ndarray) -> np.ndarray:
    """As ``cuts``, of code points; END stands between texts and is a word of its own."""
    n = len(points)
    kind = classes()[points]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    blank = kind == SPACE
    after = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    after = after[points[after] != END]  # at the end of a text the run stays whole
    edge[after - 1] = True  # the last sign of the run stands apart ...
    edge[after[points[after - 1] == 32]] = False  # ... and a blank joins the word
    quote = np.flatnonzero(points[:-1] == 39)
    quote = quote[edge[quote]]
    if len(quote):
        one = points[quote + 1]
        two = np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        edge[quote[short | long] + 1] = False
        edge[quote[short] + 2] = True
        edge[quote[long] + 3] = True
    ends = np.flatnonzero(kind == END_CLASS)
    edge[ends] = edge[ends + 1] = True
    return np.flatnonzero(edge)


def words(text: str) -> list[str]:
    at = cuts(text).tolist()
    return [text[a:b] for a, b in zip(at, at[1:])]


class Lexicon:
    """Distinct words of many texts, numbered as they come."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}

    def numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        """Numbers of the words of each text, in order."""
        out: list[np.ndarray] = []
        group, held = [], 0
        for text in texts:
            group.append(text or "")
            held += len(group[-1])
            if held >= GROUP_CHARS:
                out += self._group(group)
                group, held = [], 0
        return out + (self._group(group) if group else [])

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        joined = "\n".join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        points[np.cumsum([len(t) + 1 for t in texts]) - 1] = END
        at = cuts_of(points)
        start, size = at[:-1], np.diff(at)
        close = np.flatnonzero(points[start] == END)
        first, which = self._same(points, start, size)
        begin = start[first]
        number, new = self.number, []
        for a, b in zip(begin.tolist(), (begin + size[first]).tolist()):
            new.append(number.setdefault(joined[a:b], len(number)))
        every = np.array(new, np.int32)[which]
        return [every[a:b] for a, b in zip([0, *(close[:-1] + 1).tolist()], close.tolist())]

    @staticmethod
    def _same(points: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First of each group of equal words, and the group of each word.

        Words group by length and a hash; then every word is compared with its
        group's first, and if any differs the groups are made by exact keys.
        """
        n = len(points)
        power, inverse = powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((points + np.uint64(1)) * power[:n], out=total[1:])
        key = (total[start + size] - total[start]) * inverse[start]
        key ^= key >> np.uint64(29)
        key = key * np.uint64(0xBF58476D1CE4E5B9) + size.astype(np.uint64)
        order = np.argsort(key)
        sorted_key = key[order]
        opens = np.append(True, sorted_key[1:] != sorted_key[:-1])
        which = np.empty(len(key), np.int64)
        which[order] = np.cumsum(opens) - 1
        first = order[opens]
        if (size != size[first[which]]).any():
            return Lexicon._exact(points, start, size)
        shift = np.repeat(start[first[which]] - start, size)
        shift += np.arange(n)
        if (points[shift] != points).any():
            return Lexicon._exact(points, start, size)
        return first, which

    @staticmethod
    def _exact(points: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, known, first, which = points.tobytes(), {}, [], []
        for k, (a, n) in enumerate(zip((start * 4).tolist(), (size * 4).tolist())):
            group = known.setdefault(raw[a : a + n], len(known))
            if group == len(first):
                first.append(k)
            which.append(group)
        return np.array(first, np.int64), np.array(which, np.int64)


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    out = []
    for factor in (base, pow(base, -1, 1 << 64)):
        steps = np.full(size, factor, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64, ``n`` at least."""
    size = 1 << max(20, (n - 1).bit_length())
    if size > 1 << 20:
        return _powers.__wrapped__(size)
    return _powers(size)
