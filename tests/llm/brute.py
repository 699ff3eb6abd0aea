"""Plain versions of the training-data operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash


class Union:
    """Union-find whose roots are the smallest members."""

    def __init__(self, nodes=()):
        self.up = {n: n for n in nodes}

    def root(self, n):
        self.up.setdefault(n, n)
        while self.up[n] != n:
            n = self.up[n]
        return n

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def simhash(text: str | None) -> int:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    marks = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in marks) > len(marks))


def simhash_groups(texts: dict[int, str | None], distance: int = 2) -> dict[int, tuple[str, int]]:
    marks = {i: simhash(t) for i, t in texts.items()}
    ids = sorted(marks)
    groups = Union(ids)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (marks[a] ^ marks[b]).bit_count() <= distance:
                groups.join(a, b)
    return {i: (f"{marks[i]:016x}", groups.root(i)) for i in ids}


def substring_removal(texts: dict[int, str | None], window: int = 100) -> dict[int, tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    seen: set[bytes] = set()
    out = {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = np.zeros(len(raw) + 1, np.int8)
        for k in range(len(raw) - window + 1):
            part = hashlib.blake2b(raw[k : k + window], digest_size=16).digest()
            if part in seen:
                gone[k : k + window] = 1
            seen.add(part)
        spans = int((np.diff(np.append(0, gone)) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = len(raw), int(gone.sum()), spans, sha(kept)
    return out


def line_groups(rows: list[tuple[int, str | None]], size: int, least: float) -> dict[tuple[int, int], tuple[int, int]]:
    """First place of the component of each line that isn't blank."""
    place = {}
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            if text is not None and line.strip(" \t\r\f\x0b"):
                place[i, k] = line
    first: dict[str, tuple[int, int]] = {}
    for at in sorted(place):
        first.setdefault(place[at], at)
    sets = {line: frozenset(line[k : k + size] for k in range(max(1, len(line) - size + 1))) for line in first}
    posted = defaultdict(list)
    groups = Union(first.values())
    for line, marks in sets.items():
        shared: dict[str, int] = defaultdict(int)
        for m in marks:
            for other in posted[m]:
                shared[other] += 1
            posted[m].append(line)
        for other, both in shared.items():
            if both >= least * (len(marks) + len(sets[other]) - both):
                groups.join(first[line], first[other])
    return {at: groups.root(first[line]) for at, line in place.items()}


def vector_groups(rows: dict[int, list | None], cosine: float = 0.9) -> dict[int, tuple[int, int, bool]]:
    valid = {}
    for i, v in rows.items():
        if v and None not in v and np.isfinite(v).all() and any(v):
            x = np.array(v, np.float64)
            valid[i] = x / np.sqrt((x * x).sum())
    groups, links = Union(rows), dict.fromkeys(rows, 0)
    ids = sorted(valid)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(valid[a]) == len(valid[b]) and float(valid[a] @ valid[b]) >= cosine:
                groups.join(a, b)
                links[a] += 1
                links[b] += 1
    return {i: (links[i], groups.root(i), groups.root(i) == i) for i in rows}


def word_list(text: str | None) -> list[str]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x20\x09-\x0d]+", low)


def repeated_words(texts: dict[int, str | None], least: int = 50) -> dict[int, np.ndarray]:
    """Which words of each document lie in a run of ``least`` that also stands in an earlier document."""
    seen: dict[tuple, int] = {}
    out = {}
    for i in sorted(texts):
        words = word_list(texts[i])
        mark = np.zeros(len(words), bool)
        runs = [hash(tuple(words[k : k + least])) for k in range(len(words) - least + 1)]
        for k, run in enumerate(runs):
            if run in seen:
                mark[k : k + least] = True
        for run in runs:
            seen.setdefault(run, i)
        out[i] = mark
    return out
