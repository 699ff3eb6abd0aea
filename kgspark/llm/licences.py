"""Licence scan: a generalised suffix automaton over the words of licence notices.

The automaton is built once from the notices (a parameter, small by nature)
and goes to the tasks.  A text is streamed through it, which gives for each word the
longest stretch up to it that stands in some notice, and the state for it.
Stretches that can't grow further and are long enough are anchors; anchors
that follow each other in a text and in a notice are chained, and a chain that
covers enough of the notice is a span of it.  Phrases are notices too: a place
of a phrase is where the stretch read last ends with it.

Null texts count as empty; empty texts have no places and spans; rows are
read one by one, so repeated rows and ties don't matter, and other columns
stay as they are.  Texts are read in blocks of about BLOCK bytes.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import extended, map_blocks, table

# --- fixed values: phrases whose places count, and public licence notices by SPDX name ---
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOTICES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 2.1"),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]

#: Words of an anchor at least (a notice of fewer words: all of it).
LONG = 3
#: Words between two anchors of a chain at most, in the text and in the notice.
GAP = 40
#: Share of a notice's words that a span covers at least.
COVER = 0.8
#: Bytes of a text read at a time.
BLOCK = 1 << 22

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
FOUND = "n_words long, places array<struct<label:string,first_word:long,n_words:int>>, spans array<struct<label:string,notice:int,first_word:long,last_word:long,covered:int,coverage:double>>"


def word_blocks(raw: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text, in lists that cover about ``size`` bytes each and cut no word."""
    at = 0
    while at < len(raw):
        end = min(at + size, len(raw))
        block = raw[at:end].lower()
        while end < len(raw) and WORD.match(block[-1:]):
            more = raw[end : end + size].lower()
            tail = WORD.match(more)
            inside = tail.end() if tail else 0
            block, end = block + more[:inside], end + inside
            if inside < len(more):
                break
        yield WORD.findall(block)
        at = end


class Automaton:
    """Suffix automaton of several word sequences.

    ``step`` has each state's transitions, ``link`` its longest proper suffix of
    another class, ``size`` its longest string, ``ends`` where that ends in
    which notice, ``phrases`` the phrases that end with it (words, number).
    """

    def __init__(self, notices: list[list[bytes]], phrases: list[list[bytes]]):
        self.number: dict[bytes, int] = {}
        self.step, self.link, self.size, self.ends = [{}], [-1], [0], [set()]
        for k, words in enumerate([*notices, *phrases]):
            last = 0
            for place, word in enumerate(words):
                last = self._extended(last, self.number.setdefault(word, len(self.number)))
                if k < len(notices):
                    self.ends[last].add((k, place + 1))
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        for state in reversed(order):
            self.ends[self.link[state]] |= self.ends[state]
        here: dict[int, list[tuple[int, int]]] = {}
        for n, words in enumerate(phrases):
            state = 0
            for word in words:
                state = self.step[state][self.number[word]]
            here.setdefault(state, []).append((len(words), n))
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.size]
        for state in order:
            self.phrases[state] = self.phrases[self.link[state]] + here.get(state, [])
        self.ends[0] = set()

    def _state(self, size: int, step: dict, link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.size.append(size)
        self.ends.append(set())
        return len(self.size) - 1

    def _split(self, above: int, word: int, below: int) -> int:
        """A state for the strings of ``below`` that fit behind ``above``."""
        copy = self._state(self.size[above] + 1, dict(self.step[below]), self.link[below])
        self.link[below] = copy
        while above >= 0 and self.step[above].get(word) == below:
            self.step[above][word] = copy
            above = self.link[above]
        return copy

    def _extended(self, last: int, word: int) -> int:
        known = self.step[last].get(word)
        if known is not None:  # another sequence has been here
            return known if self.size[known] == self.size[last] + 1 else self._split(last, word, known)
        new = self._state(self.size[last] + 1, {}, 0)
        above = last
        while above >= 0 and word not in self.step[above]:
            self.step[above][word] = new
            above = self.link[above]
        if above >= 0:
            below = self.step[above][word]
            self.link[new] = below if self.size[below] == self.size[above] + 1 else self._split(above, word, below)
        return new


class Scanner:
    """Streams texts through an automaton; ``least`` has the words of an anchor for each notice."""

    def __init__(self, notices: list[tuple[str, str]], phrases: dict[str, str], long: int = LONG, gap: int = GAP, cover: float = COVER):
        words = [WORD.findall(text.encode().lower()) for _, text in notices]
        self.labels, self.phrase_labels = [label for label, _ in notices], list(phrases.values())
        self.sizes, self.long, self.gap, self.cover = [len(w) for w in words], long, gap, cover
        self.net = Automaton(words, [WORD.findall(p.encode().lower()) for p in phrases])
        # no stretch of fewer words can matter
        self.shortest = min([long, *self.sizes, *(len(p.split()) for p in phrases)])

    def read(self, text: str | None, size: int = BLOCK) -> tuple[int, list[tuple], list[tuple]]:
        """Number of words, places (phrase, first word, words) and spans of the text."""
        net = self.net
        number, step, link, longest, phrases = net.number.get, net.step, net.link, net.size, net.phrases
        seen, state, length = 0, 0, 0
        places: list[tuple[int, int, int]] = []
        stretches: list[tuple[int, int, int]] = []
        for words in word_blocks((text or "").encode(), size):
            ids = np.fromiter(map(number, words, repeat(-1)), np.int32, len(words))
            for start, end in self._runs(ids):
                if start > 0 and length:
                    stretches.append((seen, length, state))
                    state = length = 0
                for k, word in enumerate(ids[start:end].tolist(), seen + start):
                    to = step[state].get(word)
                    if to is None:
                        stretches.append((k, length, state))
                        while to is None and state:
                            state = link[state]
                            to = step[state].get(word)
                        length = longest[state]
                    state, length = to, length + 1
                    for n, which in phrases[state]:
                        if n <= length:
                            places.append((which, k + 1 - n, n))
                if end < len(ids):
                    stretches.append((seen + end, length, state))
                    state = length = 0
            if len(ids) and ids[-1] < 0 and length:
                stretches.append((seen, length, state))
                state = length = 0
            seen += len(words)
        stretches.append((seen, length, state))
        return seen, places, self._spans(stretches)

    def _runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of words of the automaton that are long enough, or at an edge of the block and so perhaps longer."""
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        keep = (ends - starts >= self.shortest) | (starts == 0) | (ends == len(ids))
        yield from zip(starts[keep].tolist(), ends[keep].tolist())

    def _spans(self, stretches: list[tuple[int, int, int]]) -> list[tuple]:
        """(label, notice, first word, last word, covered words, share) of chains that cover enough."""
        anchors: dict[int, list[tuple[int, int, int]]] = {}
        for end, length, state in stretches:
            if length >= min(self.long, *self.sizes):
                for notice, at in self.net.ends[state]:
                    if length >= min(self.long, self.sizes[notice]):
                        anchors.setdefault(notice, []).append((end - length, at - length, length))
        out = [span for notice, own in anchors.items() for span in self._chains(notice, sorted(own))]
        return sorted(out, key=lambda s: (s[2], s[3], s[0], s[1]))

    def _chains(self, notice: int, own: list[tuple[int, int, int]]) -> Iterator[tuple]:
        """Best chains first; an anchor is in one span at most."""
        starts = [a[0] for a in own]
        reach = max(length for _, _, length in own) + self.gap
        best: list[tuple[int, int]] = []
        for j, (doc, at, length) in enumerate(own):
            top = (length, -1)
            for i in range(bisect_left(starts, doc - reach), j):
                doc_i, at_i, length_i = own[i]
                if doc_i < doc and at_i < at and doc - doc_i - length_i <= self.gap and at - at_i - length_i <= self.gap:
                    shared = max(0, doc_i + length_i - doc, at_i + length_i - at)
                    if shared < length and best[i][0] + length - shared > top[0]:
                        top = (best[i][0] + length - shared, i)
            best.append(top)
        used = [False] * len(own)
        for j in sorted(range(len(own)), key=lambda j: (-best[j][0], j)):
            covered = best[j][0]
            if covered < self.cover * self.sizes[notice]:
                break
            chain, k = [], j
            while k >= 0 and not used[k]:
                chain.append(k)
                k = best[k][1]
            if k >= 0:  # joins a span that has been given out
                continue
            for k in chain:
                used[k] = True
            yield self.labels[notice], notice, own[chain[-1]][0], own[j][0] + own[j][2] - 1, covered, covered / self.sizes[notice]


def scan(docs: DataFrame, text: str = "text", notices: list[tuple[str, str]] = NOTICES, phrases: dict[str, str] = PHRASES, long: int = LONG, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """``docs`` with n_words, the places of phrases and the spans of notices; words are counted from 0.

    An own column of one of these names is replaced.
    """
    scanner = Scanner(notices, phrases, long, gap, cover)
    others = [c for c in docs.columns if c.lower() not in ("n_words", "places", "spans") and c != text]
    held = docs.select(F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in others])
    schema = extended(held, FOUND)

    def step(block: pa.RecordBatch) -> dict:
        counts, places, spans = [], [], []
        for value in block.column(0).to_pylist():
            n, found, covered = scanner.read(value)
            counts.append(n)
            places.append([{"label": scanner.phrase_labels[p], "first_word": at, "n_words": size} for p, at, size in sorted(found, key=lambda f: (f[1], f[2], f[0]))])
            spans.append([dict(zip(("label", "notice", "first_word", "last_word", "covered", "coverage"), s)) for s in covered])
        own = dict(zip(block.schema.names, block.columns))
        return own | {"n_words": counts, "places": places, "spans": spans}

    return map_blocks(held, step, schema, text=0)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of documents: places of base phrases, labels of these and of the notices found.

    The score is the largest share of a notice that a span covers, and 1 where a
    base phrase stands.  Null and empty texts: no words, null places, empty
    labels, score 0.
    """
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.transform("places", lambda p: p["label"])
    starts = F.transform("places", lambda p: p["first_word"])
    ends = F.transform("spans", lambda s: s["coverage"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.transform("spans", lambda s: s["label"])))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(ends), F.lit(0.0))).alias("score"),
        "spans",
    )
