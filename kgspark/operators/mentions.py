"""Dictionary scan: names of several words and abbreviations in sentences, with their overlaps resolved."""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.slices import slices as parts

# --- fixed values: confidence of a mention by the kind of its name; what may follow a side ---
CONFIDENCE = {"canonical": 0.95, "alias_en": 0.85, "alias_cn": 0.80, "alias_abbr": 0.60}
SIDES = ("left", "right")
SIDE_ENDINGS = "(hemisphere|sided|side)?"

LEAST_LETTERS, ABBREVIATION = 2, 3
#: Characters before and behind a mention that are searched for a side.
NEAR = 30
#: Letters of a lexicon that every task may hold; larger ones are dealt in slices.
LEXICON_LETTERS = 4_000_000
#: Sentences that one slice is matched with at a time.
BLOCK_ROWS = 20_000


def region_lexicon(names: DataFrame) -> DataFrame:
    """(term, region_id, kind, confidence, cased) of names (region_id, term, kind).

    Terms of fewer than two letters go.  An alias of two or three ASCII letters
    is an abbreviation whatever it was called.  A region has each term once, with
    its best kind.  ``cased`` terms are matched as written and as whole words:
    short ones, and those that are some region's abbreviation.  Null terms go.
    """
    term = F.trim("term")
    short = term.rlike(f"^[A-Za-z]{{{LEAST_LETTERS},{ABBREVIATION}}}$")
    kind = F.when(short & (F.col("kind") != "canonical"), "alias_abbr").otherwise(F.col("kind"))
    score = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    rows = names.select(term.alias("term"), "region_id", kind.alias("kind"), short.alias("short")).where(F.length("term") >= LEAST_LETTERS)
    best = rows.withColumn("confidence", F.element_at(score, F.col("kind"))).groupBy("term", "region_id").agg(F.max_by("kind", "confidence").alias("kind"), F.max("confidence").alias("confidence"), F.max("short").alias("short"))
    cased = F.max(F.col("short") | (F.col("kind") == "alias_abbr")).over(W.partitionBy("term"))
    return best.withColumn("cased", cased).drop("short")


def _needles(lexicon: DataFrame) -> DataFrame:
    """What is looked for, each with the entry that wins where several regions share it."""
    needle = F.when(F.col("cased"), F.col("term")).otherwise(F.lower("term"))
    entry = F.struct((-F.col("confidence")).alias("order"), "region_id", "kind", "confidence", F.lower("term").alias("term"))
    best = lexicon.withColumn("needle", needle).groupBy("needle", "cased").agg(F.min(entry).alias("e"))
    return best.select("needle", "cased", "e.term", "e.region_id", "e.kind", "e.confidence")


_LETTERS = frozenset(string.ascii_letters + string.digits)
_WORD = re.compile("[A-Za-z0-9]+")


class _Terms:
    """Entries (size, term, region_id, kind, confidence) of hits, numbered in the order in which they win at one place."""

    def __init__(self, entries: Iterable[tuple]):
        known = lambda x: (x is not None, x)
        surer = lambda e: (e[4] is not None, -(e[4] or 0.0))
        self.entries = sorted(set(entries), key=lambda e: (-e[0], surer(e), known(e[2]), known(e[1]), known(e[3])))
        self.number = {e: k for k, e in enumerate(self.entries)}
        self.sizes = [e[0] for e in self.entries]
        self.regions = [e[2] for e in self.entries]
        self.surer = [surer(e) for e in self.entries]

    def disjoint(self, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The hits (pos, number) that stay: from left to right, where two overlap the longer, of equal ones the surer.

        A hit that overlaps the last one that stays takes its place if it is longer.
        """
        kept, end, size = [], 0, 0
        for hit in sorted(hits):
            n = self.sizes[hit[1]]
            if hit[0] >= end:
                kept.append(hit)
            elif n > size:
                kept[-1] = hit
            else:
                continue
            end, size = hit[0] + n, n
        return kept

    def surest(self, kept: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Of each region the surest hit, of equal ones the first."""
        best: dict = {}
        for hit in kept:
            region = self.regions[hit[1]]
            if region not in best or self.surer[hit[1]] < self.surer[best[region][1]]:
                best[region] = hit
        return list(best.values())


class _Scan:
    """All places of needles in a sentence: those as written that are one word by a table, others by an automaton, which those for lower case have, too."""

    def __init__(self, rows: list[tuple]):
        import ahocorasick

        self.terms = _Terms((len(needle), *entry) for needle, _, *entry in rows)
        self.nets, self.words = [], {}
        for needle, cased, *entry in rows:
            if cased and _WORD.fullmatch(needle):
                self.words[needle] = self.terms.number[len(needle), *entry]
        for wanted in (True, False):
            net = ahocorasick.Automaton()
            for needle, cased, *entry in rows:
                if bool(cased) == wanted and not (cased and needle in self.words):
                    net.add_word(needle, (len(needle), self.terms.number[len(needle), *entry]))
            if len(net):
                net.make_automaton()
                self.nets.append((wanted, net))

    def places(self, sentence: str | None) -> list[tuple[int, int]]:
        """(pos, number of its entry) of each hit."""
        out = []
        if self.words and sentence:
            out = [(w.start(), self.words[w[0]]) for w in _WORD.finditer(sentence) if w[0] in self.words]
        for cased, net in self.nets if sentence else []:
            text = sentence if cased else sentence.lower()
            if cased:
                for last, (size, k) in net.iter(text):
                    start = last + 1 - size
                    if text[last + 1 : last + 2] not in _LETTERS and not (start and text[start - 1] in _LETTERS):
                        out.append((start, k))
            else:
                out += [(last + 1 - size, k) for last, (size, k) in net.iter(text)]
        return out

    def hits(self, sentence: str | None) -> list[dict]:
        out = []
        for pos, k in self.places(sentence):
            size, term, region, kind, confidence = self.terms.entries[k]
            out.append({"pos": pos, "end": pos + size, "term": term, "region_id": region, "kind": kind, "confidence": confidence})
        return out


def _hit_type(needles: DataFrame) -> StructType:
    kinds = {f.name: f.dataType for f in needles.schema}
    place = [StructField("pos", IntegerType()), StructField("end", IntegerType()), StructField("term", StringType())]
    return StructType([*place, StructField("region_id", kinds["region_id"]), StructField("kind", StringType()), StructField("confidence", DoubleType())])


def raw_hits(sentences: DataFrame, lexicon: DataFrame, keys: list[str], letters: int = LEXICON_LETTERS, *, kept: str | None = None) -> DataFrame:
    """``sentences`` (keys, sentence) with all places of terms, overlapping ones too, as an array ``hits``.

    A lexicon of at most ``letters`` characters goes to every task, and nothing
    is shuffled.  A larger one is dealt in slices of that size, each of which
    meets all sentences in blocks; the hits of a sentence then come together.
    With ``kept`` ("disjoint", or "surest" of each region) there is a row for each
    hit that stays instead: keys, the fields of a hit, and the ``stretch`` around it.
    """
    needles = _needles(lexicon).persist()
    held = sentences.select(*keys, "sentence")
    hit = _hit_type(needles)
    total = needles.agg(F.coalesce(F.sum(F.length("needle")), F.lit(0)).alias("n")).first()["n"]
    if total <= letters:
        rows = [tuple(r) for r in needles.collect()]  # bounded by the check above
        needles.unpersist()
        return _kept(held, keys, hit, kept, rows) if kept else _mapped(held, rows, hit)
    lists = _sliced(held, needles, keys, hit, ceil(total / letters))
    return _kept(lists, keys, hit, kept) if kept else lists


def _mapped(held: DataFrame, rows: list[tuple], hit: StructType) -> DataFrame:
    schema = StructType([*held.schema.fields, StructField("hits", ArrayType(hit))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _Scan(rows)
        for batch in batches:
            found = [scan.hits(s) for s in batch.column("sentence").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow.field("hits").type)], schema=arrow)

    return held.mapInArrow(run, schema)


def _kept(held: DataFrame, keys: list[str], hit: StructType, kept: str, rows: list[tuple] | None = None) -> DataFrame:
    """A row for each hit that stays in a sentence of ``held``, whose hits are listed, or found by the needles ``rows``."""
    schema = StructType([*held.select(*keys).schema.fields, *hit.fields, StructField("stretch", StringType())])
    arrow = to_arrow_schema(schema)
    at, names = held.columns.index("sentence"), ("term", "region_id", "kind", "confidence")

    def listed(part: pa.RecordBatch) -> tuple[_Terms, list[list[tuple[int, int]]]]:
        lists = [[(h["pos"], (h["end"] - h["pos"], *(h[n] for n in names))) for h in hits] for hits in part.column("hits").to_pylist()]
        terms = _Terms(entry for hits in lists for _, entry in hits)
        return terms, [[(pos, terms.number[entry]) for pos, entry in hits] for hits in lists]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = None if rows is None else _Scan(rows)
        for batch in batches:
            for part in parts(batch, [at]):
                sentences = part.column(at).to_pylist()
                terms, found = listed(part) if scan is None else (scan.terms, map(scan.places, sentences))
                row, pos, number, around = [], [], [], []
                for k, (sentence, hits) in enumerate(zip(sentences, found)):
                    if not hits:
                        continue
                    stay = terms.disjoint(hits)
                    if kept == "surest":
                        stay = terms.surest(stay)
                    row += [k] * len(stay)
                    pos += [p for p, _ in stay]
                    number += [n for _, n in stay]
                    around += [sentence[max(p - NEAR, 0) : p + terms.sizes[n] + NEAR] for p, n in stay]
                if not row:
                    continue
                row, number, pos = pa.array(row), np.array(number), np.array(pos, np.int32)
                entries = dict(zip(("size", *names), zip(*terms.entries)))
                made = {n: pa.array(entries[n], arrow.field(n).type).take(pa.array(number)) for n in names}
                made |= {"pos": pa.array(pos), "end": pa.array(pos + np.array(terms.sizes, np.int32)[number]), "stretch": pa.array(around, pa.string())}
                columns = [part.column(part.schema.get_field_index(k)).take(row) for k in keys]
                yield pa.RecordBatch.from_arrays([*columns, *(made[f.name] for f in list(arrow)[len(keys) :])], schema=arrow)

    return held.mapInArrow(run, schema)


def _sliced(held: DataFrame, needles: DataFrame, keys: list[str], hit: StructType, slices: int) -> DataFrame:
    blocks = ceil(held.count() / BLOCK_ROWS) or 1
    block = F.pmod(F.xxhash64(*keys), F.lit(blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = held.withColumn("_block", block).withColumn("_slice", every(slices))
    right = needles.withColumn("_slice", F.pmod(F.xxhash64("needle"), F.lit(slices))).withColumn("_block", every(blocks))
    schema = StructType([*held.select(*keys).schema.fields, *hit.fields])

    def match(rows: pd.DataFrame, slice_: pd.DataFrame) -> pd.DataFrame:
        scan = _Scan(list(slice_[["needle", "cased", "term", "region_id", "kind", "confidence"]].itertuples(index=False, name=None)))
        out = [(*key, *h.values()) for *key, s in rows[[*keys, "sentence"]].itertuples(index=False, name=None) for h in scan.hits(s)]
        return pd.DataFrame(out, columns=[f.name for f in schema])

    found = left.groupBy("_slice", "_block").cogroup(right.groupBy("_slice", "_block")).applyInPandas(match, schema)
    lists = found.groupBy(*keys).agg(F.collect_list(F.struct(*[f.name for f in hit])).alias("hits"))
    return held.join(lists, keys, "left").withColumn("hits", F.coalesce("hits", F.array().cast(ArrayType(hit))))


def side(stretch: Column, sides: tuple[str, str] = SIDES) -> Column:
    """Which side is named nearest to the left end of the stretch around a hit; only as written in lower case."""
    found = F.regexp_extract(stretch, rf"\b({'|'.join(sides)})s?\-?{SIDE_ENDINGS}\b", 1)
    return F.when(found == "", "unspecified").otherwise(found)


def scanned(sentences: DataFrame, lexicon: DataFrame, keys: list[str], sides: tuple[str, str] = SIDES) -> DataFrame:
    """Hits that stay after overlaps are resolved: keys, pos, end, term, region_id, kind, confidence, laterality.

    Null and empty sentences have none; equal sentences have the same.
    """
    hits = raw_hits(sentences, lexicon, keys, kept="disjoint")
    return hits.select(*keys, "pos", "end", "term", "region_id", "kind", "confidence", side(F.col("stretch"), sides).alias("laterality"))


def region_mentions(sentences: DataFrame, lexicon: DataFrame, keys: list[str], sides: tuple[str, str] = SIDES) -> DataFrame:
    """One row for each sentence and region: its surest hit, of equal ones the first.

    All of a sentence is in its row, so nothing is shuffled for it.
    """
    hits = raw_hits(sentences, lexicon, keys, kept="surest")
    return hits.select(*keys, "region_id", "pos", "end", "term", "kind", "confidence", side(F.col("stretch"), sides).alias("laterality"))
