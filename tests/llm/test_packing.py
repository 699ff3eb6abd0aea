"""The packing search: steps only raise the sum of squared fills, many small items are no burden."""

import random
import resource
import time
import tracemalloc

import pyarrow as pa
import pytest

from kgspark.llm import packing
from kgspark.llm.bpe import tokenizer_path
from kgspark.llm.common import blocks
from kgspark.llm.packing import Bins
from kgspark.llm.tokencount import VOCABULARY, transducer


class Watched(Bins):
    """Bins that look at the sum of squared fills after each step."""

    def _fuller(self, b):
        before = sum(f * f for f in self.fill)
        done = super()._fuller(b)
        after = sum(f * f for f in self.fill)
        assert after > before if done else after == before
        return done


def packed(sizes, capacity, kind=Bins):
    bins = kind(sizes, capacity)
    bins.best_fit()
    first = len(bins.held)
    bins.improve()
    assert sorted(i for h in bins.held for i in h) == list(range(len(sizes)))
    assert [sum(sizes[i] for i in h) for h in bins.held] == bins.fill and max(bins.fill, default=0) <= capacity
    assert len(bins.held) <= first
    return bins


@pytest.mark.parametrize("low, high", [(400, 900), (600, 1100), (500, 1500), (30, 2048)])
def test_every_step_raises_the_sum_of_squared_fills(low, high):
    rng = random.Random(low)
    packed([rng.randint(low, high) for _ in range(600)], 2048, Watched)


def test_small_cases_end():
    rng = random.Random(9)
    for _ in range(4000):
        capacity = rng.randint(3, 30)
        packed([rng.randint(1, capacity) for _ in range(rng.randint(0, 14))], capacity, Watched)


@pytest.mark.parametrize("sizes", [[3] * 4096, [1] * 6143, [1, 2, 3] * 2700])
def test_thousands_of_small_items(sizes):
    began, held = time.perf_counter(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    bins = packed(sizes, 2048)
    assert len(bins.held) <= -(-sum(sizes) // 2046)
    assert time.perf_counter() - began < 2
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - held < 100_000


def test_no_step_is_left():
    """No move or exchange of up to three items, two on a side at most, would fill a bin at the cost of one less full, or later of two as full."""
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.randint(6, 40)
        sizes = [rng.randint(2, capacity) for _ in range(rng.randint(3, 12))]
        bins = packed(sizes, capacity)

        def sides(held):
            ones = [sizes[i] for i in held]
            return [0], ones, [a + b for k, a in enumerate(ones) for b in ones[:k]]

        for b, own in enumerate(bins.held):
            for c, other in enumerate(bins.held):
                if bins.fill[b] < capacity and (bins.fill[c], -c) < (bins.fill[b], -b):
                    give, get = sides(own), sides(other)
                    for g, t in [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1)]:
                        assert not any(0 < y - x <= capacity - bins.fill[b] for x in give[g] for y in get[t])


def test_encoding_holds_little_at_a_time():
    """4 MB of different words in one batch: they aren't all encoded at once."""
    rng = random.Random(3)
    coder = transducer(tokenizer_path(VOCABULARY))
    texts = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(7000)) for _ in range(85)]
    batch = pa.record_batch({"doc_id": list(range(len(texts))), "text": texts})
    tracemalloc.start()
    for block in blocks(batch, 1, packing.ENCODE_BYTES):
        packing.encode_with_special(block.column(1).to_pylist(), coder)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 140e6
