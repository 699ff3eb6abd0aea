"""What verification of passages needn't do twice, and hashing of many texts at once."""

import numpy as np

from kgspark.llm import passages as p


def test_what_is_settled_is_not_compared_again(monkeypatch):
    text = np.arange(200, dtype=np.uint32)
    calls, alike = [], p._alike
    monkeypatch.setattr(p, "_alike", lambda *a: calls.append(1) or alike(*a))
    assert p.verified_spans(text, [text, text[20:150], text.copy()]) == [(0, 204)] and len(calls) == 1
    calls.clear()
    assert p.verified_spans(text, [text[20:150]], [(0, 204)]) == [] and not calls
    # too few of its shingles stand in the other one: that is told before the two are compared
    assert p.verified_spans(text, [text[::2].copy()]) == [] and not calls
    assert p.verified_spans(text, [text[100:]], [(0, 120)]) == [(100, 204)]


def test_texts_hashed_together_are_hashed_as_alone():
    texts = ["one two three four five six", None, "", " \n", "Seven", "one two three four five", "é two\tthree four five six seven"]
    h, counts = p.block_shingles(texts)
    alone = [p.document_shingles(t) for t in texts]
    assert counts.tolist() == [len(a) for a in alone] and (h == np.concatenate(alone)).all()
    assert p.block_shingles([])[0].tolist() == []


def test_passages_are_found_between_edits_that_are_no_gaps():
    """A text cut where it has most that is its own falls into parts that are too short, though longer ones are alike."""
    text = np.arange(1000, 1146, dtype=np.uint32)
    own = text.copy()
    for at, n in ((3, 13), (24, 6), (68, 5), (100, 9), (117, 5), (125, 5), (132, 5)):
        own[at : at + n] = np.arange(n, dtype=np.uint32) + 10 * at
    spans = p.verified_spans(own, [text])
    # every passage of which 8 of 9 places are hit, by brute force
    hit = own == text
    want = np.zeros(150, bool)
    for a in range(146):
        for z in range(a + 46, 147):
            if hit[a] and hit[z - 1] and hit[a:z].sum() * 9 >= 8 * (z - a):
                want[a : z + 4] = True
    got = np.zeros(150, bool)
    for a, z in spans:
        got[a:z] = True
    assert want.sum() >= 60 and (got == want).all()


def test_meetings_of_near_copies_grow_with_the_family():
    """Windows of one family: few of its pairs meet, and what any earlier one holds of a later one is among them."""

    def met(n: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(3)
        base = rng.integers(2, 1 << 14, 2 * p.WIDE + 1).astype(np.uint16) << 2 | np.uint16(p.NEW | 1)
        base[: p.WIDE - 72] = base[p.WIDE + 73 :] = 0
        near = np.tile(base, (n, 1))
        for row in near:
            for at in rng.choice(145, 4, replace=False) + p.WIDE - 72:
                if abs(at - p.WIDE) > 5:
                    row[at : min(at + 5, p.WIDE + 73)] = rng.integers(2, 1 << 14, min(at + 5, p.WIDE + 73) - at).astype(np.uint16) << 2 | np.uint16(p.NEW | 1)
        sides, yes = np.zeros((n, 2), np.int32), np.ones(n, bool)
        out = p._cell_meetings(np.zeros(n, np.int64), np.arange(n), np.full(n, 145), sides, near.copy(), yes, yes)
        return near, out

    near, few = met(200)
    many = met(800)[1]
    print("meetings of 200:", len(few), "of 800:", len(many))
    assert len(many) < 8 * len(few) and len(many) < 0.05 * 800 * 799 / 2
    middle = slice(p.WIDE - p.SIDE, p.WIDE + p.SIDE + 1)
    for y in range(150, 200):
        sure = few[(few[:, 1] == y) & (few[:, 2] == 1), 0]
        told = p._held(near[sure][:, middle], near[np.full(len(sure), y)][:, middle]).any(axis=0)
        any_ = p._held(near[:y, middle], near[np.full(y, y)][:, middle]).any(axis=0)
        assert np.count_nonzero(any_ & ~told) <= p.GAP
