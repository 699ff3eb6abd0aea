"""The additive model against a plain version that looks at every row, bin and split."""

import math
import random

import numpy as np
import pytest

from kgspark.llm import classifier as c


def bin_of(edges, value):
    return sum(e <= value for e in edges)


def slopes(rows, y, margin):
    out = []
    for k in range(len(rows)):
        p = 1 / (1 + math.exp(-margin[k]))
        out.append((p - y[k], p * (1 - p)))
    return out


def gain(pairs):
    g, h = sum(a for a, _ in pairs), sum(b for _, b in pairs)
    return g * g / (h + c.RIDGE)


def leaf(pairs):
    return -sum(a for a, _ in pairs) / (sum(b for _, b in pairs) + c.RIDGE)


def best_cut(by_bin):
    """(gain, place) of the best split of a run of bins, each a list of (gradient, curvature)."""
    best, at = 0.0, 0
    whole = [p for b in by_bin for p in b]
    for k in range(1, len(by_bin)):
        left, right = [p for b in by_bin[:k] for p in b], [p for b in by_bin[k:] for p in b]
        if min(len(left), len(right)) < c.LEAF_ROWS:
            continue
        found = gain(left) + gain(right) - gain(whole)
        if found > best:
            best, at = found, k
    return best, at if best > 1e-9 else 0


def tree(by_bin, leaves=3):
    runs = [(0, len(by_bin))]
    while len(runs) < leaves:
        cuts = [best_cut(by_bin[a:b]) for a, b in runs]
        k = max(range(len(runs)), key=lambda i: cuts[i][0])
        if not cuts[k][1]:
            break
        a, b = runs[k]
        runs[k : k + 1] = [(a, a + cuts[k][1]), (a + cuts[k][1], b)]
    return [leaf([p for x in by_bin[a:b] for p in x]) for a, b in runs for _ in range(a, b)]


def pair_tree(grid):
    """Gain and values of the best tree that cuts one feature once, then the other on either side."""
    n, m = len(grid), len(grid[0])
    flat = lambda cells: [p for cell in cells for p in cell]
    every = flat(cell for row in grid for cell in row)
    best, out = 0.0, [[leaf(every)] * m for _ in range(n)]
    for turned in (False, True):
        g = [[grid[i][j] for i in range(n)] for j in range(m)] if turned else grid
        for cut in range(1, len(g)):
            total, value = 0.0, [[0.0] * len(g[0]) for _ in g]
            for part in (range(cut), range(cut, len(g))):
                columns = [flat(g[i][j] for i in part) for j in range(len(g[0]))]
                found, at = best_cut(columns)
                total += found + gain(flat(columns))
                for side in ((range(at), range(at, len(columns))) if at else (range(len(columns)),)):
                    v = leaf(flat(columns[j] for j in side))
                    for i in part:
                        for j in side:
                            value[i][j] = v
            total -= gain(every)
            if total > best + 1e-12:
                best, out = total, [[value[j][i] for j in range(m)] for i in range(n)] if turned else value
    return best, out


def plain_fit(rows, y, edges, coarse, pairs):
    width = len(edges)
    base = math.log(sum(y) / (len(y) - sum(y)))
    margin = [base] * len(y)
    tables = [[0.0] * (len(e) + 1) for e in edges]
    for _ in range(c.ROUNDS):
        for k in range(width):
            s = slopes(rows, y, margin)
            by_bin = [[] for _ in tables[k]]
            for r, p in zip(rows, s):
                by_bin[bin_of(edges[k], r[k])].append(p)
            step = [c.RATE * v for v in tree(by_bin)]
            tables[k] = [a + b for a, b in zip(tables[k], step)]
            margin = [a + step[bin_of(edges[k], r[k])] for a, r in zip(margin, rows)]

    def grid(i, j):
        out = [[[] for _ in range(len(coarse[j]) + 1)] for _ in range(len(coarse[i]) + 1)]
        for r, p in zip(rows, slopes(rows, y, margin)):
            out[bin_of(coarse[i], r[i])][bin_of(coarse[j], r[j])].append(p)
        return out

    ranked = sorted(((pair_tree(grid(i, j))[0], i, j) for i in range(width) for j in range(i)), reverse=True)[:pairs]
    chosen = [(i, j) for found, i, j in ranked if found > 0]
    pair_tables = {p: [[0.0] * (len(coarse[p[1]]) + 1) for _ in range(len(coarse[p[0]]) + 1)] for p in chosen}
    for _ in range(c.PAIR_ROUNDS):
        for i, j in chosen:
            step = [[c.RATE * v for v in line] for line in pair_tree(grid(i, j))[1]]
            pair_tables[i, j] = [[a + b for a, b in zip(x, z)] for x, z in zip(pair_tables[i, j], step)]
            margin = [a + step[bin_of(coarse[i], r[i])][bin_of(coarse[j], r[j])] for a, r in zip(margin, rows)]

    def score(r):
        out = base + sum(t[bin_of(e, r[k])] for k, (e, t) in enumerate(zip(edges, tables)))
        out += sum(t[bin_of(coarse[i], r[i])][bin_of(coarse[j], r[j])] for (i, j), t in pair_tables.items())
        return 1 / (1 + math.exp(-out))

    return chosen, score


@pytest.mark.parametrize("seed", range(3))
def test_fit_and_score_equal_a_plain_version(monkeypatch, seed):
    for name, value in {"FEATURES": ("a", "b", "d"), "ROUNDS": 4, "PAIR_ROUNDS": 3, "BINS": 6, "PAIR_BINS": 3, "LEAF_ROWS": 5}.items():
        monkeypatch.setattr(c, name, value)
    rng = random.Random(seed)
    rows = [[rng.random(), rng.gauss(0, 1), rng.choice([0, 1, 2, 3])] for _ in range(140)]
    y = [int(r[0] * r[2] + (r[1] > 0.3) + rng.gauss(0, 0.4) > 1.2) for r in rows]
    x = np.array(rows, np.float64)
    model = c.fit(x, np.array(y, np.float64), pairs=2)
    chosen, score = plain_fit(rows, y, [list(e) for e in model.edges], [list(e) for e in model.pair_edges], 2)
    assert model.pairs == chosen and len(chosen) == 2
    fresh = rows + [[rng.random() * 2, rng.gauss(0, 3), rng.choice([-1, 5])] for _ in range(60)]
    assert np.allclose(model.score(np.array(fresh, np.float64)), [score(r) for r in fresh], atol=1e-9)
    # bins are cut at quantiles
    for k, edges in enumerate(model.edges):
        want = sorted({round(float(np.quantile(x[:, k], q / c.BINS)), 9) for q in range(1, c.BINS)})
        assert np.allclose(edges, want)


def test_one_label_only_gives_a_constant():
    x = np.zeros((3, len(c.FEATURES)))
    assert c.fit(x, np.ones(3)).score(x).min() > 0.9 and c.fit(x, np.zeros(3)).score(x).max() < 0.1 and set(c.fit(x[:0], np.ones(0)).score(x)) == {0.5}
