import math

import numpy as np
import pytest

from runscope.llm import intvectors, voronoi

SCHEMA = "vec_id long, embedding array<double>, label int, rank string"


def whole(v):
    """The integers of a vector that takes part, else None."""
    if not v or any(x is None or not math.isfinite(x * 256) for x in v):
        return None
    return [min(max(math.floor(x * 256), -(1 << 63)), (1 << 63) - 1) for x in v]


def brute(rows, is_query, k):
    own = sorted({(i, tuple(whole(v))) for i, v in rows if i is not None and whole(v)})
    out = []
    for q in sorted({i for i, _ in own if is_query(i)}):
        a = min(v for i, v in own if i == q)
        near = sorted((-min(max(sum(x * y for x, y in zip(a, v)), -(1 << 63)), (1 << 63) - 1), i) for i, v in own if i != q and len(v) == len(a))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(near[:k], 1)]
    return out


def found(df, is_query, **more):
    return sorted(tuple(r) for r in voronoi.nearest(df, is_query, **more).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_equal_to_brute_force_over_cells_blocks_and_lengths_of_vectors(spark, monkeypatch, spread):
    monkeypatch.setattr(voronoi, "PIVOT_ROWS", 40)
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 8))
    rows = [(i, (centres[r.integers(6)] + spread * r.normal(size=8)).tolist()) for i in range(700)]
    rows += [(1000 + i, centres[0].tolist()) for i in range(400)]  # a third are copies of one vector
    rows += [(2000 + i, r.normal(size=3).tolist()) for i in range(30)] + [(2100, [7.0])]  # other lengths
    rows += [(3000, None), (3005, []), (3010, [0.0] * 8), (3015, [float("nan")] * 8), (3020, [1.0, None] + [0.0] * 6), (3025, [1e308] * 8), (None, [1.0] * 8)]
    rows += [(10, rows[10][1]), (15, [9.0] * 8), (3030, (50 * centres[1]).tolist())]  # a repeated row, an id of two vectors, a long vector
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA).repartition(5)
    assert found(df, lambda c: c % 5 == 0, block_rows=64, group_rows=32) == brute(rows, lambda i: i % 5 == 0, 5)


def test_bounds_keep_most_blocks_from_most_groups(spark, monkeypatch):
    monkeypatch.setattr(voronoi, "PIVOT_ROWS", 50)
    r = np.random.default_rng(4)
    centres = r.normal(size=(20, 16)) * 10
    centres /= np.sqrt((centres**2).sum(axis=1, keepdims=True)) / 10
    x = np.concatenate([c + 0.01 * r.normal(size=(100, 16)) for c in centres])
    met = []
    p = voronoi.pivots_of(spark.createDataFrame([(i, 16, np.floor(256 * v).astype(int).tolist()) for i, v in enumerate(x)], "vec_id long, dim int, v array<long>"), {16: len(x)})[16]
    d = voronoi.between(p)
    cell = ((x[:, None] * 256 - p[None]) ** 2).sum(axis=2).argmin(axis=1)
    t = np.sqrt(((np.floor(x * 256) - p[cell]) ** 2).sum(axis=1))
    radius = {(16, c): t[cell == c].max() for c in np.unique(cell).tolist()}
    inside = {(16, c): (np.sort(t[cell == c])[:6], ((np.floor(x * 256)[cell == c]) ** 2).sum(axis=1)[np.argsort(t[cell == c])[:6]]) for c in np.unique(cell).tolist()}
    least = voronoi.thresholds({16: p}, radius, inside, 6)
    for c in np.unique(cell).tolist():
        n = (np.floor(x * 256) ** 2).sum(axis=1)
        met.append(sum(bool(voronoi.above(d[c, o], radius[16, c], t[cell == o].min(), t[cell == o].max(), n[cell == o].max()) >= least[16, c]) for o in np.unique(cell)))
    assert np.mean(met) < 0.5 * len(np.unique(cell))


def test_scores_beyond_doubles_and_longs_are_exact_or_the_limits(spark):
    rows = [(0, [float(2**40), 3.0]), (1, [float(2**30), 1 / 256]), (2, [float(2**30), 2 / 256]), (3, [1e30, 0.0]), (4, [-1e30, 0.0]), (5, [1e30, 1.0])]
    df = spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA)
    assert found(df, lambda c: c <= 1) == brute(rows, lambda i: i <= 1, 5)
    assert found(df.limit(0), lambda c: c <= 1) == []
    assert found(df.where("vec_id = 0"), lambda c: c <= 1) == []


def test_top_takes_the_smaller_ids_of_ties():
    s = np.array([[5, 5, 5, 4], [1, 2, 3, 4]])
    r, c = intvectors.top(s, np.array([[True, True, True, True], [True, True, True, False]]), np.array([9, 3, 7, 1]), 2)
    assert list(zip(r.tolist(), c.tolist())) == [(0, 1), (0, 2), (1, 2), (1, 1)]
