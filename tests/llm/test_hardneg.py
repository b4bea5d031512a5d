import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from runscope.llm import hardneg
from tests.llm.test_voronoi import whole

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, grp int"


def brute(rows, is_anchor, positives, negatives, low, high):
    own = sorted({(i, tuple(whole(v)), l) for i, v, l in rows if i is not None and l is not None and whole(v)})
    clamp = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    out = []
    for a in sorted({i for i, _, _ in own if is_anchor(i)}):
        _, v, l = min(r for r in own if r[0] == a)
        near = sorted((-clamp(sum(x * y for x, y in zip(v, w))), i, m) for i, w, m in own if i != a and len(w) == len(v))
        for p, i, _ in [x for x in near if x[2] == l][:positives]:
            fits = [(j, -s) for s, j, m in near if m != l and low * -p <= 10 * -s <= high * -p]
            out += [(a, i, n, j, -p, s) for n, (j, s) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def found(df, is_anchor, **more):
    cols = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r) for r in hardneg.mine(df, is_anchor, F.col("label"), **more).select(*cols).collect())


@pytest.mark.parametrize("spread", [0.2, 3.0])
def test_equal_to_brute_force_over_blocks_copies_and_lengths(spark, monkeypatch, spread):
    monkeypatch.setattr(hardneg, "CHUNK_BLOCKS", 4)
    r = np.random.default_rng(8)
    centres = r.normal(size=(6, 9))
    rows = [(i, (centres[r.integers(6)] + spread * r.normal(size=9)).tolist(), int(r.integers(4))) for i in range(600)]
    rows += [(1000 + i, centres[0].tolist(), i % 3) for i in range(300)]  # a third are copies of one vector
    rows += [(2000 + i, r.normal(size=2).tolist(), i % 2) for i in range(40)] + [(2100, [7.0], 1)]  # other lengths
    rows += [(3000, None, 1), (3010, [], 1), (3020, [0.0] * 9, 1), (3030, [float("nan")] * 9, 1), (3040, [1.0, None] + [0.0] * 7, 1), (3050, rows[3][1], None), (None, [1.0] * 9, 1)]
    rows += [(10, rows[10][1], rows[10][2]), (20, [9.0] * 9, 0), (11, centres[2].tolist(), 1), (3060, (50 * centres[1]).tolist(), 2)]  # a repeated row, ids of two vectors, a long vector
    df = spark.createDataFrame([(i, v, l, "clash", 1) for i, v, l in rows], SCHEMA).repartition(5)
    assert found(df, lambda c: c % 10 == 0, block_rows=64, group_rows=32) == brute(rows, lambda i: i % 10 == 0, 5, 10, 3, 9)


def test_empty_tables_lone_anchors_and_extreme_scores(spark):
    rows = [(0, [1e30, 0.0], 1), (1, [1e30, 1.0], 1), (2, [5e29, 0.0], 2), (3, [1.0, 1.0], 2), (4, [-1.0, 3.0], 3), (100, [2.0, 2.0], 9), (200, [-1.0, 0.0], 2)]
    df = spark.createDataFrame([(i, v, l, "", 0) for i, v, l in rows], SCHEMA)
    assert found(df, lambda c: c % 100 == 0) == brute(rows, lambda i: i % 100 == 0, 5, 10, 3, 9)
    assert found(df.limit(0), lambda c: c % 100 == 0) == []


def test_the_curve_visits_every_point_by_single_steps():
    for dims, bits in ((2, 4), (3, 3), (8, 1)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        places = hardneg.hilbert(points, bits)
        assert sorted(places.tolist()) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(places)], axis=0)).sum(axis=1) == 1).all()
    high = hardneg.hilbert(np.array([[0] * 8, [255] + [0] * 7]), 8)  # unsigned places in signed order
    assert high[0] < high[1]


def test_ranges_hold_every_score_of_a_box_and_rule_blocks_out():
    r = np.random.default_rng(1)
    x = np.sort(r.integers(-300, 300, size=(40, 20, 5)), axis=0)
    q = r.integers(-300, 300, size=(30, 5))
    least, most = hardneg.ranges(q, x.min(axis=1), x.max(axis=1))
    score = np.einsum("qd,bnd->qbn", q, x)
    assert (score.min(axis=2) >= least).all() and (score.max(axis=2) <= most).all()
    best = np.sort(score.reshape(30, -1), axis=1)[:, -5]
    assert (most < best[:, None]).mean() > 0.3
