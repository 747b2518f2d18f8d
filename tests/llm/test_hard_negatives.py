"""Hard negatives against all scores, the bounds that rings are left out by, and the defined value of every odd case."""

import math
import random

import numpy as np
import pytest

from loomledger.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def by_all_scores(rows):
    """Rows (vec_id, label, components) that take part, every anchor against every row."""
    held = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v])
        held[i] = min(held.get(i, row), row)
    out = []
    for a in (i for i in held if i % 100 == 0):
        score = {i: sum(x * y for x, y in zip(held[a][1], held[i][1])) for i in held if i != a}  # noqa: B905
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if held[i][0] == held[a][0]][:5]:
            fit = [i for i in order if held[i][0] != held[a][0] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:5]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows):
    return sorted(map(tuple, hard_negatives.mined(spark.createDataFrame(rows, SCHEMA)).collect()))


def clustered(r, n, dims, copies):
    """Vectors around a few centres, of various norms, a third of them equal where copies is true."""
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    one = [0.5] * dims
    return [(i, r.randrange(4), one if copies and r.random() < 0.35 else [r.choice([0.1, 1, 1, 3]) * (c + r.gauss(0, 0.1)) for c in r.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("copies", [False, True])
def test_equal_to_all_scores(spark, monkeypatch, copies):
    for name, value in (("ROWS_PER_PIVOT", 100), ("BLOCK", 40), ("GROUP", 3)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = clustered(random.Random(7), 1500, 6, copies)
    got = mined(spark, rows)
    assert got == by_all_scores(rows) and got


def test_bounds_hold_every_score_and_leave_rings_out():
    r = np.random.default_rng(3)
    centres = r.normal(size=(8, 5)) * 300
    rows = np.floor(np.repeat(centres, 50, axis=0) + r.normal(size=(400, 5)) * 8).astype(np.int64)
    anchors = rows[::40]
    cells = hard_negatives.Cells(rows[::50], float((rows.astype(float) ** 2).sum(1).max()))
    d = cells.distances(rows, False)
    at = d.argmin(1)
    scores, left_out = anchors @ rows.T, 0
    for c in range(8):
        own = d[at == c, c]
        low, high = cells.bounds(anchors, np.array([c]), own.min(keepdims=True), own.max(keepdims=True))
        mine = scores[:, at == c]
        assert (low[:, 0] <= mine.min(1)).all() and (mine.max(1) <= high[:, 0]).all()
        left_out += (high[:, 0] < 0.8 * scores.max(1)).sum()
    assert left_out > 20


def test_ties_go_to_the_smaller_id(spark):
    rows = [(0, 1, [1.0, 0.0]), *[(i, 1, [1.0, 0.5]) for i in range(1, 7)], *[(i, 2, [0.9, 0.0]) for i in range(8, 14)]]
    assert mined(spark, rows) == by_all_scores(rows)
    assert {r[1] for r in mined(spark, rows)} <= {1, 2, 3, 4, 5, 6}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = clustered(random.Random(1), 450, 3, False)
    odd = [(None, 1, [1.0] * 3), (1000, None, [1.0] * 3), (1001, 1, None), (1002, 1, [1.0, None, 1.0]), (1003, 1, [nan, 1.0, 1.0]), (1004, 1, [1.0, inf, 1.0]), (1005, 1, [1.0, -inf, 1.0])]
    # repeated rows, one id with two vectors, shorter and empty vectors, a label of one row, negative ids
    odd += [rows[100], rows[100], (200, 0, [0.5, 0.5, 0.5]), (1100, 2, [2.0]), (1101, 2, []), (1200, 77, [1.0, 1.0, 1.0]), (-100, 1, [1.0, -1.0, 0.25]), (-7, 3, [1.0, 0.0, 0.0])]
    want = by_all_scores(rows + odd)
    frame = spark.createDataFrame([(*r, 1, 2, 3.0, "c") for r in rows + odd], SCHEMA + ", cell int, `row` int, d double, rank string")
    assert sorted(map(tuple, hard_negatives.mined(frame).collect())) == want
    assert {r[0] for r in want} >= {-100, 0, 100, 200} and not {r[0] for r in want} & {1000, 1200}
    assert hard_negatives.mined(frame.limit(0)).collect() == []
    assert hard_negatives.mined(frame.filter("vec_id % 100 <> 0")).collect() == []


def test_scores_beyond_doubles_and_beyond_64_bits():
    a = np.array([[1 << 40, 3]], np.int64)
    assert hard_negatives.products(a, np.array([[1 << 20, 1], [-(1 << 20), 1]], np.int64)).tolist() == [[(1 << 60) + 3, 3 - (1 << 60)]]
    ends = np.iinfo(np.int64)
    assert hard_negatives.products(a, np.array([[1 << 40, 0], [-(1 << 40), 0]], np.int64)).tolist() == [[ends.max, ends.min + 1]]
    assert hard_negatives.products(a, np.zeros((0, 0), np.int64)).shape == (1, 0)


def test_huge_components_do_not_break(spark):
    rows = [(0, 1, [3e38, 1.0]), (1, 1, [3e38, 0.0]), (2, 2, [3e38, 0.0]), (3, 2, [-3e38, 1.0])]
    top = np.iinfo(np.int64).max
    assert mined(spark, rows) == [(0, 2, 1, 1, top, top)]  # id 0 has label 2
