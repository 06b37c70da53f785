"""Hard negatives against a search that scores all rows for all anchors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulewright.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, LABEL string, score double, key string"


def rows(seed=1, n=400, hot=0):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    near = lambda c: [x + r.gauss(0, 0.05) for x in c]
    out = [(i, near(centres[r.randrange(6)]), r.randrange(3)) for i in range(n)]
    out += [(i, out[7][1], r.randrange(3)) for i in range(n, n + hot)]  # one vector many times: ties
    out += [(10, out[10][1], 1), (10, out[11][1], 2), (100, out[100][1], out[100][2]), (20, near(centres[0]), None), (21, None, 1), (None, out[3][1], 1)]
    out += [(22, [1.0, None], 1), (23, [math.nan] * 8, 1), (24, [math.inf] * 8, 1), (200, [], 1), (25, [0.5, 0.5], 2), (300, [-x for x in centres[0]], 5)]
    return out


def brute(data, k_pos=5, k_neg=5):
    use = [(v, label, [math.floor(256 * float(np.float32(x))) for x in e]) for v, e, label in data if v is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, (v, label, q) in enumerate(use):
        if v % 100:
            continue
        scored = [(-dot(q, x), w, own == label) for j, (w, own, x) in enumerate(use) if j != i]
        for p, pid, _ in sorted(s for s in scored if s[2])[:k_pos]:
            fits = sorted((s, w) for s, w, same in scored if not same and 80 * -p <= 100 * -s <= 100 * -p)[:k_neg]
            out += [(v, pid, rank + 1, w, -p, -s) for rank, (s, w) in enumerate(fits)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize(("hot", "lists"), [(0, None), (0, 40), (300, 12)])
def test_negatives(spark, monkeypatch, hot, lists):
    """Few lists, many, and many copies of one vector in several blocks."""
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 50)
    spark.conf.set("spark.sql.caseSensitive", "true")
    data = rows(hot=hot)
    df = spark.createDataFrame([(*r, "x", 0.5, "y") for r in data], SCHEMA)
    assert got(negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, lists=lists)) == brute(data)
    spark.conf.unset("spark.sql.caseSensitive")


def test_no_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert got(negatives.hard_negatives(df, F.col("vec_id") % 100 == 0)) == []
    none = spark.createDataFrame([(1, [1.0], 1), (2, [2.0], 2)], "vec_id long, embedding array<float>, label int")
    assert got(negatives.hard_negatives(none, F.col("vec_id") % 100 == 0)) == []


def test_bounds_hold_all_scores():
    r = np.random.default_rng(3)
    x = r.integers(-200, 200, (500, 6))
    centroids = negatives.fitted(x[:200], 9)
    near, far = negatives.nearest(x.astype(float), centroids)
    radius = np.array([far[near == k].max(initial=-1) for k in range(len(centroids))])
    least, most = negatives.bounds(x[:50], centroids, radius)
    scores = x[:50] @ x.T
    assert (scores <= most[:, near]).all() and (scores >= least[:, near]).all()


def test_large_products_are_exact():
    a = np.array([[1 << 40, 3]], np.int64)
    assert negatives.products(a, np.array([[1 << 20, 1], [1, 1]], np.int64)).tolist() == [[(1 << 60) + 3, (1 << 40) + 3]]
