import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from histloom.llm import topk


def brute(rows, asked, k):
    usable = {}
    for key, v in rows:
        if key is not None and v and all(x is not None and math.isfinite(x) for x in v):
            usable.setdefault(key, []).append([math.floor(256 * x) for x in v])
    out = []
    for q in asked:
        if q not in usable:
            continue
        scored = [
            (-sum(a * b for a, b in zip(min(usable[q]), v, strict=True)), key)
            for key, vs in usable.items() if key != q for v in vs if len(v) == len(min(usable[q]))
        ]
        out += [(q, i + 1, key, -s) for i, (s, key) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("n, width, spread", [(300, 8, 1.0), (260, 3, 0.02), (4, 5, 1.0)])
def test_equals_brute_force(spark, n, width, spread):
    rng = random.Random(n)
    rows = [(i, [rng.gauss(0, spread) for _ in range(width)]) for i in range(n)]
    rows += [(n + 50 - n % 50, None), (1001, [float("nan")] * width), (1002, [math.inf] + [0.0] * (width - 1)),
             (1003, [None] * width), (None, [9.0] * width), (1004, [9.0] * (width + 1)), (1005, [])]
    rows += [(2000, rows[1][1]), (2001, rows[1][1])]
    df = spark.createDataFrame(rows, "id bigint, e array<double>")
    vectors = df.select("id", topk.quantised(F.col("e")).alias("v"))
    vectors = vectors.filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    got = topk.top_k(vectors.filter("id % 50 = 0"), vectors, query_block=3, candidate_block=64)
    asked = sorted({i for i, _ in rows if i is not None and i % 50 == 0})
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, asked, 5)
    none = vectors.filter("false")
    assert topk.top_k(none, vectors).count() == 0 and topk.top_k(vectors, none).count() == 0


def test_bounds_stop_reading_without_losing_a_hit():
    rng = np.random.default_rng(5)
    c = rng.integers(-300, 300, (3000, 64))
    q = rng.integers(-300, 300, (20, 64))
    rows, columns, scores = topk.best_of_block(np.arange(20) + 10_000, q, np.arange(3000), c, 5)
    whole = q @ c.T
    for i in range(20):
        want = np.lexsort((np.arange(3000), -whole[i]))[:5]
        assert columns[rows == i].tolist() == want.tolist()
        assert scores[rows == i].tolist() == whole[i][want].tolist()


def test_bars_and_bounds_prune_clustered_vectors():
    """Blocks of far clusters are not read; within the own cluster few pairs are resolved."""
    rng = np.random.default_rng(6)
    centres = rng.integers(-4000, 4000, (6, 16))
    blocks = [centre + rng.integers(-20, 20, (500, 16)) for centre in centres]
    q = blocks[2][:30] + 1
    ids = np.arange(30) + 90_000
    whole, resolved, bars = [], [], None
    for n in (2, 0, 1, 3, 4, 5):
        c_ids = np.arange(500) + 1000 * n
        rows, columns, scores = topk.best_of_block(ids, q, c_ids, blocks[n], 5, bars, resolved)
        whole += list(zip(rows.tolist(), (-scores).tolist(), c_ids[columns].tolist(), strict=True))
        if bars is None:
            bars = np.array([scores[rows == i].min() for i in range(30)], dtype=float)
    assert sum(resolved) < 0.2 * 30 * 3000 and 0 in resolved
    every = np.concatenate(blocks)
    for i in range(30):
        exact = every @ q[i]
        keys = np.concatenate([np.arange(500) + 1000 * n for n in range(6)])
        want = sorted(zip((-exact).tolist(), keys.tolist(), strict=True))[:5]
        assert sorted((s, key) for row, s, key in whole if row == i)[:5] == want


@pytest.mark.parametrize("size", [2**21, 2**28, 2**40])
def test_large_components_are_exact(size):
    rng = random.Random(size)
    c = [[rng.randint(-size, size) for _ in range(8)] for _ in range(60)]
    q = [[rng.randint(-size, size) for _ in range(8)] for _ in range(3)]
    rows, columns, scores = topk.best_of_block(
        np.arange(3) + 100, np.array(q), np.arange(60), np.array(c), 5
    )
    for i in range(3):
        exact = sorted((-sum(x * y for x, y in zip(q[i], v, strict=True)), n) for n, v in enumerate(c))
        assert [(-int(s), int(n)) for s, n in zip(scores[rows == i], columns[rows == i], strict=True)] == exact[:5]


def test_an_id_asked_with_several_vectors(spark):
    df = spark.createDataFrame(
        [(0, [5, 1]), (0, [-3, 2]), (1, [1, 0]), (2, [-1, 0]), (3, [10**12, 10**12])], "id bigint, v array<bigint>"
    )
    got = topk.top_k(df.filter("id = 0"), df, k=2).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 2, 3), (2, 1, -3)]
