"""Exact top-k search: brute force, early stops, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.llm import topk
from treeline.llm.topk import Lists, exact_top_k

SCHEMA = "vec_id long, embedding array<float>"


def brute(v, k=5, every=50):
    """Of rows (id, whole numbers), identical ones once; scores beyond a long count as the nearest."""
    rows = sorted({(i, tuple(x)) for i, x in v})
    near = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = {}
    for q, x in rows:
        if q % every == 0:
            out.setdefault(q, set()).update((-near(sum(a * b for a, b in zip(x, y, strict=False))), i, y) for i, y in rows if i != q)
    return sorted((q, n + 1, i, -s) for q, c in out.items() for n, (s, i, _) in enumerate(sorted(c)[:k]))


def found(df, **options):
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in exact_top_k(df, F.col("vec_id") % 50 == 0, **options).collect())


def whole(x):
    return [int(np.floor(256 * float(a))) for a in x]


def vectors(n, d, seed=3, skew=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.3, (n, d)) * (rng.pareto(1.0, (n, d)) if skew else 1)
    return x.round(1).astype("float32")  # rounded: ties


@pytest.mark.parametrize("skew", [False, True])
@pytest.mark.parametrize("numbers", [1 << 20, 24])
def test_against_brute_force(spark, monkeypatch, skew, numbers):
    """Also with several blocks of queries and of candidates."""
    monkeypatch.setattr(topk, "QUERY_NUMBERS", numbers)
    x = vectors(400, 8, skew=skew)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1050, [float("nan")] * 8), (1100, [None] * 8), (1150, []), (None, x[1].tolist()), (0, x[0].tolist()), (50, x[3].tolist())]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(3)
    assert found(df) == brute([(i, whole(v)) for i, v in rows] + [(50, whole(x[3]))])


def test_search_covers_the_best_in_every_block():
    rng = np.random.default_rng(4)
    for trial in range(60):
        n, d, k = rng.integers(40, 700), rng.integers(1, 20), int(rng.integers(1, 8))
        rows = rng.integers(-9, 9, (n, d)) if trial % 3 else np.tile(rng.integers(-9, 9, d), (n, 1))
        query = rng.integers(-3, 4, d) * rng.integers(0, 2, d)
        lists = Lists(np.arange(n), np.arange(n), rows)
        may, scores, depth = lists.search(query, 7, k)
        assert (scores == rows[may] @ query).all() and 0 <= depth <= 1 and 7 not in may
        want = sorted(((-s, i) for i, s in enumerate((rows @ query).tolist()) if i != 7))[:k]
        assert {i for _, i in want} <= set(may.tolist())
        floor = -want[-1][0]
        assert {i for _, i in want} <= set(lists.search(query, 7, k, floor)[0].tolist())


def test_skewed_vectors_stop_early():
    """Candidates with one large component each are told apart near the tops of the lists; spread-out ones are not."""
    rng = np.random.default_rng(6)
    n, d = 8_000, 32
    skewed = rng.integers(-3, 4, (n, d))
    skewed[np.arange(n), rng.integers(0, d, n)] = (rng.pareto(0.7, n) * 50).astype(int) + 10
    depths, left = {}, {}
    for name, rows in (("skewed", skewed), ("spread", rng.integers(-90, 90, (n, d)))):
        lists = Lists(np.arange(n), np.arange(n), rows)
        got = [lists.search(rows[q], q, 5) for q in range(20)]
        depths[name], left[name] = np.mean([d for _, _, d in got]), np.mean([len(may) for may, _, _ in got])
    assert depths["skewed"] < 0.25 and left["skewed"] < n / 3
    assert depths["spread"] < 1 and left["spread"] > n / 2


def test_large_components(spark):
    """Scores are exact where doubles are not, and the nearest long where they pass it."""
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**40, 3.0]), (2, [-(2.0**40), 5.0]), (50, [1.0, 1.0]), (3, [1e300, 1.0]), (4, [-1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(df, k=9)
    assert got == brute([(i, [256 * int(a) for a in v]) for i, v in rows], 9)


def test_small_and_odd_tables(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [0.5, 2.0])], SCHEMA)
    assert found(df) == [(0, 1, 50, 32768), (50, 1, 0, 32768)]
    assert found(df.filter("vec_id = 0")) == [] == found(df.limit(0)) == found(df.filter("vec_id < 0"))
    names = {c: F.lit(9) for c in ("id", "v", "h", "qh", "query_id", "rank", "score", "depth", "block", "cb")}
    assert found(df.withColumns(names)) == found(df)
