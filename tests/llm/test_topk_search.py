"""Top-k inner products against all pairs, in blocks and chunks of several sizes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm.topk_search import Block, products, top_k


def brute_force(rows, k=5, scale=256, asks=lambda i: i % 50 == 0):
    usable = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(scale * x) for x in v]))
    out = []
    for a, (i, v) in enumerate(usable):
        if asks(i):
            others = [(-min(sum(x * y for x, y in zip(v, w)), 2**63 - 1), j) for b, (j, w) in enumerate(usable) if a != b and len(v) == len(w)]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(others)[:k], 1)]
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0, **options).collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 12))
    made = [(i, (centres[i % 9] + rng.normal(size=12) * (0.05 + i % 3)).astype(np.float32).tolist()) for i in range(1500)]
    ties = [(2000 + i, [0.25, -0.25, *[0.0] * 10]) for i in range(60)]
    return made + ties


def test_blocks_and_chunks(spark, rows):
    nan, inf = float("nan"), float("inf")
    odd = [
        (None, [1.0] * 12), (3000, None), (3050, [nan] * 12), (3100, [inf, *[1.0] * 11]), (3150, [None, *[9.0] * 11]),
        (3200, [0.0] * 12), (50, [1.0] * 12), (50, [1.0] * 12), (-50, [2.0, 1.0]), (1, [1.0, 1.0]), (7, []), (100, []),
    ]
    rows = rows + odd
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, rank int, score string")
    want = brute_force(rows)
    # several blocks, and chunks that meet them; one of each; blocks smaller than k
    assert found(df.repartition(3), block_vectors=200, chunk_queries=8) == want
    assert found(df) == want
    some = [r for r in rows if r[0] is not None and r[0] < 90]
    few = df.where("vec_id < 90")
    assert found(few, block_vectors=3, chunk_queries=2) == brute_force(some)
    assert found(few, k=200, block_vectors=30) == brute_force(some, 200)
    got = top_k(df.limit(0), F.col("vec_id") % 50 == 0)
    assert got.collect() == [] and got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]


def test_large_components(spark):
    rows = [(i, [float(2**40 + i * 3), float(-(2**41)), float(i)]) for i in range(0, 60)] + [(100, [1e300, 1.0, 1.0]), (150, [1e300, 1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, block_vectors=16) == brute_force(rows)


def test_reading_stops_early():
    rng = np.random.default_rng(1)
    vectors = np.floor(256 * rng.normal(size=(4_000, 2)))
    block = Block(np.arange(4_000), np.arange(4_000), vectors)
    scored = []

    class Counting(np.ndarray):
        def __getitem__(self, at):
            scored.append(np.size(at))
            return np.asarray(super().__getitem__(at))

    block.vectors = vectors.view(Counting)
    for at in range(0, 4_000, 100):
        best = block.top(vectors[at], at, 5)
        scores = vectors @ vectors[at]
        assert [b[0] for b in best] == sorted(np.delete(scores, at), reverse=True)[:5]
    assert sum(scored) < 0.2 * 4_000 * 40  # most vectors are never scored


def test_products():
    assert products(np.array([[2.0**40, 3.0]]), np.array([2.0**40, 1.0])).tolist() == [2**63 - 1]
    assert products(np.array([[2.0**30, 3.0]]), np.array([2.0**30, 1.0])).tolist() == [2**60 + 3]
    assert products(np.zeros((2, 0)), np.zeros(0)).tolist() == [0, 0]
