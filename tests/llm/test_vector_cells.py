"""Planted links over several cells, guests and blocks, against all pairs."""

import numpy as np
import pytest

from tallyline.llm import vector_dedup as module
from tallyline.llm.vector_dedup import _cells, _widest, spherical_kmeans, unit, vector_dedup


def planted(seed, n=700, dim=10, spread=0.35):
    """Clusters that lie close to each other, with near copies inside and at their borders."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    vectors = [centres[i % 12] + rng.normal(size=dim) * spread for i in range(n)]
    for i in range(0, n, 3):
        vectors.append(vectors[i] * rng.uniform(0.1, 9) + rng.normal(size=dim) * rng.choice([0.02, 0.2, 0.5]))
    vectors += [(centres[0] + centres[1]) / 2 + rng.normal(size=dim) * 0.1 for _ in range(60)]
    vectors += vectors[:20]
    return np.array(vectors, np.float32).astype(float)


def brute_force(rows, threshold=0.93):
    n = len(rows)
    ids = [r[0] for r in rows]
    cosines = unit(np.array([r[1] for r in rows])) @ unit(np.array([r[1] for r in rows])).T
    labels = np.array([r[2] for r in rows])
    links = (cosines >= threshold) & (labels[:, None] == labels)
    np.fill_diagonal(links, False)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(links)):
        root[find(int(a))] = find(int(b))
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return sorted((ids[i], int(links[i].sum()), least[find(i)], ids[i] == least[find(i)]) for i in range(n))


@pytest.mark.parametrize("seed, labels, per_cell, block", [(1, 1, 40, 16), (2, 3, 25, 1_024), (3, 2, 2_000, 64)])
def test_cells_and_blocks(spark, monkeypatch, seed, labels, per_cell, block):
    monkeypatch.setattr(module, "VECTORS_PER_CELL", per_cell)
    monkeypatch.setattr(module, "BLOCK_VECTORS", block)
    rows = [(i, v.tolist(), i % 7 % labels) for i, v in enumerate(planted(seed))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = sorted(tuple(r) for r in vector_dedup(df).collect())
    want = brute_force(rows)
    assert got == want
    assert sum(r[1] for r in want) > 1_000 and sum(r[3] for r in want) > 100


def test_null_ids_and_odd_rows(spark):
    rows = [(None, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (6, [], 1), (7, None, 1), (8, [0.0, 0.0], 1), (9, [1.0, 2.0], None)]
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], "vec_id long, embedding array<double>, label int, copies int, node string")
    got = sorted((tuple(r) for r in vector_dedup(df).collect()), key=repr)
    assert got == sorted(
        [(None, 2, 5, False), (None, 2, 5, False), (5, 2, 5, True), *[(i, 0, i, True) for i in (6, 7, 8, 9)]], key=repr
    )


def test_clusters_have_few_guests(spark):
    """Guests grow in proportion where vectors are clustered, however many cells there are."""
    from pyspark.sql import functions as F

    def guests(n):
        rng = np.random.default_rng(7)
        cells = n // 50
        centres = rng.normal(size=(cells, 32))
        vectors = unit(np.repeat(centres, 50, axis=0) + rng.normal(size=(n, 32)) * 0.05)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<double>")
        found = spherical_kmeans(vectors, cells)
        assert (_widest(df, found) < 1.5).all()
        return _cells(df, found, np.sqrt(2 - 2 * 0.93)).agg(F.sum(F.size("guest_of"))).first()[0]

    few, many = guests(500), guests(2_500)
    assert many <= 5 * max(few, 500)
