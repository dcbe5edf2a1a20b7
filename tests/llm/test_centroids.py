"""Centroid clustering: the bounds against full scans, and whole runs against plain loops and SQL."""

import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from steadfold.llm import centroids


def plain(rows, k, rounds, dimension, scale=1024):
    """(vec_id, cluster, distance) by the definition."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    centres = [v for _, v in first]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        owner = [nearest(v)[1] for _, v in kept]
        for n in range(len(centres)):
            own = [v for (_, v), o in zip(kept, owner) if o == n]
            if own:
                centres[n] = [sum(x) // len(own) for x in zip(*own)]
    return sorted((repr(i), *reversed(nearest(v))) for i, v in kept), centres


@given(st.integers(0, 10_000), st.integers(1, 9), st.integers(0, 4), st.sampled_from([3, 40, 1 << 26]))
@settings(max_examples=60, deadline=None)
def test_bounds_against_full_scans(seed, k, bounds, spread):
    """Few and small whole numbers, so that ties abound; after every move the state's nearest one is the scan's, and its bounds hold."""
    random = np.random.default_rng(seed)
    v = random.integers(-spread, spread, (60, 4))
    centres = random.integers(-spread, spread, (k, 4))
    bounds = min(bounds, k - 1)
    state = centroids.scanned(v, centres, bounds)
    for _ in range(6):
        later = centres + random.integers(-max(1, spread // 20), max(2, spread // 20), (k, 4)) * random.integers(0, 2, (k, 1))
        drift = np.sqrt(((later - centres) ** 2).sum(axis=1)) * (1 + centroids.SLACK)
        centres, bounds = later, max(min(1, bounds), bounds - int(random.integers(0, 2)))
        state = centroids.moved(state, v, centres, drift, bounds)
        d = ((v[:, None] - centres[None]) ** 2).sum(axis=2)
        assert state.cluster.tolist() == d.argmin(axis=1).tolist()
        root = np.sqrt(d)
        for i in range(len(v)):
            named = {int(state.cluster[i]), *state.near[i].tolist()}
            assert len(named) == 1 + bounds and state.upper[i] >= root[i, state.cluster[i]]
            assert all(lo <= root[i, c] for lo, c in zip(state.lower[i], state.near[i]))
            assert all(state.lower[i, -1] <= root[i, c] for c in range(k) if c not in named)


def test_distances_are_exact():
    random = np.random.default_rng(5)
    for spread in (1000, centroids.LARGEST):
        v, c = random.integers(-spread, spread, (50, 64)), random.integers(-spread, spread, (7, 64))
        assert centroids.squared(v, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in v]


SCHEMA = "vec_id long, embedding array<float>, cluster string, v string, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], "c", "v", 1) for i, v in rows], SCHEMA)


def test_against_plain_loop(spark):
    random = np.random.default_rng(1)
    rows = [(i, random.integers(-3, 4, 5).astype(float).tolist()) for i in range(150)] + [(7, [0.5] * 5)] * 40 + [(None, [1.0, 2, 3, 4, 5]), (200, [0.1, None, 0, 0, 0]), (201, None), (202, []), (203, [float("nan")] * 5), (204, [float("inf"), 0, 0, 0, 0]), (205, [1.0] * 6), (206, [-0.25, 0, 0, 0, 0])]
    for k in (1, 2, 8, 20):
        found, centres = centroids.cluster(table(spark, rows), k=k, dimension=5)
        expected, means = plain(rows, k, 10, 5)
        assert sorted((repr(r.vec_id), r.cluster, r.distance) for r in found.collect()) == expected
        assert centres.tolist() == means


def test_few_vectors_and_none(spark):
    few = [(1, [0.0, 1.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0])]
    found, centres = centroids.cluster(table(spark, few), dimension=2)
    assert sorted(r.distance for r in found.collect()) == [0, 0, 0] and len(centres) == 3
    found, centres = centroids.cluster(table(spark, []), dimension=2)
    assert found.count() == 0 and centres.shape == (0, 2) and found.columns == ["vec_id", "cluster", "distance"]
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(table(spark, [(1, [1e9, 0.0])]), dimension=2)


def test_query_against_sql(spark, tmp_path):
    random = np.random.default_rng(2)
    rows = [(i, (random.normal(0, 0.2, 64) + i % 9 / 8).tolist()) for i in range(300)] + [(5, [0.25] * 64)] * 100 + [(None, [0.1] * 64), (301, [0.1] * 63), (302, None), (303, [None] * 64), (304, [float("nan")] * 64)]
    for n, some in enumerate((rows, rows[-3:])):
        path = f"{tmp_path}/{n}"
        table(spark, some).coalesce(2).write.parquet(f"{path}/embeddings.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
        expected = con.sql(centroids.SQL)
        found = centroids.op13_centroids(spark, path)
        assert found.columns == expected.columns
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected.fetchall()))
