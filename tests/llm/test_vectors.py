"""Nearest neighbours and clustering on awkward vectors, against brute force."""

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleloom.llm import centroids, neighbours, projection_forest, queries
from tests.util import SF, database, rows

SCHEMA = "vec_id long, embedding array<float>, label int, q array<int>, u long, vec string, cluster int, distance long, query_id long, rank int, score double"
REST = (1, [9], 9, "clash", 9, 9, 9, 9, 0.5)


def vectors(spark, pairs):
    return spark.createDataFrame([(i, v, *REST) for i, v in pairs], SCHEMA)


def clustered(n, dims, seed=1, centres=20):
    rng = np.random.default_rng(seed)
    at = rng.standard_normal((centres, dims))
    return (at[rng.integers(0, centres, n)] + 0.2 * rng.standard_normal((n, dims))).astype(np.float32)


def odd_pairs(dims):
    """Nulls, zeros, other lengths, non-finite components, copies, repeated rows, and ids that repeat or are null."""
    x = [[float(c) for c in v] for v in clustered(300, dims, 5)]
    pairs = list(enumerate(x))
    pairs += [(1000 + i, x[0]) for i in range(120)] + [(2000 + i, [c * 1.001 for c in x[0]]) for i in range(60)]
    pairs += [(5, x[5]), (5, x[5]), (100, x[7]), (None, x[9]), (None, x[0]), (7000, None), (7100, []), (7200, [0.0] * dims), (7300, x[3][1:])]
    pairs += [(7400, [None, *x[4][1:]]), (7500, [math.nan, *x[4][1:]]), (7600, [math.inf, *x[4][1:]])]
    return pairs


def brute_nearest(pairs, dims, every, k):
    own = {(i, tuple(v)) for i, v in pairs if v and len(v) == dims and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    keys = sorted(own, key=lambda p: (p[0] is None, p[0] or 0, p[1]))
    x = np.array([v for _, v in keys])
    out = collections.Counter()
    for i, v in keys:
        if i is None or i % every:
            continue
        d = np.sqrt(((x - np.array(v)) ** 2).sum(1))
        near = sorted((float(d[j]), key[0] is None, key[0] or 0) for j, key in enumerate(keys) if key != (i, v))[:k]
        out.update((i, r + 1, None if none else c, round(s, 9)) for r, (s, none, c) in enumerate(near))
    return out


def test_nearest_on_odd_rows(spark, monkeypatch):
    """With the budget of a full search the result is exact: ties, copies and ids as stated."""
    monkeypatch.setattr(neighbours, "RECALL", 1.0)
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 8)
    pairs = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in odd_pairs(8)]
    got = neighbours.nearest(vectors(spark, pairs), every=5, k=10)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert collections.Counter((r[0], r[1], r[2], round(r[3], 9)) for r in got.collect()) == brute_nearest(pairs, 8, 5, 10)


def test_fewer_candidates_than_asked(spark):
    got = neighbours.nearest(vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (3, [3.0, 4.0])]))
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(0, 1, 1, math.sqrt(2)), (0, 2, 3, math.sqrt(20))]
    assert neighbours.nearest(vectors(spark, [(0, [1.0, 0.0])])).count() == 0


@pytest.mark.parametrize("kind", ["clustered", "unstructured"])
def test_recall(spark, monkeypatch, kind):
    """Blocks, groups and a sample smaller than the table; fewer leaves are taken where there is structure."""
    for name, value in (("SAMPLE", 2000), ("LEAF_ROWS", 16), ("BLOCK_ROWS", 100), ("BLOCK_QUERIES", 7), ("MEASURED", 40)):
        monkeypatch.setattr(neighbours, name, value)
    x = clustered(6000, 16, centres=300) if kind == "clustered" else np.random.default_rng(2).standard_normal((6000, 16)).astype(np.float32)
    pairs = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    budgets, measure = [], neighbours._measured
    monkeypatch.setattr(neighbours, "_measured", lambda *a: budgets.append(measure(*a)) or budgets[-1])
    got = collections.Counter((r[0], r[2], round(r[3], 9)) for r in neighbours.nearest(vectors(spark, pairs), every=20).collect())
    want = collections.Counter((q, c, s) for q, _, c, s in brute_nearest(pairs, 16, 20, 10))
    assert sum(got.values()) == sum(want.values()) == 3000
    assert sum((got & want).values()) >= 0.9 * sum(want.values())
    assert kind == "unstructured" or budgets[0] < 100


def test_search_pops_nearest_leaves_first():
    x = clustered(2000, 8)
    forest = projection_forest.Forest(x, trees=3, leaves=32, seed=1)
    margin = forest.margins(x[:1].astype(float))[0]
    order, found = forest.order(margin), forest.search(margin, 96)
    assert len(set(found)) == 96 and forest.search(margin, 10) == found[:10]
    assert [order[t, leaf] for t, leaf in found] == sorted(order[t, leaf] for t, leaf in found)
    assert [leaf for _, leaf in sorted(found[:3])] == forest.place(x[:1].astype(float))[:, 0].tolist()


def brute_clusters(pairs, dims, k, rounds):
    own = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in pairs if v and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted(own, key=lambda p: (hashlib.sha256(f"2:{'' if p[0] is None else p[0]}".encode()).hexdigest(), p[1]))[:k]
    cent = [list(v) for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cent))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in own:
            groups[near(v)[1]].append(v)
        for j, vs in groups.items():
            cent[j] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    done = [(i, *near(v)) for i, v in own]
    sums = collections.Counter()
    for _, d, j in done:
        sums[j] += d
    return collections.Counter((i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, cent[j])).encode()).hexdigest()) for i, d, j in done)


@pytest.mark.parametrize("k", [7, 1000])
def test_clusters_on_odd_rows(spark, monkeypatch, k):
    """Copies leave centroids empty; more centroids than vectors; chunks smaller than a batch."""
    monkeypatch.setattr(centroids, "CHUNK", 50)
    pairs = odd_pairs(6)
    got = centroids.cluster(vectors(spark, pairs), k=k, dims=6)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == brute_clusters(pairs, 6, k, 5)


def test_tables_give_squared_distances():
    rng = np.random.default_rng(3)
    q, c = rng.integers(-500, 500, (70, 5)), rng.integers(-500, 500, (4, 5))
    assert (centroids.distances(q, c) == ((q[:, None] - c) ** 2).sum(2)).all()


def test_huge_components_are_held(spark):
    got = centroids.cluster(vectors(spark, [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)]), k=1, rounds=0)
    assert {r["distance"] for r in got.collect()} <= {0, 64 << 54, 64 << 56} and {r["inertia"] for r in got.collect()} <= {2 * 64 << 54, 5 * 64 << 54}
    with pytest.raises(ValueError, match="127"):
        centroids.cluster(vectors(spark, []), dims=128)


def test_empty_tables(spark):
    for pairs in ([], [(1, None), (100, [])]):
        assert neighbours.nearest(vectors(spark, pairs)).count() == centroids.cluster(vectors(spark, pairs)).count() == 0


def test_clusters_match_their_sql(spark):
    name = "op12_centroid_clustering"
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(database().sql(queries.ORACLE_SQL[name]).df())


def test_registered_search_is_near_brute_force(spark):
    pairs = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>")).collect()]
    got = collections.Counter((r[0], r[2], round(r[3], 9)) for r in queries.op11_nearest_neighbours(spark, SF).collect())
    want = collections.Counter((q, c, s) for q, _, c, s in brute_nearest(pairs, 64, 100, 10))
    assert sum(got.values()) == sum(want.values()) and sum((got & want).values()) >= 0.9 * sum(want.values())
