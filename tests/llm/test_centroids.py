"""Centroid clustering against plain integer arithmetic, dictionaries against what they encode."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import rows

from codescope.llm import centroids
from codescope.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def expected(vectors, k=16, n_rounds=3, components=64):
    """(id, cluster, distance) and centroids by the definition."""
    kept = []
    for i, v in vectors:
        if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [min(max(math.floor(64 * x), -centroids.BOUND), centroids.BOUND) for x in v]))
    mark = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    at = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(at))
    for _ in range(n_rounds):
        held = {}
        for _, v in kept:
            held.setdefault(near(v)[1], []).append(v)
        for c, members in held.items():
            at[c] = [sum(x) // len(members) for x in zip(*members)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], at


def test_query_equals_definition(spark):
    vectors = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assigned, at = expected(vectors)
    of_cluster = {c: sum(d for _, x, d in assigned if x == c) for c in range(16)}
    digest = lambda c: hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()
    wanted = sorted((i, c, d, of_cluster[c], sum(of_cluster.values()), digest(c)) for i, c, d in assigned)
    assert rows(QUERIES["op11_centroids"](spark, SF_DIR)) == wanted
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_DIR}/embeddings.parquet'")
    assert sorted(duck.execute(ORACLES["op11_centroids"]).fetchall()) == wanted


@pytest.mark.parametrize("shard_vectors", [1, 7, 32_768])
def test_shards_of_any_size(spark, shard_vectors):
    random.seed(3)
    vectors = [(i, [random.choice([-1.0, 0.01, 0.5, 0.51]) for _ in range(4)]) for i in range(40)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    found = centroids.cluster(df, k=5, components=4, shard_vectors=shard_vectors)
    wanted, at = expected(vectors, 5, 3, 4)
    assert rows(found.assigned) == sorted(wanted) and found.centroids == at


def test_odd_rows(spark):
    """Nulls anywhere, wrong lengths, values without bound, repeated rows, clashing columns."""
    nan, inf = float("nan"), float("inf")
    vectors = [
        (1, [1.0, -1.0]), (1, [1.0, -1.0]), (None, [0.1, 0.2]), (None, None), (2, None), (3, []), (4, [1.0]), (5, [1.0, 2.0, 3.0]),
        (6, [None, 1.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1e300, -1e300]), (10, [-0.0, 0.0]), (11, [0.1, 0.2]),
    ]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    df = df.selectExpr("*", "'!' AS id", "0 AS cluster", "0 AS distance", "'!' AS vector", "0 AS codes")
    for k in (2, 16):
        found = centroids.cluster(df, k=k, components=2)
        wanted, at = expected(vectors, k, 3, 2)
        assert rows(found.assigned) == sorted(wanted, key=lambda r: (r[0] is not None, r)) and found.centroids == at
        assert centroids.described(found).count() == 6
    assert len(at) == 6  # as many as vectors
    names = spark.createDataFrame([("a", [1.0, 2.0])], "vec_id string, embedding array<float>")
    assert rows(centroids.cluster(names, components=2).assigned) == [("a", 0, 0)]


def test_empty_table(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    for none in (df, df.where("false")):
        found = centroids.cluster(none)
        assert found.centroids == [] and centroids.described(found).count() == 0
        assert re.match("vec_id", centroids.described(found).columns[0])


def test_dictionary_is_lossless():
    rng = np.random.default_rng(5)
    for block, width in ((1, 6), (2, 6), (3, 6), (6, 6)):
        numbers = rng.integers(-4, 4, (500, width))
        codes, entries, sizes = centroids.dictionary(numbers, block)
        assert (centroids.decoded(codes, entries, sizes) == numbers).all()
        assert len(entries) == sizes.sum() and sizes.max() <= 8**block
        at = rng.integers(-4, 4, (5, width))
        cluster, distance = centroids.nearest(codes, entries, sizes, at)
        plain = ((numbers[:, None] - at[None]) ** 2).sum(axis=2)
        assert (cluster == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()
        held = np.array([numbers[cluster == c].sum(axis=0) for c in range(5)])
        assert (centroids.sums(codes, entries, sizes, cluster, 5) == held).all()


def test_whole_vectors_of_sliced_lists():
    lists = pa.array([[9.0], [0.5, -0.5], None, [1.0, None], [0.25, 0.0]], pa.list_(pa.float64())).slice(1)
    keep, numbers = centroids.whole_vectors(lists, 2, 64)
    assert keep.tolist() == [True, False, False, True] and numbers.tolist() == [[32, -32], [16, 0]]
