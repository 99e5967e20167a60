"""Lloyd rounds against plain Python, ties, unusable vectors, repeated and null ids."""

import hashlib
import math
import random

import pytest

from quillon.llm import centroids

KIND = "vec_id long, embedding array<float>, cluster int, _id int, _vector string"


def brute(rows, k, rounds, width):
    """{vec_id: (cluster, distance, cluster_inertia, inertia, hash)} for distinct ids."""
    ok = {i: [math.floor(256 * x) for x in v] for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)}
    c = [ok[i] for i in sorted(ok, key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())[:k]]
    for last in range(rounds + 1):
        at = {i: min((sum((a - b) ** 2 for a, b in zip(v, x)), n) for n, x in enumerate(c)) for i, v in ok.items()}
        if last < rounds:
            for n in range(len(c)):
                own = [ok[i] for i in ok if at[i][1] == n]
                c[n] = [sum(x) // len(own) for x in zip(*own)] if own else c[n]
    sums = [sum(d for d, m in at.values() if m == n) for n in range(len(c))]
    return {i: (n, d, sums[n], sum(sums), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, (d, n) in at.items()}


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 9, 9, "x") for i, v in rows], KIND).repartition(3)


def got(df):
    return {r.vec_id: (r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()}


def vectors(n, width, seed):
    rng = random.Random(seed)
    return [(i, [rng.randrange(-40, 40) / 8 for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize(("n", "k"), [(60, 5), (3, 5), (40, 1)])
def test_rounds(spark, n, k):
    rows = vectors(n, 3, n)
    assert got(centroids.lloyd(frame(spark, rows), k, 3, 3)) == brute(rows, k, 3, 3)


def test_unusable_and_ties(spark):
    good = vectors(12, 2, 1)
    bad = [(100, None), (101, []), (102, [1.0]), (103, [1.0, None]), (104, [1.0, float("nan")]), (105, [float("-inf"), 0.0]), (106, [1.0, 2.0, 3.0])]
    # equal vectors make equal centroids: the smaller number takes all, the other stays as it is
    same = [(200 + i, [0.5, -0.5]) for i in range(30)]
    rows = good + bad + same
    assert got(centroids.lloyd(frame(spark, rows), 8, 2, 2)) == brute(rows, 8, 2, 2)


def test_repeated_null_and_huge(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 4.0]), (2**60 + 1, [1e30, -1e30])]
    out = centroids.lloyd(frame(spark, rows), 2, 1, 2).collect()
    assert sorted((r.vec_id for r in out), key=str) == sorted([1, 1, None, 2**60 + 1], key=str)
    assert all(r.distance >= 0 for r in out)


def test_empty(spark):
    for rows in ([], [(1, None)]):
        out = centroids.lloyd(frame(spark, rows), 4, 2, 2)
        assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and not out.collect()
