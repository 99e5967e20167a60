"""Distractors against a comparison of all pairs, catalogues of like labels, and a large catalogue without a nested loop."""

import collections

import pytest
from pyspark.sql import functions as F

from quillon.operators import negatives as N


def words(t):
    return set(t.split())


def sim(a, b):
    return len(words(a) & words(b)) / len(words(a) | words(b)) if words(a) | words(b) else 0.0


def catalogue(spark, names):
    return spark.createDataFrame([(x,) for x in names], "label string").withColumn("w", F.filter(F.array_distinct(F.split("label", " ")), lambda x: x != ""))


ALL_ALIKE = [f"order type of kind {i}" for i in range(30)]
MIXED = [f"{a} {b}" for a in ("red", "blue", "hot", "cold", "big") for b in ("ring", "bolt", "nut", "gear")]


@pytest.mark.parametrize(("names", "k"), [(MIXED, 4), (ALL_ALIKE, 3), (ALL_ALIKE + ["solo", "lone", ""], 4), (["a", "a b", "a b c"], 5), (["x"], 3), ([], 3)])
def test_unlike_or_least_similar(spark, names, k):
    got = collections.defaultdict(list)
    for r in N.distractors(catalogue(spark, names), k).collect():
        assert r.sim == pytest.approx(sim(r.label, r.other))
        got[r.label].append((r.r, r.other))
    place = {x: i for i, x in enumerate(sorted(names))}
    for a in names:
        picked = [b for _, b in sorted(got[a])]
        safe = [b for b in names if b != a and sim(a, b) < 0.5]
        assert len(set(picked)) == len(picked) == min(k, len(names) - 1) and a not in picked
        if len(safe) >= k and len(names) < 25:
            assert set(picked) <= set(safe)
        if len(safe) < k:
            assert picked == sorted((b for b in names if b != a), key=lambda b: (sim(a, b), place[b]))[:k]


def test_draws_are_uniform(spark):
    names = [f"w{i}" for i in range(40)]
    n = collections.Counter(r.other for r in N.distractors(catalogue(spark, names), 5).collect())
    assert sum(n.values()) == 200 and len(n) > 35 and max(n.values()) < 16


def test_a_large_catalogue(spark):
    names = spark.range(100_000).select(F.concat_ws(" ", F.lit("kind"), F.col("id").cast("string"), F.pmod("id", F.lit(977)).cast("string")).alias("label"))
    out = N.distractors(names.withColumn("w", F.array_distinct(F.split("label", " "))), 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    r = out.groupBy("label").agg(F.count("*").alias("n"), F.max("sim").alias("s")).agg(F.count("*"), F.min("n"), F.max("n"), F.max("s")).first()
    assert tuple(r)[:3] == (100_000, 5, 5) and r[3] < 0.5


def test_hard_negatives(spark):
    rows = [(i, f"s{i % 3}" if i % 7 else None, f"l{i % 11}" if i % 13 else None) for i in range(60)] + [(99, "alone", "only")]
    df = spark.createDataFrame(rows, "id long, source string, label string")
    own = collections.defaultdict(set)
    for _, s, l in rows:
        if l is not None:
            own[s].add(l)
    every = set().union(*own.values())
    got = collections.defaultdict(list)
    for r in N.hard_negatives(df, "id", "source", "label", 6).collect():
        got[r.id].append((r.kind, r.label))
    for i, s, l in rows:
        same, rest = [x for k, x in got[i] if k == "same"], [x for k, x in got[i] if k == "any"]
        if l is None:
            assert not same and not rest
            continue
        assert len(same) == min(3, len(own[s]) - 1) and len(same) + len(rest) == min(5, len(every) - 1)
        assert set(same) <= own[s] and len({l, *same, *rest}) == 1 + len(same) + len(rest)
