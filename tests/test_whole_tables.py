"""Queries that must cover every row of their tables."""

import collections

from quillon import plans


def test_hard_negatives(spark, sf):
    rows = {r.p_partkey: r for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    own, every = collections.defaultdict(set), {r.p_name for r in rows.values()}
    for r in rows.values():
        own[r.p_brand].add(r.p_name)
    got = collections.defaultdict(list)
    for r in plans.QUERIES["hard_negatives"](spark, sf).collect():
        got[r.p_partkey, r.kind].append(r.label)
    for k, r in rows.items():
        same, other = got[k, "same"], got[k, "any"]
        assert len(same) == min(4, len(own[r.p_brand]) - 1) and len(other) == min(3, len(every) - 1 - len(same))
        assert len({r.p_name, *same, *other}) == 1 + len(same) + len(other)
        assert set(same) <= own[r.p_brand] and set(other) <= every
    assert {x for v in got.values() for x in v} == every


def test_drawn_ranks(spark):
    from pyspark.sql import functions as F

    from quillon.plans.options import drawn_ranks

    for n in (1, 2, 4, 9):
        drawn = spark.range(900).select(drawn_ranks("t", F.col("id"), F.lit(n), F.array(F.lit(0)), 3).alias("d")).collect()
        assert all(len(r.d) == len(set(r.d)) == min(3, n - 1) and 0 not in r.d and max(r.d, default=0) <= n - 1 for r in drawn)
    share = collections.Counter(x for r in drawn for x in r.d)
    assert all(abs(share[x] / 900 - 3 / 8) < 0.06 for x in range(1, 9))


def test_other_tables_are_whole(spark, sf):
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert plans.QUERIES["late_interaction"](spark, sf).select("vec_id").distinct().count() == n
    own = collections.defaultdict(set)
    for r in spark.read.parquet(f"{sf}/part.parquet").collect():
        own[r.p_brand].add(r.p_name)
    assert all(r["first"] not in own[r.p_brand] for r in plans.QUERIES["foreign_without_own"](spark, sf).collect())
    suite = {r.grp: r.n for r in plans.QUERIES["validation_suite"](spark, sf).collect()}
    assert suite == {g: min(500, spark.read.parquet(f"{sf}/{t}.parquet").count()) for g, t in (("paraphrase/all", "benchmark"), ("oos/all", "documents"), ("score/orders", "orders"))}
