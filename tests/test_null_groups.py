"""Null groups are groups: every function of splits, merged labels, and the registered queries on tables with nulls against their SQL."""

import collections

import pytest
from pyspark.sql import functions as F

from quillon import plans
from quillon.operators import dedup as D
from quillon.operators import draws as W
from quillon.operators import splits as S
from quillon.functions.hashing import uniform

from .oracle import TABLES, compare


def rows(spark):
    return spark.createDataFrame([(i, [None, "a", "b", "c"][i % 4], ["x", None][i % 2]) for i in range(40)], "id long, g string, c string").repartition(3)


def test_every_row_stays(spark):
    df = rows(spark)
    n = df.groupBy("g").agg(F.count("*").alias("n"))
    whole = n.withColumn("cap", F.lit(100))
    assert S.hash_ranked(df, ["g"], "s", "id").count() == S.hash_ranked(df, ["g", "c"], "s", "id").count() == S.hash_ranked(df, [], "s", "id").count() == 40
    assert S.placed(df, ["g"], ["id"]).count() == S.in_order(df, ["id"]).count() == 40
    assert S.ratio_split(df, ["g"], "s", "id").count() == 40
    assert S.group_split(df, "g", "s").count() == 40
    assert S.capped(df, ["g"], whole, "s", "id").count() == 40
    assert S.capped(df, ["g"], n.withColumn("cap", F.lit(3)), "s", "id").groupBy("g").count().collect() == [(g, 3) for g in [r.g for r in S.capped(df, ["g"], n.withColumn("cap", F.lit(3)), "s", "id").groupBy("g").count().collect()]]
    for cap in (S.train_cap(S.class_counts(df, "g"), 100, 1), S.eval_cap(S.class_counts(df, "g"), 400), S.rebalance_cap(S.class_counts(df, "g"), 1)):
        assert S.capped(df, ["g"], cap, "s", "id").count() == 40
    cells = df.withColumn("cell", F.when(F.col("id") % 8 < 4, "p").otherwise("q"))
    assert S.equal_cells(cells, "g", "cell", ["p", "q"], 100, "s", "id").count() == 40
    assert {r.g for r in S.held_out_labels(df, "g", "s", 0.99).collect()} < {"a", "b", "c"}


def test_shares_of_a_null_group(spark):
    got = collections.Counter((r.g, r.split) for r in S.ratio_split(rows(spark), ["g"], "s", "id", 0.2, 0.3).collect())
    assert all(got[g, s] == k for g in (None, "a", "b", "c") for s, k in (("test", 2), ("val", 3), ("train", 5)))


def test_merged_labels(spark):
    df = spark.createDataFrame([("A_b",), ("a b",), (None,), (None,)], "label string")
    got = D.merged_labels(df, "label", F.lower(F.translate("label", "_", " "))).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("A_b", "A_b"), ("a b", "A_b"), (None, None)], key=str)


def test_struct_keys_tell_nulls_apart(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "a", None), (3, None, "a")], "id long, x string, y string").withColumn("k", F.struct("x", "y"))
    assert sorted(r.id for r in D.first_by_priority(df, "k", ["id"]).collect()) == [1, 2]


@pytest.mark.parametrize("bins", [4096, 2])
def test_draws_follow_the_weights(spark, monkeypatch, bins):
    monkeypatch.setattr(W, "BINS", bins)
    weights = {0: 0, 1: 1, 2: 5, 3: 10, 4: 84, 5: None, 6: -3}
    df = spark.createDataFrame([(g, i, w) for g in ("a", None) for i, w in weights.items()] + [("none", 1, 0)], "g string, i long, w long")
    draws = spark.range(4000).select(F.col("id").alias("d"), F.element_at(F.array(F.lit("a"), F.lit(None), F.lit("none"), F.lit("absent")), (F.col("id") % 4 + 1).cast("int")).alias("g"))
    out = W.weighted_draws(df, "i", F.col("w"), draws, "d", ["g"], uniform("u", F.col("d")), "s").collect()
    assert sorted(r.d for r in out) == list(range(4000))
    n = collections.Counter((r.g, r.i) for r in out)
    for g in ("a", None):
        assert n[g, 0] == n[g, 5] == n[g, 6] == 0 and all(abs(n[g, i] / 1000 - w / 100) < 0.04 for i, w in weights.items() if w and w > 0)
    assert n["none", None] == n["absent", None] == 1000


def test_draws_of_many_rows(spark):
    """One row with half of all weight, many rows with little, and equal draws take equal rows."""
    df = spark.range(20_000).select(F.col("id").alias("i"), F.when(F.col("id") == 7, 20_000).otherwise(1).alias("w"))
    draws = spark.range(1000).select(F.col("id").alias("d"), (F.col("id") / 1000).alias("u"))
    out = {r.d: r.i for r in W.weighted_draws(df, "i", F.col("w"), draws, "d", [], F.col("u"), "s").collect()}
    assert len(out) == 1000 and abs(sum(i == 7 for i in out.values()) - 500) < 3 and len(set(out.values())) > 480


QUERIES = [
    "label_merge", "ratio_split", "carve_val", "carve_val_rows", "group_split", "zero_shot_holdout", "balance_train", "balance_eval", "rebalance", "equal_cell_sample", "equal_negatives",
    "source_quota_rows", "seeded_take", "inverse_frequency_draws", "three_level_draws", "mcq_collapse", "hard_negative_mix", "distractor_labels",
]


@pytest.fixture(scope="module")
def with_nulls(spark, sf, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("nulls"))
    some = lambda c, k, m: F.when(F.xxhash64(k) % m != 0, F.col(c)).alias(c)
    change = {
        "documents": {"lang": ("doc_id", 5), "source": ("doc_id", 3), "text": ("doc_id", 11)},
        "orders": {"o_orderstatus": ("o_orderkey", 4), "o_orderpriority": ("o_orderkey", 6)},
        "part": {"p_name": ("p_partkey", 5), "p_brand": ("p_partkey", 3)},
        "conversations": {"conv_id": ("turn", 5)},
    }
    for t in TABLES:
        df = spark.read.parquet(f"{sf}/{t}.parquet")
        df = df.select(*(some(c, *change[t][c]) if c in change.get(t, {}) else c for c in df.columns))
        df.coalesce(1).write.parquet(f"{at}/dir/{t}")
    import pathlib

    for t in TABLES:  # one file each, as the tables are
        (file,) = pathlib.Path(f"{at}/dir/{t}").glob("*.parquet")
        file.rename(f"{at}/{t}.parquet")
    return at


@pytest.mark.parametrize("name", QUERIES)
def test_queries_with_null_groups(spark, with_nulls, name):
    compare(spark, with_nulls, plans.QUERIES[name], plans.ORACLES[name])
