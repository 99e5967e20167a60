"""Moments of the hashed draws, the bootstrap against one that copies every row, and spans against the predicate of pairs."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import hashing as H
from quillon.operators import batching as B
from quillon.operators import calibration as C


def moments(spark, make, n=4000):
    return tuple(spark.range(n).select(make(F.col("id")).alias("x")).agg(F.avg("x"), F.var_samp("x")).first())


def test_normal_and_gamma(spark):
    m, v = moments(spark, lambda i: H.normal("n", i))
    assert abs(m) < 0.06 and abs(v - 1) < 0.08
    for a in (0.3, 1.0, 4.0, 60.0):
        m, v = moments(spark, lambda i: H.gamma("g", F.lit(a), i, a))
        assert abs(m - a) < 5 * math.sqrt(a / 4000) and abs(v / a - 1) < 0.15


@pytest.mark.parametrize("n", [1, 7, 100, 101, 5000])
def test_poisson(spark, n):
    m, v = moments(spark, lambda i: C.poisson("p", F.lit(n), i, n))
    assert abs(m - n) < 5 * math.sqrt(n / 4000) and abs(v / n - 1) < 0.15


def test_dirichlet(spark):
    p = [0.7, 0.2, 0.1, 0.0]
    rows = spark.range(300).select(F.col("id"), F.lit(0).alias("y"), F.array(*map(F.lit, p)).alias("p"))
    out = C.dirichlet_rewards(rows, "id", 8, 50.0, "d")
    assert out.count() == 2400
    one = out.groupBy("id").agg(F.avg("advantage").alias("m"), F.stddev_samp("advantage").alias("s")).agg(F.max(F.abs("m")), F.min("s"), F.max("s")).first()
    assert one[0] < 1e-9 and one[1] == pytest.approx(1) and one[2] == pytest.approx(1)
    # the mean of ln q is digamma(kappa p) - digamma(kappa); the spherical score of p is near that of the mean
    assert out.agg(F.avg("reward")).first()[0] == pytest.approx(math.log(0.7) + 0.5 * 0.7 / math.sqrt(0.54), abs=0.03)
    flat = C.dirichlet_rewards(rows.limit(1).withColumn("p", F.array(F.lit(1.0))), "id", 3, 50.0, "d").collect()
    assert [(r.reward, r.advantage) for r in flat] == [(0.5, 0.0)] * 3


def test_bootstrap_against_copies(spark):
    """Rows drawn one by one give the same interval, within the noise of 2000 resamples."""
    rows = spark.range(150).select(F.col("id"), (F.col("id") % 5 < 3).cast("int").alias("v"))
    copies = rows.select("v", "id", F.explode(F.sequence(F.lit(0), F.lit(1999))).alias("b")).withColumn("k", C.poisson("each", F.lit(1), F.col("b"), F.col("id")))
    old = copies.groupBy("b").agg((F.sum(F.col("k") * F.col("v")) / F.sum("k")).alias("mean"))
    new = C.bootstrap_means(rows, "v", "s", 2000)
    assert new.count() == 2000
    for q in (0.025, 0.5, 0.975):
        assert new.agg(F.percentile("mean", q)).first()[0] == pytest.approx(old.agg(F.percentile("mean", q)).first()[0], abs=0.012)


def test_bootstrap_of_few(spark):
    rows = spark.createDataFrame([(None,), (2.0,)], "v double")
    means = {r.mean for r in C.bootstrap_means(rows, "v", "s", 50).collect()}
    assert means == {2.0}
    assert C.bootstrap_means(rows.where("false"), "v", "s", 50).count() == 0


def test_spans_are_the_predicate(spark):
    rows = spark.createDataFrame([(1, 3, [2, 4]), (2, 1, [1]), (3, 5, [3, 1, 2])], "id long, a int, branches array<int>")
    spans = B.visible_spans(rows, "id", "a", "branches")
    every = B.branch_layout(rows, "id", "a", "branches")
    every.createOrReplaceTempView("layout")
    want = {tuple(r) for r in spark.sql(f"select q.id, q.pos, k.pos from layout q join layout k on q.id = k.id and {B.visible()}").collect()}
    pairs = spans.join(every.select("id", F.col("pos").alias("k")), "id").where(B.sees(F.col("k")))
    assert {tuple(r) for r in pairs.select("id", "pos", "k").collect()} == want
    assert spans.agg(F.sum("seen")).first()[0] == len(want)
