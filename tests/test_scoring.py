"""Array scores work out each part of a row once."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import scoring as P
from quillon.operators import calibration as C


@pytest.mark.parametrize(("score", "times"), [(P.softmax, 1), (P.normalised, 1), (P.unit, 1), (P.log_sum_exp, 1), (P.argmax, 1), (lambda z: P.cosine(z, z), 2)])
def test_argument_named_once(spark, score, times):
    """An array made by a lambda stands in the expression as often as it is given; before, each element made it anew."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    z = F.transform("v", lambda x: F.cbrt(x))
    plan = spark.createDataFrame([([1.0, 2.0],)], "v array<double>").select(score(z))._jdf.queryExecution().analyzed().toString().upper()
    assert plan.count("CBRT(LAMBDA") == times


def test_values(spark):
    v = [0.5, -2.0, 3.0, 3.0]
    df = spark.createDataFrame([(v,)], "v array<double>")
    soft, unit, lse, top, near = df.select(P.softmax(F.col("v")), P.unit(F.col("v")), P.log_sum_exp(F.col("v")), P.argmax(F.col("v")), P.cosine(F.col("v"), F.col("v"))).first()
    whole, size = sum(map(math.exp, v)), math.sqrt(sum(x * x for x in v))
    assert soft == pytest.approx([math.exp(x) / whole for x in v]) and unit == pytest.approx([x / size for x in v])
    assert (lse, top, near) == (pytest.approx(math.log(whole)), 2, pytest.approx(1.0))


def test_conformal_scores_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(i):
        seen.add(1)
        return i / 100

    rows = spark.range(99).select("id", score("id").alias("s"))
    assert tuple(C.conformal(rows, "s", 0.1, "id").first()) == (0.09, 99)
    assert seen.value == 99
