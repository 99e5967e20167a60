"""Probabilities must follow the labels' shares in the table, not those in the training sample."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.llm import quality


@pytest.mark.parametrize("per_label", [200, 4000])  # a balanced sample, and all rows
def test_quality_prior(spark, per_label):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=30)), int(rng.random() < 0.85)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")  # texts tell nothing of the label
    model = quality.fit(docs, docs.select("doc_id", "quality"), per_label=per_label)
    got = quality.judge(docs, model).agg(F.avg("probability"), F.avg((F.col("probability") >= 0.5).cast("int"))).first()
    assert abs(got[0] - 0.85) < 0.05 and got[1] > 0.9
