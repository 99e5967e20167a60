"""Tables that `cut` and `stored` give know their rows: asking whether one is small starts no job on the driver."""

import pytest
from pyspark.sql import functions as F

from quillon.llm.common import cut, discard, maybe_broadcast, small, stored


def jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().nextJobId()


@pytest.mark.parametrize("rows", [0, 1, 100])
def test_small_starts_no_job(spark, rows):
    plain = spark.range(100).where(F.col("id") < rows)
    for df in (plain, plain.groupBy("id").count()):
        for table in (cut(df), stored(df)):
            before = jobs(spark)
            assert small(table, rows) and not small(table, rows - 1)
            maybe_broadcast(table, 10)
            assert jobs(spark) == before
            assert table.count() == rows


def test_what_is_made_of_a_counted_table_is_counted_anew(spark):
    table = stored(spark.range(100).withColumn("_rows", F.lit(1)))
    assert not small(table, 99) and small(table.where("id < 10"), 10) and small(table.select("_rows").limit(5), 5)
    discard(table)
