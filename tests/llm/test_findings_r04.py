"""Findings of round 4: what the joins by shingle send through the driver, and that they lose nothing on their way around it."""

import random

import pytest

from quillon.llm import jaccard_join as J

from .test_jaccard_join import brute, cluster, run


def broadcast_rows(spark, after):
    """Rows of the largest broadcast of the executions numbered above `after`, and the last one's number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, most, last = spark._jsparkSession.sharedState().statusStore(), 0, after
    seen = store.executionsList()
    for i in range(seen.size()):
        k = seen.apply(i).executionId()
        last = max(last, k)
        if k <= after:
            continue
        values, nodes = store.executionMetrics(k), store.planGraph(k).allNodes()
        for n in (nodes.apply(j) for j in range(nodes.size())):
            if n.name() == "BroadcastExchange":
                for m in (n.metrics().apply(j) for j in range(n.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most, last


@pytest.mark.parametrize("few,lot", [(20_000, 256), (0, 3)])
def test_no_broadcast_grows_with_the_partitions(spark, monkeypatch, few, lot):
    """a frequent shingle's sets were copied once for each shuffle partition, and the planner, which saw the size before that, broadcast the copies."""
    monkeypatch.setattr(J, "FEW", few, raising=False)
    monkeypatch.setattr(J, "LOT", lot)
    rng = random.Random(4)
    rows = list(enumerate(cluster(rng, 80, 40, 3) + cluster(rng, 30, 40, 2) + ["", None, "one two", "one two"]))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    _, last = broadcast_rows(spark, -1)
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        found = run(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == brute(rows)
    most, _ = broadcast_rows(spark, last)
    assert 0 < most <= 5 * len(rows)
