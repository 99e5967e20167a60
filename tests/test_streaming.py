"""Streams against the batch results they stand for."""

from pyspark.sql import functions as F

from quillon.streaming import telemetry as S


def test_rolling_state(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = S.event_stream(spark, sf)
    out = events.groupBy("event_type").transformWithStateInPandas(S.RollingMean(200), "event_type string, n long, mean double", "Update", "None")
    got = {r.event_type: (r.n, round(r["mean"], 6)) for r in S.drained(out, "update").collect()}
    rows = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id").collect()
    want = {}
    for r in rows:
        want.setdefault(r.event_type, []).append(r.value)
    assert got == {k: (200, round(sum(v[-200:]) / 200, 6)) for k, v in want.items()}


def test_sessions_of_a_stream(spark, sf):
    got = S.drained(S.sessions(S.event_stream(spark, sf)), "append")
    batch = S.sessions(spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    late = batch.agg(F.max("end")).first()[0]
    done = {(r.user_id, r.start, r.n) for r in batch.collect() if (late - r.end).total_seconds() > 7200}
    assert done <= {(r.user_id, r.start, r.n) for r in got.collect()}


def test_step_lines(spark):
    lines = [
        "[ep 2/3]  30/100  (130/300)  loss 0.51  mono 0.02  lr 1.0e-04  3.5 it/s  9.5GiB  ETA 12m  [data_wait 1% | alloc_retries 2]",
        "[ep 2/3]  31/100  (131/300)  loss 0.50  mono 0.02  lr 1.0e-04  3.5 it/s  9.5GiB  ETA 12m",
        "saved",
    ]
    got = S.parsed_steps(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy("step").collect()
    assert [(r.epoch_step, r.step, r.loss, r.data_wait, r.retries) for r in got] == [(30, 130, 0.51, 1, 2), (31, 131, 0.5, None, None)]


def test_sampling_stream(spark):
    rows = spark.range(7).select("id")
    stream = S.sampling_stream(spark, rows, "id", "s", per_batch=40, workers=4)
    assert stream.isStreaming
    a, b = ({(r.worker, r.draw): r.id for r in S.drained(stream, "append").collect()} for _ in range(2))
    assert a == b and len(a) == 40 and set(a.values()) <= set(range(7)) and len({w for w, _ in a}) == 4
