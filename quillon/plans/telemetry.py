"""Telemetry over events: the same rows from streams and from batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.hashing import digest_sql, uniform_sql
from ..session import cut, shared_dir
from ..sources import metrics as M
from ..sources.logs import log_lines, log_stream
from ..streaming import telemetry as S
from .registry import query, table


@query("select event_type, count(*) as n, sum((value > 10)::int)::bigint as correct from events group by event_type")
def stream_counters(spark, sf):
    return S.drained(S.counters(S.event_stream(spark, sf)), "complete")


@query("select date_trunc('day', ts) as start, event_type, count(*) as n, round(avg(value),6) as mean, min(value) as low from events group by all")
def stream_daily_windows(spark, sf):
    out = S.drained(S.tumbling(S.event_stream(spark, sf), "1 day"), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    """with g as (select *, (ts - lag(ts) over w >= interval 30 minute or lag(ts) over w is null)::int as new from events window w as (partition by user_id order by ts, event_id)),
    s as (select *, sum(new) over (partition by user_id order by ts, event_id) as s from g) select user_id, min(ts) as start, max(ts) + interval 30 minute as end, count(*) as n, round(sum(value),6) as total from s group by user_id, s"""
)
def session_windows(spark, sf):
    """Batch form of the session windows; a stream emits the same rows once the watermark has passed them."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n", "total")


@query("select user_id, event_id from events where event_type = 'purchase'")
def stream_once_per_episode(spark, sf):
    return S.drained(S.once_per_episode(S.event_stream(spark, sf)).select("user_id", "event_id"), "append")


@query("select event_id, round(avg(value) over (partition by event_type order by ts, event_id rows between 199 preceding and current row),9) as rolling from events")
def rolling_mean(spark, sf):
    """Means of the last 200 values of a type. Types are few, so each is cut into ranges of time, which take the 199 rows before them along."""
    order, before = ["ts", "event_id"], 199
    e = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    e = cut(e.repartitionByRange("event_type", *order).withColumn("_range", F.spark_partition_id()))
    row = F.struct(*order, "value")
    last = Window.partitionBy("event_type", "_range").orderBy(*(F.desc(c) for c in order))
    tails = e.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= before).groupBy("event_type", "_range").agg(F.collect_list(row).alias("_tail"))
    # every range of a type has a row, so no more ranges than rows are needed before one
    earlier = F.flatten(F.collect_list("_tail").over(Window.partitionBy("event_type").orderBy("_range").rowsBetween(-before, -1)))
    tails = tails.withColumn("_tail", F.slice(F.reverse(F.array_sort(earlier)), F.lit(1), F.lit(before)))
    carried = tails.select("event_type", "_range", F.explode("_tail").alias("_t")).select("event_type", "_range", "_t.*").withColumn("_own", F.lit(False))
    rows = e.withColumn("_own", F.lit(True)).unionByName(carried)
    w = Window.partitionBy("event_type", "_range").orderBy(*order).rowsBetween(-before, 0)
    return rows.withColumn("rolling", F.round(F.avg("value").over(w), 9)).where("_own").select("event_id", "rolling")


@query("select (event_id // 500)::bigint as band, count(*) as n, round(avg(value),6) as loss, round(min(value),6) as best from events group by 1")
def interval_metrics(spark, sf):
    return S.interval_metrics(table(spark, sf, "events").select(F.col("event_id").alias("step"), F.col("value").alias("loss")), 500)


@query(
    """with l as (select user_id, max(ts) as last from events group by user_id), n as (select max(ts) as now from events)
    select user_id, case when epoch(now-last) < 120 then 'live' when epoch(now-last) < 3600 then 'idle' else 'dead' end as status from l, n"""
)
def run_status(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("last"))
    now = last.agg(F.max("last").alias("now"))
    age = F.unix_micros("now") - F.unix_micros("last")
    return last.crossJoin(F.broadcast(now)).select("user_id", S.status(age / 1e6).alias("status"))


@query("select event_id, event_type from events order by ts desc, event_id desc limit 50")
def bounded_history(spark, sf):
    return table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type")


@query("select event_type, count(*) as n, sum((props->>'k')::bigint)::bigint as k from events group by event_type")
def nested_json(spark, sf):
    """Properties parsed under a schema; text that is no JSON would be counted as skipped."""
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


@query("select event_type, arg_max(event_id, event_id) as latest, arg_max(value, event_id) as value from events group by event_type")
def latest_manifest(spark, sf):
    from ..sources.jsonl import latest_by

    e = table(spark, sf, "events").select("event_type", F.col("event_id").alias("latest"), "value")
    return latest_by(e, "event_type", "latest")


@query("select step, round(loss,6) as loss, data_wait is null as short_form from (select event_id as step, value as loss, case when event_id%2=0 then 1.0 end as data_wait from events where event_id % 5 <> 0)")
def log_steps(spark, sf):
    """Log lines written from events and parsed back; noise lines and the optional tail included."""
    i, v = F.col("event_id").cast("string"), F.col("value").cast("string")
    line = F.concat(F.lit("[ep 1/3]  7/900  ("), i, F.lit("/10000)  loss "), v, F.lit("  mono 0.1  lr 1.0e-04  3.2 it/s  9.5GiB  ETA 12m"), F.when(F.col("event_id") % 2 == 0, "  [data_wait 1% | alloc_retries 0]").otherwise(""))
    lines = table(spark, sf, "events").select(F.when(F.col("event_id") % 5 == 0, "saved a checkpoint").otherwise(line).alias("value"))
    s = S.parsed_steps(lines)
    return s.select(F.col("step").cast("long").alias("step"), F.round("loss", 6).alias("loss"), F.col("data_wait").isNull().alias("short_form"))


def _log_line(step, value):
    """A training step's line with what varies in it."""
    tail = F.when(step % 2 == 0, "  [data_wait 1% | alloc_retries 0]").otherwise("")
    return F.concat(F.lit("[ep 1/3]  7/900  ("), step.cast("string"), F.lit("/10000)  loss "), value.cast("string"), F.lit("  mono 0.1  lr 1.0e-04  3.2 it/s  9.5GiB  ETA 12m"), tail)


def _written_log(spark, sf):
    """A folder with a log of all events in order, as a Spark job writes it, and two logs that must not be taken for it."""
    at = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    e = table(spark, sf, "events").select("event_id", "value")
    line = F.when(F.col("event_id") % 5 == 0, "saved a checkpoint").otherwise(_log_line(F.col("event_id"), F.col("value")))
    ranges = e.repartitionByRange("event_id").sortWithinPartitions("event_id")
    ranges.select(line.alias("value")).write.text(f"{at}/train.log")
    for other in ("train.err.log", "dashboard.log"):
        spark.range(1).selectExpr("'not this one' as value").write.text(f"{at}/{other}")
    return at


@query(
    """with t as (select event_id, value from events order by event_id desc limit 1000), s as (select * from t where event_id % 5 <> 0 order by event_id desc limit 300)
    select event_id::bigint as step, round(value, 6) as loss, event_id % 2 <> 0 as short_form from s"""
)
def log_tail_steps(spark, sf):
    """The last 300 steps among the last 1000 lines of a log written from all events, read backwards from its end."""
    lines = log_lines(spark, _written_log(spark, sf), 1000)
    s = S.parsed_steps(lines.select(F.col("line").alias("value"))).orderBy(F.desc("step")).limit(300)
    return s.select(F.col("step").cast("long").alias("step"), F.round("loss", 6).alias("loss"), F.col("data_wait").isNull().alias("short_form"))


@query("select (event_id // 500)::bigint as band, count(*) as n, round(avg(value), 6) as loss from events where event_id % 5 <> 0 group by 1")
def log_stream_bands(spark, sf):
    """The whole log as a stream of byte ranges, its steps written by an idempotent sink and read back by the manifest, in means over 500 steps."""
    at = _written_log(spark, sf)
    steps = S.parsed_steps(log_stream(spark, at).select(F.col("line").alias("value"))).select("step", "loss", F.lit("train").alias("kind"))
    M.metrics_sink(steps, f"{at}/metrics", "one", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    rows = M.read_metrics(spark, f"{at}/metrics", "step double, loss double, kind string")
    return rows.groupBy(F.floor(F.col("step") / 500).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("loss"))


@query(f"select key as draw, doc_id from (select k as key, floor({uniform_sql('endless', 'k % 4', 'k // 4')}*n)::bigint + 1 as r from range(1000) t(k), (select count(*) as n from documents)) d join (select doc_id, row_number() over (order by {digest_sql('endless', 'doc_id')}, doc_id) as r from documents) using (r)")
def sampled_stream(spark, sf):
    """The first batch of the endless sampler: 1000 draws with replacement by four workers, each by its own seed."""
    stream = S.sampling_stream(spark, table(spark, sf, "documents"), "doc_id", "endless", 1000, 4)
    return S.drained(stream, "append").select((F.col("draw") * 4 + F.col("worker")).alias("draw"), "doc_id")
