"""Run telemetry with Structured Streaming: parsed log steps, counters, windows, sessions and exactly-once results."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.hashing import uniform
from ..operators.splits import hash_ranked
from ..session import cut, shared_dir

# fixed values: the form of a training step's log line; the bracketed tail is optional
STEP_LINE = (
    r"\[ep (\d+)/(\d+)\]\s+(\d+)/(\d+)\s+\((\d+)/(\d+)\)\s+loss\s+([\d.]+)\s+"
    r"mono\s+([\d.]+)\s+lr\s+([\d.e+-]+)\s+([\d.]+) it/s\s+([\d.]+)GiB\s+ETA\s+(\d+)m"
    r"(?:\s+\[data_wait (\d+)% \| alloc_retries (\d+)\])?"
)
STEP_FIELDS = ("epoch", "epochs", "epoch_step", "epoch_steps", "step", "steps", "loss", "mono", "lr", "rate", "gib", "eta_min", "data_wait", "retries")


def event_stream(spark: SparkSession, sf_dir: str, files: str = "events.parquet") -> DataFrame:
    """The events as a stream; event time becomes a timestamp, since watermarks need one."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    return stream.parquet(f"{sf_dir}/{files}*").withColumn("ts", F.col("ts").cast("timestamp"))


def parsed_steps(lines: DataFrame, column: str = "value") -> DataFrame:
    """Numbers of the lines that report a step; the parts of an absent tail are null."""
    rows = lines.where(F.col(column).rlike(STEP_LINE))
    pick = lambda i: F.nullif(F.regexp_extract(column, STEP_LINE, i), F.lit("")).cast("double")
    return rows.select(*(pick(i + 1).alias(n) for i, n in enumerate(STEP_FIELDS)))


def status(age_seconds):
    """live under two minutes, idle under an hour, then dead."""
    return F.when(age_seconds < 120, "live").when(age_seconds < 3600, "idle").otherwise("dead")


def tumbling(events: DataFrame, size: str, delay: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low")).select(F.col("window.start").alias("start"), "event_type", "n", "mean", "low")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def counters(events: DataFrame) -> DataFrame:
    """Running number and hits by type."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum((F.col("value") > 10).cast("int")).alias("correct"))


def once_per_episode(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A finished episode counts once, though it may be reported again within the delay."""
    return events.where("event_type = 'purchase'").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "event_id"])


class RollingMean(StatefulProcessor):
    """Mean of the last `size` values of each key, kept as a bounded list."""

    def __init__(self, size: int = 200):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [r[0] for r in self.last.get()] if self.last.exists() else []
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])["value"].tolist()
        kept = (kept + new)[-self.size :]
        self.last.put([(float(v),) for v in kept])
        yield pd.DataFrame({"event_type": [key[0]], "n": [len(kept)], "mean": [sum(kept) / len(kept)]})

    def close(self) -> None:
        pass


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what there is and gives the result as a table in the shared folder, with its checkpoint beside it.

    In update mode every batch has a folder of its own, which a replay of the batch replaces. A stream without a batch gives no rows.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", at + "/state")
    if mode == "append":
        out = out.format("parquet").option("path", at + "/rows")
    else:  # every batch holds all rows that changed; the last batch of a complete result is the result

        def keep(rows: DataFrame, batch: int) -> None:
            rows.write.mode("overwrite").parquet(at + ("/rows" if mode == "complete" else f"/rows/_batch={batch}"))

        empty = spark.createDataFrame([], stream.schema)
        empty.write.parquet(at + ("/rows" if mode == "complete" else "/rows/_batch=-1"))
        out = out.foreachBatch(keep)
    out.start().awaitTermination()
    if mode == "update":
        return spark.read.schema(stream.schema).option("basePath", at + "/rows").parquet(at + "/rows/_batch=*").drop("_batch")
    return spark.read.schema(stream.schema).parquet(at + "/rows")


def sampling_stream(spark: SparkSession, rows: DataFrame, key: str, seed: str, per_batch: int = 1000, workers: int = 4) -> DataFrame:
    """An endless stream of draws with replacement from a table: (worker, draw, key); a worker's draws follow from its seed alone.

    The table is ranked once; a draw is a rank, so each batch joins its draws with the ranks.
    """
    ranked = cut(hash_ranked(rows.select(key), [], seed, key).select(F.col("_rank").alias("_at"), "_n", key))
    n = ranked.agg(F.max("_n")).first()[0] or 0
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", per_batch).option("numPartitions", workers).load()
    worker = F.pmod("value", F.lit(workers)).alias("worker")
    draws = ticks.select(worker, F.floor(F.col("value") / workers).alias("draw"))
    at = (F.floor(uniform(seed, F.col("worker"), F.col("draw")) * n) + 1).cast("long")
    return draws.withColumn("_at", at).join(ranked.select("_at", key), "_at").select("worker", "draw", key)


def interval_metrics(steps: DataFrame, size: int) -> DataFrame:
    """Means over bands of `size` steps, as a log that resets after each line reports them."""
    return steps.groupBy(F.floor(F.col("step") / size).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("loss"), F.round(F.min("loss"), 6).alias("best"))
