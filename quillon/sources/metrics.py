"""An idempotent sink for the metrics of streams: a batch that is replayed changes nothing.

Rows of a batch go to a folder of their own, run=<run>/batch=<id>/version=<n>,
where n is one more than the versions that are there, and only then a line of
the manifest names it. Readers see the latest version of each run and batch
that the manifest names: a writer that died before the manifest leaves rows
that no one reads, one that died after it and replays the batch gives a second
version in place of the first. Nothing is ever deleted or overwritten.

As in a log of metrics only numbers are kept: numeric and boolean columns as
doubles, beside `step` and `kind`; others are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from .jsonl import latest_by

KEPT = ("step", "kind")
MANIFEST = "run string, batch bigint, version bigint, rows bigint"


def numbers(rows: DataFrame) -> DataFrame:
    """step and kind as they are, other numeric and boolean columns as doubles, and no others."""

    def kept(f: T.StructField) -> Column | None:
        if f.name in KEPT:
            return F.col(f.name)
        return F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, (T.NumericType, T.BooleanType)) else None

    return rows.select(*(c for c in map(kept, rows.schema.fields) if c is not None))


def append_metrics(rows: DataFrame, path: str) -> None:
    """Adds the numbers of rows to a folder of JSON Lines."""
    numbers(rows).write.mode("append").json(path)


def _versions(spark: SparkSession, folder: str) -> int:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return len(store.listStatus(at)) if store.exists(at) else 0


def write_batch(rows: DataFrame, batch: int, path: str, run: str) -> None:
    """A new version of a batch, and then its line in the manifest."""
    spark, folder = rows.sparkSession, f"{path}/rows/run={run}/batch={batch}"
    version = _versions(spark, folder) + 1
    kept = numbers(rows)
    kept.write.json(f"{folder}/version={version}")
    n = spark.read.schema(kept.schema).json(f"{folder}/version={version}").count()
    line = spark.createDataFrame([(run, batch, version, n)], MANIFEST)
    line.coalesce(1).write.mode("append").json(f"{path}/manifest")


def metrics_sink(stream: DataFrame, path: str, run: str, checkpoint: str) -> DataStreamWriter:
    """Writes each batch of a stream as `write_batch` does; the run's name must not change between restarts."""
    return stream.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, batch, path, run)).option("checkpointLocation", checkpoint)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(run, batch, version, rows): the latest version of each batch."""
    lines = spark.read.schema(MANIFEST).json(f"{path}/manifest")
    latest = latest_by(lines.select(F.struct("run", "batch").alias("_batch"), "version", "rows"), "_batch", "version")
    return latest.select("_batch.*", "version", "rows")


def read_metrics(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The rows of the latest versions that the manifest names, with their run and batch."""
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    keys = T._parse_datatype_string("run string, batch bigint, version bigint")
    every = spark.read.schema(T.StructType([*wanted.fields, *keys.fields])).option("basePath", f"{path}/rows").json(f"{path}/rows")
    return every.join(manifest(spark, path).drop("rows"), ["run", "batch", "version"], "left_semi").drop("version")
