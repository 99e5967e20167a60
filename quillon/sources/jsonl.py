"""JSON Lines, logs and manifests: declared schemas, strict or tolerant, and partitioned sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .logs import OWN, log_lines

# fixed values: record schemas of decision corpora
SCHEMAS = {
    "intent": "text string, label string",
    "mcq": "context string, question string, options array<string>, answer_idx int, source string",
    "bool": "context string, question string, answer_idx int, source string, nli_label string, bias_w double, blind_easy array<string>",
    "score": "context string, question string, options array<string>, num_levels int, answer_idx int, level int, reversed boolean, source string",
    "diversity": "text string, label string, labels array<string>, source string, target string",
    "paraphrase": "text1 string, text2 string, is_paraphrase boolean",
    "typed_decision": "context string, question string, options array<string>, answer_idx int, qtype string, workflow string",
}


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One object a line under a declared schema; blank lines are skipped, bad lines fail the read."""
    return spark.read.schema(SCHEMAS.get(schema, schema) if isinstance(schema, str) else schema).option("mode", "FAILFAST").json(path)


def write_jsonl(rows: DataFrame, path: str, split: str | None = None, seed: str | None = None) -> None:
    """Private columns (leading underscore) are dropped; a split column becomes folders. Nothing is overwritten.

    With a seed rows are written in the order of a hash of theirs, over all files by name, so that no file holds one source.
    """
    if seed is not None:
        mixed = F.xxhash64(F.lit(seed), *rows.columns)
        rows = rows.withColumn("_mixed", mixed).repartitionByRange("_mixed").sortWithinPartitions("_mixed")
    out = rows.drop(*(c for c in rows.columns if c.startswith("_"))).write.mode("errorifexists")
    (out.partitionBy(split) if split else out).json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Adds rows to a folder of JSON Lines, as a log of metrics grows; what is there stays."""
    rows.drop(*(c for c in rows.columns if c.startswith("_"))).write.mode("append").json(path)


def append_stream(rows: DataFrame, path: str, checkpoint: str):
    """The same for a stream: each batch is added once, also after a restart from the checkpoint."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def write_filtered(rows: DataFrame, path: str, first: DataFrame | None = None) -> str:
    """Writes a version of a corpus below `path` and returns its folder; the unfiltered rows are kept once, whatever is filtered later.

    Versions are numbered folders; none is ever replaced.
    """
    spark = rows.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if first is not None and not fs.exists(fs_path(f"{path}/unfiltered")):
        write_jsonl(first, f"{path}/unfiltered")
    n = 1
    while fs.exists(fs_path(f"{path}/version={n}")):
        n += 1
    write_jsonl(rows, f"{path}/version={n}")
    return f"{path}/version={n}"


def parse_nested(rows: DataFrame, columns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Columns of JSON text parsed under their schemas: the rows where all parse, and the count of those where one does not."""
    parsed = rows.withColumns({c: F.from_json(F.col(c), s, {"mode": "PERMISSIVE"}) for c, s in columns.items()})
    bad = None
    for c in columns:
        broken = F.try_parse_json(rows[c]).isNull()
        bad = broken if bad is None else bad | broken
    marked = rows.select("*", bad.alias("_bad"))
    good = marked.where(~F.col("_bad")).drop("_bad").withColumns({c: F.from_json(F.col(c), s) for c, s in columns.items()})
    return good.select(*parsed.columns), marked.agg(F.count_if("_bad").alias("skipped"))


def answered(*splits: DataFrame, answer: str) -> DataFrame:
    """All splits in one table, without rows whose answer is blank."""
    out = splits[0]
    for s in splits[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.where(F.trim(F.col(answer)) != "")


def without_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """A corpus as a view that leaves out one family; the files stay as they are."""
    return rows.where(~F.startswith(column, F.lit(prefix)))


def latest_by(rows: DataFrame, key: str, version: str) -> DataFrame:
    """One row for each key, that of the greatest version; used to merge a new manifest into an old one."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max(F.struct(version, *(c for c in rest if c != version))).alias("_m"))
    return best.select(key, *(F.col(f"_m.{c}").alias(c) for c in rest))


def log_tail(spark: SparkSession, folder: str, n: int = 300, own: str = OWN) -> DataFrame:
    """(line, part, at): the last n lines of train.log if it is there, else of the newest log, the reader's own left out; the last line first."""
    return log_lines(spark, folder, n, own).orderBy(F.desc("part"), F.desc("at")).select("line", "part", "at")
