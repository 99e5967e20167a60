"""Exact deduplication by progressive refinement: length, prefix hash, full hash.

Rows are grouped by the byte length of the text; only rows whose length occurs
twice go on to the hash of a prefix, and only rows whose group still has two
members have their whole content hashed. Both levels are columns of the scan.
Every level counts with aggregation on the map side, so a group with a third of
all rows costs one row for each task. The prefix hashes that survive are looked
up in Bloom maps, one for each range of some 20 million of them: a false hit, of
which there is less than one in a hundred, costs one more hash, and no text is
shuffled to find groups.

Texts are equal when they are identical after lower-casing A-Z; null counts as
empty. The row with the largest id stays. Rows that repeat both id and text
share one decision, so all of them stay or go together. A null id goes if
another id has its text. An empty table gives an empty result. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, arrow_scan, cut, maybe_broadcast, utf8, with_hit, without_listed

PREFIX_CHARS = 256
BROADCAST_ROWS = 100_000


def normalised(text: Column) -> Column:
    """Null as empty, A-Z lower-cased and no other letter."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower())


def prefix_key(text: Column) -> Column:
    """A hash of the length and the first characters of a normalised text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(F.octet_length(text), normalised(F.substring(text, 1, PREFIX_CHARS)))


def _digests(every: bool):
    """Hashes of the whole content of rows with a hit; `every` adds those of all rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = b.column(3).to_pylist()
            sha = [hashlib.sha256(x.lower()).digest() if h or every else None for x, h in zip(utf8(b.column(2)), hit)]
            columns = [b.column(0), b.column(1), pa.array([x if h else None for x, h in zip(sha, hit)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(sha, pa.binary())] * every, ["_id", "_key", "_sha"] + ["_digest"] * every)

    return scan


def full_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(_id, _key, _sha) for every row of docs; _sha is null where no other row can be equal. `digests` adds _digest, never null."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), prefix_key(F.col(text_col)).alias("_key"), F.col(text_col).cast("string").alias("_text"))
    keys = cut(docs.select(F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_len"), prefix_key(F.col(text_col)).alias("_key")))
    lengths = cut(keys.groupBy("_len").agg(F.count("*").alias("_n")).where("_n > 1").select("_len"))
    second = keys.join(maybe_broadcast(lengths, BROADCAST_ROWS), "_len", "left_semi")
    alive = cut(second.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key"))
    rows = with_hit(rows, "_key", alive.withColumnRenamed("_key", "_alive"), "_alive")
    return arrow_scan(rows, _digests(digests), f"_id {kind}, _key bigint, _sha binary" + ", _digest binary" * digests)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """id, keep_id, group_size, kept, _key and _sha (null if unique) for every row of docs; `digests` adds _digest of every text."""
    hashed = cut(full_hashes(docs, id_col, text_col, digests))
    sizes = hashed.where("_sha is not null").groupBy("_sha").agg(F.max("_id").alias("_keep"), F.count("*").alias("_n")).where("_n > 1")
    out = hashed.where("_sha is not null").join(maybe_broadcast(cut(sizes), BROADCAST_ROWS), "_sha", "left")
    # rows without an equal stay out of the join: their null hash would meet in one task
    out = out.unionByName(hashed.where("_sha is null"), allowMissingColumns=True)
    keep = F.coalesce("_keep", "_id")
    return out.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        "_key",
        "_sha",
        *["_digest"] * digests,
    )


def keep_last(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    What goes is known by id and hash, for an id may be repeated with other texts, which stay.
    """
    gone = exact_duplicates(docs, id_col, text_col).where(~F.col("kept"))
    pair = F.xxhash64(id_col, "_key")
    gone = cut(gone.select(pair.alias("_pair"), F.col(id_col).alias("_gone"), F.lower(F.hex("_sha")).alias("_sha")).distinct())
    key = F.xxhash64(F.col("_row").getField(id_col), prefix_key(F.col("_row").getField(text_col)))
    rows = docs.select(F.struct("*").alias("_row")).withColumn("_own", key)
    # startswith is no join key, so a text is hashed only where id and prefix agree
    sha = F.sha2(normalised(F.col("_row").getField(text_col)), 256)
    same = (F.col("_own") == F.col("_pair")) & F.col("_row").getField(id_col).eqNullSafe(F.col("_gone")) & F.startswith(sha, F.col("_sha"))
    return without_listed(rows, gone, same, broadcast_rows)
