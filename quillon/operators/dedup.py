"""Deduplication, decontamination and label merging as joins and aggregations on keys.

Every rule aggregates by key, so a key with a large share of the rows costs one
partial row for each task; a join back, where there is one, is one that Spark
can split where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, maybe_broadcast
from .keys import attach


def first_by_priority(rows: DataFrame, key: str, priority: list[str | Column]) -> DataFrame:
    """The first row of each key in the order of `priority`, which ends in a unique id; null is a key like any other."""
    order = [F.col(p) if isinstance(p, str) else p for p in priority]
    first = rows.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_first"))
    return first.select("_first.*")


def not_in_higher_split(rows: DataFrame, key: str, rank: str) -> DataFrame:
    """Drops rows whose key occurs in a split of higher priority; repeats inside one split stay; null is a key like any other."""
    least = rows.groupBy(F.col(key).alias("_k")).agg(F.min(rank).alias("_r"))
    return rows.join(least, rows[key].eqNullSafe(F.col("_k")) & rows[rank].eqNullSafe(F.col("_r")), "left_semi")


def blocklist(*sources: tuple[int, DataFrame]) -> DataFrame:
    """(key, src): each key once, with the first source that has it."""
    out = None
    for rank, keys in sources:
        one = keys.select(F.col(keys.columns[0]).alias("key"), F.lit(rank).alias("src"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("key").agg(F.min("src").alias("src"))


def without_blocked(rows: DataFrame, blocked: DataFrame, *keys: str) -> DataFrame:
    """Drops a row if any of its keys is blocked."""
    for k in keys:
        rows = rows.join(blocked.select(F.col("key").alias(k)), k, "left_anti")
    return rows


def spaced(text: Column) -> Column:
    """Lower-case runs of letters and digits, with one space between."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


#: Passages that are looked for one by one in the scan, and words of a passage whose hash finds its candidates.
SCANNED, KEY_WORDS = 256, 6


def without_passages(rows: DataFrame, key: str, text: str, passages: DataFrame) -> DataFrame:
    """Rows whose spaced text contains none of the spaced passages, anywhere in it; passages has one column.

    Few passages, and those too short to have whole words inside, are tested where a row is read. Of others the words
    after the first, which like the last may be part of a longer word of the text, are hashed; runs of as many words of the
    texts find them, and containment decides. Null texts contain nothing and null passages are nowhere.
    """
    p = passages.select(F.col(passages.columns[0]).alias("_p")).where("_p is not null").distinct()
    w = F.split("_p", " ")
    p = cut(p.withColumn("_n", F.least(F.lit(KEY_WORDS), F.size(w) - 2)))
    few = p.limit(SCANNED + 1).count() <= SCANNED
    direct = p if few else p.where("_n < 1")
    listed = direct.agg(F.collect_list("_p").alias("_list"))
    rows = rows.crossJoin(F.broadcast(listed)).where(~F.coalesce(F.exists("_list", lambda x: F.contains(F.col(text), x)), F.lit(False))).drop("_list")
    if few:
        return rows
    keyed = p.where("_n >= 1").withColumn("_h", F.xxhash64("_n", F.array_join(F.slice(w, F.lit(2), F.col("_n")), " ")))
    words = rows.select(key, F.split(text, " ").alias("_w"))
    if keyed.isEmpty():
        return rows
    lengths = [r[0] for r in keyed.select("_n").distinct().collect()]  # KEY_WORDS numbers at most
    run = lambda n: F.transform(F.sequence(F.lit(0), F.size("_w") - n), lambda i: F.xxhash64(F.lit(n), F.array_join(F.slice("_w", i + 1, F.lit(n)), " ")))
    runs = [F.when(F.size("_w") >= n, run(n)) for n in lengths]
    found = words.select(key, F.explode(F.array_distinct(F.concat(*(F.coalesce(r, F.array().cast("array<bigint>")) for r in runs)))).alias("_h"))
    # while they are few, candidates and hits are broadcast and no text is shuffled
    found = cut(found.join(maybe_broadcast(cut(keyed.select("_h", "_p"))), "_h").select(key, "_p"))
    hits = cut(rows.select(key, text).join(maybe_broadcast(found), key).where(F.contains(F.col(text), F.col("_p"))).select(key).distinct())
    return rows.join(maybe_broadcast(hits), key, "left_anti")


def ambiguous_keys(rows: DataFrame, key: str, answer: str) -> DataFrame:
    """Keys with more than one answer; two extremes tell, without a set of all answers."""
    return rows.groupBy(key).agg(F.min(answer).alias("_lo"), F.max(answer).alias("_hi")).where("_lo <> _hi").select(key)


def without_ambiguous(rows: DataFrame, key: str, answer: str) -> DataFrame:
    """Rows whose key has one answer; a null answer is none and contradicts no other, and rows with a null key stay."""
    return rows.join(ambiguous_keys(rows, key, answer), key, "left_anti")


def without_repeated_options(rows: DataFrame, options: str) -> DataFrame:
    return rows.where(F.size(F.array_distinct(options)) == F.size(options))


def leakage(rows: DataFrame, key: str, split: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Keys shared by each pair of splits, from one aggregation over keys."""
    held = rows.groupBy(key).agg(F.collect_set(split).alias("_s"))
    both = [F.count_if(F.array_contains("_s", a) & F.array_contains("_s", b)).alias(f"{a}_{b}") for a, b in pairs]
    wide = held.agg(*both)
    return wide.select(F.explode(F.array(*(F.struct(F.lit(f"{a}_{b}").alias("pair"), F.col(f"{a}_{b}").alias("shared")) for a, b in pairs))).alias("x")).select("x.*")


def merged_labels(labels: DataFrame, label: str, normalized: Column) -> DataFrame:
    """(label, canonical): the first in order of the labels with one normalised name; a null label is its own."""
    rows = labels.select(F.col(label).alias("label"), normalized.alias("_n")).distinct()
    return attach(rows, rows.groupBy("_n").agg(F.min("label").alias("canonical")), ["_n"]).select("label", "canonical")
