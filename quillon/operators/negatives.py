"""Distractors and hard negatives drawn by rank, so that no label meets the whole catalogue.

`distractors` draws places of the catalogue by hash, joins them by equality and
keeps the first different ones whose words are unlike the label's; labels that
are still short draw again, four times as often, until DRAWS times k draws are
spent. Only labels for which that was too little (almost all others are like
them) are compared through an index of words, and take the least similar: those
that share no word come from the gaps between the places of those that do.
`hard_negatives` gives two thirds of the other options from the row's own
source and the rest from anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..session import cut, maybe_broadcast
from .splits import hash_ranked, in_order

ALIKE, DRAWS = 0.5, (4, 16, 64)


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct words; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def distractors(catalogue: DataFrame, k: int, seed: str = "dis") -> DataFrame:
    """(label, other, sim, r): k others of each label of similarity below one half, uniformly; where draws find fewer, the k least similar, the first labels of equals.

    catalogue (label, w) has each label once, with its distinct words. Fewer than k others give as many as there are; null labels
    are left out.
    """
    every = cut(in_order(catalogue.where("label is not null").select("label", "w"), ["label"]).select("label", "w", "_place"))
    n = every.count()
    other = every.select(F.col("label").alias("other"), F.col("w").alias("v"), F.col("_place").alias("_at"))
    found, short, spent = None, every, 0
    for times in DRAWS if n > 1 else ():
        drawn = short.select("label", "w", F.explode(F.sequence(F.lit(spent), F.lit(times * k - 1))).alias("_t"))
        drawn = drawn.withColumn("_at", F.floor(uniform(seed, F.col("label"), F.col("_t")) * n).cast("long")).join(other, "_at").where(F.col("label") != F.col("other"))
        drawn = drawn.withColumn("sim", similarity(F.col("w"), F.col("v"))).where(F.col("sim") < ALIKE).select("label", "other", "sim", "_t")
        drawn = drawn if found is None else drawn.unionByName(found)
        found = cut(drawn.groupBy("label", "other").agg(F.min("_t").alias("_t"), F.first("sim").alias("sim")))
        enough = cut(found.groupBy("label").agg(F.count("*").alias("_n")).where(F.col("_n") >= min(k, n - 1)).select("label"))
        short, spent = cut(every.join(enough, "label", "left_anti")), times * k
        if short.isEmpty():
            break
    if found is None:
        return every.select("label", F.col("label").alias("other"), F.lit(0.0).alias("sim"), F.lit(1).alias("r")).where("false")
    first = found.join(maybe_broadcast(short.select("label")), "label", "left_anti")
    first = first.select("label", "other", "sim", F.row_number().over(Window.partitionBy("label").orderBy("_t")).alias("r"))
    out = first.where(F.col("r") <= k)
    return out if short.isEmpty() else out.unionByName(_least_similar(short, every, k))


def _least_similar(short: DataFrame, every: DataFrame, k: int) -> DataFrame:
    """(label, other, sim, r) of few labels, by an index of the words of all."""
    words = every.select(F.col("label").alias("other"), F.col("w").alias("v"), F.col("_place").alias("_at"), F.explode("w").alias("_word"))
    asked = short.select("label", "w", F.explode("w").alias("_word"))
    shared = cut(asked.join(words, "_word").groupBy("label", "other", "_at").agg(F.first("w").alias("w"), F.first("v").alias("v")))
    near = shared.where(F.col("label") != F.col("other")).select("label", "_at", similarity(F.col("w"), F.col("v")).alias("sim"))
    # places that share nothing lie between those that do; every label shares its words with itself, unless it has none
    taken = shared.select("label", "_at").unionByName(short.select("label", F.col("_place").alias("_at"))).distinct()
    bounds = taken.unionByName(short.select("label", F.lit(every.count()).cast("long").alias("_at")))
    before = F.coalesce(F.lag("_at").over(Window.partitionBy("label").orderBy("_at")), F.lit(-1))
    gaps = bounds.withColumn("_from", before + 1).where(F.col("_from") < F.col("_at"))
    gaps = gaps.withColumn("_to", F.least(F.col("_at"), F.col("_from") + k) - 1)
    free = gaps.select("label", F.explode(F.sequence("_from", "_to")).alias("_at"), F.lit(0.0).alias("sim"))
    ranked = near.unionByName(free, allowMissingColumns=True).withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("sim", "_at"))).where(F.col("r") <= k)
    return ranked.join(every.select(F.col("label").alias("other"), F.col("_place").alias("_at")), "_at").select("label", "other", "sim", "r")


def drawn_ranks(seed: str, key: Column, n: Column, taken: Column, k: int) -> Column:
    """Up to k ranks of 0..n-1, uniformly and without repeats, none of them in `taken`; fewer if there are not so many."""
    left = lambda t: n - F.size(t)
    skip = lambda t, p: F.aggregate(F.array_sort(t), p, lambda at, x: F.when(x <= at, at + 1).otherwise(at))
    place = lambda t, j: skip(t, F.floor(uniform(seed, key, j) * left(t)).cast("long"))
    start = taken.cast("array<bigint>")
    every = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), start, lambda t, j: F.when(left(t) > 0, F.array_append(t, place(t, j))).otherwise(t))
    return F.slice(every, F.size(start) + 1, F.lit(k))


def hard_negatives(rows: DataFrame, key: str, source: str, label: str, options: int = 6) -> DataFrame:
    """(key, kind, label): for each row floor(2/3 (options - 1)) other labels of its source, one at least, and the rest from all labels not yet taken.

    Ranks of the labels of a source and of all labels are drawn without repeats and joined by equality, so no row meets all
    labels. A source with fewer labels gives fewer hard ones and more of the rest. A null source is a source; rows without a label are left out.
    """
    hard = min(options - 1, max(1, (options - 1) * 2 // 3))
    q = rows.where(F.col(label).isNotNull()).select(F.col(key).alias("_key"), F.struct(F.col(source).alias("s")).alias("_source"), F.col(label).alias("_label"))
    s = q.select("_source", "_label").distinct()
    place = lambda x, by, seed: cut(hash_ranked(x, by, seed, "_label").select(*by, "_label", (F.col("_rank") - 1).alias("_pos"), "_n"))
    within, bank = place(s, ["_source"], "hard"), place(s.select("_label").distinct(), [], "any")
    same = q.join(within, ["_source", "_label"]).select("_key", "_source", F.col("_label").alias("_own"), F.explode_outer(drawn_ranks("hard", F.col("_key"), F.col("_n"), F.array("_pos"), hard)).alias("_pos"))
    same = cut(same.join(within.drop("_n"), ["_source", "_pos"], "left").select("_key", "_own", "_label"))
    taken = same.where("_label is not null").select("_key", "_label").unionByName(q.select("_key", "_label")).join(bank, "_label")
    taken = taken.groupBy("_key").agg(F.array_sort(F.collect_list("_pos")).alias("_taken"), F.first("_n").alias("_n"))  # as many as options
    need = F.lit(options) - F.size("_taken")
    rest = taken.select("_key", F.explode(F.slice(drawn_ranks("any", F.col("_key"), F.col("_n"), F.col("_taken"), options - 1), F.lit(1), need)).alias("_pos"))
    rest = rest.join(bank.drop("_n"), "_pos").select("_key", F.lit("any").alias("kind"), "_label")
    return same.where("_label is not null").select("_key", F.lit("same").alias("kind"), "_label").unionByName(rest).toDF(key, "kind", label)
