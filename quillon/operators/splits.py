"""Splitting, balancing, sampling weights and option-count draws.

Order inside a group comes from hashed keys, so results do not depend on the
partitioning. A rank within a group is the running count of 4096 hash buckets
plus the rank inside the bucket, so a group with most of the rows is ranked by
many tasks. Rows whose group is null are a group like any other. `capped` keeps only rows under a hash bound before it ranks them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import digest, uniform
from ..session import cut, maybe_broadcast
from .keys import attach


def hash_ranked(rows: DataFrame, by: list[str], seed: str, key: str) -> DataFrame:
    """rows with _rank (from 1, in hashed order within the group) and _n (rows of the group)."""
    bucket = F.substring(digest(seed, F.col(key)), 1, 3)
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.sum("_c").over(order.orderBy("_bucket")) - F.col("_c")
    counts = counts.select(*by, "_bucket", before.alias("_before"), F.sum("_c").over(order).alias("_n"))
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(digest(seed, F.col(key)), key))
    ranked = attach(rows.withColumn("_in", inside), counts, [*by, "_bucket"])
    return ranked.withColumn("_rank", F.col("_before") + F.col("_in")).drop("_bucket", "_in", "_before")


def placed(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """rows with _place (from 1) in the given order, within each group of `by`; no task sees more than one range of the order.

    Rows are dealt to ranges, which are ranked by themselves; the sizes of earlier ranges are added. The ranges are checkpointed,
    since their bounds are sampled.
    """
    ranges = cut(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy(*by, "_range").agg(F.count("*").alias("_c"))
    earlier = F.sum("_c").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range")) - F.col("_c")  # a row for each range
    sizes = sizes.select(*(F.col(c).alias("_g" + c) for c in by), F.col("_range").alias("_r"), earlier.alias("_before"))
    same = F.col("_range") == F.col("_r")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col("_g" + c))
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    out = ranges.withColumn("_in", inside).join(maybe_broadcast(cut(sizes)), same)  # as many rows as ranges and groups that they hold
    return out.withColumn("_place", F.col("_before") + F.col("_in")).drop("_range", "_r", "_in", "_before", *("_g" + c for c in by))


def in_order(rows: DataFrame, order: list, sums: dict[str, str] | None = None) -> DataFrame:
    """rows with _range, _place (from 0) in the given order, and under each name of `sums` the sum of a column over all earlier rows.

    As in `placed`, ranges are numbered and summed by themselves and the totals of earlier ranges are added.
    """
    ranges = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    return running(ranges, order, {"_place": F.lit(1), **{k: F.col(c) for k, c in (sums or {}).items()}})


def running(ranges: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """ranges, checkpointed rows of which those of a smaller _range come first, with the sums over all earlier rows; a range's rows are one window."""
    sums = {k: c.cast("long") for k, c in sums.items()}
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = ranges.groupBy("_range").agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    totals = cut(totals.select(F.col("_range").alias("_r"), *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias("_of" + k) for k in sums)))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranges.withColumns({k: F.sum(c).over(inside) - c for k, c in sums.items()}).join(F.broadcast(totals), F.col("_range") == F.col("_r"))
    return out.withColumns({k: F.col(k) + F.col("_of" + k) for k in sums}).drop("_r", *("_of" + k for k in sums))


def ratio_split(rows: DataFrame, by: list[str], seed: str, key: str, test: float = 0.1, val: float = 0.1) -> DataFrame:
    """The first floor(test * n) rows of each group in hashed order are test, the next floor(val * n) val, the rest train."""
    a, b = F.floor(test * F.col("_n")), F.floor(val * F.col("_n"))
    split = F.when(F.col("_rank") <= a, "test").when(F.col("_rank") <= a + b, "val").otherwise("train")
    return hash_ranked(rows, by, seed, key).withColumn("split", split).drop("_rank", "_n")


def carve_size(n: Column, val_n: int) -> Column:
    return F.least(F.greatest(F.lit(2 * val_n), F.floor(n / 10)), F.floor(n / 5))


def group_split(rows: DataFrame, group: str, seed: str, shares: tuple[float, float] = (0.7, 0.15)) -> DataFrame:
    """Whole groups go to a split; groups are ranked, not rows."""
    groups = hash_ranked(rows.select(group).distinct(), [], seed, group)
    a = F.floor(shares[0] * F.col("_n"))
    split = F.when(F.col("_rank") <= a, "train").when(F.col("_rank") <= a + F.floor(shares[1] * F.col("_n")), "val").otherwise("test")
    return attach(rows, groups.select(group, split.alias("split")), [group])


def held_out_labels(rows: DataFrame, label: str, seed: str, share: float = 0.15) -> DataFrame:
    """(label): the first floor(share * n) labels in hashed order; null is no label."""
    ranked = hash_ranked(rows.where(F.col(label).isNotNull()).select(label).distinct(), [], seed, label)
    return ranked.where(F.col("_rank") <= F.floor(share * F.col("_n"))).select(label)


def capped(rows: DataFrame, by: list[str], cap: DataFrame, seed: str, key: str) -> DataFrame:
    """The first `cap` rows of each group in hashed order; cap has the group columns, cap and n (rows of the group)."""
    u = uniform(seed, F.col(key))
    # a hash bound with ample room above the share that is kept; the exact rank follows
    bound = F.when(F.col("cap") >= F.col("n"), 2.0).otherwise((F.col("cap") + 6 * F.sqrt(F.col("cap") + F.lit(1.0)) + 20) / F.col("n"))
    near = attach(rows, cap.select(*by, "cap", "n"), by).where(u <= bound)
    return hash_ranked(near, by, seed, key).where("_rank <= cap").drop("_rank", "_n", "cap", "n")


def class_counts(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, rarest): counts of each class and of the smallest."""
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.min("n").alias("rarest"))))


def train_cap(counts: DataFrame, per_class: int, floor: int) -> DataFrame:
    return counts.withColumn("cap", F.least(F.lit(per_class), F.greatest("rarest", F.lit(floor))))


def eval_cap(counts: DataFrame, budget: int) -> DataFrame:
    n_cls = counts.agg(F.count("*").alias("k"))
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("k")))
    return counts.crossJoin(F.broadcast(n_cls)).withColumn("cap", F.least(each, F.greatest("rarest", F.lit(10))))


def rebalance_cap(counts: DataFrame, floor: int = 50) -> DataFrame:
    return counts.withColumn("cap", F.greatest("rarest", F.lit(floor)))


def equal_cells(rows: DataFrame, stratum: str, cell: str, cells: list, cap: int, seed: str, key: str) -> DataFrame:
    """As many rows of every cell of a stratum as the rarest has, `cap` at most; a cell that is missing empties its stratum."""
    n = rows.groupBy(stratum, cell).agg(F.count("*").alias("n"))
    have = n.where(F.col(cell).isin(cells)).groupBy(stratum).agg(F.count("*").alias("k"), F.min("n").alias("m"))
    have = have.select(stratum, F.when(F.col("k") == len(cells), F.least("m", F.lit(cap))).otherwise(0).alias("cap"))
    return capped(rows, [stratum, cell], attach(n, have, [stratum]), seed, key)


def source_quota(share: float, other: Column, available: Column) -> Column:
    """How many rows of a source make up `share` of all, `available` at most."""
    return F.least(F.floor(share * other / (1 - share)), available)
