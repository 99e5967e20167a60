"""Weighted draws with replacement: from classes, or from the rows of a class, of which there may be any number.

A draw asks for the first row, in hashed order within its group, whose running
weight reaches a whole number between 1 and the group's total. Running weights
have two levels: a group's hash buckets, and the rows of a bucket. On both
levels the range of weights is cut into bins, a row stands in every bin that
its share of the range meets (in all no more than rows and bins together), and
a draw joins its bin by equality. Only rows of buckets that were hit are
summed. No array holds a group, and no draw meets more than a bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import digest
from ..session import cut, maybe_broadcast
from .keys import attach

BINS = 4096


def _hit(rows: DataFrame, asked: DataFrame, group: list[str], bins: Column) -> DataFrame:
    """asked (_ask, group, _t) with the row of its group for which _low < _t <= _low + _w; rows (group, _low, _w, _whole and the column that `bins` needs), of which ranges do not overlap."""
    at = lambda t: F.least(bins - 1, F.floor((t - 1) / F.col("_whole") * bins)).cast("long")
    spread = rows.where("_w > 0").withColumn("_bin", F.explode(F.sequence(at(F.col("_low") + 1), at(F.col("_low") + F.col("_w")))))
    sizes = rows.groupBy(*group).agg(F.first("_whole").alias("_whole"), F.first("_bins").alias("_bins"))
    asked = attach(asked, sizes, group, "left").withColumn("_bin", at(F.col("_t"))).drop("_whole", "_bins")
    inside = (F.col("_t") > F.col("_low")) & (F.col("_t") <= F.col("_low") + F.col("_w"))
    return attach(asked, spread.drop("_whole", "_bins"), [*group, "_bin"]).where(inside).drop("_bin")


def weighted_draws(rows: DataFrame, key: str, weight: Column, draws: DataFrame, draw: str, by: list[str], u: Column, seed: str) -> DataFrame:
    """draws with the key of the row that each takes from its group; null where the group has no row with a weight.

    rows have the columns of `by`, which may be null, and a key that tells the rows of a group apart. Weights are whole numbers,
    of which null and those below 0 count as 0; u is a column of draws, uniform from 0 up to 1. Draws of one number are one draw.
    """
    x = rows.select(*by, F.col(key).alias("_key"), F.greatest(F.coalesce(weight.cast("long"), F.lit(0)), F.lit(0).cast("long")).alias("_w"))
    x = x.withColumns({"_order": digest(seed, F.col("_key")), "_one": F.lit(0)})
    group = [*by, "_one"]  # without columns all rows are one group
    x = x.withColumn("_bucket", F.substring("_order", 1, 3))
    over = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = x.groupBy(*group, "_bucket").agg(F.sum("_w").alias("_w"), F.count("*").alias("_rows"))
    whole = F.sum("_w").over(Window.partitionBy(*group))
    buckets = cut(buckets.select(*group, "_bucket", "_w", "_rows", (F.sum("_w").over(over) - F.col("_w")).alias("_low"), whole.alias("_whole"), F.lit(BINS).alias("_bins")))

    totals = buckets.groupBy(*group).agg(F.first("_whole").alias("_whole"))
    asked = attach(draws.select(F.col(draw).alias("_ask"), *by, u.alias("_u")).withColumn("_one", F.lit(0)), totals, group).where("_whole > 0")
    asked = asked.select("_ask", *group, (F.floor(F.col("_u") * F.col("_whole")) + 1).alias("_t"))
    first = cut(_hit(buckets.select(*group, "_bucket", F.col("_w"), "_rows", "_low", "_whole", "_bins"), asked, group, F.col("_bins")))
    asked = first.select("_ask", *group, "_bucket", (F.col("_t") - F.col("_low")).alias("_t"))

    within = [*group, "_bucket"]
    hit = cut(first.select(*within, F.col("_w").alias("_whole"), F.col("_rows").alias("_bins")).distinct())
    inside = Window.partitionBy(*within).orderBy("_order", "_key").rowsBetween(Window.unboundedPreceding, 0)
    x = attach(x, maybe_broadcast(hit), within).withColumn("_low", F.sum("_w").over(inside) - F.col("_w"))
    found = _hit(x.select(*within, "_key", "_w", "_low", "_whole", "_bins"), asked, within, F.col("_bins")).select("_ask", "_key")
    return draws.join(found.withColumnsRenamed({"_ask": draw, "_key": key}), draw, "left")


def weighted_sql(name: str, rows: str, key: str, weight: str, draws: str, by: list[str], u: str, digest_: str) -> str:
    """Tables {name}_c and {name}: the same in SQL; draws must have the columns of `by`."""
    part = f"partition by {', '.join(by)}" if by else ""
    same = " and ".join(f"d.{b} is not distinct from c.{b}" for b in by) or "true"
    return f"""{name}_c as (select *, (sum({weight}) over ({part} order by {digest_}, {key}))::bigint as cum, (sum({weight}) over ({part}))::bigint as tot from {rows}),
    {name} as (select d.*, c.{key} from {draws} d join {name}_c c on {same} and floor({u}*tot)::bigint + 1 > cum - {weight} and floor({u}*tot)::bigint + 1 <= cum)"""
