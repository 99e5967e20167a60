"""Greedy batches under a token budget, and branch layouts.

A greedy pass over all rows in order of length looks sequential: where a batch
ends decides where the next one starts. But from any row the next start is
known from the order alone, so the starts are the chain of these jumps from the
first row. Each range of the order follows the jumps of the few rows at which a
batch can start that came in from before, to where they leave the range; these
ways are joined with themselves, doubling in length each time, until the row at
which the chain enters every range is known; then the ranges mark their starts.
No task sees more than a range, and the batches are those of one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, maybe_broadcast
from .splits import hash_ranked, in_order, running


def pad64(n: int) -> int:
    return -(-n // 64) * 64


def _packed(rows: DataFrame, group: str, fits: Callable[[int, int, int], bool]) -> DataFrame:
    """(key, group, batch) for rows (key, len, opts, group) sorted by group, length and key; fits(largest, rows, options) of a batch with one more."""

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, batch, count, used, top = None, -1, 0, 0, 0
        for pdf in parts:
            out = []
            for key_, len_, opts_, group_ in pdf.itertuples(index=False):
                if group_ != now:
                    now, batch, count, used, top = group_, -1, 0, 0, 0
                if batch < 0 or not fits(max(top, len_), count + 1, used + opts_):
                    batch, count, used, top = batch + 1, 0, 0, 0
                count, used, top = count + 1, used + opts_, max(top, len_)
                out.append((key_, group_, batch))
            yield pd.DataFrame(out, columns=["key", group, "batch"])

    return rows.mapInPandas(pack, f"key long, {group} long, batch int")


def _next_starts(rows: DataFrame, max_tokens: int, max_options: int) -> DataFrame:
    """Rows (key, len, opts) with _range, _place and _next: the first later row that a batch from this row cannot hold.

    Rows come in order of length, so which rows can share a batch with a given last row is a run of places up to it: its begin
    is bounded by the padded length and by the options, and never falls. A row's next start is the number of such begins up to it.
    """
    x = cut(in_order(rows, ["len", "key"], {"_before": "opts"}))
    padded = F.ceil(F.col("len") / 64) * 64
    by_length = F.when(padded > 0, F.col("_place") + 1 - F.floor(F.lit(max_tokens) / F.greatest(padded, F.lit(1)))).otherwise(0)
    # the first place whose earlier options leave room: in the bin of that sum or the next one, each of which has few different sums
    step = max(1, max_options)
    bins = x.groupBy(F.floor(F.col("_before") / step).alias("_bin"), "_before").agg(F.min("_place").alias("_at"))
    bins = cut(bins.groupBy("_bin").agg(F.array_sort(F.collect_list(F.struct("_before", "_at"))).alias("_sums")))
    least = F.col("_before") + F.col("opts") - max_options
    asked = x.withColumns({"_by_length": by_length, "_least": F.greatest(least, F.lit(0))})
    asked = asked.withColumn("_bin", F.explode(F.array(F.floor(F.col("_least") / step), F.floor(F.col("_least") / step) + 1)))
    found = F.array_min(F.transform(F.filter("_sums", lambda s: s["_before"] >= F.col("_least")), lambda s: s["_at"]))
    found = asked.join(bins, "_bin", "left").groupBy("_place", "_range", "key", "_by_length").agg(F.min(found).alias("_by_options"))
    begin = F.greatest(F.lit(0), F.least(F.col("_place"), F.greatest("_by_length", F.coalesce("_by_options", "_place"))))
    found = cut(found.select("key", "_range", "_place", begin.cast("long").alias("_begin")))
    begins = found.groupBy(F.col("_begin").alias("_place")).agg(F.count("*").alias("_n"))
    found = cut(found.join(begins, "_place", "left").select("key", "_range", "_place", F.coalesce("_n", F.lit(0)).alias("_n")))
    found = running(found, ["_place"], {"_next": F.col("_n")})
    return cut(found.select("key", "_range", "_place", (F.col("_next") + F.col("_n")).alias("_next")))


def _exits(at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Where the jumps from each place of a range leave it; at: places one after the other."""
    first, to = at[0], to.copy()
    while (inside := to <= at[-1]).any():
        to[inside] = to[to[inside] - first]
    return to


def greedy_batches(rows: DataFrame, key: str, length: str, options: str, max_tokens: int = 16_384, max_options: int = 512) -> DataFrame:
    """(key, batch): rows in order of length and key; a batch ends before the row with which the padded length times the rows, or the options, would exceed the budget.

    A row above the budget is a batch by itself. Null lengths and options count as 0; rows without a length take no tokens. Keys are whole numbers.
    """
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    x = _next_starts(rows.select(F.col(key).cast("long").alias("key"), zero(length).alias("len"), zero(options).alias("opts")), max_tokens, max_options)
    # a batch that came in can start anywhere up to where one from the last row before the range must
    last = x.groupBy("_range").agg(F.max("_next").alias("_reach"))
    last = last.select("_range", F.coalesce(F.lag("_reach").over(Window.partitionBy(F.lit(0)).orderBy("_range")), F.lit(0)).alias("_reach"))

    def ways(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place")
        at, to = pdf["_place"].to_numpy(), pdf["_next"].to_numpy()
        few = at <= pdf["_reach"].iloc[0]
        return pd.DataFrame({"_from": at[few], "_to": _exits(at, to)[few]})

    both = x.join(F.broadcast(cut(last)), "_range")
    jumps = cut(both.select("_range", "_place", "_next", "_reach").groupBy("_range").applyInPandas(ways, "_from long, _to long"))
    entered = cut(jumps.where("_from = 0").select(F.col("_from").alias("_at")))
    known = entered.count()
    while True:
        entered = cut(entered.unionByName(entered.join(jumps, F.col("_at") == F.col("_from")).select(F.col("_to").alias("_at"))).distinct())
        if (now := entered.count()) == known:
            break
        known = now
        then = jumps.select(F.col("_from").alias("_to"), F.col("_to").alias("_later"))
        jumps = cut(jumps.join(then, "_to", "left").select("_from", F.coalesce("_later", "_to").alias("_to")))

    def marked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place")
        at, to, start = pdf["_place"].to_numpy(), pdf["_next"].to_numpy(), np.zeros(len(pdf), np.int64)
        now = pdf["_at"].min()  # not a number where no batch starts in the range
        while now <= at[-1]:
            start[int(now) - at[0]] = 1
            now = to[int(now) - at[0]]
        return pd.DataFrame({"key": pdf["key"], "_range": pdf["_range"], "_place": at, "_start": start})

    x = x.join(maybe_broadcast(entered), F.col("_place") == F.col("_at"), "left")
    x = cut(x.groupBy("_range").applyInPandas(marked, "key long, _range int, _place long, _start long"))
    return running(x, ["_place"], {"batch": F.col("_start")}).select("key", (F.col("batch") + F.col("_start") - 1).alias("batch"))


def window_batches(rows: DataFrame, key: str, length: str, seed: str, max_tokens: int = 16_384, window_mult: int = 20, least: int = 64, max_rows: int | None = None, cap: int | None = None) -> DataFrame:
    """(key, window, batch): rows in hashed order are cut into windows, sorted by length there, and batched while the largest length times the rows fits.

    A window has window_mult budgets of the longest row, and `least` rows at least; `cap` leaves out longer rows. A row above
    the budget is a batch by itself. Rows are dealt to windows by rank, so windows are as many as the rows need.
    """
    x = rows.select(F.col(key).cast("long").alias("key"), F.col(length).cast("long").alias("len"))
    if cap is not None:
        x = x.where(F.col("len") <= cap)
    longest = x.agg(F.max("len")).first()[0] or 1
    size = max(least, max_tokens * window_mult // max(1, longest))
    ranked = hash_ranked(x, [], seed, "key").select("key", "len", F.lit(0).cast("long").alias("opts"), F.floor((F.col("_rank") - 1) / size).cast("long").alias("window"))
    ranked = ranked.repartition("window").sortWithinPartitions("window", "len", "key")
    return _packed(ranked, "window", lambda top, n, _: top * n <= max_tokens and (max_rows is None or n <= max_rows))


def branch_layout(rows: DataFrame, key: str, prefix: str, branches: str) -> DataFrame:
    """(key, pos, segment, place): prefix tokens are segment 0; each branch restarts its places after the prefix."""
    parts = F.concat(F.array(F.col(prefix)), F.col(branches))
    x = rows.select(F.col(key), F.col(prefix).alias("_p"), F.posexplode(parts).alias("segment", "n"), parts.alias("_parts"))
    before = F.aggregate(F.slice("_parts", F.lit(1), F.col("segment")), F.lit(0), lambda a, b: a + b)
    x = x.select(key, "_p", "segment", before.alias("_b"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    place = F.when(F.col("segment") == 0, F.col("i")).otherwise(F.col("_p") + F.col("i"))
    return x.select(key, (F.col("_b") + F.col("i")).alias("pos"), "segment", place.alias("place"))


def visible(q: str = "q", k: str = "k") -> str:
    """SQL predicate: a query sees the prefix and its own branch up to itself."""
    return f"{k}.pos <= {q}.pos and ({k}.segment = 0 or {k}.segment = {q}.segment)"


def visible_spans(rows: DataFrame, key: str, prefix: str, branches: str) -> DataFrame:
    """(key, pos, segment, place, prefix_end, branch_start, seen): what `visible` allows each position of `branch_layout`, as two spans.

    A position sees the positions before prefix_end and those from branch_start up to itself, `seen` in all; in the prefix the
    second span is empty (branch_start is the next position). Whether a pair is allowed, and the area of a row of any length,
    follow from the spans without a table of pairs.
    """
    x = branch_layout(rows, key, prefix, branches).join(rows.select(F.col(key), F.col(prefix).alias("_p")), key)
    inside = F.col("segment") == 0
    end = F.when(inside, F.col("pos") + 1).otherwise(F.col("_p"))
    start = F.when(inside, F.col("pos") + 1).otherwise(F.col("pos") - F.col("place") + F.col("_p"))
    x = x.withColumns({"prefix_end": end, "branch_start": start})
    return x.withColumn("seen", F.col("prefix_end") + F.col("pos") + 1 - F.col("branch_start")).drop("_p")


def sees(k: Column) -> Column:
    """Whether the row of `visible_spans` allows position k."""
    return (k < F.col("prefix_end")) | ((k >= F.col("branch_start")) & (k <= F.col("pos")))
