"""Exact Jaccard similarity join of shingle sets as a metric-space join with document pivots.

The distance 1 - J is a metric; sets are linked within a radius of 1/4. With
5-word shingles nearly every document is at distance 1 from any other, so a
pivot chosen without regard to content tells nothing, and a set that is far
from all pivots needs others of its own kind. The join goes in rounds over the
sets that are still far from all pivots (at first all that can have a link):

1. Pivots. The sets that hold a deciding shingle elect one of themselves, in
   later rounds eight times as many, so every kind of set soon has a pivot.
2. Voronoi cells. Every set is measured against the pivots that can be within
   the radius. Those within it are linked through the pivot, and the nearest
   one is the set's home. Pivots are at home with themselves.
3. Windows. A set can have a link into another cell only if it is within two
   radii of its pivot (the triangle inequality): the set is measured against
   the pivots of cells into which it may have a link, and replicated to those
   within two radii.
4. Cells. Members at home are connected by their pivot. Each replica outside the
   radius is compared with the members whose distances to the pivot differ from
   its own by a radius at most; a cell of any size is compared in blocks.
5. Recursion. Sets without a home go to the next round, where they alone elect
   new pivots. Links between a set with a home and one without were found in
   step 4, so nothing else is needed; a round takes away its pivots at least,
   and rounds end when no two of the sets left share a deciding shingle.

What bounds the work is a prefix filter: in one global order of shingles
(frequent ones last) two linked sets share one, and by their sizes a known
number, of the first n - ceil(3n/4) + 1 of each. Sets without a partner by that
bound never enter, and only pairs of a set and a pivot (or a cell) that meet it
are measured. Shingle sets travel for those pairs only.

Shingles that one set alone holds decide nothing; most are told by a bit map of
fixed size and stay where they are (with more data it tells fewer, and the
shuffle tells the rest). A shingle found in more than a few sets is looked up in a broadcast array of
bounded size. The sets that hold a shingle are dealt to lots of bounded size,
as a pivot's sets are when they are measured. Links are joined to components,
so near copies are never expanded into all pairs.

Texts that are null, empty or without words have no shingles and link with
nothing; repeated rows have equal sets and share a component. A null id is
never the smallest of its component unless all its ids are null. Extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import among, arrow_scan, cut, discard, maybe_broadcast, shingle_set, shuffle_partitions, signed, small, sorted_longs, spread_join, stored, tidy, utf8, with_hit, without_listed
from .components import components

NUM, DEN = 3, 4  # similarity of at least 3/4
RADIUS = 1 - NUM / DEN
COUNTED = np.uint64(int(0.35 * 2**64))  # the part of the hash range counted over all sets
FREQUENT = 16
MAX_FREQUENT = 2_000_000
BROADCAST_IDS = 2_000_000
SEEN = 100_000
BITS = 1 << 27  # of the map of shingles that two sets hold
#: Pivots that a shingle's sets elect in a round, against the round before; sets of a shingle or of a pivot in one lot.
MORE, LOT = 8, 256
#: Rows of a round up to which what is joined with them by shingle is broadcast.
FEW = 20_000
#: Shingles of the open and of all members in a block, about.
OPEN_SHINGLES, BLOCK_SHINGLES = 1 << 17, 1 << 19


def linked(common, a, b):
    """100 |A n B| >= 75 |A u B|, in whole numbers; for arrays and columns alike."""
    return DEN * common >= NUM * (a + b - common)


def prefix_size(n):
    """How many first shingles of a set of n decide its regions; for numbers and arrays alike."""
    return n - (NUM * n + DEN - 1) // DEN + 1


def _set_id(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    for text in utf8(column):
        yield shingle_set(text)


class _Fresh:
    """Sets that this task has not met before, as far as a bounded memory tells."""

    def __init__(self):
        self.seen: set[bytes] = set()

    def __call__(self, column: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
        for s in _sets(column):
            if len(s) and (i := _set_id(s)) not in self.seen:
                if len(self.seen) >= SEEN:
                    self.seen.clear()
                self.seen.add(i)
                yield i, s


def _longs(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(signed(np.concatenate(parts)) if parts else np.empty(0, np.int64))


def _id_array(ids: np.ndarray) -> pa.Array:
    """A binary column of 16-byte ids, given as rows of two numbers."""
    ids = np.ascontiguousarray(ids, np.uint64)
    ends = np.arange(len(ids) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(ids)])


def _id_rows(column: pa.Array) -> np.ndarray:
    """The 16-byte ids of a binary column without nulls, as rows of two numbers."""
    column = column.cast(pa.binary())
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.empty(0, np.uint8)
    return data[column.offset * 16 : (column.offset + len(column)) * 16].view(np.uint64).reshape(-1, 2)


def _lacking(s: np.ndarray, common: np.ndarray) -> bool:
    """Whether a set's infrequent counted shingles are fewer than its prefix."""
    low = s[: np.searchsorted(s, COUNTED)]
    return len(low) - among(signed(low), common).sum() < prefix_size(len(s))


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in more than FREQUENT sets, sorted (the bound rises if they are too many to broadcast), and a bit map that has all counted ones that two sets may hold."""
    sc = docs.sparkSession.sparkContext

    def counted(batches):
        fresh = _Fresh()
        for b in batches:
            yield pa.RecordBatch.from_arrays([_longs([s[: np.searchsorted(s, COUNTED)] for _, s in fresh(b.column(0))])], ["s"])

    counts = cut(arrow_scan(docs, counted, "s bigint").groupBy("s").count().where("count > 1"))
    twice, first = _bit_map(counts), _above(counts)
    del counts
    tidy(docs.sparkSession)
    if not len(first):
        return first, twice
    known = sc.broadcast(first)

    def others(batches):
        fresh = _Fresh()
        for b in batches:
            parts = [s[np.searchsorted(s, COUNTED) :] for _, s in fresh(b.column(0)) if _lacking(s, known.value)]
            yield pa.RecordBatch.from_arrays([_longs(parts)], ["s"])

    rest = arrow_scan(docs, others, "s bigint").groupBy("s").count().where(F.col("count") > FREQUENT)
    out = np.union1d(first, _above(cut(rest)))
    known.destroy()
    return out, twice


def _above(counts: DataFrame) -> np.ndarray:
    least = FREQUENT
    while not small(counts.where(F.col("count") > least), MAX_FREQUENT):
        least *= 2
    return sorted_longs(counts.where(F.col("count") > least), "s")


def _bit_map(counts: DataFrame) -> np.ndarray:
    """A bit for each shingle of the table, by its lowest bits; of fixed size, so with more shingles more others have a bit, too."""
    at = F.col("s").bitwiseAND(BITS - 1)
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    words = counts.groupBy(F.shiftright(at, 6).cast("int").alias("w")).agg(F.bit_or(mark).alias("b")).toArrow()
    out = np.zeros(BITS >> 6, np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out.view(np.uint64)


def _may_be_held_twice(s: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Which sorted shingles two sets may hold: all that were not counted, and counted ones with a bit."""
    out, n = np.ones(len(s), bool), np.searchsorted(s, COUNTED)
    at = s[:n] & np.uint64(BITS - 1)
    out[:n] = (twice[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def _holders(docs: DataFrame, common, twice) -> DataFrame:
    """(s, id, rare, n, hot): the deciding shingles of every set, as far as two sets may hold them; hot: frequent ones.

    rare: the share of infrequent shingles in the set; n: its size.
    """

    def run(batches):
        fresh = _Fresh()
        for b in batches:
            s_, id_, count, rare, n, hot = [], [], [], [], [], []
            for i, s in fresh(b.column(0)):
                p = prefix_size(len(s))
                often = among(signed(s), common.value)
                cold = s[~often]
                first = cold[:p]
                first = first[_may_be_held_twice(first, twice.value)]
                take = np.concatenate([first, s[often][: p - min(p, len(cold))]])
                if not len(take):
                    continue
                s_.append(take)
                id_.append(i)
                count.append(len(take))
                rare.append(len(cold) / len(s))
                n.append(len(s))
                hot.append(np.arange(len(take)) >= len(first))
            if s_:
                ids = np.frombuffer(b"".join(id_), np.uint64).reshape(-1, 2)
                per_set = [pa.array(np.repeat(np.array(x, t), count)) for x, t in ((rare, np.float32), (n, np.int32))]
                yield pa.RecordBatch.from_arrays([_longs(s_), _id_array(np.repeat(ids, count, axis=0)), *per_set, pa.array(np.concatenate(hot))], ["s", "id", "rare", "n", "hot"])

    return arrow_scan(docs, run, "s bigint, id binary, rare float, n int, hot boolean")


def _in_runs(columns: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """The number of each row's run of equal values of the first column, and of runs."""
    s = columns[0]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    run = np.cumsum(first) - 1
    return run, int(run[-1]) + 1 if len(s) else 0


def _whole_runs(batches: Iterator[pa.RecordBatch], read) -> Iterator[list[np.ndarray]]:
    """Columns of batches sorted by the first one, in parts that hold each value's rows whole."""
    rest: list[np.ndarray] = []
    for batch in batches:
        now = read(batch)
        rest = [np.concatenate(x) for x in zip(rest, now)] if rest else now
        if len(rest[0]):
            end = int(np.searchsorted(rest[0], rest[0][-1]))  # the last value may go on
            if end:
                yield [x[:end] for x in rest]
                rest = [x[end:] for x in rest]
    if rest and len(rest[0]):
        yield rest


def _numbers(b: pa.RecordBatch, *at: int) -> list[np.ndarray]:
    return [b.column(k).to_numpy(zero_copy_only=False) for k in at]


def _held_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (s, hot, id, rare, n), sorted by s, once for each set, without infrequent shingles that only one set holds."""
    for s, hot, ids, rare, n in _whole_runs(batches, lambda b: [*_numbers(b, 0, 1), _id_rows(b.column(2)), *_numbers(b, 3, 4)]):
        run, runs = _in_runs([s])
        some = np.flatnonzero(hot | (np.bincount(run, minlength=runs)[run] > 1))
        some = some[np.lexsort((ids[some, 1], ids[some, 0], run[some]))]
        s, hot, ids, rare, n, run = (x[some] for x in (s, hot, ids, rare, n, run))
        new = np.ones(len(s), bool)  # a set that several tasks met is several rows
        new[1:] = (s[1:] != s[:-1]) | (ids[1:] != ids[:-1]).any(axis=1)
        keep = new & (hot | (np.bincount(run, new, runs)[run] > 1))
        yield pa.RecordBatch.from_arrays([pa.array(s[keep]), _id_array(ids[keep]), pa.array(rare[keep]), pa.array(n[keep]), pa.array(hot[keep])], ["s", "id", "rare", "n", "hot"])


def _held(docs: DataFrame, common, twice) -> DataFrame:
    """(s, id, rare, n, hot): the deciding shingles that two sets hold, of sets that may have a link."""
    parts = shuffle_partitions(docs.sparkSession)
    lot = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(parts))).otherwise(F.lit(0))  # the sets of a frequent one do not meet
    every = _holders(docs, common, twice).withColumn("_lot", lot).repartition(parts, "s", "_lot").sortWithinPartitions("s")
    held = stored(arrow_scan(every.select("s", "hot", "id", "rare", "n"), _held_twice, "s bigint, id binary, rare float, n int, hot boolean"))
    tidy(docs.sparkSession)
    # a bound over each shingle's sets: no set of a link shares fewer with all others together than the two with each other
    total = held.groupBy("id").agg(F.count("*").cast("int").alias("c"))
    rows = held.where("not hot").join(total, "id").select("s", "id", "n", "c").repartition(parts, "s").sortWithinPartitions("s")
    viable = arrow_scan(rows, _viable, "id binary").unionByName(held.where("hot").select("id")).distinct()
    out = stored(held.join(maybe_broadcast(cut(viable), BROADCAST_IDS // 20), "id", "left_semi").select(*held.columns))
    discard(held)
    return out


def _viable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id) of rows (s, id, n, c), sorted by s, with another set of their shingle in reach; few sets hold one."""
    for s, ids, n, c in _whole_runs(batches, lambda b: [*_numbers(b, 0), _id_rows(b.column(1)), *(x.astype(np.int64) for x in _numbers(b, 2, 3))]):
        run, runs = _in_runs([s])
        most, ok = int(np.bincount(run).max()), np.zeros(len(s), bool)
        for away in range(1, most):  # each row with the one so far below it
            a, b = np.arange(len(s) - away), np.arange(away, len(s))
            both = (run[a] == run[b]) & (NUM * np.maximum(n[a], n[b]) <= DEN * np.minimum(n[a], n[b])) & (np.minimum(c[a], c[b]) >= shared_at_least(n[a], n[b]))
            ok[a[both]] = ok[b[both]] = True
        yield pa.RecordBatch.from_arrays([_id_array(np.unique(ids[ok], axis=0))], ["id"])


def shared_at_least(n, m):
    """How many deciding shingles two linked sets of n and m share at least."""
    union = NUM * (n + m)
    return (union + NUM + DEN - 1) // (NUM + DEN) - np.maximum((NUM * n + DEN - 1) // DEN, (NUM * m + DEN - 1) // DEN) + 1


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of batches sorted by their first column, in lists that hold each value's rows whole."""
    rest: list[tuple] = []
    for b in batches:
        rest += zip(*(c.to_pylist() for c in b.columns))
        at = next((k for k in range(len(rest) - 1, 0, -1) if rest[k][0] != rest[k - 1][0]), 0)  # the last value may go on
        if at:
            yield rest[:at]
            del rest[:at]
    if rest:
        yield rest


def _runs(rows: list[tuple]) -> Iterator[list[tuple]]:
    i = 0
    while i < len(rows):
        j = i + 1
        while j < len(rows) and rows[j][0] == rows[i][0]:
            j += 1
        yield rows[i:j]
        i = j


def _set_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set): the whole sets of the ids, once each."""
    few = small(ids, BROADCAST_IDS)
    wanted = docs.sparkSession.sparkContext.broadcast(sorted_longs(ids.select(F.xxhash64("id").alias("h")), "h") if few else None)

    def run(batches):
        fresh = _Fresh()
        for b in batches:
            got = list(fresh(b.column(0)))
            if wanted.value is not None and got:
                hashed = np.array([xxhash.xxh64_intdigest(i, 42) for i, _ in got], np.uint64)  # what the column function gives
                got = [x for x, ok in zip(got, among(signed(hashed), wanted.value)) if ok]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], pa.binary()), pa.array([s.tobytes() for _, s in got], pa.binary())], ["id", "set"])

    sets = arrow_scan(docs, run, "id binary, set binary")
    if not few:
        sets = sets.join(ids, "id", "left_semi")
    out = stored(sets.dropDuplicates(["id"]), zstd=False)
    wanted.destroy()
    tidy(docs.sparkSession)
    return out


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    return int(_among(x, y).sum()) if len(x) else 0


def _among(a: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.searchsorted(keys, a)
    at[at == len(keys)] = 0
    return keys[at] == a


def _with_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows (id, ...) with the set of their id. Sets that no row asks for are not shuffled: few rows are broadcast, and many leave a bit map of their ids."""
    rows = cut(rows)
    if small(rows, BROADCAST_IDS // 10):
        return sets.join(F.broadcast(rows), "id")
    asked = cut(rows.select(F.xxhash64("id").alias("_asked")).distinct())
    return with_hit(sets.withColumn("_own", F.xxhash64("id")), "_own", asked, "_asked").where("_hit").drop("_own", "_hit").join(rows, "id")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(pivot, id, n, d): the distance of each pair (pivot, id) from their whole sets; a pivot's pairs go in lots, each with the pivot's set once."""
    lots = cut(pairs.groupBy("pivot").agg(F.count("*").alias("_n")))
    dealt = spread_join(pairs, lots.select("pivot", F.ceil(F.col("_n") / LOT).cast("int").alias("_lots")), ["pivot"], "inner", lots)
    dealt = dealt.select("pivot", "id", F.pmod(F.xxhash64("id"), F.col("_lots")).cast("int").alias("lot"))
    others = _with_sets(dealt, sets).select("pivot", "lot", F.lit(1).alias("role"), "id", "set")
    own = _with_sets(lots.select(F.col("pivot").alias("id"), F.ceil(F.col("_n") / LOT).cast("int").alias("_lots")), sets).withColumnRenamed("id", "pivot")
    own = own.select("pivot", F.explode(F.sequence(F.lit(0), F.col("_lots") - 1)).alias("lot"), F.lit(0).alias("role"), F.col("pivot").alias("id"), "set")
    rows = own.unionByName(others).repartition(shuffle_partitions(sets.sparkSession), "pivot", "lot").sortWithinPartitions("pivot", "lot", "role")

    def run(batches):
        of = None
        for b in batches:
            pivot, role, ids, of_set = (b.column(k).to_pylist() for k in (0, 2, 3, 4))
            out = []
            for p, r, i, x in zip(pivot, role, ids, of_set):
                x = np.frombuffer(x, np.uint64)
                if r == 0:
                    of = x
                else:
                    k = _shared(of, x)
                    out.append((p, i, len(x), 1 - k / (len(of) + len(x) - k), bool(linked(k, len(of), len(x)))))
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["pivot", "id", "n", "d", "near"])

    return arrow_scan(rows, run, "pivot binary, id binary, n int, d double, near boolean")


def _least_shared(n: Column, m: Column) -> Column:
    """`shared_at_least` of columns."""
    up = lambda x, by: F.floor((x + by - 1) / by)
    return up(NUM * (n + m), NUM + DEN) - F.greatest(up(NUM * n, DEN), up(NUM * m, DEN)) + 1


def _by_shingle(held: DataFrame, others: DataFrame, few: bool, on: tuple[str, ...] = ("s",), each: int = LOT) -> DataFrame:
    """held joined with others; both have m, how many sets hold the shingle. few: whether others is broadcast.

    Else the sets of a shingle go in lots of about `each`, each with its own copy of the others. The copies go through a shuffle:
    left to choose, the planner goes by the others' size without their copies, and may broadcast what is too large for the driver.
    """
    if few:
        return held.drop("m").join(F.broadcast(others.drop("m")), list(on))
    lots = F.ceil(F.col("m") / each)
    left = held.withColumn("_lot", F.pmod(F.xxhash64("id"), lots)).drop("m")
    copies = others.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), lots - 1))).drop("m")
    return left.join(copies.hint("merge"), [*on, "_lot"]).drop("_lot")


def _fits(n: Column, least: Column, most: Column) -> Column:
    """Whether a set of n can be linked with one whose size is from least to most."""
    return (NUM * n <= DEN * most) & (NUM * least <= DEN * n)


def _elected(held: DataFrame, times: int, few: bool) -> DataFrame:
    """(id): the pivots. The sets of a shingle, dealt to so many lots, elect one of each lot, the one with the smallest share of infrequent shingles; a set votes for the first of those its shingles elected."""
    lot = F.pmod(F.xxhash64(F.lit(times), "id"), F.lit(times))
    order = F.struct("rare", F.xxhash64("id").alias("h"), "id")
    held = held.select("s", "id", "m", lot.alias("lot"), order.alias("x"))
    elected = held.groupBy("s", "lot").agg(F.min("x").alias("e"), F.first("m").alias("m"))
    votes = _by_shingle(held.drop("x"), elected, few, ("s", "lot"), LOT * times)
    return votes.groupBy("id").agg(F.min("e")["id"].alias("pivot")).select(F.col("pivot").alias("id")).distinct()


def _parts(near: DataFrame, pivots: DataFrame) -> DataFrame:
    """(pivot, part): pivots of one part are connected by links (pivot, id); some that are connected may be in different parts."""
    links = cut(near.unionByName(pivots.select(F.col("id").alias("pivot"), "id")))
    parts = links.groupBy("pivot").agg(F.min("id").alias("part"))
    for _ in range(2):
        least = links.join(parts, "pivot").groupBy("id").agg(F.min("part").alias("part"))
        parts = links.join(least, "id").groupBy("pivot").agg(F.min("part").alias("part"))
    return parts


def _rounds(held: DataFrame, sets: DataFrame) -> Iterator[tuple[str, DataFrame]]:
    """Links (a, b) by their origin, `pivot` or `window`, of each round. held is gone at the end, and what a round made goes with it, but for its links."""
    elect, small_list, before = 1, BROADCAST_IDS // 20, held
    while True:
        several = cut(held.groupBy("s").agg(F.count("*").alias("m")).where("m > 1"))
        held = stored(held.select("s", "id", "rare", "n").join(maybe_broadcast(several, small_list), "s"))
        discard(before)
        before = held
        if small(held, 0):
            discard(held)
            return
        few = small(held, FEW)
        pivots = maybe_broadcast(cut(_elected(held, elect, few)), small_list)

        of_pivots = held.join(pivots, "id", "left_semi").select("s", F.col("id").alias("pivot"), F.col("n").alias("pn"), "m")
        pairs = _by_shingle(held, of_pivots, few).where((F.col("id") != F.col("pivot")) & _fits(F.col("n"), F.col("pn"), F.col("pn")))
        pairs = pairs.groupBy("pivot", "id").agg(F.count("*").alias("m"), F.first("n").alias("n"), F.first("pn").alias("pn"))
        star = stored(_measured(cut(pairs.where(F.col("m") >= _least_shared(F.col("n"), F.col("pn"))).select("pivot", "id")), sets))
        del several, of_pivots, pairs
        tidy(sets.sparkSession)
        yield "pivot", star.where("near").select(F.col("pivot").alias("a"), F.col("id").alias("b"))

        # homes: the nearest pivot within the radius; pivots are at home with themselves
        near = star.where("near")
        nearest = near.join(pivots, "id", "left_anti").groupBy("id").agg(F.min(F.struct("d", "pivot")).alias("x"), F.first("n").alias("n"))
        homes = stored(nearest.select("id", F.col("x.pivot").alias("home"), F.col("x.d").alias("d"), "n"))
        if not small(homes, 0):  # every set was measured against the pivots themselves
            yield "window", _from_windows(held, sets, star, homes, pivots, few)
        gone = maybe_broadcast(cut(homes.select("id").unionByName(pivots.select("id"))), small_list)
        discard(homes)
        held = held.join(gone, "id", "left_anti")
        elect *= MORE
        tidy(sets.sparkSession)


def _from_windows(held: DataFrame, sets: DataFrame, star: DataFrame, homes: DataFrame, pivots: DataFrame, few: bool) -> DataFrame:
    """Links (a, b) of members at home in a cell with sets from elsewhere that are within two radii of its pivot.

    Sets are asked for by their shingles and sizes, and only for cells that they are not known to be connected with; shingles
    that one connected part alone holds lead nowhere.
    """
    small_list = BROADCAST_IDS // 20
    parts = cut(_parts(star.where("near").select("pivot", "id"), pivots))
    at_home = homes.join(maybe_broadcast(parts.withColumnRenamed("pivot", "home"), small_list), "home")
    cells = cut(at_home.groupBy("home", "part").agg(F.min("n").alias("least"), F.max("n").alias("most")))
    own = at_home.select("id", "home", "part").unionByName(parts.select(F.col("pivot").alias("id"), F.lit(None).cast("binary").alias("home"), "part"))
    placed = held.join(maybe_broadcast(cut(own), small_list), "id", "left").withColumn("part", F.coalesce("part", "id"))
    placed = every = stored(placed.select("s", "id", "n", "m", "home", "part"))
    of_homes = F.count(F.when(F.col("home").isNotNull(), 1))
    mixed = cut(placed.groupBy("s").agg(F.min("part").alias("p"), F.max("part").alias("q"), of_homes.alias("c")).where("p <> q and c > 0").select("s"))
    if small(mixed, 0):
        discard(every)
        return star.where("false").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    placed = placed.join(maybe_broadcast(mixed, small_list), "s", "left_semi")
    index = placed.where("home is not null").select("s", F.col("home").alias("pivot"), "m").distinct()
    index = spread_join(cut(index), cells.select(F.col("home").alias("pivot"), F.col("part").alias("of"), "least", "most"), ["pivot"], "inner")
    asked = _by_shingle(placed, index, few).where((F.col("part") != F.col("of")) & _fits(F.col("n"), F.col("least"), F.col("most")))
    asked = asked.groupBy("pivot", "id").agg(F.count("*").alias("m"), *(F.first(c).alias(c) for c in ("n", "least", "most")))
    enough = F.least(_least_shared(F.col("n"), F.col("least")), _least_shared(F.col("n"), F.col("most")))
    asked = cut(asked.where(F.col("m") >= enough).select("pivot", "id"))
    known = star.join(maybe_broadcast(asked, small_list), ["pivot", "id"], "left_semi")
    more = _measured(cut(asked.join(known.select("pivot", "id"), ["pivot", "id"], "left_anti")), sets)
    replicas = known.where("not near").unionByName(more.where("not near")).where(F.col("d") <= 2 * RADIUS + 1e-9)
    replicas = stored(replicas.select(F.col("pivot").alias("cell"), "id", "n", "d"))
    discard(every)
    del every, placed, own, at_home, index, asked, known, more
    tidy(sets.sparkSession)
    busy = cut(replicas.select("cell").distinct())
    members = homes.select(F.col("home").alias("cell"), "id", "n", "d").join(maybe_broadcast(busy, small_list), "cell", "left_semi")
    both = members.withColumns({"open": F.lit(False), "home": F.lit(True)}).unionByName(replicas.withColumns({"open": F.lit(True), "home": F.lit(False)}))
    out = stored(_in_blocks(cut(both), sets))
    discard(replicas)
    return out


def _cell_links(d: np.ndarray, open_: np.ndarray, home: np.ndarray, of: list[np.ndarray], others: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Linked pairs of an open member and another one (of `others`, if given) whose distances to the pivot allow it."""
    if len(of) < 2 or not open_.any():
        return
    n = np.array([len(x) for x in of])
    if len(of) == 2 and others is None:
        if (home.any()) and abs(d[0] - d[1]) <= RADIUS + 1e-9 and linked(_among(of[0], of[1]).sum(), n[0], n[1]):
            yield 0, 1
        return
    value, at = np.unique(np.concatenate(of), return_inverse=True)
    bounds = np.concatenate(([0], np.cumsum(n)))
    order = np.argsort(at, kind="stable")
    begin = np.searchsorted(at[order], np.arange(len(value) + 1))
    holders = np.repeat(np.arange(len(of)), n)[order]
    for r in np.flatnonzero(open_):
        h = at[bounds[r] : bounds[r + 1]]
        lengths = begin[h + 1] - begin[h]
        hit = holders[np.repeat(begin[h] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())]
        k = np.bincount(hit, minlength=len(of))
        ok = linked(k, n[r], n) & (np.abs(d - d[r]) <= RADIUS + 1e-9) & (home | home[r])
        ok[r] = False
        if others is not None:
            ok &= others
        yield from ((int(r), int(q)) for q in np.flatnonzero(ok))


def _in_blocks(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """Compares the open members of a region of any size with all its members: a block of these with a block of those, in tasks of bounded size."""
    lots = lambda weight, each: F.greatest(F.lit(1), F.ceil(weight / each)).cast("int")
    count = cells.groupBy("cell").agg(lots(F.sum(F.when(F.col("open"), F.col("n")).otherwise(0)), OPEN_SHINGLES).alias("p"), lots(F.sum("n"), BLOCK_SHINGLES).alias("q"))
    rows = cells.join(maybe_broadcast(cut(count), BROADCAST_IDS // 20), "cell").select("cell", "id", "d", "open", "home", "p", "q")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = rows.where("open").withColumn("i", F.pmod(F.xxhash64("id"), F.col("p")).cast("int")).withColumn("j", every("q")).withColumn("role", F.lit(0))
    b = rows.withColumn("j", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("q")).cast("int")).withColumn("i", every("p")).withColumn("role", F.lit(1))
    both = _with_sets(a.unionByName(b).select(F.xxhash64("cell", "i", "j").alias("block"), "id", "d", "open", "home", "role"), sets)
    both = both.select("block", "id", "d", "open", "home", "role", "set").repartition(shuffle_partitions(sets.sparkSession), "block").sortWithinPartitions("block", "role")
    return arrow_scan(both, _block_links, "a binary, b binary")


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _by_cell(batches):
        found: list[tuple[bytes, bytes]] = []
        for members in _runs(rows):
            _, ids, d, open_, home, role, of = zip(*members)
            role = np.array(role)
            links = _cell_links(np.array(d), np.array(open_) & (role == 0), np.array(home), [np.frombuffer(x, np.uint64) for x in of], role == 1)
            found += ((ids[a], ids[b]) for a, b in links if ids[a] != ids[b])
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary())], ["a", "b"])


def set_links(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(a, b, origin): fingerprints of linked sets, and whether a pivot or a window gave the link; a spanning set of links, enough to connect all that are linked."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    common, twice = (docs.sparkSession.sparkContext.broadcast(x) for x in _frequent(texts))
    held = _held(texts, common, twice)
    common.destroy()
    twice.destroy()
    sets = _set_table(texts, cut(held.select("id").distinct()))
    out = None
    for origin, links in _rounds(held, sets):
        links = links.withColumn("origin", F.lit(origin))
        out = links if out is None else out.unionByName(links)
    discard(sets)
    return docs.sparkSession.createDataFrame([], "a binary, b binary, origin string") if out is None else out.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id and _key (a hash of the text) of every row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def facts(batches):
        for b in batches:
            sets = list(_sets(b.column(2)))
            ids = pa.array([_set_id(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), ids], ["_id", "_key", "n_shingles", "_set"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_key"), text.alias("_text"))
    rows = stored(arrow_scan(rows, facts, f"_id {kind}, _key bigint, n_shingles bigint, _set binary"))
    roots = cut(components(set_links(docs, text_col)))
    tidy(docs.sparkSession)
    roots = maybe_broadcast(roots, BROADCAST_IDS // 20)
    sets = rows.where("_set is not null").join(roots.withColumnRenamed("node", "_set"), "_set", "left")
    sets = sets.withColumn("_root", F.coalesce("root", "_set"))
    least = sets.groupBy("_root").agg(F.min("_id").alias("_least"), F.count("*").alias("_n")).where("_n > 1")
    out = sets.join(maybe_broadcast(cut(least), BROADCAST_IDS // 20), "_root", "left")
    out = out.select("_id", "n_shingles", F.coalesce("_least", "_id").alias("component_id"), "_key")
    # rows without shingles stay out of the joins: their null key would meet in one task
    alone = rows.where("_set is null").select("_id", "n_shingles", F.col("_id").alias("component_id"), "_key")
    return out.unionByName(alone).withColumnRenamed("_id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with all their columns.

    What goes is known by id and text, for an id may be repeated with another text. A null id goes if its component has
    another id, and stays otherwise. Rows that repeat id and text stay or go together.
    """
    found = near_duplicates(docs, id_col, text_col)
    gone = found.where(~F.col(id_col).eqNullSafe(F.col("component_id")))
    gone = cut(gone.select(F.xxhash64(id_col, "_key").alias("_pair"), F.col(id_col).alias("_gone")).distinct())
    id_, text = F.col("_row").getField(id_col), F.col("_row").getField(text_col).cast("string")
    rows = docs.select(F.struct("*").alias("_row")).withColumn("_own", F.xxhash64(id_, F.xxhash64(text)))
    same = (F.col("_own") == F.col("_pair")) & id_.eqNullSafe(F.col("_gone"))
    return without_listed(rows, gone, same, BROADCAST_IDS // 4)
