"""Prefix trie of conversations by preorder intervals.

Every conversation is rebuilt with the opening of the first conversation of its
hundred; the distinct prefixes of all rebuilt conversations are the nodes of a
trie. Nodes are ranked lexicographically (turns compare by a hash, which is as
good an order as any) and so stand in preorder. Each node has two events in
that order: one where its subtree opens and one, the highest key below it,
where it closes. Running sums over the events are taken in ranges and added up
over them; leaves and savings of a subtree are the difference of the sums at
its two events.

A node is known by a 128-bit exclusive or of the hashes of (position, turn) on
its path, so prefixes need no chain of tasks. The rank compares blocks: within
32 turns a key is the string of their hashes; beyond, the ranks of whole blocks
are the letters of the next level, so keys stay short and a conversation of n
turns costs n keys, not n * n letters. Turns are dealt to ranges of (id, turn,
hash) and numbered there, and windows are bounded parts of a conversation, so
one conversation may hold a third of all turns; joins look hot keys up in a
broadcast of at most a thousand rows. Texts are hashed in the scan and are
never shuffled.

Null turns come first, and turns of one number follow in the order of their
hashes; null roles and texts count as empty; repeated rows are repeated turns.
Rows without an id belong to no conversation. A table without conversations has
no node, not even the root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_scan, cut, maybe_broadcast, spread_join, stored

#: Turns compared in one key; turns of one window of running hashes; ids of one piece of a list.
BLOCK, CHUNK, PIECE = 32, 4096, 8192
LETTER, NAME, AFTER_ALL = 16, 12, "~"
NODE, HEAD = ["_a", "_b"], "array<struct<_pos:bigint,_letter:string,_chars:bigint>>"


def letter(role: Column, text: Column) -> Column:
    """A turn as 96 bits in 16 characters, all below AFTER_ALL."""
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.base64(F.unhex(F.sha2(whole, 256))), 1, LETTER)


def _xor(x: str, y: str) -> Column:
    return F.col(x).bitwiseXOR(F.col(y))


def _any(*names: str) -> list[Column]:
    return [F.any_value(c).alias(c) for c in names]


# --- turns ------------------------------------------------------------------


def numbered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(_conv, _pos, _letter, _chars) with positions from 1, and (_conv, _n)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), letter(role, text).alias("_letter"), F.char_length(text).cast("long").alias("_chars"))
    order = ["_turn", "_letter", "_lot"]  # equal turns are spread by the task that read them
    rows = rows.withColumn("_lot", F.spark_partition_id()).repartitionByRange("_conv", *order)
    rows = stored(rows.withColumn("_part", F.spark_partition_id()))
    sizes = cut(rows.groupBy("_part", "_conv").agg(F.count("*").alias("_here")))
    before = F.sum("_here").over(Window.partitionBy("_conv").orderBy("_part")) - F.col("_here")
    earlier = cut(sizes.withColumn("_before", before).where("_before > 0").drop("_here"))  # only the first conversation of a range
    inside = F.row_number().over(Window.partitionBy("_part", "_conv").orderBy(*order))
    rows = rows.withColumn("_in", inside).join(F.broadcast(earlier), ["_part", "_conv"], "left")
    rows = rows.select("_conv", (F.col("_in") + F.coalesce("_before", F.lit(0))).alias("_pos"), "_letter", "_chars")
    return rows, sizes.groupBy("_conv").agg(F.sum("_here").alias("_n"))


def rebuilt(rows: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_conv, _pos, _letter, _chars, _total) of the rebuilt conversations, and (_conv, _total)."""
    opening = F.crc32(F.col("_conv").cast("string")) % 6
    heads = rows.where((F.col("_conv") % 100 == 0) & (F.col("_pos") <= 5)).groupBy(F.col("_conv").alias("_base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("_pos", "_letter", "_chars"))).alias("_head"))  # five at most
    convs = counts.withColumns({"_base": F.col("_conv") - F.col("_conv") % 100, "_h": opening}).join(heads, "_base", "left")
    head = F.coalesce(F.col("_head").cast(HEAD), F.array().cast(HEAD))
    convs = convs.withColumn("_head", F.slice(head, F.lit(1), F.col("_h").cast("int")))
    convs = convs.withColumn("_k", F.size("_head").cast("long"))
    convs = stored(convs.select("_conv", "_head", "_k", "_h", (F.col("_k") + F.greatest(F.col("_n") - F.col("_h"), F.lit(0))).alias("_total")))
    opened = convs.select("_conv", "_total", F.inline("_head"))
    own = spread_join(stored(rows.where(F.col("_pos") > opening)), convs.select("_conv", "_k", "_h", "_total"), ["_conv"], "inner")
    own = own.withColumn("_pos", F.col("_pos") - F.col("_h") + F.col("_k"))
    names = ["_conv", "_pos", "_letter", "_chars", "_total"]
    return opened.select(*names).unionByName(own.select(*names)), convs.select("_conv", "_total")


def on_paths(rows: DataFrame) -> DataFrame:
    """Adds to each turn its node (_a, _b), the parent (_pa, _pb), the node before its block (_ua, _ub), the block's hashes so far (_xa, _xb) and their string (_key)."""
    rows = rows.withColumns({"_chunk": F.floor((F.col("_pos") - 1) / CHUNK), "_block": F.floor((F.col("_pos") - 1) / BLOCK)})
    rows = rows.withColumns({"_ha": F.xxhash64(F.lit(1), "_pos", "_letter"), "_hb": F.xxhash64(F.lit(2), "_pos", "_letter")})
    far = rows.where(F.col("_total") > CHUNK).groupBy("_conv", "_chunk").agg(F.bit_xor("_ha").alias("_ca"), F.bit_xor("_hb").alias("_cb"))
    earlier = Window.partitionBy("_conv").orderBy("_chunk")  # a row for each chunk
    far = cut(far.withColumns({"_ca": F.bit_xor("_ca").over(earlier).bitwiseXOR(F.col("_ca")), "_cb": F.bit_xor("_cb").over(earlier).bitwiseXOR(F.col("_cb"))}))
    chunk, block = Window.partitionBy("_conv", "_chunk").orderBy("_block", "_pos"), Window.partitionBy("_conv", "_chunk", "_block").orderBy("_pos")
    rows = rows.withColumns({"_a": F.bit_xor("_ha").over(chunk), "_b": F.bit_xor("_hb").over(chunk)})
    rows = rows.withColumns({"_xa": F.bit_xor("_ha").over(block), "_xb": F.bit_xor("_hb").over(block), "_key": F.array_join(F.collect_list("_letter").over(block), "")})
    if not far.isEmpty():
        rows = rows.join(maybe_broadcast(far, 100_000), ["_conv", "_chunk"], "left")  # a key has CHUNK rows at most
        rows = rows.withColumns({"_a": F.coalesce(_xor("_a", "_ca"), "_a"), "_b": F.coalesce(_xor("_b", "_cb"), "_b")})
    up = {"_pa": _xor("_a", "_ha"), "_pb": _xor("_b", "_hb"), "_ua": _xor("_a", "_xa"), "_ub": _xor("_b", "_xb")}
    return rows.withColumns(up).drop("_chunk", "_block", "_ha", "_hb", "_ca", "_cb")


# --- order --------------------------------------------------------------------


def events(nodes: DataFrame) -> DataFrame:
    """(_a, _b, _open, _place, _opened, _leaves, _saved): two events of each node in order of _key and _close, with running sums of what opened before."""
    both = F.explode(F.array(F.struct(F.lit(True).alias("_open"), F.col("_key").alias("_at")), F.struct(F.lit(False).alias("_open"), F.col("_close").alias("_at"))))
    rows = nodes.select(*NODE, "_leaf", "_save", both.alias("_e")).select(*NODE, "_leaf", "_save", "_e.*")
    rows = stored(rows.repartitionByRange("_at", *NODE).withColumn("_part", F.spark_partition_id()))
    of = {"_place": F.lit(1), "_opened": F.col("_open").cast("long"), "_leaves": F.when(F.col("_open"), F.col("_leaf")).otherwise(0), "_saved": F.when(F.col("_open"), F.col("_save")).otherwise(0)}
    parts = rows.groupBy("_part").agg(*(F.sum(c).alias("_" + k) for k, c in of.items()))
    over = Window.partitionBy(F.lit(0)).orderBy("_part")  # a row for each range
    parts = cut(parts.select("_part", *((F.sum("_" + k).over(over) - F.col("_" + k)).alias("_" + k) for k in of)))
    inside = Window.partitionBy("_part").orderBy("_at", *NODE).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({k: F.sum(c).over(inside) - (c if k != "_place" else 0) for k, c in of.items()}).join(F.broadcast(parts), "_part")
    return rows.select(*NODE, "_open", *((F.col(k) + F.col("_" + k)).alias(k) for k in of))


def paired(order: DataFrame, names: list[str]) -> DataFrame:
    """A row for each node: each name with 0 at the opening and 1 at the close."""
    at = lambda c, open_: F.max(F.when(F.col("_open") == open_, F.col(c)))
    return order.groupBy(*NODE).agg(*(at(c, True).alias(c + "0") for c in names), *(at(c, False).alias(c + "1") for c in names))


def in_preorder(nodes: DataFrame, marks: DataFrame, deepest: int) -> DataFrame:
    """paired() of all nodes in preorder. nodes: _key below the node (_ua, _ub); marks: the nodes at multiples of BLOCK on each conversation."""
    level = nodes.withColumn("_close", F.concat("_key", F.lit(AFTER_ALL)))
    size = BLOCK
    while size < deepest:
        # the ranks so far are the letters of the next level
        name = lambda c: F.lpad(F.hex(c), NAME, "0")
        ranks = stored(paired(events(level), ["_place"]).select(*NODE, name("_place0").alias("_key"), name("_place1").alias("_close")))
        marks = stored(marks.where(F.col("_pos") % size == 0))
        named = spread_join(marks, stored(ranks.select(*NODE, "_key")), NODE, "inner")
        block = Window.partitionBy("_conv", F.floor((F.col("_pos") / size - 1) / BLOCK)).orderBy("_pos")
        marks = stored(named.withColumns({"_key": F.array_join(F.collect_list("_key").over(block), ""), "_xa": F.bit_xor("_xa").over(block), "_xb": F.bit_xor("_xb").over(block)}))
        up = marks.where(F.col("_pos") % (size * BLOCK) != 0).withColumns({"_va": _xor("_a", "_xa"), "_vb": _xor("_b", "_xb")})
        up = stored(up.groupBy(F.col("_a").alias("_ua"), F.col("_b").alias("_ub")).agg(*_any("_key", "_va", "_vb")).withColumnRenamed("_key", "_path"))
        level = stored(level.drop("_key", "_close").join(ranks, NODE))
        level = spread_join(level, up, ["_ua", "_ub"])
        path = F.coalesce("_path", F.lit(""))
        level = level.withColumns({"_key": F.concat(path, "_key"), "_close": F.concat(path, "_close"), "_ua": F.coalesce("_va", "_ua"), "_ub": F.coalesce("_vb", "_ub")}).drop("_path", "_va", "_vb")
        marks = marks.drop("_key")
        size *= BLOCK
    return paired(events(level), ["_opened", "_leaves", "_saved"])


# --- lists of ids ------------------------------------------------------------


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (_a, _b, _conv) to (_a, _b, _first, _ids): ids of a node joined by commas, PIECE at most."""
    node, ids, out = None, [], []

    def flush() -> None:
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))

    def take() -> pa.RecordBatch:
        a, b, first, text = zip(*out)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(first, pa.int64()), pa.array(text, pa.string())], [*NODE, "_first", "_ids"])

    for batch in batches:
        for a, b, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (a, b) != node or len(ids) == PIECE:
                flush()
                node, ids = (a, b), []
            ids.append(c)
        if out:
            yield take()
    flush()
    if out:
        yield take()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to (_a, _b, ends_sha256); a piece is held at a time, whatever the length of the list."""
    node, sha, out = None, None, []

    def take() -> pa.RecordBatch:
        a, b, text = zip(*out)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(text, pa.string())], [*NODE, "ends_sha256"])

    for batch in batches:
        for a, b, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (a, b) != node:
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = (a, b), hashlib.sha256(text.encode())
            else:
                sha.update(b"," + text.encode())
        if out:
            yield take()
    if node:
        out.append((*node, sha.hexdigest()))
        yield take()


def end_lists(ends: DataFrame) -> DataFrame:
    """(_a, _b, ends_sha256) from (_a, _b, _conv). Ranges join ids to pieces, so the one task that a hash needs reads a row for thousands of them."""
    by = [*NODE, "_conv"]
    pieces = arrow_scan(ends.select(*by).repartitionByRange(*by).sortWithinPartitions(*by), _pieces, "_a bigint, _b bigint, _first bigint, _ids string")
    return arrow_scan(pieces.repartition(*NODE).sortWithinPartitions(*NODE, "_first"), _hashed, "_a bigint, _b bigint, ends_sha256 string")


# --- the trie --------------------------------------------------------------


def trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, preorder, subtree_end.

    preorder numbers the nodes from 0; those from preorder up to subtree_end are the node's subtree.
    """
    spark = turns.sparkSession
    rows, convs = rebuilt(*numbered(turns, conv, turn, role, text))
    rows = stored(on_paths(stored(rows)))
    ended = F.col("_pos") == F.col("_total")
    nodes = rows.groupBy(*NODE).agg(F.min("_conv").alias("_conv"), F.count("*").alias("_n"), F.sum(ended.cast("long")).alias("_ends"), *_any("_pos", "_chars", "_key", "_pa", "_pb", "_ua", "_ub"))
    r = convs.agg(F.min("_conv"), F.count("*"), F.count_if(F.col("_total") == 0), F.coalesce(F.max("_total"), F.lit(0))).first()
    kinds = "_a long, _b long, _conv long, _n long, _ends long, _pos long, _chars long, _key string, _pa long, _pb long, _ua long, _ub long"
    root = spark.createDataFrame([(0, 0, r[0], r[1], r[2], 0, 0, "", None, None, 0, 0)] if r[1] else [], kinds)
    weights = {"_leaf": (F.col("_n") == F.col("_ends")).cast("long"), "_save": (F.col("_n") - 1) * F.col("_chars")}
    nodes = stored(nodes.withColumns({"_conv": F.col("_conv").cast("long"), "_pos": F.col("_pos").cast("long")}).unionByName(root).withColumns(weights))

    sums = in_preorder(nodes.select(*NODE, "_leaf", "_save", "_key", "_ua", "_ub"), rows.where(F.col("_pos") % BLOCK == 0).select("_conv", "_pos", *NODE, "_xa", "_xb"), r[3])
    ends = rows.where(ended).select(*NODE, F.col("_conv").cast("long").alias("_conv"))
    ends = ends.unionByName(convs.where("_total = 0").select(F.lit(0).cast("long").alias("_a"), F.lit(0).cast("long").alias("_b"), F.col("_conv").cast("long").alias("_conv")))
    children = nodes.groupBy("_pa", "_pb").agg(F.count("*").alias("_children")).where("_pa is not null").toDF(*NODE, "_children")
    parents = nodes.where("_n > _ends").select(F.col("_a").alias("_pa"), F.col("_b").alias("_pb"), F.col("_conv").alias("_parent"))
    out = spread_join(nodes, stored(parents), ["_pa", "_pb"])
    out = out.join(sums, NODE).join(children, NODE, "left").join(end_lists(ends), NODE, "left")
    return out.select(
        F.col("_conv").alias("conv_id"),
        F.col("_pos").alias("depth"),
        F.col("_parent").alias("parent_conv_id"),
        F.col("_n").alias("n_convs"),
        F.coalesce("_children", F.lit(0)).cast("long").alias("n_children"),
        (F.col("_leaves1") - F.col("_leaves0")).alias("n_leaves"),
        (F.col("_saved1") - F.col("_saved0")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        F.col("_opened0").alias("preorder"),
        F.col("_opened1").alias("subtree_end"),
    )


ORACLE = """
    with crc as materialized (
        select conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s)::bigint)),
            lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
                lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end))) % 6 as h
        from (select distinct conv_id from conversations where conv_id is not null)),
    t as materialized (
        select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
               row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
        from conversations where conv_id is not null),
    r as materialized (
        select crc.conv_id, pos as o, 0 as part, role, text from crc join t on t.conv_id = crc.conv_id - crc.conv_id % 100 and pos <= h
        union all select conv_id, pos, 1, role, text from t join crc using (conv_id) where pos > h),
    s as materialized (select *, row_number() over (partition by conv_id order by part, o) as d from r),
    p as materialized (
        select conv_id, d, text, string_agg(sha256(length(role) || ':' || role || text), '' order by d) over (partition by conv_id order by d) as path, count(*) over (partition by conv_id) as n
        from s union all select conv_id, 0, '', '', (select count(*) from s where s.conv_id = crc.conv_id) from crc),
    nodes as materialized (
        select path, any_value(d) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(length(text)) as chars,
               string_agg(case when d = n then conv_id::varchar end, ',' order by conv_id) as ends
        from p group by path),
    kids as materialized (select left(path, -64) as path, count(*) as n_children from nodes where depth > 0 group by all),
    up as materialized (
        select path[:64 * k] as path, sum(leaf) as n_leaves, sum(save) as saved_tokens from (
            select path, unnest(range(depth + 1)) as k, (n_children is null)::int as leaf, (n_convs - 1) * chars as save from nodes left join kids using (path)) group by all)
    select nodes.conv_id, nodes.depth::bigint as depth, over_.conv_id as parent_conv_id, nodes.n_convs, coalesce(n_children, 0) as n_children,
           n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, sha256(coalesce(nodes.ends, '')) as ends_sha256
    from nodes join up using (path) left join kids using (path)
    left join nodes over_ on nodes.depth > 0 and over_.path = left(nodes.path, -64)"""
