"""Multi-party perspective rotation: each dialogue once for every participant.

For each participant the dialogue is rendered with that speaker as the
assistant and all others as named users; system messages stay system messages
and are no one's perspective. The result has one row for each perspective and
message, with the rendered text, its place in the rendering, and the span that
the loss mask covers (the assistant's words and the end mark).

Messages follow turn, then role, then text. The texts of a dialogue of up to
HOT messages are shuffled once, by dialogue. The messages of all longer
dialogues are counted where they are equal and dealt to ranges of that order,
so that a dialogue with a third of all messages, or a message repeated without
end, is spread over as many tasks as there are shuffle partitions. What earlier
ranges hold of a dialogue reaches a range as counts and lengths, which are
summed without texts. Ranges are told by the first characters of a text, which
is all that Spark samples; different texts of one turn and role that agree in
them stay in one range.

Null texts count as empty and null roles as `unknown`; repeated messages are
repeated in the rendering; a null turn comes first. Dialogues of system
messages alone have no perspective and no rows. Control marks inside texts are
broken by a space. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast, shuffle_partitions, stored

SYSTEM = "system"
ASSISTANT_HEAD, SYSTEM_HEAD, END = "<|assistant|>\n", "<|system|>\n", "<|end|>\n"
USER_HEAD = len("<|user name=|>\n")
HOT = 1000
#: Characters of a role, and a quarter of those of a text, that tell ranges of long dialogues.
HEAD = 64
#: Array entries that are broadcast; beyond it the join is a shuffle.
BROADCAST_ENTRIES = 50_000


def _attach(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on equal keys, null being equal to null."""
    right = right.withColumnsRenamed({k: "_r" + k for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col("_r" + k)) for k in keys))
    return left.join(right, same, how).drop(*("_r" + k for k in keys))


def _bounded(df: DataFrame, entries: str) -> DataFrame:
    """Marks a checkpointed table for broadcast if its arrays have few entries in all."""
    total = df.agg(F.sum(F.size(entries))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_ENTRIES else df


def _spread(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """rows with _part, and for hot dialogues with _copies of equal messages and _views: what each perspective has before the part."""
    few = hot.count() <= BROADCAST_ENTRIES
    rows = _attach(rows, F.broadcast(hot) if few else hot, ["_conv"])
    same = ["_conv", "_turn", "_role", "_text", "_len"]
    big = rows.where("_count is not null").groupBy(*same).agg(F.count("*").alias("_all"))
    # a message repeated without end is dealt in lots
    # ranges are told by the heads of role and text, so no whole text is sampled; lots of one text stand apart if no other has its heads
    short = F.char_length("_role") <= HEAD
    big = big.withColumns({"_who": F.substring("_role", 1, HEAD), "_head": F.when(short, F.substring("_text", 1, 4 * HEAD)).otherwise("")})
    heads = ["_conv", "_turn", "_who", "_head"]
    shared = cut(big.groupBy(*heads).agg(F.count("*").alias("_same")).where("_same > 1"))
    big = _attach(big, maybe_broadcast(shared, BROADCAST_ENTRIES), heads)
    big = big.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_all - 1) div {HOT}"))))
    big = big.withColumn("_copies", F.least(F.lit(HOT), F.col("_all") - F.col("_lot") * HOT).cast("long")).drop("_all")
    big = big.withColumn("_own_lot", F.when(F.col("_same").isNull(), F.col("_lot")).otherwise(0)).drop("_same")
    big = big.repartitionByRange(shuffle_partitions(rows.sparkSession), *heads, "_own_lot").drop("_who", "_head", "_own_lot")
    big = stored(big.withColumn("_part", F.spark_partition_id() + 1))

    units = cut(big.groupBy("_conv", "_part", "_role").agg(F.sum("_copies").alias("_rows"), F.sum(F.col("_len") * F.col("_copies")).alias("_chars")))
    people = units.where(F.col("_role") != SYSTEM).select("_conv", F.col("_role").alias("perspective")).distinct()
    own = units.select("_conv", "_part", F.col("_role").alias("perspective"), F.col("_rows").alias("_own"))
    parts = units.groupBy("_conv", "_part").agg(F.sum("_rows").alias("_rows"), F.sum("_chars").alias("_chars"))
    grid = _attach(_attach(parts, people, ["_conv"], "inner"), own, ["_conv", "_part", "perspective"])
    before = Window.partitionBy("_conv", "perspective").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    view = F.struct("perspective", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias("_before" + c) for c in ("_rows", "_chars", "_own")))
    views = cut(grid.select("_conv", "_part", view.alias("_view")).groupBy("_conv", "_part").agg(F.collect_list("_view").alias("_views")))
    big = _attach(big.drop("_lot"), _bounded(views, "_views"), ["_conv", "_part"])
    rest = rows.where("_count is null").drop("_count").withColumns({"_copies": F.lit(1).cast("long"), "_part": F.lit(0)})
    # dialogues of system messages alone have no views, and no rows
    return rest.unionByName(big.where("_views is not null"), allowMissingColumns=True)


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, perspective, position, turn, speaker, role_out, rendered, char_start, mask_start, mask_end); spans are half open, and null without a mask."""
    rows = turns.select(
        F.col(conv).alias("_conv"),
        F.col(turn).alias("_turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("_role"),
        F.replace(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("_text"),
    )
    # the length in the views of others
    head = F.when(F.col("_role") == SYSTEM, len(SYSTEM_HEAD)).otherwise(F.char_length("_role") + USER_HEAD)
    rows = rows.withColumn("_len", (head + F.char_length("_text") + len(END)).cast("long"))

    hot = cut(rows.groupBy("_conv").agg(F.count("*").alias("_count")).where(F.col("_count") > HOT))
    views_type = "array<struct<perspective:string,_before_rows:bigint,_before_chars:bigint,_before_own:bigint>>"
    if hot.isEmpty():
        rows = rows.withColumns({"_part": F.lit(0), "_copies": F.lit(1).cast("long"), "_views": F.lit(None).cast(views_type)})
    else:
        rows = _spread(rows, hot)

    part = Window.partitionBy("_conv", "_part")
    inside, earlier = part.orderBy("_turn", "_role", "_text"), (Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "_row": F.coalesce(F.sum("_copies").over(inside.rowsBetween(*earlier)), F.lit(0)),
        "_at": F.coalesce(F.sum(F.col("_len") * F.col("_copies")).over(inside.rowsBetween(*earlier)), F.lit(0)),
        "_seat": F.row_number().over(inside),
        "_here": F.collect_set(F.when(F.col("_role") != SYSTEM, F.col("_role"))).over(part),
    })
    alone = F.transform("_here", lambda p: F.struct(p.alias("perspective"), *(F.lit(0).cast("long").alias("_before" + c) for c in ("_rows", "_chars", "_own"))))
    seen = rows.withColumn("_view", F.explode(F.coalesce("_views", alone.cast(views_type)))).select("*", "_view.*").drop("_view", "_views", "_here")

    mine = F.col("_role") == F.col("perspective")
    spoken = F.sum(F.when(mine, F.col("_copies")).otherwise(0)).over(Window.partitionBy("_conv", "_part", "perspective").orderBy("_seat").rowsBetween(*earlier))
    # an own message has the assistant's head in place of the user's
    gain = len(ASSISTANT_HEAD) - USER_HEAD - F.char_length("perspective")
    start = F.col("_before_chars") + F.col("_at") + (F.col("_before_own") + F.coalesce(spoken, F.lit(0))) * gain
    seen = seen.withColumn("_start", start.cast("long")).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    seen = seen.withColumn("_start", F.col("_start") + F.col("_copy") * (F.col("_len") + F.when(mine, gain).otherwise(0)))
    is_system = F.col("_role") == SYSTEM
    return seen.select(
        F.col("_conv").alias(conv),
        "perspective",
        (F.col("_row") + F.col("_before_rows") + F.col("_copy")).cast("long").alias("position"),
        F.col("_turn").alias(turn),
        F.col("_role").alias("speaker"),
        F.when(mine, "assistant").when(is_system, SYSTEM).otherwise("user").alias("role_out"),
        F.concat(F.when(mine, ASSISTANT_HEAD).when(is_system, SYSTEM_HEAD).otherwise(F.concat(F.lit("<|user name="), F.col("_role"), F.lit("|>\n"))), F.col("_text"), F.lit(END)).alias("rendered"),
        F.col("_start").alias("char_start"),
        F.when(mine, F.col("_start") + len(ASSISTANT_HEAD)).cast("long").alias("mask_start"),
        F.when(mine, F.col("_start") + F.col("_len") + gain).cast("long").alias("mask_end"),
    )


ORACLE = """
    with t as (select conv_id, turn, coalesce(role, 'unknown') as speaker, replace(coalesce(text, ''), '<|', '< |') as body from conversations),
    people as (select distinct conv_id, speaker as perspective from t where speaker <> 'system'),
    seen as (
        select t.conv_id, perspective, turn, speaker, body,
               case when speaker = perspective then 'assistant' when speaker = 'system' then 'system' else 'user' end as role_out,
               case when speaker = perspective then '<|assistant|>' || chr(10) when speaker = 'system' then '<|system|>' || chr(10)
                    else '<|user name=' || speaker || '|>' || chr(10) end || body || '<|end|>' || chr(10) as rendered
        from t join people using (conv_id)),
    placed as (
        select *, row_number() over w - 1 as position,
               (sum(length(rendered)) over w)::bigint - length(rendered) as char_start
        from seen window w as (partition by conv_id, perspective order by turn, speaker, body rows unbounded preceding))
    select conv_id, perspective, position, turn, speaker, role_out, rendered, char_start,
           case when speaker = perspective then char_start + 14 end as mask_start,
           case when speaker = perspective then char_start + length(rendered) end as mask_end
    from placed"""
