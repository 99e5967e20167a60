"""Option sets: distractors, hard negatives, builders and suites, drawn by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import digest, digest_sql, uniform, uniform_sql
from ..operators import negatives as N
from ..operators import splits as S
from ..operators.negatives import drawn_ranks
from .registry import query, table

_LABELS = "l as (select *, row_number() over (order by label) - 1 as place, count(*) over () as n from (select distinct p_name as label, list_distinct(regexp_extract_all(lower(p_name),'[a-z0-9]+')) as w from part where p_name is not null))"


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct labels with their words."""
    return table(spark, sf, "part").select(F.col("p_name").alias("label")).distinct().withColumn("w", F.array_distinct(T.tokens(F.col("label"))))


def distractors_sql(k: int) -> str:
    """Tables l and d (label, other, sim, r): the first k of the draws of each label that are unlike it, else the k least similar."""
    sim = "coalesce(len(list_intersect(a.w,b.w))/nullif(len(list_distinct(a.w||b.w)),0)::double, 0)"
    return f"""{_LABELS}, t as (select unnest(range({N.DRAWS[-1] * k})) as t),
    drawn as (select a.label, b.label as other, {sim} as sim, min(t) as t from l a cross join t join l b on b.place = floor({uniform_sql('dis', 'a.label', 't')}*a.n)::bigint
        where a.label <> b.label and {sim} < {N.ALIKE} group by all),
    picks as (select label, other, sim, row_number() over (partition by label order by t) as r, count(*) over (partition by label) >= least({k}, (select max(n) - 1 from l)) as ok from drawn),
    least_ as (select a.label, b.label as other, {sim} as sim, row_number() over (partition by a.label order by {sim}, b.place) as r from l a, l b where a.label <> b.label and a.label not in (select label from picks where ok)),
    d as (select label, other, sim, r from picks where ok and r <= {k} union all select * from least_ where r <= {k})"""


@query(f"with {distractors_sql(5)} select label, other, round(sim,6) as sim, r::int as r from d")
def distractor_labels(spark, sf):
    return N.distractors(labels(spark, sf), 5).select("label", "other", F.round("sim", 6).alias("sim"), "r")


@query("with s as (select distinct p_brand as source, p_name as label from part) select a.source, count(*) as pool, count(distinct b.label) as labels from (select distinct source from s) a join s b on a.source <> b.source group by a.source")
def foreign_pool(spark, sf):
    """Labels of other sources, repeats kept: all pairs less the source's own, without a join of unequal keys."""
    s = table(spark, sf, "part").select(F.col("p_brand").alias("source"), F.col("p_name").alias("label")).distinct()
    per = s.groupBy("label").agg(F.count("*").alias("k"))
    own = s.join(per, "label").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("k") == 1).alias("only"))
    t = per.agg(F.sum("k").alias("all"), F.count("*").alias("labels"))
    return own.crossJoin(F.broadcast(t)).select("source", (F.col("all") - F.col("n")).alias("pool"), (F.col("labels") - F.col("only")).alias("labels"))


@query()
def hard_negatives(spark, sf):
    """Four other labels of the same source and three of any for every row: ranks of the catalogue are drawn without repeats and joined by equality, so no row meets all labels."""
    q = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name").where("p_name is not null")
    s = q.select(F.col("p_brand").alias("b"), F.col("p_name").alias("label")).distinct()
    place = lambda rows, by, seed: S.hash_ranked(rows, by, seed, "label").select(*by, "label", (F.col("_rank") - 1).alias("pos"), "_n")
    within, bank = place(s, ["b"], "hard"), place(s.select("label").distinct(), [], "any")
    mine = q.select("p_partkey", F.col("p_brand").alias("b"), F.col("p_name").alias("label"))
    key = F.col("p_partkey")
    picked = mine.join(within, ["b", "label"]).select("p_partkey", "b", F.explode(drawn_ranks("hard", key, F.col("_n"), F.array("pos"), 4)).alias("pos"))
    same = picked.join(within, ["b", "pos"]).select("p_partkey", "label")
    taken = same.unionByName(mine.select("p_partkey", "label")).join(bank, "label").groupBy("p_partkey").agg(F.collect_list("pos").alias("t"), F.first("_n").alias("_n"))
    others = taken.select("p_partkey", F.explode(drawn_ranks("any", key, F.col("_n"), F.array_sort("t"), 3)).alias("pos")).join(bank, "pos")
    return same.select("p_partkey", F.lit("same").alias("kind"), "label").unionByName(others.select("p_partkey", F.lit("any").alias("kind"), "label"))


def _mix_sql(options: int = 6) -> str:
    """Draws without repeats, one common table expression for each: a place among those left, moved past the ones taken."""
    hard = min(options - 1, max(1, (options - 1) * 2 // 3))

    def steps(name: str, seed: str, times: int, more: str) -> list[str]:
        out = []
        for j in range(times):
            move = f"list_reduce(list_prepend(floor({uniform_sql(seed, 'key', str(j))}*(n-len(t)))::bigint, list_sort(t)), lambda p, x: case when x <= p then p + 1 else p end)"
            out.append(f"{name}{j + 1} as (select * replace (case when n > len(t) and {more} then list_append(t, {move}) else t end as t) from {name}{j})")
        return out

    parts = [
        "q as (select p_partkey as key, p_brand as b, p_name as label from part where p_name is not null)",
        f"w as (select *, row_number() over (partition by b order by {digest_sql('hard', 'label')}, label) - 1 as pos, count(*) over (partition by b) as n from (select distinct b, label from q))",
        f"bank as (select *, row_number() over (order by {digest_sql('any', 'label')}, label) - 1 as pos, count(*) over () as n from (select distinct label from q))",
        "h0 as (select key, q.b, q.label, n, [pos]::bigint[] as t from q join w on w.b is not distinct from q.b and w.label = q.label)",
        *steps("h", "hard", hard, "true"),
        f"same as (select key, w.label from (select key, b, unnest(t[2:]) as pos from h{hard}) x join w on w.b is not distinct from x.b and w.pos = x.pos)",
        "a0 as (select key, any_value(n) as n, list_sort(list(pos))::bigint[] as t, count(*) as had from (select key, label from same union all select key, label from q) join bank using (label) group by key)",
        *steps("a", "any", options - 1, f"len(t) < {options}"),
        f"rest as (select key, bank.label from (select key, unnest(t[had + 1:]) as pos from a{options - 1}) x join bank using (pos))",
    ]
    return f"with {', '.join(parts)} select key as p_partkey, 'same' as kind, label as p_name from same union all select key, 'any', label from rest"


@query(_mix_sql())
def hard_negative_mix(spark, sf):
    """Six options a row: three hard negatives of five others, two from anywhere."""
    return N.hard_negatives(table(spark, sf, "part"), "p_partkey", "p_brand", "p_name")


_BUILD = f"""with {distractors_sql(3)}, o as (select p_partkey, p_name as t, p_name as truth from part union all select p_partkey, other, p_name from part join d on d.label = p_name),
    b as (select p_partkey, truth, list(t order by {digest_sql('mix', 'p_partkey', 't')}) as opts from o group by all)"""


@query(
    _BUILD + f""" select p_partkey, case (floor({uniform_sql('instr', 'p_partkey')}*3))::int when 0 then 'Pick the intent.' when 1 then 'What is asked for?' else '' end as instruction,
      array_to_string(opts,'|') as options, (list_position(opts,truth)-1)::int as answer_idx, len(opts)::int as n from b"""
)
def build_intent(spark, sf):
    """The true label and three distractors in hashed order, with an instruction from a bank of three."""
    d = N.distractors(labels(spark, sf), 3).groupBy("label").agg(F.collect_list("other").alias("others"))
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("label")).join(d, "label")
    keyed = F.transform(F.concat(F.array("label"), "others"), lambda t: F.struct(digest("mix", F.col("p_partkey"), t).alias("h"), t.alias("t")))
    opts = F.transform(F.array_sort(keyed), lambda x: x["t"])
    bank = F.array(F.lit("Pick the intent."), F.lit("What is asked for?"), F.lit(""))
    text = F.element_at(bank, (F.floor(uniform("instr", F.col("p_partkey")) * 3) + 1).cast("int"))
    return rows.select("p_partkey", text.alias("instruction"), F.array_join(opts, "|").alias("options"), (F.array_position(opts, F.col("label")) - 1).cast("int").alias("answer_idx"), F.size(opts).alias("n"))


@query(
    f"""select o_orderkey, case when {uniform_sql('order', 'o_orderkey')} < 0.5 then 'no|yes' else 'yes|no' end as options,
      case when {uniform_sql('order', 'o_orderkey')} < 0.5 then (o_orderstatus='F')::int else 1-(o_orderstatus='F')::int end as answer_idx,
      case when {uniform_sql('order', 'o_orderkey')} < 0.5 then 'yes|no' else 'no|yes' end as swapped, case when {uniform_sql('order', 'o_orderkey')} < 0.5 then 1-(o_orderstatus='F')::int else (o_orderstatus='F')::int end as swapped_idx from orders"""
)
def build_bool(spark, sf):
    """A yes/no request whose order is a coin flip, and its swapped twin."""
    heads = uniform("order", F.col("o_orderkey")) < 0.5
    yes = (F.col("o_orderstatus") == "F").cast("int")
    idx = F.when(heads, yes).otherwise(1 - yes)
    opts = F.when(heads, F.array(F.lit("no"), F.lit("yes"))).otherwise(F.array(F.lit("yes"), F.lit("no")))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(opts, "|").alias("options"), idx.alias("answer_idx"), F.array_join(F.reverse(opts), "|").alias("swapped"), (1 - idx).alias("swapped_idx"))


@query("select o_orderkey, array_to_string(list_transform(range(1,6), lambda i: 'level '||i||' of 5'),'|') as options, (substr(o_orderpriority,1,1)::int-1) as answer_idx from orders")
def build_score(spark, sf):
    opts = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.concat(F.lit("level "), i.cast("string"), F.lit(" of 5")))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(opts, "|").alias("options"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("answer_idx"))


@query(
    f"""with o as (select c_custkey, c_mktsegment, list_sort(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY']) as a, 2+floor({uniform_sql('k', 'c_custkey')}*4)::int as k from customer),
    s as (select c_custkey, c_mktsegment, list_sort(list_distinct([c_mktsegment]||list_sort(list_transform(list_filter(a, lambda x: x <> c_mktsegment), lambda x: md5('sub|'||c_custkey||'|'||x)||x))[1:k-1])) as z from o)
    select c_custkey, len(z)::int as n, (list_position(list_sort(list_transform(z, lambda x: case when x = c_mktsegment then x else substr(x,33) end)), c_mktsegment)-1)::int as answer_idx from s"""
)
def build_subset(spark, sf):
    """A random subset of the native vocabulary that holds the answer, of two options at least."""
    names = F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")))
    key, truth = F.col("c_custkey"), F.col("c_mktsegment")
    k = (2 + F.floor(uniform("k", key) * 4)).cast("int")
    others = F.transform(F.filter(names, lambda x: x != truth), lambda x: F.struct(digest("sub", key, x).alias("h"), x.alias("x")))
    picked = F.transform(F.slice(F.array_sort(others), F.lit(1), k - 1), lambda s: s["x"])
    opts = F.array_sort(F.concat(F.array(truth), picked))
    return table(spark, sf, "customer").select("c_custkey", F.size(opts).alias("n"), (F.array_position(opts, truth) - 1).cast("int").alias("answer_idx"))


@query(
    f"""with r as (select 'paraphrase/all' as grp, item_id as id, 'bool' as qtype, item_id%2 as answer_idx from benchmark union all
      select 'oos/all', doc_id, 'bool', (lang='en')::int from documents union all select 'score/orders', o_orderkey, 'score', substr(o_orderpriority,1,1)::int-1 from orders),
    t as (select * from r qualify row_number() over (partition by grp order by {digest_sql('suite', 'id')}, id) <= 500)
    select grp, qtype, count(*) as n, sum(answer_idx)::bigint as checksum, split_part(grp,'/',1) in ('paraphrase','score') as selected from t group by all"""
)
def validation_suite(spark, sf):
    """Named groups in one long table, a seeded take of 500 of each, and whether a group's family takes part in model selection."""
    one = lambda t, g, i, q, a: table(spark, sf, t).select(F.lit(g).alias("grp"), i.cast("long").alias("id"), F.lit(q).alias("qtype"), a.cast("int").alias("answer_idx"))
    r = one("benchmark", "paraphrase/all", F.col("item_id"), "bool", F.col("item_id") % 2)
    r = r.unionByName(one("documents", "oos/all", F.col("doc_id"), "bool", F.col("lang") == "en"))
    r = r.unionByName(one("orders", "score/orders", F.col("o_orderkey"), "score", F.substring("o_orderpriority", 1, 1).cast("int") - 1))
    t = S.capped(r, ["grp"], r.groupBy("grp").agg(F.count("*").alias("n")).withColumn("cap", F.lit(500)), "suite", "id")
    family = F.split_part("grp", F.lit("/"), F.lit(1))
    return t.groupBy("grp", "qtype").agg(F.count("*").alias("n"), F.sum("answer_idx").alias("checksum")).withColumn("selected", family.isin("paraphrase", "score"))


@query(
    """with g as (select c_custkey, list_filter(['up','down','left','right'], lambda x, i: (c_custkey >> (i-1)) % 2 = 1) as opts from customer)
    select c_custkey, case len(opts) when 0 then 'trapped' when 1 then 'forced' else 'model' end as gate, case when len(opts) = 1 then 1.0 end::double as prob from g"""
)
def request_gating(spark, sf):
    """No option is a trap, one is forced with probability one, more go to the model."""
    dirs = F.array(*map(F.lit, ("up", "down", "left", "right")))
    opts = F.filter(dirs, lambda x, i: F.getbit(F.col("c_custkey"), i.cast("int")) == 1)
    n = F.size(opts)
    return table(spark, sf, "customer").select("c_custkey", F.when(n == 0, "trapped").when(n == 1, "forced").otherwise("model").alias("gate"), F.when(n == 1, 1.0).alias("prob"))


@query(
    """with d as (select c_nationkey, c_custkey, c_custkey % 7 as dist from customer), m as (select *, max(dist) over (partition by c_nationkey) as mx from d)
    select c_custkey, round((mx+1-dist)/sum(mx+1-dist) over (partition by c_nationkey)::double,9) as prob from m"""
)
def heuristic_scores(spark, sf):
    """Nearer is better, normalised within the group; group totals are aggregated and joined back."""
    d = table(spark, sf, "customer").select("c_nationkey", "c_custkey", (F.col("c_custkey") % 7).alias("dist"))
    g = d.groupBy("c_nationkey").agg(F.max("dist").alias("mx"), F.sum("dist").alias("s"), F.count("*").alias("n"))
    x = d.join(g, "c_nationkey")
    return x.select("c_custkey", F.round((F.col("mx") + 1 - F.col("dist")) / ((F.col("mx") + 1) * F.col("n") - F.col("s")), 9).alias("prob"))


@query(
    """with t as (select conv_id, turn, role, length(text) as n from conversations), b as (select conv_id, count(*) as k, max(case when turn = 0 then n else 0 end) as ctx from t group by conv_id)
    select conv_id, greatest(0, least(128, (2048-20-ctx-(4+k))//k))::bigint as per_option from b"""
)
def option_budget(spark, sf):
    """Room for each option once instructions, context and marks are placed."""
    b = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("k"), F.max(F.when(F.col("turn") == 0, F.char_length("text")).otherwise(0)).alias("ctx"))
    return b.select("conv_id", F.greatest(F.lit(0), F.least(F.lit(128), F.expr("(2048 - 20 - ctx - (4 + k)) div k"))).cast("long").alias("per_option"))


@query(
    """with t as (select conv_id, turn, len(regexp_extract_all(text,'[^ ]+')) as n from conversations)
    select conv_id, turn, (1+3+sum(n+1) over w - n)::bigint as mask_pos, (1+3+sum(n+1) over w)::bigint as end_pos from t window w as (partition by conv_id order by turn rows unbounded preceding)"""
)
def sequence_assembly(spark, sf):
    """Positions of the marks when start, a three-token instruction and the turns, a mark before each, are laid end to end."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.regexp_count("text", F.lit("[^ ]+")).alias("n"))
    end = F.sum(F.col("n") + 1).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return t.select("conv_id", "turn", (4 + end - F.col("n")).alias("mask_pos"), (4 + end).alias("end_pos"))
