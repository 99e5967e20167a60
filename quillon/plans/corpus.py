"""Deduplication, decontamination, splits, balance and weights over documents and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import digest, digest_sql, uniform, uniform_sql
from ..operators import dedup as D
from ..operators import splits as S
from .registry import query, table

KEY = "md5(trim(regexp_replace(regexp_replace(lower(coalesce(text,'')),'[^a-z0-9 ]',' ','g'),'\\s+',' ','g')))"
DOCS = f"""docs as (select *, {KEY} as k, case when u < 0.1 then 0 when u < 0.2 then 1 else 2 end as rnk
    from (select *, {uniform_sql('split', 'doc_id')} as u from documents))"""


def split_docs(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, source, lang, text key and a split rank (0 test, 1 val, 2 train) drawn by id; texts themselves are not carried."""
    u = uniform("split", F.col("doc_id"))
    rank = F.when(u < 0.1, 0).when(u < 0.2, 1).otherwise(2)
    return table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", T.norm_key(F.col("text")).alias("k"), rank.alias("rnk"))


@query(f"with {DOCS} select min(rnk)::int as src, count(*) as newly_added from (select k, min(rnk) as rnk from docs where rnk < 2 group by k) group by rnk")
def blocklist_counts(spark, sf):
    d = split_docs(spark, sf)
    blocked = D.blocklist((0, d.where("rnk = 0").select("k")), (1, d.where("rnk = 1").select("k")))
    return blocked.groupBy("src").agg(F.count("*").alias("newly_added"))


@query(f"with {DOCS}, b as (select {KEY} as k from benchmark) select doc_id from docs where k not in (select k from b)")
def blocklist_anti_join(spark, sf):
    blocked = D.blocklist((0, table(spark, sf, "benchmark").select(T.norm_key(F.col("text")))))
    return D.without_blocked(split_docs(spark, sf), blocked, "k").select("doc_id")


@query(
    """select doc_id from documents where not exists (select 1 from benchmark b where contains(
      regexp_replace(lower(documents.text),'[^a-z0-9]+',' ','g'), trim(regexp_replace(lower(b.text),'[^a-z0-9]+',' ','g'))))"""
)
def contains_benchmark(spark, sf):
    """Documents that contain no benchmark passage, as runs of letters and digits between single spaces."""
    docs = table(spark, sf, "documents").select("doc_id", D.spaced(F.col("text")).alias("t"))
    passages = table(spark, sf, "benchmark").select(D.spaced(F.col("text")).alias("passage"))
    return D.without_passages(docs, "doc_id", "t", passages).select("doc_id")


@query(f"with {DOCS} select doc_id, rnk::int as rnk from docs qualify row_number() over (partition by k order by rnk, doc_id) = 1")
def dedup_by_priority(spark, sf):
    return D.first_by_priority(split_docs(spark, sf), "k", ["rnk", "doc_id"]).select("doc_id", "rnk")


@query(f"with {DOCS} select doc_id, rnk::int as rnk from docs qualify min(rnk) over (partition by text) = rnk")
def dedup_across_splits(spark, sf):
    u = uniform("split", F.col("doc_id"))
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.when(u < 0.1, 0).when(u < 0.2, 1).otherwise(2).alias("rnk"))
    return D.not_in_higher_split(d, "h", "rnk").select("doc_id", "rnk")


@query(f"with {DOCS} select doc_id from docs where k not in (select k from docs group by k having count(distinct lang) > 1)")
def ambiguity_drop(spark, sf):
    return D.without_ambiguous(split_docs(spark, sf), "k", "lang").select("doc_id")


@query("select conv_id from (select conv_id, count(*) as n, count(distinct role) as d from conversations group by conv_id) where n = d")
def repeated_options(spark, sf):
    """Conversations in which no role speaks twice: counted by role, so no conversation is collected."""
    roles = table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    once = roles.groupBy("conv_id").agg(F.max("n").alias("most"), F.count_if(F.col("role").isNull()).alias("blank"))
    return once.where("most = 1 and blank = 0").select("conv_id")


@query(
    f"""with {DOCS} select doc_id from docs qualify row_number() over (partition by k, lang, source order by rnk, doc_id) = 1"""
)
def mcq_collapse(spark, sf):
    d = split_docs(spark, sf).withColumn("kk", F.struct("k", "lang", "source"))
    return D.first_by_priority(d, "kk", ["rnk", "doc_id"]).select("doc_id")


@query(
    f"""with {DOCS}, h as (select k, bool_or(rnk=0) as te, bool_or(rnk=1) as va, bool_or(rnk=2) as tr from docs group by k)
    select 'train_val' as pair, count(*) filter (tr and va) as shared from h union all select 'train_test', count(*) filter (tr and te) from h
    union all select 'val_test', count(*) filter (va and te) from h"""
)
def leakage_matrix(spark, sf):
    d = split_docs(spark, sf).withColumn("split", F.element_at(F.array(*map(F.lit, ("test", "val", "train"))), F.col("rnk") + 1))
    return D.leakage(d, "k", "split", [("train", "val"), ("train", "test"), ("val", "test")])


@query(
    """with l as (select distinct p_brand||'::'||replace(p_name,' ', case when p_partkey%2=0 then '_' else ' ' end) as label from part),
    n as (select label, translate(lower(regexp_replace(label,'^.*?::','')),'_-','  ') as nn from l)
    select label, min(label) over (partition by nn) as canonical from n"""
)
def label_merge(spark, sf):
    sep = F.when(F.col("p_partkey") % 2 == 0, "_").otherwise(" ")
    rows = table(spark, sf, "part").select(F.concat("p_brand", F.lit("::"), F.replace("p_name", F.lit(" "), sep)).alias("label"))
    return D.merged_labels(rows, "label", T.normalized_name(F.col("label")))


@query(
    """with u as (select 'part::'||p_type as label from part union all select 'segment::'||c_mktsegment from customer union all select 'status::'||case o_orderstatus when 'P' then 'oos' else o_orderstatus end from orders)
    select label, split_part(label,'::',1) as source, ends_with(label,'::oos') as oos, count(*) as n from u group by all"""
)
def tagged_union(spark, sf):
    tag = lambda t, s, c: table(spark, sf, t).select(F.concat(F.lit(s + "::"), c).alias("label"))
    status = F.when(F.col("o_orderstatus") == "P", "oos").otherwise(F.col("o_orderstatus"))
    rows = tag("part", "part", F.col("p_type")).unionByName(tag("customer", "segment", F.col("c_mktsegment"))).unionByName(tag("orders", "status", status))
    return rows.groupBy("label").agg(F.count("*").alias("n")).select("label", T.source_of(F.col("label")).alias("source"), F.endswith("label", F.lit("::oos")).alias("oos"), "n")


@query(
    f"""with r as (select doc_id, source, row_number() over (partition by source order by {digest_sql('ratio', 'doc_id')}, doc_id) as r, count(*) over (partition by source) as n from documents)
    select doc_id, case when r <= floor(0.1*n) then 'test' when r <= floor(0.1*n)+floor(0.1*n) then 'val' else 'train' end as split from r"""
)
def ratio_split(spark, sf):
    return S.ratio_split(table(spark, sf, "documents").select("doc_id", "source"), ["source"], "ratio", "doc_id").select("doc_id", "split")


@query("select source, count(*) as n, least(greatest(2*5, floor(count(*)/10)), floor(count(*)/5))::bigint as n_val from documents group by source")
def carve_val(spark, sf):
    n = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.withColumn("n_val", S.carve_size(F.col("n"), 5).cast("long"))


@query(
    f"""with g as (select distinct conv_id from conversations), r as (select conv_id, row_number() over (order by {digest_sql('grp', 'conv_id')}, conv_id) as r, count(*) over () as n from g)
    select c.conv_id, turn, case when r <= floor(0.7*n) then 'train' when r <= floor(0.7*n)+floor(0.15*n) then 'val' else 'test' end as split from conversations c join r on r.conv_id is not distinct from c.conv_id"""
)
def group_split(spark, sf):
    return S.group_split(table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", "grp").select("conv_id", "turn", "split")


@query(
    f"""with l as (select distinct p_name from part where p_name is not null), r as (select p_name, row_number() over (order by {digest_sql('zero', 'p_name')}, p_name) as r, count(*) over () as n from l),
    z as (select p_name from r where r <= floor(0.15*n)),
    t as (select p_partkey, p_name, case when {uniform_sql('split', 'p_partkey')} < 0.1 then 'test' else 'train' end as split from part)
    select p_partkey, case when p_name in (select p_name from z) then 'zero_shot' else split end as split from t where not coalesce(p_name in (select p_name from z), false) or split = 'test'"""
)
def zero_shot_holdout(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name", F.when(uniform("split", F.col("p_partkey")) < 0.1, "test").otherwise("train").alias("split"))
    zero = S.held_out_labels(rows, "p_name", "zero").withColumn("z", F.lit(True))
    rows = rows.join(zero, "p_name", "left").where("z is null or split = 'test'")
    return rows.select("p_partkey", F.when(F.col("z"), "zero_shot").otherwise(F.col("split")).alias("split"))


_N = "n as (select lang, count(*) as n, min(count(*)) over () as rarest, count(*) over () as k from documents group by lang)"
_PICK = "select doc_id from (select doc_id, lang, row_number() over (partition by lang order by {0}, doc_id) as r from documents) d join n on n.lang is not distinct from d.lang where r <= {1}".format


@query(f"with {_N} {_PICK(digest_sql('bal', 'doc_id'), 'least(200, greatest(rarest, 40))')}")
def balance_train(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return S.capped(d, ["lang"], S.train_cap(S.class_counts(d, "lang"), 200, 40), "bal", "doc_id").select("doc_id")


@query(f"with {_N} {_PICK(digest_sql('bal', 'doc_id'), 'least(greatest(1, floor(100/k)), greatest(rarest, 10))')}")
def balance_eval(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return S.capped(d, ["lang"], S.eval_cap(S.class_counts(d, "lang"), 100), "bal", "doc_id").select("doc_id")


@query(f"with {_N} {_PICK(digest_sql('bal', 'doc_id'), 'greatest(rarest, 50)')}")
def rebalance(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return S.capped(d, ["lang"], S.rebalance_cap(S.class_counts(d, "lang")), "bal", "doc_id").select("doc_id")


@query(
    f"""with x as (select o_orderkey, o_orderpriority as depth, case when o_orderkey % 3 = 0 then 'a' when o_orderpriority = '5-LOW' then 'c' else 'b' end as cell from orders),
    n as (select depth, cell, count(*) as n from x group by all),
    c as (select depth, case when count(*) filter (cell in ('a','b')) = 2 then least(min(n) filter (cell in ('a','b')), 500) else 0 end as cap from n group by depth)
    select o_orderkey from (select *, row_number() over (partition by depth, cell order by {digest_sql('cells', 'o_orderkey')}, o_orderkey) as r from x) x join c on c.depth is not distinct from x.depth where r <= cap"""
)
def equal_cell_sample(spark, sf):
    cell = F.when(F.col("o_orderkey") % 3 == 0, "a").when(F.col("o_orderpriority") == "5-LOW", "c").otherwise("b")
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("depth"), cell.alias("cell"))
    return S.equal_cells(rows, "depth", "cell", ["a", "b"], 500, "cells", "o_orderkey").select("o_orderkey")


@query(
    f"""with c as (select count(*) filter (o_orderstatus='F') as neu, count(*) filter (o_orderstatus='O') as con, count(*) filter (o_orderstatus='P') as yes from orders),
    k as (select least(neu, con, yes // 2) as k from c)
    select o_orderkey from (select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus order by {digest_sql('nc', 'o_orderkey')}, o_orderkey) as r from orders), k
    where r <= case when o_orderstatus = 'P' then 2*k else k end"""
)
def equal_negatives(spark, sf):
    """As many neutral as contradicting rows, and twice as many agreeing ones."""
    d = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    n = d.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    of = lambda s: F.count_if(F.col("o_orderstatus") == s)
    k = d.agg(F.least(of("F"), of("O"), F.floor(of("P") / 2)).alias("k"))
    cap = n.crossJoin(F.broadcast(k)).withColumn("cap", F.when(F.col("o_orderstatus") == "P", 2 * F.col("k")).otherwise(F.col("k")))
    return S.capped(d, ["o_orderstatus"], cap, "nc", "o_orderkey").select("o_orderkey")


@query(
    """with c as (select count(*) filter (source='src0') as have, count(*) filter (source<>'src0') as other from documents)
    select least(floor(0.15*other/(1-0.15)), have)::bigint as quota, other, have from c"""
)
def source_downweight(spark, sf):
    c = table(spark, sf, "documents").agg(F.count_if(F.col("source") == "src0").alias("have"), F.count_if(F.col("source") != "src0").alias("other"))
    return c.select(S.source_quota(0.15, F.col("other"), F.col("have")).cast("long").alias("quota"), "other", "have")


@query("select lang, count(*) as n, round(pow(1.0/count(*), 0.5)/sum(count(*)*pow(1.0/count(*), 0.5)) over (),9) as row_weight from documents group by lang")
def inverse_frequency(spark, sf):
    n = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    w = F.pow(1.0 / F.col("n"), F.lit(0.5))
    total = n.agg(F.sum(F.col("n") * w).alias("t"))
    return n.crossJoin(F.broadcast(total)).select("lang", "n", F.round(w / F.col("t"), 9).alias("row_weight"))


_MIX = """with n as (select lang as family, source, count(*) as n, sqrt(count(*)) as ws from documents group by all),
    f as (select family, case family when 'en' then 2.0 else 1.0 end as wf from (select distinct family from n)),
    m as (select family, source, n, wf/sum(case when rn=1 then wf end) over () * ws/sum(ws) over (partition by family) as p from (select n.*, wf, row_number() over (partition by family order by source) as rn from n join f using (family)))"""


def source_mix(spark, sf):
    n = table(spark, sf, "documents").groupBy(F.col("lang").alias("family"), "source").agg(F.count("*").alias("n"))
    wf = F.when(F.col("family") == "en", 2.0).otherwise(1.0)
    per = n.groupBy("family").agg(F.sum(F.sqrt("n")).alias("s")).withColumn("wf", wf)
    total = per.agg(F.sum("wf").alias("t"))
    return n.join(per, "family").crossJoin(F.broadcast(total)).select("family", "source", "n", (F.col("wf") / F.col("t") * F.sqrt("n") / F.col("s")).alias("p"))


@query(_MIX + " select family, source, round(p,9) as share from m")
def mix_table(spark, sf):
    return source_mix(spark, sf).select("family", "source", F.round("p", 9).alias("share"))


@query(_MIX + " select doc_id, round(p/n,12) as inclusion from documents d join m on m.family = d.lang and m.source = d.source")
def three_level_sampler(spark, sf):
    """Closed form of the chance of a row in one draw: family, then source by the root of its size, then any row."""
    m = source_mix(spark, sf)
    return table(spark, sf, "documents").select("doc_id", F.col("lang").alias("family"), "source").join(m, ["family", "source"]).select("doc_id", F.round(F.col("p") / F.col("n"), 12).alias("inclusion"))


@query(
    f"""with w as (select doc_id, -ln(1-{uniform_sql('draw', 'doc_id')})*n_chars as k from documents)
    select doc_id, row_number() over (order by k, doc_id)::int as draw from w order by k, doc_id limit 50"""
)
def weighted_draw(spark, sf):
    """Fifty rows without replacement, short ones likelier, by exponential keys."""
    k = -F.log(1 - uniform("draw", F.col("doc_id"))) * F.col("n_chars")
    top = table(spark, sf, "documents").select("doc_id", k.alias("k")).orderBy("k", "doc_id").limit(50)
    return top.select("doc_id", F.row_number().over(Window.orderBy("k", "doc_id")).alias("draw"))


@query(
    f"""with c as (select source, sum(count(*)) over (order by source) as cum, sum(count(*)) over () as tot from documents group by source)
    select d.k::int as draw, (select min(source) from c where cum = (select min(cum) from c where cum >= {uniform_sql('bisect', 'd.k')}*tot)) as source from range(100) d(k)"""
)
def cumulative_draw(spark, sf):
    """Each draw takes the first source whose running weight reaches it; the running table is one small array."""
    n = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    arr = n.agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("a"))
    run = F.aggregate("a", F.array().cast("array<struct<source:string,cum:bigint>>"), lambda acc, x: F.concat(acc, F.array(F.struct(x["source"].alias("source"), (F.coalesce(F.try_element_at(acc, F.lit(-1))["cum"], F.lit(0)) + x["n"]).alias("cum")))))
    arr = arr.select(run.alias("c"))
    draws = spark.range(100).select(F.col("id").cast("int").alias("draw"))
    x = uniform("bisect", F.col("draw")) * F.element_at("c", -1)["cum"]
    return draws.crossJoin(F.broadcast(arr)).select("draw", F.filter("c", lambda e: e["cum"] >= x)[0]["source"].alias("source"))


@query(
    f"""select o_orderkey, case when {uniform_sql('big', 'o_orderkey')} < 0.03 then 255 else round(exp(ln(2)+{uniform_sql('n', 'o_orderkey')}*(ln(128)-ln(2))))::int end as n_options,
      case when {uniform_sql('mod', 'o_orderkey')} < 0.6 then 'both' when {uniform_sql('mod', 'o_orderkey')} < 0.8 then 'text' else 'vector' end as modality from orders"""
)
def option_count_draws(spark, sf):
    import math

    k = F.col("o_orderkey")
    n = F.round(F.exp(F.lit(math.log(2)) + uniform("n", k) * (math.log(128) - math.log(2)))).cast("int")
    m = uniform("mod", k)
    return table(spark, sf, "orders").select("o_orderkey", F.when(uniform("big", k) < 0.03, 255).otherwise(n).alias("n_options"), F.when(m < 0.6, "both").when(m < 0.8, "text").otherwise("vector").alias("modality"))


@query(f"select doc_id, source from documents qualify row_number() over (partition by source order by {digest_sql('take', 'doc_id')}, doc_id) <= 5")
def seeded_take(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    n = d.groupBy("source").agg(F.count("*").alias("n")).withColumn("cap", F.lit(5))
    return S.capped(d, ["source"], n, "take", "doc_id").select("doc_id", "source")


@query(f"select doc_id from (select doc_id from documents order by {digest_sql('scan', 'doc_id')}, doc_id limit 100)")
def random_rows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return d.orderBy(digest("scan", F.col("doc_id")), "doc_id").limit(100)


@query("select epoch, count(*) filter (n_chars <= 500 * (1 + epoch)) as kept from documents, (select unnest(range(4))::int as epoch) group by epoch")
def length_curriculum(spark, sf):
    """Rows under the length cap of each epoch, in one pass."""
    d = table(spark, sf, "documents").select("n_chars")
    wide = d.agg(*(F.count_if(F.col("n_chars") <= 500 * (1 + e)).alias(str(e)) for e in range(4)))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(e).alias("epoch"), F.col(str(e)).alias("kept")) for e in range(4)))).alias("x")).select("x.*")


@query(
    f"""with {DOCS}, s as (select source, rnk, lang, count(*) as n from docs group by all)
    select source, ['test','val','train'][rnk+1] as split, sum(n)::bigint as n, count(*) as n_labels, max(n) as top, round(max(n)/min(n),2) as max_min_ratio from s group by source, rnk"""
)
def manifest(spark, sf):
    n = split_docs(spark, sf).groupBy("source", "rnk", "lang").agg(F.count("*").alias("n"))
    split = F.element_at(F.array(*map(F.lit, ("test", "val", "train"))), F.col("rnk") + 1)
    out = n.groupBy("source", "rnk").agg(F.sum("n").alias("total"), F.count("*").alias("n_labels"), F.max("n").alias("top"), F.round(F.max("n") / F.min("n"), 2).alias("max_min_ratio"))
    return out.select("source", split.alias("split"), F.col("total").alias("n"), "n_labels", "top", "max_min_ratio")
