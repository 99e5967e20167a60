"""Adapters of multiple-choice sources, tasks and option sets with foreign labels, schedules and intervals over the tables."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring as P
from ..functions.hashing import digest, digest_sql, uniform, uniform_sql
from ..operators import calibration as C
from ..operators import draws as W
from ..operators import splits as S
from ..sources import adapters as A
from .decisions import DEPTHS, PASSES, REC, records
from .registry import query, table

_TEXTS = "[p_name, p_brand, p_type, p_type || ' ' || p_name]"


@query(
    f"""with p as (select p_partkey as key, p_name, p_brand, p_type, p_size, {_TEXTS} as four from part),
    r as (select 'race' as source, key, p_type as context, p_name as question, four[1:3 + p_size % 2] as options, list_position(['A','B','C','D'], ['A','B','C','D','E'][p_size % 5 + 1]) - 1 as a from p where p_size % 2 = 1),
    c as (select 'csqa', key, '', p_name, four[1:p_size % 4 + 1], nullif(list_position(['k1','k2','k3','k4'][1:p_size % 4 + 1], 'k' || (key % 5)), 0) - 1 from p),
    o as (select 'arc', key, '', p_name, four[1:p_size % 4 + 1], nullif(list_position(['k1','k2','k3','k4'][1:p_size % 4 + 1], 'k' || (key % 5)), 0) - 1 from p where p_size % 4 + 1 >= 2),
    q as (select key, p_name, p_size, four, list_sort(list_transform([0,1,2,3], lambda i: {digest_sql('sciq', 'key', 'i')} || i)) as h from p),
    s as (select 'sciq', key, case when p_size % 3 = 0 then '' else p_name end, p_name, list_transform(h, lambda x: four[right(x, 1)::int + 1]), list_position(list_transform(h, lambda x: right(x, 1)), '0') - 1 from q),
    e as (select 'hellaswag', key, '', p_name, four, try_cast(case when p_size % 7 = 0 then 'x' else (p_size % 6)::varchar end as int) from p),
    u as (select * from r union all select * from c union all select * from o union all select * from s union all select * from e)
    select source, key, context, question, array_to_string(options, '|') as options, a::int as answer_idx from u where a between 0 and len(options) - 1"""
)
def mcq_adapters(spark, sf):
    """Five sources, each from rows as it would publish them: odd numbers of options, unknown keys and labels that are no numbers included."""
    p, size = table(spark, sf, "part").withColumn("_key", F.col("p_partkey")), F.col("p_size")
    four = F.array("p_name", "p_brand", "p_type", F.concat_ws(" ", "p_type", "p_name"))
    question = F.col("p_name").alias("question")
    race = p.select("_key", F.col("p_type").alias("article"), question, F.slice(four, F.lit(1), 3 + size % 2).alias("options"), F.element_at(F.array(*map(F.lit, "ABCDE")), size % 5 + 1).alias("answer"))
    keys = F.array(*map(F.lit, ("k1", "k2", "k3", "k4")))
    choices = F.struct(F.slice(keys, F.lit(1), size % 4 + 1).alias("label"), F.slice(four, F.lit(1), size % 4 + 1).alias("text")).alias("choices")
    asked = p.select("_key", question, choices, F.concat(F.lit("k"), (F.col("p_partkey") % 5).cast("string")).alias("answerKey"))
    sciq = p.select("_key", question, F.when(size % 3 != 0, F.col("p_name")).alias("support"), *(four[i].alias(n) for i, n in enumerate(("correct_answer", "distractor1", "distractor2", "distractor3"))))
    swag = p.select("_key", F.col("p_name").alias("ctx"), four.alias("endings"), F.when(size % 7 == 0, "x").otherwise((size % 6).cast("string")).alias("label"))
    out = A.reading(race).unionByName(A.keyed(asked, "csqa")).unionByName(A.keyed(asked, "arc", least=2)).unionByName(A.supported(sciq)).unionByName(A.endings(swag))
    return out.withColumn("options", F.array_join("options", "|"))


@query(
    f"""with items as (select 'intent' as task, p_partkey as item, 1::bigint as w from part union all select 'mcq', doc_id, 1 from documents union all select 'bool', o_orderkey, 1 from orders),
    k as (select k as draw, case when {uniform_sql('task', 'k')} < 0.5 then 'intent' when {uniform_sql('task', 'k')} < 0.8 then 'mcq' else 'bool' end as task from range(500) r(k)),
    {W.weighted_sql('t', 'items', 'item', 'w', 'k', ['task'], uniform_sql('item', 'd.draw'), digest_sql('items', 'item'))}
    select draw, task, item from t"""
)
def task_mixer(spark, sf):
    """A task by weight, then any item of the table that stands for it."""
    tables = (("intent", "part", "p_partkey"), ("mcq", "documents", "doc_id"), ("bool", "orders", "o_orderkey"))
    items = None
    for task, t, key in tables:
        one = table(spark, sf, t).select(F.lit(task).alias("task"), F.col(key).alias("item"))
        items = one if items is None else items.unionByName(one)
    k = F.col("draw")
    u = uniform("task", k)
    draws = spark.range(500).select(F.col("id").alias("draw")).withColumn("task", F.when(u < 0.5, "intent").when(u < 0.8, "mcq").otherwise("bool"))
    return W.weighted_draws(items, "item", F.lit(1), draws, "draw", ["task"], uniform("item", k), "items").select("draw", "task", "item")


@query("with s as (select distinct p_brand as source, p_name as label from part) select a.source, b.source as of, b.label from (select distinct source from s) a join s b on a.source <> b.source")
def foreign_labels(spark, sf):
    """The pool of each source: every label of every other source; sources are a catalogue, which each label meets once."""
    s = table(spark, sf, "part").select(F.col("p_brand").alias("of"), F.col("p_name").alias("label")).where("of is not null").distinct()
    sources = s.select(F.col("of").alias("source")).distinct().agg(F.collect_list("source").alias("all"))
    return s.crossJoin(F.broadcast(sources)).select(F.explode(F.array_except("all", F.array("of"))).alias("source"), "of", "label")


_MOST = 64


@query(
    f"""with x as (select c_custkey, n_name as label, r_name as source from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey),
    l as (select source, list(distinct label order by label) as native from x group by source),
    g as (select x.*, native, (select list(o.label order by o.label) from (select unnest(b.native) as label from l b where b.source <> x.source) o) as pool, {uniform_sql('sub', 'c_custkey')} as us, {uniform_sql('pad', 'c_custkey')} as up,
      2 + floor({uniform_sql('k', 'c_custkey')}*(len(native)-1))::int as k, round(exp(ln(2)+{uniform_sql('n', 'c_custkey')}*(ln({_MOST})-ln(2))))::int as nt from x join l using (source)),
    o as (select *, case when len(native) > 2 and us < 0.5 then [label] || list_transform(list_sort(list_transform(list_filter(native, lambda t: t <> label), lambda t: {digest_sql('some', 'c_custkey', 't')} || t))[1:k-1], lambda h: h[33:]) else native end as own from g),
    f as (select *, list_transform(list_sort(list_transform(list_filter(pool, lambda t: not list_contains(own, t)), lambda t: {digest_sql('far', 'c_custkey', 't')} || t))[1:nt-len(own)], lambda h: h[33:]) as far from o),
    b as (select c_custkey, 'train' as mode, label, own || case when nt > len(own) and up < 0.3 then far else [] end as opts, len(own) as n_own from f union all select c_custkey, 'full', label, native, len(native) from g),
    z as (select *, list_transform(list_sort(list_transform(opts, lambda t: {digest_sql('deal', 'c_custkey', 'mode', 't')} || t)), lambda h: h[33:]) as dealt from b)
    select c_custkey, mode, array_to_string(dealt, '|') as options, (list_position(dealt, label) - 1)::int as answer_idx, len(dealt)::int as n, (len(opts) - n_own)::int as n_foreign from z"""
)
def build_diversity(spark, sf):
    """The native vocabulary of a row's source or a random part of it, in 30 % of the cases filled up with labels of other sources; and all of it in full mode.

    Vocabularies are catalogues: those of a source, and of all others, are one array each.
    """
    region = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("source"))
    nation = table(spark, sf, "nation").join(F.broadcast(region), "n_regionkey").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("label"), "source")
    x = table(spark, sf, "customer").join(F.broadcast(nation), "c_nationkey").select("c_custkey", "label", "source")
    native = x.select("source", "label").distinct().groupBy("source").agg(F.array_sort(F.collect_list("label")).alias("native"))
    every = native.agg(F.collect_list(F.struct("source", "native")).alias("every"))
    pool = F.flatten(F.transform(F.filter("every", lambda e: e["source"] != F.col("source")), lambda e: e["native"]))
    x = x.join(F.broadcast(native.crossJoin(F.broadcast(every)).select("source", "native", pool.alias("pool"))), "source")
    key, n = F.col("c_custkey"), F.size("native")
    hashed = lambda seed, xs, *more: F.transform(F.array_sort(F.transform(xs, lambda t: F.struct(digest(seed, key, *more, t).alias("h"), t.alias("t")))), lambda s: s["t"])
    k = 2 + F.floor(uniform("k", key) * (n - 1)).cast("int")
    some = F.concat(F.array("label"), F.slice(hashed("some", F.filter("native", lambda t: t != F.col("label"))), F.lit(1), k - 1))
    x = x.withColumn("own", F.when((n > 2) & (uniform("sub", key) < 0.5), some).otherwise(F.col("native")))
    wanted = F.round(F.exp(F.lit(math.log(2)) + uniform("n", key) * (math.log(_MOST) - math.log(2)))).cast("int")
    room = F.greatest(wanted - F.size("own"), F.lit(0))
    far = F.slice(hashed("far", F.filter("pool", lambda t: ~F.array_contains("own", t))), F.lit(1), room)
    train = x.select("c_custkey", F.lit("train").alias("mode"), "label", F.when(uniform("pad", key) < 0.3, F.concat("own", far)).otherwise(F.col("own")).alias("opts"), F.size("own").alias("n_own"))
    full = x.select("c_custkey", F.lit("full").alias("mode"), "label", F.col("native").alias("opts"), n.alias("n_own"))
    z = train.unionByName(full).withColumn("dealt", hashed("deal", F.col("opts"), F.col("mode")))
    return z.select("c_custkey", "mode", F.array_join("dealt", "|").alias("options"), (F.array_position("dealt", F.col("label")) - 1).cast("int").alias("answer_idx"), F.size("dealt").alias("n"), (F.size("opts") - F.col("n_own")).alias("n_foreign"))


@query(
    f"""with p as (select item_id, text, lead(text) over (order by item_id) as later, {uniform_sql('pair', 'item_id')} < 0.5 as same from benchmark)
    select item_id, 'Do these two texts mean the same? First: ' || text || ' Second: ' || case when same then lower(text) else later end as question, 'no|yes' as options, same::int as answer_idx from p where same or later is not null"""
)
def paraphrase_pairs(spark, sf):
    """A yes/no request for each pair: a text with itself in other letters, or with the one after it."""
    b = table(spark, sf, "benchmark").select("item_id", "text")
    after = S.in_order(b, ["item_id"])
    later = after.select((F.col("_place") - 1).alias("_place"), F.col("text").alias("later"))
    same = uniform("pair", F.col("item_id")) < 0.5
    p = after.join(later, "_place", "left").withColumn("same", same).where(F.col("same") | F.col("later").isNotNull())
    question = F.concat(F.lit("Do these two texts mean the same? First: "), F.col("text"), F.lit(" Second: "), F.when(F.col("same"), F.lower("text")).otherwise(F.col("later")))
    return p.select("item_id", question.alias("question"), F.lit("no|yes").alias("options"), F.col("same").cast("int").alias("answer_idx"))


@query(
    f"""with {REC}, {PASSES}, a as (select vec_id, y, p from pk where k = 3), b as (select vec_id, p from pk where k = {DEPTHS}),
    m as (select vec_id, y, list_transform(list_zip(a.p, b.p), lambda s: 0.3*s[1] + 0.7*s[2]) as w from a join b using (vec_id))
    select vec_id, i::int as i, round(w[i+1], 6) as weight, (list_position(w, list_max(w)) - 1 = y) as right from m, range(10) t(i)"""
)
def blended_runs(spark, sf):
    """Two runs of the records, after three passes and after all, blended key by key, and whether the blend is right."""
    x = C.depth_records(records(spark, sf), DEPTHS)
    a, b = (x.where(F.col("k") == k).select("vec_id", "y", F.col("p").alias(n)) for k, n in ((3, "a"), (DEPTHS, "b")))
    m = a.join(b.drop("y"), "vec_id").withColumn("w", F.zip_with("a", "b", lambda s, t: 0.3 * s + 0.7 * t))
    return m.select("vec_id", F.posexplode("w").alias("i", "weight"), (P.argmax(F.col("w")) == F.col("y")).alias("right")).withColumn("weight", F.round("weight", 6))


@query(
    """with n as (select count(*) as n from events), s as (select event_id, event_id - min(event_id) over () as step from events)
    select event_id, round(case when step < 100 then (step+1)/100.0 else 0.1+0.9*0.5*(1+cos(pi()*least((step-100)/greatest(n-100, 1)::double, 1))) end,9) as lr from s, n"""
)
def learning_rates(spark, sf):
    """The rate at each logged step: a warm-up, then a cosine down to a tenth over as many steps as there are events."""
    e = table(spark, sf, "events")
    n = e.agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    s = F.col("event_id") - F.col("first")
    done = F.least((s - 100) / F.greatest(F.col("n") - 100, F.lit(1)), F.lit(1.0))
    lr = F.when(s < 100, (s + 1) / 100.0).otherwise(0.1 + 0.9 * 0.5 * (1 + F.cos(F.lit(math.pi) * done)))
    return e.select("event_id").crossJoin(F.broadcast(n)).select("event_id", F.round(lr, 9).alias("lr"))


@query(
    f"""with {REC}, {PASSES}, l as (select vec_id, k, -ln(p[y+1]) as nll from pk)
    select vec_id, round(sum(nll*k)/{DEPTHS * (DEPTHS + 1) // 2}, 6) as ascending, round(avg(nll), 6) as uniform from l group by vec_id"""
)
def depth_weighted_loss(spark, sf):
    """The loss of a record over its passes, with weights that rise with the pass and with equal ones."""
    x = C.depth_records(records(spark, sf), DEPTHS).withColumn("nll", -F.log(P.at(F.col("p"), F.col("y"))))
    return x.groupBy("vec_id").agg(F.round(F.sum(F.col("nll") * F.col("k")) / (DEPTHS * (DEPTHS + 1) // 2), 6).alias("ascending"), F.round(F.avg("nll"), 6).alias("uniform"))


@query(
    """with e as (select ts, event_id, value, (event_id % 500 = 0)::int as logged from events),
    i as (select *, sum(logged) over (order by ts, event_id) - logged as interval_ from e)
    select interval_::bigint as "interval", count(*) as n, round(avg(value), 6) as mean, round(min(value), 6) as low from i group by 1"""
)
def drained_intervals(spark, sf):
    """What a sampler holds whenever a line is logged: mean and least value since the line before; lines are counted over ranges of the time."""
    e = table(spark, sf, "events").select("ts", "event_id", "value", (F.col("event_id") % 500 == 0).cast("int").alias("logged"))
    x = S.in_order(e, ["ts", "event_id"], {"interval": "logged"})
    return x.groupBy("interval").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.min("value"), 6).alias("low"))


def _answers(order):
    """The option that a reader with a small liking for early places picks from z in an order of places (option, place)."""
    best = F.array_max(F.transform(order, lambda o: F.struct((F.element_at("z", o["i"] + 1) - 0.05 * o["at"]).alias("z"), (-o["at"]).alias("at"), o["i"].alias("i"))))
    return best["i"]


@query(
    f"""with {REC}, o as (select vec_id, i::int as i, z[i+1] as z, row_number() over (partition by vec_id order by {digest_sql('flip', 'vec_id', 'i')}) - 1 as seat from rec, range(10) t(i) where family <> 'mcq'),
    base as (select vec_id, arg_max(i, z - 0.05*i) as a from o group by vec_id), again as (select vec_id, arg_max(i, z - 0.05*seat) as b from o group by vec_id)
    select count(*) as n, round(avg((a <> b)::int), 6) as flip_rate from base join again using (vec_id)"""
)
def shuffled_flip_rate(spark, sf):
    """Share of rows whose picked option changes between a run and a second one with the options in hashed order; ordinal rows are left out."""
    rows = records(spark, sf).where("family <> 'mcq'").select("vec_id", "z")
    places = F.sequence(F.lit(0), F.size("z") - 1)
    plain = F.transform(places, lambda i: F.struct(i.alias("i"), i.alias("at")))
    dealt = F.array_sort(F.transform(places, lambda i: F.struct(digest("flip", F.col("vec_id"), i).alias("h"), i.alias("i"))))
    shuffled = F.transform(dealt, lambda s, at: F.struct(s["i"].alias("i"), at.alias("at")))
    base, again = rows.select("vec_id", _answers(plain).alias("a")), rows.select("vec_id", _answers(shuffled).alias("b"))
    x = base.join(again, "vec_id")
    return x.agg(F.count("*").alias("n"), F.round(F.avg((F.col("a") != F.col("b")).cast("int")), 6).alias("flip_rate"))


_PARTS = """ev as (select label, vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), pm as (select label, i, avg(v[i]) as a from ev, range(1,65) r(i) group by label, i),
    pr as (select label, list(a order by i) as v from pm group by label),
    ct as (select vec_id, m, v[16*m+1:16*m+16] as t from ev, range(4) r(m)), ot as (select label, m, v[16*m+1:16*m+16] as t from pr, range(4) r(m)),
    cn as (select vec_id, m, list_transform(t, lambda x: x/sqrt(list_dot_product(t,t))) as t from ct), tn as (select label, m, list_transform(t, lambda x: x/sqrt(list_dot_product(t,t))) as t from ot)"""


def _label_means(e):
    """One row with `bank`: label and mean vector; labels are a catalogue."""
    d = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("a"))
    return d.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda s: s["a"]).alias("p")).agg(F.collect_list(F.struct("label", "p")).alias("bank"))


def _parts(v, normalised: bool = True):
    """Four tokens of a vector, of unit length."""
    cut = P.let(v, lambda xs: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda m: F.slice(xs, 16 * m + 1, F.lit(16))))
    return F.transform(cut, P.unit) if normalised else cut


@query(
    f"""with {_PARTS}, s as (select vec_id, label, c.m, max(list_dot_product(c.t, o.t)) as s from cn c, tn o group by all)
    select vec_id, label, round(avg(s), 6) as score from s group by vec_id, label"""
)
def token_max_sim(spark, sf):
    """Late interaction of tokens: for each token of a vector the best cosine with the label's tokens, in the mean."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", P.doubles(F.col("embedding")).alias("v"))
    bank = _label_means(e).select(F.transform("bank", lambda b: F.struct(b["label"].alias("label"), _parts(b["p"]).alias("t"))).alias("bank"))
    x = e.select("vec_id", _parts(F.col("v")).alias("c")).crossJoin(F.broadcast(bank)).select("vec_id", "c", F.explode("bank").alias("b"))
    best = F.transform("c", lambda t: F.array_max(F.transform("b.t", lambda o: P.dot(t, o))))
    return x.select("vec_id", F.col("b.label").alias("label"), F.round(P.total(best) / 4, 6).alias("score"))


@query(
    f"""with {_PARTS}, po as (select label, j, avg(t[j]) as a from ot, range(1,17) r(j) group by label, j), oo as (select label, list(a order by j) as o from po group by label), o as (select label, list_transform(o, lambda x: x/sqrt(list_dot_product(o,o))) as o from oo),
    s as (select vec_id, label, m, t, o, exp(list_dot_product(t, o)/4.0) as e from cn, o),
    w as (select vec_id, label, m, any_value(o) as o, any_value(t) as t, any_value(e) as e, sum(any_value(e)) over (partition by vec_id, label) as total from s group by vec_id, label, m),
    f as (select vec_id, label, j, sum(e/total*t[j]) as x, any_value(o[j]) as o from w, range(1,17) r(j) group by all)
    select vec_id, label, round(sum(x*o)/sqrt(sum(x*x))/0.07, 6) as score from f group by vec_id, label"""
)
def poly_scores(spark, sf):
    """Poly-encoder scores: a label attends to the four codes of a vector, which are blended by its weights, brought to unit length, and compared with it at a temperature."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", P.doubles(F.col("embedding")).alias("v"))
    places = F.sequence(F.lit(1), F.lit(16))
    mean = lambda ps: P.let(ps, lambda ts: F.transform(places, lambda j: P.total(F.transform(ts, lambda t: F.element_at(t, j))) / 4))
    bank = _label_means(e).select(F.transform("bank", lambda b: F.struct(b["label"].alias("label"), P.unit(mean(_parts(b["p"], False))).alias("o"))).alias("bank"))
    x = e.select("vec_id", _parts(F.col("v")).alias("c")).crossJoin(F.broadcast(bank)).select("vec_id", "c", F.explode("bank").alias("b")).select("vec_id", "c", "b.label", "b.o")
    weights = P.softmax(F.transform("c", lambda t: P.dot(t, F.col("o")) / 4.0))
    blend = P.let(weights, lambda ws: F.transform(places, lambda j: P.total(F.zip_with(ws, "c", lambda w, t: w * F.element_at(t, j)))))
    return x.select("vec_id", "label", F.round(P.cosine(blend, F.col("o")) / 0.07, 6).alias("score"))
