"""Scoring of embeddings against label prototypes, and the evaluation of the records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring as P
from ..functions.hashing import gamma_sql, normal_sql, uniform, uniform_sql
from ..operators import calibration as C
from .registry import query, table

TAU = 0.1
LABELS = 10


def prototypes(spark: SparkSession, sf: str) -> DataFrame:
    """(label, proto): mean vector of the training rows of each label."""
    e = table(spark, sf, "embeddings").where(uniform("train", F.col("vec_id")) < 0.8)
    d = e.select("label", F.posexplode(P.doubles(F.col("embedding"))).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("a"))
    return d.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda s: s["a"]).alias("proto"))


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Prediction records of the rows left out: the label bank is one broadcast row, so no row is multiplied."""
    bank = prototypes(spark, sf).agg(F.array_sort(F.collect_list(F.struct("label", "proto", P.norm(F.col("proto")).alias("size")))).alias("bank"))
    e = table(spark, sf, "embeddings").where(uniform("train", F.col("vec_id")) >= 0.8).select("vec_id", F.col("label").alias("y"), P.doubles(F.col("embedding")).alias("v"))
    near = lambda v, size: F.transform("bank", lambda b: P.dot(v, b["proto"]) / (size * b["size"]) / TAU)
    z = P.let(F.col("v"), lambda v: P.let(P.norm(v), lambda size: near(v, size)))
    rows = e.crossJoin(F.broadcast(bank)).withColumn("z", z).drop("bank", "v")
    rows = rows.withColumn("p", P.softmax(F.col("z")))
    i = F.col("vec_id")
    return C.scored(rows).withColumns({"family": F.when(i % 2 == 0, "intent").otherwise("mcq"), "grp": F.concat(F.lit("g"), (i % 5).cast("string")), "blind_easy": i % 3 == 0})


REC = f"""ev as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v, {uniform_sql('train', 'vec_id')} < 0.8 as train from embeddings),
    pd as (select label, i, avg(v[i]) as a from ev, range(1,65) r(i) where train group by label, i),
    pr as (select label, list(a order by i) as proto from pd group by label),
    lg as (select e.vec_id, e.label as y, list(list_dot_product(e.v,pr.proto)/(sqrt(list_dot_product(e.v,e.v))*sqrt(list_dot_product(pr.proto,pr.proto)))/{TAU} order by pr.label) as z from ev e, pr where not train group by e.vec_id, e.label),
    sx as (select *, list_transform(z, lambda x: exp(x - list_max(z))) as ex from lg),
    sp as (select vec_id, y, z, list_transform(ex, lambda x: x/list_sum(ex)) as p from sx),
    sq as (select *, (list_position(p, list_max(p))-1)::int as pred, list_max(p) as conf, p[y+1] as p_true from sp),
    rec as (select *, (pred=y)::int as correct, -ln(p_true) as nll, list_sum(list_transform(p, lambda x, i: pow(x-(i-1=y)::int,2))) as brier,
      p_true/greatest(sqrt(list_dot_product(p,p)),1e-8) as sph, list_sum(list_transform(range(1,len(p)+1), lambda j: pow(list_sum(p[1:j]) - (j-1>=y)::int,2))) as rps,
      list_sum(list_transform(p, lambda x, i: x*(i-1))) as level, len(p) as n_options,
      case when vec_id%2=0 then 'intent' else 'mcq' end as family, 'g'||(vec_id%5) as grp, vec_id%3=0 as blind_easy from sq)"""
SUMMARY = """count(*) as n, round(avg(correct),6) as acc, round(avg(nll),6) as nll, round(avg(brier),6) as brier, round(avg(conf),6) as mean_conf, round(avg(1.0/n_options),6) as chance,
    round(avg(rps),6) as rps, round(avg((abs(pred-y)<=1)::int),6) as within1, round(avg(abs(level-y)),6) as level_mae"""


@query(f"with {REC} select vec_id, round(z[1],6) as z0, round(z[{LABELS}],6) as z9 from rec")
def cosine_scores(spark, sf):
    return records(spark, sf).select("vec_id", F.round(F.col("z")[0], 6).alias("z0"), F.round(F.element_at("z", LABELS), 6).alias("z9"))


@query(f"with {REC} select vec_id, y, pred, round(conf,6) as conf, round(p_true,6) as p_true, correct, round(nll,6) as nll, round(brier,6) as brier, round(ln(p_true)+0.5*sph-case when vec_id%2=0 then rps else 0 end,6) as reward, round(level,6) as level from rec")
def prediction_records(spark, sf):
    r = lambda c: F.round(c, 6).alias(c)
    reward = F.log("p_true") + 0.5 * F.col("sph") - F.when(F.col("vec_id") % 2 == 0, F.col("rps")).otherwise(0.0)
    return records(spark, sf).select("vec_id", "y", "pred", r("conf"), r("p_true"), "correct", r("nll"), r("brier"), F.round(reward, 6).alias("reward"), r("level"))


@query(f"with {REC} select grp, {SUMMARY} from rec group by grp")
def summary_by_group(spark, sf):
    return records(spark, sf).groupBy("grp").agg(*C.summary_columns())


@query(f"with {REC} select family, grp, grouping_id(family, grp)::bigint as grain, {SUMMARY} from rec group by grouping sets ((family), (grp), (family, grp), ())")
def multi_grain_summary(spark, sf):
    f, g = F.col("family"), F.col("grp")
    out = records(spark, sf).groupingSets([[f], [g], [f, g], []], f, g).agg(F.grouping_id().cast("long").alias("grain"), *C.summary_columns())
    return out


@query(f"with {REC}, a as (select grp, avg(correct) as acc, avg(correct) filter (not blind_easy) as hard from rec group by grp) select round(avg(acc),6) as macro, round(avg(coalesce(hard,acc)),6) as macro_hard from a")
def macro_average(spark, sf):
    a = records(spark, sf).groupBy("grp").agg(F.avg("correct").alias("acc"), F.avg(F.when(~F.col("blind_easy"), F.col("correct"))).alias("hard"))
    return a.agg(F.round(F.avg("acc"), 6).alias("macro"), F.round(F.avg(F.coalesce("hard", "acc")), 6).alias("macro_hard"))


@query(
    f"""with {REC}, b as (select family, least(floor(conf*15),14) as bin, avg(conf) as c, avg(correct) as a, count(*) as m from rec group by all)
    select family, round(sum(abs(c-a)*m)/sum(m),6) as ece from b group by family"""
)
def ece_15(spark, sf):
    return C.ece(records(spark, sf), ["family"]).select("family", F.round("ece", 6).alias("ece"))


@query(f"with {REC} select least(floor(conf*15),14)::int as bin, count(*) as n, round(avg(conf),6) as mean_conf, round(avg(correct),6) as acc from rec group by 1")
def reliability_bins(spark, sf):
    b = F.least(F.floor(F.col("conf") * 15), F.lit(14)).cast("int")
    return records(spark, sf).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("conf"), 6).alias("mean_conf"), F.round(F.avg("correct"), 6).alias("acc"))


@query(
    f"""with {REC}, b as (select case when conf >= 1 then 9 else floor(conf/0.1) end as bin, avg(conf) as c, avg(correct) as a, count(*) as m from rec group by 1)
    select round(sum(abs(c-a)*m)/sum(m),6) as ece from b"""
)
def ece_10(spark, sf):
    rows = records(spark, sf)
    b = F.when(F.col("conf") >= 1, 9).otherwise(F.floor(F.col("conf") / 0.1))
    per = rows.groupBy(b.alias("bin")).agg(F.avg("conf").alias("c"), F.avg("correct").alias("a"), F.count("*").alias("m"))
    return per.agg(F.round(F.sum(F.abs(F.col("c") - F.col("a")) * F.col("m")) / F.sum("m"), 6).alias("ece"))


COSTS = [(1.0, 0.1), (3.0, 0.25), (10.0, 0.5)]
TAUS = [round(i * 0.02, 2) for i in range(51)]
_GRID = f"(select unnest({TAUS}) as threshold) t, (values {', '.join(f'({w}::double,{e}::double)' for w, e in COSTS)}) c(wrong, escalate)"
_CURVE = f"select threshold, wrong, escalate, avg(case when conf < threshold then -escalate when correct = 1 then 1.0 else -wrong end) as u from rec, {_GRID} group by all"


@query(f"with {REC}, q as ({_CURVE}) select threshold::double as threshold, wrong, escalate, round(u,6) as utility from q")
def utility_curve(spark, sf):
    return C.utility(records(spark, sf), TAUS, COSTS).withColumn("utility", F.round("utility", 6))


@query(f"with {REC}, q as ({_CURVE}), m as (select wrong, escalate, max({{'u': round(u,9), 't': threshold::double}}) as m from q group by all) select wrong, escalate, m.t as threshold, round(m.u,6) as utility from m")
def utility_best(spark, sf):
    return C.best_utility(C.utility(records(spark, sf), TAUS, COSTS))


GRID = [round(0.05 * 1.15**i, 4) for i in range(40)]
GRID_EXP = [round(2.718281828459045 ** (-3 + 0.1 * i), 6) for i in range(61)]


def _temperature_sql(grid: list[float], by: str) -> str:
    return f"""with {REC}, x as (select {by}, t::double as t, list_transform(z, lambda v: v/t::double) as s, y from rec, (select unnest({grid}) as t)),
    n as (select {by}, t, round(avg(list_max(s)+ln(list_sum(list_transform(s, lambda v: exp(v-list_max(s)))))-s[y+1]),9) as nll, count(*) as n from x group by all having count(*) >= 30),
    m as (select {by}, min({{'nll': nll, 't': t}}) as m from n group by {by}) select {by}, m.t as temperature, round(m.nll,6) as nll from m"""


@query(_temperature_sql(GRID, "family"))
def temperature_fit(spark, sf):
    return C.best_temperature(records(spark, sf), ["family"], GRID)


@query(_temperature_sql(GRID_EXP, "family"))
def temperature_fit_exp(spark, sf):
    return C.best_temperature(records(spark, sf), ["family"], GRID_EXP)


@query(f"with {REC}, o as (select vec_id, pred, (list_position(p[6:10]||p[1:5], list_max(list_transform(p[6:10]||p[1:5], lambda x: round(x,2))))-1) as q, list_transform(p, lambda x: round(x,2)) as r from rec), s as (select vec_id, pred, (list_position(r,list_max(r))-1)::int as a, (list_position(r[6:10]||r[1:5],list_max(r))-1)::int as b from o) select count(*) as n, round(avg((a <> (b+5)%10)::int),6) as flip_rate from s")
def order_flip_rate(spark, sf):
    """Answers on coarse probabilities, before and after the options are rotated; compared by the option, not its place."""
    r = F.transform("p", lambda x: F.round(x, 2))
    turned = F.concat(F.slice(r, 6, 5), F.slice(r, 1, 5))
    x = records(spark, sf).select(P.argmax(r).alias("a"), P.argmax(turned).alias("b"))
    return x.agg(F.count("*").alias("n"), F.round(F.avg((F.col("a") != (F.col("b") + 5) % 10).cast("int")), 6).alias("flip_rate"))


B = 2000


@query(
    f"""with {REC}, d as (select b, correct, {uniform_sql('boot', 'b', 'vec_id')} as u from rec, range({B}) x(b)),
    w as (select b, correct, {' + '.join(f'(u >= {t!r})::int' for t in C.POISSON)} as w from d),
    m as (select b, sum(w*correct)/sum(w) as a from w group by b having sum(w) > 0)
    select round(quantile_cont(a,0.025),6) as lo, round(quantile_cont(a,0.975),6) as hi from m"""
)
def bootstrap_interval(spark, sf):
    """Percentiles of 2000 Poisson resamples: how often a row is in a resample is hashed for each row and resample."""
    means = C.resampled_means(records(spark, sf), "vec_id", "correct", "boot", B)
    return means.agg(F.round(F.percentile("mean", 0.025), 6).alias("lo"), F.round(F.percentile("mean", 0.975), 6).alias("hi"))


DRAWN, KAPPA = 8, 50.0


@query(
    f"""with {REC}, x as (select vec_id, y, g, i - 1 as i, greatest({KAPPA}*greatest(p[i],1e-6),1e-3) as a from rec, range({DRAWN}) t(g), range(1, {LABELS} + 1) s(i)),
    d as (select *, case when a < 1 then a + 1 else a end - 1.0::double/3 as d from x),
    v as (select vec_id, y, g, i, greatest({gamma_sql('dir', 'd', 'vec_id', 'g', 'i')}*case when a < 1 then pow(1-{uniform_sql('dir', 'vec_id', 'g', 'i', "'b'")}, 1/a) else 1.0 end, 1e-300) as v from d),
    n as (select *, greatest(v/sum(v) over (partition by vec_id, g), 1e-8) as n from v),
    q as (select *, n/sum(n) over (partition by vec_id, g) as q from n),
    r as (select vec_id, g, max(ln(q)) filter (i = y) + 0.5*max(q) filter (i = y)/greatest(sqrt(sum(q*q)),1e-8) as reward from q group by vec_id, g)
    select vec_id, g::int as g, round(reward,6) as reward, round((reward-avg(reward) over w)/greatest(stddev_samp(reward) over w,1e-6),6) as advantage from r window w as (partition by vec_id)"""
)
def dirichlet_advantages(spark, sf):
    """Eight reports around each record's probabilities, their rewards, and these against the mean of the record's reports."""
    x = C.dirichlet_rewards(records(spark, sf), "vec_id", DRAWN, KAPPA, "dir")
    return x.select("vec_id", "g", F.round("reward", 6).alias("reward"), F.round("advantage", 6).alias("advantage"))


@query(f"with {REC} select pred, count(*) as n, round(count(*)/sum(count(*)) over (),6) as share, count(*)/sum(count(*)) over () > 0.85 as collapsed from rec group by pred")
def prediction_histogram(spark, sf):
    n = records(spark, sf).groupBy("pred").agg(F.count("*").alias("n"))
    t = n.agg(F.sum("n").alias("t"))
    share = F.col("n") / F.col("t")
    return n.crossJoin(F.broadcast(t)).select("pred", "n", F.round(share, 6).alias("share"), (share > 0.85).alias("collapsed"))


@query(f"with {REC}, d as (select *, 100*(vec_id%40) as len from rec) select round(avg(correct) filter (len < 2048),6) as short, round(avg(correct) filter (len >= 2048),6) as long from d")
def length_band_accuracy(spark, sf):
    n = 100 * (F.col("vec_id") % 40)
    return records(spark, sf).agg(F.round(F.avg(F.when(n < 2048, F.col("correct"))), 6).alias("short"), F.round(F.avg(F.when(n >= 2048, F.col("correct"))), 6).alias("long"))


DEPTHS = 6
PASSES = f"""pz as (select vec_id, y, k, list_transform(z, lambda v: v*k/{DEPTHS}) as z from rec, range(1,{DEPTHS}+1) r(k)),
    px as (select *, list_transform(z, lambda x: exp(x-list_max(z))) as ex from pz), pk as (select vec_id, y, k::int as k, list_transform(ex, lambda x: x/list_sum(ex)) as p from px)"""
_H = "lambda x, q: greatest(x,1e-12)*ln(greatest(x,1e-12))"


@query(
    f"""with {REC}, {PASSES}, l as (select *, lag(p) over (partition by vec_id order by k) as b from pk)
    select vec_id, k, round(list_max(p),6) as top1, round(list_reverse_sort(p)[1]-list_reverse_sort(p)[2],6) as margin,
      round(-list_sum(list_transform(p, lambda x: greatest(x,1e-12)*ln(greatest(x,1e-12)))),6) as entropy,
      round(case when b is null then 0 else list_sum(list_transform(p, lambda x, i: greatest(x,1e-12)*(ln(greatest(x,1e-12))-ln(greatest(b[i],1e-12))))) end,6) as kl from l"""
)
def depth_features(spark, sf):
    r = lambda c: F.round(c, 6).alias(c)
    return C.depth_features(C.depth_records(records(spark, sf), DEPTHS)).select("vec_id", "k", r("top1"), r("margin"), r("entropy"), r("kl"))


@query(
    f"""with {REC}, {PASSES}, a as materialized (select vec_id, y, k, list_position(p,list_max(p))-1 as pred from pk)
    select vec_id, k, pred = last_value(pred) over (partition by vec_id order by k rows between unbounded preceding and unbounded following) as halt, pred <> y as escalate from a"""
)
def halt_targets(spark, sf):
    x = C.depth_records(records(spark, sf), DEPTHS).withColumn("pred", P.argmax(F.col("p")))
    last = F.max(F.when(F.col("k") == DEPTHS, F.col("pred"))).over(Window.partitionBy("vec_id"))
    return x.select("vec_id", "k", (F.col("pred") == last).alias("halt"), (F.col("pred") != F.col("y")).alias("escalate"))


THETAS = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]  # fixed values: the thresholds of the curve


@query(
    f"""with {REC}, {PASSES}, g as (select vec_id, y, k, list_max(p) as c, (list_position(p,list_max(p))-1) as pred from pk),
    s as (select vec_id, t::double as theta, coalesce(min(k) filter (c >= t::double), {DEPTHS}) as stop from g, (select unnest({THETAS}) as t) group by all)
    select theta, round(avg(stop),6) as mean_depth, round(avg((pred=y)::int),6) as acc from s join g on g.vec_id=s.vec_id and g.k=s.stop group by theta"""
)
def halting_curve(spark, sf):
    """The first pass whose confidence reaches the threshold, else the last; one row of arrays per record."""
    passes = C.depth_records(records(spark, sf), DEPTHS)
    arr = passes.groupBy("vec_id", "y").agg(F.array_sort(F.collect_list(F.struct("k", F.array_max("p").alias("c"), P.argmax(F.col("p")).alias("pred")))).alias("a"))
    x = arr.select("y", "a", F.explode(F.array(*map(F.lit, THETAS))).alias("theta"))
    stop = F.coalesce(F.try_element_at(F.filter("a", lambda e: e["c"] >= F.col("theta")), F.lit(1)), F.element_at("a", -1))
    x = x.withColumn("s", stop)
    return x.groupBy("theta").agg(F.round(F.avg("s.k"), 6).alias("mean_depth"), F.round(F.avg((F.col("s.pred") == F.col("y")).cast("int")), 6).alias("acc"))


@query(
    f"""with {REC}, w as (select conf, row_number() over (order by conf, vec_id) as r, count(*) over () as n from rec where correct = 0)
    select round(conf,9) as threshold, n from w where r = least(greatest(floor(0.1*(n+1))-1,0),n-1)+1"""
)
def conformal_threshold(spark, sf):
    wrong = records(spark, sf).where("correct = 0").select("conf", "vec_id")
    return C.conformal(wrong, "conf", 0.1, "vec_id").select(F.round("threshold", 9).alias("threshold"), "n")


@query(
    f"""with {REC}, {PASSES}, a as (select k, (list_position(p,list_max(p))-1 = y)::int as c from pk), d as (select k, avg(c) as acc from a group by k)
    select k, round(acc,6) as acc, round((select acc from d where k={DEPTHS})-(select acc from d where k=1),6) as gain, (select max(acc)-min(acc) from d) < 0.01 as flat from d"""
)
def depth_curve(spark, sf):
    d = C.depth_records(records(spark, sf), DEPTHS).groupBy("k").agg(F.avg((P.argmax(F.col("p")) == F.col("y")).cast("int")).alias("acc"))
    t = d.agg(F.max(F.when(F.col("k") == DEPTHS, F.col("acc"))).alias("z"), F.max(F.when(F.col("k") == 1, F.col("acc"))).alias("a"), (F.max("acc") - F.min("acc")).alias("range"))
    return d.crossJoin(F.broadcast(t)).select("k", F.round("acc", 6).alias("acc"), F.round(F.col("z") - F.col("a"), 6).alias("gain"), (F.col("range") < 0.01).alias("flat"))


@query(
    f"""with {REC}, {PASSES}, m as (select vec_id, k, z[y+1]-ln(list_sum(list_transform(list_filter(z, lambda x, i: i-1<>y), lambda x: exp(x)))) as m from pz),
    h as (select vec_id, k, m, case when k > 1 then greatest(lag(m) over (partition by vec_id order by k)-m, 0) end as hinge from m)
    select k::int as k, round(avg(m),6) as mean_margin, round(avg(hinge),6) as mean_hinge from h group by k"""
)
def margin_hinge(spark, sf):
    x = records(spark, sf).select("vec_id", "y", "z", F.explode(F.sequence(F.lit(1), F.lit(DEPTHS))).alias("k"))
    z = F.transform("z", lambda v: v * F.col("k") / DEPTHS)
    others = F.filter(z, lambda v, i: i != F.col("y"))
    x = x.select("vec_id", "k", (P.at(z, F.col("y")) - P.log_sum_exp(others)).alias("m"))
    back = F.lag("m").over(Window.partitionBy("vec_id").orderBy("k"))
    x = x.withColumn("h", F.greatest(back - F.col("m"), F.when(back.isNotNull(), F.lit(0.0))))
    return x.groupBy("k").agg(F.round(F.avg("m"), 6).alias("mean_margin"), F.round(F.avg("h"), 6).alias("mean_hinge"))


@query(f"with {REC} select vec_id, rank::int as rank, (i-1)::int as option, round(p[i],6) as prob from (select vec_id, p, unnest(list_transform(list_sort(list_transform(p, lambda x, i: {{'x': -x, 'i': i}}))[1:3], lambda s: s.i)) as i, generate_subscripts([1,2,3],1) as rank from rec)")
def top_k_options(spark, sf):
    x = records(spark, sf).select("vec_id", "p", F.posexplode(P.top_k(F.col("p"), 3)).alias("r", "option"))
    return x.select("vec_id", (F.col("r") + 1).alias("rank"), "option", F.round(P.at(F.col("p"), F.col("option")), 6).alias("prob"))


@query(f"with {REC} select case when y < 8 then 'in' else 'oos' end as scope, count(*) as n, round(avg(list_max(z)),6) as mean_max from rec group by 1")
def oos_separation(spark, sf):
    return records(spark, sf).groupBy(F.when(F.col("y") < 8, "in").otherwise("oos").alias("scope")).agg(F.count("*").alias("n"), F.round(F.avg(F.array_max("z")), 6).alias("mean_max"))


@query(f"with {REC}, s as (select y, correct, (list_position(list_transform(z, lambda x: round(x,1)), list_max(list_transform(z, lambda x: round(x,1))))-1=y)::int as para from rec) select round(avg(correct)-avg(para),6) as gap from s")
def paraphrase_gap(spark, sf):
    """Accuracy on exact scores minus accuracy on coarse ones, over the same rows."""
    coarse = P.argmax(F.transform("z", lambda x: F.round(x, 1)))
    return records(spark, sf).agg(F.round(F.avg("correct") - F.avg((coarse == F.col("y")).cast("int")), 6).alias("gap"))


@query(f"with {REC} select round(avg(correct),6) as choice_acc, round(avg(((p_true > 0.5) = (y%2=0))::int),6) as bool_acc, round(avg((round_even(level,0)=y)::int),6) as ordinal_acc, round(avg(abs(level-y)),6) as ordinal_mae, round(greatest(avg((y%2=0)::int),1-avg((y%2=0)::int)),6) as bool_majority from rec")
def multi_question_accuracy(spark, sf):
    even = (F.col("y") % 2 == 0).cast("int")
    r = lambda c, n: F.round(c, 6).alias(n)
    return records(spark, sf).agg(
        r(F.avg("correct"), "choice_acc"), r(F.avg(((F.col("p_true") > 0.5) == (F.col("y") % 2 == 0)).cast("int")), "bool_acc"),
        r(F.avg((F.bround("level") == F.col("y")).cast("int")), "ordinal_acc"), r(F.avg(F.abs(F.col("level") - F.col("y"))), "ordinal_mae"),
        r(F.greatest(F.avg(even), 1 - F.avg(even)), "bool_majority"),
    )


@query(f"with {REC} select round(avg(nll)+0.5*avg(1-sph)+coalesce(avg(rps) filter (family='mcq'),0),6) as loss, round(avg(1/(1+exp(-(z[1]-z[2])))),6) as mean_pair from rec")
def mixed_loss(spark, sf):
    pair = P.sigmoid(F.col("z")[0] - F.col("z")[1])
    loss = F.avg("nll") + 0.5 * F.avg(1 - F.col("sph")) + F.coalesce(F.avg(F.when(F.col("family") == "mcq", F.col("rps"))), F.lit(0.0))
    return records(spark, sf).agg(F.round(loss, 6).alias("loss"), F.round(F.avg(pair), 6).alias("mean_pair"))


@query(
    f"""with {REC}, s as (select grp, family, correct, nll, vec_id%4 as mode, vec_id%2 as n2 from rec)
    select family, round(avg(correct) filter (mode=0),6) as text_only, round(avg(correct) filter (mode=1),6) as vector_only, round(avg(correct) filter (mode>=2),6) as both from s group by family"""
)
def modality_sweep(spark, sf):
    m = F.when(F.col("vec_id") % 4 == 0, "text_only").when(F.col("vec_id") % 4 == 1, "vector_only").otherwise("both")
    return records(spark, sf).withColumn("mode", m).groupBy("family").pivot("mode", ["text_only", "vector_only", "both"]).agg(F.round(F.avg("correct"), 6))


@query(
    f"""with ev as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
    g as (select label, vec_id % 3 as part, i, avg(v[i]) as a from ev, range(1,65) r(i) group by all),
    c as (select label, part, list(a order by i) as c from g group by all),
    u as (select label, part, list_transform(c, lambda x: x/sqrt(list_dot_product(c,c))) as c from c),
    t as (select e.vec_id, u.label, max(list_dot_product(e.v,u.c)/sqrt(list_dot_product(e.v,e.v))) as m, avg(list_dot_product(e.v,u.c)/sqrt(list_dot_product(e.v,e.v))) as a from ev e, u group by all)
    select vec_id, label, round(m,6) as max_sim, round(a,6) as mean_sim from t"""
)
def late_interaction(spark, sf):
    """Best and mean cosine of every vector with the part means of each label; the means are one broadcast row."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", P.doubles(F.col("embedding")).alias("v"))
    g = e.select("label", (F.col("vec_id") % 3).alias("part"), F.posexplode("v").alias("i", "x")).groupBy("label", "part", "i").agg(F.avg("x").alias("a"))
    c = g.groupBy("label", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda s: s["a"]).alias("c"))
    bank = c.groupBy("label").agg(F.collect_list("c").alias("parts")).agg(F.collect_list(F.struct("label", "parts")).alias("bank"))
    x = e.select("vec_id", "v").crossJoin(F.broadcast(bank)).select("vec_id", "v", F.explode("bank").alias("b"))
    s = F.transform("b.parts", lambda q: P.cosine(F.col("v"), q))
    return x.select("vec_id", F.col("b.label").alias("label"), F.round(F.array_max(s), 6).alias("max_sim"), F.round(P.total(s) / F.size(s), 6).alias("mean_sim"))


@query("select label, i::int as i, round(avg(embedding[i]::double),6) as mean from embeddings, range(1,65) r(i) group by label, i")
def mean_pool(spark, sf):
    x = table(spark, sf, "embeddings").select("label", F.posexplode(P.doubles(F.col("embedding"))).alias("i", "x"))
    return x.groupBy("label", (F.col("i") + 1).alias("i")).agg(F.round(F.avg("x"), 6).alias("mean"))


@query(
    f"""with {REC}, s as (select vec_id%4 as step, grp, correct from rec), m as (select step, grp, avg(correct) as a from s group by all), t as (select step, avg(a) as macro, max(a) as best from m group by step)
    select (select step from t order by round(macro,9) desc, step limit 1)::int as best_macro_step, (select step from t order by round(best,9) desc, step limit 1)::int as best_group_step, round(max(macro),6) as macro from t"""
)
def run_comparison(spark, sf):
    t = records(spark, sf).groupBy((F.col("vec_id") % 4).alias("step"), "grp").agg(F.avg("correct").alias("a")).groupBy("step").agg(F.avg("a").alias("macro"), F.max("a").alias("best"))
    pick = lambda c: -F.max(F.struct(F.round(c, 9), (-F.col("step")).alias("s")))["s"]
    return t.agg(pick("macro").cast("int").alias("best_macro_step"), pick("best").cast("int").alias("best_group_step"), F.round(F.max("macro"), 6).alias("macro"))
