"""Audits of a corpus: baselines without content, chance, flags, correlations and label reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import uniform, uniform_sql
from ..operators.splits import placed
from ..session import cut, maybe_broadcast
from .registry import query, table

LEVELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def flag(acc: Column, chance: Column, n: Column) -> Column:
    """Whether accuracy is above chance by five points and by three standard errors; never without rows."""
    error = F.sqrt(F.greatest(chance * (1 - chance), F.lit(1e-6)) / F.greatest(n, F.lit(1)))
    return F.when(n > 0, acc - chance > F.greatest(F.lit(0.05), 3 * error)).otherwise(False)


FLAG = "case when n > 0 then acc-chance > greatest(0.05, 3*sqrt(greatest(chance*(1-chance),1e-6)/greatest(n,1))) else false end"


@query("select lang, count(*) as n, round(max(count(*)) over ()/min(count(*)) over (),2) as max_min_ratio from documents group by lang")
def label_histogram(spark, sf):
    n = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    r = n.agg(F.round(F.max("n") / F.min("n"), 2).alias("max_min_ratio"))
    return n.crossJoin(F.broadcast(r))


_SPLIT = f"select *, case when {uniform_sql('audit', 'doc_id')} < 0.8 then 'train' else 'val' end as split from documents"


def audit_docs(spark: SparkSession, sf: str) -> DataFrame:
    split = F.when(uniform("audit", F.col("doc_id")) < 0.8, "train").otherwise("val")
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", split.alias("split"))


@query(
    f"""with d as ({_SPLIT}), c as (select lang, count(*) as n, min(doc_id) as first from d where split='train' group by lang),
    m as (select lang from c order by n desc, first limit 1), r as (select count(*) as n, avg((lang = (select lang from m))::int) as acc, 1.0/count(distinct lang) as chance from d where split='val')
    select (select lang from m) as majority, n, round(acc,6) as acc, round(chance,6) as chance, {FLAG} as flagged from r"""
)
def majority_baseline(spark, sf):
    """The most frequent training label, scored on validation; of ties the one seen first."""
    d = audit_docs(spark, sf)
    c = d.where("split = 'train'").groupBy("lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    top = c.agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "lang"))["lang"].alias("majority"))
    v = d.where("split = 'val'").groupBy("lang").agg(F.count("*").alias("k"))
    r = v.crossJoin(F.broadcast(top)).groupBy("majority").agg(F.sum("k").alias("n"), (F.sum(F.when(F.col("lang") == F.col("majority"), F.col("k")).otherwise(0)) / F.sum("k")).alias("acc"), (F.lit(1.0) / F.count("*")).alias("chance"))
    return r.select("majority", "n", F.round("acc", 6).alias("acc"), F.round("chance", 6).alias("chance"), flag(F.col("acc"), F.col("chance"), F.col("n")).alias("flagged"))


@query(
    """with t as (select (length(c_name)+c_custkey)%5 as idx, count(*) as n, min(c_custkey) as f from customer where c_custkey%5<>0 group by 1),
    m as (select idx from t order by n desc, f limit 1) select (select idx from m)::int as position, count(*) as n, round(avg(((length(c_name)+c_custkey)%5 = (select idx from m))::int),6) as acc from customer where c_custkey%5=0"""
)
def position_baseline(spark, sf):
    idx = (F.char_length("c_name") + F.col("c_custkey")) % 5
    x = table(spark, sf, "customer").select("c_custkey", idx.alias("idx"))
    t = x.where("c_custkey % 5 <> 0").groupBy("idx").agg(F.count("*").alias("n"), F.min("c_custkey").alias("f"))
    top = t.agg(F.max(F.struct("n", (-F.col("f")).alias("f"), "idx"))["idx"].alias("position"))
    r = x.where("c_custkey % 5 = 0").crossJoin(F.broadcast(top))
    return r.agg(F.first("position").cast("int").alias("position"), F.count("*").alias("n"), F.round(F.avg((F.col("idx") == F.col("position")).cast("int")), 6).alias("acc"))


_OPTS = """with o as (select p_partkey, p_size % 3 as answer, [p_name, p_brand, p_type] as opts from part),
    l as (select p_partkey, answer, opts, list_transform(opts, lambda x: length(x)) as lens from o)"""


def part_options(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 3).alias("answer"), F.array("p_name", "p_brand", "p_type").alias("opts"))


@query(_OPTS + " select count(*) as n, round(avg((list_position(lens,list_max(lens))-1 = answer)::int),6) as longest, round(avg((list_position(lens,list_min(lens))-1 = answer)::int),6) as shortest, round(avg(1.0/len(opts)),6) as chance from l")
def length_baselines(spark, sf):
    lens = F.transform("opts", F.char_length)
    first = lambda m: F.array_position(lens, m(lens)) - 1
    hit = lambda m: F.round(F.avg((first(m) == F.col("answer")).cast("int")), 6)
    return part_options(spark, sf).agg(F.count("*").alias("n"), hit(F.array_max).alias("longest"), hit(F.array_min).alias("shortest"), F.round(F.avg(1 / F.size("opts")), 6).alias("chance"))


@query(
    """with o as (select p_partkey, p_size % 3 as answer, list_distinct(regexp_extract_all(lower(p_name||' '||case when p_size%2=0 then p_type else '' end),'[a-z0-9]+')) as ctx,
      [list_distinct(regexp_extract_all(lower(p_name),'[a-z0-9]+')), list_distinct(regexp_extract_all(lower(p_brand),'[a-z0-9]+')), list_distinct(regexp_extract_all(lower(p_type||' '||p_name),'[a-z0-9]+'))] as opts from part),
    k as (select answer, list_transform(opts, lambda x: len(list_intersect(ctx,x))) as s from o)
    select count(*) as n, round(avg((list_max(s) > 0)::int),6) as coverage, round(avg((list_max(s) > 0 and list_position(s,list_max(s))-1 = answer)::int),6) as acc from k"""
)
def keyword_match(spark, sf):
    """The option that shares most words with the context; none shared counts as wrong."""
    ctx = F.array_distinct(T.tokens(F.concat("p_name", F.lit(" "), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(""))))
    opts = F.array(*(F.array_distinct(T.tokens(c)) for c in (F.col("p_name"), F.col("p_brand"), F.concat("p_type", F.lit(" "), "p_name"))))
    s = F.transform(opts, lambda x: F.size(F.array_intersect(ctx, x)))
    x = table(spark, sf, "part").select((F.col("p_size") % 3).alias("answer"), s.alias("s"))
    top = F.array_max("s")
    ok = (top > 0) & (F.array_position("s", top) - 1 == F.col("answer"))
    return x.agg(F.count("*").alias("n"), F.round(F.avg((top > 0).cast("int")), 6).alias("coverage"), F.round(F.avg(ok.cast("int")), 6).alias("acc"))


@query(
    """with x as (select lang, row_number() over (partition by lang order by n_chars, doc_id) as r, doc_id%5 as level from documents)
    select lang, round(corr(r, level),6) as corr from x group by lang"""
)
def rank_correlation(spark, sf):
    """Correlation of the length rank with an ordinal level; a rank is the running count of lengths plus the place among equals."""
    d = table(spark, sf, "documents").select("lang", "n_chars", "doc_id", (F.col("doc_id") % 5).alias("level"))
    c = d.groupBy("lang", "n_chars").agg(F.count("*").alias("k"))
    c = c.select("lang", "n_chars", (F.sum("k").over(Window.partitionBy("lang").orderBy("n_chars")) - F.col("k")).alias("before"))
    x = d.join(c, ["lang", "n_chars"])
    r = F.col("before") + F.row_number().over(Window.partitionBy("lang", "n_chars").orderBy("doc_id"))
    return x.select("lang", r.alias("r"), "level").groupBy("lang").agg(F.round(F.corr("r", "level"), 6).alias("corr"))


@query(
    f"""with d as ({_SPLIT}), a as (select source, count(*) as n, avg((lang='en')::int) as acc, 0.25 as chance from d where split='val' group by source)
    select source, n, round(acc,6) as acc, {FLAG} as flagged from a"""
)
def significance_flags(spark, sf):
    a = audit_docs(spark, sf).where("split = 'val'").groupBy("source").agg(F.count("*").alias("n"), F.avg((F.col("lang") == "en").cast("int")).alias("acc"))
    return a.select("source", "n", F.round("acc", 6).alias("acc"), flag(F.col("acc"), F.lit(0.25), F.col("n")).alias("flagged"))


@query(
    """with n as (select p_brand as source, p_name as label, count(*) as n from part group by all), s as (select source, sum(n)::bigint as n, count(*) as labels, round(max(n)/min(n),2) as ratio from n group by source),
    t as (select source, string_agg(label,'|' order by n desc, label) as top5 from (select *, row_number() over (partition by source order by n desc, label) as r from n) where r <= 5 group by source)
    select source, n, labels, ratio, top5 from s join t using (source)"""
)
def intent_audit(spark, sf):
    n = table(spark, sf, "part").groupBy(F.col("p_brand").alias("source"), F.col("p_name").alias("label")).agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "label"))
    top = n.withColumn("r", r).where("r <= 5").groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]), "|").alias("top5"))
    s = n.groupBy("source").agg(F.sum("n").alias("n"), F.count("*").alias("labels"), F.round(F.max("n") / F.min("n"), 2).alias("ratio"))
    return s.join(top, "source")


@query("select lang, round(pow(sum(w),2)/sum(w*w),6) as ess from (select lang, ln(1+n_chars)::double as w from documents) group by lang")
def effective_sample_size(spark, sf):
    w = F.log1p("n_chars")
    return table(spark, sf, "documents").groupBy("lang").agg(F.round(F.pow(F.sum(w), F.lit(2.0)) / F.sum(w * w), 6).alias("ess"))


@query(
    """with r as (select lang, n_chars, row_number() over (partition by lang order by n_chars, doc_id) as r, count(*) over (partition by lang) as n from documents)
    select lang, max(n_chars) filter (r = floor(n*0.5)+1) as p50, max(n_chars) filter (r = floor(n*0.9)+1) as p90, max(n_chars) filter (r = least(floor(n*0.99)+1,n)) as p99, max(n_chars) as top from r group by lang"""
)
def percentile_summary(spark, sf):
    """Order statistics from counts of each length: the running count of a label's lengths finds the place."""
    c = table(spark, sf, "documents").groupBy("lang", "n_chars").agg(F.count("*").alias("k"))
    w = Window.partitionBy("lang").orderBy("n_chars")
    c = c.withColumn("to", F.sum("k").over(w)).withColumn("n", F.sum("k").over(Window.partitionBy("lang")))
    at = lambda q: F.min(F.when(F.col("to") >= F.least(F.floor(F.col("n") * q) + 1, F.col("n")), F.col("n_chars")))
    return c.groupBy("lang").agg(at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.max("n_chars").alias("top"))


@query("select lang, round(coalesce(avg(toxic),0),6) as positive_share from documents left join labels using (doc_id) group by lang")
def class_balance(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return d.groupBy("lang").agg(F.round(F.coalesce(F.avg("toxic"), F.lit(0.0)), 6).alias("positive_share"))


@query("select event_type, case when value < 5 then 'low' when value < 20 then 'mid' else 'high' end as bucket, count(*) as n, round(avg(value),6) as mean_value from events group by all")
def latency_by_bucket(spark, sf):
    b = F.when(F.col("value") < 5, "low").when(F.col("value") < 20, "mid").otherwise("high")
    return table(spark, sf, "events").groupBy("event_type", b.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query(
    """with m as (select source, avg((lang='en')::int) as majority, avg((n_chars>1000)::int) as longest_only, avg((doc_id%2=0)::int) as other, count(*) as n from documents group by source),
    u as (unpivot m on majority, longest_only, other into name metric value acc)
    select source, string_agg(metric, ',' order by metric) as flags from u where metric in ('majority','longest_only') and acc - 0.25 > greatest(0.05, 3*sqrt(0.1875/n)) group by source"""
)
def audit_report(spark, sf):
    """The checks of each source that are above chance; only those that read no content can be flagged."""
    a = lambda c: F.avg(c.cast("int"))
    m = table(spark, sf, "documents").groupBy("source").agg(a(F.col("lang") == "en").alias("majority"), a(F.col("n_chars") > 1000).alias("longest_only"), F.count("*").alias("n"))
    u = m.unpivot(["source", "n"], ["majority", "longest_only"], "metric", "acc").where(flag(F.col("acc"), F.lit(0.25), F.col("n")))
    return u.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("metric")), ",").alias("flags"))


_NB = f"""d as (select doc_id, toxic as y, (floor({uniform_sql('fold', 'doc_id')}*5))::int as fold, list_distinct(regexp_extract_all(lower(text),'[a-z]{{4,}}')) as w from documents join labels using (doc_id)),
    x as (select doc_id, y, fold, unnest(w) as w from d),
    f as (select unnest(range(5))::int as fold), wc as (select w, fold, sum(y) as pos, count(*)-sum(y) as neg from x group by all),
    wa as (select w, sum(pos) as pos, sum(neg) as neg from wc group by w), nc as (select fold, sum(y) as pos, count(*)-sum(y) as neg from d group by fold), na as (select sum(pos) as pos, sum(neg) as neg from nc),
    o as (select wc.w, wc.fold, ln((wa.pos-wc.pos+1)/(na.pos-nc.pos+2)) - ln((wa.neg-wc.neg+1)/(na.neg-nc.neg+2)) as odds from wc join wa using (w) join nc using (fold), na),
    s as (select x.doc_id, x.y, x.fold, sum(odds) as s from x join o on x.w=o.w and x.fold=o.fold group by all),
    p as (select doc_id, y, 1/(1+exp(-(greatest(least(s/10,30),-30) + ln((na.pos-nc.pos+1)/(na.neg-nc.neg+1))))) as p from s join nc using (fold), na)"""


def blind_nb(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-fitted naive Bayes over the words of a text, in hashed folds: each row is scored by the other folds' counts."""
    d = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("y")), "doc_id")
    d = d.select("doc_id", "y", F.floor(uniform("fold", F.col("doc_id")) * 5).cast("int").alias("fold"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1))).alias("ws"))
    # the words stay with their row and are not shuffled; only counts and the odds of words that rows have in common are
    d = cut(d)
    x = d.select("doc_id", "y", "fold", F.explode("ws").alias("w"))
    per = [F.sum(F.when(F.col("fold") == k, F.lit(1) if y is None else F.col("y")).otherwise(0)).alias(f"{n}{k}") for n, y in (("n", None), ("p", "y")) for k in range(5)]
    wc = x.groupBy("w").agg(F.count("*").alias("all"), F.sum("y").alias("ap"), *per)
    nc = d.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()  # a row for each fold
    n, p = ({r.fold: r[c] for r in nc} for c in ("n", "p"))
    held = lambda k: (sum(p.values()) - p.get(k, 0), sum(n.values()) - sum(p.values()) - n.get(k, 0) + p.get(k, 0))  # noqa: E731  rows of the other folds with and without the label

    def odds(k: int):
        pos, neg = F.col("ap") - F.col(f"p{k}"), (F.col("all") - F.col(f"n{k}")) - (F.col("ap") - F.col(f"p{k}"))
        return F.log((pos + 1) / (held(k)[0] + 2)) - F.log((neg + 1) / (held(k)[1] + 2))

    o = cut(wc.select("w", F.array(*map(odds, range(5))).alias("odds")))
    # while the words are few no row of a common word is shuffled
    x = x.join(maybe_broadcast(o, 200_000), "w")
    s = x.groupBy("doc_id", "y", "fold").agg(F.sum(F.element_at("odds", F.col("fold") + 1)).alias("s"))
    prior = F.element_at(F.array(*(F.lit(math.log((held(k)[0] + 1) / (held(k)[1] + 1))) for k in range(5))), F.col("fold") + 1)
    z = F.greatest(F.least(F.col("s") / 10, F.lit(30.0)), F.lit(-30.0)) + prior
    return s.select("doc_id", "y", (1 / (1 + F.exp(-z))).alias("p"))


@query(f"with {_NB} select doc_id, y::int as y, round(p,6) as p, (p > 0.5)::int = y as correct from p")
def blind_scores(spark, sf):
    return blind_nb(spark, sf).select("doc_id", F.col("y").cast("int").alias("y"), F.round("p", 6).alias("p"), ((F.col("p") > 0.5).cast("int") == F.col("y")).alias("correct"))


@query(f"with {_NB}, w as (select doc_id, least(greatest(1/greatest(case when y=1 then p else 1-p end,1e-3),0.25),4) as w from p) select doc_id, round(w/avg(w) over (),4) as bias_w from w")
def bias_weights(spark, sf):
    """Inverse of the blind probability of the gold label, clipped and scaled to mean one."""
    p = F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))
    w = blind_nb(spark, sf).select("doc_id", F.least(F.greatest(1 / F.greatest(p, F.lit(1e-3)), F.lit(0.25)), F.lit(4.0)).alias("w"))
    mean = w.agg(F.avg("w").alias("m"))
    return w.crossJoin(F.broadcast(mean)).select("doc_id", F.round(F.col("w") / F.col("m"), 4).alias("bias_w"))


@query(f"with {_NB}, t as (select y, p, abs(p-0.5) as c from p), n as (select count(*) as n from t) select doc_id from (select doc_id, row_number() over (order by round(case when y=1 then p else 1-p end,9) desc, doc_id) as r from p), n where r <= floor(0.05*n)")
def predictable_rows(spark, sf):
    """The twentieth of the rows that the blind scores predict best, ties by id."""
    p = F.round(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")), 9)
    rows = cut(blind_nb(spark, sf).select("doc_id", p.alias("q")))
    n = rows.count()  # rows without a word have no score and do not count
    return placed(rows, [], [F.desc("q"), F.col("doc_id")]).where(F.col("_place") <= n // 20).select("doc_id")
