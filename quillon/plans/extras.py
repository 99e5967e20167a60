"""Composites: phrase buckets, candidate sets, adapters, suites and pooling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring as P
from ..functions import text as T
from ..functions.hashing import digest_sql, uniform, uniform_sql
from ..operators.keys import attach
from ..operators.splits import in_order, placed
from ..session import cut
from .decisions import REC, records
from .registry import query, table


@query(
    """select s_suppkey, case when s_acctbal < 0 then 'in debt' when s_acctbal < 2500 then 'tight' when s_acctbal < 6000 then 'fair' else 'ample' end
      ||' ('||(floor(s_acctbal/1000)::int)::varchar||'k)' as phrase from supplier"""
)
def phrase_buckets(spark, sf):
    a = F.col("s_acctbal")
    word = F.when(a < 0, "in debt").when(a < 2500, "tight").when(a < 6000, "fair").otherwise("ample")
    return table(spark, sf, "supplier").select("s_suppkey", F.concat(word, F.lit(" ("), F.floor(a / 1000).cast("int").cast("string"), F.lit("k)")).alias("phrase"))


@query(
    """with p as (select list(distinct p_name order by p_name) as pool from part), o as (select p_brand, list(distinct p_name order by p_name) as own from part group by p_brand)
    select p_brand, len(list_filter(pool, lambda x: not list_contains(own, x)))::int as n, list_filter(pool, lambda x: not list_contains(own, x))[1] as first from o, p"""
)
def foreign_without_own(spark, sf):
    """How many labels of the pool a brand has not, and the first of them: the first gap in the places of its own."""
    own = table(spark, sf, "part").where("p_name is not null").select("p_brand", "p_name").distinct()
    pool = in_order(own.select("p_name").distinct(), ["p_name"])
    pool = cut(pool.select("p_name", "_place"))
    places = attach(own, pool, ["p_name"]).select("p_brand", "_place")
    seat = F.row_number().over(Window.partitionBy("p_brand").orderBy("_place")) - 1
    gap = F.min(F.when(F.col("_place") != F.col("seat"), F.col("seat")))
    g = places.withColumn("seat", seat.cast("long")).groupBy("p_brand").agg(F.count("*").alias("k"), gap.alias("gap"))
    g = g.withColumn("_place", F.coalesce("gap", "k")).crossJoin(F.broadcast(pool.agg(F.count("*").alias("all"))))
    return g.join(pool, "_place", "left").select("p_brand", (F.col("all") - F.col("k")).cast("int").alias("n"), F.col("p_name").alias("first"))


@query(
    f"""with {REC}, c as (select vec_id, y, z, list_filter(range(10), lambda i: (i + vec_id) % 3 <> 0 or i = y) as own from rec),
    s as (select vec_id, y, list_transform(own, lambda i: z[i+1]) as zz, own from c) select vec_id, len(own)::int as n, (own[list_position(zz, list_max(zz))] = y)::int as correct from s"""
)
def grouped_candidates(spark, sf):
    """Each row has its own candidates; scores of others are left out, not padded."""
    own = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda i: ((i + F.col("vec_id")) % 3 != 0) | (i == F.col("y")))
    x = records(spark, sf).select("vec_id", "y", "z", own.alias("own")).withColumn("zz", F.transform("own", lambda i: F.element_at("z", i + 1)))
    best = F.element_at("own", P.argmax(F.col("zz")) + 1)
    return x.select("vec_id", F.size("own").alias("n"), (best == F.col("y")).cast("int").alias("correct"))


@query(
    """with a as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as k, length(text) as n from conversations where role = 'user'),
    b as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as k, length(text) as n from conversations where role = 'assistant')
    select a.conv_id, a.k::int as k, a.n as asked, b.n as answered from a join b using (conv_id, k)"""
)
def pairwise_zip(spark, sf):
    """Two aligned lists matched by place."""
    of = lambda r, n: table(spark, sf, "conversations").where(F.col("role") == r).select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("k"), F.char_length("text").cast("long").alias(n))
    return of("user", "asked").join(of("assistant", "answered"), ["conv_id", "k"])


@query("select row_number() over (order by n_chars, doc_id) as place, doc_id from documents")
def length_order(spark, sf):
    """The packing order: every row's place by length."""
    rows = placed(table(spark, sf, "documents").select("n_chars", "doc_id"), [], ["n_chars", "doc_id"])
    return rows.select(F.col("_place").alias("place"), "doc_id")


@query(
    """with ev as (select label, vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), ctx as (select * from ev where vec_id % 20 = 0), q as (select c.vec_id, c.v, m, (c.v[1:16*(m+1)])[16*m+1:] as code from ctx c, range(4) r(m)),
    pm as (select label, i, avg(v[i]) as a from ev, range(1,65) r(i) group by label, i), pr as (select label, list(a order by i) as p from pm group by label),
    s as (select vec_id, label, m, list_dot_product(code, p[16*m+1:16*m+16])/4.0 as s from q, pr), w as (select vec_id, label, list(s order by m) as ss from s group by all)
    select vec_id, label, round(list_sum(list_transform(ss, lambda x: exp(x-list_max(ss))*x))/list_sum(list_transform(ss, lambda x: exp(x-list_max(ss)))),6) as score from w"""
)
def poly_attention(spark, sf):
    """Four codes of a vector attend to each label and blend their scores."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", P.doubles(F.col("embedding")).alias("v"))
    d = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("a"))
    bank = d.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda s: s["a"]).alias("p")).agg(F.collect_list(F.struct("label", "p")).alias("bank"))
    x = e.where("vec_id % 20 = 0").select("vec_id", "v").crossJoin(F.broadcast(bank)).select("vec_id", "v", F.explode("bank").alias("b"))
    s = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda m: P.dot(F.slice("v", 16 * m + 1, F.lit(16)), F.slice(F.col("b.p"), 16 * m + 1, F.lit(16))) / 4.0)
    x = x.select("vec_id", F.col("b.label").alias("label"), s.alias("s"))
    return x.select("vec_id", "label", F.round(P.dot(P.softmax(F.col("s")), F.col("s")), 6).alias("score"))


@query(
    """with t as (select conv_id, list(role order by turn) as r, list(length(text)::double order by turn) as n from conversations group by conv_id)
    select conv_id, array_to_string(list_transform((list_filter(range(len(r)), lambda i: r[i+1] = 'assistant')||[0,0,0])[1:3], lambda i: i::varchar),',') as marks, n[len(n)] as last, round(list_sum(n)/len(n),6) as pooled from t"""
)
def marker_positions(spark, sf):
    """The first three places of a mark, padded by 0; and the last and mean of a per-turn value."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.char_length("text").cast("double").alias("n"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = t.withColumn("at", F.row_number().over(w) - 1).withColumn("mark", (F.col("role") == "assistant").cast("int"))
    t = t.withColumn("k", F.sum("mark").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = [F.coalesce(F.max(F.when((F.col("mark") == 1) & (F.col("k") == k), F.col("at"))), F.lit(0)).cast("string") for k in (1, 2, 3)]
    return t.groupBy("conv_id").agg(F.concat_ws(",", *first).alias("marks"), F.max_by("n", "at").alias("last"), F.round(F.avg("n"), 6).alias("pooled"))


@query(
    """with o as (select p_partkey, p_size, list_distinct([p_name, p_brand, p_type, p_type||' '||p_name]) as opts from part)
    select p_partkey, case when p_size % 2 = 0 then (p_size % 4) else p_size - 1 end::int as answer_idx from o where len(opts) = 4 and (p_size % 2 = 0 or p_size between 1 and 4)"""
)
def source_adapter(spark, sf):
    """Exactly four options; a letter or a number in range names the answer."""
    opts = F.array_distinct(F.array("p_name", "p_brand", "p_type", F.concat("p_type", F.lit(" "), "p_name")))
    s = F.col("p_size")
    letters = F.array(*map(F.lit, "ABCD"))
    answer = F.when(s % 2 == 0, F.element_at(letters, s % 4 + 1)).otherwise(s.cast("string"))
    return table(spark, sf, "part").where(F.size(opts) == 4).select("p_partkey", T.key_index(answer, letters).alias("answer_idx")).where("answer_idx is not null")


@query("with n as (select source, lang, count(*) as n from documents where length(text) >= 200 group by all having count(*) >= 20) select doc_id from documents join n using (source, lang) where length(text) >= 200")
def diversity_adapter(spark, sf):
    """Texts of a least length whose label has twenty rows at least."""
    d = table(spark, sf, "documents").where(F.char_length("text") >= 200).select("doc_id", "source", "lang")
    n = d.groupBy("source", "lang").agg(F.count("*").alias("n")).where("n >= 20")
    return d.join(n, ["source", "lang"], "left_semi").select("doc_id")


@query(
    f"""select item_id, case when {uniform_sql('oos', 'item_id')} < 0.5 then 'oos' else 'in' end as scope, 'Do both texts mean the same? '||left(text,10) as question, 'no|yes' as options, ({uniform_sql('oos', 'item_id')} >= 0.5)::int as answer_idx from benchmark"""
)
def paraphrase_requests(spark, sf):
    oos = uniform("oos", F.col("item_id")) < 0.5
    question = F.concat(F.lit("Do both texts mean the same? "), F.left("text", F.lit(10)))
    return table(spark, sf, "benchmark").select("item_id", F.when(oos, "oos").otherwise("in").alias("scope"), question.alias("question"), F.lit("no|yes").alias("options"), (~oos).cast("int").alias("answer_idx"))


@query(
    """select p_partkey, p_name as choice_answer, regexp_matches(p_name||' '||lower(p_type),'small|widget|promo|broken|complaint') as bool_answer,
      case when regexp_matches(p_name||' '||lower(p_type),'red|urgent') then 4 when regexp_matches(p_name||' '||lower(p_type),'small|widget|promo|broken|complaint') then 3 when regexp_matches(p_name||' '||lower(p_type),'green|later') then 0
        when regexp_matches(p_name||' '||lower(p_type),'blue|pending|balance|limit|fee') then 2 else 1 end as level_answer from part"""
)
def multi_question_request(spark, sf):
    """One state with a choice, a yes/no and a five-level question."""
    from .text import HUMAN_WORDS, URGENCY_RULES

    state = F.concat("p_name", F.lit(" "), F.lower("p_type"))
    level = F.lit(2)
    for n, words in reversed(URGENCY_RULES):
        level = F.when(state.rlike("|".join(words)), n).otherwise(level)
    return table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("choice_answer"), state.rlike("|".join(HUMAN_WORDS)).alias("bool_answer"), (level - 1).alias("level_answer"))


@query(
    f"""with {REC}, l as (select vec_id, y, list(i order by {digest_sql('opts', 'vec_id', 'i')}) as opts from rec, range(10) r(i) where i <> y group by vec_id, y), s as (select l.vec_id, l.y, opts[1:4]||[l.y::bigint] as o from l)
    select vec_id, array_to_string(list_sort(o),',') as options, (list_aggregate(list_transform(o, lambda i: z[i+1]),'max') = z[s.y+1])::int as correct from s join rec using (vec_id)"""
)
def seeded_option_sets(spark, sf):
    """Four distractors for each row, drawn by its id, and whether the true option scores best."""
    from ..functions.hashing import digest

    others = F.transform(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda i: i != F.col("y")), lambda i: F.struct(digest("opts", F.col("vec_id"), i).alias("h"), i.alias("i")))
    opts = F.concat(F.transform(F.slice(F.array_sort(others), 1, 4), lambda s: s["i"]), F.array("y"))
    x = records(spark, sf).select("vec_id", "y", "z", opts.alias("o"))
    best = F.array_max(F.transform("o", lambda i: F.element_at("z", i + 1)))
    return x.select("vec_id", F.array_join(F.transform(F.array_sort("o"), lambda i: i.cast("string")), ",").alias("options"), (best == P.at(F.col("z"), F.col("y"))).cast("int").alias("correct"))


@query(f"with {REC}, d as (select *, vec_id%4 as depth from rec), a as (select depth, grp, count(*) as n, avg(correct) as acc from d group by all) select grp, round(avg(acc),6) as score, sum(n)::bigint as n from a group by grp")
def depth_stratified(spark, sf):
    """Accuracy by depth and group, then the mean over depths."""
    a = records(spark, sf).groupBy("grp", (F.col("vec_id") % 4).alias("depth")).agg(F.count("*").alias("n"), F.avg("correct").alias("acc"))
    return a.groupBy("grp").agg(F.round(F.avg("acc"), 6).alias("score"), F.sum("n").alias("n"))


@query(
    """with t as (select distinct text, lang, source from documents) select lang, count(*) as n, count(*) filter (length(trim(text)) > 0) as answered from t where not starts_with(source, 'src1') group by lang"""
)
def corpus_view(spark, sf):
    """A corpus without one family of sources, repeats once, blank answers counted apart."""
    from ..sources.jsonl import without_prefix

    d = without_prefix(table(spark, sf, "documents"), "source", "src1").select(F.sha2("text", 256).alias("h"), (F.char_length(F.trim("text")) > 0).alias("a"), "lang", "source").distinct()
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("a").alias("answered"))


@query(
    """with b as (select (event_id // 250)::bigint as band, ts, value, event_type from events)
    select band, count(*) as examples, round(count(*)/(epoch(max(ts))-epoch(min(ts))),6) as rate, round(avg((event_type='error')::int),6) as wait_share from b group by band"""
)
def interval_throughput(spark, sf):
    e = table(spark, sf, "events").select(F.floor(F.col("event_id") / 250).alias("band"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_type")
    seconds = (F.max("t") - F.min("t")) / 1e6
    return e.groupBy("band").agg(F.count("*").alias("examples"), F.round(F.count("*") / seconds, 6).alias("rate"), F.round(F.avg((F.col("event_type") == "error").cast("int")), 6).alias("wait_share"))
