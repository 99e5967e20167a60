"""Samplers, splits and builders that return their rows, and the shapes of criteria and adapters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import digest, digest_sql, uniform, uniform_sql
from ..operators import calibration as C
from ..operators import draws as W
from ..operators import splits as S
from .decisions import REC, SUMMARY, records
from .registry import query, table


def _ranked_sql(seed: str, by: str, key: str, name: str) -> str:
    return f"row_number() over (partition by {by} order by {digest_sql(seed, key)}, {key}) as {name}"


@query(
    f"""with r as (select doc_id, source, {_ranked_sql('carve', 'source', 'doc_id', 'r')}, count(*) over (partition by source) as n from documents)
    select doc_id, case when r <= least(greatest(2*5, floor(n/10)), floor(n/5)) then 'val' else 'train' end as split from r"""
)
def carve_val_rows(spark, sf):
    """Validation rows carved from the train rows of each source, by hashed rank."""
    rows = S.hash_ranked(table(spark, sf, "documents").select("doc_id", "source"), ["source"], "carve", "doc_id")
    return rows.select("doc_id", F.when(F.col("_rank") <= S.carve_size(F.col("_n"), 5), "val").otherwise("train").alias("split"))


@query("select (epoch)::int as epoch, doc_id from documents, (select unnest(range(4)) as epoch) where n_chars <= 500 * (1 + epoch)")
def length_curriculum_rows(spark, sf):
    """The rows under the length cap of each epoch."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("epoch"))
    return d.where(F.col("n_chars") <= 500 * (1 + F.col("epoch"))).select("epoch", "doc_id")


@query(
    f"""with c as (select count(*) filter (source='src0') as have, count(*) filter (source is distinct from 'src0') as other from documents),
    r as (select doc_id, source, {_ranked_sql('quota', 'source', 'doc_id', 'r')} from documents)
    select doc_id from r, c where source is distinct from 'src0' or r <= least(floor(0.15*other/(1-0.15)), have)"""
)
def source_quota_rows(spark, sf):
    """All rows of other sources, and so many of one source that it makes up 15 %."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    n = d.groupBy("source").agg(F.count("*").alias("n"))
    own = F.col("source").eqNullSafe(F.lit("src0"))
    c = d.agg(F.count_if(own).alias("have"), F.count_if(~own).alias("other"))
    cap = n.where(own).crossJoin(F.broadcast(c)).withColumn("cap", S.source_quota(0.15, F.col("other"), F.col("have")))
    return d.where(~own).select("doc_id").unionByName(S.capped(d.where(own), ["source"], cap, "quota", "doc_id").select("doc_id"))


DRAWS = 1000


@query(
    f"""with k as (select k as draw from range({DRAWS}) t(k)),
    n as (select lang, floor(count(*)*pow(1.0/count(*), 0.5)*1000000)::bigint as w from documents group by lang),
    {W.weighted_sql('l', 'n', 'lang', 'w', 'k', [], uniform_sql('ifl', 'd.draw'), "md5(concat_ws('|', 'ifc', lang))")},
    x as (select doc_id, lang, 1::bigint as w from documents),
    {W.weighted_sql('r', 'x', 'doc_id', 'w', 'l', ['lang'], uniform_sql('ifr', 'd.draw'), digest_sql('ifw', 'doc_id'))}
    select draw, doc_id from r"""
)
def inverse_frequency_draws(spark, sf):
    """Draws with replacement in which a row weighs the inverse root of its class: a class by its weight, then a row of it."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    n = d.groupBy("lang").agg(F.count("*").alias("n"))
    draws, k = spark.range(DRAWS).select(F.col("id").alias("draw")), F.col("draw")
    draws = W.weighted_draws(n, "lang", F.floor(F.col("n") * F.pow(1.0 / F.col("n"), F.lit(0.5)) * 1_000_000), draws, "draw", [], uniform("ifl", k), "ifc")
    return W.weighted_draws(d, "doc_id", F.lit(1), draws, "draw", ["lang"], uniform("ifr", k), "ifw").select("draw", "doc_id")


_KIND = "case when n_chars < 1000 then 'short' when n_chars < 4000 then 'middle' else 'long' end"


@query(
    f"""with k as (select k as draw from range({DRAWS}) t(k)),
    x as (select doc_id, lang, source, case lang when 'en' then {_KIND} else '' end as kind,
          case lang when 'fr' then least(greatest(10000000 // greatest(n_chars, 1), 2500), 40000) else 1 end::bigint as w from documents),
    f as (select distinct lang, case lang when 'en' then 2 else 1 end::bigint as w from x),
    s as (select lang, source, floor(sqrt(count(*))*case source when 'src1' then 2.0 else 1.0 end*1000000)::bigint as w from x group by lang, source),
    c as (select distinct lang, source, kind, 1::bigint as w from x),
    {W.weighted_sql('d1', 'f', 'lang', 'w', 'k', [], uniform_sql('lv0', 'd.draw'), "md5(concat_ws('|', 'lvf', lang))")},
    {W.weighted_sql('d2', 's', 'source', 'w', 'd1', ['lang'], uniform_sql('lv1', 'd.draw'), "md5(concat_ws('|', 'lvs', source))")},
    {W.weighted_sql('d3', 'c', 'kind', 'w', 'd2', ['lang', 'source'], uniform_sql('lv2', 'd.draw'), digest_sql('lvk', 'kind'))},
    {W.weighted_sql('d4', 'x', 'doc_id', 'w', 'd3', ['lang', 'source', 'kind'], uniform_sql('lv3', 'd.draw'), digest_sql('lv', 'doc_id'))}
    select draw, doc_id from d4"""
)
def three_level_draws(spark, sf):
    """Draws with replacement: a family by weight, a source by the root of its size and a factor, then a row.

    One family draws a class of the source first, so classes are equally likely; one draws rows by their own weight (that of
    `bias_w`, here larger for short texts); the others draw any row.
    """
    kind = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 4000, "middle").otherwise("long")
    bias = F.when(F.col("lang") == "fr", F.least(F.greatest(F.expr("10000000 div greatest(n_chars, 1)"), F.lit(2500)), F.lit(40000))).otherwise(1)
    x = table(spark, sf, "documents").select("doc_id", "lang", "source", F.when(F.col("lang") == "en", kind).otherwise("").alias("kind"), bias.alias("w"))
    s = x.groupBy("lang", "source").agg(F.count("*").alias("n"))
    root = F.floor(F.sqrt("n") * F.when(F.col("source") == "src1", 2.0).otherwise(1.0) * 1_000_000)
    draws, k = spark.range(DRAWS).select(F.col("id").alias("draw")), F.col("draw")
    draws = W.weighted_draws(s.select("lang").distinct(), "lang", F.when(F.col("lang") == "en", 2).otherwise(1), draws, "draw", [], uniform("lv0", k), "lvf")
    draws = W.weighted_draws(s, "source", root, draws, "draw", ["lang"], uniform("lv1", k), "lvs")
    draws = W.weighted_draws(x.select("lang", "source", "kind").distinct(), "kind", F.lit(1), draws, "draw", ["lang", "source"], uniform("lv2", k), "lvk")
    return W.weighted_draws(x, "doc_id", F.col("w"), draws, "draw", ["lang", "source", "kind"], uniform("lv3", k), "lv").select("draw", "doc_id")


@query(
    f"""with {REC}, s as (select grp, {SUMMARY}, round(avg(correct) filter (not blind_easy),6) as acc_blind_hard, count(*) filter (not blind_easy) as n_blind_hard from rec group by grp),
    b as (select grp, least(floor(conf*15),14) as bin, avg(conf) as c, avg(correct) as a, count(*) as m from rec group by all),
    e as (select grp, round(sum(abs(c-a)*m)/sum(m),6) as ece from b group by grp) select s.*, ece from s join e using (grp)"""
)
def summary_with_ece(spark, sf):
    """The summary of each group with its calibration error and its accuracy on rows that are not blindly easy."""
    rows = records(spark, sf)
    hard = F.when(~F.col("blind_easy"), F.col("correct"))
    s = rows.groupBy("grp").agg(*C.summary_columns(), F.round(F.avg(hard), 6).alias("acc_blind_hard"), F.count(hard).alias("n_blind_hard"))
    return s.join(C.ece(rows, ["grp"]).select("grp", F.round("ece", 6).alias("ece")), "grp")


def option_texts(labels: Column, criteria: Column) -> Column:
    """One text for each label from criteria in any shape, as JSON text.

    An object gives the text of its label, or of true and false for yes and no; a list as long as the labels gives each
    label with its entry; anything else gives the labels.
    """
    named, listed = F.from_json(criteria, "map<string,string>"), F.from_json(criteria, "array<string>")
    is_map, is_list = F.startswith(F.trim(criteria), F.lit("{")), F.startswith(F.trim(criteria), F.lit("["))
    # fixed values: the keys that stand for yes and no
    other = F.create_map(*map(F.lit, ("yes", "true", "no", "false", "true", "true", "false", "false")))
    of_map = F.transform(labels, lambda x: F.coalesce(F.try_element_at(named, x), F.try_element_at(named, F.try_element_at(other, F.lower(x))), x))
    of_list = F.zip_with(labels, listed, lambda x, y: F.concat(x, F.lit(": "), y))
    return F.when(is_map, of_map).when(is_list & (F.size(listed) == F.size(labels)), of_list).otherwise(labels)


_CRITERIA = ('{"yes": "it is", "maybe": "both"}', '{"true": "holds", "false": "fails"}', '["first", "second"]', '["one"]')


@query(
    """select event_id, case (event_id % 5)::int when 0 then 'it is|No' when 1 then 'holds|fails' when 2 then 'yes: first|No: second' else 'yes|No' end as options from events"""
)
def criteria_options(spark, sf):
    """The option texts of yes/no rows under criteria as a map, a true/false map, a list, a list of another length, and none."""
    shapes = F.array(*map(F.lit, _CRITERIA), F.lit(None).cast("string"))
    labels = F.array(F.lit("yes"), F.lit("No"))
    e = table(spark, sf, "events").select("event_id", F.element_at(shapes, (F.col("event_id") % 5 + 1).cast("int")).alias("criteria"))
    return e.select("event_id", F.array_join(option_texts(labels, F.col("criteria")), "|").alias("options"))


def target_options(seed: str, key: Column, most: int, least: int = 2) -> Column:
    """A number of options from least to most, even on a logarithmic scale."""
    return F.round(F.exp(F.lit(math.log(least)) + uniform(seed, key) * (math.log(most) - math.log(least)))).cast("int")


@query(
    f"""with pool as (select list(distinct name) as pool from (select n_name as name from nation union select c_mktsegment from customer)),
    o as (select p_partkey, list_distinct([p_name, p_brand, p_type, p_type||' '||p_name]) as opts, [p_name, p_brand, p_type, p_type||' '||p_name][(p_size%4+1)::int] as truth from part),
    t as (select *, round(exp(ln(2)+{uniform_sql('mcqn', 'p_partkey')}*(ln(20)-ln(2))))::int as target, {uniform_sql('mcqpad', 'p_partkey')} < 0.5 as pads from o where len(opts) = 4),
    f as (select p_partkey, list(x order by {digest_sql('mcqf', 'p_partkey', 'x')}) as others from (select p_partkey, unnest(pool) as x from t, pool) group by p_partkey),
    a as (select t.p_partkey, truth, case when pads and target > 4 then opts || others[1:least(target, 4+len(others))-4] else opts end as all_opts from t join f using (p_partkey)),
    s as (select p_partkey, truth, list(x order by {digest_sql('mcqs', 'p_partkey', 'x')}) as shown from (select p_partkey, truth, unnest(all_opts) as x from a) group by all)
    select p_partkey, array_to_string(shown,'|') as options, (list_position(shown, truth)-1)::int as answer_idx, len(shown)::int as n from s"""
)
def build_mcq(spark, sf):
    """Choices of a row in hashed order, half of the time padded by options of other tables to a drawn number from 2 to 20."""
    k = F.col("p_partkey")
    # the pool is a catalogue of some dozen names in one broadcast row
    names = table(spark, sf, "nation").select(F.col("n_name").alias("x")).union(table(spark, sf, "customer").select("c_mktsegment")).distinct()
    pool = names.agg(F.collect_list("x").alias("pool"))
    opts = F.array("p_name", "p_brand", "p_type", F.concat("p_type", F.lit(" "), "p_name"))
    rows = table(spark, sf, "part").select(k, opts.alias("opts"), F.element_at(opts, (F.col("p_size") % 4 + 1).cast("int")).alias("truth")).where(F.size(F.array_distinct("opts")) == 4)
    shuffled = lambda seed, a: F.transform(F.array_sort(F.transform(a, lambda x: F.struct(digest(seed, k, x).alias("h"), x.alias("x")))), lambda s: s["x"])
    missing = F.greatest(F.lit(0), F.least(target_options("mcqn", k, 20) - 4, F.size("pool")))
    padded = F.when(uniform("mcqpad", k) < 0.5, F.concat("opts", F.slice(shuffled("mcqf", F.col("pool")), F.lit(1), missing))).otherwise(F.col("opts"))
    shown = rows.crossJoin(F.broadcast(pool)).select(k, "truth", shuffled("mcqs", padded).alias("shown"))
    return shown.select(k, F.array_join("shown", "|").alias("options"), (F.array_position("shown", F.col("truth")) - 1).cast("int").alias("answer_idx"), F.size("shown").alias("n"))


@query(
    f"""with l as (select distinct p_name as label from part), n as (select label, row_number() over (order by {digest_sql('oosl', 'label')}, label) as r, count(*) over () as n from l),
    q as (select item_id, j, (floor({uniform_sql('oosr', 'item_id')}*n) + j * greatest(1, floor({uniform_sql('ooss', 'item_id')}*floor((n-1)/6)) + 1))::bigint % n + 1 as r from benchmark, (select max(n) as n from n), range(6) t(j))
    select item_id, string_agg(label, '|' order by j) as options, min(label) filter (j = 0) as fake_gold from q join n using (r) group by item_id"""
)
def oos_requests(spark, sf):
    """Texts out of scope, each with a label that counts as its answer and five others, at ranks of the catalogue that a stride tells apart."""
    labels = S.hash_ranked(table(spark, sf, "part").select(F.col("p_name").alias("label")).distinct(), [], "oosl", "label")
    size = labels.agg(F.max("_n").alias("n"))
    q = table(spark, sf, "benchmark").select("item_id").crossJoin(F.broadcast(size)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(5))))
    stride = F.greatest(F.lit(1), F.floor(uniform("ooss", F.col("item_id")) * F.floor((F.col("n") - 1) / 6)) + 1)
    at = (F.floor(uniform("oosr", F.col("item_id")) * F.col("n")) + F.col("j") * stride).cast("long") % F.col("n") + 1
    x = q.select("item_id", "j", at.alias("_rank")).join(labels.select("_rank", "label"), "_rank")
    s = x.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("j", "label"))).alias("a"))
    return s.select("item_id", F.array_join(F.transform("a", lambda e: e["label"]), "|").alias("options"), F.col("a")[0]["label"].alias("fake_gold"))


@query(
    f"""with a as (select o_orderkey, case when o_orderkey % 50 = 0 then 'maybe' when o_orderstatus = 'F' then ' True ' when o_orderstatus = 'O' then 'FALSE' else 'unknown' end as answer,
      (o_orderkey % 7)::int as idx from orders),
    t as (select o_orderkey, 'theory' as source, list_position(['true','false','unknown'], lower(trim(answer))) - 1 as answer_idx from a where lower(trim(answer)) in ('true','false','unknown')),
    c as (select o_orderkey, 'narrative' as source, idx as answer_idx from a where idx < 5),
    u as (select * from t union all select * from c),
    r as (select *, {_ranked_sql('reason', 'source', 'o_orderkey', 'r')}, count(*) over (partition by source) as n from u)
    select o_orderkey, source, answer_idx::int as answer_idx, case when r <= floor(0.7*n) then 'train' when r <= floor(0.7*n)+floor(0.15*n) then 'val' else 'test' end as split from r"""
)
def reasoning_adapters(spark, sf):
    """Rows of theories, whose answer is one of three words in any case, and of narratives, whose answer is a place among their choices; split by rank."""
    k = F.col("o_orderkey")
    answer = F.when(k % 50 == 0, "maybe").when(F.col("o_orderstatus") == "F", " True ").when(F.col("o_orderstatus") == "O", "FALSE").otherwise("unknown")
    rows = table(spark, sf, "orders").select("o_orderkey", answer.alias("answer"), (k % 7).cast("int").alias("idx"), F.array(*(F.lit(f"choice {i}") for i in range(5))).alias("choices"))
    both = theory_rows(rows, "answer").select("o_orderkey", F.lit("theory").alias("source"), "answer_idx").unionByName(choice_rows(rows, "choices", "idx").select("o_orderkey", F.lit("narrative").alias("source"), "answer_idx"))
    ranked = S.hash_ranked(both, ["source"], "reason", "o_orderkey")
    a, b = F.floor(0.7 * F.col("_n")), F.floor(0.15 * F.col("_n"))
    return ranked.select("o_orderkey", "source", "answer_idx", F.when(F.col("_rank") <= a, "train").when(F.col("_rank") <= a + b, "val").otherwise("test").alias("split"))


def theory_rows(rows: DataFrame, answer: str) -> DataFrame:
    """rows with option_texts and answer_idx, whose answer is true, false or unknown in any case; others go."""
    options = F.array(*map(F.lit, ("True", "False", "Unknown")))
    at = F.array_position(options, F.initcap(F.trim(F.col(answer).cast("string"))))
    return rows.withColumns({"option_texts": options, "answer_idx": (at - 1).cast("int")}).where("answer_idx >= 0")


def choice_rows(rows: DataFrame, choices: str, index: str) -> DataFrame:
    """rows with option_texts and answer_idx, whose index is a place among their choices; others go."""
    at = F.coalesce(F.col(index), F.lit(0)).cast("int")
    return rows.withColumns({"option_texts": F.col(choices), "answer_idx": at}).where((F.size("option_texts") > 0) & F.col("answer_idx").between(0, F.size("option_texts") - 1))


@query(
    f"""select item_id, case when {uniform_sql('swap', 'item_id')} < 0.5 then right(text,20) else left(text,20) end as first,
      case when {uniform_sql('swap', 'item_id')} < 0.5 then left(text,20) else right(text,20) end as second from benchmark"""
)
def swapped_pairs(spark, sf):
    """Sentence pairs, of which half are turned round."""
    turn = uniform("swap", F.col("item_id")) < 0.5
    a, b = F.left("text", F.lit(20)), F.right("text", F.lit(20))
    return table(spark, sf, "benchmark").select("item_id", F.when(turn, b).otherwise(a).alias("first"), F.when(turn, a).otherwise(b).alias("second"))


@query(
    f"""with r as (select o_orderkey, 'status::'||case o_orderstatus when 'P' then 'oos' else o_orderstatus end as label, {uniform_sql('osplit', 'o_orderkey')} as u from orders)
    select o_orderkey, label, case when ends_with(label,'::oos') then 'test_oos' when u < 0.1 then 'test' when u < 0.2 then 'val' else 'train' end as split from r"""
)
def oos_split(spark, sf):
    """Rows of the label out of scope go to a split of their own and to no other."""
    label = F.concat(F.lit("status::"), F.when(F.col("o_orderstatus") == "P", "oos").otherwise(F.col("o_orderstatus")))
    u = uniform("osplit", F.col("o_orderkey"))
    split = F.when(F.endswith("label", F.lit("::oos")), "test_oos").when(u < 0.1, "test").when(u < 0.2, "val").otherwise("train")
    return table(spark, sf, "orders").select("o_orderkey", label.alias("label")).select("o_orderkey", "label", split.alias("split"))


@query(
    f"""with {REC} select vec_id, vec_id % 3 = 0 as reversed, round(case when vec_id % 3 = 0 then len(p)-1-level else level end,6) as level,
      case when vec_id % 3 = 0 then len(p)-1-y else y end::int as true_level from rec"""
)
def ordinal_levels(spark, sf):
    """Expected levels; where the levels were shown in reverse, counted from the other end."""
    rev, last = F.col("vec_id") % 3 == 0, F.size("p") - 1
    turned = lambda x: F.when(rev, last - x).otherwise(x)
    return records(spark, sf).select("vec_id", rev.alias("reversed"), F.round(turned(F.col("level")), 6).alias("level"), turned(F.col("y")).cast("int").alias("true_level"))


SWEEP = (2, 4, 8)


@query(
    f"""with {REC}, n as (select unnest({list(SWEEP)}) as n),
    o as (select vec_id, y, n, list(i order by {digest_sql('sweep', 'vec_id', 'n', 'i')}) as opts from rec, n, range(10) r(i) where i <> y group by all),
    c as (select o.vec_id, n, rec.z, o.y, opts[1:(n-1)::int] as others from o join rec using (vec_id))
    select n::int as n, ['both','text','vector'][(vec_id%3+1)::int] as modality, count(*) as rows, round(avg((z[y+1] >= list_max(list_transform(others, lambda i: z[i+1])))::int),6) as acc from c group by all"""
)
def cardinality_sweep(spark, sf):
    """Accuracy by modality and number of options, with distractors drawn for each row and number."""
    from ..functions import scoring as P

    x = records(spark, sf).select("vec_id", "y", "z", F.explode(F.array(*map(F.lit, SWEEP))).alias("n"))
    others = F.transform(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda i: i != F.col("y")), lambda i: F.struct(digest("sweep", F.col("vec_id"), F.col("n"), i).alias("h"), i.alias("i")))
    best = F.array_max(F.transform(F.slice(F.array_sort(others), F.lit(1), F.col("n") - 1), lambda s: F.element_at("z", s["i"] + 1)))
    mode = F.element_at(F.array(*map(F.lit, ("both", "text", "vector"))), (F.col("vec_id") % 3 + 1).cast("int"))
    return x.groupBy("n", mode.alias("modality")).agg(F.count("*").alias("rows"), F.round(F.avg((P.at(F.col("z"), F.col("y")) >= best).cast("int")), 6).alias("acc"))


THETAS = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)


@query(
    f"""with {REC}, k as (select vec_id, y, k, list_transform(z, lambda v: v*k/6.0) as s from rec, range(1,7) t(k)),
    e as (select *, list_transform(s, lambda v: exp(v-list_max(s))) as ex from k), pk as (select vec_id, y, k, list_transform(ex, lambda x: x/list_sum(ex)) as p from e),
    h as (select vec_id, y, k, (list_position(p,list_max(p))-1)::int as pred, 1/(1+exp(-12*(list_max(p)-list_sort(p)[9]-0.3))) as halt from pk),
    t as (select unnest({list(THETAS)})::double as theta), s as (select vec_id, theta, coalesce(min(k) filter (halt >= theta), 6) as stop from h, t group by all)
    select theta, round(avg(stop),6) as mean_depth, round(avg((pred=y)::int),6) as acc from s join h on h.vec_id = s.vec_id and h.k = s.stop group by theta"""
)
def halting_probabilities(spark, sf):
    """The first pass whose halting probability (of the margin) reaches the threshold, else the last; mean depth and accuracy."""
    from ..functions import scoring as P

    passes = C.depth_records(records(spark, sf), 6)
    halt = 1 / (1 + F.exp(-12 * (F.array_max("p") - F.element_at(F.array_sort("p"), -2) - 0.3)))
    arr = passes.groupBy("vec_id", "y").agg(F.array_sort(F.collect_list(F.struct("k", halt.alias("h"), P.argmax(F.col("p")).alias("pred")))).alias("a"))
    x = arr.select("y", "a", F.explode(F.array(*map(F.lit, THETAS))).alias("theta"))
    x = x.withColumn("s", F.coalesce(F.try_element_at(F.filter("a", lambda e: e["h"] >= F.col("theta")), F.lit(1)), F.element_at("a", -1)))
    return x.groupBy("theta").agg(F.round(F.avg("s.k"), 6).alias("mean_depth"), F.round(F.avg((F.col("s.pred") == F.col("y")).cast("int")), 6).alias("acc"))


# fixed values: the words of yes/no options, no first
BOOL_WORDS = (("no", "yes"), ("false", "true"), ("No", "Yes"))
#: Descriptive options by status, no first, and those for a status without its own; test data.
CRITERIA = {"F": ("still open", "all shipped"), "O": ("nothing is due", "parts are due")}
OTHER_CRITERIA = ("it does not hold", "it holds")


@query(
    f"""with w as (select o_orderkey, o_orderstatus as s, (o_totalprice > 100000)::int as y, {uniform_sql('desc', 'o_orderkey')} < 0.3 as described, o_orderkey % 10 = 0 as pinned,
      (floor({uniform_sql('words', 'o_orderkey')}*3))::int as k, {uniform_sql('yesfirst', 'o_orderkey')} < 0.5 as turned from orders),
    p as (select *, case when pinned then 'no' when described then case s when 'F' then 'still open' when 'O' then 'nothing is due' else 'it does not hold' end else ['no','false','No'][k+1] end as neg,
      case when pinned then 'yes' when described then case s when 'F' then 'all shipped' when 'O' then 'parts are due' else 'it holds' end else ['yes','true','Yes'][k+1] end as pos from w)
    select o_orderkey, case when turned and not pinned then pos||'|'||neg else neg||'|'||pos end as options, case when turned and not pinned then 1-y else y end as answer_idx from p"""
)
def bool_wordings(spark, sf):
    """Yes/no requests in one of three pairs of words or the criteria of their source, in either order; pinned ones read no, yes."""
    k = F.col("o_orderkey")
    pinned, described, turned = k % 10 == 0, uniform("desc", k) < 0.3, uniform("yesfirst", k) < 0.5
    pair = lambda p: F.array(*map(F.lit, p))
    words = F.element_at(F.array(*map(pair, BOOL_WORDS)), (F.floor(uniform("words", k) * len(BOOL_WORDS)) + 1).cast("int"))
    own = F.create_map(*(x for s, p in CRITERIA.items() for x in (F.lit(s), pair(p))))
    opts = F.when(pinned, pair(BOOL_WORDS[0])).when(described, F.coalesce(F.try_element_at(own, F.col("o_orderstatus")), pair(OTHER_CRITERIA))).otherwise(words)
    y, turn = (F.col("o_totalprice") > 100000).cast("int"), turned & ~pinned
    return table(spark, sf, "orders").select(k, F.array_join(F.when(turn, F.reverse(opts)).otherwise(opts), "|").alias("options"), F.when(turn, 1 - y).otherwise(y).alias("answer_idx"))


#: Instructions by market segment, and those of segments without their own; test data.
INSTRUCTIONS = {"BUILDING": ("Which {target} fits?",), "MACHINERY": ("Name the {target}.", "What {target} is meant?")}
OTHER_INSTRUCTIONS = ("Choose the {target}.", "Tell the {target}.", "")


@query(
    f"""select c_custkey, replace(case c_mktsegment when 'BUILDING' then 'Which {{target}} fits?' when 'MACHINERY' then ['Name the {{target}}.','What {{target}} is meant?'][(floor({uniform_sql('ins', 'c_custkey')}*2)+1)::int]
      else ['Choose the {{target}}.','Tell the {{target}}.',''][(floor({uniform_sql('ins', 'c_custkey')}*3)+1)::int] end, '{{target}}', case when c_custkey % 2 = 0 then 'segment' else 'answer' end) as instruction from customer"""
)
def instruction_choice(spark, sf):
    """An instruction of the row's source, or of the common bank where it has none, with its target named."""
    bank = lambda x: F.array(*map(F.lit, x))
    own = F.create_map(*(x for s, b in INSTRUCTIONS.items() for x in (F.lit(s), bank(b))))
    texts = F.coalesce(F.try_element_at(own, F.col("c_mktsegment")), bank(OTHER_INSTRUCTIONS))
    text = F.element_at(texts, (F.floor(uniform("ins", F.col("c_custkey")) * F.size(texts)) + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", F.replace(text, F.lit("{target}"), F.when(F.col("c_custkey") % 2 == 0, "segment").otherwise("answer")).alias("instruction"))


@query(
    f"""with t as (select conv_id, turn, text from conversations), p as (select a.conv_id, a.turn, a.text as x, b.text as y from t a join t b on a.conv_id = b.conv_id and b.turn = a.turn + 1),
    q as (select 'pair' as kind, conv_id as id, turn, 'Do "'||x||'" and "'||y||'" mean the same?' as question, (x = y)::int as answer_idx from p
      union all select 'scope', doc_id, 0, 'Is this in scope?', 1 from documents where lang <> 'en' union all select 'scope', item_id, 1, 'Is this in scope?', 0 from benchmark)
    select kind, id, turn, md5(question) as question, answer_idx from q"""
)
def bool_requests(spark, sf):
    """Yes/no requests of whole sentence pairs, and of texts in and out of scope from two tables."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    pairs = t.join(after, ["conv_id", "turn"])
    question = F.concat(F.lit('Do "'), "text", F.lit('" and "'), "next", F.lit('" mean the same?'))
    out = pairs.select(F.lit("pair").alias("kind"), F.col("conv_id").alias("id"), "turn", question.alias("question"), (F.col("text") == F.col("next")).cast("int").alias("answer_idx"))
    scope = lambda rows, i, n, inside: rows.select(F.lit("scope").alias("kind"), F.col(i).alias("id"), F.lit(n).cast("long").alias("turn"), F.lit("Is this in scope?").alias("question"), F.lit(inside).alias("answer_idx"))
    out = out.unionByName(scope(table(spark, sf, "documents").where("lang <> 'en'"), "doc_id", 0, 1)).unionByName(scope(table(spark, sf, "benchmark"), "item_id", 1, 0))
    return out.withColumn("question", F.md5("question"))


@query(
    """with d as (select doc_id, source, list_filter([case when n_chars < 1000 then 'short' end, case when lang = 'en' then 'english' end, case when source = 'src1' then 'one' end], lambda x: x is not null) as labels from documents where length(text) >= 50),
    s as (select doc_id, source, labels[1] as label from d where len(labels) = 1), n as (select source, label from s group by all having count(*) >= 3)
    select doc_id, label from s join n using (source, label)"""
)
def single_label_rows(spark, sf):
    """Rows of a least length with one label only, which enough rows of their source have."""
    label = lambda cond, name: F.when(cond, name)
    labels = F.array(label(F.col("n_chars") < 1000, "short"), label(F.col("lang") == "en", "english"), label(F.col("source") == "src1", "one"))
    d = table(spark, sf, "documents").where(F.char_length("text") >= 50).select("doc_id", "source", F.filter(labels, lambda x: x.isNotNull()).alias("labels"))
    s = d.where(F.size("labels") == 1).select("doc_id", "source", F.col("labels")[0].alias("label"))
    n = s.groupBy("source", "label").agg(F.count("*").alias("n")).where("n >= 3")
    return s.join(n, ["source", "label"], "left_semi").select("doc_id", "label")


@query(
    """with b as (select (event_id // 250)::bigint as band, ts, value, event_type, coalesce((props->>'k')::bigint, 0) as tokens from events)
    select band, round(sum(tokens)/(epoch(max(ts))-epoch(min(ts))),6) as tokens_per_s, round(avg((value > 10)::int) filter (event_type = 'click'),6) as click_acc,
      round(avg((value > 10)::int) filter (event_type = 'purchase'),6) as purchase_acc from b group by band"""
)
def interval_tokens(spark, sf):
    """Tokens a second and the accuracy of each family over bands of a log."""
    k = F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(0))
    e = table(spark, sf, "events").select(F.floor(F.col("event_id") / 250).alias("band"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_type", (F.col("value") > 10).cast("int").alias("right"), k.alias("tokens"))
    acc = lambda kind: F.round(F.avg(F.when(F.col("event_type") == kind, F.col("right"))), 6).alias(kind + "_acc")
    return e.groupBy("band").agg(F.round(F.sum("tokens") / ((F.max("t") - F.min("t")) / 1e6), 6).alias("tokens_per_s"), acc("click"), acc("purchase"))


@query(
    """with s as (select event_id, event_type, case when event_id % 10 = 0 then '{broken' when event_id % 10 = 1 then null else props end as props from events)
    select event_type, count(*) filter (event_id % 10 > 1) as parsed, count(*) filter (event_id % 10 <= 1) as skipped, sum(case when event_id % 10 > 1 then (props->>'k')::bigint end)::bigint as k from s group by event_type"""
)
def tolerant_json(spark, sf):
    """Properties of which some are broken or missing: those that parse, and the number of the others."""
    i = F.col("event_id") % 10
    s = table(spark, sf, "events").select("event_type", F.when(i == 0, "{broken").when(i > 1, F.col("props")).alias("props"))
    k = F.from_json("props", "k bigint")["k"]
    good = F.try_parse_json("props").isNotNull()
    return s.groupBy("event_type").agg(F.count_if(good).alias("parsed"), F.count_if(~good).alias("skipped"), F.sum(F.when(good, k)).alias("k"))


@query("select conv_id, turn, role as split from conversations where trim(text) <> ''")
def answered_rows(spark, sf):
    """Splits in one table, without rows whose answer is blank."""
    from ..sources.jsonl import answered

    t = table(spark, sf, "conversations")
    of = lambda role: t.where(F.col("role") == role).withColumn("split", F.lit(role))
    return answered(of("user"), of("assistant"), t.where(~F.col("role").isin("user", "assistant")).withColumn("split", F.col("role")), answer="text").select("conv_id", "turn", "split")


@query(
    f"""with c as (select o_orderkey, l_linenumber as direction, (l_quantity::int % 7)::int as d, l_linestatus = 'O' as safe from orders join lineitem on l_orderkey = o_orderkey),
    w as (select *, max(d) over (partition by o_orderkey) as m from c), s as (select *, (m+1-d)::double / sum(m+1-d) over (partition by o_orderkey) as score from w),
    q as (select o_orderkey, min({{'u': not safe, 'd': d, 'n': direction}}) as best, count(*) as n, max(score) as top from s group by o_orderkey)
    select o_orderkey, best.n as choice, not best.u as safe, n, round(top,6) as top_score from q"""
)
def safe_first_choice(spark, sf):
    """Scores that fall with the distance and add up to one, and the choice: safe directions first, then the nearest."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("n"), (F.col("l_quantity").cast("int") % 7).alias("d"), (F.col("l_linestatus") != "O").alias("u"))
    li = li.join(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", "left_semi")
    # the scores follow from three aggregates of the order, so no row is joined back
    a = li.groupBy("o_orderkey").agg(F.min(F.struct("u", "d", "n")).alias("b"), F.count("*").alias("n"), F.max("d").alias("m"), F.min("d").alias("low"), F.sum("d").alias("all"))
    top = (F.col("m") + 1 - F.col("low")) / (F.col("n") * (F.col("m") + 1) - F.col("all"))
    return a.select("o_orderkey", F.col("b.n").alias("choice"), (~F.col("b.u")).alias("safe"), "n", F.round(top, 6).alias("top_score"))
