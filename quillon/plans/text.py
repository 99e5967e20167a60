"""Normalisation, label names and rendering over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import uniform, uniform_sql
from ..operators.splits import placed
from .registry import query, table

NORM = "trim(regexp_replace(regexp_replace(lower({0}),'[^a-z0-9 ]',' ','g'),'\\s+',' ','g'))".format
FLAT = "trim(regexp_replace(replace({0},'\\n',' '),'[ \\t\\n\\r\\f\\x0B]+',' ','g'))".format
STOP = "[" + ",".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


@query(f"select doc_id, md5({NORM("coalesce(text,'')")}) as norm_key from documents")
def norm_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.norm_key(F.col("text")).alias("norm_key"))


@query("select doc_id, array_to_string(regexp_extract_all(lower(text),'[a-z0-9]+'),' ') as norm from documents")
def norm_audit(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.tokens(F.col("text")), " ").alias("norm"))


@query(
    f"""select doc_id, case when length(flat) > 300 then regexp_replace(substr(flat,1,300),' [^ ]*$','') else flat end as cleaned
    from (select doc_id, {FLAT('text')} as flat from documents)"""
)
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean(F.col("text"), 300).alias("cleaned"))


@query(
    f"""select doc_id, len(w)::int as n, array_to_string(w,' ') as words from (
    select doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text),'[a-z0-9]+'), lambda x: not list_contains({STOP}, x)))) as w from documents)"""
)
def content_words(spark, sf):
    w = T.word_set(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(w).alias("n"), F.array_join(w, " ").alias("words"))


@query(
    """with p as (select p_partkey, case when p_partkey % 97 = 0 then '' else p_name end as name from part),
    x as (select p_partkey, generate_subscripts(w,1) as pos, unnest(w) as tok from (select p_partkey, regexp_extract_all(lower(name),'[a-z0-9]+')[1:32] as w from p)),
    t as (select tok, min({'k': p_partkey, 'p': pos}) as seen from x where tok <> 'ring' group by tok),
    v as (select tok, 1 + row_number() over (order by seen) as id from t)
    select p.p_partkey, coalesce(string_agg(coalesce(id,1)::varchar,' ' order by pos),'1') as ids from p left join x on x.p_partkey = p.p_partkey left join v using (tok) group by p.p_partkey"""
)
def vocab_encode(spark, sf):
    """Ids of the first 32 tokens; words are numbered from 2 as they are first seen, others are 1, and a text without tokens is a single 1."""
    name = F.when(F.col("p_partkey") % 97 == 0, "").otherwise(F.col("p_name"))
    rows = table(spark, sf, "part").select("p_partkey", F.posexplode_outer(F.slice(T.tokens(name), 1, 32)).alias("pos", "tok"))
    seen = rows.where("tok is not null and tok <> 'ring'").groupBy("tok").agg(F.min(F.struct("p_partkey", "pos")).alias("seen"))
    vocab = placed(seen, [], ["seen"]).select("tok", (F.col("_place") + 1).alias("id"))
    out = rows.join(vocab, "tok", "left").groupBy("p_partkey").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(1)).alias("id")))).alias("x"))
    return out.select("p_partkey", F.array_join(F.transform("x", lambda e: e["id"].cast("string")), " ").alias("ids"))


@query(
    """with l as (select distinct p_brand||'::'||replace(p_name,' ','_')||'ByType?'||p_type as label from part)
    select label, split_part(label,'::',1) as source, regexp_replace(label,'^.*?::','') as intent,
      lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(label,'^.*?::',''),'[_?]',' ','g'),'(.)([A-Z])','\\1 \\2','g'),'(.)([A-Z])','\\1 \\2','g'),' +',' ','g'))) as human,
      translate(lower(regexp_replace(label,'^.*?::','')),'_-','  ') as normalized from l"""
)
def label_names(spark, sf):
    label = F.concat("p_brand", F.lit("::"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("ByType?"), "p_type")
    rows, c = table(spark, sf, "part").select(label.alias("label")).distinct(), F.col("label")
    return rows.select("label", T.source_of(c).alias("source"), T.intent_of(c).alias("intent"), T.humanize(T.intent_of(c)).alias("human"), T.normalized_name(c).alias("normalized"))


#: Test data of the two queries below, over part names.
TEMPLATES = ("any {x} in stock", "{x}, two boxes", "is {x} still sold", "parcel of {x}", "send {x} back", "{x} or the like", "price of {x}", "one more {x}")
_TPL = "[" + ",".join(f"'{t}'" for t in TEMPLATES) + "]"
_SYN = "map {" + ",".join(f"'{k}':'{v}'" for k, v in T.SYNONYMS.items()) + "}"
_WORDS = "string_split(p_name,' ')"


@query(
    f"""select p_partkey, replace({_TPL}[(floor({uniform_sql('tpl', 'p_partkey')}*8)+1)::int],'{{x}}',
      array_to_string(list_transform({_WORDS}, lambda w, i: case when {uniform_sql('syn', 'p_partkey', 'i-1')} < 0.4 then coalesce({_SYN}[w], w) else w end),' ')) as described,
      case when p_type = 'PROMO' then 'a request that fits none of the others' else 'a request about '||p_name end as base
    from part"""
)
def template_descriptions(spark, sf):
    k = F.col("p_partkey")
    label = F.when(F.col("p_type") == "PROMO", "x::oos").otherwise(F.concat(F.lit("x::"), F.replace("p_name", F.lit(" "), F.lit("_"))))
    text = T.from_template(T.with_synonyms(F.col("p_name"), "syn", k), TEMPLATES, "tpl", k)
    return table(spark, sf, "part").select("p_partkey", text.alias("described"), T.base_description(label).alias("base"))


RENDER_MODES = ("bare", "template", "description", "label_description")


@query(
    f"""with r as (select p_partkey, p_name, floor({uniform_sql('mode', 'p_partkey')}*4)::int as m from part)
    select p_partkey, ['bare','template','description','label_description'][m+1] as mode,
      case m when 0 then p_name when 1 then replace({_TPL}[(floor({uniform_sql('tpl', 'p_partkey')}*8)+1)::int],'{{x}}',p_name)
        when 2 then 'a request about '||p_name else p_name||': a request about '||p_name end as rendered from r"""
)
def render_modes(spark, sf):
    m, k, name = F.floor(uniform("mode", F.col("p_partkey")) * 4).cast("int"), F.col("p_partkey"), F.col("p_name")
    about = F.concat(F.lit("a request about "), name)
    text = F.when(m == 0, name).when(m == 1, T.from_template(name, TEMPLATES, "tpl", k)).when(m == 2, about).otherwise(F.concat(name, F.lit(": "), about))
    return table(spark, sf, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, RENDER_MODES)), m + 1).alias("mode"), text.alias("rendered"))


_SLOT = "My {item} has a {defect}, I want {money} back"
_DEFECTS = ("crack", "scratch", "missing part", "loose screw")


@query(
    f"""select p_partkey, k::int as k, replace(replace(replace('{_SLOT}','{{item}}',p_name),'{{defect}}',
      {list(_DEFECTS)}[(floor({uniform_sql('defect', 'p_partkey', 'k')}*4)+1)::int]),'{{money}}',(20+floor({uniform_sql('money', 'p_partkey', 'k')}*480)::int)::varchar) as text
    from part, range(3) r(k)"""
)
def slot_fill(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    defect = F.element_at(F.array(*map(F.lit, _DEFECTS)), (F.floor(uniform("defect", F.col("p_partkey"), F.col("k")) * 4) + 1).cast("int"))
    money = (F.lit(20) + F.floor(uniform("money", F.col("p_partkey"), F.col("k")) * 480)).cast("string")
    text = F.replace(F.replace(F.replace(F.lit(_SLOT), F.lit("{item}"), F.col("p_name")), F.lit("{defect}"), defect), F.lit("{money}"), money)
    return rows.select("p_partkey", "k", text.alias("text"))


# the order of the rules and the words broken, complaint, urgent, later, pending, balance, limit and fee are fixed values; the others are part names
HUMAN_WORDS = ("small", "widget", "promo", "broken", "complaint")
URGENCY_RULES = ((5, ("red", "urgent")), (4, HUMAN_WORDS), (1, ("green", "later")), (3, ("blue", "pending", "balance", "limit", "fee")))


@query(
    """with n as (select distinct p_name||' '||lower(p_type) as name from part)
    select name, regexp_matches(name,'small|widget|promo|broken|complaint') as needs_human,
      case when regexp_matches(name,'red|urgent') then 5 when regexp_matches(name,'small|widget|promo|broken|complaint') then 4
        when regexp_matches(name,'green|later') then 1 when regexp_matches(name,'blue|pending|balance|limit|fee') then 3 else 2 end as urgency from n"""
)
def rule_labels(spark, sf):
    rows, c = table(spark, sf, "part").select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("name")).distinct(), F.col("name")
    urgency = F.lit(2)
    for level, words in reversed(URGENCY_RULES):
        urgency = F.when(c.rlike("|".join(words)), level).otherwise(urgency)
    return rows.select("name", c.rlike("|".join(HUMAN_WORDS)).alias("needs_human"), urgency.alias("urgency"))


@query("select doc_id, contains(' '||text||' ',' not ') as negated from documents")
def negation_test(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.negated(F.col("text")).alias("negated"))


@query(
    """select o_orderkey, coalesce(nullif(list_position(['A','B','C','D','E'], k),0)-1, case when try_cast(k as int) between 1 and 5 then try_cast(k as int)-1 end)::int as idx
    from (select o_orderkey, case o_orderkey % 7 when 0 then 'A' when 1 then 'C' when 2 then '4' when 3 then '9' when 4 then '' when 5 then 'E' else '1' end as k from orders)
    where coalesce(nullif(list_position(['A','B','C','D','E'], k),0)-1, case when try_cast(k as int) between 1 and 5 then try_cast(k as int)-1 end) is not null"""
)
def answer_key_index(spark, sf):
    keys = F.element_at(F.array(*map(F.lit, ("A", "C", "4", "9", "", "E", "1"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    idx = T.key_index(keys, F.array(*map(F.lit, "ABCDE")))
    return table(spark, sf, "orders").select("o_orderkey", idx.alias("idx")).where("idx is not null")


@query(
    f"""select o_orderkey, least(4, round_even((o_orderkey%9)/8.0*4,0)::int) as level, {uniform_sql('rev', 'o_orderkey')} < 0.3 as reversed,
      case when {uniform_sql('rev', 'o_orderkey')} < 0.3 then 4-least(4, round_even((o_orderkey%9)/8.0*4,0)::int) else least(4, round_even((o_orderkey%9)/8.0*4,0)::int) end as answer_idx from orders"""
)
def similarity_levels(spark, sf):
    level = T.similarity_level((F.col("o_orderkey") % 9) / F.lit(8.0))
    rev = uniform("rev", F.col("o_orderkey")) < 0.3
    return table(spark, sf, "orders").select("o_orderkey", level.alias("level"), rev.alias("reversed"), F.when(rev, 4 - level).otherwise(level).alias("answer_idx"))


@query("select item_id, array_to_string(list_sort([left(text,20), right(text,20)]),' || ') as pair_key from benchmark")
def sentence_pair_key(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.sorted_pair(F.left("text", F.lit(20)), F.right("text", F.lit(20))).alias("pair_key"))


@query(
    """with r as (select event_id, event_type, case when event_id % 2 = 0 then 'noul' else 'choice' end as qtype, ('{"yes": "it is", "no": "it is not", "a": "first"}')::json as crit from events)
    select event_id, case qtype when 'noul' then 'bool' else qtype end as qtype,
      case when qtype = 'noul' then 'it is|it is not' else 'first|b' end as options, (event_id % 2)::int as answer_idx,
      json_object('type', event_type, 'id', event_id)::varchar as state from r"""
)
def benchmark_render(spark, sf):
    """Criteria of a label, else the label itself; structured states as JSON."""
    rows = table(spark, sf, "events").withColumn("crit", F.from_json(F.lit('{"yes": "it is", "no": "it is not", "a": "first"}'), "map<string,string>"))
    noul = F.col("event_id") % 2 == 0
    labels = F.when(noul, F.array(F.lit("yes"), F.lit("no"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    expected = F.when(noul, "yes").otherwise("b")
    options = F.transform(labels, lambda x: F.coalesce(F.try_element_at("crit", x), x))
    state = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("event_id").alias("id")))
    return rows.select("event_id", F.when(noul, "bool").otherwise("choice").alias("qtype"), F.array_join(options, "|").alias("options"), (F.array_position(labels, expected) - 1).cast("int").alias("answer_idx"), state.alias("state"))


@query(
    """select conv_id, turn, case when role = 'user' then text else '' end || case when role = 'user' then chr(10)||chr(10)||'Question: ' else '' end || role as mcq,
      text||' [SEP] [OPT] '||role||' [OPT] other [NOUL] [LVL] low [LVL] high' as marked from conversations"""
)
def context_rendering(spark, sf):
    context = F.when(F.col("role") == "user", F.col("text")).otherwise("")
    marked = T.marker_sequence(F.col("text"), F.array("role", F.lit("other")), F.array(F.lit("low"), F.lit("high")))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.mcq_context(context, F.col("role")).alias("mcq"), marked.alias("marked"))


@query(
    """select doc_id, round(ln(1+length(text)),6) as log_chars, round(ln(1+len(list_filter(regexp_split_to_array(text,'\\s+'), lambda w: w <> ''))),6) as log_words,
      case when doc_id%40 <= 2 then '2' when doc_id%40 <= 5 then '3-5' when doc_id%40 <= 10 then '6-10' when doc_id%40 <= 30 then '11-30' else '31+' end as cardinality,
      case when doc_id%6 <= 0 then '0' when doc_id%6 = 1 then '1' when doc_id%6 <= 3 then '2-3' else '4+' end as depth,
      (floor(length(text)/3)+64*greatest(1,doc_id%5)+160)::bigint as token_estimate from documents"""
)
def length_features(spark, sf):
    chars, words = T.log_lengths(F.col("text"))
    i = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id", F.round(chars, 6).alias("log_chars"), F.round(words, 6).alias("log_words"),
        T.cardinality_bucket(i % 40).alias("cardinality"), T.depth_bucket(i % 6).alias("depth"),
        T.token_estimate(F.char_length("text"), i % 5).cast("long").alias("token_estimate"),
    )


@query(
    f"""with o as (select o_orderkey, ['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'] as opts, o_orderpriority from orders),
    x as (select o_orderkey, o_orderpriority, unnest(opts) as t from o),
    s as (select o_orderkey, o_orderpriority, list(t order by md5('order|'||o_orderkey||'|'||t)) as l from x group by all)
    select o_orderkey, array_to_string(l,'|') as options, (list_position(l, o_orderpriority)-1)::int as answer_idx from s"""
)
def option_order(spark, sf):
    """Options in hashed order; the answer is found again by its text."""
    opts = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    keyed = F.transform(opts, lambda t: F.struct(F.md5(F.concat_ws("|", F.lit("order"), F.col("o_orderkey").cast("string"), t)).alias("h"), t.alias("t")))
    shuffled = F.transform(F.array_sort(keyed), lambda s: s["t"])
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(shuffled, "|").alias("options"), (F.array_position(shuffled, F.col("o_orderpriority")) - 1).cast("int").alias("answer_idx"))
