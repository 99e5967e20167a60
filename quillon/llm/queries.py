"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat_views, exact_dedup, jaccard_join, language_id, link_trust, mixing, packing, prefix_trie, quality, token_count, toxicity, warc
from .common import held_out, new_folder, table

Query = Callable[[SparkSession, str], DataFrame]
WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


#: Even out sources and languages, hold down tables and marked-up texts, keep half of all tokens.
MIX = mixing.Mix(source=0.5, lang={"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}, topic={"table": 0.05, "marked": 0.03, "loud": 0.02}, budget=0.5)


LLOYD = {"k": 40, "rounds": 5, "width": 64}


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.with_probability(table(spark, sf_dir, "documents"), MIX)
    names = {"_source": "source", "_lang": "lang", "_topic": "topic", "_tokens": "n_tokens"}
    return out.select("_row.doc_id", *(F.col(k).alias(v) for k, v in names.items()), F.round("_p", 6).alias("probability"), F.col("_sampled").alias("sampled"))


def op2_chat_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_views.rotate(table(spark, sf_dir, "conversations"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).drop("_key")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.verdicts(table(spark, sf_dir, "pages"), URL_RULES)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the operator hashes survivors only; the result wants a digest of every row
    out = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), digests=True)
    return out.withColumn("text_sha256", F.lower(F.hex("_digest"))).drop("_key", "_sha", "_digest")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.judge(docs, quality.fit(docs, labels))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.scores(docs, toxicity.fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = token_count.token_counts(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.predict(docs, language_id.fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.lloyd(table(spark, sf_dir, "embeddings"), **LLOYD)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations")).drop("preorder", "subtree_end")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.captures(warc.assemble(warc.read_records(spark, folder, with_payload=False)))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items()}


_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"


def _link_trust_sql() -> str:
    """Rules, host edges and enough rounds of propagation that nothing moves, one common table expression each."""
    from .link_trust import DAMPING, THRESHOLD

    rounds = 90

    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lambda u: low(f"regexp_extract(regexp_extract(coalesce({u}, ''), '(?s)^.*?://(.*)$', 1), '^[^/?#]*')")
    fits = lambda t: "((host = '{0}' or ends_with(host, '.{0}')) and starts_with(path, '/{1}'))".format(*t.split("/", 1))
    ranked = sorted(URL_RULES, key=lambda r: (-len(r[1]), r[1]))
    rule = "case " + " ".join(f"when {fits(t)} then '{t}'" for _, t in ranked) + " end"
    says = "case " + " ".join(f"when {fits(t)} then '{v}'" for v, t in ranked) + " end"
    parts = [
        f"""p as (select page_id, {host("url")} as host,
            regexp_extract(regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1), '^[^/?#]*([^?#]*)', 1) as path, html from pages)""",
        f"j as (select *, {rule} as rule, {says} as says from p)",
        """raw as (select host as src, unnest(string_split(regexp_replace(html, '(^|[^-A-Za-z0-9_])[hH][rR][eE][fF]\\s*=\\s*', chr(1), 'g'), chr(1))[2:]) as tail from p where host <> ''),
        l as (select src, trim(case left(tail, 1) when chr(34) then split_part(tail[2:], chr(34), 1) when chr(39) then split_part(tail[2:], chr(39), 1)
            else regexp_extract(tail, '^[^\\s>\\x22\\x27]*') end, chr(32) || chr(9) || chr(10) || chr(13)) as tgt from raw)""",
        f"""e0 as (select src, case when tgt[1:2] = '//' then {host("'x:' || tgt")} when not regexp_matches(split_part(tgt, ':', 1), '^[A-Za-z][A-Za-z0-9+.-]*$') or not contains(tgt, ':') then src
            when starts_with(split_part(tgt, ':', 2), '//') then {host("tgt")} else '' end as dst, 1.0::double as w from l),
        h as (select distinct host from p where host <> ''),
        e as (select src, dst, sum(w) as w from (
            select * from e0 where dst <> '' union all
            select host, regexp_extract(host, '^[^.]+[.](.+[.].+)$', 1), 1.0 from h where regexp_extract(host, '^[^.]+[.](.+[.].+)$', 1) <> '') group by all)""",
        "g as (select 'trust' as kind, src, dst, w from e union all select 'distrust', dst, src, w from e)",
        """mass as (select host, case when host = 'org' or ends_with(host, '.org') then 1.0 else 0.0 end as good,
            count(*) filter (says = 'block')::double / count(*) as bad from j where host <> '' group by host)""",
        """sd as (select kind, host, m / sum(m) over (partition by kind) as v from (
            select 'trust' as kind, host, good::double as m from mass union all select 'distrust', host, bad from mass) where m > 0)""",
        """st0 as (select kind, src, dst, w / sum(w) over (partition by kind, src) as p from g)""",
        """nodes as (select kind, dst as host from g union select kind, host from sd)""",
        """st as (select * from st0 union all select kind, host, host, 1.0 from nodes n
            where not exists (select 1 from st0 where st0.kind = n.kind and st0.src = n.host))""",
        "r0 as (select kind, host, v as r from sd)",
    ]
    for i in range(rounds):
        parts.append(f"""r{i + 1} as (select kind, host, sum(r) as r from (
            select st.kind, dst as host, {DAMPING} * p * r as r from st join r{i} on st.kind = r{i}.kind and st.src = r{i}.host
            union all select kind, host, {1 - DAMPING} * v from sd) group by all)""")
    parts.append(f"""k as (select host, round(coalesce(sum(r) filter (kind = 'trust'), 0) * (select count(*) from mass), 3) as t,
        round(coalesce(sum(r) filter (kind = 'distrust'), 0) * (select count(*) from mass), 3) as d from r{rounds} group by host)""")
    return f"""with {", ".join(x.replace(" as (", " as materialized (", 1) for x in parts)}
        select page_id, host, path, rule, coalesce(says, case when coalesce(d, 0) > {THRESHOLD} and coalesce(d, 0) > coalesce(t, 0) then 'block' else 'allow' end) as verdict,
               coalesce(t, 0) as trust, coalesce(d, 0) as distrust
        from j left join k using (host)"""


ORACLES = {
    "op1_mix_sources": mixing.oracle(MIX),
    "op2_chat_views": chat_views.ORACLE,
    "op3_jaccard_join": f"""
        with recursive d as materialized (select doc_id, regexp_extract_all({_AZ}, '{_WORD}') as w from documents),
        s as materialized (
            select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                       when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
        n as materialized (select doc_id, count(*) as n from s group by doc_id),
        k as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by all),
        links as materialized (select a, b from k join n p on p.doc_id = a join n q on q.doc_id = b where 100 * k >= 75 * (p.n + q.n - k)),
        r(a, b) as (select doc_id, doc_id from documents union select r.a, links.b from r join links on r.b = links.a)
        select doc_id, coalesce(n, 0) as n_shingles, m as component_id
        from (select a as doc_id, min(b) as m from r group by a) left join n using (doc_id)""",
    "op4_url_filters": _link_trust_sql(),
    "op11_centroids": centroids.oracle(**LLOYD),
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_warc": warc.ORACLE,
    "op5_exact_dedup": f"""
        with d as (select doc_id, {_AZ} as t from documents)
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
        from d window w as (partition by t)""",
}
