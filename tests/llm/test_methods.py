"""Single steps of the operators against plain versions of them."""

import collections
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import chat_views, common, jaccard_join, language_id, linear, link_trust, mixing, packing, quality, toxicity


def test_gram_buckets_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abcé ÀB\n\t.") for _ in range(3000)).encode()
    whole = collections.Counter(np.concatenate(list(linear.gram_buckets(text, (2, 3, 4), 2, 18))).tolist())
    monkeypatch.setattr(common, "BLOCK_BYTES", 50)
    parts = list(linear.gram_buckets(text, (2, 3, 4), 2, 18))
    assert len(parts) > 20 and collections.Counter(np.concatenate(parts).tolist()) == whole
    # as many grams as there are places and words
    words = len(text.split())
    assert sum(whole.values()) == sum(len(text) - n + 1 for n in (2, 3, 4)) + words + words - 1


def test_language_scores_by_hand(monkeypatch):
    rng = np.random.default_rng(2)
    table = rng.normal(size=(1 << language_id.BITS, 3)).astype(np.float32)
    text = "Über the hills and away".encode()
    f = np.concatenate(list(language_id.features(text)))
    bias, usual = np.array([0.1, -0.2], np.float32), table[f, 2].astype(float).mean()
    z = (table[f, :2].astype(float).mean(axis=0) + bias) / 0.7
    p = np.exp(z - z.max())
    for threshold, least, gone in ((0.0, usual - 0.01, False), (0.0, usual + 0.01, True), (1.0, usual - 0.01, True)):
        got, rejected = language_id.LanguageModel(["a", "b"], table, bias, 0.7, threshold, least).judged(text)
        assert np.allclose(got, p / p.sum()) and rejected == gone


def test_foreign_letters_are_rejected(spark, sf):
    model = language_id.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    assert 1 / len(model.languages) < model.threshold <= 0.5
    odd = ["これは日本語の文章です。" * 5, "это русский текст для проверки " * 4, "אבגדה וזחטי " * 9]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    got = {r.doc_id: (r.rejected, r.score) for r in language_id.predict(rows, model).collect()}
    assert all(r for r, _ in got.values()), got


LONG = """
import resource, sys
import numpy as np
from quillon.llm import language_id, quality, toxicity
text = ("the quick brown fox jumps over it again 12 " * 700_000)[: 30 << 20].encode()
m = quality.QualityModel(np.zeros(1 << quality.BITS, np.float32), 0.0, 1.0, 0.0)
l = language_id.LanguageModel(["a"], np.zeros((1 << language_id.BITS, 2), np.float32), np.zeros(1, np.float32), 1.0, 0.5, 0.0)
t = toxicity.ToxicityModel(toxicity.Lexicon({"idiot": 2.0}, {}), np.zeros(9), 0.0)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
f = {"op6": lambda: (m.probability(text), quality.rule_counts(text)), "op8": lambda: t.score(text.decode()), "op10": lambda: l.judged(text)}[sys.argv[1]]
f()
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""


@pytest.mark.parametrize("name", ["op6", "op8", "op10"])
def test_memory_of_a_text_of_30_mb(name):
    out = subprocess.run([sys.executable, "-c", LONG, name], capture_output=True, text=True, check=True)
    assert float(out.stdout) < 900, out.stdout


def test_equal_messages_are_spread(spark, monkeypatch):
    """A message repeated without end, and messages that differ late, have the views of a dialogue that is not cut."""
    rows = [(1, 0, "ann", "same words")] * 300 + [(1, 1, "bob", "h" * 300 + f"{i % 7}") for i in range(120)] + [(1, 0, "system", "be kind"), (2, 0, "ann", "x")] + [(None, None, None, None)] * 25
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    want = chat_views.rotate(turns)
    monkeypatch.setattr(chat_views, "HOT", 10)
    got = chat_views.rotate(turns)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    hot = spark.createDataFrame([(1, 420)], "_conv long, _count long")
    lanes = turns.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.coalesce("role", F.lit("unknown")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"), F.lit(5).cast("long").alias("_len"))
    sizes = chat_views._spread(lanes, hot).where("_part > 0").groupBy("_part").agg(F.sum("_copies").alias("n")).collect()
    assert len(sizes) >= 3 and max(r.n for r in sizes) < 250 and sum(r.n for r in sizes) == 421


def test_edges(spark):
    html = """<a href="http://B.net/x">1</a><A HREF='https://c.net'>2</A><a href=//d.net/y>3</a><a href="/go?u=http://evil.net/x">4</a>
        <a href="mailto:me@f.net">5</a><a href="javascript:go('http://g.net')">6</a><a data-href="http://h.net/">7</a><a href = " http://i.net:80/ ">8</a><a href="#top">9</a><a href=''>10</a>"""
    pages = spark.createDataFrame([("a.com", html), ("x.a.com", None), ("", '<a href="http://b.net">')], "host string, html string")
    got = {(r.src, r.dst): r.w for r in link_trust.edges(pages).collect()}
    assert got == {("a.com", "b.net"): 1, ("a.com", "c.net"): 1, ("a.com", "d.net"): 1, ("a.com", "i.net:80"): 1, ("a.com", "a.com"): 3, ("x.a.com", "a.com"): 1}


@pytest.mark.parametrize(("widest", "few"), [(4.0, 200_000), (0.0, 200_000), (10.0**9, 0), (0.0, 0)])  # doubled or not, broadcast or by source with hubs
def test_ranks_as_a_power_iteration_gives_them(spark, monkeypatch, widest, few):
    monkeypatch.setattr(link_trust, "BROADCAST_HOSTS", few)
    rng = random.Random(6)
    hosts = [f"h{i}.x" for i in range(25)]
    links = [(k, rng.choice(hosts), rng.choice(hosts), float(rng.randrange(1, 5))) for k in ("trust", "distrust") for _ in range(70)]
    graph = spark.createDataFrame(links, "kind string, src string, dst string, w double").groupBy("kind", "src", "dst").agg(F.sum("w").alias("w"))
    seeds = spark.createDataFrame([(k, h, 0.25) for k in ("trust", "distrust") for h in hosts[:4]], "kind string, host string, v double")
    got = {(r.kind, r.host): r.r for r in link_trust.propagate(graph, seeds, widest=widest).collect()}
    for kind in ("trust", "distrust"):
        m = np.zeros((25, 25))
        for k, s, d, w in links:
            if k == kind:
                m[hosts.index(d), hosts.index(s)] += w
        for j in range(25):
            m[j, j] += m[:, j].sum() == 0
        m /= m.sum(axis=0)
        v = np.array([0.25] * 4 + [0] * 21)
        r = np.linalg.solve(np.eye(25) - link_trust.DAMPING * m, (1 - link_trust.DAMPING) * v)
        assert all(abs(got.get((kind, h), 0.0) - x) < 1e-6 for h, x in zip(hosts, r))


def test_walks_stay_where_they_are(spark, monkeypatch):
    """Beyond the broadcast bound a round shuffles ranks, not walks."""
    monkeypatch.setattr(link_trust, "BROADCAST_HOSTS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        steps = spark.range(5000).select(F.lit("trust").alias("kind"), (F.col("id") % 2000).cast("string").alias("src"), (F.col("id") % 77).cast("string").alias("dst"), F.lit(0.1).alias("p"))
        walks = link_trust._kept(steps)
        ranks = common.cut(spark.range(2000).select(F.lit("trust").alias("kind"), F.col("id").cast("string").alias("host"), F.lit(1.0).alias("r")))
        moved = walks.moved(ranks).groupBy("kind", "host").agg(F.sum("r").alias("r"))
        assert moved.agg(F.sum("r")).first()[0] == pytest.approx(500)
        plan = moved._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(kind") == 2  # of the ranks, and of the sums
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_very_long_page(spark):
    html = '<a href="http://b.net/x">' * 200_000 + "text " * 1_000_000 + '<a href="http://c.net">'
    pages = spark.createDataFrame([(1, "http://a.com/", html), (2, "http://b.net/", None)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.host, r.verdict) for r in link_trust.verdicts(pages, [("allow", "com/")]).collect()) == [(1, "a.com", "allow"), (2, "b.net", "allow")]
    got = {(r.src, r.dst): r.w for r in link_trust.edges(pages.select(link_trust.host_of(F.col("url")).alias("host"), "html")).collect()}
    assert got == {("a.com", "b.net"): 200_000, ("a.com", "c.net"): 1}


def test_a_far_mark_of_inches_cites_nothing():
    lexicon = toxicity.Lexicon({"idiot": 3.0}, {}, frozenset())
    far = 'a 5" pipe ' + "and so on " * 15 + "you idiot go away"
    for text in (far, 'a 5" you idiot 6" b', 'he got "mail" you idiot and "more" came', "you idiot"):
        f = lexicon.features(text)
        assert f[0] > 0 and f[3] == 0, text
    for text in ('so "you idiot" it read', "«idiot» disait", "« idiot » là", "she wrote idiot there", 'x “what an idiot” y', "„idiot“ stand da"):
        f = lexicon.features(text)
        assert f[0] == 0 and f[3] > 0, text


def test_parts_of_a_long_text_find_the_same_hits(monkeypatch):
    lexicon = toxicity.Lexicon({"idiot": 3.0, "scum": 2.0}, {"moro": 2.0}, frozenset())
    text = " ".join(random.Random(3).choice(["word", "idiot", "scum", "id1ot", '"idiot"', "moronic", "said", "x.y"]) for _ in range(400))
    want = lexicon.features(text)
    monkeypatch.setattr(toxicity, "PART", 40)
    assert np.allclose(lexicon.features(text), want)


def test_raking_meets_margins_and_budget(spark):
    rng = random.Random(9)
    rows = [(f"s{a}", ["en", "fr", "de"][b], f"t{c}", float(rng.randrange(50, 900))) for a in range(6) for b in range(3) for c in range(4)]
    cells = common.cut(spark.createDataFrame(rows, "_source string, _lang string, _topic string, base double"))
    mix = mixing.Mix(source=0.5, lang={"en": 0.4, "fr": 0.3, "de": 0.3}, topic=0.7, budget=0.2)
    got = mixing.rake(cells, mix).toPandas()
    kept = got["base"] * got["probability"]
    assert abs(kept.sum() / got["base"].sum() - 0.2) < 1e-3 and got["probability"].max() < 1
    for value, share in mix.lang.items():
        assert abs(kept[got["_lang"] == value].sum() / kept.sum() - share) < 1e-3


def test_bound_on_shared_shingles():
    """No linked pair shares fewer deciding shingles than the bound says, under any order."""
    rng = random.Random(5)
    for _ in range(400):
        n = rng.randrange(1, 60)
        a = set(range(n))
        b = set(rng.sample(range(n), n - rng.randrange(0, n // 4 + 1))) | set(range(1000, 1000 + rng.randrange(0, n // 4 + 1)))
        if jaccard_join.linked(len(a & b), len(a), len(b)):
            order = sorted(a | b, key=lambda _: rng.random())
            first = lambda s: set([x for x in order if x in s][: jaccard_join.prefix_size(len(s))])
            assert len(first(a) & first(b)) >= jaccard_join.shared_at_least(len(a), len(b)) >= 1


def test_long_words_do_not_meet():
    """Words of a structure on which sums of powers are known to meet."""
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    h = common.word_hashes(f"{a} {b} {a}".encode())
    assert h[0] != h[1] and h[0] == h[2] and common.word_hashes(a.upper().encode())[0] == h[0]


def test_word_ids_as_the_library_gives_them():
    import unicodedata

    import public_tokenizers
    from tokenizers import Tokenizer

    from quillon.llm.queries import WORD_BPE

    path = public_tokenizers.path(WORD_BPE)
    mine, library = packing.WordIds(path, 1 << 16), Tokenizer.from_file(path)
    chars = [chr(c) for c in range(1, 256)] + list("İKıſŸẞßσΣς \u0085  　᠎​­﻿ﬁ日本") + ["<|endoftext|>", "<|startoftext|>", "'s", "'S", "é", "É", "</w>", "it's", "'ll"]
    texts = [x for c in chars for x in (c, "ab" + c, c + "ab", "ab" + c + "cd", "AB " + c + " cd!?")]
    rng = random.Random(4)
    texts += ["".join(rng.choice(chars + list(" abcdeXYZ.,!") * 6) for _ in range(rng.randrange(1, 30))) for _ in range(2000)]
    texts = [f(x) for x in texts for f in (str, lambda s: unicodedata.normalize("NFD", s))]
    got = [x for i in range(0, len(texts), 300) for x in mine.encode([t.encode() for t in texts[i : i + 300]])]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_no_text_is_sampled(spark, monkeypatch):
    """Texts of hundreds of kilobytes that share their begin, and long roles, keep the views of a dialogue that is not cut; ranges see heads only."""
    long = "shared begin " * 20_000
    rows = [(1, i % 3, "ann" if i % 2 else "r" * 100 + str(i % 4), long + str(i % 5)) for i in range(40)] + [(1, 5, "bob", f"m{i}") for i in range(40)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    digest = lambda df: sorted(df.select("perspective", "position", "turn", "speaker", "role_out", F.md5("rendered"), "char_start", "mask_start", "mask_end").collect(), key=repr)
    want = digest(chat_views.rotate(turns))
    keys = []
    real = type(turns).repartitionByRange
    monkeypatch.setattr(chat_views, "HOT", 10)
    monkeypatch.setattr(type(turns), "repartitionByRange", lambda self, n, *cols: keys.append(self.agg(F.max(F.length(F.concat_ws("", *(F.col(c).cast("string") for c in cols)))).alias("n")).first().n) or real(self, n, *cols))
    assert digest(chat_views.rotate(turns)) == want
    assert keys and max(keys) < 400
