"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import chat_views, common, exact_dedup, language_id, link_trust, mixing, packing, quality, token_count, toxicity
from quillon.llm.queries import BYTE_BPE, MIX, URL_RULES, WORD_BPE

LONG = "Lorem ipsum dolor " * 30_000
TEXTS = ["Same Text", "same text", None, "", " \n ", "Ünï Cödé ÄÖ", "ünï cödé äö", LONG, LONG, "a<|endoftext|>b", "it's 12 345 ok!!", "x" * 3000, "line\nline\nother", "日本語 тест"]
CLASH = ["_id", "_text", "_len", "_key", "_sha", "gone", "row", "shas", "keep_id", "id", "set", "cell", "host", "_row", "_p", "kept", "score"]


def table(spark, texts=TEXTS, ids=None):
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}") for i, t in zip(ids or range(len(texts)), texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs.select("*", *(F.lit(7).alias(c) for c in CLASH)).repartition(3)


def az(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_exact_dedup(spark, monkeypatch):
    ids = [*range(len(TEXTS) - 1), 3]  # an id that repeats with another text
    for rows, keys, maps in ((10**6, 85, 16), (0, 85, 16), (0, 1, 16), (0, 1, 0)):  # by broadcast, by a join of suspects, by many maps, and with none
        monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(common, "MAP_BLOCKS", 1 << 18 if keys > 1 else 1)
        monkeypatch.setattr(common, "KEYS_PER_BLOCK", keys)
        monkeypatch.setattr(common, "MAPS", maps)
        got = exact_dedup.exact_duplicates(table(spark, ids=ids)).collect()
        groups = collections.defaultdict(list)
        for i, t in zip(ids, TEXTS):
            groups[az(t)].append(i)
        want = sorted((i, max(groups[az(t)]), len(groups[az(t)]), i == max(groups[az(t)])) for i, t in zip(ids, TEXTS))
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want
        kept = exact_dedup.keep_last(table(spark, ids=ids), broadcast_rows=rows)
        assert kept.columns == table(spark).columns
        assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((i, t or "") for i, t in zip(ids, TEXTS) if i == max(groups[az(t)]))
        # every row has the digest of its own text, also where ids repeat
        got = exact_dedup.exact_duplicates(table(spark, ids=ids), digests=True).collect()
        assert sorted((r.doc_id, r._digest.hex()) for r in got) == sorted((i, hashlib.sha256(az(t).encode()).hexdigest()) for i, t in zip(ids, TEXTS))


@pytest.mark.parametrize("blocks", [1 << 18, 40])  # one map, and several
def test_maps_of_keys(spark, monkeypatch, blocks):
    """Every key hits, and others under one in a hundred, however many maps the keys take."""
    monkeypatch.setattr(common, "MAP_BLOCKS", blocks)
    keys = common.cut(spark.range(40_000).select(F.xxhash64("id").alias("k")))
    rows = spark.range(80_000).select("id", F.xxhash64("id").alias("own"))
    hit = common.with_hit(rows, "own", keys, "k")
    assert hit.columns == ["id", "own", "_hit"]
    n = hit.groupBy((F.col("id") < 40_000).alias("key"), "_hit").count().collect()
    n = {(r.key, r._hit): r["count"] for r in n}
    assert n[True, True] == 40_000 and n.get((True, False), 0) == 0 and n.get((False, True), 0) < 400


def test_few_texts_are_shuffled(spark, monkeypatch):
    """Beyond the broadcast bound, with small maps, whole rows go through the shuffle only where a copy may go."""
    monkeypatch.setattr(common, "MAP_BLOCKS", 4)
    seen = []
    real = common.with_hit
    monkeypatch.setattr(common, "with_hit", lambda *a: seen.append(real(*a)) or seen[-1])
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.greatest(F.col("id"), F.lit(900)).cast("string")).alias("text"))
    assert exact_dedup.keep_last(docs, broadcast_rows=0).count() == 2100
    (marked,) = seen
    assert 900 <= marked.where("_hit").count() <= 900 + 21


def test_exact_dedup_null_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 1, 3), (None, 1, 3), (1, 1, 3), (None, None, 1)], key=str)
    for rows in (10**6, 0):
        assert sorted(map(tuple, exact_dedup.keep_last(docs, broadcast_rows=rows).collect()), key=str) == sorted([(1, "a"), (None, "b")], key=str)


def test_packing_round_trip(spark):
    t = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    for texts, ids in ((TEXTS, None), (TEXTS, [5] * len(TEXTS))):
        docs = table(spark, texts, ids)
        got = packing.pack(docs, public_tokenizers.path(WORD_BPE), group=4, with_ids=True).collect()
        fill = collections.defaultdict(list)
        for r in got:
            assert 0 < r.length <= 2048 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            fill[r.sequence_id].append((r.offset, r.length))
        for pieces in fill.values():  # gapless, within the window
            end = 0
            for at, n in sorted(pieces):
                assert at == end
                end += n
            assert end <= 2048
        want = collections.Counter(tuple(t.encode(x or "", add_special_tokens=False).ids + [1]) for x in texts)
        if ids is None:
            whole = collections.defaultdict(dict)
            for r in got:
                whole[r.doc_id][r.start] = r.ids
            assert collections.Counter(tuple(itertools.chain(*(v[k] for k in sorted(v)))) for v in whole.values()) == want
        assert sum(r.length for r in got) == sum(len(k) * n for k, n in want.items())


@pytest.mark.parametrize("sizes", [[2048], [1] * 5, [2000, 100, 1900, 60, 48], list(range(1, 400))])
def test_differencing(sizes):
    w = packing.windows_for(sizes)
    assert sorted(i for x in w for i in x) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in x) <= 2048 for x in w)
    assert len(w) <= -(-sum(sizes) // 2048) + 1


def test_differencing_is_even():
    sums = [sum(range(1, 101)[i] for i in w) for w in packing.difference(list(range(1, 101)), 7)]
    assert max(sums) - min(sums) <= 3


def test_token_count(spark, sf):
    t = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE))
    more = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(150).collect()]
    texts = [*TEXTS, *more, "ababab" * 50, "<|endoftext|>", "  <|endoftext|><|endoftext|> x"]
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_count.token_counts(table(spark, texts), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN).collect()}
    assert got == {i: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in enumerate(texts)}


def rules(text):
    """The base counts, from their definitions."""
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, sf):
    more = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(200).collect()]
    texts = [*TEXTS, *more, "a b c d e f g h a b c d e f g h", "A B c d e f g h a b c d e f g h", "# $ | <x>\n\n# $ | <x>"]
    got = {r.doc_id: r for r in quality.judge(table(spark, texts), None).collect()}
    for i, x in enumerate(texts):
        r, want = got[i], rules(x)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and r.kept == (not r.base_failed)


def test_quality_learns(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judge(docs, quality.fit(docs, labels)).join(labels, "doc_id").where(~F.col("base_failed"))
    hit = got.select(((F.col("probability") >= 0.5) == (F.col("quality") == 1)).cast("int").alias("h")).agg(F.avg("h")).first()[0]
    assert hit >= 0.95


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(docs)
    got = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    from quillon.llm.common import held_out

    assert got.where(held_out()).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.95
    assert got.agg(F.avg(F.col("rejected").cast("int"))).first()[0] <= 0.02
    odd = {r.doc_id: r for r in language_id.predict(table(spark), model).collect()}
    assert len(odd) == len(TEXTS)
    assert all((odd[i].lang_pred == "und") == (not re.search(r"[^\W\d_]", TEXTS[i] or "")) and 0 <= odd[i].score <= 1 for i in odd)
    kept = language_id.keep_known(table(spark), model)
    assert kept.columns == table(spark).columns and {r.doc_id for r in kept.collect()} == {i for i in odd if not odd[i].rejected}


def test_toxicity(spark, sf):
    from quillon.llm.common import held_out

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = toxicity.scores(docs, model).join(labels, "doc_id").where(held_out())
    assert got.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("toxic")).cast("int"))).first()[0] >= 0.9
    assert all(0 <= r.score <= 1 for r in toxicity.scores(table(spark), model).collect())


def test_levenshtein_automaton():
    words = ["idiot", "clown", "trash", "loser", "pathetic", "scum"]
    trie = toxicity.Trie(words)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for w in ["idiot", "idoit", "1diot", "idiots", "clwn", "tarsh", "traash", "lose", "x", "", "pathetik", "scam", "sccum"]:
        for limit in (0, 1, 2):
            assert sorted(trie.within(toxicity.LevenshteinAutomaton(w, limit))) == sorted(x for x in words if distance(w, x) <= limit)
    lexicon = toxicity.Lexicon({w: 3.0 for w in words}, {"moro": 2.0})
    kinds = {w: lexicon.kind(w)[0] for w in ("idiot", "idiots", "pathetik", "moronic", "morning", "scam")}
    assert kinds == {"idiot": 1, "idiots": 3, "pathetik": 3, "moronic": 2, "morning": 0, "scam": 0}
    abuse, cited = lexicon.features("you idiot go"), lexicon.features('they said "idiot" then')
    assert abuse[0] > 0 and not abuse[3] and cited[3] > 0 and not cited[0]


def test_models_without_labels(spark):
    docs = table(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, none) is None and toxicity.fit(docs, none) is None
    assert language_id.fit(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.score for r in toxicity.scores(docs, None).collect()} == {0.0}
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}


def test_mixing(spark, monkeypatch):
    texts = [f"{'w ' * (10 * (i % 7) + 1)}" for i in range(300)] + [None, ""]
    docs = table(spark, texts)
    want = {r["_row"].doc_id: (round(r["_p"], 9), r["_sampled"]) for r in mixing.with_probability(docs, MIX).collect()}
    assert len(want) == len(texts) and all(0 <= p <= 1 for p, _ in want.values())
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)
    monkeypatch.setattr(mixing, "SWEEPS", 2)
    few = {r["_row"].doc_id: round(r["_p"], 6) for r in mixing.with_probability(docs, MIX).collect()}
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 10**6)
    assert few == {r["_row"].doc_id: round(r["_p"], 6) for r in mixing.with_probability(docs, MIX).collect()}
    kept = mixing.sample(docs, MIX)
    assert kept.columns == docs.columns and kept.count() < len(texts)


def test_mixing_meets_the_targets(spark):
    texts = [f"{'w ' * 50}" for _ in range(4000)]
    rows = [(i, t, ["en", "fr"][i % 4 == 0], f"s{i % 3}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mix = mixing.Mix(source=1.0, lang={"en": 0.5, "fr": 0.5}, topic=1.0, budget=0.4)
    got = {r.lang: r["count"] for r in mixing.sample(docs, mix).groupBy("lang").count().collect()}
    assert abs(got["en"] / got["fr"] - 1) < 0.12 and abs(sum(got.values()) / 4000 - 0.4) < 0.04


def test_full_cells_leave_the_margins(spark, sf):
    """Cells that are kept whole do not take from the targets of their values; a target beyond what there is shows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cells = mixing.described(docs).groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").cast("double").alias("base"))
    raked = common.cut(mixing.rake(common.cut(cells), MIX))
    assert raked.where("probability = 1 and base > 0").count() > 0
    for r in mixing.margins(raked, MIX).collect():
        assert abs(r.wanted - r.got) < 1e-3
    scarce = mixing.Mix(source=1.0, lang={"en": 0.1, "es": 0.8}, topic=1.0, budget=0.9)
    raked = common.cut(mixing.rake(common.cut(cells), scarce))
    got = {r.value: (r.wanted, r.got) for r in mixing.margins(raked, scarce).where("dimension = 'lang'").collect()}
    assert got["es"][0] > 0.6 > 0.4 > got["es"][1] and raked.where("_lang = 'es'").agg(F.min("probability")).first()[0] > 0.99


def test_url_parts(spark):
    urls = ["http://A.Example.org/es/x?y#z", "HTTP://b.com", "x://h/p://q", None, "nothing", "a://", "http://com/fr/", "http://xcom/fr/", "http://u.com/de/?", "https://example.org/en/12", "http://d.net#f/p"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule) for r in link_trust.verdicts(pages, URL_RULES).collect()}
    assert got == {
        0: ("a.example.org", "/es/x", "example.org/es/"), 1: ("b.com", "", None), 2: ("h", "/p://q", None), 3: ("", "", None), 4: ("", "", None), 5: ("", "", None),
        6: ("com", "/fr/", "com/fr/"), 7: ("xcom", "/fr/", None), 8: ("u.com", "/de/", "com/de/"), 9: ("example.org", "/en/12", "example.org/en/1"), 10: ("d.net", "", None),
    }


def test_link_graph(spark):
    """Distrust flows to hosts that link to blocked ones; ranks as a plain power iteration gives them."""
    rows = [(1, "http://bad.com/de/1", '<a href="http://x.net/">'), (2, "http://bad.com/de/2", None), (3, "http://farm.net/a", '<a href="http://bad.com/z"><a href="//bad.com/">'), (4, "http://good.org/a", '<a href="http://fine.net/">'), (5, "http://fine.net/", '<a href="/own">')]
    got = {r.host: r for r in link_trust.verdicts(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES).collect()}
    assert got["farm.net"].verdict == "block" and got["fine.net"].verdict == "allow" and got["fine.net"].trust > 0.3 and got["good.org"].rule == "org/"
    assert abs(got["bad.com"].distrust + got["farm.net"].distrust - len(got)) < 1e-5


def test_chat_views(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "who"), (2, 0, "system", "alone"), (None, 1, "ann", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("_part", F.lit(0)).withColumn("perspective", F.lit(""))
    got = chat_views.rotate(turns).collect()
    views = collections.defaultdict(list)
    for r in got:
        views[r.conv_id, r.perspective].append(r)
    assert set(views) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    for (_, who), v in views.items():
        v.sort(key=lambda r: r.position)
        whole = "".join(r.rendered for r in v)
        assert [r.position for r in v] == list(range(len(v)))
        for r in v:
            assert whole[r.char_start :].startswith(r.rendered) and "<|end|>" not in r.rendered[:-8]
            if r.speaker == who:
                assert r.role_out == "assistant" and whole[r.mask_start : r.mask_end].endswith("<|end|>\n") and r.mask_end == r.char_start + len(r.rendered)
            else:
                assert r.mask_start is None


def test_chat_views_of_long_dialogues(spark, monkeypatch):
    """A dialogue cut into parts has the same views as one that is not."""
    rows = [(c, t // 3, "abcd"[t * 7 % 4] * (t % 4 + 1) if t % 11 else "system", f"say {t * t % 13} " + "x" * (t % 5)) for c, n in ((1, 90), (2, 7), (None, 60)) for t in range(n)]
    turns = spark.createDataFrame(rows + rows[:2], "conv_id long, turn long, role string, text string").repartition(3)
    want = chat_views.rotate(turns)
    monkeypatch.setattr(chat_views, "HOT", 10)
    for entries in (50_000, 0):
        monkeypatch.setattr(chat_views, "BROADCAST_ENTRIES", entries)
        got = chat_views.rotate(turns)
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_empty_tables(spark):
    docs = table(spark).where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert exact_dedup.exact_duplicates(docs).count() == exact_dedup.keep_last(docs).count() == 0
    assert packing.pack(docs, public_tokenizers.path(WORD_BPE)).count() == 0
    assert token_count.token_counts(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN).count() == 0
    assert quality.judge(docs, quality.fit(docs, labels)).count() == toxicity.scores(docs, toxicity.fit(docs, labels)).count() == 0
    assert language_id.predict(docs, language_id.fit(docs)).count() == 0
    assert mixing.sample(docs, MIX).count() == 0
    assert link_trust.verdicts(spark.createDataFrame([], "page_id long, url string, html string"), URL_RULES).count() == 0
    assert chat_views.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
