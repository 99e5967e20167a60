"""Operators on hand-made rows: null keys, passages of any length, batches, filters and tags."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import batching as B
from quillon.operators import blind as M
from quillon.operators import calibration as C
from quillon.operators import dedup as D
from quillon.operators import splits as S
from quillon.plans.rows import choice_rows, option_texts, theory_rows


def test_null_keys_count_as_one_key(spark):
    rows = spark.createDataFrame([(1, None, 0), (2, None, 1), (3, "a", 1), (4, "a", 0), (5, "b", None)], "id long, k string, r int")
    assert sorted(r.id for r in D.first_by_priority(rows, "k", ["r", "id"]).collect()) == [1, 4, 5]
    assert sorted(r.id for r in D.not_in_higher_split(rows, "k", "r").collect()) == [1, 4, 5]


def test_two_kinds_of_dedup(spark):
    """The same text twice in train, and once each in val and test."""
    rows = spark.createDataFrame([(1, "t", 2), (2, "t", 2), (3, "t", 1), (4, "t", 0), (5, "u", 2), (6, "u", 2)], "id long, k string, r int")
    assert sorted(r.id for r in D.first_by_priority(rows, "k", ["r", "id"]).collect()) == [4, 5]
    assert sorted(r.id for r in D.not_in_higher_split(rows, "k", "r").collect()) == [4, 5, 6]


def test_norm_key_of_null_and_values(spark):
    row = spark.createDataFrame([(None, 1, None)], "t string, b int, a int").select(T.norm_key(F.col("t")).alias("n"), T.norm_key(F.lit("")).alias("e"), T.value_key(b=F.col("b"), a=F.col("a")).alias("v"), T.norm_key(F.lit('{"a":null,"b":1}')).alias("w")).first()
    assert row.n == row.e and row.v == row.w


@pytest.mark.parametrize("scanned", [256, 0])  # tested one by one, and found by hashed words
def test_passages_of_any_length(spark, monkeypatch, scanned):
    monkeypatch.setattr(D, "SCANNED", scanned)
    words = [f"w{i}" for i in range(30)]
    passages = [" ".join(words[:1]), "b1 b2", "c1 c2 c3", " ".join(f"d{i}" for i in range(6)), " ".join(f"e{i}" for i in range(7)), " ".join(f"f{i}" for i in range(8)), " ".join(f"g{i}" for i in range(20))]
    texts, want = ["nothing here", "", None, "d0 d1 d2 d3 d4 x d5", "c1 c2"], {0, 1, 2, 3, 4}
    for p in passages:
        texts += [p, "x " + p + " y", "glued" + p + "glued", p + "9", "a" + p, p[1:], p.replace(" ", "  ") if " " in p else "w", p.upper() + "!"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").select("id", D.spaced(F.col("text")).alias("t"))
    table = spark.createDataFrame([(p,) for p in [*passages, None]], "p string").select(D.spaced(F.col("p")).alias("p"))
    got = {r.id for r in D.without_passages(rows, "id", "t", table).collect()}
    flat = [" ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split()) for t in texts]
    want |= {i for i, t in enumerate(flat) if not any(p in t for p in passages)}
    assert got == want
    assert D.without_passages(rows, "id", "t", table.where("false")).count() == len(texts)
    assert D.without_passages(rows, "id", "t", table.limit(0).union(spark.createDataFrame([("",)], "p string"))).count() == sum(t is None for t in texts)


def test_placed(spark):
    rows = spark.createDataFrame([("a" if i % 3 else None, i * 7 % 100) for i in range(100)], "g string, v long").repartition(5)
    got = {(r.g, r.v): r._place for r in S.placed(rows, ["g"], ["v"]).collect()}
    for g in ("a", None):
        values = sorted(v for k, v in got if k == g)
        assert [got[g, v] for v in values] == list(range(1, len(values) + 1))


def test_conformal_of_few_scores(spark):
    at = lambda n: tuple(C.conformal(spark.createDataFrame([(i / 10, i) for i in range(n)], "s double, k long"), "s", 0.1, "k").first())
    assert at(0) == (0.5, 0) and at(1) == (0.0, 1) and at(9) == (0.0, 9) and at(29) == (0.2, 29)


def test_window_batches_keep_the_budget(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate([9000, 9000, 9000, 100, 100, 20_000])], "id long, n long")
    got = B.window_batches(rows, "id", "n", "s").collect()
    length = {r[0]: r[1] for r in rows.collect()}
    batches = {}
    for r in got:
        batches.setdefault((r.window, r.batch), []).append(length[r.key])
    assert sorted(map(sorted, batches.values())) == [[100, 100], [9000], [9000], [9000], [20_000]]
    assert {r.key for r in B.window_batches(rows, "id", "n", "s", cap=9000).collect()} == {0, 1, 2, 3, 4}
    greedy = B.greedy_batches(rows, "id", "n", "id").collect()
    assert len(greedy) == 6


def views_data(spark, n=300):
    rng = random.Random(2)
    rows = [(i, ("long word " * 30 if i % 2 else "tiny ") + f"x{rng.randrange(50)}", float(i % 2 if i < n * 2 // 3 else rng.randrange(2))) for i in range(n)]
    return spark.createDataFrame(rows, "_id long, text string, y double")


def test_aflite_drops_what_a_view_tells(spark):
    rows = views_data(spark)
    kept, report = M.aflite(rows, [M.View("length", M.length_stages)], "y", 0.5, rounds=2, folds=2, partitions=2, min_rows=50)
    n = kept.count()
    assert report[0]["n"] == 300 and report[0]["length"] > 0.6
    assert 300 - 2 * 15 <= n <= 300 - 15 and kept.columns == rows.columns
    # below chance in the first round: there is no round to undo
    kept, report = M.aflite(rows, [M.View("length", M.length_stages)], "y", 0.99, rounds=2, folds=2, partitions=1, min_rows=50)
    assert kept.count() == 300 and len(report) == 1
    assert M.aflite(rows.limit(40), [M.View("length", M.length_stages)], "y", 0.5)[1] == []
    # never more than half of the first rows
    kept, _ = M.aflite(rows, [M.View("length", M.length_stages)], "y", 0.0, rounds=3, folds=2, partitions=1, share=0.9, above=-1.0, min_rows=10)
    assert kept.count() == 150


def test_options_view_and_tags(spark):
    rng = random.Random(4)
    words = [f"o{i}" for i in range(40)]
    rows = []
    for i in range(200):
        gold = rng.randrange(3)
        options = [" ".join(rng.choices(words, k=2)) for _ in range(3)]
        options[gold] += " surely so indeed"
        rows.append((i, options, float(gold), "a" if i % 2 else "b", "train" if i < 150 else "val"))
    df = spark.createDataFrame(rows, "_id long, options array<string>, y double, source string, split string")
    view = M.OptionsView()
    seen = M.cross_fit(df, [view], "y", "s", folds=2)
    assert seen.agg(F.avg("hits")).first()[0] > 0.9 and seen.count() == 200
    tagged = M.eval_tags(df.where("split = 'train'"), df.where("split = 'val'"), [view], "y")
    assert tagged.where(F.array_contains("blind_easy", "options")).count() > 45 and tagged.count() == 50
    out, report = M.filter_sources(df, {"a": [view]}, "y", rounds=1, folds=2, partitions=1, min_rows=20)
    assert out.where("source = 'b'").count() == 100 and out.where("source = 'a' and split = 'val'").count() == 25
    assert report["a"]["train_before"] == 75 and report["a"]["train_after"] < 75


def test_weighted_fit_and_top_features(spark):
    rows = spark.createDataFrame([(i, "good fine" if i % 2 else "bad poor", float(i % 2), 1.0 + i % 3) for i in range(60)], "_id long, text string, y double, w double")
    view = M.View("text", M.text_stages)
    top = dict(M.top_features(view.fit(rows, "y", weight="w"), 2))
    assert min(top, key=top.get) in {"bad", "poor", "bad poor"} and max(top, key=top.get) in {"good", "fine", "good fine"}


def test_criteria_shapes(spark):
    crit = ['{"yes": "it is", "x": "y"}', '{"true": "holds", "false": "fails"}', '["first", "second"]', '["one"]', None, "{}", "free text"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(crit)], "i int, c string").select("i", option_texts(F.array(F.lit("yes"), F.lit("No")), F.col("c")).alias("o"))
    assert [r.o for r in rows.orderBy("i").collect()] == [["it is", "No"], ["holds", "fails"], ["yes: first", "No: second"], ["yes", "No"], ["yes", "No"], ["yes", "No"], ["yes", "No"]]


def test_reasoning_rows(spark):
    rows = spark.createDataFrame([(" TRUE", 0, ["a"]), ("maybe", 1, ["a"]), (None, None, []), ("unknown", None, ["a", "b"])], "answer string, i int, choices array<string>")
    assert [r.answer_idx for r in theory_rows(rows, "answer").collect()] == [0, 2]
    assert [r.answer_idx for r in choice_rows(rows, "choices", "i").collect()] == [0, 0]


def one_pass(rows, max_tokens, max_options):
    """(key, batch) of a single pass in order of length and key."""
    out, n, used, batch = [], 0, 0, -1
    for key, length, opts in sorted(((k, a or 0, b or 0) for k, a, b in rows), key=lambda r: (r[1], r[0])):
        if batch < 0 or -(-length // 64) * 64 * (n + 1) > max_tokens or used + opts > max_options:
            batch, n, used = batch + 1, 0, 0
        n, used = n + 1, used + opts
        out.append((key, batch))
    return sorted(out)


@pytest.mark.parametrize(("lengths", "options", "budget"), [(3000, 12, (16_384, 512)), (400, 3, (1000, 20)), (5, 1, (640, 7)), (1, 2, (64, 1_000_000)), (90, 40, (10**9, 30)), (200, 1, (256, 0)), (50, 60, (5000, 30))])
def test_greedy_batches_are_those_of_one_pass(spark, lengths, options, budget):
    rng = random.Random(lengths)
    rows = [(i, rng.choice([None, rng.randrange(lengths)]) if i % 9 == 0 else rng.randrange(lengths), rng.randrange(options)) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, n long, o long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges
    try:
        assert sorted(map(tuple, B.greedy_batches(df, "id", "n", "o", *budget).collect())) == one_pass(rows, *budget)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_greedy_batches_of_few_rows(spark):
    for rows in ([], [(5, 99, 99)], [(5, None, None), (6, None, None)]):
        df = spark.createDataFrame(rows, "id long, n long, o long")
        assert sorted(map(tuple, B.greedy_batches(df, "id", "n", "o", 64, 8).collect())) == one_pass(rows, 64, 8)
