"""Cases of the third round's findings."""

import os

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon import plans
from quillon.llm import common, jaccard_join, language_id, linear, packing
from quillon.operators import blind as M
from quillon.operators import calibration as C
from quillon.operators import crossfit as X
from quillon.plans import models

from .oracle import compare


def test_twentieth_of_scored_rows(spark, sf, tmp_path):
    """rows without a word have no score and do not count; of 40 labelled rows 20 have words, so one row is a twentieth."""
    for name in os.listdir(sf):
        if name not in ("documents.parquet", "labels.parquet"):
            os.symlink(f"{sf}/{name}", tmp_path / name)
    con = duckdb.connect()
    text = "case when i % 2 = 0 then 'a 1' when i % 4 = 1 then 'good word number' || i else 'poor word' end"
    con.sql(f"copy (select i as doc_id, {text} as text, 'en' as lang, 's' as source, 9 as n_chars from range(40) r(i)) to '{tmp_path}/documents.parquet'")
    con.sql(f"copy (select i as doc_id, 1::int as quality, (i % 4 = 1)::int as toxic from range(40) r(i)) to '{tmp_path}/labels.parquet'")
    assert plans.QUERIES["predictable_rows"](spark, str(tmp_path)).count() == 1
    compare(spark, str(tmp_path), plans.QUERIES["predictable_rows"], plans.ORACLES["predictable_rows"])


def test_resamples_are_drawn_for_each_row(spark):
    """every row has its own number in every resample; before, all rows of a value had one number."""
    rows = spark.range(30).select("id", (F.col("id") % 2).alias("v"))
    got = {r.b: r.mean for r in C.resampled_means(rows, "id", "v", "s", 50).collect()}
    con = duckdb.connect()
    u = "('0x'||substr(md5('s|'||b||'|'||i),1,12))::ubigint::double/281474976710656.0"
    k = " + ".join(f"(u >= {t!r})::int" for t in C.POISSON)
    want = dict(con.sql(f"select b, sum(({k})*(i%2))/sum({k}) from (select b, i, {u} as u from range(30) r(i), range(50) s(b)) group by b").fetchall())
    assert got == pytest.approx(want)
    assert "range(2000) x(b)" in plans.ORACLES["bootstrap_interval"] and "'|'||(vec_id)" in plans.ORACLES["bootstrap_interval"]


def test_words_are_split_once(spark):
    """the words of a text are made once for its terms; before, once for each time they were named."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = spark.createDataFrame([("a b",)], "t string").select(X.hashed_terms(F.col("t")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("split(") == 1


def test_batch_of_a_slice():
    """rows without terms and slices of batches keep their own numbers."""
    terms = [[1, 2], [], [3]]
    at, value = X._bytes(X.np.int32([1, 2, 3]), X.np.array([2, 0, 1])), X._bytes(X.np.float32([1, 2, 4]), X.np.array([2, 0, 1]))
    dense = X._bytes(X.np.empty(0), X.np.zeros(3, int))
    rb = pa.RecordBatch.from_arrays([pa.array([0, 1, 1], pa.int32()), pa.array([1.0] * 3), pa.array([[0], [1], [2]]), at, value, dense], ["_y", "_w", "_folds", "_at", "_value", "_dense"])
    for i in range(3):
        b = X._Batch(rb.slice(i))
        assert b.at.tolist() == sum(terms[i:], []) and b.folds[:, 0].tolist() == [0, 1, 2][i:] and b.dense.shape == (3 - i, 0)
        assert b.by_row(b.value).tolist() == [3.0, 0.0, 4.0][i:]


def test_only_asked_terms_make_rows(spark):
    """terms are kept by bucket before they become rows; before, every term of every text became one."""
    df = spark.createDataFrame([(i, "good fine" if i % 2 else "bad poor", float(i % 2)) for i in range(40)], "_id long, text string, y double")
    out = M.named_terms(df, M.View("text", M.text_stages), "y", 1)
    assert out.count() == 2
    assert " IN (" in out._jdf.queryExecution().analyzed().toString().upper()


def test_memo_is_asked_and_not_walked(monkeypatch):
    """op7: new words are told by lookups; before, every block of texts walked through all that the memos held."""

    class Asked(packing.Memo):
        def __iter__(self):
            raise AssertionError("the memo was walked")

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [b"some words, some more", b"a word at last", b"Some w\xc3\xb6rds, 12 more"]
    want = [b for t in texts for b in packing.WordIds(path).encode([t])]
    monkeypatch.setattr(packing, "Memo", Asked)
    assert packing.WordIds(path).encode(texts) == want


def test_rounds_leave_links_only(spark, sf, monkeypatch):
    """op3: when the links are known, only they are left in the shared folder; before, every set and what each round made stayed to the session's end."""
    tables = []
    monkeypatch.setattr(jaccard_join, "stored", lambda df, **k: tables.append(common.stored(df, **k)) or tables[-1])
    links = jaccard_join.set_links(spark.read.parquet(f"{sf}/documents.parquet"))
    left = [t.columns for t in tables if os.path.exists(t._folder.removeprefix("file:"))]
    assert len(tables) > len(left) and all(c in (["pivot", "id", "n", "d", "near"], ["a", "b"]) for c in left)
    assert links.count() > 0


def test_features_are_made_once(spark, monkeypatch):
    """rounds read the features of the first rows, without those that went; before, each round made them anew."""
    df = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} w{i % 7}", float(i % 2)) for i in range(120)], "_id long, text string, y double")
    made, views = [], [M.View("text", M.text_stages), M.View("length", M.length_stages)]
    real = X.counted
    monkeypatch.setattr(X, "counted", lambda x: made.append(1) or real(x))
    kept, report = M.aflite(df, views, "y", 0.5, rounds=2, folds=2, partitions=1, min_rows=20)
    assert len(made) == 2 and [r["n"] for r in report] == [120, 114] and kept.count() == 109
    rows = [df.where("_id > 5"), M.features_of(df, views, "y")]
    gone = df.where("_id <= 5").select("_id")
    one, two = (M.cross_fit(rows[0], views, "y", "s", 2, 1, features=f) for f in (None, [x.join(gone, "_id", "left_anti") for x in rows[1]]))
    assert sorted((r._id, r.hits, round(r.p, 9)) for r in one.collect()) == sorted((r._id, r.hits, round(r.p, 9)) for r in two.collect())


def test_language_model_is_trained_in_a_task(spark, sf, monkeypatch):
    """pipeline, op10: the driver gets the model alone; before, the sample's texts and the buckets of all of them were the driver's."""

    def refused(*a, **k):
        raise AssertionError("on the driver")

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts, labels = linear.training_sample(docs, "lang", 50)
    want = language_id._trained(texts, labels)
    monkeypatch.setattr(linear, "training_sample", refused)
    monkeypatch.setattr(DataFrame, "toPandas", refused)
    got = language_id.fit(docs, per_language=50)
    assert got.languages == want.languages and (got.table == want.table).all() and (got.bias == want.bias).all()
    assert (got.temperature, got.threshold, got.usual) == (want.temperature, want.threshold, want.usual)
    assert language_id.fit(docs.where("false")) is None


def test_audit_takes_words_once(spark, sf, monkeypatch):
    """F8: the words and the lengths of all texts are taken once, for weights, models and what these are asked; before, for each of them anew. Same models as of separate fits."""
    made, real = [], X.counted
    rows = models._by_language(spark, sf)
    train, others = rows.where("split = 'train'"), rows.where("split <> 'train'")
    views = [models.TEXT, models.LENGTH]
    weighted = M.weighted_by_views(train, models.VIEWS_OF, "y", folds=models.FOLDS)
    want = {}
    for name, w in (("acc", None), ("acc_weighted", "bias_w")):
        for r in M.refit(weighted, others, views, "y", w).groupBy("_view").agg(F.avg("_right").alias("a")).collect():
            want[r["_view"], name] = round(r.a, 6)
    monkeypatch.setattr(X, "counted", lambda x: made.append(1) or real(x))
    got = plans.QUERIES["weighted_audit"](spark, sf).collect()
    assert len(made) == 2
    assert {(r["view"], c): r[c] for r in got for c in ("acc", "acc_weighted")} == want
