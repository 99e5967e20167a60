"""Toxic texts whose only terms are misspelt, through scores()."""

import random

from quillon.llm import toxicity


def test_misspelt_terms_score_as_terms(spark):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in ("mar", "tol", "ven") for b in "aeiou" for c in ("n", "dek", "riv", "stop")]
    text = lambda *more: " ".join([*rng.choices(words, k=30), *more, *rng.choices(words, k=10)])
    rows = [(text(("idiot", "scum", "stupid", "moron")[i % 4]), 1) for i in range(160)] + [(text(rng.choice(["scam", "sum", "stop", "it's"])), 0) for _ in range(600)]
    learn = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, toxic int")
    model = toxicity.fit(learn, learn.select("doc_id", "toxic"))
    assert {"idiot", "scum", "stupid", "moron"} <= set(model.lexicon.words)
    bad = ["id1ot", "st*pid", "mor0n", "idoit", "scumm", "sc*m", "sucm", "skum", "1diot", "stupdi"]
    fine = ["scam", "sum", "it's", "stop!now", "well-known", ""]
    docs = spark.createDataFrame([(i, text(w)) for i, w in enumerate([*bad, *fine])], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect()}
    least, most = min(got[i] for i in range(len(bad))), max(got[len(bad) + i] for i in range(len(fine)))
    assert least > 0.5 > most, got


def test_marks_inside_words():
    lexicon = toxicity.Lexicon({"scum": 3.0, "idiot": 3.0}, {}, frozenset({"scam"}))
    kinds = {w: lexicon.kind(w)[0] for w in ("scum", "scumm", "skum", "scm", "sucm", "sc*m", "scam", "idoit", "iditos", "su")}
    assert kinds == {"scum": 1, "scumm": 3, "skum": 3, "scm": 3, "sucm": 3, "sc*m": 3, "scam": 0, "idoit": 3, "iditos": 0, "su": 0}
    assert lexicon.features("so id1ot goes")[2] > 0 and lexicon.features("so id10t goes")[2] == 0
    assert lexicon.features('they said "id1ot" then')[5] > 0
    assert lexicon.features("idiot's")[:3] == lexicon.features("idiot s")[:3]
