"""Each stage of the pipeline held to what it must keep, over the whole small table."""

import collections
import re

import corpus_pipeline as P
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillon.llm import language_id, mixing
from quillon.llm.queries import MIX, WORD_BPE

from .test_jaccard_join import brute


def az(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {name: None for name, _ in P.STAGES}
    now = docs
    for name, stage in P.STAGES:
        now = stage(spark, now, sf).cache()
        rows[name] = now.collect()
        if name != "packing":
            assert now.columns == docs.columns
    start = docs.collect()

    known = {r.doc_id for r in language_id.predict(docs, language_id.fit(docs)).where("not rejected").collect()}
    assert {r.doc_id for r in rows["language_id"]} == known and len(known) >= 0.98 * len(start)

    last = {}
    for r in rows["language_id"]:
        last[az(r.text)] = max(last.get(az(r.text), -1), r.doc_id)
    assert {r.doc_id for r in rows["exact_dedup"]} == set(last.values())

    first = {d for d, _, c in brute([(r.doc_id, r.text) for r in rows["exact_dedup"]]) if d == c}
    assert {r.doc_id for r in rows["jaccard_join"]} == first

    # raking by hand over the cells
    cells = collections.Counter()
    of = {}
    for r in mixing.described(spark.createDataFrame(rows["jaccard_join"], docs.schema)).collect():
        of[r["_row"].doc_id] = (r["_source"], r["_lang"], r["_topic"])
        cells[of[r["_row"].doc_id]] += r["_tokens"]
    total = sum(cells.values())
    w = {k: v / total for k, v in cells.items()}
    want = []
    for i, target in enumerate((MIX.source, MIX.lang, MIX.topic)):
        own = collections.Counter()
        for k, v in w.items():
            own[k[i]] += v
        t = {k: (target.get(k, v) if isinstance(target, dict) else v**target) for k, v in own.items()}
        want.append({k: v / sum(t.values()) for k, v in t.items()})
    m = {k: MIX.budget * v for k, v in cells.items() if v}
    for _ in range(mixing.SWEEPS):
        for i, t in enumerate(want):
            for value, share in t.items():
                own = [k for k in m if k[i] == value]
                lo, hi = 0.0, 1e9
                for _ in range(200):  # the factor that gives the value its tokens, no cell above what it has
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if sum(min(cells[k], mid * m[k]) for k in own) < MIX.budget * total * share else (lo, mid)
                m.update({k: min(cells[k], hi * m[k]) for k in own})
    got = {r["_row"].doc_id: r["_p"] for r in mixing.with_probability(spark.createDataFrame(rows["jaccard_join"], docs.schema), MIX).collect()}
    assert all(abs(p - (m[of[d]] / cells[of[d]] if cells[of[d]] else 1)) < 1e-4 for d, p in got.items())
    assert abs(sum(got[d] * n for d, n in ((r["_row"].doc_id, r["_tokens"]) for r in mixing.described(spark.createDataFrame(rows["jaccard_join"], docs.schema)).collect())) / total - MIX.budget) < 0.01

    t = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    whole = collections.defaultdict(dict)
    for r in rows["packing"]:
        whole[r.doc_id][r.start] = r.ids
    assert {d: [x for k in sorted(v) for x in v[k]] for d, v in whole.items()} == {r.doc_id: t.encode(r.text, add_special_tokens=False).ids + [1] for r in rows["mixing"]}
    used = collections.Counter()
    for r in rows["packing"]:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and np.mean(list(used.values())) >= 0.95 * 2048
