"""The pivot join against a brute-force version on texts and union-find."""

import random
import re

import pytest

from quillon.llm import jaccard_join as J


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < i}:
            k = len(s & sets[j])
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(s), least.get(find(i), d)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def run(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, J.near_duplicates(docs, **kw).drop("_key").collect()), key=str)


def cluster(rng, size, words, edits):
    base = [f"w{rng.randrange(900)}" for _ in range(words)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed,frequent,more,lot,block", [(256, 16, 8, 256, 1 << 19), (10, 3, 2, 3, 200), (6, 2, 1, 1, 50), (5, 10**6, 8, 7, 1000)])
def test_matches_brute_force(spark, monkeypatch, seed, frequent, more, lot, block):
    for name, x in (("FREQUENT", frequent), ("MORE", more), ("LOT", lot), ("BLOCK_SHINGLES", block), ("OPEN_SHINGLES", block)):
        monkeypatch.setattr(J, name, x)
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = cluster(rng, 60, 80, 9) + cluster(rng, 12, 30, 3) + cluster(rng, 40, 45, 4)
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 40))) for _ in range(50)]
    texts += ["", None, "  \n", "one two", "ONE two", "one", "a b c d e", "a b c d e", "A b\tc\nd e f", "é É a b c d"] + ["same text of some seven words here"] * 30
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(7, texts[0]), (7, texts[0]), (None, texts[1]), (None, None)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_long_text_and_word(spark):
    long = " ".join(str(i % 5000) for i in range(200_000))
    rows = [(1, long), (2, long.replace("4999", "5000", 3)), (3, "y" * 700_000), (4, "y" * 700_000 + " z")]
    assert run(spark, rows) == brute(rows)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, J.near_duplicates(docs.withColumn("id", docs.n_chars)).drop("_key").collect()), key=str) == brute(rows)


def test_keep_one_has_the_same_columns(spark):
    docs = spark.createDataFrame([(2, "a b c d e f", 1), (1, "a b c d e f", 2), (3, None, 3)], "doc_id long, text string, s int")
    assert sorted(map(tuple, J.keep_one(docs).collect())) == [(1, "a b c d e f", 2), (3, None, 3)]


def test_links_come_from_cells(spark):
    """On a whole table every link is one to a pivot within the radius, which makes a Voronoi cell, or one found in a cell's window."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    n = {r.origin: r["count"] for r in J.set_links(docs).groupBy("origin").count().collect()}
    assert set(n) <= {"pivot", "window"} and sum(n.values()) > 100 and n["pivot"] > sum(n.values()) / 2


def test_windows_and_rounds(spark, monkeypatch):
    """Chains whose ends are in different cells, and sets that are far from the first pivots, need windows and later rounds."""
    rounds = []
    real = J._rounds
    monkeypatch.setattr(J, "_rounds", lambda *a: (rounds.append(o) or (o, x) for o, x in real(*a)))
    words = [f"w{i}" for i in range(100)]
    # neighbours differ by about a fifth of their shingles, so the ends of a chain share little
    chain = [" ".join(f"{w}x{i}" if j < 3 * i else w for j, w in enumerate(words)) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(chain)] + [(100 + i, " ".join(words[:40] + [f"y{i}z{j}" for j in range(60)])) for i in range(20)]
    assert run(spark, rows) == brute(rows)
    assert rounds.count("pivot") > 1
