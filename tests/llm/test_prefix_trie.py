"""The trie against plain Python: shared openings, turnless conversations, long ones in several levels, nulls, ties and repeats."""

import base64
import collections
import hashlib
import random
import zlib

import pytest

from quillon.llm import common, prefix_trie

KIND = "conv_id long, turn long, role string, text string, depth int, _conv string, _a int, _key string"
EMPTY = hashlib.sha256(b"").hexdigest()


def letter(t):
    return base64.b64encode(hashlib.sha256(f"{len(t[0])}:{t[0]}{t[1]}".encode()).digest())[:16]


def rem(c, n):
    return c - n * int(c / n)


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, letter((role or "", text or "")), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = (*own.get(c - rem(c, 100), [])[:h], *own[c][h:])
    members = collections.defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(full[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, "x", 6, "y") for r in rows], KIND).repartition(3)


def got(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = df.collect()
    spans = sorted((r.preorder, r.subtree_end, r.depth) for r in rows)
    assert [x[0] for x in spans] == list(range(len(rows)))  # numbers without gaps, subtrees nested
    for i, (at, end, depth) in enumerate(spans):
        assert all(d > depth for _, _, d in spans[i + 1 : end]) and (end == len(spans) or spans[end][2] <= depth)
    return sorted((tuple(r[n] for n in names) for r in rows), key=str)


def conversations(seed, n, longest, words=("a", "bb", "ccc")):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "bot"]), rng.choice(words)) for c in rng.sample(range(-250, 450), n) for t in range(rng.randrange(1, longest))]


@pytest.mark.parametrize("limits", [(32, 4096, 8192, 100_000), (2, 4, 3, 0)])
def test_trie(spark, monkeypatch, limits):
    for name, x in zip(("BLOCK", "CHUNK", "PIECE"), limits):
        monkeypatch.setattr(prefix_trie, name, x)
    monkeypatch.setattr(common, "BROADCAST_ROWS", limits[-1])
    rows = conversations(1, 60, 9) + [(0, t, "user", "a") for t in range(12)]
    rows += [(c, t, "user", f"{t % 3}" * 4) for c in (700, 701, 702, 703) for t in range(19)]  # whole copies
    rows += [(800, 0, "user", "x")] * 5 + [(801, None, None, None), (801, None, "u", None), (801, 1, None, ""), (None, 3, "user", "no conversation")]
    assert got(prefix_trie.trie(table(spark, rows))) == brute(rows)


def test_turnless_and_absent_base(spark):
    # a conversation all of whose turns are its opening, with and without a base to take them from
    short = next(c for c in range(501, 599) if zlib.crc32(str(c).encode()) % 6 >= 3)
    rows = [(short, 0, "user", "a"), (short, 1, "bot", "b")]
    assert brute(rows) == [(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]
    for more in ([], [(500, 0, "user", "q")], [(-100, 0, "user", "q"), (-199, 0, "user", "q")]):
        assert got(prefix_trie.trie(table(spark, rows + more))) == brute(rows + more)


def test_long_texts_and_levels(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    long = "long text " * 100_000
    rows = [(c, t, "user", long if t == 40 else "same") for c in (0, 100, 200) for t in range(70 + c // 100)]
    assert got(prefix_trie.trie(table(spark, rows))) == brute(rows)


def test_empty(spark):
    for rows in ([], [(None, 1, "user", "x")]):
        assert not prefix_trie.trie(table(spark, rows)).collect()
