"""Toxicity by a lexicon trie intersected with Levenshtein automata, and scores of the context of each hit.

The lexicon (words, and stems that accept any ending) is learned from labelled
rows: terms far likelier in toxic than in other texts. A word of a text is
looked up by walking the trie along the word's Levenshtein automaton of
distance 1, or with two neighbours swapped; a hit is a term, a stem or a
misspelling, which may have a digit or mark inside. The window around a hit
tells quotation (a pair of quotation marks, words of saying) from abuse. A logistic
regression over the hits of each kind, fit on a bounded labelled sample and
calibrated by its own likelihood, gives the score.

Nothing but the text is an input of a score. Null and empty texts have no hits
and get the score of such texts. Without labelled rows of both kinds every
score is 0. Repeated rows score alike; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_scan, utf8
from .linear import sigmoid, training_sample
from .quality import label_rows, labelled

SAMPLE_PER_LABEL = 4000
LEAST_TEXTS, LEAST_ODDS = 6, 8.0  # the odds by their lower bound, two standard errors down
STEM, WORD = (5, 9), (3, 24)
FUZZY_FROM, GUARDED_FROM = 5, 4  # terms of four letters only where innocent words are known
#: Words on each side of a hit that are its context, and characters in which they are looked for; characters of a text taken at once.
SPAN, REACH, PART = 6, 240, 1 << 16
_space = regex.compile(r"\s").search
MEMO = 400_000
_words = regex.compile(r"[^\W\d_]+")
_mark = regex.compile(r"[^\W\d_][^\s\p{L}\p{M}][^\W\d_]").search  # what any of the next has inside
_joined = regex.compile(r"(?<![^\W\d_])(?=([^\W\d_]++[^\s\p{L}\p{M}][^\W\d_]++))[^\W\d_]++")  # two runs of letters and the mark or digit between

# fixed values: words of saying and marks of quotation
SAYING = {"said", "says", "called", "word", "term", "quote", "quoted", "wrote", "dit", "mot", "terme", "sagte", "wort", "dijo", "palabra"}
QUOTES = "\"“”„«»"


class LevenshteinAutomaton:
    """Deterministic states for one word: the row of edit distances, cut off above the limit."""

    def __init__(self, word: str, limit: int):
        self.word, self.limit = word, limit

    def start(self) -> tuple[int, ...]:
        return tuple(min(i, self.limit + 1) for i in range(len(self.word) + 1))

    def step(self, state: tuple[int, ...], char: str) -> tuple[int, ...]:
        row = [min(state[0] + 1, self.limit + 1)]
        for i, c in enumerate(self.word):
            row.append(min(row[i] + 1, state[i] + (c != char), state[i + 1] + 1, self.limit + 1))
        return tuple(row)

    def accepts(self, state: tuple[int, ...]) -> bool:
        return state[-1] <= self.limit

    def alive(self, state: tuple[int, ...]) -> bool:
        return min(state) <= self.limit


class Trie:
    """Terms as nested dictionaries; the empty key holds the term that ends there."""

    def __init__(self, terms):
        self.root: dict = {}
        for t in terms:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t

    def within(self, automaton: LevenshteinAutomaton) -> Iterator[str]:
        stack = [(self.root, automaton.start())]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c == "":
                    if automaton.accepts(state):
                        yield child
                elif automaton.alive(after := automaton.step(state, c)):
                    stack.append((child, after))

    def stem_of(self, word: str) -> str | None:
        node = self.root
        for c in word:
            if "" in node:
                return node[""]
            node = node.get(c)
            if node is None:
                return None
        return node.get("")


def _by_length(parts) -> list[tuple[int, set[str]]]:
    out: dict[int, set[str]] = {}
    for x in parts:
        out.setdefault(len(x), set()).add(x)
    return sorted(out.items())


@dataclass
class Lexicon:
    words: dict[str, float]  # with the logarithm of their odds
    stems: dict[str, float]
    innocent: frozenset[str] | None = None  # words near a term that clean texts hold; None if not known
    memo: dict = field(default_factory=dict)

    def __post_init__(self):
        self.trie, self.stem_trie = Trie(self.words), Trie(self.stems)
        self.fuzzy_from = FUZZY_FROM if self.innocent is None else GUARDED_FROM
        long = [t for t in self.words if len(t) >= self.fuzzy_from]
        self.lengths = {len(t) for t in long}
        # one edit leaves the first or the last half of a term as it is
        self.heads, self.tails = _by_length(t[: len(t) // 2] for t in long), _by_length(t[len(t) // 2 :] for t in long)

    def __getstate__(self):
        return {"words": self.words, "stems": self.stems, "innocent": self.innocent}

    def __setstate__(self, state):
        self.__init__(**state)

    def kind(self, word: str) -> tuple[int, float]:
        """0 none, 1 term, 2 stem, 3 misspelt term; and how strong."""
        k = self.memo.get(word)
        if k is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            k = self.memo[word] = self._kind(word)
        return k

    def _kind(self, word: str) -> tuple[int, float]:
        if word in self.words:
            return 1, self.words[word]
        if stem := self.stem_trie.stem_of(word):
            return 2, self.stems[stem]
        if len(word) >= self.fuzzy_from - 1 and word not in (self.innocent or ()):
            near = self._swapped(word)
            if self._half_fits(word):
                near += [self.words[t] for t in self.trie.within(LevenshteinAutomaton(word, 1)) if len(t) >= self.fuzzy_from]
            if near:
                return 3, max(near)
        return 0, 0.0

    def _half_fits(self, word: str) -> bool:
        return any(word[:n] in h for n, h in self.heads) or any(word[-n:] in t for n, t in self.tails)

    def _swapped(self, word: str) -> list[float]:
        """Strengths of the terms that two swapped neighbours make of the word."""
        if len(word) not in self.lengths:
            return []
        others = (word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1))
        return [self.words[t] for t in others if t in self.words]

    def _hits(self, low: str, a: int, b: int) -> tuple[int, list[tuple[int, int, tuple[int, float], str]]]:
        """Number of words from a to b, and the hits there: (start, end, kind and strength, what was found)."""
        found = _words.findall(low, a, b)
        kinds = {w: k for w in set(found) if (k := self.kind(w))[0]}
        marked = {w: k for w in set(_joined.findall(low, a, b)) if (k := self.kind(w))[0] == 3} if _mark(low, a, b) else {}
        if not kinds and not marked:
            return len(found), []
        spans = [m.span() for m in _words.finditer(low, a, b)]
        hits = [(*spans[i], kinds[w], w) for i, w in enumerate(found) if w in kinds]
        if marked:  # misspelt terms with a digit or mark inside, where neither half is a hit
            for i, ((x, y), (u, v)) in enumerate(zip(spans, spans[1:])):
                if u == y + 1 and (k := marked.get(low[x:v])) and found[i] not in kinds and found[i + 1] not in kinds:
                    hits.append((x, v, k, low[x:v]))
        return len(found), hits

    def found(self, text: str) -> tuple[list[float], float, list[tuple[int, float]]]:
        """Strength of hits by kind and context, their density, and kind and strength of the different ones."""
        low = text.lower()
        out, words, places, different = [0.0] * 6, 0, 0, {}
        for a, b in _parts(low):
            n, hits = self._hits(low, a, b)
            words += n
            places += len(hits)
            for start, end, (k, strength), what in hits:
                out[k - 1 + 3 * self._cited(low, start, end)] += strength
                different[what] = (k, strength)
        return out, min(1.0, 20 * places / words) if places else 0.0, list(different.values())

    def features(self, text: str, as_terms: bool = False) -> list[float]:
        """Nine numbers of what is found, see `numbers`."""
        return numbers(*self.found(text), as_terms)

    @staticmethod
    def _cited(low: str, start: int, end: int) -> bool:
        """Whether the window of SPAN words around a hit has a word of saying, or puts the hit between an opening and a closing mark.

        A mark opens if it begins a word, and closes if it ends one, so a mark of inches or one far away cites nothing.
        """
        lo, hi = max(0, start - REACH), min(len(low), end + REACH)
        before, after = [*_words.finditer(low, lo, start)][-SPAN:], [*islice(_words.finditer(low, end, hi), SPAN)]
        if not SAYING.isdisjoint([m[0] for m in before + after]):
            return True
        if before:
            lo = max(0, before[0].start() - 2)
        if after:
            hi = min(len(low), after[-1].end() + 2)
        left = max(low.rfind(q, lo, start) for q in QUOTES)
        right = min((k for q in QUOTES if (k := low.find(q, end, hi)) >= 0), default=-1)
        if left < 0 or right < 0:
            return False
        opens = left == 0 or low[left - 1].isspace() or low[left - 1] in "([{"
        return opens and (low[right] in "”»" or not low[right - 1].isspace())


def numbers(by_kind: list[float], density: float, different: list[tuple[int, float]], as_terms: bool = False) -> list[float]:
    """Logarithms of the strength by kind and context, the density, and the sum and maximum over different terms; as_terms: misspelt terms count as terms."""
    if as_terms:
        by_kind = [by_kind[0] + by_kind[2], by_kind[1], 0.0, by_kind[3] + by_kind[5], by_kind[4], 0.0]
    terms = [strength for k, strength in different if k < 3 or as_terms]
    return [*np.log1p(by_kind), density, sum(terms) / 4, float(max(terms, default=0))]


def _parts(low: str) -> Iterator[tuple[int, int]]:
    """Parts of a long text that end after white space, so that no list of all its words is held."""
    a = 0
    while a < len(low):
        m = _space(low, a + PART) if a + PART < len(low) else None
        b = m.end() if m else len(low)
        yield a, b
        a = b


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float
    as_terms: bool = False  # too few labelled texts hold misspelt terms to weigh these by themselves

    def score(self, text: str) -> float:
        return float(sigmoid(self.bias + float(self.weights @ np.array(self.lexicon.features(text, self.as_terms)))))


def learn_lexicon(texts: list[str], y: np.ndarray) -> Lexicon:
    """Terms and stems by the odds of the texts that hold them."""
    toxic, other, ends = Counter(), Counter(), {}
    for t, label in zip(texts, y):
        w = {x for x in _words.findall(t.lower()) if WORD[0] <= len(x) <= WORD[1]}
        (toxic if label else other).update(w)
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    clean = set(other).union(*(_joined.findall(t.lower()) for t, label in zip(texts, y) if not label))
    for counts in (toxic, other):  # a stem is found as often as its words together
        for w, k in list(counts.items()):
            for n in range(STEM[0], min(STEM[1] + 1, len(w))):
                counts[w[:n] + "*"] += k
                if counts is toxic:
                    ends.setdefault(w[:n], set()).add(w)
    odds = {t: ((k + 0.5) / (n1 + 1)) / ((other[t] + 0.5) / (n0 + 1)) for t, k in toxic.items() if k >= LEAST_TEXTS}
    low = {t: np.log(o) - 2 * np.sqrt(1 / (toxic[t] + 0.5) + 1 / (other[t] + 0.5)) for t, o in odds.items()}
    good = {t for t, o in low.items() if o >= np.log(LEAST_ODDS)}
    words = {t for t in good if not t.endswith("*")}
    stems = {t[:-1] for t in good if t.endswith("*") and len(ends[t[:-1]]) >= 3}  # one word with its ending is that word
    stems = {s for s in stems if not any(s[:n] in stems for n in range(STEM[0], len(s)))}
    strength = lambda t: float(np.log(odds[t]))
    lexicon = Lexicon({w: strength(w) for w in sorted(words)}, {s: strength(s + "*") for s in sorted(stems)}, frozenset())
    return Lexicon(lexicon.words, lexicon.stems, frozenset(w for w in clean if lexicon.kind(w)[0] == 3))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> ToxicityModel | None:
    rows = labelled(docs, labels, label, per_label, id_col, text_col)
    texts, y = training_sample(rows, "_y", per_label, "_id", "_text")
    y = np.array(y, float)
    if len(set(y)) < 2:
        return None
    texts = [t.decode() for t in texts]
    lexicon = learn_lexicon(texts, y)
    found = [lexicon.found(t) for t in texts]
    as_terms = sum(f[0][2] + f[0][5] > 0 and label > 0 for f, label in zip(found, y)) < LEAST_TEXTS
    x = np.array([numbers(*f, as_terms) for f in found])
    x1, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([0.5] * x.shape[1] + [1e-6])
    for _ in range(40):  # Newton's method with a small penalty
        p = sigmoid(x1 @ w)
        step = np.linalg.solve(x1.T @ (x1 * (p * (1 - p) + 1e-9)[:, None]) + ridge, x1.T @ (p - y) + ridge @ w)
        w -= step
        if abs(step).max() < 1e-8:
            break
    # the sample holds more of the rarer label than there is; the bias goes back to the labels' own shares
    all_y = {r[0]: r[1] for r in label_rows(labels, label, id_col).groupBy("_y").count().collect()}
    prior = np.log(all_y[1] / all_y[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return ToxicityModel(lexicon, w[:-1], float(w[-1] + prior), as_terms)


def scores(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = [m.score(t.decode()) if m else 0.0 for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], [id_col, "score"])

    return arrow_scan(docs.select(F.col(id_col), F.col(text_col).cast("string")), scan, f"`{id_col}` {kind}, score double")
