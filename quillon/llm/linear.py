"""Hashed n-gram features and linear models trained in numpy, shared by the text classifiers.

Only the training sample is bounded: at most so many labelled rows of each
class, of texts up to so many bytes each and about so many bytes in all, chosen
by hashed id. Scoring covers every row and whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_bounds, held_out, mix, windows, word_hashes

MAX_TRAINING_BYTES = 1 << 16
#: Bytes of texts in a training sample, about, over all labels.
MAX_SAMPLE_BYTES = 24 << 20
_U = np.uint64
_CHAR = np.random.default_rng(99).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_CHAR_FOLDED = _CHAR.copy()
_CHAR_FOLDED[65:91] = _CHAR[97:123]
for _s in (9, 10, 11, 12, 13):
    _CHAR_FOLDED[_s] = _CHAR_FOLDED[32]


def gram_buckets(text: bytes, sizes: tuple[int, ...], words: int, bits: int, fold: bool = False) -> Iterator[np.ndarray]:
    """Buckets of all byte n-grams of the sizes and of all runs of up to `words` words, in blocks of the text.

    fold: byte n-grams take A-Z as a-z and white space as a space. Blocks bound the memory of a long text; grams across their borders are not lost.
    """
    char, before = _CHAR_FOLDED if fold else _CHAR, np.empty(0, np.uint64)
    for i, j in block_bounds(text):
        a = char[np.frombuffer(text[i : j + max(sizes) - 1], np.uint8)]
        hashes = [mix(windows(a[: j - i + n - 1], n) ^ _U(n)) for n in sizes]
        own = word_hashes(text[i:j])
        hashes.append(own)
        for n in range(2, words + 1):
            hashes.append(windows(np.concatenate([before[max(0, len(before) - n + 1) :], own]), n))
        before = np.concatenate([before, own])[-max(1, words - 1) :]
        yield (np.concatenate(hashes) >> _U(64 - bits)).astype(np.int32)


def mean_score(table: np.ndarray, blocks: Iterator[np.ndarray]) -> tuple[np.ndarray, int]:
    """Sum of the table's entries over all buckets, and the number of buckets."""
    total, n = np.zeros(table.shape[1:], np.float64), 0
    for b in blocks:
        total += table.take(b, axis=0).sum(axis=0, dtype=np.float64)
        n += len(b)
    return total, n


def training_rows(docs: DataFrame, label: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """(y, t) by hashed id, of somewhat more than `limit` rows of each label value outside the held-out fifth, in one part; None without a label.

    The rate for each label comes from its count over all rows; the number of label values is bounded by 1000.
    """
    rows = docs.where(F.col(label).isNotNull() & ~held_out(id_col) & F.col(id_col).isNotNull() & (F.octet_length(text_col) <= MAX_TRAINING_BYTES))
    sizes = rows.groupBy(label).agg(F.count("*").alias("n"), F.sum(F.octet_length(text_col)).alias("bytes"))
    counts = {r[0]: (r[1], r[2]) for r in sizes.orderBy(F.desc("n"), label).limit(1000).collect()}
    if not counts:
        return None
    u = F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    share = MAX_SAMPLE_BYTES / len(counts)
    rates = F.create_map(*(F.lit(x) for k, (n, size) in counts.items() for x in (k, min(1.0, 1.3 * limit / n, share / max(size, 1)))))
    picked = rows.where(u < F.try_element_at(rates, F.col(label)))
    got = picked.select(F.col(label).alias("y"), F.col(text_col).alias("t"), u.alias("u"), F.col(id_col).alias("i"))
    return got.orderBy("u", "i").limit(int(1.3 * limit * len(counts)) + 1).select("y", "t")


def first_of_each(labels: list, limit: int) -> list[int]:
    """Places of the first `limit` of each label."""
    taken: Counter = Counter()
    out = []
    for k, y in enumerate(labels):
        taken[y] += 1
        if taken[y] <= limit:
            out.append(k)
    return out


def training_sample(docs: DataFrame, label: str, limit: int, id_col: str = "doc_id", text_col: str = "text"):
    """(texts, labels) of at most `limit` rows of each label value outside the held-out fifth, see `training_rows`."""
    rows = training_rows(docs, label, limit, id_col, text_col)
    if rows is None:
        return [], []
    got = rows.toPandas()
    labels, texts = got.y.tolist(), got.t.tolist()
    of = first_of_each(labels, limit)
    return [texts[k].encode() for k in of], [labels[k] for k in of]


def sparse(rows: Iterable[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each row with their share; of an iterator one row at a time is held whole."""
    out = []
    for r in rows:
        i, n = np.unique(r, return_counts=True)
        out.append((i.astype(np.int32), (n / max(1, len(r))).astype(np.float32)))
    return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that calibrate scores, by Newton's method with smoothed targets."""
    z, y = np.asarray(z, float), np.asarray(y, float)
    up, down = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        w = p * (1 - p) + 1e-9
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, epochs: int = 12, rate: float = 0.5, scale: float = 40.0):
    """Weights and bias by AdaGrad; class weights balance the two labels. Logit: bias + scale * mean weight."""
    w, g2, b, gb = np.zeros(size, np.float32), np.full(size, 1e-6, np.float32), 0.0, 1e-6
    weight = np.where(y > 0, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
    order = np.arange(len(rows))
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        rng.shuffle(order)
        for k in order:
            i, x = rows[k]
            e = weight[k] * (sigmoid(b + scale * float(w[i] @ x)) - y[k])
            d = (e * scale) * x + 1e-6 * w[i]
            g2[i] += d * d
            w[i] -= rate * 0.1 * d / np.sqrt(g2[i])
            gb += e * e
            b -= rate * 0.1 * e / np.sqrt(gb)
    return w, float(b)
