"""Quality rules and a hashed word and character n-gram logistic regression.

The base rules count whole texts. The model is trained on a bounded sample of
labelled rows (see `linear`), its probabilities are calibrated on rows left
out of the training and corrected to the labels' shares in all rows, so they
do not depend on how much of the table the sample holds, and every row is scored in Arrow batches against a fixed
threshold. The broadcast model has a fixed size.

Words are runs of anything but ASCII white space. Null texts have no words and
fail the base rules. Repeated rows are judged alike; without labelled rows the
base rules alone decide; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, among, arrow_scan, distinct, held_out, maybe_broadcast, utf8, windows, word_bounds, word_hashes
from .linear import gram_buckets, logistic, mean_score, platt, sigmoid, sparse, training_sample

BITS = 18
SCALE = 40.0
SAMPLE_PER_LABEL = 2000
KEEP_FROM = 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    intercept: float

    def probability(self, text: bytes) -> float:
        total, n = mean_score(self.weights, features(text))
        z = self.bias + (SCALE * float(total) / n if n else 0.0)
        return float(sigmoid(self.slope * z + self.intercept))


def features(text: bytes) -> Iterator[np.ndarray]:
    return gram_buckets(text, (2, 3, 4), 2, BITS)


def rule_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    a = np.frombuffer(text, np.uint8)
    start, _ = word_bounds(a)
    n = len(start)
    chars = int(((a & 0xC0) != 0x80).sum() - SPACE[a].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    return n, chars, int(SYMBOLS[a].sum()), len(lines) - len(set(lines)), _repeated(text, n)


def _repeated(text: bytes, n: int, size: int = 8) -> int:
    """Words inside windows of `size` words that occur twice or more; here case counts."""
    if n <= size:
        return 0
    h = windows(word_hashes(text, fold=False), size)
    s = np.sort(h)
    again = distinct(s[1:][s[1:] == s[:-1]])
    if not len(again):
        return 0
    twice = np.flatnonzero(among(h, again))
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + size, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> QualityModel | None:
    """Learns from labelled rows outside the held-out fifth; None if a label is missing."""
    rows = labelled(docs, labels, label, per_label, id_col, text_col)
    texts, y = training_sample(rows, "_y", per_label, "_id", "_text")
    y = np.array(y, float)
    if len(set(y)) < 2:
        return None
    x = sparse([np.concatenate([np.empty(0, np.int32), *features(t)]) for t in texts])
    left = np.arange(len(x)) % 5 == 4
    w, b = logistic([r for r, s in zip(x, left) if not s], y[~left], 1 << BITS, scale=SCALE)
    z = np.array([b + SCALE * float(w[i] @ v) for i, v in (r for r, s in zip(x, left) if s)])
    a, c = platt(z, y[left])
    # the left-out fifth holds the labels at the sample's shares; the intercept goes back to the labels' own
    share = {r[0]: r[1] for r in label_rows(labels, label, id_col).groupBy("_y").count().limit(1000).collect()}
    up = y[left].sum()
    prior = np.log(share[1] / share[0]) - np.log((up + 1) / (left.sum() - up + 1))
    return QualityModel(w, b, a, float(c + prior))


def label_rows(labels: DataFrame, label: str, id_col: str) -> DataFrame:
    """(_id, _y): the label, 0 or 1, of each id outside the held-out fifth; other values are no labels."""
    y = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    return y.where(~held_out("_id")).groupBy("_id").agg(F.min("_y").alias("_y"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_label: int, id_col: str, text_col: str) -> DataFrame:
    """Texts of a bounded number of labelled ids; the ids are few, so the texts stay where they are read."""
    y = label_rows(labels, label, id_col)
    counts = {r[0]: r[1] for r in y.groupBy("_y").count().limit(1000).collect()}
    u = F.pmod(F.xxhash64(F.lit(17), F.col("_id")), F.lit(1 << 30)) / float(1 << 30)
    if counts:
        rates = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.6 * per_label / n))))
        y = y.where(u < F.try_element_at(rates, F.col("_y")))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return texts.join(maybe_broadcast(y, 100_000), "_id")


def judge(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """Counts, base_failed, probability and kept of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "probability"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            counts, p = [], []
            for text in utf8(b.column(1)):
                counts.append(rule_counts(text))
                p.append(m.probability(text) if m else 1.0)
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array(p, pa.float64())], names)

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    out = arrow_scan(rows, scan, f"`{id_col}` {kind}, " + ", ".join(f"{c} bigint" for c in names[1:6]) + ", probability double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("probability") >= keep_from))
