"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are byte n-grams of the folded text and whole words, hashed to
buckets. Embeddings and output layer are trained by stochastic gradient
descent in numpy, in one task, on a bounded sample of labelled rows (see
`linear`); a fifth of the sample is left out to fit a temperature and the rejection threshold.
The trained product of embedding and output is one row of scores per bucket,
sent to the tasks as a broadcast of fixed size.

Every row gets a learned language; a text that is null or has no letter gets
`und` and score 0. Rows below the threshold are marked rejected: the threshold
is the score that all but a small share of the rightly told left-out rows
reach, one half at most, so clean rows stay, and above an even share. A text
whose subwords are so rare in the sample that they lie nearer to subwords drawn
at random than to those of the least usual left-out row, by three to one, is
rejected too: it is of no learned language, whatever the softmax makes of it;
numbers, names and code in a known language do not go that far. With no labelled rows nothing can be learned:
every row is `und` and none is rejected. An empty table gives an empty result. Repeated rows are scored alike; extra columns are not
read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_scan, utf8
from .linear import first_of_each, gram_buckets, mean_score, sparse, training_rows

BITS, DIM, EPOCHS = 16, 16, 6
SAMPLE_PER_LANGUAGE = 800
#: The left-out part of the sample; the share of its rightly told rows that may lie below the threshold; and even shares that the threshold is at least.
LEFT_OUT, REJECT_SHARE, EVEN_SHARES = 5, 0.002, 1.2
#: How far from the least usual left-out row towards subwords drawn at random a text must lie to be of no learned language.
UNLIKE = 0.75
UNKNOWN = "und"
_letter = regex.compile(r"\p{L}").search


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # (2^bits, languages + 1): embedding times output layer, and the logarithm of the bucket's share in the sample
    bias: np.ndarray
    temperature: float
    threshold: float
    usual: float  # the mean of the last column that a text of a learned language has at least

    def judged(self, text: bytes) -> tuple[np.ndarray, bool]:
        """Probabilities of the languages, and whether the text is rejected."""
        total, n = mean_score(self.table, features(text))
        z = total[:-1] / n + self.bias
        z = np.exp((z - z.max()) / self.temperature)
        p = z / z.sum()
        return p, bool(p.max() < self.threshold or total[-1] / n < self.usual)


def features(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of all subwords of a text, in blocks; each side is padded by a space."""
    return gram_buckets(b" " + text + b" ", (2, 3, 4), 1, BITS, fold=True)


def fit(docs: DataFrame, lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text") -> LanguageModel | None:
    """Learns in a task, which gets the bounded sample; the driver gets the model alone."""
    sample = training_rows(docs, lang_col, per_language, id_col, text_col)
    if sample is None:
        return None

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for b in batches:
            texts += utf8(b.column(1))
            labels += b.column(0).to_pylist()
        of = first_of_each(labels, per_language)
        model = _trained([texts[k] for k in of], [labels[k] for k in of])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = [pickle.loads(r[0]) for r in arrow_scan(sample, learn, "model binary").collect()]  # of one part, or of none where no row was picked
    return next((m for m in found if m is not None), None)


def _trained(texts: list[bytes], labels: list) -> LanguageModel | None:
    lettered = [k for k, t in enumerate(texts) if _letter(t.decode())]
    if not lettered:
        return None
    names, sizes = sorted({labels[k] for k in lettered}), []
    rows, y = sparse(_found((texts[k] for k in lettered), sizes)), np.array([names.index(labels[k]) for k in lettered])
    test = np.arange(len(rows)) % LEFT_OUT == LEFT_OUT - 1
    rng = np.random.default_rng(3)
    embed = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIM, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    order = np.flatnonzero(~test)
    steps = max(1, EPOCHS * len(order))
    for step in range(EPOCHS * len(order)):
        if step % max(1, len(order)) == 0:
            rng.shuffle(order)
        k = order[step % len(order)]
        i, x = rows[k]
        hidden = x @ embed[i]
        p = _softmax(hidden @ out + bias)
        p[y[k]] -= 1
        rate = 2.0 * (1 - step / steps) + 0.02
        back = out @ p
        out -= rate * np.outer(hidden, p)
        bias -= 0.1 * rate * p
        embed[i] -= rate * 10 * np.outer(x, back)
    table = embed @ out
    held = np.full(1 << BITS, 0.1)  # what a bucket that the sample lacks counts
    for k in order:
        held[rows[k][0]] += rows[k][1] * sizes[k]
    share = np.log(held / held.sum()).astype(np.float32)
    left = np.flatnonzero(test) if test.any() else np.arange(len(rows))
    z = np.array([x @ table[i] for i, x in (rows[k] for k in left)]) + bias
    temperature = min((float(t) for t in np.geomspace(0.1, 10, 60)), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(left)), y[left]] + 1e-12).sum())
    p = _softmax(z / temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y[left]])
    reached = right[int(REJECT_SHARE * len(right))] if len(right) else 0.0
    # no largest probability lies below an even share
    threshold = max(min(0.5, float(reached)), min(1.0, EVEN_SHARES / len(names)))
    typical = np.array([float(x @ share[i]) for i, x in (rows[k] for k in left)])
    usual = float(typical.min() + UNLIKE * (share.mean() - typical.min()))
    return LanguageModel(names, np.column_stack([table, share]).astype(np.float32), bias, temperature, threshold if len(names) > 1 else 0.0, usual)


def _found(texts: Iterable[bytes], sizes: list[int]) -> Iterator[np.ndarray]:
    """All buckets of one text after the other, repeats included; sizes gets their numbers."""
    for t in texts:
        out = np.concatenate(list(features(t)))
        sizes.append(len(out))
        yield out


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score and rejected for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            names, scores, rejected = [], [], []
            for text in utf8(b.column(1)):
                known = m is not None and _letter(text.decode()) is not None
                p, out = m.judged(text) if known else (None, True)
                names.append(m.languages[int(p.argmax())] if known else UNKNOWN)
                scores.append(float(p.max()) if known else 0.0)
                rejected.append(m is not None and out)
            columns = [b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return arrow_scan(rows, scan, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not rejected (all without a model), all columns unchanged; the decision is made where the row is read."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            ok = [_letter(t.decode()) is not None and not m.judged(t)[1] for t in utf8(b.column(at))]
            yield b.filter(pa.array(ok, pa.bool_()))

    return arrow_scan(docs, scan, docs.schema)
