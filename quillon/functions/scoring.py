"""Probabilities and proper scores over array columns, inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once for a row, however often f names it and whatever lambda it stands in."""
    return F.element_at(F.transform(F.array(value), f), 1)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def doubles(xs: Column) -> Column:
    return F.transform(xs, lambda x: x.cast("double"))


def normalised(xs: Column) -> Column:
    """Divided by their sum."""
    return let(xs, lambda v: let(total(v), lambda t: F.transform(v, lambda x: x / t)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    return let(a, lambda v: let(b, lambda w: dot(v, w) / (norm(v) * norm(w))))


def unit(xs: Column) -> Column:
    return let(xs, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: x / n)))


def softmax(z: Column) -> Column:
    return normalised(let(z, lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))))


def log_sum_exp(z: Column) -> Column:
    return let(z, lambda v: let(F.array_max(v), lambda top: top + F.log(total(F.transform(v, lambda x: F.exp(x - top))))))


def argmax(xs: Column) -> Column:
    """The first index of the maximum, from 0."""
    return let(xs, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def at(xs: Column, index: Column) -> Column:
    return F.element_at(xs, index.cast("int") + 1)


def brier(p: Column, y: Column) -> Column:
    return total(F.transform(p, lambda x, i: F.pow(x - F.when(i == y, 1.0).otherwise(0.0), F.lit(2.0))))


def spherical(p: Column, y: Column) -> Column:
    return at(p, y) / F.greatest(norm(p), F.lit(1e-8))


def ranked_probability_score(p: Column, y: Column) -> Column:
    """Squared differences of the running sums of p and of the outcome."""
    state = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s"), F.lit(0).alias("i"))

    def step(acc, x):
        c = acc["c"] + x
        d = c - F.when(acc["i"] >= y, 1.0).otherwise(0.0)
        return F.struct(c.alias("c"), (acc["s"] + d * d).alias("s"), (acc["i"] + 1).alias("i"))

    return F.aggregate(p, state, step)["s"]


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda x: F.greatest(x, F.lit(1e-12)) * F.log(F.greatest(x, F.lit(1e-12)))))


def kl(p: Column, q: Column) -> Column:
    low = F.lit(1e-12)
    return total(F.zip_with(p, q, lambda x, y: F.greatest(x, low) * (F.log(F.greatest(x, low)) - F.log(F.greatest(y, low)))))


def margin(p: Column) -> Column:
    s = F.sort_array(p, asc=False)
    return F.element_at(s, 1) - F.element_at(s, 2)


def expected_level(p: Column) -> Column:
    return total(F.transform(p, lambda x, i: x * i))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def top_k(p: Column, k: int) -> Column:
    """Indices of the k largest, the lower index first on ties."""
    keyed = F.transform(p, lambda x, i: F.struct((-x).alias("x"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["i"])
