"""Deterministic pseudo-random numbers: every draw hashes a seed and a key, so runs repeat and engines agree."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(x) -> Column:
    return x.cast("string") if isinstance(x, Column) else F.lit(str(x))


def digest(seed: str, *keys) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *(_text(k) for k in keys)))


def uniform(seed: str, *keys) -> Column:
    """A number in [0, 1) from the first 48 bits of the digest."""
    return F.conv(F.substring(digest(seed, *keys), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def uniform_sql(seed: str, *keys: str) -> str:
    joined = "||'|'||".join([f"'{seed}'", *(f"({k})::varchar" for k in keys)])
    return f"(('0x'||substr(md5({joined}),1,12))::ubigint::double/{2**48}.0)"


#: Tries of the gamma draw; each is taken with probability 0.95 at least.
TRIES = 6


def normal(seed: str, *keys) -> Column:
    """A standard normal number from two uniforms."""
    radius = F.sqrt(-2 * F.log(1 - uniform(seed, *keys, "r")))
    return radius * F.cos(2 * math.pi * uniform(seed, *keys, "a"))


def gamma(seed: str, shape: Column, *keys) -> Column:
    """A gamma number of scale 1, by squeezing a cubed normal number into the density; the tries are hashed, so their number is fixed.

    Shapes below 1 are drawn one higher and scaled down by a power of a uniform. Without an accepted try (less than one draw in
    ten million) it is the mode of the cubed number.
    """
    d = F.when(shape < 1, shape + 1).otherwise(shape) - 1.0 / 3
    c = 1 / F.sqrt(9 * d)

    def attempt(t: int) -> Column:
        x = normal(seed, *keys, t)
        v = F.pow(1 + c * x, F.lit(3.0))
        room = F.when(v > 0, 0.5 * x * x + d - d * v + d * F.log(F.when(v > 0, v)))
        return F.when(F.log(1 - uniform(seed, *keys, t, "u")) < room, d * v)

    drawn = F.coalesce(*(attempt(t) for t in range(TRIES)), d)
    return drawn * F.when(shape < 1, F.pow(1 - uniform(seed, *keys, "b"), 1 / shape)).otherwise(1.0)


def normal_sql(seed: str, *keys: str) -> str:
    return f"(sqrt(-2*ln(1-{uniform_sql(seed, *keys, chr(39) + 'r' + chr(39))}))*cos(2*pi()*{uniform_sql(seed, *keys, chr(39) + 'a' + chr(39))}))"


def gamma_sql(seed: str, d: str, *keys: str) -> str:
    """The draw for shapes of 1 and more, where d is the shape less a third."""
    tries = []
    for t in range(TRIES):
        x = normal_sql(seed, *keys, str(t))
        v = f"pow(1+{x}/sqrt(9*{d}), 3)"
        u = uniform_sql(seed, *keys, str(t), "'u'")
        tries.append(f"when {v} > 0 and ln(1-{u}) < 0.5*{x}*{x}+{d}-{d}*{v}+{d}*ln(greatest({v}, 1e-300)) then {d}*{v}")
    return f"(case {' '.join(tries)} else {d} end)"


def digest_sql(seed: str, *keys: str) -> str:
    return "md5(" + "||'|'||".join([f"'{seed}'", *(f"({k})::varchar" for k in keys)]) + ")"
