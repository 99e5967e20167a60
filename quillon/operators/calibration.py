"""Evaluation of prediction records: calibration, utility, temperatures, halting and conformal thresholds.

Records carry p (probabilities), z (logits), y (index of the answer) and what
follows from them. Grids of thresholds and temperatures are fixed and small,
so they are expanded per record before one aggregation with partial sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as P
from ..functions.hashing import gamma, normal, uniform
from ..session import cut
from .splits import placed


def scored(rows: DataFrame) -> DataFrame:
    """rows (…, y, z, p) with the columns of a prediction record."""
    p, y = F.col("p"), F.col("y")
    rows = rows.withColumns({"pred": P.argmax(p), "conf": F.array_max(p), "p_true": P.at(p, y)})
    return rows.withColumns({
        "correct": (F.col("pred") == y).cast("int"), "nll": -F.log("p_true"), "brier": P.brier(p, y),
        "sph": P.spherical(p, y), "rps": P.ranked_probability_score(p, y), "level": P.expected_level(p), "n_options": F.size(p),
    })


def ece(rows: DataFrame, by: list[str], bins: int = 15) -> DataFrame:
    """Expected calibration error over equal bins; the last bin is closed."""
    b = F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1))
    per = rows.groupBy(*by, b.alias("bin")).agg(F.avg("conf").alias("c"), F.avg("correct").alias("a"), F.count("*").alias("m"))
    return per.groupBy(*by).agg((F.sum(F.abs(F.col("c") - F.col("a")) * F.col("m")) / F.sum("m")).alias("ece"))


def summary_columns() -> list[Column]:
    r = lambda c, n: F.round(c, 6).alias(n)
    return [
        F.count("*").alias("n"), r(F.avg("correct"), "acc"), r(F.avg("nll"), "nll"), r(F.avg("brier"), "brier"), r(F.avg("conf"), "mean_conf"),
        r(F.avg(1 / F.col("n_options")), "chance"), r(F.avg("rps"), "rps"),
        r(F.avg((F.abs(F.col("pred") - F.col("y")) <= 1).cast("int")), "within1"), r(F.avg(F.abs(F.col("level") - F.col("y"))), "level_mae"),
    ]


def utility(rows: DataFrame, thresholds: list[float], costs: list[tuple[float, float]]) -> DataFrame:
    """(threshold, wrong, escalate, utility): mean value of answering at or above the threshold and escalating below."""
    grid = F.array(*(F.struct(F.lit(t).alias("threshold"), F.lit(w).alias("wrong"), F.lit(e).alias("escalate")) for t in thresholds for w, e in costs))
    x = rows.select("conf", "correct", F.explode(grid).alias("g")).select("conf", "correct", "g.*")
    value = F.when(F.col("conf") < F.col("threshold"), -F.col("escalate")).when(F.col("correct") == 1, 1.0).otherwise(-F.col("wrong"))
    return x.groupBy("threshold", "wrong", "escalate").agg(F.avg(value).alias("utility"))


def best_utility(curve: DataFrame) -> DataFrame:
    """The best threshold for each cost; on ties the larger."""
    best = curve.groupBy("wrong", "escalate").agg(F.max(F.struct(F.round("utility", 9).alias("u"), F.col("threshold").alias("t"))).alias("m"))
    return best.select("wrong", "escalate", F.col("m.t").alias("threshold"), F.round("m.u", 6).alias("utility"))


def temperature_nll(rows: DataFrame, by: list[str], grid: list[float]) -> DataFrame:
    x = rows.select(*by, "z", "y", F.explode(F.array(*map(F.lit, grid))).alias("t"))
    z = F.transform("z", lambda v: v / F.col("t"))
    return x.groupBy(*by, "t").agg(F.round(F.avg(P.log_sum_exp(z) - P.at(z, F.col("y"))), 9).alias("nll"), F.count("*").alias("n"))


def best_temperature(rows: DataFrame, by: list[str], grid: list[float], least: int = 30) -> DataFrame:
    """The temperature with the least mean loss; on ties the smaller; buckets under `least` rows have none."""
    t = temperature_nll(rows, by, grid).where(F.col("n") >= least)
    best = t.groupBy(*by).agg(F.min(F.struct("nll", "t")).alias("m"))
    return best.select(*by, F.col("m.t").alias("temperature"), F.round("m.nll", 6).alias("nll"))


#: Counts up to which a Poisson number is drawn from its own distribution; above it a cubed normal number is as near as makes no difference.
EXACT = 100


def poisson(seed: str, n: Column, *keys) -> Column:
    """A Poisson number of mean n, which is a whole number."""
    m = F.least(n, F.lit(EXACT)).cast("double")
    steps = F.sequence(F.lit(1), (m + 10 * F.sqrt(m) + 12).cast("int"))  # beyond any uniform of 48 bits
    start = F.struct(F.exp(-m).alias("p"), F.exp(-m).alias("c"), F.lit(0).alias("k"))
    u = uniform(seed, *keys)

    def step(a: Column, i: Column) -> Column:
        p = a["p"] * m / i
        return F.struct(p.alias("p"), (a["c"] + p).alias("c"), F.when(a["c"] <= u, i).otherwise(a["k"]).alias("k"))

    few = F.aggregate(steps, start, step, lambda a: a["k"])
    many = F.floor(n * F.pow(1 - 1 / (9 * n) + normal(seed, *keys) / (3 * F.sqrt(n)), F.lit(3.0)) + 0.5)
    return F.when(n <= EXACT, few).otherwise(F.greatest(many, F.lit(0))).cast("long")


def bootstrap_means(rows: DataFrame, value: str, seed: str, resamples: int) -> DataFrame:
    """(b, mean) of each Poisson resample: a row is in it Poisson(1) times, so the rows of one value are in it Poisson(their number) times.

    The rows are counted by value once; the work after that is resamples times values. Resamples without a row have no mean; null values are left out.
    """
    n = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    x = n.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    x = x.withColumn("k", poisson(seed, F.col("n"), F.col("b"), F.col("v")))
    return x.groupBy("b").agg(F.try_divide(F.sum(F.col("k") * F.col("v")), F.sum("k")).alias("mean")).where("mean is not null")


#: The distribution function of Poisson(1) from 0 on, as far as a resample holds a row: 8 times at most.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]


def resampled_means(rows: DataFrame, key: str, value: str, seed: str, resamples: int) -> DataFrame:
    """(b, mean) of each Poisson resample, drawn for each row: a row is in it Poisson(1) times, by a hash of its key and the resample.

    The rows are stored before they are multiplied, and dealt to all cores, since a small table may come in one part.
    """
    rows = cut(rows.select(key, value))
    x = rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, key)
    x = x.select(key, value, F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    x = x.select("b", value, uniform(seed, F.col("b"), F.col(key)).alias("_u"))
    times = reduce(Column.__add__, ((F.col("_u") >= t).cast("int") for t in POISSON))
    x = x.select("b", value, times.alias("_k"))
    return x.groupBy("b").agg(F.try_divide(F.sum(F.col("_k") * F.col(value)), F.sum("_k")).alias("mean")).where("mean is not null")


def dirichlet_rewards(rows: DataFrame, key: str, draws: int, kappa: float, seed: str, spherical: float = 0.5, ranked: float = 0.0) -> DataFrame:
    """(key, g, reward, advantage) of `draws` reports drawn around each row's probabilities p by Dirichlet(kappa p), scored against the answer y.

    The reward is the logarithmic score and `spherical` times the spherical one, less `ranked` times the ranked one; the advantage is
    it against the mean of the row's reports, in units of their standard deviation.
    """
    shape = F.transform("p", lambda x: F.greatest(kappa * F.greatest(x, F.lit(1e-6)), F.lit(1e-3)))
    x = rows.select(key, "y", shape.alias("_shape"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("g"))
    x = x.withColumn("_q", F.transform("_shape", lambda a, i: F.greatest(gamma(seed, a, F.col(key), F.col("g"), i), F.lit(1e-300))))
    q = P.normalised(F.transform(P.normalised(F.col("_q")), lambda v: F.greatest(v, F.lit(1e-8))))
    x = x.withColumn("_q", q)
    p, y = F.col("_q"), F.col("y")
    reward = F.log(P.at(p, y)) + spherical * P.spherical(p, y) - ranked * P.ranked_probability_score(p, y)
    x = x.select(key, "g", reward.alias("reward"))
    one = Window.partitionBy(key)  # as many rows as draws
    spread = F.greatest(F.stddev_samp("reward").over(one), F.lit(1e-6))
    return x.withColumn("advantage", (F.col("reward") - F.avg("reward").over(one)) / spread)


def conformal(scores: DataFrame, score: str, alpha: float, key: str) -> DataFrame:
    """The sorted score at floor(alpha * (n + 1)) - 1, clamped to the list; one half if there are none."""
    scores = cut(scores.select(score, key))
    n = scores.agg(F.count("*").alias("n")).first()[0]  # one number
    if not n:
        return scores.sparkSession.range(1).select(F.lit(0.5).alias("threshold"), F.lit(0).cast("long").alias("n"))
    rank = min(max(int(alpha * (n + 1)) - 1, 0), n - 1)
    at = placed(scores, [], [score, key]).where(F.col("_place") == rank + 1)
    return at.agg(F.max(score).alias("threshold"), F.lit(n).cast("long").alias("n"))


def depth_records(rows: DataFrame, depths: int) -> DataFrame:
    """One row for each pass k of a record: the answer sharpens with k."""
    x = rows.select("vec_id", "y", "z", F.explode(F.sequence(F.lit(1), F.lit(depths))).alias("k"))
    return x.withColumn("p", P.softmax(F.transform("z", lambda v: v * F.col("k") / depths))).drop("z")


def depth_features(passes: DataFrame) -> DataFrame:
    before = F.lag("p").over(Window.partitionBy("vec_id").orderBy("k"))
    p = F.col("p")
    return passes.select("vec_id", "y", "k", "p", F.array_max(p).alias("top1"), P.margin(p).alias("margin"), P.entropy(p).alias("entropy"), F.coalesce(P.kl(p, before), F.lit(0.0)).alias("kl"))
