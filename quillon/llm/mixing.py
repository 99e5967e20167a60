"""Mixing documents to target weights: iterative proportional fitting of token weights, then sampling.

Documents fall into cells of source, language and topic; one aggregation (with
partial sums on the map side) gives the tokens of each cell. The cell weights
are raked to the marginal targets with what there is as an upper bound inside the
loop: each step scales the cells of a value to its share of the token budget,
and what full cells cannot take goes to the others of the value, so the next
steps see it. Sweeps end when none moves. Sampling keeps a document with the
probability raked / available of its cell, so the expected tokens of the sample
follow the margins; `margins` shows targets that the documents cannot meet.

While the cells are within a checked bound they are raked in numpy on the
driver and their probabilities are broadcast; beyond it the same steps run as
aggregations and joins over the checkpointed cells.

A missing dimension value is a value of its own (the empty string); null and
empty texts have no tokens and are kept with their cell's probability. A
target names shares of the values of one dimension, or an exponent that
tempers the shares there are; values that a target does not name keep their
own share. A document's draw hashes its id, so repeated rows are kept or
dropped together, and a run can be repeated. Without a topic column the form of
a text stands in for it; a caller can pass another expression. An empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small, spread_join

DIMS = ("source", "lang", "topic")
#: Sweeps at most, which end when none moves more than this part of all tokens; cells that are raked on the driver at most.
SWEEPS, TOLERANCE = 40, 1e-10
DRIVER_CELLS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Targets by dimension: shares of values, or the exponent that tempers the shares there are."""

    source: dict[str, float] | float = 0.5
    lang: dict[str, float] | float = 0.7
    topic: dict[str, float] | float = 0.7
    budget: float = 0.5  # share of all tokens to keep
    seed: str = "mix"


def topic_of(text: Column, words: Column) -> Column:
    """The form of a text, in place of a topic column."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.regexp_like(text, F.lit("[#*$%&]{3}")), "marked")
        .when(F.contains(text, F.lit("!! ")), "loud")
        .when(words < 100, "note")
        .when(words < 600, "article")
        .otherwise("long")
    )


Topic = Callable[[Column, Column], Column]  # of a text and its number of words


def described(docs: DataFrame, text_col: str = "text", topic: Topic = topic_of) -> DataFrame:
    """(_row, _source, _lang, _topic, _tokens): the row, its cell, and the words of its whole text."""
    rows = docs.select(F.struct("*").alias("_row"))
    blank = lambda c: F.coalesce(F.col("_row").getField(c).cast("string"), F.lit(""))
    out = rows.withColumn("_tokens", F.regexp_count(blank(text_col), F.lit(WORD)).cast("long"))
    return out.withColumns({"_source": blank("source"), "_lang": blank("lang"), "_topic": topic(blank(text_col), F.col("_tokens"))})


def draw(seed: str, id_col: Column) -> Column:
    """A number from 0 to 1 that depends on the seed and the id only."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def _shares(own: dict, target) -> dict:
    """Target shares of the values that have tokens, adding up to 1."""
    if isinstance(target, dict):
        want = {k: target.get(k, v) for k, v in own.items()}
    else:
        want = {k: v**target for k, v in own.items()}
    total = sum(want.values())
    return {k: v / total for k, v in want.items()} if total else own


def rake(cells: DataFrame, mix: Mix) -> DataFrame:
    """cells (_source, _lang, _topic, base) with probability; base > 0 for at least one cell, or all are kept."""
    spark = cells.sparkSession
    names = ["_" + d for d in DIMS]
    margins = {}
    total = cells.agg(F.sum("base")).first()[0] or 0.0
    if not total:
        return cells.withColumn("probability", F.lit(1.0))
    if not small(cells, DRIVER_CELLS):
        return _rake_spread(cells, mix, float(total))
    pdf = cells.orderBy(*names).toPandas()
    base = pdf["base"].to_numpy(float)
    for d, n in zip(DIMS, names):
        own = (pdf.groupby(n)["base"].sum() / total).to_dict()
        margins[n] = _shares({k: v for k, v in own.items() if v > 0}, getattr(mix, d))
    codes = {n: pdf[n].astype("category").cat.codes.to_numpy() for n in names}
    want = {n: mix.budget * total * np.array([margins[n].get(v, 0.0) for v in pdf[n].astype("category").cat.categories]) for n in names}
    m = mix.budget * base
    for _ in range(SWEEPS):
        before = m
        for n in names:
            m = _filled(m, base, codes[n], want[n])
        if np.abs(m - before).max(initial=0) <= TOLERANCE * total:
            break
    pdf["probability"] = np.where(base > 0, m / np.where(base > 0, base, 1), 1.0)
    return F.broadcast(spark.createDataFrame(pdf, cells.schema.add("probability", "double")))


def _filled(m: np.ndarray, base: np.ndarray, code: np.ndarray, want: np.ndarray) -> np.ndarray:
    """m scaled within each value to its wanted sum, no cell above its base: cells that the factor lifts above it are set to it, and the others get more."""
    room = np.divide(base, m, out=np.full_like(m, np.inf), where=m > 0)
    order = np.lexsort((room, code))
    c, first = code[order], np.ones(len(code), bool)
    first[1:] = c[1:] != c[:-1]
    start = np.flatnonzero(first)[np.cumsum(first) - 1]
    before = lambda x: np.concatenate(([0.0], np.cumsum(x[order])))
    b, o = before(base), before(m)
    at = np.arange(len(code))
    left = np.bincount(code, m, len(want))[c] - (o[at] - o[start])
    factor = np.divide(want[c] - (b[at] - b[start]), left, out=np.zeros(len(code)), where=left > 0)
    best = np.full(len(want), -np.inf)
    ok = factor <= room[order]
    np.maximum.at(best, c[ok], factor[ok])
    best = np.where(best == -np.inf, np.inf, best)[code]
    return np.minimum(base, np.multiply(best, m, out=np.zeros_like(m), where=m > 0))


def _rake_spread(cells: DataFrame, mix: Mix, total: float) -> DataFrame:
    """The same steps with the cells left where they are; margins are joined back."""
    names = ["_" + d for d in DIMS]
    w = cells.withColumn("m", F.col("base") * mix.budget)
    for d in DIMS:
        n, target = "_" + d, getattr(mix, d)
        own = w.groupBy(n).agg((F.sum("base") / total).alias("own")).where("own > 0")
        if isinstance(target, dict):
            pairs = F.create_map(*(F.lit(x) for k, v in target.items() for x in (k, float(v)))) if target else None
            want = F.coalesce(F.try_element_at(pairs, F.col(n)), F.col("own")) if target else F.col("own")
        else:
            want = F.pow("own", F.lit(float(target)))
        own = own.withColumn("want", want)
        whole = own.agg(F.sum("want")).first()[0]
        w = cut(w.join(own.select(n, (F.col("want") / whole * mix.budget * total).alias("want" + n)), n, "left").fillna(0.0, ["want" + n]))
    for _ in range(SWEEPS):
        w = w.withColumn("was", F.col("m"))
        for n in names:
            w = w.withColumn("room", F.when(F.col("m") > 0, F.col("base") / F.col("m")).otherwise(float("inf")))
            of = Window.partitionBy(n)
            upto = of.orderBy("room", *names).rowsBetween(Window.unboundedPreceding, 0)
            left = F.sum("m").over(of) - (F.sum("m").over(upto) - F.col("m"))
            w = w.withColumns({"left": left, "capped": F.sum("base").over(upto) - F.col("base")})
            w = w.withColumn("factor", F.when(F.col("left") > 0, (F.col("want" + n) - F.col("capped")) / F.col("left")).otherwise(0.0))
            best = F.coalesce(F.max(F.when(F.col("factor") <= F.col("room"), F.col("factor"))).over(of), F.lit(float("inf")))
            w = w.withColumn("m", F.when(F.col("m") > 0, F.least(F.col("base"), best * F.col("m"))).otherwise(0.0))
            w = cut(w.drop("room", "left", "capped", "factor"))
        moved = w.agg(F.max(F.abs(F.col("m") - F.col("was")))).first()[0] or 0.0
        w = w.drop("was")
        if moved <= TOLERANCE * total:
            break
    return cut(w.withColumn("probability", F.when(F.col("base") > 0, F.col("m") / F.col("base")).otherwise(1.0))).select(*cells.columns, "probability")


def margins(cells: DataFrame, mix: Mix) -> DataFrame:
    """(dimension, value, wanted, got): shares of the expected tokens of a sample for raked cells; a target that the documents cannot meet shows as a difference.

    Wanted shares are of the budget, got shares of the expected sample.
    """
    whole = cells.agg(F.sum(F.col("base") * F.col("probability")).alias("_kept"), F.sum("base").alias("_all"))
    out = None
    for d in DIMS:
        own = cells.groupBy(F.col("_" + d).alias("value")).agg(F.sum("base").alias("_own"), F.sum(F.col("base") * F.col("probability")).alias("_got")).crossJoin(F.broadcast(whole))
        target, share = getattr(mix, d), F.try_divide(F.col("_own"), F.col("_all"))
        named = F.lit(None).cast("double")
        if isinstance(target, dict):
            for k, v in target.items():
                named = F.when(F.col("value") == k, float(v)).otherwise(named)
        want = F.coalesce(named, share) if isinstance(target, dict) else F.pow(share, F.lit(float(target)))
        own = own.withColumn("_want", F.when(F.col("_own") > 0, want).otherwise(0.0))
        own = own.crossJoin(F.broadcast(own.agg(F.sum("_want").alias("_sum"))))
        one = own.select(F.lit(d).alias("dimension"), "value", F.try_divide(F.col("_want"), F.col("_sum")).alias("wanted"), F.try_divide(F.col("_got"), F.col("_kept")).alias("got"))
        out = one if out is None else out.unionByName(one)
    return out


def with_probability(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", topic: Topic = topic_of) -> DataFrame:
    """(_row, _source, _lang, _topic, _tokens, _p, _sampled) of every row of docs."""
    names = ["_" + d for d in DIMS]
    rows = described(docs, text_col, topic)
    cells = cut(rows.groupBy(*names).agg(F.sum("_tokens").cast("double").alias("base"), F.count("*").alias("_n")))
    rates = rake(cells.drop("_n"), mix).select(*names, F.col("probability").alias("_p"))
    id_ = F.col("_row").getField(id_col)
    if small(cells, DRIVER_CELLS):
        rows = rows.join(rates, names, "left")
    else:  # no broadcast: a hot cell's rows do not meet
        rows = spread_join(rows, rates, names, counts=cells.select(*names, "_n"))
    return rows.withColumn("_sampled", draw(mix.seed, id_) < F.col("_p"))


def sample(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", topic: Topic = topic_of) -> DataFrame:
    """The sampled rows of docs with their own columns."""
    return with_probability(docs, mix, id_col, text_col, topic).where("_sampled").select("_row.*")


def oracle(mix: Mix) -> str:
    """The same steps in SQL, a common table expression each."""
    n = ", ".join("_" + d for d in DIMS)
    parts = [
        f"""d as (select doc_id, coalesce(source, '') as _source, coalesce(lang, '') as _lang, coalesce(text, '') as t,
            len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as _tokens from documents)""",
        """x as (select *, case when contains(t, ' | ') then 'table' when regexp_matches(t, '[#*$%&]{3}') then 'marked'
            when contains(t, '!! ') then 'loud' when _tokens < 100 then 'note' when _tokens < 600 then 'article' else 'long' end as _topic from d)""",
        f"c0 as (select {n}, sum(_tokens)::double as base from x group by all)",
        "tot as (select sum(base) as total from c0)",
        "b as (select *, base / total as w0 from c0, tot)",
    ]
    for d in DIMS:
        target = getattr(mix, d)
        if isinstance(target, dict):
            cases = " ".join(f"when '{k}' then {v}" for k, v in target.items())
            want = f"case _{d} {cases} else sum(w0) end"
        else:
            want = f"pow(sum(w0), {target})"
        parts.append(f"m_{d} as (select _{d}, want / sum(want) over () as want_{d} from (select _{d}, {want} as want from b group by _{d} having sum(w0) > 0))")
    joins = " ".join(f"join m_{d} using (_{d})" for d in DIMS)
    parts.append(f"s0 as (select b.* exclude (w0), {', '.join('want_' + d for d in DIMS)}, {mix.budget} * base as m from b {joins} where base > 0)")
    k = 0
    for _ in range(SWEEPS):
        for d in DIMS:
            parts.append(f"a{k} as (select *, case when m > 0 then base / m else 'infinity'::double end as room from s{k})")
            parts.append(f"""l{k} as (select *, case when rest > 0 then (want_{d} * {mix.budget} * total - capped) / rest else 0 end as factor from (
                select *, sum(m) over (partition by _{d}) - (sum(m) over w - m) as rest, sum(base) over w - base as capped from a{k}
                window w as (partition by _{d} order by room, {n} rows unbounded preceding)))""")
            best = f"coalesce(max(case when factor <= room then factor end) over (partition by _{d}), 'infinity'::double)"
            parts.append(f"s{k + 1} as (select * exclude (room, rest, capped, factor) replace (case when m > 0 then least(base, {best} * m) else 0 end as m) from l{k})")
            k += 1
    parts.append(f"p as (select {n}, m / base as p from s{k})")
    u = f"('0x' || substr(md5('{mix.seed}|' || coalesce(doc_id::varchar, '')), 1, 12))::ubigint::double / {2**48}.0"
    return f"""with {", ".join(p if i < 0 else p.replace(" as (", " as materialized (", 1) for i, p in enumerate(parts))}
        select doc_id, _source as source, _lang as lang, _topic as topic, _tokens as n_tokens,
               round(coalesce(p, 1.0), 6) as probability, {u} < coalesce(p, 1.0) as sampled
        from x left join p using ({n})"""
