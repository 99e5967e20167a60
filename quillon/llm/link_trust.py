"""URL verdicts: host and path rules, else trust and distrust propagated over the host link graph.

DataFrame operations only. Links of a page lead from its host to the host of
the link: absolute links begin with a scheme and `://` or with `//`, other
schemes (mailto and the like) are no links, a link without a host stays on its
own, and every host also links to its parent domain. Personalised PageRank runs from the hosts that allow rules
cover whole (trust, along links) and from hosts by their share of blocked
pages (distrust, against links). Edges are counted before they are shuffled,
so a host with a third of all pages is one row for each task. Links that lead
through few hosts are followed in doubling lengths, so a tree of hosts takes a
handful of rounds; a dense graph is followed link by link, with its links kept
where their source is and hubs joined with a broadcast of their rank. Rounds end
when the walks left out hold no more than a set part of all rank. Trust and distrust are
given as multiples of an even share over all hosts, so the threshold means the
same for any number of them. A host is blocked if its distrust is above the
threshold and above its trust.

Null urls and urls without `://` have empty host and path, match no rule and
are allowed. Null html has no links. Repeated rows get equal verdicts; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, cut, maybe_broadcast, shuffle_partitions

DAMPING, EACH = 0.85, 5
TOLERANCE = 1e-7  # of all rank, in walks that are not summed
#: How many times more walks of twice the length there may be; rows of a part of a small graph.
WIDEST, PART_ROWS = 4.0, 100_000
THRESHOLD = 1.0  # multiple of an even share of all distrust
BROADCAST_HOSTS = 200_000


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def host_of(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return _lower(F.regexp_extract(rest, r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and what it says; rules are (verdict, host and path)."""
    rule, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, start = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit("/" + start))
        rule, says = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(says)
    return rule, says


#: The value of a link's attribute, with its quotes of either kind or none, in any case; and what begins a link that has a scheme.
HREF = r"""(?i)(?<![\w-])href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): links between hosts with their number; each host links to its parent domain once."""
    links = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("to")).where("host <> ''")
    links = links.select("host", F.btrim("to", F.lit(" \t\r\n\"'")).alias("to"))
    there = (
        F.when(F.startswith("to", F.lit("//")), host_of(F.concat(F.lit("x:"), F.col("to"))))
        .when(F.col("to").rlike(SCHEME + "//"), host_of(F.col("to")))
        .when(F.col("to").rlike(SCHEME), F.lit(""))
        .otherwise(F.col("host"))
    )
    out = links.select(F.col("host").alias("src"), there.alias("dst")).where("dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    hosts = pages.select("host").where("host <> ''").distinct()
    parent = F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1)
    up = hosts.select(F.col("host").alias("src"), parent.alias("dst"), F.lit(1.0).alias("w")).where("dst <> ''")
    return out.unionByName(up).groupBy("src", "dst").agg(F.sum("w").alias("w"))


@dataclass(frozen=True)
class Walks:
    """(kind, src, dst, p): how much rank walks of one length carry from a host to another. Hubs are hosts with more than a thousandth of all rows."""

    rest: DataFrame
    hubs: DataFrame | None
    sources: DataFrame | None
    rows: int

    def moved(self, ranks: DataFrame) -> DataFrame:
        """(kind, host, r): the rank that the walks carry; rows of `rest` stay where they are, and a hub's rank is broadcast."""
        ranks = ranks.withColumnRenamed("host", "src")
        out = self.rest.join(F.broadcast(ranks) if self.rows <= BROADCAST_HOSTS else ranks, ["kind", "src"])
        if self.hubs is not None:
            few = ranks.join(F.broadcast(self.sources), ["kind", "src"], "left_semi")
            out = out.unionByName(self.hubs.join(F.broadcast(few), ["kind", "src"]))
        return out.select("kind", F.col("dst").alias("host"), (F.col("p") * F.col("r")).alias("r"))

    def every(self) -> DataFrame:
        return self.rest if self.hubs is None else self.rest.unionByName(self.hubs)


def _cut_by(df: DataFrame) -> DataFrame:
    """A checkpoint that still knows how its rows are dealt, which a plan that adapts while it runs does not tell."""
    conf, key = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    was = conf.get(key)
    conf.set(key, "false")
    try:
        return cut(df.select("*"))
    finally:
        conf.set(key, was)


def _kept(steps: DataFrame) -> Walks:
    """Checkpointed walks: few ones in few parts, many ones by their source, so that a round shuffles ranks and no walks."""
    steps = cut(steps)
    n, parts = steps.count(), shuffle_partitions(steps.sparkSession)
    if n <= BROADCAST_HOSTS:
        return Walks(steps.coalesce(max(1, -(-n // PART_ROWS))), None, None, n)
    hot = cut(steps.groupBy("kind", "src").agg(F.count("*").alias("_n")).where(F.col("_n") > n / 1000).select("kind", "src"))
    rest = _cut_by(steps.join(F.broadcast(hot), ["kind", "src"], "left_anti").repartition(parts, "kind", "src"))
    return Walks(rest, None, None, n) if hot.isEmpty() else Walks(rest, cut(steps.join(F.broadcast(hot), ["kind", "src"], "left_semi")), hot, n)


def propagate(graph: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, widest: float = WIDEST) -> DataFrame:
    """(kind, host, r) by personalised PageRank; graph (kind, src, dst, w), seeds (kind, host, v), v sums to 1 for each kind.

    Hosts without links out keep their rank. All but `tolerance` of the rank is where it ends. A round doubles the length of the
    walks that are summed, as long as those of twice the length are at most `widest` times as many as now, which is counted
    beforehand; from then on a round adds the walks of the length reached.
    """
    out = graph.groupBy("kind", "src").agg(F.sum("w").alias("all"))
    ends = graph.select("kind", F.col("dst").alias("src")).union(seeds.select("kind", "host")).distinct()
    loops = ends.join(out, ["kind", "src"], "left_anti").select("kind", "src", F.col("src").alias("dst"), F.lit(DAMPING).alias("p"))
    walks = _kept(graph.join(out, ["kind", "src"]).select("kind", "src", "dst", (DAMPING * F.col("w") / F.col("all")).alias("p")).unionByName(loops))
    base = ranks = cut(seeds.select("kind", "host", ((1 - DAMPING) * F.col("v")).alias("r")))
    left, length, doubling, rounds = DAMPING, 1, True, 0  # left: of all rank, in longer walks than are summed
    while left > tolerance:
        ranks = base.unionByName(walks.moved(ranks)).groupBy("kind", "host").agg(F.sum("r").alias("r"))
        left, rounds = left * DAMPING**length, rounds + 1
        if doubling or rounds % EACH == 0:
            ranks = cut(ranks)
        if doubling and left > tolerance:
            every = walks.every()
            into = every.groupBy("kind", F.col("dst").alias("host")).agg(F.count("*").alias("i"))
            onward = every.groupBy("kind", F.col("src").alias("host")).agg(F.count("*").alias("o"))
            longer = into.join(onward, ["kind", "host"]).agg(F.sum(F.col("i").cast("double") * F.col("o"))).first()[0] or 0.0
            doubling = longer <= widest * walks.rows
            if doubling:
                then = every.select("kind", F.col("src").alias("dst"), F.col("dst").alias("end"), F.col("p").alias("q"))
                walks = _kept(every.join(then, ["kind", "dst"]).groupBy("kind", "src", F.col("end").alias("dst")).agg(F.sum(F.col("p") * F.col("q")).alias("p")))
                base, length = ranks, 2 * length
    return cut(ranks)


def verdicts(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, host, path, rule, verdict, trust and distrust of every page."""
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.select("_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), "html")
    rule, says = rule_columns(F.col("host"), F.col("path"), rules)
    whole = [t[:-1] for v, t in rules if v == "allow" and t.count("/") == 1 and t.endswith("/")]
    trusted = reduce(lambda a, b: a | b, [(F.col("host") == d) | F.endswith("host", F.lit("." + d)) for d in whole], F.lit(False))

    by_host = rows.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(says.eqNullSafe("block")).alias("blocked"))
    mass = cut(by_host.select("host", F.when(trusted, 1.0).otherwise(0.0).alias("good"), (F.col("blocked") / F.col("n")).alias("bad")))
    long = mass.select("host", F.explode(F.create_map(F.lit("trust"), "good", F.lit("distrust"), "bad")).alias("kind", "m")).where("m > 0")
    total = long.groupBy("kind").agg(F.sum("m").alias("t"))
    seeds = long.join(F.broadcast(total), "kind").select("kind", "host", (F.col("m") / F.col("t")).alias("v"))
    links = cut(edges(rows))
    graph = links.select(F.lit("trust").alias("kind"), "src", "dst", "w").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    ranks = propagate(graph, seeds)
    even = float(mass.count())
    pick = lambda k: F.round(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("r"))), F.lit(0.0)) * even, 3)
    hosts = maybe_broadcast(cut(ranks.groupBy("host").agg(pick("trust").alias("trust"), pick("distrust").alias("distrust"))), BROADCAST_HOSTS)
    out = rows.drop("html").join(hosts, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when((distrust > threshold) & (distrust > trust), "block").otherwise("allow")
    return out.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
