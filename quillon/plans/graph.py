"""Values scored once and joined back, and rewards normalised within their group."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query, table


@query(
    """with q as (select c_custkey, case when c_custkey%2=0 then c_mktsegment else 'OTHER' end as opt from customer), d as (select distinct opt from q), s as (select opt, length(opt)*1.5 as score from d)
    select c_custkey, round(score::double,6) as score from q join s using (opt)"""
)
def score_once(spark, sf):
    """Each distinct option is scored once and joined back to its rows."""
    q = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("OTHER").alias("opt"))
    s = q.select("opt").distinct().withColumn("score", F.char_length("opt") * 1.5)
    return q.join(s, "opt").select("c_custkey", F.round("score", 6).alias("score"))


@query("select source, round((n_chars-avg(n_chars) over w)/nullif(stddev_pop(n_chars) over w,0),6) as advantage, doc_id from documents window w as (partition by source)")
def group_advantage(spark, sf):
    """Rewards normalised within their group; the group's moments are aggregated and joined back."""
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    g = d.groupBy("source").agg(F.avg("n_chars").alias("m"), F.stddev_pop("n_chars").alias("s"))
    return d.join(g, "source").select("doc_id", "source", F.round(F.try_divide(F.col("n_chars") - F.col("m"), F.col("s")), 6).alias("advantage"))
