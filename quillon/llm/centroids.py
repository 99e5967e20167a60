"""Plain Lloyd clustering of vectors in integers.

Components become floor(scale * x). Each round broadcasts the centroids (a set
number of rows of a set width, so of fixed size), takes in every partition the
integer squared differences to one centroid after the other, and returns one
row of integer sums for each cluster that the partition meets; a groupBy merges
them, and the driver gets one row for each cluster. Vectors are read again in
each round and never shuffled, so neither a hot cluster nor repeated vectors
weigh on one task.

Vectors of another width, null, or with a null or non-finite component are
left out. Ties go to the smaller number of the centroid, equal start hashes
(repeated ids) to the smaller vector. A null id cannot start a centroid before
any other has; its vector is assigned like all. With fewer vectors than
centroids there are as many centroids as vectors; without vectors the result is
empty. Components beyond 2^27 in size count as 2^27 with their sign, for
squared distances are longs. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: The largest component of which 64 squared differences fit in a long, and vectors compared at once.
LARGEST, ROWS = 1 << 27, 4096


def usable(vector: Column, width: int) -> Column:
    """Whether a vector has the width and finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # false for NaN, which is larger than all
    return F.coalesce((F.size(vector) == width) & finite, F.lit(False))


def integers(vectors: pd.Series, scale: int) -> np.ndarray:
    """(rows, width) of floor(scale * component)."""
    x = np.floor(np.stack(vectors.to_list()).astype(np.float64) * scale)
    return np.clip(x, -LARGEST, LARGEST).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each row, the smaller of equals, and the squared distance."""
    apart = np.empty((len(centroids), len(x)), np.int64)
    for i, c in enumerate(centroids):
        d = x - c
        apart[i] = np.einsum("ij,ij->i", d, d)
    best = apart.argmin(axis=0)
    return best, apart[best, np.arange(len(x))]


def start(rows: DataFrame, k: int, scale: int, seed: int) -> np.ndarray:
    """The k vectors of smallest hash of seed and id."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    first = rows.orderBy(order.asc_nulls_last(), "_vector").limit(k).select("_vector").collect()
    return integers(pd.Series([r[0] for r in first]), scale) if first else np.empty((0, 0), np.int64)


def moved(rows: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round: floors of the means of their vectors, empty ones as they were."""
    k, width = centroids.shape
    held = rows.sparkSession.sparkContext.broadcast(centroids)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for f in frames:
            for i in range(0, len(f), ROWS):
                x = integers(f["_vector"].iloc[i : i + ROWS], scale)
                best, _ = nearest(x, held.value)
                np.add.at(total, best, x)
                count += np.bincount(best, minlength=k)
        met = np.flatnonzero(count)
        yield pd.DataFrame({"_cluster": met.astype(np.int32), "_n": count[met], **{f"_s{j}": total[met, j] for j in range(width)}})

    columns = [f"_s{j}" for j in range(width)]
    parts = rows.select("_vector").mapInPandas(sums, "_cluster int, _n bigint, " + ", ".join(f"{c} bigint" for c in columns))
    merged = parts.groupBy("_cluster").agg(F.sum("_n").alias("_n"), *(F.sum(c).alias(c) for c in columns)).collect()
    out = centroids.copy()
    for r in merged:
        out[r._cluster] = [r[c] // r._n for c in columns]
    held.destroy()
    return out


def assigned(rows: DataFrame, centroids: np.ndarray, scale: int) -> DataFrame:
    """(_id, cluster, distance) of every row."""
    kind, held = rows.schema["_id"].dataType.simpleString(), rows.sparkSession.sparkContext.broadcast(centroids)

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), ROWS):
                part = f.iloc[i : i + ROWS]
                best, apart = nearest(integers(part["_vector"], scale), held.value)
                yield pd.DataFrame({"_id": part["_id"].array, "cluster": best.astype(np.int32), "distance": apart})

    # as text: pandas would turn whole numbers beside a null into floats
    out = rows.select(F.col("_id").cast("string"), "_vector").mapInPandas(label, "_id string, cluster int, distance bigint")
    return out.withColumn("_id", F.col("_id").cast(kind))


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def lloyd(vectors: DataFrame, k: int, rounds: int, width: int, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector, after `rounds` moves of k centroids."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_vector")).where(usable(F.col("_vector"), width))
    centroids = start(rows, k, scale, seed)
    schema = f"{id_col} {rows.schema['_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        centroids = moved(rows, centroids, scale)
    out = stored(assigned(rows, centroids, scale))
    within = {r.cluster: r[1] for r in out.groupBy("cluster").agg(F.sum("distance")).collect()}
    of = [(c, n, sum(within.values()), digest(centroids[c])) for c, n in sorted(within.items())]  # k rows at most
    of = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = out.join(F.broadcast(of), "cluster")
    return out.select(F.col("_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int, rounds: int, width: int, scale: int = 256, seed: int = 2) -> str:
    """SQL of the query on `embeddings`, one common table expression for each half of a round."""
    parts = [
        f"""v as (select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as x from embeddings
            where len(embedding) = {width} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {width})""",
        f"""c0 as (select row_number() over (order by h, x) - 1 as c, x from (
            select sha256('{seed}:' || vec_id::varchar) as h, x from v order by h, x limit {k}))""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} as (select vec_id, v.x, arg_min(c, [d, c]) as c, min(d) as d from (
            select vec_id, v.x, c, list_sum(list_transform(list_zip(v.x, c{i}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from v, c{i}) v group by vec_id, v.x)""")
        if i < rounds:
            parts.append(f"""m{i} as (select c, list(f order by j) as x from (
                select c, j, (s - ((s % n) + n) % n) // n as f from (
                    select c, j, sum(x[j])::bigint as s, count(*) as n from a{i}, range(1, {width + 1}) t(j) group by c, j)) group by c)""")
            parts.append(f"c{i + 1} as (select c, coalesce(m{i}.x, c{i}.x) as x from c{i} left join m{i} using (c))")
    return f"""with {", ".join(x.replace(" as (", " as materialized (", 1) for x in parts)}
        select vec_id, c::int as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
               sha256(array_to_string(c{rounds}.x, ',')) as centroid_sha256
        from a{rounds} join c{rounds} using (c)"""
