"""Exact nearest vectors: similarity is a Column, and the k best come from a distributed top-k. Lists of k-means centres prune partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.errors import RequestError
from ..plans.schema import Field


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(v: Column, query: Sequence[float], metric: str, dims: int = 0) -> Column:
    """Greater is nearer: cosine, inner product, or 1 / (1 + squared distance)."""
    query = list(map(float, query))[: dims or None]
    v = F.slice(v, 1, dims) if dims else v
    q = F.array(*(F.lit(x) for x in query))
    if metric == "cosine":
        size = sum(x * x for x in query) ** 0.5
        return F.try_divide(_dot(v, q), F.sqrt(_dot(v, v)) * size)
    if metric == "ip":
        return _dot(v, q)
    if metric != "l2":
        raise RequestError("bad_metric", f"no metric {metric}")
    gap = F.aggregate(F.zip_with(v, q, lambda x, y: F.pow(x.cast("double") - y, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + gap)


def nearest(domain: DataFrame, key: str, field: Field, query: Sequence[float], k: int, least: float | None = None, group: Sequence[str] | None = None) -> DataFrame:
    """(key, _near_) of the k nearest rows, ties by key; with `group`, of the nearest rows of the k nearest groups.

    Rows without a vector, of another length or (for cosine) of length zero are left out. Of several vectors a row's best
    counts. `least` then drops those under it; for L2 it is the greatest distance.
    """
    one = lambda v: F.when(F.size(v) >= len(query) if field.truncate_dims else F.size(v) == len(query), similarity(v, query, field.metric, field.truncate_dims))
    c = F.col(field.source)
    near = F.array_max(F.transform(c, one)) if field.multi else one(c)
    rows = domain.select(key, *(group or ()), near.alias("_near_")).where("_near_ is not null")
    if group:
        best = Window.partitionBy(*group).orderBy(F.desc("_near_"), key)
        rows = rows.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    out = rows.orderBy(F.desc("_near_"), key).limit(k).select(key, "_near_")
    if least is not None:
        out = out.where(F.col("_near_") >= (1 / (1 + float(least) ** 2) if field.metric == "l2" else float(least)))
    return out


def lists(df: DataFrame, column: str, k: int, seed: int = 7) -> tuple[DataFrame, list[list[float]]]:
    """`df` with `list_id`, its nearest of `k` centres, and the centres: written partitioned by list, a search reads a few lists."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="list_id", maxIter=10).fit(df.select(array_to_vector(F.col(column).cast("array<double>")).alias("_v")))
    made = model.transform(df.withColumn("_v", array_to_vector(F.col(column).cast("array<double>")))).drop("_v")
    return made, [c.tolist() for c in model.clusterCenters()]


def probed(df: DataFrame, centres: Sequence[Sequence[float]], query: Sequence[float], nprobe: int) -> DataFrame:
    """Rows of the `nprobe` lists whose centres are nearest; a filter on the partition column."""
    gap = [sum((a - b) ** 2 for a, b in zip(c, query)) for c in centres]
    near = sorted(range(len(centres)), key=gap.__getitem__)[:nprobe]
    return df.where(F.col("list_id").isin(near))
