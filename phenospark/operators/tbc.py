"""Trace-based clustering: which clusters of the K-cluster partition persist
across the partitions with 2..K-1 clusters.

Partitions are kept wide — one row per instance with its cluster in every
partition (``c_2 .. c_K``) — so match counting is a per-row explode of K-2
pairs followed by an aggregate whose partial phase combines them map-side;
no self-join on the instance id and no shuffle of instance rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenospark.session import cut_lineage

METRICS = ("jaccard", "jaccard2", "dice")
SEED_STEP = 3


def _check(K: int, metric: str | None = None):
    if int(K) != K or K < 3:
        raise ValueError("K must be an integer >= 3 (K = 2 has no earlier partition)")
    if metric is not None and metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")


def cluster_col(k: int) -> str:
    return f"c_{k}"


# T1 -----------------------------------------------------------------------------------
def tbc_partitions(df: DataFrame, features: Sequence[str], K: int, seed: int, key: str = "row_id",
                   max_iter: int = 300) -> DataFrame:
    """K-means for k = 2..K (seed grows by 3 per run) -> ``(key, c_2..c_K)``.
    The assembled vectors are checkpointed and reused by the K-1 fits and the assignment:
    of a table that is not persisted each fit keeps the vectors as they are in memory, and
    so doesn't decode them again in every round.  A fit ends when its centres rest, after
    ``max_iter`` rounds at the latest."""
    _check(K)
    if int(seed) != seed or seed < 0:
        raise ValueError("seed must be an integer >= 0")
    vec = VectorAssembler(inputCols=list(features), outputCol="features").transform(df.select(key, *features))
    out = vec = cut_lineage(vec.select(key, "features"))
    models = [KMeans(k=k, seed=int(seed) + SEED_STEP * i, maxIter=max_iter, featuresCol="features",
                     predictionCol=cluster_col(k)).fit(vec) for i, k in enumerate(range(2, K + 1))]
    for model in models:
        out = model.transform(out)
    return out.drop("features")


def partitions_long(wide: DataFrame, K: int, key: str = "row_id") -> DataFrame:
    """``(key, k, cluster)``."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(cluster_col(k)).cast("int").alias("cluster"))
                      for k in range(2, K + 1)])
    return wide.select(key, F.explode(pairs).alias("p")).select(key, "p.k", "p.cluster")


# T2 -----------------------------------------------------------------------------------
def _value(metric: str, inter: Column, size_k: Column, size_prev: Column) -> Column:
    if metric == "jaccard":
        return inter / (size_k + size_prev - inter)
    if metric == "jaccard2":
        return F.when(size_prev > 0, inter / size_prev)
    return F.when(size_k + size_prev > 0, 2.0 * inter / (size_k + size_prev))


def tbc_matches(wide: DataFrame, K: int, metric: str = "jaccard") -> DataFrame:
    """``(cluster, k, best_cluster, match)`` for every cluster of partition K
    and every earlier partition k: the best-matching cluster of k (ties to
    the lowest cluster number)."""
    _check(K, metric)
    cK = F.col(cluster_col(K)).cast("int")
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(cluster_col(k)).cast("int").alias("ck")) for k in range(2, K)])
    inter = (wide.select(cK.alias("cluster"), F.explode(pairs).alias("p"))
             .groupBy("cluster", "p.k", "p.ck").agg(F.count(F.lit(1)).alias("inter")))
    sizes_long = wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(cluster_col(k)).cast("int").alias("ck"))
                                                  for k in range(2, K + 1)])).alias("p"))
    sizes = sizes_long.groupBy("p.k", "p.ck").agg(F.count(F.lit(1)).alias("size"))
    size_K = sizes.where(F.col("k") == K).select(F.col("ck").alias("cluster"), F.col("size").alias("size_K"))
    # every cluster number 0..k-1 of every earlier partition is a candidate
    grid = (size_K.select("cluster", "size_K", F.explode(F.sequence(F.lit(2), F.lit(K - 1))).alias("k"))
            .select("cluster", "size_K", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("ck")))
    g = (grid.join(inter, ["cluster", "k", "ck"], "left").join(sizes.withColumnRenamed("size", "size_prev"), ["k", "ck"], "left")
         .fillna(0, ["inter", "size_prev"]))
    g = g.withColumn("match", _value(metric, F.col("inter").cast("double"), F.col("size_K").cast("double"),
                                     F.col("size_prev").cast("double")))
    best = g.where(F.col("match").isNotNull()).groupBy("cluster", "k").agg(
        F.max(F.struct(F.col("match"), (-F.col("ck")).alias("neg"))).alias("b"))
    return best.select("cluster", "k", (-F.col("b.neg")).alias("best_cluster"), F.col("b.match").alias("match"))


# T3 -----------------------------------------------------------------------------------
def tbc_candidates(matches: DataFrame, threshold: float) -> DataFrame:
    """Clusters whose mean best match over the earlier partitions reaches
    the threshold -> ``(cluster, mean_match)``."""
    m = matches.groupBy("cluster").agg(F.avg("match").alias("mean_match"))
    return m.where(F.col("mean_match") >= F.lit(float(threshold)))


# T4 -----------------------------------------------------------------------------------
def tbc_output(wide: DataFrame, candidates: DataFrame, K: int, key: str = "row_id") -> DataFrame:
    """One row per instance of a candidate cluster: index, cluster name
    ``partition_k_K_cluster_c`` and the mean match."""
    c = wide.select(key, F.col(cluster_col(K)).cast("int").alias("cluster")).join(candidates, "cluster")
    name = F.concat(F.lit(f"partition_k_{K}_cluster_"), F.col("cluster").cast("string"))
    return c.select(F.col(key).alias("instance_index"), name.alias("cluster_name"), "mean_match")


# T5 -----------------------------------------------------------------------------------
def trace_based_clustering(df: DataFrame, features: Sequence[str], K: int, metric: str, seed: int, threshold: float,
                           key: str = "row_id") -> DataFrame:
    _check(K, metric)
    wide = cut_lineage(tbc_partitions(df, features, K, seed, key))   # read for sizes, overlaps and output
    cands = tbc_candidates(tbc_matches(wide, K, metric), threshold)
    return tbc_output(wide, cands, K, key)
