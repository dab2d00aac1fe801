"""Clusters of lanes and their statistics."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spec import hcm_type


def kmeans(index: DataFrame, k: int = 6, seed: int = 42) -> DataFrame:
    """lane and cluster of each row."""
    rows = index.select("lane", array_to_vector("e").alias("features"))
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).select("lane", F.col("prediction").alias("cluster"))


def layout(index: DataFrame, k: int = 2) -> DataFrame:
    """lane and its coordinates on the first principal components."""
    rows = index.select("lane", array_to_vector("e").alias("features"))
    out = PCA(k=k, inputCol="features", outputCol="xy").fit(rows).transform(rows)
    return out.select("lane", vector_to_array("xy").alias("xy"))


def cluster_stats(rows: DataFrame) -> DataFrame:
    """Statistics of each cluster but noise (-1): rows have cluster, speed, density, rank, is_left, is_right."""
    edges = (F.sum(F.col("is_left").cast("int")) + F.sum(F.col("is_right").cast("int"))) / (2 * F.count("*"))
    out = rows.where("cluster <> -1").groupBy("cluster").agg(F.count("*").alias("n_lanes"), F.avg("speed").alias("mean_speed"), F.avg("density").alias("mean_density"), F.avg("rank").alias("mean_lat_rank"), edges.alias("edge_ratio"))
    return out.withColumn("inferred_type", hcm_type(F.col("mean_speed"), F.col("mean_density"), F.col("edge_ratio")))
