"""Clusters of feature vectors: principal components, then k-means, both by Spark ML."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F


def clustered(rows: DataFrame, components: int, clusters: int, seed: int = 0) -> DataFrame:
    """(image_id, cluster) of rows (image_id, v); vectors with missing numbers are left out."""
    whole = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))
    x = rows.where(whole).select("image_id", array_to_vector("v").alias("features"))
    small = PCA(k=components, inputCol="features", outputCol="parts").fit(x).transform(x).select("image_id", "parts")
    model = KMeans(k=clusters, seed=seed, featuresCol="parts", predictionCol="cluster").fit(small)
    return model.transform(small).select("image_id", "cluster")
