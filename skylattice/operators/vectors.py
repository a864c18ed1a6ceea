"""Embedding vectors: seeds, similarity, change and clusters."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.joins import with_single_row
from skylattice.functions.randoms import order_key
from skylattice.operators.learning import dot
from skylattice.session import materialize

# Fixed values.
DIMENSIONS = 64
MIN_K, MAX_K = 2, 12


def checked(vector: Column) -> Column:
    """The vector, or an error when a dimension is missing."""
    bad = (F.size(vector) != DIMENSIONS) | F.exists(vector, lambda x: x.isNull())
    return F.when(bad, F.raise_error(F.lit("seed vector has a missing dimension")).cast("array<float>")).otherwise(vector)


def seed_at(mosaic: DataFrame, points: DataFrame) -> DataFrame:
    """Vector under each point of a seed table; an incomplete vector is an error."""
    return points.join(mosaic, ["pixel_id", "year"]).withColumn("seed", checked(F.col("embedding"))).select(*points.columns, "seed")


def similarity(mosaic: DataFrame, seed: DataFrame) -> DataFrame:
    """Cosine similarity of every pixel to one seed (unit vectors, so a dot product).

    ``seed`` is a single row with the vector in ``seed``; that row is all that is broadcast.
    """
    one = seed.agg(checked(F.first("seed")).alias("seed"))
    return with_single_row(mosaic, one).withColumn("similarity", dot("embedding", "seed")).drop("seed")


def most_similar(mosaic: DataFrame, seed: DataFrame, n: int) -> DataFrame:
    return similarity(mosaic, seed).orderBy(F.desc("similarity"), "pixel_id").limit(n)


def change(mosaic: DataFrame, year_a: int, year_b: int) -> DataFrame:
    """One minus the dot product of a pixel's two years."""
    a = mosaic.where(F.col("year") == year_a).select("pixel_id", F.col("embedding").alias("a"))
    b = mosaic.where(F.col("year") == year_b).select("pixel_id", F.col("embedding").alias("b"))
    return a.join(b, "pixel_id").select("pixel_id", (1.0 - dot("a", "b")).alias("change"))


def cluster(mosaic: DataFrame, k: int, seed: int = 0, sample: int | None = None) -> DataFrame:
    """k-means fitted on all pixels and applied to them; k is held between 2 and 12.

    ``sample`` fits on that many rows instead, picked repeatably. The first centres are drawn per
    partition, so another layout of the rows may end in another local optimum.
    """
    k = max(MIN_K, min(MAX_K, k))
    # every iteration reads the rows again
    features = materialize(mosaic, "vectors").withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    picked = features
    if sample is not None:
        picked = features.orderBy(order_key(seed, F.concat_ws("|", "pixel_id", "year"))).limit(sample)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(picked.select("features"))
    return model.transform(features).drop("features")
