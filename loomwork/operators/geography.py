"""Survey coordinates of countries and clusters: weighted means, centroids, nearest centroid, distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_mean(x: str, w: str) -> Column:
    """Nulls of the measure count in neither sum; null if nothing is left."""
    return F.try_divide(F.sum(F.col(x) * F.col(w)), F.sum(F.when(F.col(x).isNotNull(), F.col(w))))


def country_means(df: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted means of x and y with a denominator each; n counts all respondents. Countries without any value go."""
    out = df.groupBy(*keys).agg(weighted_mean("x", "w").alias("x"), weighted_mean("y", "w").alias("y"), F.count("*").alias("n"))
    return out.where("x is not null and y is not null")


def centroids(countries: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Respondent-weighted centre of the countries with a published cluster."""
    return countries.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(weighted_mean("x", "n").alias("cx"), weighted_mean("y", "n").alias("cy"))


def assign_nearest(countries: DataFrame, centres: DataFrame) -> DataFrame:
    """Countries without a cluster get the one with the nearest centre, the first by name on ties; ``inferred`` marks them.

    Both sides are dimensions (a row per country, a row per cluster).
    """
    lost = countries.where("cluster is null").drop("cluster")
    d = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
    near = lost.crossJoin(F.broadcast(centres)).groupBy("country").agg(F.min_by("cluster", F.struct(d.alias("d"), F.col("cluster"))).alias("cluster"))
    found = lost.join(near, "country", "left").withColumn("inferred", F.lit(True))
    return countries.where("cluster is not null").withColumn("inferred", F.lit(False)).unionByName(found)


def with_distance(countries: DataFrame, centres: DataFrame, anchor: str) -> DataFrame:
    point = centres.where(F.col("cluster") == anchor).select(F.col("cx").alias("ax"), F.col("cy").alias("ay")).limit(1)
    return countries.crossJoin(F.broadcast(point)).withColumn("distance", F.hypot(F.col("x") - F.col("ax"), F.col("y") - F.col("ay"))).drop("ax", "ay")


def augment(countries: DataFrame, published: DataFrame) -> DataFrame:
    """Published countries that the survey lacks, with null coordinates, after the surveyed ones."""
    lacking = published.join(countries, "country", "left_anti")
    return countries.unionByName(lacking, allowMissingColumns=True)


def cluster_summary(countries: DataFrame, anchor: str) -> DataFrame:
    """Centre, distance, sizes and members (sorted, joined by ';') by cluster, over all assigned countries."""
    rows = countries.groupBy("cluster").agg(
        weighted_mean("x", "n").alias("cx"), weighted_mean("y", "n").alias("cy"), F.count("*").alias("n_countries"), F.sum("n").alias("n_respondents"),
        F.count(F.when(F.col("inferred"), 1)).alias("n_inferred"), F.array_join(F.array_sort(F.collect_list("country")), ";").alias("countries"),
    )
    return with_distance(rows.withColumnsRenamed({"cx": "x", "cy": "y"}), rows, anchor)
