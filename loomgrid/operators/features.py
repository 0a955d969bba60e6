"""Superpixel aggregates: class counts, means, weighted neighbour features, centroids, sampling, node labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.operators import sums


def class_counts(raster: DataFrame, label: str = "sp", truth: str = "gt") -> DataFrame:
    """(sp, cls, n): pixels of each class in each superpixel, background included."""
    return raster.groupBy(F.col(label).alias("sp"), F.col(truth).alias("cls")).agg(F.count(F.lit(1)).alias("n"))


def majority(counts: DataFrame) -> DataFrame:
    """(sp, cls, n): the most frequent class, the lowest of equal ones."""
    best = F.max(F.struct("n", (-F.col("cls")).alias("c")))
    return counts.groupBy("sp").agg(best.alias("b")).select("sp", (-F.col("b.c")).alias("cls"), F.col("b.n").alias("n"))


def purity(counts: DataFrame) -> DataFrame:
    """(sp, size, purity)."""
    return counts.groupBy("sp").agg(F.sum("n").alias("size"), (F.max("n") / F.sum("n")).alias("purity"))


def mean_feature(raster: DataFrame, label: str = "sp", vector: str = "v") -> DataFrame:
    """(sp, k, mu): means of the vectors of each superpixel, added up as whole vectors. Pixels without a superpixel take no part."""
    rows = raster.where(F.col(label).isNotNull()).select(F.col(label).alias("sp"), F.lit(1).cast("long").alias("n"), F.col(vector).alias("v"))
    total = sums.by_key(rows, "sp", ["n"], ["v"])
    return total.select("sp", F.posexplode(F.transform("v", lambda x: x / F.col("n"))).alias("k", "mu"))


def neighbour_weights(means: DataFrame, edges: DataFrame, h: float = 15.0) -> DataFrame:
    """(src, dst, w): exp(-squared distance of the means / h)."""
    a = means.select(F.col("sp").alias("src"), "k", F.col("mu").alias("a"))
    b = means.select(F.col("sp").alias("dst"), "k", F.col("mu").alias("b"))
    d2 = edges.join(a, "src").join(b, ["dst", "k"]).groupBy("src", "dst").agg(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("d2"))
    return d2.select("src", "dst", F.exp(-F.col("d2") / h).alias("w"))


def weighted_feature(means: DataFrame, weights: DataFrame) -> DataFrame:
    """(sp, k, wmu): mean of the neighbours' means by weight; a node without neighbours, or of zero weights, keeps its own mean."""
    near = weights.join(means.select(F.col("sp").alias("dst"), "k", "mu"), "dst")
    mixed = near.groupBy(F.col("src").alias("sp"), "k").agg(F.sum(F.col("w") * F.col("mu")).alias("s"), F.sum("w").alias("w"))
    out = means.join(mixed, ["sp", "k"], "left")
    return out.select("sp", "k", F.when(F.coalesce("w", F.lit(0.0)) > 0, F.col("s") / F.col("w")).otherwise(F.col("mu")).alias("wmu"))


def centroids(raster: DataFrame, label: str = "sp") -> DataFrame:
    """(sp, ci, cj)."""
    return raster.groupBy(F.col(label).alias("sp")).agg(F.avg("i").alias("ci"), F.avg("j").alias("cj"))


def stratified_sample(raster: DataFrame, n: int, seed: int, truth: str = "gt", keep_small: bool = False) -> DataFrame:
    """(p, cls): n pixels of each class, by the smallest digest of p and the seed, so that draws of different seeds are
    independent. A class of n pixels or fewer loses all of them, or keeps them if ``keep_small``."""
    px = raster.where(F.col(truth) > 0).select("p", F.col(truth).alias("cls"), F.md5(F.concat_ws(":", F.col("p").cast("string"), F.lit(str(seed)))).alias("turn"))
    chosen = px.withColumn("rn", F.row_number().over(Window.partitionBy("cls").orderBy("turn", "p"))).where(F.col("rn") <= n)
    if not keep_small:
        chosen = chosen.join(px.groupBy("cls").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > n), "cls")
    return chosen.select("p", "cls")


def node_labels(raster: DataFrame, sample: DataFrame, label: str = "sp") -> DataFrame:
    """(sp, cls, n): sampled pixels of each class in each superpixel."""
    return raster.select("p", F.col(label).alias("sp")).join(sample, "p").groupBy("sp", "cls").agg(F.count(F.lit(1)).alias("n"))


def node_probabilities(labels: DataFrame) -> DataFrame:
    """(sp, cls, prob): shares of the node's labels; a node without labels has no rows."""
    return labels.select("sp", "cls", (F.col("n") / F.sum("n").over(Window.partitionBy("sp"))).alias("prob"))


def distinct_counts(rows: DataFrame, value: str, order: Column) -> DataFrame:
    """(value, n, first): each distinct value, how often, and the least of ``order`` it has."""
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
