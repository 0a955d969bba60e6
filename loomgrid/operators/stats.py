"""Band statistics: standardising, covariances, the shift-difference noise field, scaling of features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def standardize(bands: DataFrame, key: str = "p") -> DataFrame:
    """(key, k, z): each band less its mean over its population deviation; a constant band is only centred."""
    stat = bands.groupBy("k").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    z = (F.col("x") - F.col("mu")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    return bands.join(F.broadcast(stat), "k").select(key, "k", z.alias("z"))


def _joined(x: tuple[int, np.ndarray, np.ndarray], y: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, Gram matrix of the rows less their means) of two sets together."""
    if not x[0] or not y[0]:
        return x if x[0] else y
    n, step = x[0] + y[0], y[1] - x[1]
    return n, x[1] + step * (y[0] / n), x[2] + y[2] + np.outer(step, step) * (x[0] * y[0] / n)


def centred_moments(vectors: DataFrame, vector: str = "v") -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, Gram matrix of the vectors less their means) in one pass: each task centres its batches on their own means and joins
    them, and the tasks' results, d x d numbers each, meet by twos in a tree, so bands of large values and small variance don't cancel."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = 0, np.zeros(0), np.zeros((0, 0))
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                mean = x.mean(0)
                x = x - mean
                held = _joined(held, (len(x), mean, x.T @ x))
        yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1].tobytes()], pa.binary()), pa.array([held[2].tobytes()], pa.binary())], names=["n", "mean", "gram"])

    def read(r) -> tuple[int, np.ndarray, np.ndarray]:
        mean = np.frombuffer(r["mean"])
        return r["n"], mean, np.frombuffer(r["gram"]).reshape(len(mean), len(mean))

    parts = vectors.select(vector).mapInArrow(part, "n long, mean binary, gram binary").rdd.map(read)
    return parts.treeReduce(_joined) if parts.getNumPartitions() else (0, np.zeros(0), np.zeros((0, 0)))


def covariance_matrix(vectors: DataFrame, vector: str = "v") -> np.ndarray:
    """Covariance of the vector's elements, over n - 1."""
    n, _, g = centred_moments(vectors, vector)
    return g / (n - 1)


def covariance_pairs(vectors: DataFrame, vector: str = "v") -> DataFrame:
    """(k1, k2, c) for k1 <= k2: the covariance matrix as a table, d x d numbers whatever the rows."""
    c = covariance_matrix(vectors, vector)
    return vectors.sparkSession.createDataFrame([(a, b, float(c[a, b])) for a in range(len(c)) for b in range(a, len(c))], "k1 int, k2 int, c double")


def shift_noise(raster: DataFrame) -> DataFrame:
    """(p, d) of (p, i, j, v): half the step from the pixel above plus half the step to the pixel on the right, band by band; none at the
    border. Windows pass whole vectors."""
    half = lambda y: F.zip_with("v", y, lambda a, b: (a - b) / 2)  # noqa: E731  # null beyond the border
    up = raster.select("p", "i", "j", "v", F.lag("v").over(Window.partitionBy("j").orderBy("i")).alias("up"))
    both = up.withColumn("right", F.lead("v").over(Window.partitionBy("i").orderBy("j")))
    none = F.transform("v", lambda x: F.lit(0.0))
    d = F.zip_with(F.coalesce(half("up"), none), F.coalesce(half("right"), none), lambda x, y: x + y)
    return both.select("p", d.alias("d"))


def explained(variances: DataFrame, target: float) -> DataFrame:
    """(rank, k, ratio, cum, keep) of (k, variance): the largest first; kept up to the first that passes the target, none if it is never passed."""
    total = variances.agg(F.sum("variance").alias("total"))
    order = Window.orderBy(F.desc("variance"), "k")  # as many rows as bands
    ratio = variances.crossJoin(F.broadcast(total)).select("k", "variance", (F.col("variance") / F.col("total")).alias("ratio"))
    cum = ratio.select(F.row_number().over(order).alias("rank"), "k", "ratio", F.sum("ratio").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))
    first = cum.where(F.col("cum") > target).agg(F.min("rank").alias("first"))
    return cum.crossJoin(F.broadcast(first)).select("rank", "k", "ratio", "cum", F.coalesce(F.col("rank") <= F.col("first"), F.lit(False)).alias("keep"))


def scale_features(features: DataFrame, value: str, key: str = "sp") -> DataFrame:
    """(key, k, f): each feature scaled to [-1, 1] over all nodes; a constant one becomes -1."""
    span = features.groupBy("k").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    f = F.when(F.col("hi") == F.col("lo"), -1.0).otherwise(2 * (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) - 1)
    return features.join(F.broadcast(span), "k").select(key, "k", f.alias("f"))
