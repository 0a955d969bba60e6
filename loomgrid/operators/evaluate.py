"""Scores of a classification: confusion, accuracy, kappa, recall, coverage, errors by region, summaries of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tested(pixels: DataFrame, sample: DataFrame) -> DataFrame:
    """Pixels that count: not background, not among the sampled ones."""
    return pixels.where("gt > 0").join(sample.select("p"), "p", "left_anti")


def mask_sampled(raster: DataFrame, sample: DataFrame) -> DataFrame:
    """The raster with sampled pixels as background."""
    mark = sample.select("p", F.lit(True).alias("sampled"))
    return raster.join(mark, "p", "left").withColumn("gt", F.when(F.col("sampled"), 0).otherwise(F.col("gt"))).drop("sampled")


def back_project(raster: DataFrame, nodes: DataFrame, label: str = "sp", cls: str = "cls") -> DataFrame:
    """The raster with ``pred``, its superpixel's class; null where the superpixel has none."""
    own = nodes.select(F.col("sp").alias(label), F.col(cls).alias("pred"))
    return raster.join(own, label, "left")


def confusion(pixels: DataFrame) -> DataFrame:
    """(pred, gt, n)."""
    return pixels.groupBy("pred", "gt").agg(F.count(F.lit(1)).alias("n"))


def overall_accuracy(pixels: DataFrame) -> DataFrame:
    return pixels.agg(F.avg((F.col("pred") == F.col("gt")).cast("double")).alias("oa"))


def kappa(counts: DataFrame) -> DataFrame:
    """(kappa) of a confusion table."""
    total = counts.agg(F.sum("n").cast("double").alias("t"), F.sum(F.when(F.col("pred") == F.col("gt"), F.col("n")).otherwise(0)).cast("double").alias("hit"))
    by_pred = counts.groupBy(F.col("pred").alias("c")).agg(F.sum("n").cast("double").alias("a"))
    by_truth = counts.groupBy(F.col("gt").alias("c")).agg(F.sum("n").cast("double").alias("b"))
    chance = by_pred.join(by_truth, "c").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0.0)).alias("ab"))
    po, pe = F.col("hit") / F.col("t"), F.col("ab") / (F.col("t") * F.col("t"))
    return total.crossJoin(chance).select(((po - pe) / (1 - pe)).alias("kappa"))


def class_recall(pixels: DataFrame) -> DataFrame:
    """(cls, recall)."""
    return pixels.groupBy(F.col("gt").alias("cls")).agg(F.avg(F.coalesce((F.col("pred") == F.col("gt")).cast("double"), F.lit(0.0))).alias("recall"))


def coverage(pixels: DataFrame) -> DataFrame:
    """(count_out, count_in, accuracy, coverage): labelled pixels, those whose node has a class, and how many of them are right; null without any."""
    inside = (F.col("gt") != 0) & (F.coalesce("pred", F.lit(0)) != 0)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    s = pixels.agg(one(F.col("gt") != 0).alias("count_out"), one(inside).alias("count_in"), one(inside & (F.col("pred") == F.col("gt"))).alias("hit"))
    return s.select("count_out", "count_in", F.try_divide("hit", "count_in").alias("accuracy"), F.try_divide("count_in", "count_out").alias("coverage"))


def spreading_accuracy(pixels: DataFrame) -> DataFrame:
    """(spread, accuracy, false_positive): pixels that have both labels, how many agree, and those labelled on background."""
    both = (F.col("pred") != 0) & (F.col("gt") != 0)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    s = pixels.agg(one(both).alias("spread"), one(both & (F.col("pred") == F.col("gt"))).alias("hit"), one((F.col("pred") != 0) & (F.col("gt") == 0)).alias("false_positive"))
    return s.select("spread", F.try_divide("hit", "spread").alias("accuracy"), "false_positive")


def region_errors(pixels: DataFrame, label: str = "sp") -> DataFrame:
    """(sp, errors)."""
    wrong = (F.col("gt") != 0) & (F.col("gt") != F.col("pred"))
    return pixels.groupBy(F.col(label).alias("sp")).agg(F.sum(F.when(wrong, 1).otherwise(0)).alias("errors"))


def run_summary(metrics: DataFrame) -> DataFrame:
    """(metric, mean, std) in percent of (run, metric, cls, value) with metrics oa, kappa and recall by class.

    Deviations are of the population. aa is the mean of the classes' means, and its deviation that across classes.
    """
    each = metrics.groupBy("metric", "cls").agg((100 * F.avg("value")).alias("mean"), (100 * F.stddev_pop("value")).alias("std"))
    named = each.select(F.when(F.col("metric") == "recall", F.concat(F.lit("recall_"), F.col("cls"))).otherwise(F.col("metric")).alias("metric"), "mean", "std")
    aa = each.where("metric = 'recall'").agg(F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("std")).select(F.lit("aa").alias("metric"), "mean", "std")
    return named.unionByName(aa)


def best_run(metrics: DataFrame) -> DataFrame:
    """(run, oa): the run of the largest overall accuracy, the first of equal ones."""
    best = F.max(F.struct("value", (-F.col("run")).alias("r")))
    return metrics.where("metric = 'oa'").agg(best.alias("b")).select((-F.col("b.r")).alias("run"), F.col("b.value").alias("oa"))
