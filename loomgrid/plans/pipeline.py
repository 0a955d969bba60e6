"""The classification pipeline: reduce, segment, describe superpixels, build the graph, spread labels, score."""

from __future__ import annotations

import argparse
import logging
import random
import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.operators import evaluate, features, graph, lcmr, neighbourhood, reduce, render, segment, stats
from loomgrid.sources.raster import from_scene
from loomgrid.sources.stored import stored

#: Superpixels asked for, and the ranges of the feature mix and of the log10 spatial decay, by scene.
SCENE_PARAMETERS = {
    "Indiana": (1200, (0.89, 0.9), (-0.8, -0.6)),
    "PaviaU": (2400, (0.09, 0.1), (2.5, 3.0)),
    "Salinas": (1500, (0.89, 0.9), (0.8, 1.3)),
}
#: Ranges that a run's kernel width and label pull are drawn from.
SIGMAS, MUS = (0.19, 0.20), (0.1, 0.15)


@dataclass(frozen=True)
class Config:
    """Midpoints of the ranges are the defaults. The sample of each run is drawn by the seed and the run; so are ``sigma`` and ``mu`` if ``draw``."""

    superpixels: int = 1200
    pca_variance: float = 0.998
    components: int = 20
    window: int = 25
    window_neighbours: int = 400
    compactness: float = 4.0
    merging: bool = True
    labelled: int = 15
    runs: int = 1
    mix: float = 0.895
    sigma: float = 0.195
    sigma_l: float = 10**-0.7
    mu: float = 0.125
    neighbours: int = 8
    h: float = 15.0
    seed: int = 7
    keep_small: bool = False
    draw: bool = False

    @classmethod
    def of_scene(cls, name: str, seed: int = 7, draw: bool = False) -> Config:
        """The scene's parameters: midpoints of their ranges, or drawn from them by the seed."""
        k, mix, decay = SCENE_PARAMETERS[name]
        pick = random.Random(seed).uniform if draw else lambda low, high: (low + high) / 2
        return cls(superpixels=k, mix=pick(*mix), sigma_l=10 ** pick(*decay), seed=seed, draw=draw)

    def of_run(self, run: int) -> tuple[float, float]:
        """(sigma, mu) of a run."""
        r = random.Random(f"{self.seed}:{run}")
        return (r.uniform(*SIGMAS), r.uniform(*MUS)) if self.draw else (self.sigma, self.mu)


def describe(raster: DataFrame, config: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(means, weighted features, centroids) of the superpixels ``sp`` of a raster with bands ``v``, both scaled to [-1, 1]."""
    mean = features.mean_feature(raster)
    weights = features.neighbour_weights(mean, neighbourhood.adjacency(raster), config.h)
    weighted = features.weighted_feature(mean, weights)
    return graph.packed(stats.scale_features(mean, "mu"), "f"), graph.packed(stats.scale_features(weighted, "wmu"), "f"), features.centroids(raster)


def classify(raster: DataFrame, config: Config, maps: dict[int, DataFrame] | None = None) -> DataFrame:
    """(run, metric, cls, value): oa, kappa and recall by class of each run on a raster with ``gt`` and superpixels ``sp``. ``maps`` gets the
    pixels (i, j, gt, pred) of each run."""
    raster = stored(raster, "raster")
    mean, weighted, centroids = (stored(x, "features") for x in describe(raster, config))
    edges, built = None, None
    nodes = raster.select(F.col("sp").alias("node")).distinct()
    out = None
    for run in range(config.runs):
        sigma, mu = config.of_run(run)
        if sigma != built:
            edges, built = stored(graph.fcf_graph(mean, weighted, centroids, sigma, config.sigma_l, config.mix, config.neighbours), "graph"), sigma
        sample = features.stratified_sample(raster, config.labelled, config.seed + run, keep_small=config.keep_small)
        labels = features.node_labels(raster, sample).select(F.col("sp").alias("node"), "cls", F.col("n").alias("y"))
        cls = graph.classify(graph.lgc(edges, labels, mu), nodes).withColumnRenamed("node", "sp")
        if maps is not None:
            maps[run] = stored(evaluate.back_project(raster.select("i", "j", "gt", "sp"), cls).select("i", "j", "gt", "pred"), "map")
        pixels = evaluate.tested(evaluate.back_project(raster.select("p", "gt", "sp"), cls), sample)
        none = F.lit(None).cast("int")
        rows = evaluate.overall_accuracy(pixels).select(F.lit("oa").alias("metric"), none.alias("cls"), F.col("oa").alias("value"))
        rows = rows.unionByName(evaluate.kappa(evaluate.confusion(pixels)).select(F.lit("kappa").alias("metric"), none.alias("cls"), F.col("kappa").alias("value")))
        rows = rows.unionByName(evaluate.class_recall(pixels).select(F.lit("recall").alias("metric"), "cls", F.col("recall").alias("value")))
        rows = rows.select(F.lit(run).alias("run"), "metric", "cls", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def run_pipeline(raster: DataFrame, config: Config, maps: dict[int, DataFrame] | None = None) -> DataFrame:
    """From a raster (p, i, j, gt, v) to the runs' metrics, and their ``maps`` if asked for. The seconds of each step go to this module's log."""
    began = [time.time()]

    def log(step: str) -> None:
        began.append(time.time())
        logging.getLogger(__name__).info("%s: %.1f s", step, began[-1] - began[-2])

    pc = stored(reduce.pca(raster, config.pca_variance), "components")
    log("components")
    logs = stored(lcmr.log_matrices(reduce.mnf(raster, config.components), "mnf", config.window, config.window_neighbours), "log-matrices")
    log("covariance matrices")
    pixels = pc.select("p", "i", "j", F.col("pc").alias("v")).join(logs, "p")
    superpixels = segment.segment(pixels, config.superpixels, config.compactness, config.merging)
    log("segmentation")
    labelled = pc.select("p", "i", "j", "gt", F.col("pc").alias("v")).join(superpixels.select("p", "sp"), "p")
    metrics = stored(classify(labelled, config, maps), "metrics")
    log("graph and classification")
    return metrics


def write_maps(metrics: DataFrame, maps: dict[int, DataFrame], folder: str, name: str) -> list[str]:
    """Pictures of the run of largest overall accuracy, the whole map and that with the background masked; their paths."""
    spark = metrics.sparkSession
    best = evaluate.best_run(metrics).first()
    out = []
    for kind, masked in (("full", False), ("masked", True)):
        out.append(f"{folder}/{name}_{kind}_{100 * best['oa']:.2f}.png")
        render.write_png(render.class_map(maps[best["run"]], render.palette(spark, name), masked), out[-1])
    return out


def main(argv: list[str] | None = None) -> DataFrame:
    """Command line: a scene's files to printed accuracy."""
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("--dataset", default="Indiana", choices=sorted(SCENE_PARAMETERS))
    a.add_argument("--folder", default=".")
    a.add_argument("--pca-v", "--pca-variance", dest="pca_variance", type=float, default=0.998)
    a.add_argument("--cm-feats", dest="components", type=int, default=20)
    a.add_argument("--cm-size", dest="window", type=int, default=25)
    a.add_argument("--cm-nn", dest="window_neighbours", type=int, default=400)
    a.add_argument("--run-n", dest="runs", type=int, default=1)
    a.add_argument("--num-labeled", dest="labelled", type=int, default=15)
    a.add_argument("--draw", action="store_true", help="draw the parameters from their ranges by the seed, instead of the midpoints")
    a.add_argument("--seed", type=int, default=7)
    a.add_argument("--maps", help="folder for pictures of the best run")
    args = vars(a.parse_args(argv))
    logging.basicConfig(level=logging.WARNING)
    logging.getLogger(__name__).setLevel(logging.INFO)
    name, folder, draw, seed, pictures = (args.pop(x) for x in ("dataset", "folder", "draw", "seed", "maps"))
    spark = SparkSession.builder.getOrCreate()
    maps: dict[int, DataFrame] | None = {} if pictures else None
    metrics = run_pipeline(from_scene(spark, folder, name), replace(Config.of_scene(name, seed, draw), **args), maps)
    if maps:
        for path in write_maps(metrics, maps, pictures, name):
            print(path)
    summary = evaluate.run_summary(metrics)
    for r in summary.orderBy("metric").collect():
        print(f"{r['metric']}: {r['mean']:,.2f} ± {r['std']:,.2f}")
    return summary


if __name__ == "__main__":
    main()
