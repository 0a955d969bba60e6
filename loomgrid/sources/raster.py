"""Raster tables: one row a pixel, (p, i, j, gt, v) with p = i * width + j and v the bands.

Readers: Parquet tables of that shape, MAT-files (version 5) of the five known scenes, and the view
of an embeddings table as a raster of 25 columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.sources import mat

WIDTH = 25
SHIFT = 0.5

#: File and key of the cube and of the ground truth of each scene.
SCENES = {
    "PaviaU": ("PaviaUni/PaviaU.mat", "paviaU", "PaviaUni/PaviaU_gt.mat", "paviaU_gt"),
    "Indiana": ("Indiana/Indian_pines_corrected.mat", "indian_pines_corrected", "Indiana/Indian_pines_gt.mat", "indian_pines_gt"),
    "Salinas": ("Salinas/Salinas_corrected.mat", "salinas_corrected", "Salinas/Salinas_gt.mat", "salinas_gt"),
    "Botswana": ("Botswana/Botswana.mat", "Botswana", "Botswana/Botswana_gt.mat", "Botswana_gt"),
    "KSC": ("KSC/KSC.mat", "KSC", "KSC/KSC_gt.mat", "KSC_gt"),
}


def from_embeddings(embeddings: DataFrame, width: int = WIDTH, shift: float = SHIFT) -> DataFrame:
    """(p, i, j, gt, gt_full, v, sp): vectors in the order of (label, vec_id), bands of the label raised by ``shift``,
    one pixel in seven background, sp blocks of five by five pixels.

    Positions are counted within each label and offset by the labels before it, so labels are numbered in parallel.
    """
    own = Window.partitionBy("label").orderBy("vec_id")
    sizes = embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.label") < F.col("a.label"), "left").groupBy("a.label").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("base"))
    px = embeddings.withColumn("at", F.row_number().over(own)).join(F.broadcast(before), "label")
    px = px.withColumn("p", (F.col("base") + F.col("at") - 1).cast("int"))
    i, j = F.floor(F.col("p") / width).cast("int"), F.pmod(F.col("p"), F.lit(width))
    v = F.transform("embedding", lambda x, k: x.cast("double") + F.when(k % 10 == F.col("label"), shift).otherwise(0.0))
    sp = (F.floor(F.col("p") / (5 * width)) * (width // 5) + F.floor(j / 5)).cast("int")
    return px.select("p", i.alias("i"), j.alias("j"), F.when(F.col("vec_id") % 7 == 0, 0).otherwise(F.col("label") + 1).cast("int").alias("gt"), (F.col("label") + 1).cast("int").alias("gt_full"), v.alias("v"), sp.alias("sp"))


def bands(raster: DataFrame, vector: str = "v") -> DataFrame:
    """The long form: the raster's other columns, band k and value x."""
    rest = [c for c in raster.columns if c != vector]
    return raster.select(*rest, F.posexplode(vector).alias("k", "x"))


def from_arrays(spark: SparkSession, cube: np.ndarray, truth: np.ndarray | None = None) -> DataFrame:
    """A cube held by the driver as a raster table."""
    height, width, depth = cube.shape
    flat = cube.reshape(-1, depth).astype(float)
    gt = np.zeros(height * width, int) if truth is None else truth.reshape(-1).astype(int)
    rows = [(p, p // width, p % width, int(gt[p]), flat[p].tolist()) for p in range(height * width)]
    return spark.createDataFrame(rows, "p int, i int, j int, gt int, v array<double>")


def from_files(spark: SparkSession, cube: tuple[str, str], truth: tuple[str, str]) -> DataFrame:
    """A raster table of the arrays (path, key) of two MAT-files, bands and ground truth; a pixel that the latter lacks is background,
    and where it is NaN there is no pixel."""
    v = mat.pixels(spark, *cube)
    gt = mat.pixels(spark, *truth, "g").select("i", "j", F.get("g", 0).alias("gt"))
    width = v.agg(F.max("j")).first()[0] + 1
    return v.join(gt, ["i", "j"], "left").where(~F.isnan(F.coalesce("gt", F.lit(0.0)))).select((F.col("i") * width + F.col("j")).cast("int").alias("p"), "i", "j", F.coalesce(F.col("gt").cast("int"), F.lit(0)).alias("gt"), "v")


def from_scene(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A known scene's MAT-files under ``folder``; an unknown name is an error."""
    if name not in SCENES:
        raise ValueError(f"unknown scene {name!r}; known: {', '.join(SCENES)}")
    cube, cube_key, truth, truth_key = SCENES[name]
    return from_files(spark, (f"{folder}/{cube}", cube_key), (f"{folder}/{truth}", truth_key))
