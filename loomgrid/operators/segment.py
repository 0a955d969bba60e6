"""Superpixels: seeds, adaptive boxes, splitting, merging, nearest-centre assignment, update, connectivity, the loop.

Pixels and clusters stay distributed: pixels as a table bucketed by tiles, clusters as a table that each round replaces. The driver sees counts,
the residual and the sizes of ranges.
"""

from __future__ import annotations

import itertools
import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions import vectors as V
from loomgrid.operators import connect, merging, neighbourhood, sums
from loomgrid.sources.stored import ONE_TASK, bucketed, ranked, stored

#: A distance from here on can't win a pixel.
FAR = 10000.0


def grid_step(height: int, width: int, k: int) -> int:
    return int(math.sqrt(height * width / k))


def check_contraction(height: int, width: int, clusters: int) -> None:
    if height * width / clusters < 15:
        raise ValueError("fewer than 15 pixels a superpixel; ask for fewer superpixels")


def seeds(raster: DataFrame, step: int, within: bool = False) -> DataFrame:
    """(c, p, i, j): every step-th pixel of every step-th row from half a step on, numbered row by row. ``within``: a raster no longer than
    half a step along one side has its seeds on the middle of that side, where else it had none."""
    h, w = neighbourhood.extent(raster)
    start = {x: n // 2 if within and step // 2 >= n else step // 2 for x, n in (("i", h), ("j", w))}
    on = lambda x: (F.col(x) >= start[x]) & ((F.col(x) - start[x]) % step == 0)
    across = (w - 1 - start["j"]) // step + 1
    c = F.floor((F.col("i") - start["i"]) / step) * across + F.floor((F.col("j") - start["j"]) / step)
    return raster.where(on("i") & on("j")).select(c.cast("int").alias("c"), "p", "i", "j")


def move_seeds(seed: DataFrame, gradient: DataFrame) -> DataFrame:
    """(c, i, j, g): each seed on the pixel of least gradient among it and its eight neighbours; the seed itself wins ties, then scan order."""
    ring = [(0, 0), *((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)]
    near = neighbourhood.offsets(seed.select("c", "i", "j"), ring)
    g = gradient.select(F.col("i").alias("ni"), F.col("j").alias("nj"), "g")
    best = near.join(g, ["ni", "nj"]).groupBy("c").agg(F.min(F.struct("g", "o", "ni", "nj")).alias("b"))
    return best.select("c", F.col("b.ni").alias("i"), F.col("b.nj").alias("j"), F.col("b.g").alias("g"))


def search_range(area: DataFrame, clusters: int) -> DataFrame:
    """(total, lsr): the area a superpixel's box should span."""
    return area.agg(F.sum("area").alias("total")).select("total", (4 * F.col("total") / clusters).alias("lsr"))


def box_sums(area: DataFrame, step: int) -> DataFrame:
    """(i, j, box): area within ``step`` rows and columns of each pixel, by running sums along rows and then columns: the work of a
    pixel is the same for any step. Pixels that the raster lacks have no row, and no area in other boxes."""
    h, w, n = area.agg(F.max("i") + 1, F.max("j") + 1, F.count(F.lit(1))).first()
    held = area.select("i", "j", "area", F.lit(True).alias("there"))
    if n < h * w:  # runs count rows, so they need every place
        places = area.sparkSession.range(h * w).select(F.floor(F.col("id") / w).cast("int").alias("i"), F.pmod("id", F.lit(w)).cast("int").alias("j"))
        held = held.unionByName(places.join(area.select("i", "j"), ["i", "j"], "left_anti").select("i", "j", F.lit(0.0).alias("area"), F.lit(False).alias("there")))

    def along(df: DataFrame, value: str, x: str, other: str, out: str) -> DataFrame:
        line = Window.partitionBy(other).orderBy(x)
        run = df.withColumn("run", F.sum(value).over(line.rowsBetween(Window.unboundedPreceding, 0)))
        ahead = F.coalesce(F.lead("run", step).over(line), F.last("run").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        before = F.coalesce(F.lag("run", step + 1).over(line), F.lit(0.0))
        return run.withColumn(out, ahead - before).drop("run")

    return along(along(held, "area", "j", "i", "row"), "row", "i", "j", "box").where("there").select("i", "j", "box")


def adaptive_scale(clusters: DataFrame, area: DataFrame, step: int, lsr: float) -> DataFrame:
    """(c, i, j, box, scale): area in the box of ``step`` around the centre, and sqrt(lsr / that)."""
    box = clusters.select("c", "i", "j").join(box_sums(area, step), ["i", "j"])
    return box.select("c", "i", "j", "box", F.sqrt(F.lit(lsr) / F.col("box")).alias("scale"))


def split(clusters: DataFrame, step: int, lsr: float, height: int, width: int, most_scale: float = 0.5, many: int | None = None) -> DataFrame:
    """(c, old, child, i, j, area, scale) of (c, i, j, area, scale): a cluster of small scale and large area becomes four,
    half a scaled step away from its centre; numbers after it move up by three. Others keep child 0. ``many``: how many clusters
    there are, if known."""
    parted = (F.col("scale") < most_scale) & (F.col("area") > lsr / 4)
    off = F.bround(step * F.col("scale") / 2).cast("int")
    up, down = F.greatest(F.col("i") - off, F.lit(0)), F.least(F.col("i") + off, F.lit(height - 1))
    left, right = F.greatest(F.col("j") - off, F.lit(0)), F.least(F.col("j") + off, F.lit(width - 1))
    child = lambda n, i, j: F.struct(F.lit(n).alias("child"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(float(lsr)).alias("area"), (F.col("scale") / 2).alias("scale"))
    four = F.array(child(0, up, right), child(1, up, left), child(2, down, right), child(3, down, left))
    own = F.array(F.struct(F.lit(0).alias("child"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("area").alias("area"), F.col("scale").alias("scale")))
    parts = clusters.select(F.col("c").alias("old"), F.explode(F.when(parted, four).otherwise(own)).alias("x")).select("old", "x.*")
    numbered = ranked(parts, ["old", "child"], "split", many)
    return numbered.select(F.col("place").cast("int").alias("c"), "old", "child", "i", "j", "area", "scale")


def remap(labels: DataFrame, parts: DataFrame) -> DataFrame:
    """(p, c) after a split: an old label becomes its cluster's first child."""
    first = parts.where("child = 0").select(F.col("old").alias("c"), F.col("c").alias("new"))
    return labels.join(first, "c").select("p", F.col("new").alias("c"))


def tile_side(step: int) -> int:
    """Pixels along a tile: a few boxes of usual scale."""
    return max(32, 4 * (step + 1))


def in_tiles(df: DataFrame, side: int) -> DataFrame:
    return df.withColumns({"ti": F.floor(F.col("i") / side).cast("int"), "tj": F.floor(F.col("j") / side).cast("int")})


def gathered(pixels: DataFrame, clusters: DataFrame, step: int, compactness: float, side: int, a1: float = 0.5, a2: float = 0.5) -> DataFrame:
    """(c, n, si, sj, area, v, lcmr, p, dist): a row for each tile and cluster that has pixels in it: how many, sums of their places, areas and
    vectors, and which they are; c is null for those that no cluster reaches.

    ``pixels`` (ti, tj, p, i, j, v, lcmr, area) in tiles of ``side``, ``clusters`` (c, i, j, v, lcmr, scale). A range join by tiles: a cluster
    goes to the tiles its box meets, in which one task takes the boxes one after the other, each as slices of the tile.
    """
    g = step + 1
    reach = F.round(F.col("scale") * g).cast("int")
    low, high = (lambda x: F.floor((x - F.col("reach")) / side).cast("int")), (lambda x: F.floor((x + F.col("reach")) / side).cast("int"))
    boxes = clusters.select(*(F.col(x).alias(x) for x in ("c", "i", "j", "v", "lcmr")), reach.alias("reach"))  # new columns, where both tables come from one
    boxes = boxes.withColumn("ti", F.explode(F.sequence(low(F.col("i")), high(F.col("i"))))).withColumn("tj", F.explode(F.sequence(low(F.col("j")), high(F.col("j")))))
    matrix = lambda t, name: np.stack(t[name].to_numpy()) if t.num_rows else np.zeros((0, 0))

    def solve(px: pa.Table, near: pa.Table) -> pa.Table:
        p, i, j, area = (px[n].to_numpy() for n in ("p", "i", "j", "area"))
        names = ["c", "n", "si", "sj", "area", "v", "lcmr", "p", "dist"]
        if not len(p):  # a box beyond the raster
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), *[pa.list_(pa.float64())] * 2, pa.list_(pa.int32()), pa.list_(pa.float64())]
            return pa.table([pa.array([], k) for k in kinds], names=names)
        v, m = matrix(px, "v"), matrix(px, "lcmr")
        i0, j0 = i.min(), j.min()
        at = np.full((i.max() - i0 + 1, j.max() - j0 + 1), -1)
        at[i - i0, j - j0] = np.arange(len(p))
        best, own = np.full(len(p), FAR), np.full(len(p), -1)
        near = near.sort_by("c")
        cv, cm = matrix(near, "v"), matrix(near, "lcmr")
        for k, (c, ci, cj, r) in enumerate(zip(*(near[n].to_pylist() for n in ("c", "i", "j", "reach")), strict=True)):
            rows = at[max(ci - r - i0, 0) : max(ci + r + 1 - i0, 0), max(cj - r - j0, 0) : max(cj + r + 1 - j0, 0)].ravel()
            rows = rows[rows >= 0]
            far = a1 * np.sqrt(((v[rows] - cv[k]) ** 2).sum(1)) + a2 * np.sqrt(((m[rows] - cm[k]) ** 2).sum(1)) + compactness / g * np.sqrt((i[rows] - ci) ** 2.0 + (j[rows] - cj) ** 2.0)
            won = far < best[rows]
            best[rows[won]], own[rows[won]] = far[won], c
        order = np.argsort(own, kind="stable")
        ids, begin = np.unique(own[order], return_index=True)
        total = lambda x: np.add.reduceat(x[order], begin, axis=0)
        parts = np.split(order, begin[1:])
        lists = lambda x, kind: pa.array([x[rows] for rows in parts], pa.list_(kind))
        columns = [pa.array(ids, pa.int32(), mask=ids < 0), pa.array(np.array([len(x) for x in parts])), pa.array(total(i).astype(np.int64)), pa.array(total(j).astype(np.int64)), pa.array(total(area))]
        columns += [pa.array(list(total(x)), pa.list_(pa.float64())) for x in (v, m)]
        return pa.table([*columns, lists(p, pa.int32()), lists(best, pa.float64())], names=names)

    left = pixels.select("ti", "tj", "p", "i", "j", "v", "lcmr", "area").groupBy("ti", "tj")
    return left.cogroup(boxes.groupBy("ti", "tj")).applyInArrow(solve, "c int, n long, si long, sj long, area double, v array<double>, lcmr array<double>, p array<int>, dist array<double>")


def labelled(rows: DataFrame) -> DataFrame:
    """(p, c, dist) of :func:`gathered`."""
    each = rows.select("c", F.explode(F.arrays_zip("p", "dist")).alias("x"))
    return each.select("x.p", "c", F.when(F.col("c").isNotNull(), F.col("x.dist")).alias("dist"))


def updated(rows: DataFrame, unassigned: int | None = None) -> DataFrame:
    """(c, i, j, n, area, v, lcmr) of :func:`gathered`: rounded mean places (halves away from zero), mean vectors, summed areas. Pixels without a
    cluster take no part, or count for the cluster ``unassigned``."""
    held = rows.select(F.coalesce("c", F.lit(unassigned).cast("int")).alias("c"), "n", "si", "sj", "area", "v", "lcmr").where("c IS NOT NULL")
    total = sums.by_key(held, "c", ["n", "si", "sj", "area"], ["v", "lcmr"])
    mean = lambda x: F.transform(x, lambda y: y / F.col("n")).alias(x)
    return total.select("c", F.round(F.col("si") / F.col("n")).cast("int").alias("i"), F.round(F.col("sj") / F.col("n")).cast("int").alias("j"), "n", "area", mean("v"), mean("lcmr"))


def assign(pixels: DataFrame, clusters: DataFrame, step: int, compactness: float, a1: float = 0.5, a2: float = 0.5) -> DataFrame:
    """(p, c, dist): the nearest of the clusters whose box holds the pixel, the lowest of equal ones; none at FAR or beyond.
    ``pixels`` (p, i, j, v, lcmr), ``clusters`` (c, i, j, v, lcmr, scale)."""
    side = tile_side(step)
    return labelled(gathered(in_tiles(pixels.withColumn("area", F.lit(0.0)), side), clusters, step, compactness, side, a1, a2))


def update(pixels: DataFrame, labels: DataFrame, unassigned: int | None = None) -> DataFrame:
    """(c, i, j, n, area, v, lcmr) of ``pixels`` (p, i, j, v, lcmr, area) and their ``labels`` (p, c), as :func:`updated`."""
    own = pixels.join(labels.select("p", "c"), "p").select("c", F.lit(1).cast("long").alias("n"), F.col("i").cast("long").alias("si"), F.col("j").cast("long").alias("sj"), "area", "v", "lcmr")
    return updated(own, unassigned)


def _moved() -> Column:
    return F.pow(F.col("i") - F.col("i0"), 2) + F.pow(F.col("j") - F.col("j0"), 2) + V.squared_distance(F.col("v"), F.col("v0")) + F.sqrt(V.squared_distance(F.col("lcmr"), F.col("l0")))


def _before(clusters: DataFrame) -> DataFrame:
    return clusters.select("c", F.col("i").alias("i0"), F.col("j").alias("j0"), F.col("v").alias("v0"), F.col("lcmr").alias("l0"))


def residual(old: DataFrame, new: DataFrame) -> DataFrame:
    """(err): over clusters with pixels, squared change of place and vector plus the length of the matrix's change."""
    return new.join(_before(old), "c").agg(F.coalesce(F.sum(_moved()), F.lit(0.0)).alias("err"))


def reseeded(places: DataFrame, step: int, height: int, width: int) -> DataFrame:
    """``places`` (c, i, j) of clusters without pixels, moved by a quarter step; what leaves the raster goes to the third row or column
    before its end."""
    nudge = round(step / 4)
    moved = lambda x, n: F.when(F.col(x) + nudge > n - 1, max(n - 3, 0)).otherwise(F.col(x) + nudge).cast("int")
    return places.withColumns({"i": moved("i", height), "j": moved("j", width)})


def compact(clusters: DataFrame, alive: str = "alive") -> DataFrame:
    """(c, new): surviving clusters numbered from 0 in their order."""
    return ranked(clusters.where(alive).select("c"), ["c"], "compact").select("c", F.col("place").cast("int").alias("new"))


def enforce_connectivity(labels: DataFrame, height: int, width: int, clusters: int, least: int = 8, tile: int = 256) -> DataFrame:
    """(p, i, j, sp) of (p, i, j, c): connected superpixels of at most ten times the mean area; see :func:`connect.connectivity`."""
    return connect.connectivity(labels, width, least, int(10 * height * width / clusters), tile)


def segment(pixels: DataFrame, k: int, compactness: float = 4.0, merging_on: bool = True, most_rounds: int | None = 20, least: int = 8, wrap_unassigned: bool = False, merge_side: int | None = None, tile: int | None = None) -> DataFrame:
    """(p, i, j, sp): superpixels of ``pixels`` (p, i, j, v, lcmr). Each round scales boxes, splits and merges (from the second
    on), assigns and updates, until the residual stops falling; a warning if that takes more than ``most_rounds`` (None: no
    bound). ``wrap_unassigned``: pixels that no box reaches count for the last cluster in the update. A cluster without pixels moves a quarter
    step and takes the vectors of the pixel there.

    Tiles of ``tile`` pixels share out the pixels; clusters merge in tiles of ``merge_side`` pixels, or in one task while one can number
    them. The result doesn't hang on either.
    """
    pixels = stored(pixels.select("p", "i", "j", "v", "lcmr"), "raster")  # read by areas, seeds and tiles
    h, w = neighbourhood.extent(pixels)
    step = grid_step(h, w, k)
    side = tile or tile_side(step)
    area = stored(neighbourhood.manifold_area(pixels, compactness, step), "area")
    held = in_tiles(pixels.join(area.select("p", "area"), "p").join(box_sums(area, step), ["i", "j"]), side)
    held = bucketed(held.select("ti", "tj", "p", "i", "j", "v", "lcmr", "area", "box"), "pixels", ["ti", "tj"])
    place = ["ti", "tj", "i", "j"]
    ends = None if pixels.count() == h * w else stored(pixels.groupBy("j").agg(F.max("i").alias("end")), "ends")

    def there(df: DataFrame, *columns: str) -> DataFrame:
        if ends is not None:  # a place below a column's end, where the last row is a part of one, means that end
            df = df.join(F.broadcast(ends), "j").withColumn("i", F.least("i", "end")).drop("end")
        return in_tiles(df, side).join(held.select(*place, *columns), place).drop("ti", "tj")

    seed = move_seeds(seeds(pixels, step, within=True), neighbourhood.gradient(pixels))
    clusters = stored(there(seed.select("c", "i", "j"), "v", "lcmr", "area").withColumn("scale", F.lit(1.0)), "clusters")
    started = count = clusters.count()
    check_contraction(h, w, count)
    lsr = 4 * held.agg(F.sum("area")).first()[0] / count
    rows, last, ratio = None, math.inf, 0.0
    for turn in itertools.count():
        if not (ratio < 0.99 or ratio > 1 and turn < 2):
            break
        if turn == most_rounds:
            warnings.warn(f"the residual still fell, to {ratio:.4f} of itself, after {most_rounds} rounds", stacklevel=2)
            break
        scaled = there(clusters, "box").withColumn("scale", F.sqrt(F.lit(lsr) / F.col("box"))).drop("box")
        if turn and merging_on:
            parts = split(scaled.select("c", "i", "j", "area", "scale"), step, lsr, h, w, many=count)
            own = clusters.select(F.col("c").alias("old"), "v", "lcmr")
            four = parts.select("old").where("child = 1")
            new = there(parts.join(four, "old"), "v", "lcmr")
            filled = parts.join(four, "old", "left_anti").join(own, "old").unionByName(new)
            first = parts.where("child = 0").select("old", "c")
            touching = neighbourhood.adjacency(labelled(rows).join(held.select("p", "i", "j"), "p"), "c")
            touching = touching.join(first.select(F.col("old").alias("src"), F.col("c").alias("a")), "src").join(first.select(F.col("old").alias("dst"), F.col("c").alias("b")), "dst")
            merged = merging.merge(filled, touching.select(F.col("a").alias("src"), F.col("b").alias("dst")), lsr, merge_side or (None if count <= ONE_TASK else 64 * side))
            scaled = ranked(merged, ["c"], "merged", 4 * count).drop("c").withColumn("c", F.col("place").cast("int")).drop("place")
        clusters = stored(scaled.select("c", "i", "j", "area", "scale", "v", "lcmr"), "clusters")
        count = clusters.count()
        rows = stored(gathered(held, clusters, step, compactness, side), "assigned")
        new = updated(rows, count - 1 if wrap_unassigned else None)
        met = stored(_before(clusters).join(clusters.select("c", "scale"), "c").join(new, "c", "left").withColumn("moved", _moved()), "updated")
        err, full = met.agg(F.coalesce(F.sum("moved"), F.lit(0.0)), F.count("n")).first()
        ratio = 1.0 if err == 0 else 0.0 if math.isinf(last) else err / last
        last = err
        columns = ["c", "i", "j", "area", "scale", "v", "lcmr"]
        clusters = met.where("n IS NOT NULL").select(*columns)
        if full < count:
            empty = reseeded(met.where("n IS NULL").select("c", F.col("i0").alias("i"), F.col("j0").alias("j"), "scale"), step, h, w)
            empty = there(empty, "v", "lcmr").withColumn("area", F.lit(lsr / 4.5))
            clusters = stored(clusters.unionByName(empty.select(*columns)), "clusters")
    labels = labelled(rows).join(held.select("p", "i", "j"), "p").select("p", "i", "j", "c")
    return stored(enforce_connectivity(labels, h, w, started, least), "superpixels")
