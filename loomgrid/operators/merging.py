"""Greedy merging of superpixels in the order of their ids, worked out in parallel.

One after the other, a small cluster that nobody has taken takes the best of its higher neighbours that nobody has taken. So all
that an earlier cluster can change for a later one is to take it, or one of those it would take; clusters further apart don't
matter to each other. Each round every tile walks its own clusters in order and decides those that no undecided cluster before them,
here or in another tile, can still change; the lowest undecided one always can be decided, so rounds end. Chains of clusters that wait
for one another can be as long as the raster, so from round to round tiles become larger, and what one task may hold it walks to the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.functions import vectors as V
from loomgrid.sources.stored import ONE_TASK, stored

#: Wishes of a cluster, as a rule at most; a task walks those of ONE_TASK clusters.
WISHES = 8


def candidates(clusters: DataFrame, edges: DataFrame, lsr: float) -> DataFrame:
    """(a, n, turn): whom each small cluster would take, best first. One of an area below lsr / 32 prefers the nearest colour, one below
    lsr / 5 the least joint area if that stays below lsr / 5; the lower id of equal ones."""
    own = clusters.select(F.col("c").alias("a"), F.col("area").alias("area_a"), F.col("v").alias("v_a")).where(F.col("area_a") < lsr / 5)
    other = clusters.select(F.col("c").alias("n"), F.col("area").alias("area_n"), F.col("v").alias("v_n"))
    met = edges.where("dst > src").select(F.col("src").alias("a"), F.col("dst").alias("n")).distinct().join(own, "a").join(other, "n")
    joint = (F.col("area_a") + F.col("area_n")) / (lsr / 5)
    cost = F.when(F.col("area_a") < lsr / 32, F.sqrt(V.squared_distance(F.col("v_a"), F.col("v_n")))).when(joint < 1, joint)
    each = met.select("a", cost.alias("cost"), "n").where("cost IS NOT NULL").groupBy("a").agg(F.array_sort(F.collect_list(F.struct("cost", "n"))).alias("near"))
    return each.select("a", F.posexplode("near").alias("turn", "x")).select("a", F.col("x.n").alias("n"), "turn")


def walk(wishes: dict[int, list[int]], outside: dict[int, int]) -> list[tuple[int, int]]:
    """(a, n) that are sure: cluster a takes n. ``wishes`` has the undecided clusters of a tile and whom they'd take, best first;
    ``outside`` the lowest undecided cluster of another tile that would take a cluster."""
    none = 1 << 62
    taken: set[int] = set()
    maybe: set[int] = set()
    out = []
    for a in sorted(wishes):
        if a in taken:
            continue
        left = [n for n in wishes[a] if n not in taken]
        if not left:
            continue
        best = left[0]
        free = best not in maybe and outside.get(best, none) > a
        if free and a not in maybe and outside.get(a, none) > a:
            taken.add(best)
            out.append((a, best))
        else:  # it may yet be taken itself, or find its best taken
            maybe.update([best] if free else left)
    return out


def partners(wishes: DataFrame, places: DataFrame, side: int | None) -> DataFrame:
    """(a, n): the merges of ``wishes`` (a, n, turn), as one after the other in the order of a. ``places`` (c, i, j) deals clusters into
    tiles of ``side`` pixels at first, or all into one if None."""
    tile = F.struct(*(F.floor(F.col(x) / (side or 1)).cast("int").alias(x) for x in "ij"))
    made = None

    def decide(own: pa.Table, other: pa.Table) -> pa.Table:
        wishes: dict[int, list[tuple[int, int]]] = {}
        for a, n, turn in zip(*(own[x].to_pylist() for x in ("a", "n", "turn")), strict=True):
            wishes.setdefault(a, []).append((turn, n))
        outside = dict(zip(other["node"].to_pylist(), other["least"].to_pylist(), strict=True))
        sure = np.array(walk({a: [n for _, n in sorted(x)] for a, x in wishes.items()}, outside), np.int64).reshape(-1, 2)
        return pa.table({"a": sure[:, 0], "n": sure[:, 1]})

    if not side:  # nothing is outside, so one walk decides all
        own = wishes.select(F.lit(0).alias("own"), F.col("a").cast("long").alias("a"), F.col("n").cast("long").alias("n"), "turn").groupBy("own")
        return own.applyInArrow(lambda t: decide(t, pa.table({"node": pa.array([], pa.int64()), "least": pa.array([], pa.int64())})), "a long, n long")
    undecided = stored(wishes.join(places.select(F.col("c").alias("a"), tile.alias("tile")), "a"), "wishes")
    wider = F.struct(*(F.floor(F.col(f"tile.{x}") / 2).cast("int").alias(x) for x in "ij"))
    left = undecided.count()
    while left:
        wanted = undecided.groupBy(F.col("n").alias("node"), F.col("tile").alias("from")).agg(F.min("a").alias("least"))
        nodes = undecided.select(F.col("tile").alias("to"), F.explode(F.array("a", "n")).alias("node")).distinct()
        beyond = nodes.join(wanted, "node").where(F.col("to") != F.col("from")).groupBy("to", "node").agg(F.min("least").alias("least"))
        own = undecided.select(F.col("tile").alias("own"), F.col("a").cast("long").alias("a"), F.col("n").cast("long").alias("n"), "turn").groupBy("own")
        sure = stored(own.cogroup(beyond.groupBy("to")).applyInArrow(decide, "a long, n long"), "merges")
        made = sure if made is None else made.unionByName(sure)
        gone = sure.select(F.explode(F.array("a", "n")).alias("a"))
        undecided = stored(undecided.join(gone, "a", "left_anti").join(sure.select("n"), "n", "left_anti").select("a", "n", "turn", "tile"), "wishes")
        left = undecided.count()
        if left <= WISHES * ONE_TASK:
            undecided = undecided.withColumn("tile", F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
        elif undecided.groupBy(wider.alias("tile")).count().agg(F.max("count")).first()[0] <= WISHES * ONE_TASK:
            undecided = undecided.withColumn("tile", wider)
    return wishes.sparkSession.createDataFrame([], "a long, n long") if made is None else made


def merge(clusters: DataFrame, edges: DataFrame, lsr: float, side: int | None = 4096) -> DataFrame:
    """The clusters (c, i, j, area, scale, v, lcmr) that are left, by their old ids. A cluster and the one it takes become the mean of their
    rows by area, rounded (half to even) in i and j alone, with the sum of the areas and the plain mean of the log-matrices."""
    clusters = stored(clusters.select("c", "i", "j", "area", "scale", "v", "lcmr"), "to-merge")
    pairs = stored(partners(candidates(clusters, edges, lsr), clusters.select("c", "i", "j"), side), "pairs")
    other = clusters.select(F.col("c").alias("n"), *(F.col(x).alias(f"{x}_n") for x in ("i", "j", "area", "scale", "v", "lcmr")))
    taking = clusters.withColumnRenamed("area", "area_a").join(pairs.withColumnRenamed("a", "c"), "c").join(other, "n")
    total = F.col("area_a") + F.col("area_n")
    mean = lambda x: (F.col(x) * F.col("area_a") + F.col(f"{x}_n") * F.col("area_n")) / total
    v = F.transform(F.arrays_zip("v", "v_n"), lambda x: (x["v"] * F.col("area_a") + x["v_n"] * F.col("area_n")) / total)
    joined = taking.select("c", F.bround(mean("i")).cast("int").alias("i"), F.bround(mean("j")).cast("int").alias("j"), total.alias("area"), mean("scale").alias("scale"), v.alias("v"), F.zip_with("lcmr", "lcmr_n", lambda x, y: x / 2 + y / 2).alias("lcmr"))
    gone = pairs.select(F.explode(F.array("a", "n")).alias("c"))
    return clusters.join(gone, "c", "left_anti").unionByName(joined)
