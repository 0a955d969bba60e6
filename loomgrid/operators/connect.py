"""Connected regions of a label raster, numbered in scan order, small ones absorbed by a neighbour.

Regions are found by tiles, each in one task with numpy, and joined across tile borders by contracting the graph of the tiles'
regions. What hangs on the order of the scan is then looked at per region: a region's number is its rank by first pixel, and a small
region needs only its own few pixels and the regions around them that began before it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.neighbourhood import offsets
from loomgrid.sources.stored import ranked, stored

#: Order in which a search looks around a pixel: right, left, below, above.
AROUND = [(0, 1), (0, -1), (1, 0), (-1, 0)]


def grid_components(grid: np.ndarray, held: np.ndarray) -> np.ndarray:
    """For each cell the least flat index of its region: cells of equal value joined by their sides; cells that aren't ``held`` join none."""
    h, w = grid.shape
    at = np.arange(h * w).reshape(h, w)
    across = (grid[:, 1:] == grid[:, :-1]) & held[:, 1:] & held[:, :-1]
    down = (grid[1:] == grid[:-1]) & held[1:] & held[:-1]
    a = np.concatenate([at[:, :-1][across], at[:-1][down]])
    b = np.concatenate([at[:, 1:][across], at[1:][down]])
    root = np.arange(h * w)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root.reshape(h, w)
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component of ``edges`` (a, b), of all nodes but the roots; large-star and small-star in turn."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = stored(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.withColumnRenamed("m", "b"))
        edges = stored(small.distinct(), "small-star")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now


def regions(labels: DataFrame, width: int, tile: int = 256) -> DataFrame:
    """(p, i, j, region) of ``labels`` (p, i, j, c) with p = i * width + j: the least p of each pixel's region. No task holds more than a tile."""

    def solve(t: pa.Table) -> pa.Table:
        p, i, j, c = (t[n].to_numpy() for n in ("p", "i", "j", "c"))
        i0, j0 = i.min(), j.min()
        grid, held = np.zeros((i.max() - i0 + 1, j.max() - j0 + 1), np.int64), np.zeros((i.max() - i0 + 1, j.max() - j0 + 1), bool)
        grid[i - i0, j - j0], held[i - i0, j - j0] = c, True
        at = grid_components(grid, held)[i - i0, j - j0]
        return pa.table({"p": p, "i": i, "j": j, "c": c, "part": (at // grid.shape[1] + i0).astype(np.int64) * width + at % grid.shape[1] + j0})

    px = labels.select(F.col("p").cast("long").alias("p"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.coalesce("c", F.lit(-1)).cast("long").alias("c"))
    dealt = px.withColumns({"ti": F.floor(F.col("i") / tile), "tj": F.floor(F.col("j") / tile)}).groupBy("ti", "tj")
    parts = stored(dealt.applyInArrow(solve, "p long, i int, j int, c long, part long"), "parts")
    crossing = []
    for x in "ij":
        y = "j" if x == "i" else "i"
        low = parts.where((F.col(x) + 1) % tile == 0).select((F.col(x) + 1).alias(x), y, "c", F.col("part").alias("a"))
        high = parts.where((F.col(x) % tile == 0) & (F.col(x) > 0)).select(x, y, "c", F.col("part").alias("b"))
        crossing.append(low.join(high, [x, y, "c"]).select("a", "b"))
    root = components(crossing[0].unionByName(crossing[1]))
    return parts.join(root, parts["part"] == root["node"], "left").select("p", "i", "j", F.coalesce("root", "part").alias("region"))


def cut_region(p: np.ndarray, width: int, most: int) -> np.ndarray:
    """For each pixel of a region its piece's first pixel: breadth-first searches from the first pixel left, each of at most ``most`` pixels."""
    left, piece = dict.fromkeys(np.sort(p).tolist()), {}
    for start in list(left):
        if start not in left:
            continue
        del left[start]
        found, todo = [start], deque([start])
        while todo and len(found) < most:
            x = todo.popleft()
            for di, dj in AROUND:
                y = x + di * width + dj
                if y in left and 0 <= x % width + dj < width:
                    del left[y]
                    found.append(y)
                    todo.append(y)
                    if len(found) >= most:
                        break
        piece.update(dict.fromkeys(found, start))
    return np.array([piece[x] for x in p.tolist()], np.int64)


def last_met(cells: list[tuple[int, int]], beside: dict[tuple[int, int, int], int]) -> int | None:
    """The last of ``beside`` (i, j, direction) that a breadth-first search of the cells from their first meets."""
    left = set(cells)
    todo, last = deque([min(cells)]), None
    left.discard(todo[0])
    while todo:
        i, j = todo.popleft()
        for n, (di, dj) in enumerate(AROUND):
            if (i + di, j + dj) in left:
                left.discard((i + di, j + dj))
                todo.append((i + di, j + dj))
            else:
                last = beside.get((i, j, n), last)
    return last


def connectivity(labels: DataFrame, width: int, least: int, most: int, tile: int = 256) -> DataFrame:
    """(p, i, j, sp) of ``labels`` (p, i, j, c), p = i * width + j: connected superpixels, numbered from 0 in scan order.

    Regions of equal c are searched breadth first from their first pixel in the scan; a search ends at ``most`` pixels, and what is left
    is searched from its own first pixel. A piece of fewer than ``least`` pixels joins the last neighbour met in its search that began before
    it, with whatever that joined; without one it joins number 0. A missing c is a label of its own.

    A region of more than ``most`` pixels is cut by one task, over integers, since each search begins where the one before ended; all
    else is by tiles, joins and ranges.
    """
    if most < least:
        raise ValueError("a search may not end before a piece is large enough")
    found = stored(regions(labels, width, tile), "regions")
    over = stored(found.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("region"), "large-regions")

    def cut(t: pa.Table) -> pa.Table:
        p = t["p"].to_numpy()
        return pa.table({"p": p, "i": t["i"], "j": t["j"], "piece": cut_region(p, width, most)})

    whole = found.join(over, "region", "left_anti").select("p", "i", "j", F.col("region").alias("piece"))
    pieces = found.join(over, "region", "left_semi").groupBy("region").applyInArrow(cut, "p long, i int, j int, piece long").unionByName(whole)
    pieces = stored(pieces, "pieces")
    sizes = stored(pieces.groupBy("piece").agg((F.count(F.lit(1)) >= least).alias("large")), "piece-sizes")
    numbers = ranked(sizes.where("large").select("piece"), ["piece"], "piece-numbers")

    small = pieces.join(sizes.where("not large").select("piece"), "piece")
    other = pieces.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("piece").alias("other"))
    met = offsets(small, AROUND).join(other, ["ni", "nj"], "left").select("piece", "i", "j", "o", F.when(F.col("other") < F.col("piece"), F.col("other")).alias("other"))
    each = met.groupBy("piece").agg(F.collect_list(F.struct("i", "j", "o", "other")).alias("met"))  # fewer than 4 * least entries

    def point(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = []
            for met in batch.column(1).to_pylist():
                to.append(last_met(list({(x["i"], x["j"]) for x in met}), {(x["i"], x["j"], x["o"]): x["other"] for x in met if x["other"] is not None}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to, pa.int64())], names=["piece", "to"])

    joins = stored(each.mapInArrow(point, "piece long, to long"), "joins")
    while True:  # a piece that joined a small one follows it; each turn doubles how far
        after = joins.select(F.col("piece").alias("to"), F.col("to").alias("next"), F.lit(True).alias("on"))
        joins = stored(joins.join(after, "to", "left").select("piece", F.when(F.col("on"), F.col("next")).otherwise(F.col("to")).alias("to"), F.coalesce("on", F.lit(False)).alias("on")), "joins")
        if joins.where("on").isEmpty():
            break
        joins = joins.drop("on")
    of = joins.select("piece", F.col("to").alias("at")).unionByName(numbers.select("piece", F.col("piece").alias("at")))
    final = of.join(numbers.select(F.col("piece").alias("at"), "place"), "at", "left").select("piece", F.coalesce("place", F.lit(0)).cast("int").alias("sp"))
    return pieces.join(final, "piece").select(F.col("p").cast("int").alias("p"), "i", "j", "sp")
