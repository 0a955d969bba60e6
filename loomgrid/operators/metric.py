"""Exact nearest vectors by an index of pivots.

Each vector belongs to its nearest pivot, and a pivot's vectors are cut into chunks by their distance from it, so a chunk is a shell around
a pivot. Neighbours are looked for in a vector's own chunk first. How far the k-th of these is bounds how far any other can be, and by the
triangle inequality rules out whole pairs of chunks before vectors are sent, and single vectors within a pair. What is left is one
product of matrices in single precision, whose rounding is bounded; vectors within the bound are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.sources.stored import ranked, stored

#: Pivots at most: distances of all pairs are sent to the tasks, 8 MB.
PIVOTS = 1024
#: Chunks that a task goes through one after the other, the nearest first, for the vectors of one.
TOGETHER = 8
#: Room for rounding in bounds of distances, as a share.
SLACK = 1e-9


def _vectors(t: pa.Table | pa.RecordBatch, name: str = "x") -> np.ndarray:
    column = t[name].combine_chunks() if isinstance(t, pa.Table) else t.column(t.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def closest(s: np.ndarray, x: np.ndarray, limit: np.ndarray, t: np.ndarray, y: np.ndarray, k: int, rows: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, squared distance): of each x the k nearest y of another key that are no further than ``limit``, which is squared; the
    lower key of equal ones. ``t`` is ascending."""
    centre = x.mean(0)
    size = max(np.abs(x - centre).max(initial=0), np.abs(y - centre).max(initial=0)) or 1.0
    a, b = (((v - centre) / size).astype(np.float32) for v in (x, y))
    na, nb = ((v.astype(float) ** 2).sum(1) for v in (a, b))
    right = np.concatenate([-2 * b, nb[:, None].astype(np.float32), np.ones((len(b), 1), np.float32)], 1).T
    bound = 8 * (x.shape[1] + 8) * np.finfo(np.float32).eps * (na + nb.max(initial=0))
    most = limit / (size * size)
    out = []
    for i in range(0, len(x), rows):
        left = np.concatenate([a[i : i + rows], np.ones((len(a[i : i + rows]), 1), np.float32), na[i : i + rows, None].astype(np.float32)], 1)
        d = left @ right
        d[s[i : i + rows, None] == t] = np.inf
        held = most[i : i + rows].copy()
        open_ = np.flatnonzero(~np.isfinite(held))
        if len(open_) and k < len(t):
            held[open_] = np.partition(d[open_], k - 1, axis=1)[:, k - 1]
        row, pick = np.nonzero(d <= np.nextafter((held + bound[i : i + rows]).astype(np.float32), np.float32(np.inf))[:, None])
        ok = s[i + row] != t[pick]
        row, pick = row[ok], pick[ok]
        exact = np.concatenate([np.zeros(0), *(((x[i + row[n : n + 65_536]] - y[pick[n : n + 65_536]]) ** 2).sum(1) for n in range(0, len(row), 65_536))])
        order = np.lexsort((pick, exact, row))
        row, pick, exact = row[order], pick[order], exact[order]
        first = (np.arange(len(row)) - np.searchsorted(row, row) < k) & (exact <= limit[i + row])
        out.append((i + row[first], pick[first], exact[first]))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def index(vectors: DataFrame, block: int) -> tuple[DataFrame, np.ndarray, list]:
    """((chunk, key, x), pivots, [(chunk, cell, low, high)]) of (key, x): shells around pivots, of at most ``block`` vectors each."""
    kinds = dict(vectors.dtypes)
    many = max(1, min(PIVOTS, -(-vectors.count() // block)))
    pivots = np.array([r["x"] for r in vectors.orderBy(F.xxhash64("key"), "key").limit(many).collect()], float)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch)
            cell = np.concatenate([np.zeros(0, int), *(((p * p).sum(1) - 2 * x[n : n + 4096] @ p.T).argmin(1) for p in [pivots] for n in range(0, len(x), 4096))])
            far = np.sqrt(((x - pivots[cell]) ** 2).sum(1)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=["key", "x", "cell", "far"])

    dealt = vectors.mapInArrow(deal, f"key {kinds['key']}, x {kinds['x']}, cell int, far double")
    placed = ranked(dealt, ["cell", "far", "key"], "by-pivot")
    placed = stored(placed.select((F.floor(F.col("place") / block) * PIVOTS + F.col("cell")).alias("chunk"), "key", "x", "cell", "far"), "chunks")
    shells = placed.groupBy("chunk").agg(F.first("cell"), F.min("far"), F.max("far")).orderBy("chunk").collect()
    return placed.select("chunk", "key", "x"), pivots, [tuple(r) for r in shells]


def near_chunks(shells: list, pivots: np.ndarray, reach: dict[int, float], a: int) -> np.ndarray:
    """Chunks, but a's own, that can hold a vector within ``reach`` of one of chunk a's: between shells around p and q, with radii from low to
    high, vectors are at least |p q| - high - high apart, and at least a low radius less |p q| and the other high one. The nearest come first."""
    chunk, cell, low, high = (np.array(v) for v in zip(*shells, strict=True))
    n = int(np.flatnonzero(chunk == a)[0])
    apart = np.sqrt(((pivots[cell] - pivots[cell[n]]) ** 2).sum(1))
    least = np.maximum.reduce([apart - high - high[n], low - apart - high[n], low[n] - apart - high, np.zeros(len(low))])
    near = np.flatnonzero((least * (1 - SLACK) <= reach[a] * (1 + SLACK) + SLACK * (apart + high + high[n])) & (chunk != a))
    return chunk[near[np.argsort(least[near], kind="stable")]]


def nearest(vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 8192) -> DataFrame:
    """(s, t, d2): the k nearest others of each vector, the lower key first of equal ones, exactly. Keys are distinct numbers.

    Of equal vectors only the first k + 1 are looked for and look around themselves; any further copy has the first k as its nearest,
    so a vector that a third of all rows share costs no more than another."""
    kind = dict(vectors.dtypes)[key]
    vectors = stored(vectors.select(F.col(key).alias("key"), F.col(vector).alias("x")), "vectors")
    copy = F.row_number().over(Window.partitionBy("x").orderBy("key"))
    heads = stored(vectors.withColumn("copy", copy).where(F.col("copy") <= k + 1), "heads")
    many = heads.groupBy("x").agg(F.max("copy").alias("copies"), F.array_sort(F.collect_list("key")).alias("keys")).where(F.col("copies") > k)
    rest = vectors.join(heads.select("key"), "key", "left_anti").join(many, "x")
    rest = rest.select(F.col("key").alias("s"), F.explode(F.slice("keys", 1, k)).alias("t"), F.lit(0.0).alias("d2"))
    return _searched(heads.select("key", "x"), k, kind, block).unionByName(rest)


def _searched(vectors: DataFrame, k: int, kind: str, block: int) -> DataFrame:
    spark = vectors.sparkSession
    chunks, pivots, shells = index(vectors, block)
    schema = f"s {kind}, t {kind}, d2 double"

    def table(s: pa.ChunkedArray, t: pa.ChunkedArray, found: tuple) -> pa.Table:
        return pa.table({"s": s.take(pa.array(found[0])), "t": t.take(pa.array(found[1])), "d2": pa.array(found[2])})

    def own(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key")
        keys, x = rows["key"].to_numpy(), _vectors(rows)
        return table(rows["key"], rows["key"], closest(keys, x, np.full(len(x), np.inf), keys, x, k))

    first = chunks.groupBy("chunk").applyInArrow(own, schema)
    top = Window.partitionBy("s").orderBy("d2", "t")
    cut = lambda df: df.withColumn("rk", F.row_number().over(top)).where(F.col("rk") <= k).drop("rk")
    if len(shells) < 2:
        return first
    first = stored(first, "own-chunk")
    bound = first.groupBy(F.col("s").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("limit")).where(F.col("n") >= k).drop("n")
    held = stored(chunks.join(bound, "key", "left").select("chunk", "key", "x", F.coalesce("limit", F.lit(float("inf"))).alias("limit")), "bounded")
    reach = {r[0]: float(np.sqrt(r[1])) for r in held.groupBy("chunk").agg(F.max("limit")).collect()}

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in batch.column(0).to_pylist():
                b = near_chunks(shells, pivots, reach, a)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), a)), pa.array(b), pa.array(np.arange(len(b)))], names=["a", "b", "turn"])

    pairs = stored(spark.createDataFrame([(x[0],) for x in shells], "a long").repartition(8).mapInArrow(pair, "a long, b long, turn long"), "chunk-pairs")
    pairs = pairs.withColumn("part", F.floor(F.col("turn") / TOGETHER))
    around = {x[0]: (pivots[x[1]], x[2], x[3]) for x in shells}
    left = held.withColumnRenamed("chunk", "a").join(pairs.select("a", "part").distinct(), "a").select(F.col("a").alias("a1"), F.col("part").alias("part1"), "key", "x", "limit")
    right = chunks.withColumnRenamed("chunk", "b").join(pairs, "b").select(F.col("a").alias("a2"), F.col("part").alias("part2"), "b", "turn", F.col("key").alias("key"), F.col("x").alias("x"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("turn", "ascending"), ("key", "ascending")])
        keys, x, limit = left["key"].to_numpy(), _vectors(left), left["limit"].to_numpy().copy()
        turns, y, others = right["turn"].to_numpy(), _vectors(right), right["key"].to_numpy()
        found = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        for begin, end in zip(*(np.searchsorted(turns, np.unique(turns), side) for side in ("left", "right")), strict=True):
            pivot, low, high = around[right["b"][int(begin)].as_py()]
            far = np.sqrt(((x - pivot) ** 2).sum(1))
            able = np.flatnonzero(np.maximum(far - high, low - far) * (1 - SLACK) <= np.sqrt(limit) * (1 + SLACK) + SLACK * (far + high))
            if not len(able):
                continue
            row, pick, d2 = closest(keys[able], x[able], limit[able], others[begin:end], y[begin:end], k)
            row, pick, d2 = (np.concatenate(v) for v in zip(found, (able[row], begin + pick, d2), strict=True))
            order = np.lexsort((others[pick], d2, row))
            row, pick, d2 = row[order], pick[order], d2[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            limit[row[place == k - 1]] = np.minimum(limit[row[place == k - 1]], d2[place == k - 1])
            found = row[place < k], pick[place < k], d2[place < k]
        return table(left["key"], right["key"], found)

    found = left.groupBy("a1", "part1").cogroup(right.groupBy("a2", "part2")).applyInArrow(meet, schema)
    return cut(first.unionByName(found))
