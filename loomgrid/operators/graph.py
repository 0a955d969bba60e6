"""Affinity graphs over nodes with features, and label propagation on them. A graph is a table of edges (s, t, w)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from loomgrid.functions import vectors as V
from loomgrid.operators import metric
from loomgrid.sources.stored import ranked, stored

#: Nodes up to which a solver may run on the driver; beyond, fixed-point rounds over the edge table.
DRIVER_NODES = 2_000


def packed(features: DataFrame, value: str, key: str = "sp") -> DataFrame:
    """(key, x): the long form as one vector a node."""
    return features.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", value))), lambda x: x[value]).alias("x"))


def block_pairs(nodes: DataFrame, cost: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int | None, key: str, vector: str, out: str, block: int = 1024) -> DataFrame:
    """(s, t, out): of each node the k others of least cost, all equal to the k-th too; every other node if k is None. A pair of cost inf is none.

    Vectors are packed into blocks; each pair of blocks is one call of ``cost`` on slices of bounded size, and only what is
    asked for leaves it, so the quadratic part never becomes rows. Costs of a pair must not depend on the block it is in.
    """
    parts = max(1, -(-nodes.count() // block))
    kind = dict(nodes.dtypes)[key]
    dealt = nodes.select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("x"))
    other = F.sequence(F.lit(0), F.lit(parts - 1))
    left = dealt.withColumn("b", F.explode(other)).select(F.col("part").alias("a"), "b", "key", "x")
    right = dealt.withColumn("a", F.explode(other)).select("a", F.col("part").alias("b"), F.col("key").alias("key"), F.col("x").alias("x"))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        arrow = (left if left.num_rows else right).schema.field("key").type
        empty = pa.table({"s": pa.array([], arrow), "t": pa.array([], arrow), out: pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        s, t = (x["key"].to_numpy() for x in (left, right))
        x, y = (np.stack(v["x"].to_numpy()) for v in (left, right))
        made, step = [empty], max(1, (1 << 22) // max(y.size, 1))
        for i in range(0, len(x), step):
            c = cost(x[i : i + step], y)
            c[s[i : i + step, None] == t] = np.inf
            ok = np.isfinite(c)
            if k is not None and k < len(t):
                ok &= c <= np.partition(c, k - 1, axis=1)[:, k - 1 : k]
            row, pick = np.nonzero(ok)
            made.append(pa.table({"s": pa.array(s[i + row], arrow), "t": pa.array(t[pick], arrow), out: pa.array(c[row, pick])}))
        return pa.concat_tables(made)

    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(solve, f"s {kind}, t {kind}, {out} double")
    return found if k is None else top(found, k, F.col(out).asc())


def _squared(x: np.ndarray, y: np.ndarray, shares: np.ndarray | None = None) -> np.ndarray:
    """Squared distances, each dimension by its share."""
    d = (x[:, None] - y) ** 2
    return d.sum(2) if shares is None else d @ shares


def pairwise(nodes: DataFrame, key: str = "sp", value: str = "x") -> DataFrame:
    """(s, t, d2) of every ordered pair of different nodes. All pairs are the result; for the nearest ones of many vectors use :func:`metric.nearest`."""
    return block_pairs(nodes, _squared, None, key, value, "d2")


def pairwise_centroids(centroids: DataFrame) -> DataFrame:
    """(s, t, d) for s < t. All pairs are the result; :func:`fcf_graph` needs only those that are near enough."""
    places = centroids.select("sp", F.array("ci", "cj").alias("x"))
    return block_pairs(places, lambda x, y: np.sqrt(_squared(x, y)), None, "sp", "x", "d").where("s < t")


def _mixed(x: np.ndarray, y: np.ndarray, b: float) -> np.ndarray:
    """b times the squared distance of the second halves, the weighted features, plus 1 - b times that of the first, the means."""
    half = x.shape[1] // 2
    return _squared(x, y, np.repeat([1 - b, b], half))


def _both(mean: DataFrame, weighted: DataFrame) -> DataFrame:
    return mean.select("sp", F.col("x").alias("m")).join(weighted.select("sp", F.col("x").alias("w")), "sp").select("sp", F.concat("m", "w").alias("x"))


def combined(mean: DataFrame, weighted: DataFrame, b: float, neighbours: int | None = None) -> DataFrame:
    """(s, t, d): b times the squared distance of the weighted features plus 1 - b times that of the means; of each node
    its ``neighbours`` nearest, ties kept, or all others."""
    return block_pairs(_both(mean, weighted), lambda x, y: _mixed(x, y, b), neighbours, "sp", "x", "d")


def affinity(distances: DataFrame, sigma: float, column: str = "d") -> DataFrame:
    """(s, t, w): the Gaussian kernel without the diagonal."""
    return distances.select("s", "t", V.gaussian(F.col(column), sigma).alias("w"))


def symmetric(edges: DataFrame, value: str = "w") -> DataFrame:
    """The larger of both directions; an edge that either side has."""
    both = edges.select("s", "t", value).unionByName(edges.select(F.col("t").alias("s"), F.col("s").alias("t"), value))
    return both.groupBy("s", "t").agg(F.max(value).alias(value))


def top(edges: DataFrame, k: int, order: Column, ties: bool = True) -> DataFrame:
    """Of each source the first k edges in the order; with ``ties`` all equal to the k-th."""
    rank = (F.rank() if ties else F.row_number()).over(Window.partitionBy("s").orderBy(order) if ties else Window.partitionBy("s").orderBy(order, "t"))
    return edges.withColumn("rk", rank).where(F.col("rk") <= k).drop("rk")


def affinity_knn(distances: DataFrame, sigma: float, neighbours: int) -> DataFrame:
    """Each node's nearest (ties kept), made symmetric by the larger distance, as affinities; pairs of no distance drop out."""
    near = symmetric(top(distances, neighbours, F.col("d").asc()), "d")
    return affinity(near, sigma).where("w <> 1")


def _largest(s: np.ndarray, x: np.ndarray, t: np.ndarray, y: np.ndarray, weigh: Callable[[np.ndarray, np.ndarray], np.ndarray], least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, weight): of each x the k largest weights with y of another key that are at least ``least`` and not zero, all equal to the k-th too."""
    out, step = [], max(1, (1 << 21) // max(y.size, 1))
    for i in range(0, len(x), step):
        w = weigh(x[i : i + step], y)
        w[s[i : i + step, None] == t] = 0
        ok = (w > 0) & (w >= least[i : i + step, None])
        if k < len(t):
            ok &= w >= np.partition(w, -k, axis=1)[:, -k, None]
        row, pick = np.nonzero(ok)
        out.append((i + row, pick, w[row, pick]))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _places(nodes: DataFrame, block: int) -> tuple[DataFrame, list]:
    """(nodes with chunk, [(chunk, least i, largest i, least j, largest j)]): nodes (sp, x, ci, cj) by bands of rows and, in a band, by column, cut
    into chunks of ``block``."""
    n, i0, i1, j0, j1 = nodes.agg(F.count(F.lit(1)), F.min("ci"), F.max("ci"), F.min("cj"), F.max("cj")).first()
    band = max(((i1 - i0 + 1) * (j1 - j0 + 1) * block / n) ** 0.5, 1.0) if n else 1.0
    dealt = ranked(nodes, [F.floor(F.col("ci") / band), "cj", "sp"], "by-place").withColumn("chunk", F.floor(F.col("place") / block)).drop("place")
    dealt = stored(dealt, "placed")
    return dealt, [tuple(r) for r in dealt.groupBy("chunk").agg(F.min("ci"), F.max("ci"), F.min("cj"), F.max("cj")).orderBy("chunk").collect()]


def _gap(i: np.ndarray, j: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Distance of points, or of boxes given as (least, largest), from boxes."""
    low_i, high_i, low_j, high_j = np.moveaxis(box, -1, 0)
    return np.hypot(np.maximum(np.maximum(low_i - i[..., 1], i[..., 0] - high_i), 0), np.maximum(np.maximum(low_j - j[..., 1], j[..., 0] - high_j), 0))


def fcf_graph(mean: DataFrame, weighted: DataFrame, centroids: DataFrame, sigma: float, sigma_l: float, b: float, k: int = 8, block: int = 2048) -> DataFrame:
    """Feature affinity times spatial decay, each node's k largest, made symmetric. Pairs of equal features have no edge.

    A weight is at most exp(-distance / sigma_l). So the k-th largest weight within a node's own chunk of the plane bounds how far away a
    larger one can be: only chunks that near are sent to it, the nearest first, and the bound falls as they are met."""
    places = centroids.select("sp", "ci", "cj")
    nodes = _both(mean, weighted).join(places, "sp").select("sp", "x", "ci", "cj")
    chunks, boxes = _places(stored(nodes, "nodes"), block)
    kind = dict(nodes.dtypes)["sp"]
    schema = f"s {kind}, t {kind}, w double"

    def weigh(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        w = np.exp(-_mixed(x[:, :-2], y[:, :-2], b) / (sigma * sigma))
        return np.where(w == 1, 0, w * np.exp(-np.sqrt(_squared(x[:, -2:], y[:, -2:])) / sigma_l))

    def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        places = [t[n].to_numpy()[:, None] for n in ("ci", "cj")]
        return t["sp"].to_numpy(), np.concatenate([np.array(t["x"].to_pylist(), float), *places], 1)

    def table(s: pa.ChunkedArray, t: pa.ChunkedArray, found: tuple) -> pa.Table:
        return pa.table({"s": s.take(pa.array(found[0])), "t": t.take(pa.array(found[1])), "w": pa.array(found[2])})

    def own(t: pa.Table) -> pa.Table:
        s, x = arrays(t)
        return table(t["sp"], t["sp"], _largest(s, x, s, x, weigh, np.zeros(len(x)), k))

    first = chunks.groupBy("chunk").applyInArrow(own, schema)
    if len(boxes) < 2:
        return symmetric(first)
    first = stored(first, "own-chunk")
    kth = top(first, k, F.col("w").desc()).groupBy(F.col("s").alias("sp")).agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("least")).where(F.col("n") >= k).drop("n")
    held = stored(chunks.join(kth, "sp", "left").withColumn("least", F.coalesce("least", F.lit(0.0))), "bounded")
    reach = {r[0]: float("inf") if r[1] == 0 else -sigma_l * float(np.log(r[1])) for r in held.groupBy("chunk").agg(F.min("least")).collect()}
    ids, edges_of = np.array([r[0] for r in boxes]), np.array([r[1:] for r in boxes], float)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in batch.column(0).to_pylist():
                n = int(np.flatnonzero(ids == a)[0])
                gap = _gap(edges_of[n, None, :2], edges_of[n, None, 2:], edges_of)
                close = np.flatnonzero((gap <= reach[a] * (1 + 1e-9)) & (ids != a))
                b = ids[close[np.argsort(gap[close], kind="stable")]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), a)), pa.array(b), pa.array(np.arange(len(b)))], names=["a", "b", "turn"])

    starts = mean.sparkSession.createDataFrame([(a,) for a in ids.tolist()], "a long").repartition(8)
    pairs = stored(starts.mapInArrow(near, "a long, b long, turn long"), "chunk-pairs").withColumn("part", F.floor(F.col("turn") / 8))
    left = held.withColumnRenamed("chunk", "a").join(pairs.select("a", "part").distinct(), "a").select(F.col("a").alias("a1"), F.col("part").alias("part1"), "sp", "x", "ci", "cj", "least")
    right = chunks.withColumnRenamed("chunk", "b").join(pairs, "b").select(F.col("a").alias("a2"), F.col("part").alias("part2"), "turn", *(F.col(c).alias(c) for c in ("sp", "x", "ci", "cj")))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("turn")
        (s, x), (t, y), least, turns = arrays(left), arrays(right), left["least"].to_numpy().copy(), right["turn"].to_numpy()
        found = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        for begin, end in zip(*(np.searchsorted(turns, np.unique(turns), side) for side in ("left", "right")), strict=True):
            low, high = y[begin:end, -2:].min(0), y[begin:end, -2:].max(0)
            gap = _gap(x[:, -2, None].repeat(2, 1), x[:, -1, None].repeat(2, 1), np.array([low[0], high[0], low[1], high[1]]))
            able = np.flatnonzero(np.exp(-gap * (1 - 1e-9) / sigma_l) >= least)
            if not len(able):
                continue
            row, pick, w = _largest(s[able], x[able], t[begin:end], y[begin:end], weigh, least[able], k)
            row, pick, w = (np.concatenate(v) for v in zip(found, (able[row], begin + pick, w), strict=True))
            order = np.lexsort((-w, row))
            row, pick, w = row[order], pick[order], w[order]
            full = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == k - 1)
            least[row[full]] = np.maximum(least[row[full]], w[full])
            kept = w >= least[row]
            found = row[kept], pick[kept], w[kept]
        return table(left["sp"], right["sp"], found)

    found = left.groupBy("a1", "part1").cogroup(right.groupBy("a2", "part2")).applyInArrow(meet, schema)
    return symmetric(top(first.unionByName(found), k, F.col("w").desc()))


def fcf_m_graph(vectors: DataFrame, sigma: float, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Affinity of generic vectors: each one's k nearest, made symmetric."""
    return symmetric(affinity(metric.nearest(vectors, k, key, vector), sigma, "d2"))


def degree(edges: DataFrame) -> DataFrame:
    """(s, deg)."""
    return edges.groupBy("s").agg(F.sum("w").alias("deg"))


def normalized(edges: DataFrame) -> DataFrame:
    """(s, t, w): w over the roots of both degrees; nodes of no degree have no edges."""
    edges = stored(edges, "edges")  # read three times
    deg = degree(edges).where("deg > 0")
    a, b = deg.select("s", F.col("deg").alias("ds")), deg.select(F.col("s").alias("t"), F.col("deg").alias("dt"))
    return edges.join(a, "s").join(b, "t").select("s", "t", (F.col("w") / F.sqrt(F.col("ds") * F.col("dt"))).alias("w"))


def check_weights(edges: DataFrame) -> None:
    if (least := edges.agg(F.min("w")).first()[0]) is not None and least < 0:
        raise ValueError("an edge has a negative weight")


def propagate(s: DataFrame, labels: DataFrame, alpha: float, rounds: int) -> DataFrame:
    """(node, cls, f): ``rounds`` times f = alpha S f + (1 - alpha) y, from f = y. ``labels`` (node, cls, y)."""
    s = stored(s, "affinities")  # each round reads both
    y = stored(labels.select("node", "cls", F.col("y").cast("double").alias("y")), "labels")
    f = y.select("node", "cls", F.col("y").alias("f"))
    own = y.select("node", "cls", ((1 - alpha) * F.col("y")).alias("f"))
    for _ in range(rounds):
        spread = s.join(f.withColumnRenamed("node", "t"), "t").select(F.col("s").alias("node"), "cls", (alpha * F.col("w") * F.col("f")).alias("f"))
        f = spread.unionByName(own).groupBy("node", "cls").agg(F.sum("f").alias("f"))
    return f


def _dense(edges: DataFrame, labels: DataFrame) -> tuple[np.ndarray, list, np.ndarray, list[int]]:
    rows, marks = edges.collect(), labels.collect()
    nodes = sorted({r["s"] for r in rows} | {r["t"] for r in rows} | {r["node"] for r in marks})
    classes = sorted({r["cls"] for r in marks})
    at, of = {n: i for i, n in enumerate(nodes)}, {c: i for i, c in enumerate(classes)}
    w, y = np.zeros((len(nodes), len(nodes))), np.zeros((len(nodes), len(classes)))
    for r in rows:
        w[at[r["s"]], at[r["t"]]] = r["w"]
    for r in marks:
        y[at[r["node"]], of[r["cls"]]] = r["y"]
    return w, nodes, y, classes


def _long(spark, nodes: list, classes: list[int], f: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(n, c, float(f[i, j])) for i, n in enumerate(nodes) for j, c in enumerate(classes)], "node long, cls int, f double")


def _by_class(spread: DataFrame, state: DataFrame, alpha: float, width: int) -> DataFrame:
    """``state`` (node, x, r, p) with q = p - alpha S p; ``spread`` are the edges (s, t, w) of S."""
    moved = spread.join(state.select(F.col("node").alias("t"), *(F.get("p", c).alias(f"p{c}") for c in range(width))), "t")
    sums = moved.groupBy(F.col("s").alias("node")).agg(*(F.sum(F.col("w") * F.col(f"p{c}")).alias(f"p{c}") for c in range(width)))
    q = F.array(*(F.get("p", c) - alpha * F.coalesce(F.col(f"p{c}"), F.lit(0.0)) for c in range(width)))
    return state.join(sums, "node", "left").select("node", "x", "r", "p", q.alias("q"))


def conjugate_gradients(s: DataFrame, y: DataFrame, alpha: float, tolerance: float, most_rounds: int) -> DataFrame:
    """(node, cls, f) with (1 - alpha S) f = (1 - alpha) y, of every node and class, for symmetric edges ``s`` (s, t, w) of norm 1 at most.

    Conjugate gradients for all classes at once. A round is one join with the edges, written to the shared folder; the products of vectors
    that its step needs, a few numbers a class, are observed as it is written. Ends when the residual proves every value right to the
    tolerance; an error if that takes more than ``most_rounds``."""
    classes = sorted(r[0] for r in y.select("cls").distinct().collect())
    nodes = s.select(F.explode(F.array("s", "t")).alias("node")).unionByName(y.select("node")).distinct()
    if not classes:
        return nodes.limit(0).select("node", F.lit(0).alias("cls"), F.lit(0.0).alias("f"))
    start = y.groupBy("node").agg(F.array(*(F.coalesce(F.sum(F.when(F.col("cls") == c, (1 - alpha) * F.col("y"))), F.lit(0.0)) for c in classes)).alias("b"))
    b = F.coalesce("b", F.array(*[F.lit(0.0)] * len(classes)))
    state = nodes.join(start, "node", "left").select("node", F.transform(b, lambda x: F.lit(0.0)).alias("x"), b.alias("r"), b.alias("p"))
    state = stored(state, "solver-start")
    for _ in range(most_rounds):
        seen = Observation()
        dot = lambda a, b, c: F.sum(F.get(a, c) * F.get(b, c))
        observed = [dot(a, b, c).alias(f"{a}{b}{c}") for a, b in ("rr", "rq", "qq", "pq") for c in range(len(classes))]
        state = stored(_by_class(s, state, alpha, len(classes)).observe(seen, *observed), "solver-step")
        rr, rq, qq, pq = (np.array([seen.get[f"{n}{c}"] or 0.0 for c in range(len(classes))]) for n in ("rr", "rq", "qq", "pq"))
        step = np.where(pq > 0, rr / np.where(pq > 0, pq, 1), 0)
        left = np.maximum(rr - 2 * step * rq + step * step * qq, 0)
        turn = np.where(rr > 0, left / np.where(rr > 0, rr, 1), 0)
        fixed = lambda v: F.array(*map(F.lit, v.tolist()))
        along = lambda name, other, v: F.transform(name, lambda x, c: x + F.get(fixed(v), c) * F.get(other, c))
        state = state.withColumn("r2", along("r", "q", -step)).select("node", along("x", "p", step).alias("x"), F.col("r2").alias("r"), along("r2", "p", turn).alias("p"))
        if np.sqrt(left.max()) <= tolerance * (1 - alpha):
            return state.select("node", F.posexplode("x").alias("c", "f")).select("node", F.get(F.array(*map(F.lit, classes)), F.col("c")).alias("cls"), "f")
    raise RuntimeError(f"the residual was still {np.sqrt(left.max()):.3g} after {most_rounds} rounds")


def lgc(edges: DataFrame, labels: DataFrame, mu: float, tolerance: float = 1e-8, most_rounds: int = 400) -> DataFrame:
    """(node, cls, f) of local and global consistency: f = a S f + (1 - a) y with a = 1 / (1 + mu), of every node and class, solved
    on the driver for a small graph, else by :func:`conjugate_gradients`."""
    check_weights(edges)
    alpha = 1 / (1 + mu)
    s = normalized(edges)
    if edges.select("s").distinct().count() <= DRIVER_NODES:
        m, nodes, y, classes = _dense(s, labels)
        return _long(edges.sparkSession, nodes, classes, (1 - alpha) * np.linalg.solve(np.eye(len(nodes)) - alpha * m, y) if nodes else y)
    y = stored(labels.select("node", "cls", F.col("y").cast("double").alias("y")), "labels")
    return conjugate_gradients(stored(s, "affinities"), y, alpha, tolerance, most_rounds)


def label_solve(edges: DataFrame, labels: DataFrame, alpha: float) -> DataFrame:
    """(node, cls, f): (1 - alpha S)^-1 y, the propagation without its factor."""
    return lgc(edges, labels, 1 / alpha - 1).withColumn("f", F.col("f") / (1 - alpha))


def classify(scores: DataFrame, nodes: DataFrame | None = None, unreached: int = 1) -> DataFrame:
    """(node, cls): the class of largest score, the lowest of equal ones; nodes that no label reaches get ``unreached``."""
    best = scores.groupBy("node").agg(F.max(F.struct("f", (-F.col("cls")).alias("c"))).alias("b"))
    out = best.select("node", F.when(F.col("b.f") > 0, -F.col("b.c")).otherwise(unreached).cast("int").alias("cls"))
    return out if nodes is None else nodes.select("node").join(out, "node", "left").select("node", F.coalesce("cls", F.lit(unreached)).alias("cls"))


def class_probabilities(scores: DataFrame) -> DataFrame:
    """(node, cls, prob): scores over the node's sum; NaN where that is zero."""
    s = F.sum("f").over(Window.partitionBy("node"))
    return scores.select("node", "cls", F.when(s == 0, F.lit(float("nan"))).otherwise(F.col("f") / s).alias("prob"))


def graph_mbo(edges: DataFrame, labels: DataFrame, mu: float, steps: int = 20, dt: float = 0.01, by_class: bool = False) -> DataFrame:
    """(node, cls): an explicit step of diffusion by the Laplacian L, less the pull towards the labels found in the step before, and a
    threshold, in turn.

    In the whole eigenbasis Q of L, with eigenvalues e, the step is Q (1 - dt e) Q' u, which is u - dt L u; so no basis is needed, and a step
    is a join with the edges, for graphs of any size. ``by_class``: the pull is indexed by class instead of by node."""
    y = stored(labels.groupBy("node", "cls").agg(F.sum("y").cast("double").alias("y")), "labels")
    classes = sorted(r[0] for r in y.select("cls").distinct().collect())
    s = stored(normalized(edges), "affinities")
    nodes = edges.select(F.explode(F.array("s", "t")).alias("node")).unionByName(y.select("node")).distinct()
    if not classes:
        return nodes.limit(0).select(F.col("node").cast("long").alias("node"), F.lit(0).alias("cls"))
    width, zeros = len(classes), F.array(*[F.lit(0.0)] * len(classes))
    given = y.groupBy("node").agg(F.array(*(F.coalesce(F.sum(F.when(F.col("cls") == c, F.col("y"))), F.lit(0.0)) for c in classes)).alias("y"))
    state = nodes.join(given, "node", "left").select("node", F.coalesce("y", zeros).alias("y")).select("node", "y", F.col("y").alias("u"), zeros.alias("d"))
    held = F.when(F.array_max("y") > 0, float(mu)).otherwise(0.0)
    pull = lambda c: held
    if by_class:  # the c-th node's mark in place of the node's own
        order = [r["node"] for r in nodes.orderBy("node").limit(width).collect()]
        marked = {r["node"] for r in y.where((F.col("y") > 0) & F.col("node").isin(order)).collect()}
        marks = F.array(*(F.lit(float(mu) if n in marked else 0.0) for n in order + [None] * (width - len(order))))
        pull = lambda c: F.get(marks, c)
    for _ in range(steps):
        state = stored(state, "mbo-step")
        moved = s.join(state.select(F.col("node").alias("t"), *(F.get("u", c).alias(f"u{c}") for c in range(width))), "t")
        sums = moved.groupBy(F.col("s").alias("node")).agg(*(F.sum(F.col("w") * F.col(f"u{c}")).alias(f"u{c}") for c in range(width)))
        # L is 1 - S, on nodes without edges too
        each = F.array(*((1 - dt) * F.get("u", c) + dt * F.coalesce(F.col(f"u{c}"), F.lit(0.0)) - dt * F.get("d", c) for c in range(width)))
        spread = state.join(sums, "node", "left").select("node", "y", each.alias("spread"))
        rounded = F.transform("spread", lambda x: F.round(x, 12))  # nodes that nothing reaches yet hold rounding errors only: the lowest class
        at = F.array_position(rounded, F.array_max(rounded)) - 1
        hot = F.transform("spread", lambda x, c: (c == at).cast("double"))
        d = F.transform("spread", lambda x, c: pull(c) * (x - F.get("y", c)))
        state = spread.select("node", "y", hot.alias("u"), d.alias("d"))
    return state.select(F.col("node").cast("long").alias("node"), F.get(F.array(*map(F.lit, classes)), F.array_position("u", 1.0).cast("int") - 1).alias("cls"))


def label_spreading(pixels: DataFrame, gamma: float = 1e-6, alpha: float = 0.2, rounds: int = 30, tolerance: float = 1e-3) -> DataFrame:
    """(p, sp, part, new) of (p, sp, v, cls): within each superpixel, classes spread from labelled pixels over a dense Gaussian
    graph. part: 0 where a superpixel has at most one class, else 1, 2, ... for its classes in the order in which a scan by p first sees them.
    new: the superpixel's number for its parts 0 and 1; other parts are superpixels of their own, numbered on from the largest number
    in the order of superpixels and, within one, of first pixels. Groups are superpixels, whose size the segmentation bounds."""

    def solve(group: pa.Table) -> pa.Table:
        group = group.sort_by("p")
        cls = np.array([c or 0 for c in group["cls"].to_pylist()])
        kinds, seen = np.unique(cls[cls > 0], return_index=True)
        kinds = kinds[np.argsort(seen)]
        part = np.zeros(len(cls), int)
        if len(kinds) > 1:
            x = np.array(group["v"].to_pylist(), float)
            x -= x.mean(0)
            size = (x * x).sum(1)
            w = np.exp(-gamma * np.maximum(size[:, None] + size - 2 * x @ x.T, 0))
            np.fill_diagonal(w, 0)
            root = 1 / np.sqrt(np.maximum(w.sum(1), 1e-300))
            s = root[:, None] * w * root
            y = (cls[:, None] == kinds).astype(float)
            f = y
            for _ in range(rounds):
                new = alpha * s @ f + (1 - alpha) * y
                done = np.abs(new - f).sum() < tolerance
                f = new
                if done:
                    break
            part = f.argmax(1) + 1
        return pa.table({"p": group["p"], "sp": group["sp"], "part": pa.array(part.astype(np.int32))})

    parts = stored(pixels.select("p", "sp", "v", "cls").groupBy("sp").applyInArrow(solve, "p int, sp int, part int"), "parts")
    fresh = parts.where("part > 1").groupBy("sp", "part").agg(F.min("p").alias("first"))
    numbers = ranked(fresh, ["sp", "first"], "new-superpixels").select("sp", "part", "place")
    last = parts.agg(F.max("sp")).first()[0]
    new = F.coalesce(F.col("place") + 1 + (last or 0), F.col("sp")).cast("int")
    return parts.join(numbers, ["sp", "part"], "left").select("p", "sp", "part", new.alias("new"))
