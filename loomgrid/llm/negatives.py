"""Hard negatives: rows of another label whose score with an anchor lies in a window under that of a positive.

Rows are sorted by norm, largest first, and cut into chunks and, within these, buckets. An anchor's score with a row is at most the
product of their norms, so a bucket whose largest norm can't reach an anchor's window's lower limit, or its running k-th score, is skipped, and
so are all after it. The first chunk is searched first; the k-th scores found there rule out whole chunks before they are sent
to a block of anchors. Scores are whole numbers, and so the same however rows are dealt.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import bounded_batches, materialize, ranked

#: Anchors of a block, rows of a chunk and of a bucket: a task holds a block and a chunk, and scores of a bucket at a time.
BLOCK, CHUNK, BUCKET = 4096, 8192, 1024
#: Scaled components are held within these bounds, so that scores of up to 1,024 of them fit 64 bits.
MOST = 1 << 26
#: No limit of a window, in hundredths of a score.
NONE = 1 << 62
#: Stands for a null vec_id, after all others.
LAST = (1 << 63) - 1


def scaled(rows: DataFrame, anchor: Column, scale: float) -> DataFrame:
    """(vec_id, label, q, norm, anchor): floor(scale x) of each component; without rows of null label, null vector or a component that is
    null or not finite."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
    whole = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(scale * x.cast("double"), F.lit(-float(MOST))), F.lit(float(MOST)))).cast("int"))
    out = held.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST)).alias("vec_id"), "label", whole.alias("q"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    return out.withColumn("norm", F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def first(k: int, owner: np.ndarray, score: np.ndarray, turn: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which entries are among their owner's first k by falling score, then turn, then place; in that order."""
    order = np.lexsort((place, turn, -score, owner))
    own = owner[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def scan(a: dict[str, np.ndarray], c: dict[str, np.ndarray], k: int, same: bool, bucket: int = BUCKET, block: int = 1024) -> tuple[list[np.ndarray], int]:
    """((owner, score, vec_id, place) of the first k rows for each window of each anchor, how many pairs were scored).

    ``a``: x, norm, label, place, and low, high, kth with a column a window; ``c``: x, norm, label, place, vec_id by falling norm. An owner is
    the number of the anchor times the number of windows plus that of the window."""
    windows = a["low"].shape[1]
    kth = a["kth"].copy()
    best = [np.zeros(0, np.int64)] * 4
    exact = np.abs(a["x"]).max(initial=0) * np.abs(c["x"]).max(initial=0) * max(a["x"].shape[1], 1) < 2**53
    scored = 0
    for at in range(0, len(c["x"]), bucket):
        part = {name: v[at : at + bucket] for name, v in c.items()}
        least = np.maximum(kth, -(-a["low"] // 100)).min(1)
        reach = a["norm"] * part["norm"].max() * (1 + 1e-9)
        active = np.flatnonzero(reach >= least)
        if not len(active):
            break  # norms fall: no later bucket can reach either
        turns = np.argsort(part["vec_id"], kind="stable")
        x, label, place, vec_id = (part[n][turns] for n in ("x", "label", "place", "vec_id"))
        new = [best]
        for b in range(0, len(active), block):
            rows = active[b : b + block]
            scored += len(rows) * len(x)
            s = (a["x"][rows] @ x.T).astype(np.int64) if exact else a["x"][rows].astype(np.int64) @ x.T.astype(np.int64)
            meets = (a["label"][rows, None] == label) if same else (a["label"][rows, None] != label)
            meets &= a["place"][rows, None] != place
            for w in range(windows):
                ok = meets & (s >= kth[rows, w, None]) & (100 * s >= a["low"][rows, w, None]) & (100 * s <= a["high"][rows, w, None])
                if len(x) > k and ok.sum() > 4 * k * len(rows):
                    masked = np.where(ok, s, -NONE)
                    ok &= s >= np.partition(masked, -k, axis=1)[:, -k, None]
                row, pick = np.nonzero(ok)
                new.append([rows[row] * windows + w, s[row, pick], vec_id[pick], place[pick]])
        best = [np.concatenate(v) for v in zip(*new, strict=True)]
        keep = first(k, *best)
        best = [v[keep] for v in best]
        last = np.searchsorted(best[0], best[0], side="right") - 1  # of full owners, the k-th entry
        full = np.flatnonzero(last - np.searchsorted(best[0], best[0]) == k - 1)
        kth.reshape(-1)[best[0][full]] = best[1][last[full]]
    return best, scored


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id", "place")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _wave(anchors: DataFrame, rows: DataFrame, norms: list[float], begin: int, k: int, same: bool) -> DataFrame | None:
    """(anchor, window, score, vec_id, place) from the chunks from ``begin`` on that a block of anchors can need; None if there are none."""
    spark = rows.sparkSession
    least = F.array_min(F.zip_with("kth", "low", lambda x, y: F.greatest(x, F.ceil(y / 100))))
    need = F.when(least <= 0, 0.0).when(F.col("norm") > 0, least / F.col("norm") * (1 - 1e-9)).otherwise(float("inf"))
    blocks = anchors.groupBy("block").agg(F.min(need).alias("need")).orderBy("need", "block").collect()
    falling = -np.array(norms)
    spans = [(r["block"], n, int(np.searchsorted(falling, -r["need"], side="right"))) for n, r in enumerate(blocks)]  # blocks that need most come first
    spans = [(block, n, end) for block, n, end in spans if end > begin]
    if not spans:
        return None
    ends = np.array([end for _, _, end in spans])
    takers = [(c, int((ends > c).sum())) for c in range(begin, int(ends.max()))]
    left = anchors.join(F.broadcast(spark.createDataFrame(spans, "block long, n int, ends int")), "block")
    left = left.withColumn("chunk", F.explode(F.sequence(F.lit(begin), F.col("ends") - 1)))
    right = rows.withColumn("chunk", F.floor(F.col("place") / CHUNK).cast("int")).join(F.broadcast(spark.createDataFrame(takers, "chunk int, takers int")), "chunk")
    right = right.withColumn("n", F.explode(F.sequence(F.lit(0), F.col("takers") - 1)))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["anchor", "window", "score", "vec_id", "place"]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int32() if n == "window" else pa.int64()) for n in names})
        right = right.sort_by("place")
        width = max(max(x["q"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max(initial=0) for x in (left, right)), 1)
        codes = np.unique(np.array(left["label"].to_pylist() + right["label"].to_pylist()), return_inverse=True)[1]
        get = lambda t, n: t[n].to_numpy()
        a = {"x": _matrix(left["q"], width), "norm": get(left, "norm"), "label": codes[: left.num_rows], "place": get(left, "place")}
        a |= {n: np.array(left[n].to_pylist(), np.int64) for n in ("low", "high", "kth")}
        c = {"x": _matrix(right["q"], width), "label": codes[left.num_rows :], **{n: get(right, n) for n in ("norm", "place", "vec_id")}}
        (owner, score, vec_id, place), _ = scan(a, c, k, same)
        windows = a["low"].shape[1]
        return pa.table([pa.array(a["place"][owner // windows]), pa.array((owner % windows).astype(np.int32)), *map(pa.array, (score, vec_id, place))], names=names)

    left = left.select("n", "chunk", "place", "label", "q", "norm", "low", "high", "kth").groupBy("n", "chunk")
    right = right.select("n", "chunk", "place", "vec_id", "label", "q", "norm").groupBy("n", "chunk")
    return left.cogroup(right).applyInArrow(solve, "anchor long, window int, score long, vec_id long, place long")


def search(anchors: DataFrame, rows: DataFrame, norms: list[float], k: int, same: bool) -> DataFrame:
    """(anchor, window, rank, score, vec_id, place): for each window of each anchor (place, block, label, q, norm, low, high) the first k
    of ``rows`` (place, vec_id, label, q, norm) of its label, or of others, whose hundredfold score lies in the window. Places number
    the rows by falling norm; ``norms`` has the largest norm of each chunk of places."""
    anchors = anchors.withColumn("kth", F.transform("low", lambda x: F.lit(-NONE)))
    found = _wave(anchors, rows, norms[:1], 0, k, same)
    if found is None:
        return rows.sparkSession.createDataFrame([], "anchor long, window int, score long, vec_id long, place long, rank int")
    if len(norms) > 1:
        found = materialize(found, "first-chunk")
        ends = found.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        ends = ends.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "least"))).alias("ends"))
        held = anchors.join(ends.withColumnRenamed("anchor", "place"), "place", "left")
        held = held.withColumn("kth", F.transform("low", lambda x, w: F.coalesce(F.element_at("ends", w.cast("int")), F.lit(-NONE)))).drop("ends")
        rest = _wave(materialize(held, "anchors"), rows, norms, 1, k, same)
        found = found if rest is None else found.unionByName(rest)
    return _top(found, k)


def mine(rows: DataFrame, anchor: Column, scale: float = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (vec_id, label, embedding).

    A score is the inner product of the vectors whose components are floor(``scale`` x). An anchor's positives are its first
    ``positives`` other rows of the same label; for each, the first ``negatives`` rows of another label whose score is at least ``low``
    and at most ``high`` percent of the positive's. Higher scores come first, ties by smaller vec_id.

    Rows with a null label, a null vector, or a component that is null or not finite take no part. A shorter vector is as if it went
    on with zeros. Scaled components beyond 2^26 count as that. Repeated rows are rows of their own: a copy may be a positive, and
    ties of one vec_id keep the order of the norms. A null vec_id comes after all others and is returned as null. An empty
    table, or anchors without positives or without rows in the window, give no rows. Other columns aren't read.
    """
    bounded_batches(rows.sparkSession)
    placed = ranked(materialize(scaled(rows, anchor, scale), "scaled"), [F.col("norm").desc(), "vec_id", "label", "q"], "by-norm")
    placed = materialize(placed, "placed")
    norms = [r["norm"] for r in placed.groupBy(F.floor(F.col("place") / CHUNK).alias("chunk")).agg(F.max("norm").alias("norm")).orderBy("chunk").collect()]
    columns = ["place", "vec_id", "label", "q", "norm"]
    anchors = ranked(placed.where("anchor").select(*columns, F.col("place").alias("at")).drop("place"), ["at"], "anchors")
    anchors = anchors.select(F.floor(F.col("place") / BLOCK).alias("block"), F.col("at").alias("place"), "vec_id", "label", "q", "norm")
    anchors = materialize(anchors, "anchor-blocks")
    open_ = anchors.withColumns({"low": F.array(F.lit(-NONE)), "high": F.array(F.lit(NONE))})
    near = materialize(search(open_, placed.select(*columns), norms, positives, same=True), "positives")
    near = near.select(F.col("anchor").alias("place"), (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive"), F.col("score").alias("positive_score"))
    each = near.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("window", "positive", "positive_score"))).alias("near"))
    asked = anchors.join(each, "place")
    asked = asked.withColumns({"low": F.transform("near", lambda x: low * x["positive_score"]), "high": F.transform("near", lambda x: high * x["positive_score"])})
    found = search(asked.drop("near"), placed.select(*columns), norms, negatives, same=False)
    found = found.select(F.col("anchor").alias("place"), "window", "rank", F.col("vec_id").alias("negative"), F.col("score").alias("negative_score"))
    named = found.join(near, ["place", "window"]).join(anchors.select("place", F.col("vec_id").alias("anchor")), "place")
    back = lambda x: F.when(F.col(x) != LAST, F.col(x)).alias(f"{x}_id")
    return named.select(back("anchor"), back("positive"), F.col("rank").cast("int").alias("rank"), back("negative"), "positive_score", "negative_score")


def mine_sql() -> str:
    return """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, list_dot_product(a.q, c.q)::BIGINT AS s
              FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT a, c, s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, c) AS r FROM s WHERE same) WHERE r <= 5),
        n AS (SELECT s.a, p.c AS p, s.c AS n, p.s AS ps, s.s AS ns, row_number() OVER (PARTITION BY s.a, p.c ORDER BY s.s DESC, s.c) AS r
              FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s)
        SELECT a AS anchor_id, p AS positive_id, r::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 10
    """
