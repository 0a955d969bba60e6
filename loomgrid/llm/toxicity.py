"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Presence of each hashed n-gram of bytes (A-Z lower-cased, texts framed by spaces) is scaled by
r = log((p + a) / |p|) - log((q + a) / |q|), p and q being how many toxic and other training
texts hold it; ratios of weak evidence shrink towards zero, since a rare n-gram's ratio is mostly
chance. A logistic regression with an L2 penalty is fitted on the scaled features. All 2 ** 20 take
part; none is left out for being rare or weak.

The fit reads a bounded sample of labelled texts: at most ``max_positive`` + ``max_negative``, taken by
the smallest hash of their id, and of these, in that order, as many as hold ``max_entries`` features together, which
bounds what the task that fits holds, however long the texts are; the driver gets one weight a feature. Class weights undo the choice, so scores stay
probabilities. Scoring is map-only over whole texts. Labels, language, source and id are never inputs of a score.

Null and empty texts hold no n-gram and get the model's base score. Very long texts are read in pieces
and scored whole. Repeated rows, and rows of null or repeated ids, are scored each; in the sample they
count as often as they are there. Ties of the ids' hashes go to the smaller id. Null labels and ids
aren't learned from. Without labelled rows of both classes the score is the share of toxic ones (0 without
any). An empty table gives no rows. Extra columns stay; one named like the score is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import ascii_lower, materialize, text_buffer

#: Lengths of the n-grams in bytes, and bits of a feature's number.
SIZES, BITS = (3, 4, 6, 8), 20
_ODD = {3: 0x9E3779B97F4A7C15, 4: 0xC2B2AE3D27D4EB4F, 6: 0x165667B19E3779F9, 8: 0xD6E8FEB86659FD93}
#: Bytes of a text that are read at once, features of the sample that the fit works on at once.
_PIECE, _ENTRIES = 1 << 18, 1 << 20


@dataclass
class Model:
    """Weight (ratio times coefficient) of each feature, and the intercept."""

    weights: np.ndarray
    intercept: float


def _hashed(framed: np.ndarray) -> np.ndarray:
    """Feature of each n-gram of a framed text or piece of one."""
    n = len(framed)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = framed
    words = np.ndarray((n,), "<u8", padded, strides=(1,))
    out = []
    for size in SIZES:
        x = words[: max(n - size + 1, 0)]
        if size < 8:
            x = x & np.uint64((1 << 8 * size) - 1)
        out.append((((x ^ (x >> np.uint64(29))) * np.uint64(_ODD[size])) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out)


def hash_of(gram: bytes) -> int:
    """Feature of one n-gram, for tests and reports."""
    x = int.from_bytes(gram, "little")
    return ((x ^ x >> 29) * _ODD[len(gram)] & (1 << 64) - 1) >> 64 - BITS


def grams(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct features of each text, in no order; nothing for an empty one."""
    data, offsets = text_buffer(column)
    last = np.zeros(1 << BITS, np.int32)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if a == b:
            yield np.zeros(0, np.int32)
        elif b - a <= _PIECE:
            framed = np.full(b - a + 2, 32, np.uint8)
            framed[1:-1] = ascii_lower(data[a:b])
            h = _hashed(framed)
            at = np.arange(len(h), dtype=np.int32)
            last[h] = at
            yield h[last[h] == at]  # each feature where it stands last
        else:
            held = np.zeros(1 << BITS, bool)
            for k in range(a, b, _PIECE):
                piece = ascii_lower(data[k : min(k + _PIECE + max(SIZES) - 1, b)])
                ends = [np.full(1, 32, np.uint8)] * (k == a), [np.full(1, 32, np.uint8)] * (k + _PIECE + max(SIZES) - 1 >= b)
                held[_hashed(np.concatenate([*ends[0], piece, *ends[1]]))] = True
            yield np.flatnonzero(held).astype(np.int32)


def training_rows(docs: DataFrame, labels: DataFrame, max_positive: int, max_negative: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, label, turn) of the sample, to be read in the order of ``turn``, and how many labelled rows each class has.
    The sample's ids are at most ``max_positive`` + ``max_negative`` rows of two numbers, so they are broadcast."""
    at = F.col("doc_id").cast("string")
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (F.crc32(at) % 4 != 2)).select("doc_id", F.col("toxic").cast("int").alias("__label"))
    counts = {r["__label"]: r["n"] for r in usable.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bound = {0: max_negative, 1: max_positive}
    parts = [usable.where(F.col("__label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound[k]) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "__label", F.xxhash64("doc_id").alias("__turn")), counts


def _first(sample: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The sample's rows, in the order of ``turn``, that hold ``most`` features together, and how many they hold."""
    total = sample.agg(F.sum("size")).first()[0] or 0
    if total <= most:
        return sample, total
    order, total = ["turn", "label", "digest", "row"], 0
    for r in sample.select(*order, "size").orderBy(*order).toLocalIterator():  # five numbers a row
        if total + r["size"] > most:
            break
        total += r["size"]
    return sample.where(F.struct(*order) < F.struct(*(F.lit(r[c]).cast(sample.schema[c].dataType).alias(c) for c in order))), total


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 1_500, max_negative: int = 2_500, max_entries: int = 50_000_000, alpha: float = 0.5, doubt: float = 10.0, penalty: float = 0.02) -> Model:
    """The model. A task fits it, which holds at most ``max_entries`` features of three bytes; the driver gets the weights alone. Ratios of weak
    evidence shrink smoothly towards zero, by half where their square is about 2.4 times ``doubt`` squared standard errors."""
    rows, counts = training_rows(docs, labels, max_positive, max_negative)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x.tobytes() for x in grams(b.column(0))]
            sizes = pa.array([len(x) // 4 for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), b.column(1), b.column(2), sizes], names=["features", "label", "turn", "size"])

    sample = rows.mapInArrow(gather, "features binary, label int, turn long, size long")
    sample = materialize(sample.select("*", F.xxhash64("features").alias("digest"), F.monotonically_increasing_id().alias("row")), "toxicity-sample")
    sample, total = _first(sample, max_entries)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # three bytes a feature, in two columns
        low, high, sizes, y, at = np.empty(total, np.uint16), np.empty(total, np.uint8), [], [], 0
        for b in batches:
            data, ends = text_buffer(b.column(0))
            found = np.frombuffer(data, np.int32)
            low[at : at + len(found)] = found & 0xFFFF
            high[at : at + len(found)] = found >> 16
            at += len(found)
            sizes.append(np.diff(ends) // 4)
            y.append(b.column(1).to_numpy(zero_copy_only=False))
        model = _fitted(low, high, np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(y).astype(float), counts, alpha, doubt, penalty) if y else None
        if model is not None:
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.intercept])], names=["weights", "intercept"])

    # the order, and so the sums, don't hang on the tasks
    ordered = sample.select("features", "label", "turn", "digest", "row").repartition(1).sortWithinPartitions("turn", "label", "digest", "row").select("features", "label")
    model = ordered.mapInArrow(train, "weights binary, intercept double").first()
    if model is None:
        return Model(np.zeros(1 << BITS, np.float32), _logit(counts.get(1, 0) / max(sum(counts.values()), 1)))
    return Model(np.frombuffer(model["weights"], np.float32), model["intercept"])


def _fitted(low: np.ndarray, high: np.ndarray, ends: np.ndarray, y: np.ndarray, counts: dict[int, int], alpha: float, doubt: float, penalty: float) -> Model | None:
    """The model of rows with labels y; row i holds the features ends[i] to ends[i + 1] of the columns. None if there is one label alone."""
    if y.min() == y.max():
        return None
    n = np.array([(y == k).sum() for k in (0, 1)], float)
    weight = np.array([max(1.0, counts[k] / n[k]) for k in (0, 1)])[y.astype(int)]

    def column(a: int, b: int) -> np.ndarray:
        return high[a:b].astype(np.int32) << 16 | low[a:b]

    held = np.zeros((2, 1 << BITS))
    for i in range(len(y)):
        held[int(y[i]), column(ends[i], ends[i + 1])] += 1  # a text's features are distinct
    rate = (held + alpha) / (n[:, None] + 2 * alpha)
    ratio = np.log(rate[1] / rate[0])
    evidence = ratio**2 / (1 / (held + alpha)).sum(0)  # in squared standard errors
    ratio *= (evidence / (evidence + doubt)) ** 2
    coefficient, intercept = _logistic(column, ends, ratio, y, weight, penalty)
    return Model((coefficient * ratio).astype(np.float32), intercept)


def _logit(p: float) -> float:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return float(np.log(p / (1 - p)))


def _logistic(column: Callable[[int, int], np.ndarray], ends: np.ndarray, scale: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float, steps: int = 10) -> tuple[np.ndarray, float]:
    """Weighted logistic loss plus penalty / 2 times the squared norm, by L-BFGS with backtracking, stopped after
    ``steps``, where log loss was least in a validation on training folds. Row i holds the features column(ends[i], ends[i + 1])."""
    n, d = len(y), len(scale)
    cuts = [0]  # blocks of rows, of so many features or one row each
    for i in range(1, n):
        if ends[i + 1] - ends[cuts[-1]] > _ENTRIES:
            cuts.append(i)
    blocks = list(zip(cuts, [*cuts[1:], n], strict=True))

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        value, z, g = theta[:d] * scale, np.empty(n), np.zeros(d)
        for i, j in blocks:
            full = np.flatnonzero(np.diff(ends[i : j + 1]))
            z[i:j] = theta[d]
            if len(full):
                z[i + full] += np.add.reduceat(value[column(ends[i], ends[j])], ends[i + full] - ends[i])
        e = w * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        for i, j in blocks:
            g += np.bincount(column(ends[i], ends[j]), np.repeat(e[i:j], np.diff(ends[i : j + 1])), d)
        g = g * scale + penalty * theta[:d]
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + penalty / 2 * (theta[:d] ** 2).sum()), np.append(g, e.sum())

    theta = np.append(np.zeros(d), _logit(float((w * y).sum() / w.sum())))
    f, g = loss(theta)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []  # the last steps, in half the bytes, with their product
    for _ in range(steps):
        q, keep = g.copy(), []
        for s, t, st in reversed(past):
            a = s @ q / st
            q -= a * t
            keep.append(a)
        if past:
            _, t, st = past[-1]
            q *= st / float(t @ t)
        else:
            q /= max(1.0, np.abs(g).max())
        for (s, t, st), a in zip(past, reversed(keep), strict=True):
            q += s * (a - t @ q / st)
        step, slope = 1.0, -(g @ q)
        while True:
            new = theta - step * q
            f2, g2 = loss(new)
            if f2 <= f + 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        s, t = new - theta, g2 - g
        if s @ t > 1e-12:
            past = [*past[-9:], (s.astype(np.float32), t.astype(np.float32), float(s @ t))]
        done = abs(f - f2) <= 1e-6 * max(1.0, abs(f))
        theta, f, g = new, f2, g2
        if done:
            break
    return theta[:d], float(theta[d])


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with ``out``: the probability that the text is toxic. Map-only."""
    keep = [c for c in df.columns if c != out]
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            z = np.array([m.weights[f].sum(dtype=float) for f in grams(b.column(at))]) + m.intercept
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*keep, out])

    kinds = dict(df.dtypes)
    return df.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in keep) + f"`{out}` double")
