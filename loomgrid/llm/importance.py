"""Importance resampling towards a target: a bag of hashed word runs of the corpus against that of a target set.

Two passes of Arrow batches over the texts. In the first each task counts the features of its texts into
one vector of ``buckets`` numbers by ``np.bincount``, whatever it reads; ``treeReduce`` merges the vectors, so the
driver gets one. In the second each task gathers a feature's gain by its bucket and sums a document's gains by
``np.bincount`` with weights. Gains are whole numbers, so sums are exact in any order. Drawing the highest scores is a
range sort of thin rows: a row's rank is its place in its range plus the sizes of the ranges before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import ascii_lower, bounded_batches, materialize, ranked, slices, text_buffer

#: Bytes up to which words are hashed side by side; longer ones go one at a time.
SIDE_BY_SIDE = 64

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _crc_table() -> np.ndarray:
    """Of CRC-32 with the reflected polynomial 0xEDB88320."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return t


_CRC = _crc_table()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the words of lower-cased texts laid end to end: digits, a-z and bytes from 0x80 on."""
    is_word = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = is_word.copy()
    start[1:] &= ~is_word[:-1] | edge[1:-1]
    end = is_word.copy()
    end[:-1] &= ~is_word[1:] | edge[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray, crc: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of each data[start:end], going on from ``crc`` where given. One numpy step a byte position, over the words that
    have one; words of over ``SIDE_BY_SIDE`` bytes go one at a time."""
    size = end - start
    out = np.zeros(len(start), np.uint32) if crc is None else crc.copy()
    for k in np.flatnonzero(size > SIDE_BY_SIDE):
        out[k] = zlib.crc32(data[start[k] : end[k]].tobytes(), int(out[k]))
    short = np.flatnonzero(size <= SIDE_BY_SIDE)
    order = short[np.argsort(-size[short].astype(np.int8), kind="stable")]
    at, shorter, state = start[order], -size[order], ~out[order]
    for k in range(-int(shorter[0]) if len(order) else 0):
        m = int(np.searchsorted(shorter, -k))  # words of more than k bytes
        state[:m] = _CRC[(state[:m] ^ data[at[:m] + k]) & np.uint32(255)] ^ (state[:m] >> np.uint32(8))
    out[order] = ~state
    return out


def features(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of all runs of one word, then of two, and so on up to ``longest``."""
    start, end, text = words(data, offsets)
    crc = np.zeros(len(start), np.uint32)
    for n in range(longest):
        if n:  # each run of n words, a space, and the word after it in the same text
            crc, held = ~crc[:-1], text[n:] == text[:-n]
            crc = ~(_CRC[(crc ^ np.uint32(32)) & np.uint32(255)] ^ (crc >> np.uint32(8)))
        else:
            held = np.ones(len(start), bool)
        crc = crc32(data, start[n:], end[n:], crc)
        yield text[n:][held], (crc[held] % np.uint32(buckets)).astype(np.int64)
        if len(crc) < 2:
            return


def bucket_counts(texts: DataFrame, column: str = "text", buckets: int = 10_000, longest: int = 1) -> np.ndarray:
    """How many features of all texts fall in each bucket. Null and empty texts have none; an empty table gives zeros."""
    bounded_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for i, j in slices(offsets):
                for _, bucket in features(ascii_lower(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i], longest, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["n"])

    parts = texts.select(column).mapInArrow(count, "n binary").rdd.map(lambda r: np.frombuffer(r["n"], np.int64))
    return parts.treeReduce(np.add) if parts.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share of the target / share of the corpus)) of each bucket, both counts one larger."""
    s, t = corpus.astype(float), target.astype(float)
    n = float(len(s))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n))))


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of the gains of a document's features."""
    bounded_batches(docs.sparkSession)
    buckets = len(gain)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            sums = np.zeros((3, batch.num_rows), np.int64)
            for i, j in slices(offsets):
                for n, (text, bucket) in enumerate(features(ascii_lower(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i], longest, buckets)):
                    many = np.bincount(text, minlength=j - i)
                    sums[0, i:j] += many if n == 0 else 0
                    sums[1, i:j] += many
                    sums[2, i:j] += np.bincount(text, gain[bucket], j - i).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums)], names=["doc_id", "n_words", "n_features", "weight"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(solve, f"doc_id {kind}, n_words long, n_features long, weight long")


def drawn(scored: DataFrame, share: int, least_words: int) -> DataFrame:
    """``scored`` (doc_id, n_words, n_features, weight, score) with ``rank``: of the N rows of at least ``least_words`` words the
    first floor(share N / 100) by falling score, then doc_id, null last; null for the others.

    The rows are sorted by ranges, so no task holds them all; only the size of each range comes to the driver."""
    scored = scored.withColumn("late", (F.col("n_words") < least_words).cast("int"))
    many = scored.where("late = 0").count() * share // 100
    order = ["late", F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "n_words", "weight"]
    rank = F.col("place") + 1
    return ranked(scored, order, "ranked").withColumn("rank", F.when(rank <= many, rank))


def resample(docs: DataFrame, target: DataFrame, share: int = 10, least_words: int = 20, seed: int = 2024, buckets: int = 10_000, longest: int = 1) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text), drawn towards the texts of ``target``.

    Words are A-Z lower-cased runs of digits, letters and bytes beyond ASCII of whole texts; features are all runs of up to
    ``longest`` of them, repeats counted. A score is the weight plus Gumbel noise from the digest of seed and doc_id, so that the
    highest ``share`` percent are a draw without replacement in proportion to exp(weight / 1000).

    Null and empty texts have no features and weight 0. Texts of any length are read whole, in slices of whole texts. A null
    doc_id has the digest of an empty one and comes last among equal scores. Repeated rows each count and are ranked; equal ones
    are interchangeable. Without a target all gains follow from the corpus alone; an empty table gives an empty result. Other
    columns, whatever their names, aren't read.
    """
    docs, target = docs.select("doc_id", "text"), target.select("text")
    gain = gains(bucket_counts(docs, "text", buckets, longest), bucket_counts(target, "text", buckets, longest))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = materialize(weigh(docs, gain, longest).withColumn("score", F.col("weight") + noise), "weighed")
    return drawn(scored, share, least_words).select("doc_id", "n_features", "weight", "score", "rank")


def resample_sql() -> str:
    """The query in SQL, with the CRC folded over the bytes of each distinct word."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
        WITH step AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
                      FROM (SELECT unnest(range(256)) AS n)),
        dw AS (SELECT doc_id, unnest({found}) AS w FROM documents),
        tw AS (SELECT unnest({found}) AS w FROM benchmark),
        crc AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)),
                       lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295) % 10000 AS b
                FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM tw)), step),
        s AS (SELECT b, count(*) AS s FROM dw JOIN crc USING (w) GROUP BY b),
        t AS (SELECT b, count(*) AS t FROM tw JOIN crc USING (w) GROUP BY b),
        gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + 10000)
                        / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000))))::BIGINT AS g
                 FROM (SELECT unnest(range(10000)) AS b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
        sums AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS weight FROM dw JOIN crc USING (w) JOIN gain USING (b) GROUP BY doc_id),
        scored AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
                   + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
                   FROM documents d LEFT JOIN sums ON sums.doc_id = d.doc_id),
        ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS many FROM scored WHERE n_features >= 20)
        SELECT scored.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * many // 100 THEN rank END AS rank
        FROM scored LEFT JOIN ranked ON ranked.doc_id = scored.doc_id
    """
