"""Lines that several documents hold, kept in one of them only, by levelled sorted runs of line hashes.

A run is a table of (key, docs, last): the 128-bit digest of a line, how many documents of some batches hold it, and the largest of
their doc_ids. Runs are bucketed and sorted by key, so a new batch meets them by merge join without shuffling them. A batch adds a
run of its own, without the keys that a run has settled: found in enough documents already, the last of them not before the batch's.
When ``fan`` runs stand on a level they are merged into one run of the next, so a batch meets few runs, and each key is written again
once a level. Reading the runs together gives every line's documents, and a second pass over the texts drops lines.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm.common import SLICE_BYTES, ascii_lower, bounded_batches, join_spread, materialize, null_to_empty, shared_dir

#: White space that doesn't count at the ends of a line.
WHITE = b" \t\n\x0b\x0c\r"
#: Keys that a task holds before it hands them on.
EMITTED = 50_000


def line_keys(text: bytes, least: int) -> list[bytes | None]:
    """The digest of each line, stripped and A-Z lower-cased; None where that has fewer than ``least`` code points."""
    lowered = ascii_lower(np.frombuffer(text, np.uint8)).tobytes()
    out: list[bytes | None] = []
    for line in lowered.split(b"\n"):
        line = line.strip(WHITE)
        if len(line) < least or (not line.isascii() and len(line.decode("utf-8", "surrogatepass")) < least):
            out.append(None)
        else:
            out.append(hashlib.blake2b(line, digest_size=16).digest())
    return out


class Runs:
    """Levelled runs of keys in the folder that driver and executors share. Batches may come in any order, but all rows of a
    doc_id in one batch; falling doc_ids settle keys soonest."""

    def __init__(self, spark: SparkSession, enough: int, fan: int = 3) -> None:
        self.spark, self.enough, self.fan = spark, enough, fan
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]

    def _write(self, rows: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = rows.select("key", "docs", "last").repartition(self.buckets, "key").sortWithinPartitions("key")
        dealt.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{shared_dir(self.spark)}/loomgrid/{name}").saveAsTable(name)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """One row a key: the runs are merged two by two."""
        while len(runs) > 1:
            joined = []
            for a, b in zip(runs[::2], runs[1::2], strict=False):
                b = b.select("key", F.col("docs").alias("docs_b"), F.col("last").alias("last_b"))
                docs = F.coalesce("docs", F.lit(0)) + F.coalesce("docs_b", F.lit(0))
                joined.append(a.join(b, "key", "full").select("key", docs.alias("docs"), F.greatest("last", "last_b").alias("last")))
            runs = joined + (runs[-1:] if len(runs) % 2 else [])
        return runs[0]

    def add(self, keys: DataFrame) -> None:
        """A batch of (doc_id, key), each pair once."""
        own = keys.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last"))
        for run in self.runs():
            settled = run.where(F.col("docs") >= self.enough).select("key", F.col("last").alias("after"))
            own = own.join(settled, (own["key"] == settled["key"]) & (F.col("last").isNull() | (F.col("last") <= F.col("after"))), "left_anti")
        self.levels[0].append(self._write(own))
        for level, runs in enumerate(self.levels):
            if len(runs) < self.fan:
                break
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._merged(runs)))
            self.levels[level] = []

    def settled(self) -> DataFrame:
        """(key, docs, last) of the keys found in enough documents."""
        return self._merged(self.runs()).where(F.col("docs") >= self.enough)


def _batches(docs: DataFrame, batches: int) -> tuple[Column, int]:
    """Number of each row's batch, and how many there are: ranges of falling doc_id of about equal size, null last; for ids that
    aren't numbers, by their hash."""
    if dict(docs.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return F.pmod(F.xxhash64("doc_id"), F.lit(batches)), batches
    cuts = sorted(set(docs.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01)), reverse=True) if batches > 1 else []
    number = F.lit(len(cuts))
    for k, cut in reversed(list(enumerate(cuts))):
        number = F.when(F.col("doc_id") > cut, k).otherwise(number)
    return number, len(cuts) + 1


def repeated_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int = 4, fan: int = 3) -> DataFrame:
    """(doc_id, keys) of the documents that lose lines: digests of the lines that at least ``least_docs`` documents hold, of which
    this one isn't the last."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]

    def digest(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            keys, rows = [], []
            for i, text in enumerate(null_to_empty(batch.column(2))):
                own = {k for k in line_keys(text.as_py(), least_chars) if k}
                keys += own
                rows.append(np.full(len(own), i))
                if len(keys) > EMITTED or i + 1 == batch.num_rows:
                    at = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(keys, pa.binary())], names=["doc_id", "batch", "key"])
                    keys, rows = [], []

    number, many = _batches(docs, batches)
    numbered = docs.select("doc_id", number.cast("int").alias("batch"), "text")
    found = numbered.mapInArrow(digest, f"doc_id {kind}, batch int, key binary")
    path = f"{shared_dir(spark)}/loomgrid/line-keys-{uuid.uuid4().hex}"
    found.write.partitionBy("batch").parquet(path)
    keys = spark.read.schema(f"doc_id {kind}, key binary, batch int").parquet(path)
    runs = Runs(spark, least_docs, fan)
    for k in range(many):
        runs.add(keys.where(F.col("batch") == k).select("doc_id", "key").distinct())
    settled = materialize(runs.settled(), "settled-lines")
    lost = join_spread(keys.select("doc_id", "key"), settled, "key", "docs").where(~F.col("doc_id").eqNullSafe(F.col("last")))
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def drop_repeated_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int = 4, fan: int = 3) -> DataFrame:
    """(doc_id, kept, n_lines, n_dropped): texts without the lines that a later document holds too.

    Lines are what stands between newlines, all of a text; a line's key is the line with ASCII white space stripped at both ends
    and A-Z lower-cased. Keys of at least ``least_chars`` code points found in at least ``least_docs`` documents lose all their
    lines, repeats within a document included, but those of the largest doc_id holding it. Other lines stay as they are, joined by
    newlines.

    A null or empty text is one empty line and stays (``kept`` is empty). Rows of one doc_id count as one document for the lines
    they share; each is returned with its own text. Rows without doc_id are one document before all others. A text of any length is
    one row and is read whole. Empty tables give an empty result. Other columns, whatever their names, aren't read.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    gone = materialize(repeated_lines(docs, least_chars, least_docs, batches, fan), "lost-lines")
    gone = gone.withColumnRenamed("doc_id", "of")
    met = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "text", "keys")

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts, kept, sizes, begun = null_to_empty(batch.column(1)), [], [], 0
            for i in range(batch.num_rows):
                text, lost = texts[i].as_py(), batch.column(2)[i].as_py()
                if lost:
                    lost = set(lost)
                    lines = text.split(b"\n")
                    left = [line for line, key in zip(lines, line_keys(text, least_chars), strict=True) if key not in lost]
                    kept.append(b"\n".join(left))
                    sizes.append((len(lines), len(lines) - len(left)))
                else:
                    kept.append(text)
                    sizes.append((text.count(b"\n") + 1, 0))
                if len(kept[-1]) > SLICE_BYTES or len(kept) == 256 or i + 1 == batch.num_rows:
                    n = np.array(sizes)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begun, len(kept)), pa.array(kept, pa.binary()), pa.array(n[:, 0]), pa.array(n[:, 1])], names=["doc_id", "kept", "n_lines", "n_dropped"])
                    kept, sizes, begun = [], [], i + 1

    return met.mapInArrow(cut, f"doc_id {kind}, kept binary, n_lines long, n_dropped long")


def drop_repeated_lines_sql() -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        l AS (SELECT doc_id, n, a[n] AS line, trim(b[n], {white}) AS key
              FROM (SELECT doc_id, a, b, unnest(range(1, len(a) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS a, string_split({lower}, chr(10)) AS b FROM d))),
        r AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        m AS (SELECT l.doc_id, n, line, coalesce(last <> l.doc_id, false) AS lost FROM l LEFT JOIN r USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT lost), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """
