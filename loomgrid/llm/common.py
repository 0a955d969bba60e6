"""Helpers shared by the training-data operators: shared-folder tables and Arrow text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.sources.stored import shared_dir, stored  # noqa: F401

#: Bytes of text that a numpy kernel works on at once; bounds temporary arrays whatever the batch holds.
SLICE_BYTES = 1 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than the session's defaults, since rows here are whole texts; a setting of the user's stays."""
    for key, default, value in (("maxBytesPerBatch", "67108864b", "16m"), ("maxRecordsPerBatch", "10000", "4000")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", default) == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """:func:`loomgrid.sources.stored.stored`, in batches of bounded size."""
    bounded_batches(df.sparkSession)
    return stored(df, label)


def join_spread(rows: DataFrame, table: DataFrame, key: str, weight: str, most: int = 10_000) -> DataFrame:
    """``rows`` inner-joined with ``table``, which has one row a key and in ``weight`` how many rows have it.

    The ``most`` keys of largest weight are sent to the tasks, so of those that are shuffled none holds more than one row
    in ``most``, however frequent a key is. ``rows`` and ``table`` are read several times and should be stored.
    """
    hot = materialize(table.orderBy(F.desc(weight), key).limit(most), "frequent").drop(weight)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.drop(weight), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def ranked(rows: DataFrame, order: list, label: str) -> DataFrame:
    """``rows`` with ``place``: their number from 0 in the order, over all of them. Rows are sorted by ranges, so no task holds them all,
    and only the size of each range comes to the driver. Rows equal in the whole order are numbered in any way."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = materialize(placed, label)
    sizes = placed.groupBy(F.shiftright("place", 33).alias("range")).count().orderBy("range").collect()
    starts, before = [], 0
    for r in sizes:
        starts.append((r["range"], before))
        before += r["count"]
    starts = placed.sparkSession.createDataFrame(starts, "range long, before long").select(F.col("range").alias("__range"), F.col("before").alias("__before"))
    met = placed.join(F.broadcast(starts), F.shiftright("place", 33) == F.col("__range"))
    return met.withColumn("place", F.col("__before") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("__range", "__before")


def null_to_empty(column: pa.Array) -> pa.Array:
    """Strings or binaries as large_binary; null becomes empty."""
    column = column.cast(pa.large_binary())
    return pc.fill_null(column, b"") if column.null_count else column


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts as uint8, n + 1 offsets); a null is empty."""
    column = null_to_empty(column)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts with about ``most`` bytes each; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64 over uint64, wrapping."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased byte by byte; other bytes of UTF-8 are never in that range."""
    return _LOWER[data]
