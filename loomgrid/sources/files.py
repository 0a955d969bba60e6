"""Single files in any store Spark knows, written piece by piece."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def write_pieces(spark: SparkSession, path: str, pieces: Iterable[bytes]) -> None:
    """The pieces one after the other as a file; the driver holds one at a time."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        for piece in pieces:
            out.write(bytearray(piece))
    finally:
        out.close()
