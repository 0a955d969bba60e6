"""MAT-files (version 5) as tables.

A file holds an array column by column, the last dimension slowest, often as one deflated stream. A task reads it from Spark's binary
reader and inflates it as it goes; what leaves it is a row for each column of the raster and band, and a raster column's bands meet in a
second step. So no task holds a cube, and none of it comes to the driver.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.sources.files import write_pieces

#: Fixed values of the format: numpy type of each data type, and the numbers of compressed elements and matrices.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1"}
COMPRESSED, MATRIX = 15, 14
#: Bytes inflated at a time.
PIECE = 1 << 20


class Stream:
    """Bytes in order, some at a time."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held = pieces, b""

    def read(self, size: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < size and (piece := next(self.pieces, None)) is not None:
            parts.append(piece)
            have += len(piece)
        whole = b"".join(parts)
        self.held = whole[size:]
        return whole[:size]


def _inflated(data: memoryview) -> Iterator[bytes]:
    z = zlib.decompressobj()
    for at in range(0, len(data), PIECE):
        rest = bytes(data[at : at + PIECE])
        while rest:
            if made := z.decompress(rest, PIECE):
                yield made
            rest = z.unconsumed_tail
    yield z.flush()


def _tag(stream: Stream, order: str) -> tuple[int, int, bytes]:
    """(type, size, content if that is in the tag itself)."""
    head = stream.read(8)
    if len(head) < 8:
        return 0, 0, b""
    first, second = struct.unpack(order + "II", head)
    return (first & 0xFFFF, first >> 16, head[4 : 4 + (first >> 16)]) if first >> 16 else (first, second, b"")


def _content(stream: Stream, order: str) -> tuple[int, bytes]:
    kind, size, inside = _tag(stream, order)
    return (kind, inside) if inside else (kind, stream.read(-(-size // 8) * 8)[:size])


def lines(content: bytes, key: str) -> Iterator[tuple[int, int, np.ndarray]]:
    """(j, k, values): the k-th band of raster column j of the array named ``key``; an error if there is none of that name."""
    order = "<" if content[126:128] == b"IM" else ">"
    view, at = memoryview(content), 128
    while at + 8 <= len(view):
        kind, size = struct.unpack(order + "II", view[at : at + 8])
        body = view[at + 8 : at + 8 + size]
        at += 8 + (size if kind == COMPRESSED else -(-size // 8) * 8)
        stream = Stream(_inflated(body) if kind == COMPRESSED else (bytes(body[x : x + PIECE]) for x in range(0, len(body), PIECE)))
        if kind == COMPRESSED:
            kind, size, _ = _tag(stream, order)
        if kind != MATRIX or not size:
            continue
        _content(stream, order)  # flags
        dims = _content(stream, order)[1]
        shape = struct.unpack(f"{order}{len(dims) // 4}i", dims)
        if _content(stream, order)[1].decode() != key:
            continue
        kind, size, inside = _tag(stream, order)
        if kind not in TYPES:
            raise ValueError(f"{key} isn't an array of numbers")
        each = np.dtype(order + TYPES[kind])
        if inside:
            stream.held = inside + stream.held
        height, width = shape[0], shape[1]
        for k in range(int(np.prod(shape[2:]))):
            for j in range(width):
                yield j, k, np.frombuffer(stream.read(height * each.itemsize), each).astype(float)
        return
    raise ValueError(f"no array named {key}")


def pixels(spark: SparkSession, path: str, key: str, out: str = "v") -> DataFrame:
    """(i, j, out): the array ``key`` of the file as a row a pixel, with its bands as an array."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held: list[tuple[int, int, np.ndarray]] = []
                for line in lines(content.as_buffer().to_pybytes(), key):
                    held.append(line)
                    if len(held) * len(line[2]) > PIECE // 8:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    def assemble(t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        x = np.stack(t["x"].to_numpy()).T
        return pa.table({"i": pa.array(np.arange(len(x), dtype=np.int32)), "j": pa.array(np.full(len(x), t["j"][0].as_py(), np.int32)), out: pa.array(list(x), pa.list_(pa.float64()))})

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, "j int, k int, x array<double>")
    return found.groupBy("j").applyInArrow(assemble, f"i int, j int, {out} array<double>")


def _batch(held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    j, k, x = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(k, pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=["j", "k", "x"])


def write(rows: DataFrame, path: str, key: str, value: str = "v") -> None:
    """A raster (i, j, value), a number or an array a pixel, as an array ``key`` of doubles; pixels that it lacks are NaN there. Tasks lay
    out the bytes of a raster column and band; the driver passes them on in order."""
    whole = rows.select("i", "j", (F.col(value) if "array" in dict(rows.dtypes)[value] else F.array(value)).cast("array<double>").alias("v"))
    h, w, d = whole.agg(F.max("i") + 1, F.max("j") + 1, F.max(F.size("v"))).first()

    def line(t: pa.Table) -> pa.Table:
        x = np.full((h, d), np.nan, "<f8")
        x[t["i"].to_numpy()] = np.stack(t["v"].to_numpy())
        return pa.table({"k": pa.array(np.arange(d, dtype=np.int32)), "j": pa.array(np.full(d, t["j"][0].as_py(), np.int32)), "x": pa.array([x[:, k].tobytes() for k in range(d)], pa.binary())})

    name, dims = key.encode(), struct.pack("<3i", h, w, d) if "array" in dict(rows.dtypes)[value] else struct.pack("<2i", h, w)
    padded = lambda kind, data: struct.pack("<II", kind, len(data)) + data + bytes(-len(data) % 8)
    head = padded(6, struct.pack("<II", 6, 0)) + padded(5, dims) + padded(1, name) + struct.pack("<II", 9, h * w * d * 8)
    start = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    made = whole.groupBy("j").applyInArrow(line, "k int, j int, x binary").orderBy("k", "j")

    def pieces() -> Iterator[bytes]:
        yield start + struct.pack("<II", MATRIX, len(head) + h * w * d * 8) + head
        blank, at = np.full(h, np.nan, "<f8").tobytes(), 0
        for r in made.toLocalIterator():
            for _ in range(r["k"] * w + r["j"] - at):  # raster columns without a pixel
                yield blank
            yield bytes(r["x"])
            at = r["k"] * w + r["j"] + 1

    write_pieces(rows.sparkSession, path, pieces())
