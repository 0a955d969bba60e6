"""Class maps and superpixel images as tables of (i, j, r, g, b), and a PNG writer for their presentation."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.sources.files import write_pieces
from loomgrid.sources.stored import stored

# Colours of the classes of the known scenes, background first.
PALETTE_17 = [
    (0, 0, 0), (140, 67, 46), (0, 0, 255), (255, 100, 0), (0, 255, 123), (164, 75, 155), (101, 174, 255), (118, 254, 172), (60, 91, 112),
    (255, 255, 0), (255, 255, 125), (255, 0, 255), (100, 0, 255), (0, 172, 254), (0, 255, 0), (171, 175, 80), (101, 193, 60),
]
PALETTE_10 = [(0, 0, 0), (192, 192, 192), (0, 255, 0), (0, 255, 255), (0, 128, 0), (255, 0, 255), (165, 82, 41), (128, 0, 128), (255, 0, 0), (255, 255, 0)]
PALETTES = {"Salinas": PALETTE_17, "Indiana": PALETTE_17, "PaviaU": PALETTE_10}


def palette(spark: SparkSession, name: str) -> DataFrame:
    """(cls, r, g, b)."""
    rows = ", ".join(f"({c}, {r}, {g}, {b})" for c, (r, g, b) in enumerate(PALETTES[name]))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS p(cls, r, g, b)")


def class_map(pixels: DataFrame, colours: DataFrame, masked: bool = False) -> DataFrame:
    """(i, j, r, g, b) of (i, j, gt, pred); ``masked``: background stays background."""
    cls = F.when(F.col("gt") == 0, 0).otherwise(F.col("pred")) if masked else F.col("pred")
    return pixels.select("i", "j", cls.alias("cls")).join(F.broadcast(colours), "cls").select("i", "j", "r", "g", "b")


def stretch(raster: DataFrame, chosen: tuple[int, int, int]) -> DataFrame:
    """(p, i, j, sp, r, g, b): three bands from 0 to 255 over their joint extremes, truncated."""
    three = [F.element_at("v", b + 1) for b in chosen]
    px = raster.select("p", "i", "j", "sp", *(x.alias(n) for x, n in zip(three, "rgb", strict=True)))
    ends = px.agg(F.min(F.least("r", "g", "b")).alias("lo"), F.max(F.greatest("r", "g", "b")).alias("hi"))
    level = lambda c: F.floor(255 * (F.col(c) - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("int").alias(c)
    return px.crossJoin(F.broadcast(ends)).select("p", "i", "j", "sp", level("r"), level("g"), level("b"))


def mean_colours(image: DataFrame) -> DataFrame:
    """(i, j, r, g, b): each pixel in its superpixel's mean colour, truncated."""
    mean = image.groupBy("sp").agg(*(F.floor(F.avg(c)).cast("int").alias(c) for c in "rgb"))
    return image.select("i", "j", "sp").join(mean, "sp").select("i", "j", "r", "g", "b")


def boundary_overlay(image: DataFrame, edges: DataFrame) -> DataFrame:
    """(i, j, r, g, b): pixels at a superpixel's boundary in red."""
    both = image.join(edges, "p")
    return both.select("i", "j", *(F.when(F.col("edge"), red).otherwise(F.col(c)).cast("int").alias(c) for c, red in zip("rgb", (255, 0, 0), strict=True)))


def joined_adler(first: int, second: int, size: int) -> int:
    """Adler-32 of two pieces together, from those of each and the size of the second."""
    a1, b1, a2, b2 = first & 0xFFFF, first >> 16, second & 0xFFFF, second >> 16
    return (b1 + b2 + size * (a1 - 1)) % 65521 << 16 | (a1 + a2 - 1) % 65521


def strips(image: DataFrame, width: int, rows: int = 64) -> DataFrame:
    """(strip, body, adler, size): each ``rows`` lines of a table (i, j, r, g, b), deflated so that strips go on from one another, with
    checksum and size of what was deflated. Pixels that are missing are black."""

    def deflate(t: pa.Table) -> pa.Table:
        i = t["i"].to_numpy()
        strip = int(i[0]) // rows
        low = strip * rows
        raw = np.zeros((int(i.max()) - low + 1, 1 + 3 * width), np.uint8)
        for n, c in enumerate("rgb"):
            raw[i - low, 1 + 3 * t["j"].to_numpy() + n] = t[c].to_numpy()
        z = zlib.compressobj(wbits=-15)
        body = z.compress(raw.tobytes()) + z.flush(zlib.Z_FULL_FLUSH)
        return pa.table({"strip": [strip], "body": pa.array([body], pa.binary()), "adler": [zlib.adler32(raw.tobytes())], "size": [raw.size]})

    px = image.select(*(F.col(c).cast("int").alias(c) for c in ("i", "j", "r", "g", "b")), F.floor(F.col("i") / rows).alias("strip"))
    return px.groupBy("strip").applyInArrow(deflate, "strip long, body binary, adler long, size long")


def write_png(image: DataFrame, path: str) -> None:
    """A picture of a table (i, j, r, g, b), with no line missing, as a file in any store Spark knows. Tasks deflate strips of lines; the
    driver passes them on, one at a time."""
    h, w = image.agg(F.max("i") + 1, F.max("j") + 1).first()
    made = stored(strips(image, w), "strips").orderBy("strip")
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    def pieces() -> Iterator[bytes]:
        yield b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", b"\x78\x01")
        adler = 1
        for r in made.toLocalIterator():
            adler = joined_adler(adler, r["adler"], r["size"])
            yield part(b"IDAT", bytes(r["body"]))
        yield part(b"IDAT", b"\x03\x00" + struct.pack(">I", adler)) + part(b"IEND", b"")

    write_pieces(image.sparkSession, path, pieces())
