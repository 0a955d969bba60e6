"""Copies of images by local descriptors: multiscale corners, orientation-normalised binary tests,
Hamming tables and geometric consensus.

Each image gives corners, the more the larger it is, at scales half an octave apart, with a 256-bit
descriptor: comparisons of pixel pairs around the corner, turned by its orientation, so brightness,
contrast and cropping leave them as they are. Tables of 32 of the bits bring equal parts together,
so corners of up to seven differing bits always meet; all 256 bits decide by their Hamming distance.
A pair of images is a copy if enough matched corners agree on one rotation, scale and shift.

Images of equal pixels collapse to the smallest id first. The others are packed into blocks, and each
pair of blocks is met in one task: all corners that share a bucket there, of all pairs of different
images. Only counts of links and one link a member leave the task. Classes are the connected
components of all confirmed pairs. Images that can't be decoded, null or too small have no corners
and are a class of their own; repeated ids count once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import materialize
from loomgrid.llm.minhash import components
from loomgrid.sources.stored import bucketed

#: Corners kept of each scale: one for so many pixels, but not fewer than the second; half the width of a patch; turns of the test pattern.
AREA, FEWEST, RADIUS, TURNS = 128, 12, 9, 30
#: Tables of 256 / TABLES bits each; differing bits of 256 that still match; agreeing corners that confirm a pair, and
#: their share of the pair's matched ones, since many corners agree by chance where images have many.
TABLES, DIFFERING, LEAST, SHARE = 8, 56, 5, 0.15
#: Images and corners of a block, partitions of blocks on either side, corners that meet held at once.
_BLOCK, _CORNERS, _SIDE, _MET = 1024, 1 << 17, 32, 1 << 18
#: A corner as blocks hold it.
_CORNER = np.dtype([("x", "<i4"), ("y", "<i4"), ("scale", "u1"), ("turn", "u1"), ("d", "<u8", 4)])
_HALF, _LOW = np.uint64(32), np.uint64((1 << 32) - 1)
_random = np.random.default_rng(7_919)
_TESTS = np.clip(np.round(_random.normal(0, 3.6, (256, 4))), -6, 6)
_PARTS = _random.permutation(256).reshape(TABLES, -1)


# -- images ------------------------------------------------------------------------------------


def write_pgm(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode(image: bytes | None) -> np.ndarray | None:
    """Grey pixels of a binary PGM or PPM (8 bits) or a PNG (8 bits, not interlaced); None if it is none of them."""
    try:
        if not image:
            return None
        if image[:2] in (b"P5", b"P6"):
            fields, at = [], 2
            while len(fields) < 3:
                while image[at : at + 1].isspace():
                    at += 1
                if image[at : at + 1] == b"#":
                    at = image.index(b"\n", at)
                    continue
                end = at
                while image[end : end + 1].isdigit():
                    end += 1
                fields.append(int(image[at:end]))
                at = end
            width, height, _ = fields
            depth = 1 if image[:2] == b"P5" else 3
            pixels = np.frombuffer(image, np.uint8, width * height * depth, at + 1).reshape(height, width, depth)
        elif image[:8] == b"\x89PNG\r\n\x1a\n":
            pixels = _png(image)
        else:
            return None
        return pixels[..., 0] if pixels.shape[2] < 3 else (pixels[..., :3] @ np.array([0.299, 0.587, 0.114])).round().astype(np.uint8)
    except (ValueError, IndexError, KeyError, zlib.error):
        return None


def _png(image: bytes) -> np.ndarray:
    at, packed = 8, b""
    while at < len(image):
        size, kind = int.from_bytes(image[at : at + 4], "big"), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
            depth = {0: 1, 2: 3, 4: 2, 6: 4}[body[9]]
            if body[8] != 8 or body[12]:
                raise ValueError("only 8 bits, not interlaced")
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * depth)
    out = np.zeros((height, width * depth), np.uint8)
    above = np.zeros(width * depth, np.int64)
    for y, row in enumerate(rows):
        mode, line = row[0], row[1:].astype(np.int64)
        if mode == 2:
            line = line + above
        elif mode in (1, 3, 4):
            line = line.copy()
            for x in range(width * depth):
                left = line[x - depth] if x >= depth else 0
                corner = above[x - depth] if x >= depth else 0
                if mode == 1:
                    line[x] += left
                elif mode == 3:
                    line[x] += (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    line[x] += min((left, above[x], corner), key=lambda v, p=p: abs(p - v))
                line[x] &= 255
        above = line & 255
        out[y] = above
    return out.reshape(height, width, depth)


@lru_cache
def _waves(size: int, count: int) -> np.ndarray:
    r = np.random.default_rng(31)
    f, phase = r.uniform(2, 11, (count, 2)) * r.choice([-1, 1], (count, 2)), r.uniform(0, 2 * np.pi, count)
    y, x = np.mgrid[:size, :size] / size
    return np.cos(2 * np.pi * (f[:, 0, None] * x.ravel() + f[:, 1, None] * y.ravel()) + phase[:, None])


def render_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", size: int = 64) -> DataFrame:
    """(image_id, image): each vector as a grey texture, a sum of waves weighted by its elements; null vectors give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 512) for x in batches for i in range(0, max(1, x.num_rows), 512)):  # bounds the images held at once
            images = []
            for v in b.column(1).to_pylist():
                if not v:
                    images.append(None)
                    continue
                x = np.nan_to_num(np.array(v, float))
                t = x @ _waves(size, len(x)) / (np.linalg.norm(x) or 1.0)
                images.append(write_pgm(np.clip(128 + 55 * t, 0, 255).round().reshape(size, size)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(images, pa.binary())], names=["image_id", "image"])

    kind = dict(vectors.dtypes)[vec_id]
    return vectors.select(F.col(f"`{vec_id}`").alias("image_id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).mapInArrow(run, f"image_id {kind}, image binary")


# -- corners and descriptors -------------------------------------------------------------------


def _blur(x: np.ndarray) -> np.ndarray:
    """Binomial smoothing over five pixels along both axes."""
    for axis in (0, 1):
        p = np.pad(x, [(2, 2) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n = x.shape[axis]
        s = [p[i : i + n] if axis == 0 else p[:, i : i + n] for i in range(5)]
        x = (s[0] + s[4] + 4 * (s[1] + s[3]) + 6 * s[2]) / 16
    return x


@lru_cache
def _patterns() -> tuple[np.ndarray, np.ndarray]:
    angle = 2 * np.pi * np.arange(TURNS) / TURNS
    c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
    turn = lambda x, y: np.stack([np.round(s * x + c * y), np.round(c * x - s * y)], -1).astype(int)
    return turn(_TESTS[:, 0], _TESTS[:, 1]), turn(_TESTS[:, 2], _TESTS[:, 3])


def _shrink(x: np.ndarray) -> np.ndarray:
    """Smaller by the root of two, bilinear."""
    for axis in (0, 1):
        at = np.clip((np.arange(int(x.shape[axis] / np.sqrt(2))) + 0.5) * np.sqrt(2) - 0.5, 0, x.shape[axis] - 1.001)
        low, part = at.astype(int), at % 1
        a, b = np.take(x, low, axis), np.take(x, low + 1, axis)
        part = part[:, None] if axis == 0 else part
        x = a * (1 - part) + b * part
    return x


def _levels(pixels: np.ndarray) -> Iterator[np.ndarray]:
    """The image at 1, 1 / sqrt 2, 1 / 2, ... of its size, as long as patches fit."""
    level = pixels.astype(float)
    while min(level.shape) >= 2 * RADIUS + 3:
        yield level
        if min((between := _shrink(level)).shape) >= 2 * RADIUS + 3:
            yield between
        h, w = level.shape[0] // 2 * 2, level.shape[1] // 2 * 2
        level = (level[:h:2, :w:2] + level[1:h:2, :w:2] + level[:h:2, 1:w:2] + level[1:h:2, 1:w:2]) / 4


def corners(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y, scale, turn) of the corners, in pixels of the image, and their descriptors as bits."""
    found, bits = [], []
    dy, dx = np.mgrid[-RADIUS + 2 : RADIUS - 1, -RADIUS + 2 : RADIUS - 1]
    disc = dy**2 + dx**2 <= (RADIUS - 2) ** 2
    for scale, level in enumerate(_levels(pixels)):
        smooth = _blur(level)
        gy, gx = np.gradient(smooth)
        a, b, c = _blur(gx * gx), _blur(gy * gy), _blur(gx * gy)
        response = a * b - c * c - 0.05 * (a + b) ** 2
        inner = response[RADIUS:-RADIUS, RADIUS:-RADIUS]
        around = [response[RADIUS + i : response.shape[0] - RADIUS + i, RADIUS + j : response.shape[1] - RADIUS + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
        y, x = np.nonzero((inner > np.max(around, axis=0)) & (inner > 1e-3))
        top = np.lexsort((x, y, -inner[y, x]))[: max(FEWEST, level.size // AREA)]
        y, x = y[top] + RADIUS, x[top] + RADIUS
        if not len(y):
            continue
        turns, tests = [], []
        for i in range(0, len(y), 512):  # bounds the patches held at once
            v, u = y[i : i + 512], x[i : i + 512]
            patch = smooth[v[:, None, None] + dy, u[:, None, None] + dx] * disc
            angle = np.arctan2((patch * dy).sum((1, 2)), (patch * dx).sum((1, 2)))
            turn = np.round(angle / (2 * np.pi) * TURNS).astype(int) % TURNS
            p, q = (t[turn] for t in _patterns())
            turns.append(turn)
            tests.append(smooth[v[:, None] + p[..., 0], u[:, None] + p[..., 1]] < smooth[v[:, None] + q[..., 0], u[:, None] + q[..., 1]])
        grow = 2 ** (scale / 2)
        place = lambda k, g=grow: np.round((k + 0.5) * g - 0.5).astype(int)
        found.append(np.stack([place(x), place(y), np.full(len(x), scale), np.concatenate(turns)], 1))
        bits.append(np.concatenate(tests))
    if not found:
        return np.zeros((0, 4), int), np.zeros((0, 256), bool)
    return np.concatenate(found), np.concatenate(bits)


def describe(images: DataFrame, image_id: str = "image_id", image: str = "image") -> DataFrame:
    """(image_id, digest, side, corners) of each image: its longer side, and corners with their descriptors as four longs, the keys of the tables one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("x", "y", "scale", "turn", "d0", "d1", "d2", "d3")
        for b in (x.slice(i, 512) for x in batches for i in range(0, max(1, x.num_rows), 512)):  # bounds the corners held at once
            digests, sides, sizes, places = [], [], [], [np.zeros((0, 8), np.int64)]
            for raw in b.column(1).to_pylist():
                pixels = decode(raw)
                found, bits = corners(pixels) if pixels is not None else (np.zeros((0, 4), int), np.zeros((0, 256), bool))
                digests.append(None if pixels is None else hashlib.blake2b(pixels.tobytes(), digest_size=16, key=str(pixels.shape).encode()).digest())
                sides.append(0 if pixels is None else max(pixels.shape))
                sizes.append(len(found))
                places.append(np.concatenate([found, np.ascontiguousarray(np.packbits(bits[:, _PARTS.ravel()], axis=1)).view(">i8")], 1).astype(np.int64))
            rows = np.concatenate(places)
            flat = pa.StructArray.from_arrays([pa.array(rows[:, k], pa.int32() if k < 4 else pa.int64()) for k in range(8)], names=names)
            offsets = pa.array(np.append(0, np.cumsum(np.array(sizes, int))), pa.int32())
            made = [pa.array(digests, pa.binary()), pa.array(sides, pa.int32()), pa.ListArray.from_arrays(offsets, flat)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["image_id", "digest", "side", "corners"])

    kind = dict(images.dtypes)[image_id]
    corner = "struct<x:int,y:int,scale:int,turn:int,d0:bigint,d1:bigint,d2:bigint,d3:bigint>"
    return images.select(F.col(f"`{image_id}`").alias("image_id"), F.col(f"`{image}`").alias("image")).mapInArrow(run, f"image_id {kind}, digest binary, side int, corners array<{corner}>")


# -- pairs of images that share buckets --------------------------------------------------------


class _Block:
    """Images that a task holds at once: their ids, longer sides and corners, one after the other."""

    def __init__(self, ids: pa.Array, sides: np.ndarray, sizes: np.ndarray, corners: np.ndarray):
        self.ids, self.sides, self.corners = ids, sides, corners
        self.start = np.append(0, np.cumsum(sizes))
        self.image = np.repeat(np.arange(len(sizes)), sizes)
        self._tables: list[np.ndarray] = []

    @property
    def tables(self) -> list[np.ndarray]:
        """For each table the corners' keys with their numbers in the low half, sorted."""
        if not self._tables:
            words = np.ascontiguousarray(self.corners["d"]).view(np.uint32).reshape(-1, TABLES)
            number = np.arange(len(words), dtype=np.uint64)
            self._tables = [np.sort(words[:, t].astype(np.uint64) << _HALF | number) for t in range(TABLES)]
        return self._tables


def _blocks(reps: DataFrame, most: int) -> DataFrame:
    """(block, ids, sides, sizes, corners): ``reps`` (image_id, side, corners) packed, up to ``most`` images and about ``_CORNERS`` corners a row."""
    kind = dict(reps.dtypes)["image_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, images, many = [], 0, 0
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy()
            ends = np.cumsum(sizes)
            i = 0
            while i < len(sizes):
                j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _CORNERS - many, side="right"))
                j = min(max(j, i if held else i + 1), i + most - images)
                if j > i:
                    held.append(batch.slice(i, j - i))
                    images, many, i = images + j - i, many + int(sizes[i:j].sum()), j
                if i < len(sizes):
                    yield packed(held)
                    held, images, many = [], 0, 0
        if held:
            yield packed(held)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, sides, corners = (c.combine_chunks() for c in pa.Table.from_batches(held).columns)
        flat = corners.flatten()
        out = np.zeros(len(flat), _CORNER)
        for n in ("x", "y", "scale", "turn"):
            out[n] = flat.field(n).to_numpy()
        for k in range(4):
            out["d"][:, k] = flat.field(f"d{k}").to_numpy()
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        rows = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), one(sides.to_numpy(), pa.int32()), one(corners.value_lengths().to_numpy(), pa.int32()), pa.array([out.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(rows, names=["ids", "sides", "sizes", "corners"])

    rows = reps.select("image_id", "side", "corners").mapInArrow(run, f"ids array<{kind}>, sides array<int>, sizes array<int>, corners binary")
    return materialize(rows.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _meeting(one: _Block, two: _Block, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n, m): different pairs of corners n of ``one`` and m of ``two`` that share a bucket, of pairs of images that share at least ``least``; all
    of a pair of images together, about ``_MET`` at once. Of the same block each image meets those after it."""
    todo = [(0, len(one.sides), 0, len(two.sides))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        found = []
        for own, other in zip(one.tables, two.tables, strict=True):
            n = (own & _LOW).astype(np.int64)
            if a1 - a0 < len(one.sides):
                own = own[at := (n >= one.start[a0]) & (n < one.start[a1])]
                n = n[at]
            key = own & ~_LOW
            first = np.maximum(one.start[one.image[n] + 1], two.start[b0]) if one is two else np.full(len(n), two.start[b0])
            low = np.searchsorted(other, key | first.astype(np.uint64))
            last = key | np.uint64(two.start[b1])
            at = np.flatnonzero(low < len(other))
            at = at[other[low[at]] < last[at]]
            low = low[at]
            found.append((n[at], low, np.searchsorted(other, last[at]) - low))
        many = np.zeros(a1 - a0, np.int64)
        for n, _, times in found:
            many += np.bincount(one.image[n] - a0, times, a1 - a0).astype(np.int64)
        if many.sum() > _MET and (a1 - a0 > 1 or b1 - b0 > 1):
            if a1 - a0 > 1:
                todo += [(a0 + x.start, a0 + x.stop, b0, b1) for x in _slices(many, _MET)] if many.max() < many.sum() else [(a0 + i, a0 + i + 1, b0, b1) for i in np.flatnonzero(many)]
            else:
                half = (b0 + b1) // 2
                todo += [(a0, a1, b0, half), (a0, a1, half, b1)]
            continue
        n = np.concatenate([np.repeat(n, times) for n, _, times in found])
        if not len(n):
            continue
        m = np.concatenate([(other[np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())] & _LOW).astype(np.int64) for other, (_, low, times) in zip(two.tables, found, strict=True)])
        pair = (one.image[n] - a0) * (b1 - b0) + two.image[m] - b0
        enough = np.bincount(pair)[pair] >= least  # most go here
        met = np.unique(n[enough] * len(two.corners) + m[enough])  # corners that share several tables
        if len(met):
            yield met // len(two.corners), met % len(two.corners)


def _slices(many: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of items whose numbers add up to about ``most``."""
    ends = np.cumsum(many)
    i = 0
    while i < len(many):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        yield slice(i, j)
        i = j


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """Numbers from 0, not all of them used, that are equal where the rows of the columns are."""
    out, many = np.zeros(len(columns[0]), np.int64), 1
    for c in columns:
        c = c.astype(np.int64)
        low, high = int(c.min()), int(c.max())
        if many * (high - low + 1) >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1]
            many = int(out.max()) + 1
        out, many = out * (high - low + 1) + (c - low), many * (high - low + 1)
    return out


def _distinct(group: np.ndarray, *values: np.ndarray) -> np.ndarray:
    """How many different values each of the groups 0, 1, ... has."""
    values = np.unique(_numbered(*values), return_inverse=True)[1]
    many = int(values.max()) + 1
    return np.bincount(np.unique(group * many + values) // many, minlength=int(group.max()) + 1)


def _agree(pair: np.ndarray, side: np.ndarray, p: np.ndarray, q: np.ndarray, least: int, pairs: int) -> np.ndarray:
    """Whether enough of the matched corners p and q of each of the pairs 0, 1, ..., of images with this longer side, agree on one rotation, scale and shift."""
    out = np.zeros(pairs, bool)
    places = lambda g, r: np.minimum(_distinct(g, p["x"][r], p["y"][r]), _distinct(g, q["x"][r], q["y"][r]))
    n = places(pair, slice(None))
    near = np.flatnonzero(n[pair] >= least)
    needed = np.maximum(least, SHARE * n)
    turn = (q["turn"][near].astype(int) - p["turn"][near]) % TURNS
    scale = q["scale"][near].astype(int) - p["scale"][near]
    angle, grow, half = turn * (2 * np.pi / TURNS), np.power(2.0, scale / 2), side[near] / 2
    # where the middle of a falls in b; errors of turn and scale move it in proportion to the side
    x, y = p["x"][near] - half, p["y"][near] - half
    dx = q["x"][near] - grow * (np.cos(angle) * x - np.sin(angle) * y)
    dy = q["y"][near] - grow * (np.sin(angle) * x + np.cos(angle) * y)
    cell = np.maximum(8.0, side[near] / 8)
    # grids half a cell apart in each dimension, so that no agreement is lost at a cell's edge
    for g, h, i, j in np.ndindex(2, 2, 2, 2):
        left = np.flatnonzero(~out[pair[near]])  # of pairs that no grid before has confirmed
        if not len(left):
            break
        whose, at = pair[near[left]], (turn[left] + g) // 2 % (TURNS // 2)
        at = _numbered(at, (scale[left] + h) // 2, np.floor(dx[left] / cell[left] + i / 2), np.floor(dy[left] / cell[left] + j / 2), whose)
        at, first, own = np.unique(at, return_index=True, return_inverse=True)
        whose = whose[first]
        out[whose[places(own, near[left]) >= needed[whose]]] = True
    return out


def _confirmed(one: _Block, two: _Block, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): the copies a of ``one`` and b of ``two``, all of them, of different images."""
    same = one is two
    names = one.ids if same else pa.concat_arrays([one.ids, two.ids])
    rank = np.unique(names.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    ends = [(np.zeros(0, np.int64),) * 2]
    for n, m in _meeting(one, two, least):
        p, q = one.corners[n], two.corners[m]
        near = np.bitwise_count(p["d"] ^ q["d"]).sum(1) <= DIFFERING
        n, m, p, q = n[near], m[near], p[near], q[near]
        if not len(n):
            continue
        pair, at = np.unique(one.image[n] * len(two.sides) + two.image[m], return_inverse=True)
        a, b = pair // len(two.sides), pair % len(two.sides)
        # the smaller id is the one whose middle is looked for in the other
        turned = rank[a] > rank[b if same else b + len(one.sides)]
        p, q = np.where(turned[at], q, p), np.where(turned[at], p, q)
        ok = _agree(at, np.where(turned, two.sides[b], one.sides[a])[at], p, q, least, len(pair))
        ends.append((a[ok], b[ok]))
    a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
    return a, b


def _roots(a: np.ndarray, b: np.ndarray, many: int) -> np.ndarray:
    """The smallest of the numbers 0, 1, ... that each one reaches by the links a, b."""
    root = np.arange(many)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _links(blocks: DataFrame, least: int) -> DataFrame:
    """(image_id, root, n_links): for each pair of blocks the images with copies among them, how many, and one that they reach by these.

    All pairs of blocks are met, each in one task; blocks are read from where they are stored and not shuffled, and neither corners that meet nor
    pairs of images leave a task."""
    kind = dict(blocks.dtypes)["ids"][6:-1]
    many = min(_SIDE, blocks.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Block] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                pair = []
                for at in (0, 5):
                    name = batch.column(at)[row].as_py()
                    if name not in held:
                        ids, sides, sizes, data = (batch.column(at + k)[row] for k in range(1, 5))
                        made = _Block(pa.concat_arrays([ids.values]), *(x.values.to_numpy(zero_copy_only=False).copy() for x in (sides, sizes)), np.frombuffer(data.as_buffer().to_pybytes(), _CORNER))
                        while len(held) >= 3:
                            held.pop(next(k for k in held if not pair or k != pair[0]))
                        held[name] = made
                    pair.append(name)
                one, two = (held[k] for k in pair)
                a, b = _confirmed(one, two, least)
                if not len(a):
                    continue
                b = b if one is two else b + len(one.sides)
                names = one.ids if one is two else pa.concat_arrays([one.ids, two.ids])
                root, links = _roots(a, b, len(names)), np.bincount(np.concatenate([a, b]), minlength=len(names))
                of = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(of)), names.take(pa.array(root[of])), pa.array(links[of])], names=["image_id", "root", "n_links"])

    side = lambda n: blocks.coalesce(max(1, many)).select(*(F.col(c).alias(f"{c}{n}") for c in ("block", "ids", "sides", "sizes", "corners")))
    pairs = side(1).join(side(2).hint("shuffle_replicate_nl"), F.expr("block1 <= block2"))
    return materialize(pairs.mapInArrow(run, f"image_id {kind}, root {kind}, n_links long"), "links")


def copies(images: DataFrame, image_id: str = "image_id", image: str = "image", least: int = LEAST) -> DataFrame:
    """(image_id, n_corners, class_id, n_links): the class's smallest id, and how many other images this one is a copy of. Images of
    equal pixels count as one."""
    # bucketed as the images come, so that no join moves descriptors; images dealt by id give a file a bucket
    every = describe(images, image_id, image).where("image_id IS NOT NULL").select("image_id", "digest", "side", "corners", F.size("corners").alias("n_corners"), F.monotonically_increasing_id().alias("row"))
    every = bucketed(every, "descriptors", ["image_id"], deal=False)
    once = every.groupBy("image_id").agg(F.min(F.struct("row", "digest", "n_corners")).alias("x"))  # repeated ids count once
    members = materialize(once.select("image_id", "x.*"), "members")
    same = members.where("digest IS NOT NULL").groupBy("digest").agg(F.min("image_id").alias("rep"))
    same = materialize(same, "same")
    reps = members.where(F.col("n_corners") >= least).join(same.select(F.col("rep").alias("image_id")), "image_id", "left_semi").select("image_id", F.col("row").alias("first"))
    reps = materialize(reps, "representatives")
    own = every.join(reps, "image_id").where("row <= first")  # no equality, so that the join is by the buckets' key alone
    links = _links(_blocks(own.coalesce(max(1, -(-reps.count() // _BLOCK))), _BLOCK), least)
    group = components(links.select(F.col("image_id").alias("a"), F.col("root").alias("b")))
    degree = links.groupBy(F.col("image_id").alias("rep")).agg(F.sum("n_links").alias("n_links"))
    member = members.join(same, "digest", "left").withColumn("rep", F.coalesce("rep", "image_id"))
    out = member.join(group, F.col("rep") == F.col("node"), "left").join(degree, "rep", "left")
    return out.select("image_id", "n_corners", F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
