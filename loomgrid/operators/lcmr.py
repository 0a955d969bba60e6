"""Local covariance log-matrices by tiles with a halo.

Each pixel goes to every tile whose mirrored windows show it, and a tile is solved in one numpy
kernel, so a window of 25 x 25 costs a pixel a few copies instead of 625 rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.neighbourhood import extent, haloed


def window_logm(cube: np.ndarray, own: tuple[slice, slice], size: int, keep: int, shrink: float = 0.001, above: int = 0) -> np.ndarray:
    """Log-matrices of the ``own`` cells of a cube that holds their whole windows; neighbours are those of the pixel ``above`` rows higher.

    A row of windows is solved at once: cosines are one batch of products, the ``keep`` largest of each window are marked (of equal ones
    those that come first column by column), and the covariance is a product of the marked vectors."""
    half, d = size // 2, cube.shape[2]
    rows, columns = range(own[0].start, own[0].stop), range(own[1].start, own[1].stop)
    keep = min(keep, size * size)
    with np.errstate(invalid="ignore", divide="ignore"):
        unit = cube / np.linalg.norm(cube, axis=2, keepdims=True)
        low, high = cube.min(2, keepdims=True), cube.max(2, keepdims=True)
        scaled = np.nan_to_num((cube - low) / (high - low))

    def windows(x: np.ndarray, i: int) -> np.ndarray:
        strip = x[i - half : i + half + 1, columns.start - half : columns.stop + half]
        # (column, band, row in the window, column in the window): the offset of (row, column) is row + size * column
        view = np.lib.stride_tricks.sliding_window_view(strip, (size, size), axis=(0, 1))[0]
        return np.ascontiguousarray(view.transpose(0, 3, 2, 1)).reshape(len(columns), size * size, d)

    out = np.empty((len(rows), len(columns), d, d))
    for a, i in enumerate(rows):
        cor = np.round((windows(unit, i) @ unit[i - above, columns.start : columns.stop, :, None])[:, :, 0], 10)
        cor[np.isnan(cor)] = -np.inf
        least = np.partition(cor, -keep, axis=1)[:, -keep, None]
        tied = cor == least
        marked = (cor > least) | tied & (np.cumsum(tied, axis=1) <= keep - (cor > least).sum(1, keepdims=True))
        held = windows(scaled, i)
        mean = (marked[:, None, :].astype(float) @ held) / keep
        held = (held - mean) * marked[:, :, None]
        cov = held.transpose(0, 2, 1) @ held / max(keep - 1, 1)
        trace = np.trace(cov, axis1=1, axis2=2)
        cov += (shrink * np.maximum(trace, 1e-12))[:, None, None] * np.eye(d)
        values, vectors = np.linalg.eigh(cov)
        out[a] = (vectors * np.log(np.maximum(values, 1e-300))[:, None, :]) @ vectors.transpose(0, 2, 1)
    return out


def log_matrices(raster: DataFrame, vector: str = "mnf", size: int = 25, keep: int = 400, tile: int = 32, out: str = "lcmr", above: int = 0) -> DataFrame:
    """(p, out): the row-major d x d log-matrix of each pixel's window, of odd ``size``; beyond the raster it is mirrored, again and again where
    the window is larger. ``above=1`` takes the window's centre one place early, column by column."""
    if size % 2 == 0:
        raise ValueError("a window of even size has no centre")
    h, w = extent(raster)
    half = size // 2

    px = haloed(raster.select("p", "i", "j", F.col(vector).alias("v")), half, tile, h, w)

    def solve(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        i0, j0 = key[0] * tile, key[1] * tile
        i1, j1 = min(i0 + tile, h), min(j0 + tile, w)
        d = len(t["v"].iloc[0])
        cube = np.zeros((i1 - i0 + 2 * half, j1 - j0 + 2 * half, d))
        where = np.full(cube.shape[:2], -1)
        a, b = t["pi"].to_numpy() - i0 + half, t["pj"].to_numpy() - j0 + half
        cube[a, b] = np.stack(t["v"].to_numpy())
        own = (t["pi"] == t["i"]) & (t["pj"] == t["j"])
        where[a[own], b[own]] = t["p"].to_numpy()[own]
        m = window_logm(cube, (slice(half, half + i1 - i0), slice(half, half + j1 - j0)), size, keep, above=above)
        p = where[half : half + i1 - i0, half : half + j1 - j0]
        kept = p.ravel() >= 0  # others the raster lacks
        return pd.DataFrame({"p": p.ravel()[kept], out: list(m.reshape(p.size, d * d)[kept])})

    return px.groupBy("ti", "tj").applyInPandas(solve, f"p int, {out} array<double>")
