"""Linear reductions. Only d x d matrices reach the driver; projections are map-only Arrow kernels over pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgrid.operators import stats


def _signed(basis: np.ndarray) -> np.ndarray:
    """Each column with its element of largest magnitude positive, so results don't hang on the solver."""
    top = np.abs(basis).argmax(0)
    return basis * np.where(basis[top, np.arange(basis.shape[1])] < 0, -1.0, 1.0)


def project(raster: DataFrame, basis: np.ndarray, out: str, centre: np.ndarray | None = None, vector: str = "v") -> DataFrame:
    """``raster`` with ``out`` = (vector - centre) @ basis."""
    shared = raster.sparkSession.sparkContext.broadcast((basis, np.zeros(len(basis)) if centre is None else centre))
    keep = [c for c in raster.columns if c != out]
    at = keep.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, c = shared.value
        for batch in batches:
            x = np.array(batch.column(at).to_pylist(), float).reshape(batch.num_rows, len(b))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list((x - c) @ b), pa.list_(pa.float64()))], names=[*keep, out])

    kinds = dict(raster.dtypes)
    return raster.select(*keep).mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in keep) + f"`{out}` array<double>")


def pca(raster: DataFrame, target: float = 0.998, most: int = 100, out: str = "pc") -> DataFrame:
    """``raster`` with the principal components of its standardised bands, as many as first pass ``target`` of the
    variance. None if it is never passed; an error if ``most`` components hold less than the target."""
    n, mean, g = stats.centred_moments(raster)
    cov = g / n
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd[sd <= 1e-12 * np.maximum(1, np.abs(mean))] = 1.0
    values, basis = np.linalg.eigh(cov / np.outer(sd, sd))
    values, basis = values[::-1], _signed(basis[:, ::-1])
    ratio = np.maximum(values, 0) / max(values.sum(), 1e-300)
    cum = np.cumsum(ratio[:most])
    if cum[-1] < target - 1e-12:
        raise ValueError(f"{most} components hold {cum[-1]:.4f} of the variance, less than {target}")
    above = np.flatnonzero(cum > target)
    count = int(above[0]) + 1 if len(above) else 0
    return project(raster, basis[:, :count] / sd[:, None], out, mean)


def mnf(raster: DataFrame, count: int = 20, out: str = "mnf", order: str = "descending") -> DataFrame:
    """``raster`` with its noise-adjusted components: eigenvectors of inverse noise covariance times covariance,
    applied to the vectors as they are. ``order``: by eigenvalue, or ``lapack``, as the solver gives them."""
    cov = stats.covariance_matrix(raster)
    noise = stats.shift_noise(raster)
    values, basis = np.linalg.eig(np.linalg.inv(stats.covariance_matrix(noise, "d")) @ cov)
    values, basis = values.real, basis.real
    if order == "descending":
        basis = basis[:, np.argsort(-values, kind="stable")]
    return project(raster, _signed(basis / np.linalg.norm(basis, axis=0))[:, :count], out)
