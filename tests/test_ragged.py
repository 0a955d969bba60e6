"""Rasters whose last row is a part of one, with values that round to a negative zero: queries beside their SQL."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import TABLES, same
from pyspark.sql import functions as F

from loomgrid.operators import neighbourhood, segment
from loomgrid.plans import catalog
from loomgrid.sources.raster import from_embeddings

NAMES = """load_raster load_scene manifold_area search_range adaptive_scale split_clusters update_clusters update_clusters_whole merge_clusters window_vectors
    window_vectors_whole assign_nearest gaussian_blur_wide pairwise_feature""".split()


@pytest.fixture(scope="module")
def ragged(sf_dir, tmp_path_factory):
    """487 vectors, so that the last of 20 rows has 12 of 25 pixels."""
    folder = tmp_path_factory.mktemp("ragged")
    for t in TABLES:
        if t != "embeddings":
            os.symlink(f"{sf_dir}/{t}.parquet", folder / f"{t}.parquet")
    rows = pq.read_table(f"{sf_dir}/embeddings.parquet").slice(0, 487)
    vectors = rows["embedding"].to_pylist()
    for n, x in enumerate(vectors):
        x[(rows["label"][n].as_py() + 1) % 10] = -3e-7 if n % 2 else 3e-7
    at = rows.schema.get_field_index("embedding")
    pq.write_table(rows.set_column(at, "embedding", pa.array(vectors, rows.schema.field(at).type)), folder / "embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, ragged, name):
    same(spark, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name], ragged)


def test_superpixels_of_a_ragged_raster(spark, ragged):
    """Every pixel has one, and no split or moved cluster is lost below the raster's end."""
    raster = from_embeddings(spark.read.parquet(f"{ragged}/embeddings.parquet"))
    px = raster.select("p", "i", "j", F.slice("v", 1, 4).alias("v"), F.slice("v", 5, 4).alias("lcmr"))
    got = segment.segment(px, 20, most_rounds=3).collect()
    assert sorted(r["p"] for r in got) == list(range(487))
    assert neighbourhood.manifold_area(raster, 4.0, 5).where("area IS NULL OR isnan(area)").isEmpty()


@pytest.mark.filterwarnings("ignore:the residual still fell")
def test_superpixels_of_a_narrow_raster(spark):
    """Half a step is longer than the rows, so no grid point lies on the raster."""
    px = spark.createDataFrame([(p, p // 5, p % 5, [p % 3 + p / 100, 1.0], [0.1 * (p % 7)]) for p in range(300)], "p int, i int, j int, v array<double>, lcmr array<double>")
    step = segment.grid_step(60, 5, 2)
    assert segment.seeds(px, step).isEmpty()
    assert [(r["c"], r["i"], r["j"]) for r in segment.seeds(px, step, within=True).orderBy("c").collect()] == [(n, 6 + step * n, 2) for n in range(5)]
    assert sorted(r["p"] for r in segment.segment(px, 2, most_rounds=1).collect()) == list(range(300))
