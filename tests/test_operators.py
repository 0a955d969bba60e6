"""Numpy oracles, properties and hand-worked cases of operators that SQL can't express."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.functions import vectors as V
from loomgrid.operators import evaluate, features, graph, lcmr, metric, neighbourhood, reduce, render, segment, stats
from loomgrid.plans import catalog
from loomgrid.plans.pipeline import Config
from loomgrid.sources import mat
from loomgrid.sources import raster as source


@pytest.fixture(scope="module")
def raster(spark, sf_dir):
    return source.from_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).persist()


@pytest.fixture(scope="module")
def cube(raster):
    rows = raster.orderBy("p").collect()
    return np.array([r["v"] for r in rows]).reshape(-1, source.WIDTH, 64)


def test_pca_spans_the_leading_directions(raster, cube):
    got = reduce.pca(raster, 0.7).orderBy("p").collect()
    x = cube.reshape(-1, 64)
    z = (x - x.mean(0)) / x.std(0)
    values, basis = np.linalg.eigh(z.T @ z / len(z))
    values, basis = values[::-1], basis[:, ::-1]
    count = int(np.flatnonzero(np.cumsum(values) / values.sum() > 0.7)[0]) + 1
    pc = np.array([r["pc"] for r in got])
    assert pc.shape[1] == count
    np.testing.assert_allclose(np.abs(pc), np.abs(z @ basis[:, :count]), atol=1e-6)


def test_pca_rejects_a_target_its_components_miss(raster):
    with pytest.raises(ValueError):
        reduce.pca(raster, 0.999, most=2)


def test_mnf_whitens_the_noise(raster, cube):
    got = np.array([r["mnf"] for r in reduce.mnf(raster, 6).orderBy("p").collect()]).reshape(*cube.shape[:2], 6)
    up = np.zeros_like(got)
    up[1:] = (got[1:] - got[:-1]) / 2
    right = np.zeros_like(got)
    right[:, :-1] = (got[:, :-1] - got[:, 1:]) / 2
    cov = np.cov((up + right).reshape(-1, 6).T)
    off = cov - np.diag(np.diag(cov))
    assert np.abs(off).max() < 1e-8 * np.diag(cov).max() + 1e-10
    snr = np.var(got.reshape(-1, 6), axis=0) / np.diag(cov)
    assert (np.diff(snr) < 1e-6).all()


def test_log_matrices_match_a_plain_loop(raster, cube):
    small = raster.withColumn("v", F.slice("v", 1, 4))
    got = {r["p"]: np.array(r["lcmr"]).reshape(4, 4) for r in lcmr.log_matrices(small, "v", size=5, keep=9, tile=8).collect()}
    c = cube[..., :4]
    h, w = c.shape[:2]
    pad = np.pad(c, ((2, 2), (2, 2), (0, 0)), mode="symmetric")
    assert sorted(got) == list(range(h * w))
    for i, j in [(0, 0), (0, w - 1), (h - 1, 3), (7, 8), (10, 24)]:
        x = pad[i : i + 5, j : j + 5].transpose(1, 0, 2).reshape(-1, 4)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        x = x[np.argsort(-np.round(u @ u[12], 10), kind="stable")[:9]]
        x = (x - x.min(1, keepdims=True)) / (x.max(1, keepdims=True) - x.min(1, keepdims=True))
        s = np.cov(x.T)
        values, vectors = np.linalg.eigh(s + 0.001 * np.trace(s) * np.eye(4))
        np.testing.assert_allclose(got[i * w + j], vectors @ np.diag(np.log(values)) @ vectors.T, atol=1e-8)


def test_windows_larger_than_the_raster(spark):
    r = np.random.default_rng(4)
    c = r.random((3, 4, 2)) + 0.1
    df = spark.createDataFrame([(i * 4 + j, i, j, c[i, j].tolist()) for i in range(3) for j in range(4)], "p int, i int, j int, v array<double>")
    pad = np.pad(c, ((9, 9), (9, 9), (0, 0)), mode="symmetric")
    want = lcmr.window_logm(pad, (slice(9, 12), slice(9, 13)), 19, 100).reshape(12, 4)
    got = {r["p"]: r["lcmr"] for r in lcmr.log_matrices(df, "v", size=19, keep=100, tile=2).collect()}
    np.testing.assert_allclose([got[p] for p in range(12)], want)
    cells = {(x["pi"], x["pj"]): x["p"] for x in neighbourhood.mirror_pad(df, 9).collect()}
    at = np.pad(np.arange(12).reshape(3, 4), 9, mode="symmetric")
    assert cells == {(i, j): at[i, j] for i in range(21) for j in range(22)}
    assert neighbourhood.window_vectors(df, 19).count() == 12 * 19 * 19
    with pytest.raises(ValueError, match="even"):
        lcmr.log_matrices(df, "v", size=4)


def test_lgc_solves_its_equation_both_ways(spark, raster, monkeypatch):
    edges, labels = catalog._fcf(raster).persist(), catalog._labels(raster).persist()
    near = {(r["node"], r["cls"]): r["f"] for r in graph.lgc(edges, labels, 0.125).collect()}
    monkeypatch.setattr(graph, "DRIVER_NODES", 0)
    far = {(r["node"], r["cls"]): r["f"] for r in graph.lgc(edges, labels, 0.125).collect()}
    assert all(abs(near[k] - far.get(k, 0.0)) < 1e-6 for k in near)
    ls = {(r["node"], r["cls"]): r["f"] for r in graph.label_solve(edges, labels, 1 / 1.125).collect()}
    assert all(abs(ls[k] * (1 - 1 / 1.125) - far.get(k, 0.0)) < 1e-6 for k in ls)


def test_lgc_rows_and_rounds_do_not_hang_on_size(spark, monkeypatch):
    edges = spark.createDataFrame([(a, b, 1.0) for x, y in ((0, 1), (1, 2), (5, 6)) for a, b in ((x, y), (y, x))], "s long, t long, w double")
    labels = spark.createDataFrame([(0, 1, 1), (2, 3, 1)], "node long, cls int, y int")
    near = {(r["node"], r["cls"]): r["f"] for r in graph.lgc(edges, labels, 0.125).collect()}
    monkeypatch.setattr(graph, "DRIVER_NODES", 0)
    far = {(r["node"], r["cls"]): r["f"] for r in graph.lgc(edges, labels, 0.125, tolerance=1e-3).collect()}
    assert far.keys() == near.keys() and len(near) == 10 and all(abs(near[k] - far[k]) < 0.05 for k in near)
    with pytest.raises(RuntimeError):
        graph.lgc(edges, labels, 1e-6, most_rounds=1)


def test_negative_weights_are_an_error(spark):
    edges = spark.createDataFrame([(0, 1, -1.0)], "s int, t int, w double")
    with pytest.raises(ValueError):
        graph.check_weights(edges)


def test_isolated_nodes_get_the_default_class(spark):
    scores = spark.createDataFrame([(0, 1, 0.2), (0, 2, 0.2), (1, 1, 0.0)], "node int, cls int, f double")
    nodes = spark.createDataFrame([(0,), (1,), (2,)], "node int")
    assert sorted(map(tuple, graph.classify(scores, nodes).collect())) == [(0, 1), (1, 1), (2, 1)]
    assert sorted(map(tuple, graph.classify(scores, nodes, unreached=0).collect())) == [(0, 1), (1, 0), (2, 0)]


def test_nearest_of_many_equal_vectors(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 64))
    x[r.permutation(400)[:40]] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for block in (2048, 50):
        got = {}
        for e in metric.nearest(df, 8, block=block).collect():
            got.setdefault(e["s"], set()).add(e["t"])
        for i, v in enumerate(x):
            d = ((v - x) ** 2).sum(1)
            d[i] = np.inf
            assert got[i] == set(np.lexsort((np.arange(400), d))[:8].tolist())


def test_nearest_is_exact_with_several_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (60, 4)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in metric.nearest(df, 5, block=16).collect():
        got.setdefault(r["s"], []).append((r["d2"], r["t"]))
    d2 = ((x[:, None] - x) ** 2).sum(2)
    for s in range(60):
        want = sorted((d2[s, t], t) for t in range(60) if t != s)[:5]
        assert [d for d, _ in sorted(got[s])] == [d for d, _ in want]


def test_top_keeps_ties(spark):
    edges = spark.createDataFrame([(0, 1, 3.0), (0, 2, 2.0), (0, 3, 2.0), (0, 4, 1.0)], "s int, t int, w double")
    assert graph.top(edges, 2, F.col("w").desc()).count() == 3
    assert graph.top(edges, 2, F.col("w").desc(), ties=False).count() == 2


def test_mbo_keeps_labelled_nodes_apart(spark):
    pairs = [(0, 1, 1.0), (1, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0)]
    edges = spark.createDataFrame(pairs + [(b, a, w) for a, b, w in pairs], "s int, t int, w double")
    labels = spark.createDataFrame([(0, 1, 1.0), (2, 1, 1.0), (3, 2, 1.0), (5, 2, 1.0)], "node int, cls int, y double")
    got = dict(map(tuple, graph.graph_mbo(edges, labels, 50.0).collect()))
    assert got[0] == got[2] == 1 and got[3] == got[5] == 2


def test_label_spreading_splits_mixed_superpixels(spark):
    rows = [(0, 0, [9.0], 3), (1, 0, [0.1], None), (2, 0, [0.0], 1), (3, 0, [9.1], None), (4, 1, [0.0], 2), (5, 1, [5.0], None), (6, 2, [70.1], None), (7, 2, [40.0], 5), (8, 2, [70.0], 4), (9, 2, [-9.0], 7), (10, 2, [-9.1], None)]
    df = spark.createDataFrame(rows, "p int, sp int, v array<double>, cls int").repartition(3)
    got = {r["p"]: (r["part"], r["new"]) for r in graph.label_spreading(df, gamma=1.0).collect()}
    assert got == {0: (1, 0), 1: (2, 3), 2: (2, 3), 3: (1, 0), 4: (0, 1), 5: (0, 1), 6: (2, 4), 7: (1, 2), 8: (2, 4), 9: (3, 5), 10: (3, 5)}


@pytest.mark.parametrize("sigma_l,part", [(2.0, 0.5), (1e6, 1.0)])
def test_graph_in_the_plane_is_that_of_all_pairs(spark, monkeypatch, sigma_l, part):
    """Chunks beyond the bound are never sent; with little decay all are."""
    r = np.random.default_rng(9)
    n = 300
    at, m, wm = r.random((n, 2)) * 60, r.integers(0, 3, (n, 3)) * 0.3, r.normal(size=(n, 3)) * 0.3
    m[7], wm[7] = m[8], wm[8]
    tables = [spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sp int, x array<double>") for x in (m, wm)]
    places = spark.createDataFrame([(i, *v) for i, v in enumerate(at.tolist())], "sp int, ci double, cj double")
    sent, stored = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda d, label: sent.append((label, out := stored(d, label))) or out)
    got = {(x["s"], x["t"]): x["w"] for x in graph.fcf_graph(*tables, places, 1.0, sigma_l, 0.7, 5, block=12).collect()}
    d = 0.7 * ((wm[:, None] - wm) ** 2).sum(2) + 0.3 * ((m[:, None] - m) ** 2).sum(2)
    f = np.exp(-d)
    w = np.where(f == 1, 0, f * np.exp(-np.sqrt(((at[:, None] - at) ** 2).sum(2)) / sigma_l))
    near = np.where((w >= np.sort(w, 1)[:, -5, None]) & (w > 0), w, 0)
    near = np.maximum(near, near.T)
    assert got.keys() == {(int(i), int(j)) for i, j in np.argwhere(near)}
    np.testing.assert_allclose([got[k] for k in got], [near[k] for k in got])
    assert dict(sent)["chunk-pairs"].count() <= part * 25 * 24


def test_sample_drops_small_classes(spark):
    df = spark.createDataFrame([(p, 1 if p < 3 else 2) for p in range(7)], "p int, gt int")
    got = features.stratified_sample(df, 3, 7).groupBy("cls").count().collect()
    assert [(r["cls"], r["count"]) for r in got] == [(2, 3)]
    assert features.stratified_sample(df, 3, 7, keep_small=True).count() == 6


def test_constant_band(spark):
    df = spark.createDataFrame([(p, 0, float(p)) for p in range(4)] + [(p, 1, 5.0) for p in range(4)], "p int, k int, x double")
    assert {r["z"] for r in stats.standardize(df).where("k = 1").collect()} == {0.0}
    f = stats.scale_features(df.withColumnRenamed("p", "sp"), "x").where("k = 1").collect()
    assert {r["f"] for r in f} == {-1.0}


def test_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    got = df.select(V.normalized(F.col("v")).alias("u"), V.minmax(F.col("v")).alias("m")).collect()
    assert all(np.isnan(got[0]["u"])) and got[1]["u"] == [0.6, 0.8] and all(np.isnan(got[0]["m"])) and got[1]["m"] == [0.0, 1.0]


def test_assignment_ties_and_reach(spark):
    px = spark.createDataFrame([(0, 0, 0, [0.0], [0.0]), (1, 0, 2, [0.0], [0.0]), (2, 0, 9, [0.0], [0.0])], "p int, i int, j int, v array<double>, lcmr array<double>")
    cl = spark.createDataFrame([(7, 0, 3, [0.0], [0.0], 1.0), (3, 0, 1, [0.0], [0.0], 1.0)], "c int, i int, j int, v array<double>, lcmr array<double>, scale double")
    got = {r["p"]: r["c"] for r in segment.assign(px, cl, 1, 4.0).collect()}
    assert got == {0: 3, 1: 3, 2: None}


def test_contraction_guard():
    with pytest.raises(ValueError):
        segment.check_contraction(10, 10, 10)


def test_superpixels_cover_and_connect(raster, spark, sf_dir):
    rows = catalog.QUERIES["hms"](spark, sf_dir).collect()
    h, w = neighbourhood.extent(raster)
    grid = np.full((h, w), -1)
    for r in rows:
        grid[r["i"], r["j"]] = r["sp"]
    assert (grid >= 0).all() and sorted(np.unique(grid)) == list(range(grid.max() + 1))


def test_partitions_do_not_change_results(spark, raster):
    one = sorted(map(tuple, neighbourhood.adjacency(raster.coalesce(1)).collect()))
    many = sorted(map(tuple, neighbourhood.adjacency(raster.repartition(8)).collect()))
    assert one == many


def test_pipeline_scores_separable_classes(spark, sf_dir):
    got = {(r["run"], r["metric"]): r["value"] for r in catalog.QUERIES["classify_blocks"](spark, sf_dir).collect() if r["metric"] == "oa"}
    assert set(got) == {(0, "oa"), (1, "oa")} and min(got.values()) > 0.3


def test_empty_tables(spark):
    px = spark.createDataFrame([], "p int, gt int, pred int, sp int")
    assert evaluate.coverage(px).first()["accuracy"] is None
    assert evaluate.confusion(px).count() == 0
    assert graph.symmetric(spark.createDataFrame([], "s int, t int, w double")).count() == 0


def _element(kind, body):
    return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def test_scenes_from_mat_files(spark, tmp_path):
    def element(name, array, packed):
        body = _element(6, struct.pack("<II", 6, 0)) + _element(5, struct.pack(f"<{array.ndim}i", *array.shape)) + _element(1, name.encode()) + _element(9, array.astype("<f8").tobytes(order="F"))
        element = _element(14, body)
        if packed:
            z = zlib.compress(element)
            element = struct.pack("<II", 15, len(z)) + z
        return b"MATLAB 5.0".ljust(124) + struct.pack("<H", 0x100) + b"IM" + element

    cube, truth = np.arange(24.0).reshape(2, 3, 4), np.array([[0, 1, 2], [2, 1, 0]])
    (tmp_path / "KSC").mkdir()
    (tmp_path / "KSC/KSC.mat").write_bytes(element("KSC", cube, True))
    (tmp_path / "KSC/KSC_gt.mat").write_bytes(element("KSC_gt", truth, False))
    rows = source.from_scene(spark, str(tmp_path), "KSC").orderBy("p").collect()
    assert [r["v"] for r in rows] == cube.reshape(-1, 4).tolist() and [r["gt"] for r in rows] == truth.ravel().tolist()
    with pytest.raises(ValueError):
        source.from_scene(spark, str(tmp_path), "Elsewhere")


def test_mat_files_round_trip(spark, tmp_path, monkeypatch):
    """Written by tasks and read back in small pieces; names, small tags and other arrays before the one wanted."""
    monkeypatch.setattr(mat, "PIECE", 37)
    r = np.random.default_rng(12)
    cube, truth = r.normal(size=(7, 5, 3)), r.integers(0, 4, (7, 5))
    rows = [(i, j, cube[i, j].tolist(), int(truth[i, j])) for i in range(7) for j in range(5)]
    df = spark.createDataFrame(rows, "i int, j int, v array<double>, gt int").repartition(4)
    mat.write(df, str(tmp_path / "a.mat"), "scene")
    mat.write(df, str(tmp_path / "b.mat"), "gt", "gt")
    got = source.from_files(spark, (str(tmp_path / "a.mat"), "scene"), (str(tmp_path / "b.mat"), "gt")).orderBy("p").collect()
    assert [(x["i"], x["j"], x["v"], x["gt"]) for x in got] == rows
    a, b = (tmp_path / "a.mat").read_bytes(), (tmp_path / "b.mat").read_bytes()
    (tmp_path / "both.mat").write_bytes(b + a[128:])
    assert mat.pixels(spark, str(tmp_path / "both.mat"), "scene").count() == 35
    with pytest.raises(Exception, match="no array named other"):
        mat.pixels(spark, str(tmp_path / "both.mat"), "other").count()


def read_png(data):
    at, body, size = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + part)
        size = struct.unpack(">II", part[:8]) if kind == b"IHDR" else size
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(size[1], 1 + 3 * size[0])
    assert not lines[:, 0].any()
    return lines[:, 1:].reshape(size[1], size[0], 3)


def test_png_holds_the_table(spark, tmp_path):
    r = np.random.default_rng(13)
    picture = r.integers(0, 256, (150, 9, 3))
    picture[3, 4] = 0
    df = spark.createDataFrame([(i, j, *picture[i, j].tolist()) for i in range(150) for j in range(9) if (i, j) != (3, 4)], "i int, j int, r int, g int, b int").repartition(5)
    render.write_png(df, str(tmp_path / "x.png"))
    np.testing.assert_array_equal(read_png((tmp_path / "x.png").read_bytes()), picture)
    for a, b in ((b"", b"x"), (b"abc" * 9999, b"zz" * 40_000), (b"q", b"")):
        assert render.joined_adler(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)


def test_maps_of_the_best_run(spark, raster, tmp_path):
    from loomgrid.plans import pipeline

    maps = {}
    metrics = pipeline.classify(raster, Config(labelled=5, runs=2, sigma=2.0, sigma_l=10.0), maps)
    paths = pipeline.write_maps(metrics, maps, str(tmp_path), "Salinas")
    best = max((x["value"], -x["run"]) for x in metrics.where("metric = 'oa'").collect())
    px = {(x["i"], x["j"]): x for x in maps[-best[1]].collect()}
    for path, masked in zip(paths, (False, True), strict=True):
        for (i, j), x in px.items():
            assert tuple(read_png(open(path, "rb").read())[i, j]) == render.PALETTE_17[0 if masked and x["gt"] == 0 else x["pred"]]


def test_draws_of_two_seeds_are_independent(spark):
    df = spark.range(10_000).select(F.col("id").cast("int").alias("p"), F.lit(1).alias("gt"))
    drawn = {seed: {r["p"] for r in features.stratified_sample(df, 500, seed).collect()} for seed in (7, 8, 12)}
    for a, b in ((7, 8), (7, 12), (8, 12)):
        assert len(drawn[a]) == 500 and 10 <= len(drawn[a] & drawn[b]) <= 45  # 25 by chance


def test_drawn_parameters():
    one, other, mid = Config.of_scene("Indiana", 1, True), Config.of_scene("Indiana", 2, True), Config.of_scene("Indiana")
    assert one != other and one == Config.of_scene("Indiana", 1, True) and 0.89 <= one.mix <= 0.9
    assert one.of_run(0) != one.of_run(1) and mid.of_run(0) == mid.of_run(1) == (0.195, 0.125)
    assert 0.19 <= one.of_run(3)[0] <= 0.2 and 0.1 <= one.of_run(3)[1] <= 0.15


def test_block_pairs_in_several_blocks(spark):
    r = np.random.default_rng(3)
    x = r.integers(0, 3, (60, 2)).astype(float)  # many ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sp int, x array<double>")
    d = ((x[:, None] - x) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    for k in (4, None):
        want = {(s, t) for s in range(60) for t in range(60) if s != t and (k is None or d[s, t] <= np.sort(d[s])[k - 1])}
        for block in (7, 2048):
            got = {(e["s"], e["t"]): e["c"] for e in graph.block_pairs(df, graph._squared, k, "sp", "x", "c", block).collect()}
            assert set(got) == want and all(got[s, t] == d[s, t] for s, t in want)


def test_blocked_graphs_have_no_cross_join(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "sp int, x array<double>")
    at = df.select("sp", F.col("sp").cast("double").alias("ci"), F.lit(0.0).alias("cj"))
    for out in (graph.pairwise(df), graph.combined(df, df, 0.5, 3), graph.fcf_graph(df, df, at, 1.0, 1.0, 0.5, 3)):
        plan = out._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_covariance_of_large_values(spark):
    x = 1e8 + np.random.default_rng(1).normal(size=(400, 3))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    assert np.allclose(stats.covariance_matrix(df), np.cov(x.T), rtol=1e-6)


def test_mbo_against_a_plain_loop(spark):
    r = np.random.default_rng(5)
    n = 24
    w = np.triu(r.random((n, n)) * (r.random((n, n)) < 0.3), 1)
    w += w.T
    w[np.arange(n), (np.arange(n) + 1) % n] = w[(np.arange(n) + 1) % n, np.arange(n)] = 0.5
    y = np.zeros((n, 3))
    y[[0, 1, 2, 9], [0, 1, 2, 1]] = [2, 1, 3, 1]
    edges = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]], "s long, t long, w double")
    labels = spark.createDataFrame([(int(i), int(c) + 1, float(y[i, c])) for i, c in np.argwhere(y)], "node long, cls int, y double")
    got = dict(map(tuple, graph.graph_mbo(edges, labels, 30.0).collect()))
    values, basis = np.linalg.eigh(np.eye(n) - w / np.sqrt(np.outer(w.sum(1), w.sum(1))))
    u, d = y.copy(), np.zeros((n, 3))
    for _ in range(20):
        a = basis.T @ u
        for k in range(n):
            a[k] = a[k] * (1 - 0.01 * values[k]) - 0.01 * d[k]
        u = basis @ a
        d = basis.T @ (30.0 * (y.max(1) > 0)[:, None] * (u - y))
        u = np.eye(3)[u.round(12).argmax(1)]
    assert got == {i: int(u[i].argmax()) + 1 for i in range(n)}
    by_class = dict(map(tuple, graph.graph_mbo(edges, labels, 30.0, by_class=True).collect()))
    u, d = y.copy(), np.zeros((n, 3))
    for _ in range(20):
        u = basis @ ((1 - 0.01 * values[:, None]) * (basis.T @ u)) - 0.01 * d
        d = 30.0 * (y.max(1) > 0)[None, :3] * (u - y)
        u = np.eye(3)[u.round(12).argmax(1)]
    assert by_class == {i: int(u[i].argmax()) + 1 for i in range(n)}


def test_conjugate_gradients_at_a_small_mu(spark, monkeypatch):
    """Condition 200, an unconnected part, a node without edges."""
    r = np.random.default_rng(8)
    n = 300
    w = np.zeros((n, n))
    for i in range(n - 1):
        for j in r.integers(0, n - 1, 3):
            if (i < 40) == (j < 40) and i != j:
                w[i, j] = w[j, i] = r.random() + 0.1
    edges = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in np.argwhere(w)], "s long, t long, w double")
    labels = spark.createDataFrame([(50, 2, 1), (51, 7, 3), (60, 2, 2), (n - 1, 7, 1)], "node long, cls int, y int")
    monkeypatch.setattr(graph, "DRIVER_NODES", 0)
    got = {(r["node"], r["cls"]): r["f"] for r in graph.lgc(edges, labels, 0.01).collect()}
    deg = np.where(w.sum(1) > 0, w.sum(1), 1)
    y = np.zeros((n, 2))
    y[[50, 60, 51, n - 1], [0, 0, 1, 1]] = [1, 2, 3, 1]
    a = 1 / 1.01
    f = (1 - a) * np.linalg.solve(np.eye(n) - a * w / np.sqrt(np.outer(deg, deg)), y)
    assert len(got) == 2 * len(np.flatnonzero((w.sum(1) > 0) | (y.max(1) > 0)))
    assert max(abs(v - f[i, 0 if c == 2 else 1]) for (i, c), v in got.items()) < 1e-8


def test_rounds_without_bound_and_a_warning_at_one(raster, spark):
    from loomgrid.operators import lcmr, reduce

    pixels = raster.select("p", "i", "j", "v").join(lcmr.log_matrices(reduce.mnf(raster, 3), "mnf", 3, 5), "p")
    assert segment.segment(pixels, 20, most_rounds=None).count() == raster.count()
    with pytest.warns(UserWarning, match="still fell"):
        segment.segment(pixels, 20, most_rounds=1, wrap_unassigned=True).count()


def test_unassigned_pixels_count_for_the_last_cluster(spark):
    px = spark.createDataFrame([(0, 0, 0, [1.0], [0.0], 1.0), (1, 0, 1, [3.0], [0.0], 1.0)], "p int, i int, j int, v array<double>, lcmr array<double>, area double")
    labels = spark.createDataFrame([(0, 4), (1, None)], "p int, c int")
    assert [tuple(r["v"]) for r in segment.update(px, labels).collect()] == [(1.0,)]
    assert [tuple(r["v"]) for r in segment.update(px, labels, 4).collect()] == [(2.0,)]


def test_log_matrices_around_the_pixel_above():
    from loomgrid.operators.lcmr import window_logm

    cube = np.random.default_rng(3).random((9, 9, 3)) + 0.1
    own = slice(2, 7), slice(2, 7)
    got, whole = window_logm(cube, own, 5, 9, above=1), window_logm(cube, own, 5, 25)
    assert not np.allclose(got, window_logm(cube, own, 5, 9)) and np.allclose(whole, window_logm(cube, own, 5, 25, above=1))
    window = cube[1:6, 2:7].transpose(1, 0, 2).reshape(-1, 3)  # of the pixel (3, 4)
    unit = window / np.linalg.norm(window, axis=1, keepdims=True)
    held = window[np.argsort(-np.round(unit @ unit[5 * 5 // 2 - 1], 10), kind="stable")[:9]]
    held = (held - held.min(1, keepdims=True)) / np.ptp(held, axis=1, keepdims=True)
    cov = np.cov(held.T)
    values, vectors = np.linalg.eigh(cov + 0.001 * np.trace(cov) * np.eye(3))
    assert np.allclose(got[1, 2], vectors @ np.diag(np.log(values)) @ vectors.T)


def test_nearest_skips_chunks_of_clustered_vectors(spark, monkeypatch):
    """Far clusters: most pairs of chunks are never sent, and the rows are those of all pairs; copies and lone vectors too."""
    r = np.random.default_rng(11)
    x = np.concatenate([c * 50 + r.normal(size=(60, 5)) for c in r.normal(size=(12, 5))] + [np.ones((30, 5)), r.normal(size=(3, 5)) * 1e3])
    keys = r.permutation(len(x)) * 3
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(keys, x, strict=True)], "vec_id long, embedding array<double>").repartition(4)
    sent = []
    stored = metric.stored
    monkeypatch.setattr(metric, "stored", lambda d, label: sent.append((label, out := stored(d, label))) or out)
    got = {}
    for e in metric.nearest(df, 4, block=20).collect():
        got.setdefault(e["s"], []).append((e["d2"], e["t"]))
    for n, i in enumerate(keys):
        d = sorted((float(((x[n] - x[m]) ** 2).sum()), int(j)) for m, j in enumerate(keys) if m != n)[:4]
        assert [t for _, t in sorted(got[int(i)])] == [t for _, t in d]
    tables = dict(sent)
    chunks = tables["chunks"].select("chunk").distinct().count()
    assert chunks > 30 and tables["chunk-pairs"].count() < chunks * chunks / 2
