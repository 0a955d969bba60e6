"""Connectivity, merging and the segmentation loop against plain versions that walk the raster and the clusters in order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.operators import connect, merging, neighbourhood, segment, sums


def scan(labels, least, most):
    """The rule of the connectivity step, pixel by pixel."""
    h, w = labels.shape
    out, number = np.full((h, w), -1), 0
    for i in range(h):
        for j in range(w):
            if out[i, j] >= 0:
                continue
            beside, found, at = 0, [(i, j)], 0
            out[i, j] = number
            while at < len(found) < most:
                for di, dj in ((0, 1), (0, -1), (1, 0), (-1, 0)):
                    y, x = found[at][0] + di, found[at][1] + dj
                    if not (0 <= y < h and 0 <= x < w):
                        continue
                    if labels[y, x] == labels[i, j] and out[y, x] < 0:
                        out[y, x] = number
                        found.append((y, x))
                        if len(found) >= most:
                            break
                    elif out[y, x] >= 0 and out[y, x] != number:
                        beside = out[y, x]
                at += 1
            if len(found) < least:
                for y, x in found:
                    out[y, x] = beside
            else:
                number += 1
    return out


def solved(spark, labels, least, most, tile):
    h, w = labels.shape
    rows = [(i * w + j, i, j, None if labels[i, j] < 0 else int(labels[i, j])) for i in range(h) for j in range(w)]
    got = np.full((h, w), -1)
    for r in connect.connectivity(spark.createDataFrame(rows, "p int, i int, j int, c int"), w, least, most, tile).collect():
        got[r["i"], r["j"]] = r["sp"]
    return got


@pytest.mark.parametrize("h,w,kinds,blot,least,most,tile", [(60, 70, 3, 1, 8, 10**6, 16), (60, 50, 2, 1, 8, 60, 7), (64, 64, 4, 3, 8, 200, 256), (45, 80, 3, 2, 12, 40, 10), (9, 200, 5, 1, 3, 30, 5), (50, 50, 9, 1, 8, 100, 8), (40, 41, 1, 1, 8, 90, 6)])
def test_connectivity_is_that_of_the_scan(spark, h, w, kinds, blot, least, most, tile):
    r = np.random.default_rng(h * w + kinds)
    labels = np.kron(r.integers(-1 if kinds > 4 else 0, kinds, (-(-h // blot), -(-w // blot))), np.ones((blot, blot), int))[:h, :w]
    np.testing.assert_array_equal(solved(spark, labels, least, most, tile), scan(labels, least, most))


def test_small_pieces_follow_chains(spark):
    """Stripes too small to stand alone: each joins the one before, all of them number 0."""
    labels = np.arange(40)[None].repeat(2, 0)
    assert (solved(spark, labels, 8, 100, 4) == 0).all()
    wide = np.concatenate([np.full((2, 9), 99), labels, np.full((2, 9), 98)], 1)
    np.testing.assert_array_equal(solved(spark, wide, 8, 100, 4), scan(wide, 8, 100))
    assert solved(spark, np.array([[5, 5, 7, 7]]), 1, 9, 2).tolist() == [[0, 0, 1, 1]]
    with pytest.raises(ValueError):
        solved(spark, wide, 8, 7, 4)


def test_kernels_against_the_scan():
    """Hundreds of rasters: regions, cut regions and what small ones meet last, without Spark's share."""
    r = np.random.default_rng(1)
    for n in range(300):
        labels = r.integers(0, 2 + n % 4, (20, 25))
        least, most = 8, int(r.integers(8, 80))
        root = connect.grid_components(labels, np.ones_like(labels, bool))
        piece = np.zeros(500, int)
        for x in np.unique(root):
            p = np.flatnonzero(root.ravel() == x)
            piece[p] = connect.cut_region(p, 25, most)
        begin, size = np.unique(piece, return_counts=True)
        number, final = 0, {}
        for b, s in zip(begin, size, strict=True):
            if s >= least:
                final[b] = number
                number += 1
            else:
                cells = [divmod(int(p), 25) for p in np.flatnonzero(piece == b)]
                beside = {(i, j, o): piece[(i + di) * 25 + j + dj] for i, j in cells for o, (di, dj) in enumerate(connect.AROUND) if 0 <= i + di < 20 and 0 <= j + dj < 25 and piece[(i + di) * 25 + j + dj] < b}
                final[b] = final.get(connect.last_met(cells, beside), 0)
        np.testing.assert_array_equal(np.array([final[x] for x in piece]).reshape(20, 25), scan(labels, least, most))


def merge_in_order(clusters, edges, lsr):
    """Clusters {c: [i, j, area, scale, v, m]} one after the other."""
    left, visited = {c: list(x) for c, x in clusters.items()}, set()
    for c in sorted(clusters):
        if c in visited:
            continue
        visited.add(c)
        near = sorted(n for n in edges.get(c, ()) if n not in visited)
        a = left[c]
        if not near or a[2] >= lsr / 5:
            continue
        if a[2] < lsr / 32:
            n = min(near, key=lambda n: (np.linalg.norm(left[n][4] - a[4]), n))
        else:
            n = min(near, key=lambda n: ((a[2] + left[n][2]) / (lsr / 5), n))
            if (a[2] + left[n][2]) / (lsr / 5) >= 1:
                continue
        b = left.pop(n)
        visited.add(n)
        total = a[2] + b[2]
        mean = lambda x, y: (x * a[2] + y * b[2]) / total  # noqa: B023,E731
        left[c] = [round(mean(a[0], b[0])), round(mean(a[1], b[1])), total, mean(a[3], b[3]), mean(a[4], b[4]), (a[5] + b[5]) / 2]
    return left


@pytest.mark.parametrize("side,seed", [(None, 1), (10, 2), (25, 3), (5, 4)])
def test_merging_is_that_of_the_order(spark, side, seed):
    r = np.random.default_rng(seed)
    h, w = 14, 15
    ids = r.permutation(h * w).reshape(h, w) if seed % 2 else np.arange(h * w).reshape(h, w)
    clusters = {int(ids[i, j]): [5 * i, 5 * j, float(r.choice([1.0, 2.0, 3.0, 10.0, 20.0, 60.0])), float(r.uniform(0.3, 1.7)), r.integers(0, 4, 3) * 1.0, r.normal(size=2)] for i in range(h) for j in range(w)}
    edges = {}
    for i in range(h):
        for j in range(w):
            for di, dj in ((0, 1), (1, 0), (1, 1)):
                if i + di < h and j + dj < w and r.random() < 0.8:
                    a, b = int(ids[i, j]), int(ids[i + di, j + dj])
                    edges.setdefault(a, set()).add(b)
                    if r.random() < 0.9:  # adjacency has a direction
                        edges.setdefault(b, set()).add(a)
    frame = spark.createDataFrame([(c, x[0], x[1], x[2], x[3], x[4].tolist(), x[5].tolist()) for c, x in clusters.items()], "c int, i int, j int, area double, scale double, v array<double>, lcmr array<double>")
    got = {x["c"]: x for x in merging.merge(frame, spark.createDataFrame([(a, b) for a, bs in edges.items() for b in bs], "src int, dst int"), 100.0, side).collect()}
    want = merge_in_order(clusters, edges, 100.0)
    assert set(got) == set(want) and len(want) < len(clusters) - 20
    for c, (i, j, area, scale, v, m) in want.items():
        x = got[c]
        assert (x["i"], x["j"]) == (i, j)
        np.testing.assert_allclose([x["area"], x["scale"], *x["v"], *x["lcmr"]], [area, scale, *v, *m])


@pytest.mark.parametrize("most", [20_000, 1])
def test_merging_of_a_long_chain_takes_few_rounds(spark, monkeypatch, most):
    """Each cluster would take the next: that of a tile's first waits for the tile before it, 40 tiles in a row."""
    monkeypatch.setattr(merging, "ONE_TASK", most)
    rounds, real = [], merging.stored
    monkeypatch.setattr(merging, "stored", lambda df, label: rounds.append(label) or real(df, label))
    n = 81
    wishes = spark.createDataFrame([(c, c + 1, 0) for c in range(n - 1)], "a int, n int, turn int")
    places = spark.createDataFrame([(c, 5 * c, 0) for c in range(n)], "c int, i int, j int")
    got = sorted((x["a"], x["n"]) for x in merging.partners(wishes, places, 10).collect())
    assert got == [(c, c + 1) for c in range(0, n - 1, 2)]
    assert rounds.count("merges") <= {20_000: 2, 1: 12}[most]  # 40 of tiles that stay as they are


def test_walks_in_tiles_are_those_of_the_order():
    """Hundreds of random wishes, dealt into tiles and decided in rounds, without Spark's share."""
    r = np.random.default_rng(7)
    for _ in range(300):
        n = 40
        wishes = {a: [int(x) for x in r.permutation(np.arange(a + 1, min(a + 9, n)))[: r.integers(1, 6)]] for a in range(n - 1) if r.random() < 0.6}
        taken, want = set(), []
        for a in sorted(wishes):
            if a not in taken and (left := [x for x in wishes[a] if x not in taken]):
                taken.add(left[0])
                want.append((a, left[0]))
        tile, got, left = {c: int(r.integers(0, 4)) for c in range(n)}, [], {a: list(x) for a, x in wishes.items()}
        while left:
            sure = []
            for t in range(4):
                outside = {}
                for a, x in left.items():
                    if tile[a] != t:
                        for y in x:
                            outside[y] = min(a, outside.get(y, n))
                sure += merging.walk({a: x for a, x in left.items() if tile[a] == t}, outside)
            assert sure
            got += sure
            gone, took = {x for s in sure for x in s}, {x for _, x in sure}
            left = {a: y for a, x in left.items() if a not in gone and (y := [z for z in x if z not in took])}
        assert sorted(got) == want


def test_merge_by_hand(spark):
    def run(areas, colours, edges):
        frame = spark.createDataFrame([(n, 0, n, float(a), 0.4 + n / 20, [float(v)], [0.0]) for n, (a, v) in enumerate(zip(areas, colours, strict=True))], "c int, i int, j int, area double, scale double, v array<double>, lcmr array<double>")
        return {x["c"]: (x["area"], round(x["scale"], 6)) for x in merging.merge(frame, spark.createDataFrame(edges, "src int, dst int"), 100.0).collect()}

    assert run([1, 90, 80], [0, 10, 1], [(0, 1), (0, 2), (1, 2), (2, 1)]) == {0: (81.0, round((0.4 + 80 * 0.5) / 81, 6)), 1: (90.0, 0.45)}
    assert len(run([15, 16], [0, 9], [(0, 1), (1, 0)])) == 2
    assert run([5, 6], [0, 9], [(0, 1), (1, 0)]) == {0: (11.0, round((5 * 0.4 + 6 * 0.45) / 11, 6))}


def test_empty_clusters_move_a_quarter_step(spark):
    at = spark.createDataFrame([(0, 3, 3), (1, 18, 24), (2, 17, 22), (3, 19, 23)], "c int, i int, j int")
    got = {r["c"]: (r["i"], r["j"]) for r in segment.reseeded(at, 10, 20, 25).collect()}
    assert got == {0: (5, 5), 1: (17, 22), 2: (19, 24), 3: (17, 22)}  # round(10 / 4) = 2


def test_boxes_are_summed_at_any_step(spark):
    r = np.random.default_rng(2)
    grid = r.random((13, 17))
    df = spark.createDataFrame([(i, j, float(grid[i, j])) for i in range(13) for j in range(17)], "i int, j int, area double")
    for step in (0, 2, 20):
        for x in segment.box_sums(df, step).collect():
            i, j = x["i"], x["j"]
            assert np.isclose(x["box"], grid[max(i - step, 0) : i + step + 1, max(j - step, 0) : j + step + 1].sum())


def test_sums_of_vectors(spark):
    r = np.random.default_rng(3)
    rows = [(int(k), float(a), r.normal(size=3).tolist()) for k, a in zip(r.integers(0, 500, 3000), r.normal(size=3000), strict=True)]
    got = {x["k"]: x for x in sums.by_key(spark.createDataFrame(rows, "k int, a double, v array<double>").repartition(6), "k", ["a"], ["v"]).collect()}
    assert len(got) == len({x[0] for x in rows})
    for k in got:
        own = [x for x in rows if x[0] == k]
        np.testing.assert_allclose([got[k]["a"], *got[k]["v"]], [sum(x[1] for x in own), *np.sum([x[2] for x in own], 0)])


def test_segments_do_not_hang_on_tiles(spark, sf_dir):
    from loomgrid.sources import raster as source

    px = source.from_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("p", "i", "j", "v", F.slice("v", 1, 4).alias("lcmr"))
    runs = [sorted(map(tuple, segment.segment(px, 20, most_rounds=4, tile=t, merge_side=m).collect())) for t, m in ((None, None), (6, 8))]
    assert runs[0] == runs[1]
    h, w = neighbourhood.extent(px)
    assert len(runs[0]) == h * w and {r[3] for r in runs[0]} == set(range(max(r[3] for r in runs[0]) + 1))
