"""Registered queries of the raster and graph operators, with the SQL that gives the same rows.

All run on the raster view of ``embeddings``: blocks of five by five pixels stand in for superpixels,
so that operators on nodes can be tested apart from the segmentation.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions import vectors as V
from loomgrid.operators import evaluate, features, graph, lcmr, merging, neighbourhood, reduce, render, segment, stats
from loomgrid.plans.pipeline import Config, classify, run_pipeline
from loomgrid.sources import mat
from loomgrid.sources.raster import bands, from_embeddings, from_files
from loomgrid.sources.stored import shared_dir, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

STEP, COMPACT, SIGMA, SIGMA_L, MIX, SAMPLE, SEED, ALPHA = 5, 4.0, 2.0, 10.0, 0.9, 5, 7, 1 / 1.125

_VIEWS = {
    "px": "SELECT cast(row_number() OVER (ORDER BY label, vec_id) - 1 AS int) p, vec_id, label, embedding FROM embeddings",
    "raster": """SELECT p, p // 25 i, p % 25 j, cast(CASE WHEN vec_id % 7 = 0 THEN 0 ELSE label + 1 END AS int) gt, label + 1 gt_full,
        list_transform(embedding, lambda x, k: cast(x AS double) + CASE WHEN (k - 1) % 10 = label THEN 0.5 ELSE 0.0 END) v,
        cast((p // 25 // 5) * 5 + ((p % 25) // 5) AS int) sp FROM px""",
    "bands": "SELECT p, i, j, gt, sp, cast(generate_subscripts(v, 1) - 1 AS int) k, unnest(v) x FROM raster",
    "dim": "SELECT max(i) + 1 h, max(j) + 1 w FROM raster",
    "noise": """SELECT p, i, j, k, coalesce((x - lag(x) OVER (PARTITION BY k, j ORDER BY i)) / 2, 0)
        + coalesce((x - lead(x) OVER (PARTITION BY k, i ORDER BY j)) / 2, 0) d FROM bands""",
    "mean": "SELECT sp, k, avg(x) mu FROM bands GROUP BY sp, k",
    "four": "SELECT * FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) t(a, b)",
    "adj": """SELECT DISTINCT a.sp src, b.sp dst FROM raster a, four f, dim, raster b
        WHERE a.i BETWEEN 1 AND h - 2 AND a.j BETWEEN 1 AND w - 2 AND b.i = a.i + f.a AND b.j = a.j + f.b AND a.sp <> b.sp""",
    "nw": """SELECT src, dst, exp(-sum((a.mu - b.mu) * (a.mu - b.mu)) / 15.0) w FROM adj JOIN mean a ON a.sp = src
        JOIN mean b ON b.sp = dst AND b.k = a.k GROUP BY src, dst""",
    "wmean": """SELECT m.sp, m.k, CASE WHEN coalesce(q.w, 0) > 0 THEN q.s / q.w ELSE m.mu END wmu FROM mean m LEFT JOIN
        (SELECT src sp, k, sum(w * mu) s, sum(w) w FROM nw JOIN mean ON mean.sp = dst GROUP BY src, k) q ON q.sp = m.sp AND q.k = m.k""",
    "cent": "SELECT sp, avg(i) ci, avg(j) cj FROM raster GROUP BY sp",
    "counts": "SELECT sp, gt cls, count(*) n FROM raster GROUP BY sp, gt",
    "major": "SELECT sp, cls, n FROM (SELECT *, row_number() OVER (PARTITION BY sp ORDER BY n DESC, cls) r FROM counts) WHERE r = 1",
    "sample": """SELECT p, gt cls FROM (SELECT p, gt, row_number() OVER (PARTITION BY gt ORDER BY md5(p || ':7'), p) rn,
        count(*) OVER (PARTITION BY gt) size FROM raster WHERE gt > 0) WHERE rn <= 5 AND size > 5""",
    "nodelab": "SELECT sp, cls, count(*) n FROM raster JOIN sample USING (p) GROUP BY sp, cls",
    "pred": "SELECT r.p, r.i, r.j, r.gt, r.sp, m.cls pred FROM raster r JOIN major m USING (sp)",
    "tested": "SELECT * FROM pred WHERE gt > 0 AND p NOT IN (SELECT p FROM sample)",
    "conf": "SELECT pred, gt, count(*) n FROM tested GROUP BY pred, gt",
    "comb": """SELECT a.sp s, b.sp t, 0.9 * sum((wa.wmu - wb.wmu) * (wa.wmu - wb.wmu)) + (1 - 0.9) * sum((a.mu - b.mu) * (a.mu - b.mu)) d
        FROM mean a JOIN mean b ON a.k = b.k AND a.sp <> b.sp JOIN wmean wa ON wa.sp = a.sp AND wa.k = a.k
        JOIN wmean wb ON wb.sp = b.sp AND wb.k = b.k GROUP BY a.sp, b.sp""",
    "fw": """SELECT s, t, exp(-d / 4.0) * exp(-sqrt(pow(a.ci - b.ci, 2) + pow(a.cj - b.cj, 2)) / 10.0) w FROM comb
        JOIN cent a ON a.sp = s JOIN cent b ON b.sp = t WHERE exp(-d / 4.0) <> 1""",
    "ftop": "SELECT s, t, w FROM (SELECT *, rank() OVER (PARTITION BY s ORDER BY w DESC) r FROM fw) WHERE r <= 8",
    "fcf": "SELECT s, t, max(w) w FROM (SELECT s, t, w FROM ftop UNION ALL SELECT t, s, w FROM ftop) GROUP BY s, t",
    "deg": "SELECT s, sum(w) deg FROM fcf GROUP BY s",
    "norm": "SELECT f.s, f.t, f.w / sqrt(a.deg * b.deg) w FROM fcf f JOIN deg a ON a.s = f.s JOIN deg b ON b.s = f.t",
    "y": "SELECT sp node, cls, cast(n AS double) y FROM nodelab",
    "f1": """SELECT node, cls, sum(f) f FROM (SELECT s node, cls, w * y / 1.125 f FROM norm JOIN y ON node = t UNION ALL
        SELECT node, cls, (1 - 1 / 1.125) * y FROM y) GROUP BY node, cls""",
    "f2": """SELECT node, cls, sum(f) f FROM (SELECT s node, cls, w * f / 1.125 f FROM norm JOIN f1 ON node = t UNION ALL
        SELECT node, cls, (1 - 1 / 1.125) * y FROM y) GROUP BY node, cls""",
    "f3": """SELECT node, cls, sum(f) f FROM (SELECT s node, cls, w * f / 1.125 f FROM norm JOIN f2 ON node = t UNION ALL
        SELECT node, cls, (1 - 1 / 1.125) * y FROM y) GROUP BY node, cls""",
    # (1 - a)(y + a S y + (a S)^2 y + ...): each step doubles the number of terms
    "lp0": "SELECT s, t, w / 1.125 w FROM norm",
    "lf0": """SELECT n.node, c.cls, (1 - 1 / 1.125) * coalesce(y.y, 0) f FROM (SELECT s node FROM norm UNION SELECT node FROM y) n, (SELECT DISTINCT cls FROM y) c
        LEFT JOIN y ON y.node = n.node AND y.cls = c.cls""",
    **{f"lf{j + 1}": f"""SELECT node, cls, sum(f) f FROM (SELECT node, cls, f FROM lf{j} UNION ALL SELECT p.s, q.cls, p.w * q.f FROM lp{j} p JOIN lf{j} q ON q.node = p.t)
        GROUP BY node, cls""" for j in range(9)},
    **{f"lp{j + 1}": f"SELECT a.s, b.t, sum(a.w * b.w) w FROM lp{j} a JOIN lp{j} b ON b.s = a.t GROUP BY a.s, b.t" for j in range(8)},
    # diffusion, pull and threshold, step by step
    "mbhold": "SELECT node FROM y GROUP BY node HAVING max(y) > 0",
    "mb0": """SELECT n.node, c.cls, coalesce(y.y, 0) y, coalesce(y.y, 0) u, 0.0::DOUBLE d FROM (SELECT s node FROM fcf UNION SELECT node FROM y) n, (SELECT DISTINCT cls FROM y) c
        LEFT JOIN y ON y.node = n.node AND y.cls = c.cls""",
    **{f"mb{j + 1}": f"""SELECT node, cls, y, CASE WHEN row_number() OVER (PARTITION BY node ORDER BY round(x, 12) DESC, cls) = 1 THEN 1.0 ELSE 0.0 END u,
        CASE WHEN node IN (SELECT node FROM mbhold) THEN 0.125 * (x - y) ELSE 0 END d FROM (SELECT m.node, m.cls, m.y, 0.99 * m.u + 0.01 * coalesce(q.x, 0) - 0.01 * m.d x
        FROM mb{j} m LEFT JOIN (SELECT s node, cls, sum(w * u) x FROM norm JOIN mb{j} ON node = t GROUP BY s, cls) q ON q.node = m.node AND q.cls = m.cls)""" for j in range(20)},
    # labels spread within a superpixel until they move by less than the tolerance
    "spk": """SELECT sp, cls, row_number() OVER (PARTITION BY sp ORDER BY seen) k FROM (SELECT sp, gt cls, min(p) seen FROM raster WHERE p IN (SELECT p FROM sample) GROUP BY sp, gt
        ) QUALIFY count(*) OVER (PARTITION BY sp) > 1""",
    "spw": """SELECT a.sp, a.p, b.p q, exp(-0.1 * pow(list_distance(a.v, b.v), 2)) w FROM raster a JOIN raster b ON a.sp = b.sp AND a.p <> b.p WHERE a.sp IN (SELECT sp FROM spk)""",
    "spd": "SELECT p, sum(w) d FROM spw GROUP BY p",
    "sps": "SELECT sp, spw.p, q, w / sqrt(greatest(a.d, 1e-300) * greatest(b.d, 1e-300)) w FROM spw JOIN spd a ON a.p = spw.p JOIN spd b ON b.p = q",
    "ls0": """SELECT r.sp, r.p, k.k, CASE WHEN k.cls = r.gt AND r.p IN (SELECT p FROM sample) THEN 1.0 ELSE 0.0 END y, CASE WHEN k.cls = r.gt AND r.p IN (SELECT p FROM sample) THEN 1.0 ELSE 0.0 END f,
        false fin FROM raster r JOIN spk k USING (sp)""",
    **{f"ls{j + 1}": f"""SELECT sp, p, k, y, g f, fin OR sum(abs(g - f)) OVER (PARTITION BY sp) < 0.001 fin FROM (SELECT l.sp, l.p, l.k, l.y, l.f, l.fin,
        CASE WHEN l.fin THEN l.f ELSE 0.2 * coalesce(q.x, 0) + 0.8 * l.y END g FROM ls{j} l LEFT JOIN (SELECT sps.p, k, sum(w * f) x FROM sps JOIN ls{j} ON ls{j}.p = q GROUP BY sps.p, k) q
        ON q.p = l.p AND q.k = l.k)""" for j in range(30)},
    "seeds": "SELECT cast(row_number() OVER (ORDER BY i, j) - 1 AS int) c, p, i, j, v FROM raster WHERE i >= 2 AND j >= 2 AND (i - 2) % 5 = 0 AND (j - 2) % 5 = 0",
    "grad": """SELECT r.p, r.i, r.j, sqrt(pow(list_distance(d.v, u.v), 2) + pow(list_distance(e.v, l.v), 2)) g FROM raster r, dim
        JOIN raster d ON d.i = CASE WHEN r.i + 1 >= h THEN h - 2 ELSE r.i + 1 END AND d.j = r.j
        JOIN raster u ON u.i = CASE WHEN r.i = 0 THEN 1 ELSE r.i - 1 END AND u.j = r.j
        JOIN raster e ON e.i = r.i AND e.j = CASE WHEN r.j + 1 >= w THEN w - 2 ELSE r.j + 1 END
        JOIN raster l ON l.i = r.i AND l.j = CASE WHEN r.j = 0 THEN 1 ELSE r.j - 1 END""",
    "corner": """SELECT r.p, r.i, r.j, q.k, sum(q.x) FILTER (q.i < r.i + 1 AND q.j < r.j + 1) / 16.0 nw, sum(q.x) FILTER (q.i >= r.i AND q.j <= r.j) / 16.0 sw,
        sum(q.x) FILTER (q.i >= r.i AND q.j >= r.j) / 16.0 se, sum(q.x) FILTER (q.i <= r.i AND q.j >= r.j) / 16.0 ne
        FROM raster r, dim JOIN bands q ON q.i BETWEEN r.i - 1 AND r.i + 1 AND q.j BETWEEN r.j - 1 AND r.j + 1
        WHERE r.i BETWEEN 1 AND h - 2 AND r.j BETWEEN 1 AND w - 2 GROUP BY r.p, r.i, r.j, q.k""",
    "sides": """SELECT i, j, 0.04 + sum((nw - sw) * (nw - sw)) a, 0.04 + sum((se - sw) * (se - sw)) b, sum((nw - sw) * (se - sw)) ab,
        0.04 + sum((nw - ne) * (nw - ne)) c, 0.04 + sum((se - ne) * (se - ne)) d, sum((nw - ne) * (se - ne)) cd FROM corner GROUP BY i, j""",
    "inarea": "SELECT i, j, 0.5 * sqrt(a) * sqrt(b) * sqrt(1 - pow(ab / (sqrt(a) * sqrt(b)), 2)) + 0.5 * sqrt(c) * sqrt(d) * sqrt(1 - pow(cd / (sqrt(c) * sqrt(d)), 2)) area FROM sides",
    "area": "SELECT r.p, r.i, r.j, a.area FROM raster r, dim JOIN inarea a ON a.i = least(greatest(r.i, 1), h - 2) AND a.j = least(greatest(r.j, 1), w - 2)",
    "range_": "SELECT sum(area) total, 4 * sum(area) / (SELECT count(*) FROM seeds) lsr FROM area",
    "scaled": """SELECT c, s.i, s.j, sum(a.area) box, sqrt((SELECT lsr FROM range_) / sum(a.area)) scale FROM seeds s
        JOIN area a ON abs(a.i - s.i) <= 5 AND abs(a.j - s.j) <= 5 GROUP BY c, s.i, s.j""",
    "assigned": """SELECT p, c, dist FROM (SELECT r.p, s.c, 0.5 * list_distance(r.v, s.v) + 0.5 * list_distance(r.v, s.v)
        + 4.0 / 6 * sqrt(pow(r.i - s.i, 2) + pow(r.j - s.j, 2)) dist, row_number() OVER (PARTITION BY r.p ORDER BY
        0.5 * list_distance(r.v, s.v) + 0.5 * list_distance(r.v, s.v) + 4.0 / 6 * sqrt(pow(r.i - s.i, 2) + pow(r.j - s.j, 2)), s.c) n
        FROM raster r JOIN seeds s ON abs(r.i - s.i) <= 5 AND abs(r.j - s.j) <= 5) WHERE n = 1""",
    "unit": "SELECT p, i, j, v, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) u FROM raster",
    "win": """SELECT q.p, q.off, b.p q, round(list_dot_product(q.u, b.u), 10) cor FROM
        (SELECT a.p, a.u, (o.c + 1) * 3 + o.r + 1 off, CASE WHEN a.i + o.r < 0 THEN -1 - (a.i + o.r) WHEN a.i + o.r >= h THEN 2 * h - 1 - (a.i + o.r) ELSE a.i + o.r END ni,
        CASE WHEN a.j + o.c < 0 THEN -1 - (a.j + o.c) WHEN a.j + o.c >= w THEN 2 * w - 1 - (a.j + o.c) ELSE a.j + o.c END nj
        FROM unit a, dim, (SELECT r, c FROM (VALUES (-1), (0), (1)) x(r), (VALUES (-1), (0), (1)) y(c)) o) q JOIN unit b ON b.i = ni AND b.j = nj""",
    "wtop": "SELECT p, n AS rank, off, q, cor FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY cor DESC, off) n FROM win) WHERE n <= 5",
    "rgb0": "SELECT p, i, j, sp, v[20] r, v[16] g, v[13] b FROM raster",
    "ends": "SELECT min(least(r, g, b)) lo, max(greatest(r, g, b)) hi FROM rgb0",
    "rgb": "SELECT p, i, j, sp, cast(floor(255 * (r - lo) / (hi - lo)) AS int) r, cast(floor(255 * (g - lo) / (hi - lo)) AS int) g, cast(floor(255 * (b - lo) / (hi - lo)) AS int) b FROM rgb0, ends",
    "edge": """SELECT a.p, coalesce(bool_or(b.sp <> a.sp), false) edge FROM raster a, four f LEFT JOIN raster b ON b.i = a.i + f.a AND b.j = a.j + f.b GROUP BY a.p""",
    "wedge": """SELECT a.p, coalesce(bool_or(b.sp <> a.sp), false) edge FROM raster a, four f, dim LEFT JOIN raster b ON b.i = CASE WHEN a.i + f.a < 0 THEN h - 1 ELSE a.i + f.a END
        AND b.j = CASE WHEN a.j + f.b < 0 THEN w - 1 ELSE a.j + f.b END GROUP BY a.p""",
    "pal10": "SELECT * FROM (VALUES " + ", ".join(f"({c}, {r}, {g}, {b})" for c, (r, g, b) in enumerate(render.PALETTE_10)) + ") t(cls, r, g, b)",
    "pal": "SELECT * FROM (VALUES " + ", ".join(f"({c}, {r}, {g}, {b})" for c, (r, g, b) in enumerate(render.PALETTE_17)) + ") t(cls, r, g, b)",
}


def _needs(text: str, seen: dict[str, None]) -> None:
    """Views that the text reads, those they need first."""
    for name in re.findall(r"(?:FROM|JOIN|,)\s+([a-z_0-9]+)\b(?!\s*[.(])", text):
        if name in _VIEWS and name not in seen and _VIEWS[name] is not text:
            _needs(_VIEWS[name], seen)
            seen[name] = None


def _sql(text: str) -> str:
    seen: dict[str, None] = {}
    _needs(text, seen)
    kept = lambda n: " MATERIALIZED" if n[:2] in ("lp", "lf", "ls", "mb") or n[:3] in ("sps", "spk") else ""  # noqa: E731  # else each step would repeat all before it twice
    views = ", ".join(f"{n} AS{kept(n)} ({_VIEWS[n]})" for n in seen)
    if text.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views}, {text[15:]}"
    if text.startswith("WITH "):
        return f"WITH {views}, {text[5:]}"
    return f"WITH {views} {text}" if views else text


def query(name: str, sql: str | None = None, view: Callable[[DataFrame], DataFrame] = from_embeddings):
    """Registers f(spark, view of ``embeddings``)."""

    def register(f: Callable[[SparkSession, DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(spark, view(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
        if sql:
            ORACLE_SQL[name] = _sql(sql)
        return f

    return register


def r6(name: str, column=None):
    return F.round(F.col(name) if column is None else column, 6).alias(name)


# -- sources and scalar operators -----------------------------------------------------------------


@query("load_raster", "SELECT p, i, j, gt, sp, list_transform(v, lambda x: round(x, 6)) v FROM raster")
def _(spark, raster):
    return raster.select("p", "i", "j", "gt", "sp", V.rounded(F.col("v")).alias("v"))


@query("load_scene", "SELECT p, i, j, gt, list_transform(v, lambda x: round(x, 6)) v FROM raster")
def _(spark, raster):
    """The raster as MAT-files, like those of the known scenes, and read back."""
    raster = stored(raster.select("i", "j", "gt", "v"), "raster")
    paths = [f"{shared_dir(spark)}/loomgrid/{kind}-{uuid.uuid4().hex}.mat" for kind in ("cube", "truth")]
    mat.write(raster, paths[0], "cube")
    mat.write(raster, paths[1], "cube_gt", "gt")
    return from_files(spark, (paths[0], "cube"), (paths[1], "cube_gt")).select("p", "i", "j", "gt", V.rounded(F.col("v")).alias("v"))


@query("standardize_bands", "SELECT p, k, round((x - avg(x) OVER (PARTITION BY k)) / stddev_pop(x) OVER (PARTITION BY k), 6) z FROM bands")
def _(spark, raster):
    return stats.standardize(bands(raster)).select("p", "k", r6("z"))


@query("covariance_pairs", "SELECT a.k k1, b.k k2, round(covar_samp(a.x, b.x), 6) c FROM bands a JOIN bands b ON a.p = b.p AND a.k <= b.k GROUP BY a.k, b.k")
def _(spark, raster):
    return stats.covariance_pairs(raster).select("k1", "k2", r6("c"))


@query("shift_noise", "SELECT p, k, round(d, 6) d FROM noise")
def _(spark, raster):
    return stats.shift_noise(raster).select("p", F.posexplode("d").alias("k", "d")).select("p", "k", r6("d"))


@query("noise_covariance", "SELECT a.k k1, b.k k2, round(covar_samp(a.d, b.d), 6) c FROM noise a JOIN noise b ON a.p = b.p AND a.k <= b.k GROUP BY a.k, b.k")
def _(spark, raster):
    return stats.covariance_pairs(stats.shift_noise(raster), "d").select("k1", "k2", r6("c"))


@query(
    "cum_variance",
    """SELECT rank, k, round(ratio, 6) ratio, round(cum, 6) cum, rank <= (SELECT min(rank) FROM
    (SELECT rank, sum(ratio) OVER (ORDER BY rank) cum FROM (SELECT row_number() OVER (ORDER BY v DESC, k) rank, v / sum(v) OVER () ratio FROM
    (SELECT k, round(var_pop(x), 8) v FROM bands GROUP BY k))) WHERE cum > 0.8) keep
    FROM (SELECT rank, k, ratio, sum(ratio) OVER (ORDER BY rank) cum FROM (SELECT row_number() OVER (ORDER BY v DESC, k) rank, k, v / sum(v) OVER () ratio FROM
    (SELECT k, round(var_pop(x), 8) v FROM bands GROUP BY k)))""",
)
def _(spark, raster):
    variance = bands(raster).groupBy("k").agg(F.round(F.var_pop("x"), 8).alias("variance"))
    return stats.explained(variance, 0.8).select(F.col("rank").cast("long").alias("rank"), "k", r6("ratio"), r6("cum"), "keep")


@query(
    "mirror_pad",
    """SELECT a + 2 pi, b + 2 pj, p FROM (SELECT cast(unnest(generate_series(-2, h + 1)) AS int) a, h, w FROM dim), (SELECT cast(unnest(generate_series(-2, w + 1)) AS int) b FROM dim)
    JOIN raster ON i = CASE WHEN a < 0 THEN -1 - a WHEN a >= h THEN 2 * h - 1 - a ELSE a END AND j = CASE WHEN b < 0 THEN -1 - b WHEN b >= w THEN 2 * w - 1 - b ELSE b END""",
)
def _(spark, raster):
    return neighbourhood.mirror_pad(raster, 2)


@query("normalize_vectors", "SELECT p, k, round(x / sqrt(sum(x * x) OVER (PARTITION BY p)), 6) u FROM bands")
def _(spark, raster):
    return raster.select("p", F.posexplode(V.normalized(F.col("v"))).alias("k", "u")).select("p", "k", r6("u"))


@query("vector_minmax", "SELECT p, k, round((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w), 6) u FROM bands WINDOW w AS (PARTITION BY p)")
def _(spark, raster):
    return raster.select("p", F.posexplode(V.minmax(F.col("v"))).alias("k", "u")).select("p", "k", r6("u"))


@query("feature_minmax", "SELECT sp, k, round(2 * (mu - min(mu) OVER w) / (max(mu) OVER w - min(mu) OVER w) - 1, 6) f FROM mean WINDOW w AS (PARTITION BY k)")
def _(spark, raster):
    return stats.scale_features(features.mean_feature(raster), "mu").select("sp", "k", r6("f"))


@query("natural_log", "SELECT p, k, round(ln(abs(x) + 1), 6) y FROM bands")
def _(spark, raster):
    return raster.select("p", F.posexplode(V.logarithms(F.transform("v", lambda x: F.abs(x) + 1))).alias("k", "y")).select("p", "k", r6("y"))


@query("rounding_modes", "SELECT p, cast(round(p / 2.0 - 3.5) AS int) away, cast(round_even(p / 2.0 - 3.5, 0) AS int) even, cast(trunc(p / 2.0 - 3.5) AS int) cut FROM raster")
def _(spark, raster):
    x = F.col("p") / 2.0 - 3.5
    return raster.select("p", V.round_away(x).alias("away"), V.round_even(x).alias("even"), V.truncated(x).alias("cut"))


@query("gaussian_blur", "SELECT p, k, round(x, 6) x FROM bands")
def _(spark, raster):
    return bands(neighbourhood.blur(raster)).select("p", "k", r6("x"))


@query("window_vectors", "SELECT q.p, q.off, b.p q, list_transform(b.u, lambda x: round(x, 6)) u FROM win q JOIN unit b ON b.p = q.q")
@query("window_vectors_whole", "SELECT q.p, q.off, b.p q, list_transform(b.u, lambda x: round(x, 6)) u FROM win q JOIN unit b ON b.p = q.q")
def _(spark, raster):
    return neighbourhood.window_vectors(raster, 3).select("p", "off", "q", V.rounded(F.col("u")).alias("u"))


@query("band_selection", "SELECT p, round(v[20], 6) b0, round(v[16], 6) b1, round(v[13], 6) b2 FROM raster")
def _(spark, raster):
    return raster.select("p", *(r6(f"b{n}", F.element_at("v", k + 1)) for n, k in enumerate((19, 15, 12))))


@query("rgb_stretch", "SELECT p, r, g, b FROM rgb")
def _(spark, raster):
    return render.stretch(raster, (19, 15, 12)).select("p", "r", "g", "b")


# -- segmentation ---------------------------------------------------------------------------------


@query("seed_grid", "SELECT c, p, i, j FROM seeds")
def _(spark, raster):
    return segment.seeds(raster, STEP)


def _blurred(sigma: float) -> str:
    """SQL of the blur: one axis after the other, each mirrored at its ends."""
    reach = int(4 * sigma + 0.5)
    total = f"(SELECT sum(exp(-0.5 * pow(x / {sigma}, 2))) FROM (SELECT unnest(generate_series(-{reach}, {reach})) x))"
    kernel = f"kern AS (SELECT o, exp(-0.5 * pow(o / {sigma}, 2)) / {total} g FROM (SELECT unnest(generate_series(-{reach}, {reach})) o))"
    steps, last = [kernel, "size AS (SELECT h, w, (SELECT max(k) + 1 FROM bands) d FROM dim)"], "bands"
    for axis, n in (("k", "d"), ("i", "h"), ("j", "w")):
        at = f"a.{axis} + o"
        mirrored = f"CASE WHEN {at} < 0 THEN -1 - ({at}) WHEN {at} >= {n} THEN 2 * {n} - 1 - ({at}) ELSE {at} END"
        on = " AND ".join(f"b.{x} = " + (mirrored if x == axis else f"a.{x}") for x in "ijk")
        steps.append(f"blur_{axis} AS (SELECT a.p, a.i, a.j, a.k, sum(g * b.x) x FROM {last} a, kern, size JOIN {last} b ON {on} GROUP BY a.p, a.i, a.j, a.k)")
        last = f"blur_{axis}"
    return f"WITH {', '.join(steps)} SELECT p, k, round(x, 6) x FROM {last}"


@query("gaussian_blur_wide", _blurred(1.0))
def _(spark, raster):
    blurred = neighbourhood.blur(raster, 1.0)
    return blurred.select("p", F.posexplode("v").alias("k", "x")).select("p", "k", r6("x"))


@query(
    "gradient_wrapped",
    """WITH rm AS MATERIALIZED (SELECT p, i, j, v FROM raster), n AS MATERIALIZED (SELECT p, i, j, CASE WHEN i + 1 >= h THEN h - 2 ELSE i + 1 END dn,
    CASE WHEN i = 0 THEN h - 1 ELSE i - 1 END up, CASE WHEN j + 1 >= w THEN w - 2 ELSE j + 1 END rt, CASE WHEN j = 0 THEN w - 1 ELSE j - 1 END lf FROM raster, dim)
    SELECT n.p, round(sqrt(pow(list_distance(d.v, u.v), 2) + pow(list_distance(e.v, l.v), 2)), 6) g FROM n JOIN rm d ON d.i = n.dn AND d.j = n.j
    JOIN rm u ON u.i = n.up AND u.j = n.j JOIN rm e ON e.i = n.i AND e.j = n.rt JOIN rm l ON l.i = n.i AND l.j = n.lf""",
)
def _(spark, raster):
    return neighbourhood.gradient(raster, wrap=True).select("p", r6("g"))


@query("gradient", "SELECT p, round(g, 6) g FROM grad")
def _(spark, raster):
    return neighbourhood.gradient(raster).select("p", r6("g"))


@query(
    "seed_move",
    """SELECT c, i, j, round(g, 6) g FROM (SELECT s.c, g.i, g.j, g.g, row_number() OVER (PARTITION BY s.c ORDER BY g.g, CASE WHEN g.p = s.p THEN 0 ELSE 1 END, g.i, g.j) n
    FROM seeds s JOIN grad g ON abs(g.i - s.i) <= 1 AND abs(g.j - s.j) <= 1) WHERE n = 1""",
)
def _(spark, raster):
    return segment.move_seeds(segment.seeds(raster, STEP), neighbourhood.gradient(raster)).select("c", "i", "j", r6("g"))


@query("manifold_area", "SELECT p, round(area, 6) area FROM area")
def _(spark, raster):
    return neighbourhood.manifold_area(raster, COMPACT, STEP).select("p", r6("area"))


@query("search_range", "SELECT round(total, 6) total, round(lsr, 6) lsr FROM range_")
def _(spark, raster):
    return segment.search_range(neighbourhood.manifold_area(raster, COMPACT, STEP), segment.seeds(raster, STEP).count()).select(r6("total"), r6("lsr"))


def _scaled(raster):
    area = neighbourhood.manifold_area(raster, COMPACT, STEP)
    seed = segment.seeds(raster, STEP)
    lsr = segment.search_range(area, seed.count()).first()["lsr"]
    return segment.adaptive_scale(seed, area, STEP, lsr), lsr


@query("adaptive_scale", "SELECT c, i, j, round(box, 6) box, round(scale, 6) scale FROM scaled")
def _(spark, raster):
    return _scaled(raster)[0].select("c", "i", "j", r6("box"), r6("scale"))


@query(
    "split_clusters",
    """SELECT cast(base + child AS int) c, old, child, CASE WHEN f THEN CASE WHEN child < 2 THEN greatest(i - off, 0) ELSE least(i + off, h - 1) END ELSE i END i,
    CASE WHEN f THEN CASE WHEN child IN (0, 2) THEN least(j + off, w - 1) ELSE greatest(j - off, 0) END ELSE j END j,
    round(CASE WHEN f THEN lsr ELSE box END, 6) area, round(CASE WHEN f THEN scale / 2 ELSE scale END, 6) scale
    FROM (SELECT c old, i, j, box, scale, lsr, scale < m AND box > lsr / 4 f, c + coalesce(sum(CASE WHEN scale < m AND box > lsr / 4 THEN 3 ELSE 0 END)
    OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) base, cast(round_even(5 * scale / 2, 0) AS int) off
    FROM scaled, range_, (SELECT avg(scale) m FROM scaled)), dim, (VALUES (0), (1), (2), (3)) t(child) WHERE f OR child = 0""",
)
def _(spark, raster):
    scaled, lsr = _scaled(raster)
    h, w = neighbourhood.extent(raster)
    most = scaled.agg(F.avg("scale")).first()[0]  # splits about half of these, which hold no small scales
    parts = segment.split(scaled.withColumnRenamed("box", "area"), STEP, lsr, h, w, most)
    return parts.select("c", "old", "child", "i", "j", r6("area"), r6("scale"))


def _pixels(raster):
    """The bands stand in for a log-matrix too."""
    return raster.select("p", "i", "j", "v", F.col("v").alias("lcmr"))


def _assigned(raster):
    px = _pixels(raster)
    clusters = segment.seeds(raster, STEP).select("c", "p").join(px, "p").select("c", "i", "j", "v", "lcmr", F.lit(5 / 6).alias("scale"))
    return px, clusters, segment.assign(px, clusters, STEP, COMPACT)


@query("assign_nearest", "SELECT p, c, round(dist, 6) dist FROM assigned")
@query("assign_nearest_whole", "SELECT p, c, round(dist, 6) dist FROM assigned")
def _(spark, raster):
    return _assigned(raster)[2].select("p", "c", r6("dist"))


def _updated(raster):
    px, clusters, labels = _assigned(raster)
    area = neighbourhood.manifold_area(raster, COMPACT, STEP).select("p", "area")
    return clusters, segment.update(px.join(area, "p"), labels)


_UPDATED = """(SELECT c, cast(round(avg(r.i)) AS int) i, cast(round(avg(r.j)) AS int) j, count(*) n, sum(area) area FROM assigned JOIN raster r USING (p) JOIN area USING (p) GROUP BY c)"""
_UPDATE_SQL = f"""SELECT u.c, u.i, u.j, u.n, round(u.area, 6) area, list_transform(m.v, lambda x: round(x, 6)) v FROM {_UPDATED} u JOIN
    (SELECT c, list(x ORDER BY k) v FROM (SELECT c, k, avg(x) x FROM assigned JOIN bands USING (p) GROUP BY c, k) GROUP BY c) m USING (c)"""
_RESIDUAL_SQL = f"""SELECT round(sum(pow(u.i - s.i, 2) + pow(u.j - s.j, 2) + m.d + sqrt(m.d)), 6) err FROM {_UPDATED} u JOIN seeds s USING (c) JOIN
    (SELECT c, sum(pow(x - s.v[k + 1], 2)) d FROM (SELECT c, k, avg(x) x FROM assigned JOIN bands USING (p) GROUP BY c, k) JOIN seeds s USING (c) GROUP BY c) m USING (c)"""


@query("update_clusters", _UPDATE_SQL)
@query("update_clusters_whole", _UPDATE_SQL)
def _(spark, raster):
    return _updated(raster)[1].select("c", "i", "j", "n", r6("area"), V.rounded(F.col("v")).alias("v"))


@query("residual", _RESIDUAL_SQL)
@query("residual_whole", _RESIDUAL_SQL)
def _(spark, raster):
    return segment.residual(*_updated(raster)).select(r6("err"))


@query("cluster_lookup", "SELECT c, list_transform(v, lambda x: round(x, 6)) v FROM seeds")
def _(spark, raster):
    return segment.seeds(raster, STEP).select("c", "i", "j").join(raster.select("i", "j", "v"), ["i", "j"]).select("c", V.rounded(F.col("v")).alias("v"))


@query("split_remap", "SELECT p, cast(c + 3 * ((c + 2) // 3) AS int) c FROM assigned WHERE c IS NOT NULL")
def _(spark, raster):
    """Every third cluster, from the first on, is split."""
    _, clusters, labels = _assigned(raster)
    marked = clusters.select("c", "i", "j", F.lit(9.0).alias("area"), F.when(F.col("c") % 3 == 0, 0.1).otherwise(0.9).alias("scale"))
    return segment.remap(labels.select("p", "c"), segment.split(marked, STEP, 4.0, *neighbourhood.extent(raster)))


@query("compaction", "SELECT c, cast(row_number() OVER (ORDER BY c) - 1 AS int) AS new FROM seeds WHERE c % 3 <> 1")
def _(spark, raster):
    return segment.compact(segment.seeds(raster, STEP).withColumn("alive", F.col("c") % 3 != 1))


@query("region_adjacency", "SELECT src, dst FROM adj")
def _(spark, raster):
    return neighbourhood.adjacency(raster)


# -- features and labels --------------------------------------------------------------------------


def _mean(raster):
    return features.mean_feature(raster)


def _weighted(raster):
    mean = _mean(raster)
    return mean, features.weighted_feature(mean, features.neighbour_weights(mean, neighbourhood.adjacency(raster)))


@query("neighbour_weights", "SELECT src, dst, round(w, 6) w FROM nw")
def _(spark, raster):
    return features.neighbour_weights(_mean(raster), neighbourhood.adjacency(raster)).select("src", "dst", r6("w"))


@query("mean_feature", "SELECT sp, k, round(mu, 6) mu FROM mean")
def _(spark, raster):
    return _mean(raster).select("sp", "k", r6("mu"))


@query("weighted_feature", "SELECT sp, k, round(wmu, 6) wmu FROM wmean")
def _(spark, raster):
    return _weighted(raster)[1].select("sp", "k", r6("wmu"))


@query("centroid", "SELECT sp, round(ci, 6) ci, round(cj, 6) cj FROM cent")
def _(spark, raster):
    return features.centroids(raster).select("sp", r6("ci"), r6("cj"))


@query("class_counts", "SELECT sp, cls, n FROM counts")
def _(spark, raster):
    return features.class_counts(raster)


@query("majority_label", "SELECT sp, cls, n FROM major")
def _(spark, raster):
    return features.majority(features.class_counts(raster))


@query("purity", "SELECT sp, cast(sum(n) AS bigint) size, round(max(n) / sum(n), 6) purity FROM counts GROUP BY sp")
def _(spark, raster):
    return features.purity(features.class_counts(raster)).select("sp", "size", r6("purity"))


def _sample(raster):
    return features.stratified_sample(raster, SAMPLE, SEED)


@query("stratified_sample", "SELECT p, cls FROM sample")
def _(spark, raster):
    return _sample(raster)


@query("node_label_counts", "SELECT sp, cls, n FROM nodelab")
def _(spark, raster):
    return features.node_labels(raster, _sample(raster))


@query("node_label_probs", "SELECT sp, cls, round(n / sum(n) OVER (PARTITION BY sp), 6) prob FROM nodelab")
def _(spark, raster):
    return features.node_probabilities(features.node_labels(raster, _sample(raster))).select("sp", "cls", r6("prob"))


# -- graphs ---------------------------------------------------------------------------------------


@query("pairwise_feature", "SELECT a.sp s, b.sp t, round(sum((a.mu - b.mu) * (a.mu - b.mu)), 6) d2 FROM mean a JOIN mean b ON a.k = b.k AND a.sp <> b.sp GROUP BY a.sp, b.sp")
def _(spark, raster):
    return graph.pairwise(graph.packed(_mean(raster), "mu")).select("s", "t", r6("d2"))


@query("pairwise_centroid", "SELECT a.sp s, b.sp t, round(sqrt(pow(a.ci - b.ci, 2) + pow(a.cj - b.cj, 2)), 6) d FROM cent a JOIN cent b ON a.sp < b.sp")
def _(spark, raster):
    return graph.pairwise_centroids(features.centroids(raster)).select("s", "t", r6("d"))


def _nodes(raster):
    mean, weighted = _weighted(raster)
    return graph.packed(mean, "mu"), graph.packed(weighted, "wmu")


@query("affinity_all", "SELECT s, t, round(exp(-d / 4.0), 6) w FROM comb")
def _(spark, raster):
    return graph.affinity(graph.combined(*_nodes(raster), MIX), SIGMA).select("s", "t", r6("w"))


@query(
    "affinity_knn",
    """SELECT s, t, round(exp(-max(d) / 4.0), 6) w FROM (SELECT s, t, d FROM (SELECT *, rank() OVER (PARTITION BY s ORDER BY d) r FROM comb) WHERE r <= 6
    UNION ALL SELECT t, s, d FROM (SELECT *, rank() OVER (PARTITION BY s ORDER BY d) r FROM comb) WHERE r <= 6) GROUP BY s, t HAVING exp(-max(d) / 4.0) <> 1""",
)
def _(spark, raster):
    return graph.affinity_knn(graph.combined(*_nodes(raster), MIX, 6), SIGMA, 6).select("s", "t", r6("w"))


def _fcf(raster):
    raster = stored(raster, "raster")  # read by means, adjacency and centroids
    return graph.fcf_graph(*_nodes(raster), features.centroids(raster), SIGMA, SIGMA_L, MIX)


@query("fcf_graph", "SELECT s, t, round(w, 6) w FROM fcf")
def _(spark, raster):
    return _fcf(raster).select("s", "t", r6("w"))


@query(
    "fcf_m_graph",
    """SELECT s, t, round(max(w), 6) w FROM (SELECT s, t, exp(-d2 / 4.0) w FROM near UNION ALL SELECT t, s, exp(-d2 / 4.0) FROM near) GROUP BY s, t""".replace(
        "FROM near",
        """FROM (SELECT s, t, d2 FROM (SELECT s, t, d2, row_number() OVER (PARTITION BY s ORDER BY d2, t) r FROM (SELECT a.vec_id s, b.vec_id t,
        list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) d2
        FROM (SELECT vec_id, cast(embedding AS double[]) e FROM embeddings) a JOIN (SELECT vec_id, cast(embedding AS double[]) e FROM embeddings) b ON a.vec_id <> b.vec_id)) WHERE r <= 8)""",
    ),
    view=lambda embeddings: embeddings,
)
def _(spark, embeddings):
    return graph.fcf_m_graph(embeddings, SIGMA, 8).select("s", "t", r6("w"))


@query("degree", "SELECT s, round(deg, 6) deg FROM deg")
def _(spark, raster):
    return graph.degree(_fcf(raster)).select("s", r6("deg"))


@query("sym_normalize", "SELECT s, t, round(w, 6) w FROM norm")
def _(spark, raster):
    return graph.normalized(_fcf(raster)).select("s", "t", r6("w"))


def _labels(raster):
    return features.node_labels(raster, _sample(raster)).select(F.col("sp").alias("node"), "cls", F.col("n").alias("y"))


def _three(raster):
    return graph.propagate(graph.normalized(_fcf(raster)), _labels(raster), ALPHA, 3)


@query("lgc_k_steps", "SELECT node, cls, round(f, 6) f FROM f3")
def _(spark, raster):
    return _three(raster).select("node", "cls", r6("f"))


@query("lgc", "SELECT node, cls, round(f, 6) f FROM lf9")
def _(spark, raster):
    return graph.lgc(_fcf(raster), _labels(raster), 0.125).select("node", "cls", r6("f"))


@query("ls", "SELECT node, cls, round(f / (1 - 1 / 1.125), 6) f FROM lf9")
def _(spark, raster):
    return graph.label_solve(_fcf(raster), _labels(raster), ALPHA).select("node", "cls", r6("f"))


@query("classify_argmax", "SELECT node, cls FROM (SELECT node, cls, row_number() OVER (PARTITION BY node ORDER BY round(f, 9) DESC, cls) r FROM f3) WHERE r = 1")
def _(spark, raster):
    return graph.classify(_three(raster).withColumn("f", F.round("f", 9)))


@query("classify_prob", "SELECT node, cls, round(f / sum(f) OVER (PARTITION BY node), 6) prob FROM f3")
def _(spark, raster):
    return graph.class_probabilities(_three(raster)).select("node", "cls", r6("prob"))


# -- back to pixels -------------------------------------------------------------------------------


def _pred(raster):
    return evaluate.back_project(raster, features.majority(features.class_counts(raster)).select("sp", "cls"))


def _tested(raster):
    return evaluate.tested(_pred(raster), _sample(raster))


@query("produce_classification", "SELECT p, gt, pred FROM pred")
def _(spark, raster):
    return _pred(raster).select("p", "gt", "pred")


@query("test_pixels", "SELECT p, gt, pred FROM tested")
def _(spark, raster):
    return _tested(raster).select("p", "gt", "pred")


@query("mask_training", "SELECT p, CASE WHEN p IN (SELECT p FROM sample) THEN 0 ELSE gt END gt FROM raster")
def _(spark, raster):
    return evaluate.mask_sampled(raster, _sample(raster)).select("p", "gt")


@query(
    "accuracy_coverage",
    """SELECT o count_out, n count_in, round(hit / n, 6) accuracy, round(n / o, 6) coverage FROM (SELECT count(*) FILTER (gt <> 0) o, count(*) FILTER (gt <> 0 AND pred <> 0) n,
    count(*) FILTER (gt <> 0 AND pred <> 0 AND gt = pred) hit FROM pred)""",
)
def _(spark, raster):
    return evaluate.coverage(_pred(raster)).select("count_out", "count_in", r6("accuracy"), r6("coverage"))


@query(
    "spreading_accuracy",
    """SELECT n spread, round(hit / n, 6) accuracy, fp false_positive FROM (SELECT count(*) FILTER (gt <> 0 AND pred <> 0) n,
    count(*) FILTER (gt <> 0 AND pred <> 0 AND gt = pred) hit, count(*) FILTER (gt = 0 AND pred <> 0) fp FROM pred)""",
)
def _(spark, raster):
    return evaluate.spreading_accuracy(_pred(raster)).select("spread", r6("accuracy"), "false_positive")


@query("region_errors", "SELECT sp, count(*) FILTER (gt <> 0 AND gt <> pred) errors FROM pred GROUP BY sp")
def _(spark, raster):
    return evaluate.region_errors(_pred(raster))


@query("distinct_count", "SELECT cls AS value, count(*) n, min(sp) AS first FROM counts GROUP BY cls")
def _(spark, raster):
    return features.distinct_counts(features.class_counts(raster), "cls", F.col("sp")).withColumnRenamed("cls", "value")


@query("confusion", "SELECT pred, gt, n FROM conf")
def _(spark, raster):
    return evaluate.confusion(_tested(raster))


@query("overall_accuracy", "SELECT round(avg(CASE WHEN pred = gt THEN 1.0 ELSE 0.0 END), 6) oa FROM tested")
def _(spark, raster):
    return evaluate.overall_accuracy(_tested(raster)).select(r6("oa"))


@query(
    "kappa",
    """SELECT round((po - pe) / (1 - pe), 6) kappa FROM (SELECT (SELECT sum(n) FROM conf WHERE pred = gt) / (SELECT sum(n) FROM conf) po,
    (SELECT sum(a * b) FROM (SELECT pred c, sum(n) a FROM conf GROUP BY pred) JOIN (SELECT gt c, sum(n) b FROM conf GROUP BY gt) USING (c)) / pow((SELECT sum(n) FROM conf), 2) pe)""",
)
def _(spark, raster):
    return evaluate.kappa(evaluate.confusion(_tested(raster))).select(r6("kappa"))


@query("class_recall", "SELECT gt cls, round(avg(CASE WHEN pred = gt THEN 1.0 ELSE 0.0 END), 6) recall FROM tested GROUP BY gt")
def _(spark, raster):
    return evaluate.class_recall(_tested(raster)).select("cls", r6("recall"))


_RUNS = "(SELECT p % 3 run, gt, pred FROM tested)"


@query(
    "run_summary",
    f"""WITH m AS (SELECT run, 'oa' metric, NULL::int cls, avg(CASE WHEN pred = gt THEN 1.0 ELSE 0.0 END) v FROM {_RUNS} GROUP BY run UNION ALL
    SELECT run, 'recall', gt, avg(CASE WHEN pred = gt THEN 1.0 ELSE 0.0 END) FROM {_RUNS} GROUP BY run, gt),
    e AS (SELECT metric, cls, 100 * avg(v) mean_, 100 * stddev_pop(v) std_ FROM m GROUP BY metric, cls)
    SELECT CASE WHEN metric = 'recall' THEN 'recall_' || cls ELSE metric END metric, round(mean_, 6) AS mean, round(std_, 6) AS std FROM e
    UNION ALL SELECT 'aa', round(avg(mean_), 6), round(stddev_pop(mean_), 6) FROM e WHERE metric = 'recall'""",
)
def _(spark, raster):
    px = _tested(raster).withColumn("run", F.col("p") % 3)
    hit = F.avg((F.col("pred") == F.col("gt")).cast("double")).alias("value")
    oa = px.groupBy("run").agg(hit).select("run", F.lit("oa").alias("metric"), F.lit(None).cast("int").alias("cls"), "value")
    recall = px.groupBy("run", "gt").agg(hit).select("run", F.lit("recall").alias("metric"), F.col("gt").alias("cls"), "value")
    return evaluate.run_summary(oa.unionByName(recall)).select("metric", r6("mean"), r6("std"))


@query(
    "best_run",
    f"""SELECT run, round(v, 6) oa FROM (SELECT run, v, row_number() OVER (ORDER BY v DESC, run) n FROM
    (SELECT run, avg(CASE WHEN pred = gt THEN 1.0 ELSE 0.0 END) v FROM {_RUNS} GROUP BY run)) WHERE n = 1""",
)
def _(spark, raster):
    px = _tested(raster).withColumn("run", F.col("p") % 3)
    oa = px.groupBy("run").agg(F.avg((F.col("pred") == F.col("gt")).cast("double")).alias("value"))
    return evaluate.best_run(oa.withColumn("metric", F.lit("oa"))).select("run", r6("oa"))


# -- windows and pictures -------------------------------------------------------------------------


@query("window_topk_cosine", "SELECT p, cast(rank AS bigint) AS rank, cast(off AS int) off, q, round(cor, 6) cor FROM wtop")
def _(spark, raster):
    return neighbourhood.window_neighbours(raster, 3, 5).select("p", F.col("rank").cast("long").alias("rank"), "off", "q", r6("cor"))


_COVARIANCE = """u AS (SELECT p, k, (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) x FROM bands WINDOW w AS (PARTITION BY p)),
    s AS (SELECT t.p, t.rank, k, x FROM wtop t JOIN u ON u.p = t.q),
    c AS (SELECT a.p, a.k a, b.k b, covar_samp(a.x, b.x) c FROM s a JOIN s b ON a.p = b.p AND a.rank = b.rank GROUP BY a.p, a.k, b.k),
    r AS (SELECT p, a, b, round(c + CASE WHEN a = b THEN 0.001 * sum(CASE WHEN a = b THEN c ELSE 0 END) OVER (PARTITION BY p) ELSE 0 END, 6) c FROM c),
    z AS (SELECT p, a, b, CASE WHEN c = 0 THEN 0 ELSE c END c FROM r)"""


def _covariances(raster):
    """No zero has a sign."""
    cells = F.transform("c", lambda x: F.when(F.round(x, 6) == 0, 0.0).otherwise(F.round(x, 6))).alias("c")
    return neighbourhood.window_covariance(neighbourhood.window_neighbours(raster, 3, 5), raster).select("p", "a", cells)


@query("window_covariance", f"WITH {_COVARIANCE} SELECT p, a, list(c ORDER BY b) c FROM z GROUP BY p, a")
@query("window_covariance_whole", f"WITH {_COVARIANCE} SELECT p, a, list(c ORDER BY b) c FROM z GROUP BY p, a")
def _(spark, raster):
    """A matrix row a row."""
    return _covariances(raster)


@query("boundary_wrapped", "SELECT p, edge FROM wedge")
def _(spark, raster):
    return neighbourhood.boundary(raster, wrap=True)


@query("class_map_paviau", "SELECT i, j, q.r, q.g, q.b FROM (SELECT i, j, pred % 10 cls FROM pred) JOIN pal10 q USING (cls)")
def _(spark, raster):
    """Classes 1 to 9 and background, as in that scene."""
    return render.class_map(_pred(raster).withColumn("pred", F.col("pred") % 10), render.palette(spark, "PaviaU"))


@query("mean_color", "SELECT a.i, a.j, m.r, m.g, m.b FROM rgb a JOIN (SELECT sp, cast(floor(avg(r)) AS int) r, cast(floor(avg(g)) AS int) g, cast(floor(avg(b)) AS int) b FROM rgb GROUP BY sp) m USING (sp)")
def _(spark, raster):
    return render.mean_colours(render.stretch(raster, (19, 15, 12)))


@query("boundary", "SELECT i, j, CASE WHEN edge THEN 255 ELSE r END r, CASE WHEN edge THEN 0 ELSE g END g, CASE WHEN edge THEN 0 ELSE b END b FROM rgb JOIN edge USING (p)")
def _(spark, raster):
    return render.boundary_overlay(render.stretch(raster, (19, 15, 12)), neighbourhood.boundary(raster))


@query("class_map", "SELECT i, j, r, g, b FROM pred JOIN pal ON pal.cls = pred")
def _(spark, raster):
    return render.class_map(_pred(raster), render.palette(spark, "Salinas"))


@query("masked_class_map", "SELECT i, j, r, g, b FROM pred JOIN pal ON pal.cls = CASE WHEN gt = 0 THEN 0 ELSE pred END")
def _(spark, raster):
    return render.class_map(_pred(raster), render.palette(spark, "Salinas"), masked=True)


# -- what SQL can't express: tested against numpy in tests/ ---------------------------------------


@query("pca")
def _(spark, raster):
    return reduce.pca(raster, 0.7).select("p", "pc")


@query("mnf")
def _(spark, raster):
    return reduce.mnf(raster, 8).select("p", "mnf")


def _logs(raster):
    return lcmr.log_matrices(reduce.mnf(raster, 6), "mnf", 5, 15)


@query("lcmr_logm")
def _(spark, raster):
    return _logs(raster)


@query(
    "merge_clusters",
    """WITH RECURSIVE g AS (SELECT sp c, cast(round(avg(i)) AS int) i, cast(round(avg(j)) AS int) j, sum(area) area, 0.4 + sp % 10 / 10 scale FROM raster JOIN (SELECT p, area FROM area) USING (p) GROUP BY sp),
    gv AS (SELECT sp c, list(mu ORDER BY k) v FROM mean GROUP BY sp), cl AS MATERIALIZED (SELECT * FROM g JOIN gv USING (c)), lim AS (SELECT 11 * avg(area) lsr FROM cl),
    wish AS (SELECT a, n, cost FROM (SELECT a.c a, b.c n, CASE WHEN a.area < lsr / 32 THEN list_distance(a.v, b.v) WHEN (a.area + b.area) / (lsr / 5) < 1 THEN (a.area + b.area) / (lsr / 5) END cost
        FROM adj JOIN cl a ON a.c = src JOIN cl b ON b.c = dst, lim WHERE dst > src AND a.area < lsr / 5) WHERE cost IS NOT NULL),
    wl AS MATERIALIZED (SELECT row_number() OVER (ORDER BY a) k, a, list(n ORDER BY cost, n) near FROM wish GROUP BY a),
    m(k, taken, a, n) AS (SELECT 0::BIGINT, []::INT[], NULL::INT, NULL::INT UNION ALL SELECT k, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, a, pick FROM
        (SELECT w.k, taken, w.a, CASE WHEN list_contains(taken, w.a) THEN NULL ELSE list_filter(near, lambda x: NOT list_contains(taken, x))[1] END pick FROM m JOIN wl w ON w.k = m.k + 1)),
    pair AS MATERIALIZED (SELECT a, n FROM m WHERE n IS NOT NULL),
    f AS (SELECT x.*, y.i yi, y.j yj, y.area ya, y.scale ys, y.v yv FROM cl x LEFT JOIN pair ON a = x.c LEFT JOIN cl y ON y.c = pair.n WHERE x.c NOT IN (SELECT n FROM pair))
    SELECT c, CASE WHEN ya IS NULL THEN i ELSE cast(round_even((i * area + yi * ya) / (area + ya), 0) AS int) END i, CASE WHEN ya IS NULL THEN j ELSE cast(round_even((j * area + yj * ya) / (area + ya), 0) AS int) END j,
        round(area + coalesce(ya, 0), 6) area, round(CASE WHEN ya IS NULL THEN scale ELSE (scale * area + ys * ya) / (area + ya) END, 6) scale,
        CASE WHEN ya IS NULL THEN list_transform(v, lambda x: round(x, 6)) ELSE list_transform(list_zip(v, yv), lambda z: round((z[1] * area + z[2] * ya) / (area + ya), 6)) END v FROM f""",
)
def _(spark, raster):
    """Blocks as clusters of various scales, with a range at which many of them merge; in tiles of 10 pixels."""
    area = neighbourhood.manifold_area(raster, COMPACT, STEP).select("p", "area")
    blocks = segment.update(_pixels(raster).join(area, "p"), raster.select("p", F.col("sp").alias("c")))
    clusters = stored(blocks.withColumn("scale", 0.4 + F.col("c") % 10 / 10), "blocks")
    mean = clusters.agg(F.avg("area")).first()[0]
    merged = merging.merge(clusters, neighbourhood.adjacency(raster), 11 * mean, side=10)
    return merged.select("c", "i", "j", r6("area"), r6("scale"), V.rounded(F.col("v")).alias("v"))


@query(
    "connectivity",  # no region here is as large as the limit of a search
    """WITH RECURSIVE lab AS MATERIALIZED (SELECT p, i, j, (sp * 7 + p % 3) % 4 c FROM raster), dirs AS (SELECT * FROM (VALUES (0, 0, 1), (1, 0, -1), (2, 1, 0), (3, -1, 0)) t(o, a, b)),
    side AS MATERIALIZED (SELECT x.p, o, y.p q, x.c = y.c same FROM lab x, dirs JOIN lab y ON y.i = x.i + a AND y.j = x.j + b),
    reach AS (SELECT p, p r FROM lab UNION SELECT q, r FROM reach JOIN side USING (p) WHERE same),
    piece AS MATERIALIZED (SELECT p, min(r) piece FROM reach GROUP BY p), size AS MATERIALIZED (SELECT piece, count(*) n FROM piece GROUP BY piece),
    num AS MATERIALIZED (SELECT piece, row_number() OVER (ORDER BY piece) - 1 no FROM size WHERE n >= 8),
    walk AS (SELECT piece, piece p, '' AS path, [piece] seen FROM size WHERE n < 8 UNION ALL SELECT piece, q, path || o, list_append(seen, q) FROM walk JOIN side USING (p) WHERE same AND NOT list_contains(seen, q)),
    turn AS MATERIALIZED (SELECT piece, p, min((strlen(path), path)) t FROM walk GROUP BY piece, p),
    met AS (SELECT t.piece, b.piece AS other, row_number() OVER (PARTITION BY t.piece ORDER BY t.t DESC, o DESC) r FROM turn t JOIN side USING (p) JOIN piece b ON b.p = q WHERE b.piece < t.piece),
    joins AS MATERIALIZED (SELECT size.piece, other AS dest FROM size LEFT JOIN met ON met.piece = size.piece AND r = 1 WHERE n < 8),
    chain AS (SELECT piece, dest FROM joins UNION ALL SELECT c.piece, j.dest FROM chain c JOIN joins j ON j.piece = c.dest),
    fin AS (SELECT piece, no FROM num UNION ALL SELECT joins.piece, coalesce(max(no), 0) FROM joins LEFT JOIN chain USING (piece) LEFT JOIN num ON num.piece = chain.dest GROUP BY joins.piece)
    SELECT p, i, j, cast(no AS int) sp FROM lab JOIN piece USING (p) JOIN fin USING (piece)""",
)
def _(spark, raster):
    h, w = neighbourhood.extent(raster)
    scattered = raster.select("p", "i", "j", ((F.col("sp") * 7 + F.col("p") % 3) % 4).alias("c"))
    return segment.enforce_connectivity(scattered, h, w, 20)


@query("hms")
def _(spark, raster):
    pixels = reduce.pca(raster, 0.5).select("p", "i", "j", F.col("pc").alias("v")).join(_logs(raster), "p")
    return segment.segment(pixels, 20)


@query("graph_mbo", "SELECT node, cls FROM mb20 WHERE u = 1")
def _(spark, raster):
    return graph.graph_mbo(_fcf(raster), _labels(raster), 0.125)


@query(
    "label_spreading",
    """WITH best AS (SELECT sp, p, cast(k AS int) part FROM ls30 QUALIFY row_number() OVER (PARTITION BY p ORDER BY f DESC, k) = 1),
    fresh AS (SELECT sp, part, row_number() OVER (ORDER BY sp, first) n FROM (SELECT sp, part, min(p) AS first FROM best WHERE part > 1 GROUP BY sp, part))
    SELECT r.p, r.sp, coalesce(b.part, 0) part, cast(coalesce(f.n + (SELECT max(sp) FROM raster), r.sp) AS int) new
    FROM raster r LEFT JOIN best b ON b.p = r.p LEFT JOIN fresh f ON f.sp = b.sp AND f.part = b.part""",
)
def _(spark, raster):
    marked = raster.join(_sample(raster), "p", "left")
    return graph.label_spreading(marked.select("p", "sp", "v", "cls"), gamma=0.1)


@query("classify_blocks")
def _(spark, raster):
    return classify(raster, Config(labelled=SAMPLE, runs=2, sigma=SIGMA, sigma_l=SIGMA_L, mix=MIX))


@query("classify_raster")
def _(spark, raster):
    return run_pipeline(raster.drop("sp"), Config(superpixels=20, pca_variance=0.5, components=6, window=5, window_neighbours=15, labelled=SAMPLE, sigma=SIGMA, sigma_l=SIGMA_L, mix=MIX))
