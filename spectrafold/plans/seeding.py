"""Queries over seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import condition as C
from ..operators import neighborhood as N
from ..operators import rois as R
from ..operators import seeds as G
from ..operators import unmix as U
from ..tables import FIELD, PIXEL
from . import fixtures as fx
from .regions import BANDS_SQL, HITS_SQL
from .registry import query
from .sourcing import rnd
from .unmixing import NNLS2_SQL, SCORE_SQL

PICK_SQL = BANDS_SQL + """,
ub AS (SELECT DISTINCT component, channel FROM bandrows),
met AS (SELECT v.image_id, v.slice_id, v.y, v.x, component, max(v.value) AS m FROM vox v JOIN ub USING (channel) GROUP BY ALL),
c0 AS (SELECT *, row_number() OVER (ORDER BY m DESC, y, x) AS rn FROM met WHERE component = 0),
s0 AS (SELECT * FROM c0 WHERE rn <= 10),
r1 AS (SELECT * FROM met WHERE component = 1 AND (y, x) NOT IN (SELECT (y, x) FROM s0)),
s1 AS (SELECT * FROM r1 WHERE m > 0.5::DOUBLE * (SELECT max(m) FROM r1)),
c2 AS (SELECT *, row_number() OVER (ORDER BY m DESC, y, x) AS rn FROM met WHERE component = 2 AND (y, x) NOT IN (SELECT (y, x) FROM s0) AND (y, x) NOT IN (SELECT (y, x) FROM s1)),
s2p AS (SELECT * FROM c2 WHERE rn <= 5),
picked AS (SELECT image_id, slice_id, y, x, component, m FROM s0 UNION ALL SELECT image_id, slice_id, y, x, component, m FROM s1 UNION ALL SELECT image_id, slice_id, y, x, component, m FROM s2p)"""


def bands(spark, unique=True):
    return G.component_bands(fx.resonances(spark), fx.axis64(spark), unique)


@query("seed_pixels", "SELECT image_id, slice_id, y, x, component, round(m, 6) AS metric FROM picked", PICK_SQL)
def _(spark, sf):
    return G.seed_pixels(fx.pixels_emb(spark, sf), bands(spark)).select(*PIXEL, "component", rnd("metric", "metric"))


@query("seed_pixel_spectra", """
SELECT p.component, v.channel, round(avg(v.value), 6) AS value FROM picked p JOIN vox v USING (y, x) GROUP BY ALL""", PICK_SQL)
def _(spark, sf):
    p = fx.pixels_emb(spark, sf)
    out = G.seed_pixel_spectra(p, G.seed_pixels(p, bands(spark)), bands(spark))
    return out.select("component", F.posexplode("spectrum").alias("channel", "value")).withColumn("value", rnd("value"))


@query("seed_metric_score", """
SELECT image_id, slice_id, y, x, component, round(greatest((i - o) / (o + 1e-6), 0), 6) AS score FROM (
  SELECT v.image_id, v.slice_id, v.y, v.x, c.component, avg(v.value) FILTER (u.channel IS NOT NULL) AS i, coalesce(avg(v.value) FILTER (u.channel IS NULL), 0) AS o
  FROM vox v CROSS JOIN (SELECT DISTINCT component FROM ub) c LEFT JOIN ub u ON u.component = c.component AND u.channel = v.channel GROUP BY ALL)""", PICK_SQL)
def _(spark, sf):
    j = fx.pixels_emb(spark, sf).join(F.broadcast(bands(spark)), "image_id")
    return j.select(*PIXEL, "component", rnd(G.seed_metric(F.col("spectrum"), F.col("channels"), "score"), "score"))


@query("seed_pixels_topn_corpus", """
SELECT image_id, slice_id, y, x, CAST(value AS DOUBLE) AS metric FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id, slice_id ORDER BY value DESC, y, x) AS rn FROM (SELECT image_id, slice_id, y, x, max(value) AS value FROM ordvox WHERE channel IN (1, 3) GROUP BY ALL)) WHERE rn <= 40""")
def _(spark, sf):
    p = fx.pixels_ord(spark, sf)
    b = p.select("image_id").distinct().select(
        "image_id", F.lit(0).alias("component"), F.array(F.lit(1), F.lit(3)).alias("channels"), F.lit(40).alias("n_pixels"),
        F.lit(None).cast("double").alias("threshold"))
    return G.seed_pixels(p, b).select(*PIXEL, "metric")


@query("legacy_resonance_seeds", """
SELECT image_id, slice_id, y, x, component, round(m, 6) AS metric FROM l0 UNION ALL SELECT image_id, slice_id, y, x, component, round(m, 6) FROM r1 WHERE m > 0.6::DOUBLE * (SELECT max(m) FROM r1) OR m = (SELECT max(m) FROM r1)""", """
fr AS (SELECT v.image_id, v.slice_id, v.y, v.x, CASE v.channel WHEN 21 THEN 0 ELSE 1 END AS component, v.value AS m FROM vox v WHERE v.channel IN (21, 38)),
l0 AS (SELECT * FROM fr WHERE component = 0 AND (m > 0.6::DOUBLE * (SELECT max(m) FROM fr WHERE component = 0) OR m = (SELECT max(m) FROM fr WHERE component = 0))),
r1 AS (SELECT * FROM fr WHERE component = 1 AND (y, x) NOT IN (SELECT (y, x) FROM l0))""")
def _(spark, sf):
    res = fx.resonances(spark).filter("resonance_id < 2")
    return G.legacy_resonance_seeds(fx.pixels_emb(spark, sf), res, fx.axis64(spark), threshold=0.6).select(*PIXEL, "component", rnd("metric", "metric"))


@query("gaussian_model_spectra", """
SELECT component, channel, round(sum(CASE WHEN g = 0 THEN 2.220446049250313e-16 ELSE g END), 6) AS value FROM (
  SELECT component, channel, amp * exp(-((value - center) ** 2) / (2 * (width / sqrt(2 * ln(2.0::DOUBLE))) ** 2)) AS g
  FROM (SELECT CAST(s_suppkey % 5 AS INT) AS component, 2750 + 12.0::DOUBLE * s_nationkey AS center, 5.0::DOUBLE + s_suppkey % 7 AS width, s_acctbal AS amp FROM supplier), axis64) GROUP BY ALL""")
def _(spark, sf):
    res = fx.table(spark, sf, "supplier").select(
        F.lit("emb").alias("image_id"), (F.col("s_suppkey") % 5).cast("int").alias("component"),
        (2750 + F.lit(12.0) * F.col("s_nationkey")).alias("center"), (5.0 + F.col("s_suppkey") % 7).alias("width"),
        F.lit(True).alias("use_gaussian"), F.col("s_acctbal").alias("amplitude"))
    out = G.gaussian_model_spectra(res, fx.axis64(spark))
    return out.select("component", F.posexplode("spectrum").alias("channel", "value")).withColumn("value", rnd("value"))


def _long_w(df):
    return df.select(*PIXEL, F.posexplode("w").alias("component", "w")).withColumn("w", rnd("w"))


@query("w_seed_nnls", """
SELECT image_id, slice_id, y, x, CAST(c AS INT) AS component, round(greatest(w, 1e-8) / max(greatest(w, 1e-8)) OVER (PARTITION BY c), 6) AS w
FROM (SELECT image_id, slice_id, y, x, unnest([0, 1]) AS c, unnest([w0, w1]) AS w FROM w2)""", NNLS2_SQL)
def _(spark, sf):
    return _long_w(G.w_seed(fx.pixels_emb(spark, sf), fx.label_spectra(spark, sf, 2), 2, "nnls"))


@query("w_seed_selective_score", """
SELECT image_id, slice_id, y, x, component, round(w / max(w) OVER (PARTITION BY component), 6) AS w FROM score""", SCORE_SQL)
def _(spark, sf):
    return _long_w(G.w_seed(fx.pixels_emb(spark, sf), fx.label_spectra(spark, sf, 3), 3, "selective_score"))


@query("w_seed_modes", """
SELECT image_id, slice_id, y, x, CAST(component AS INT) AS component,
  round(greatest(hw, 1e-8) / max(greatest(hw, 1e-8)) OVER p, 6) AS h_weighted, round(greatest(av, 1e-8) / max(greatest(av, 1e-8)) OVER p, 6) AS average, 1.0::DOUBLE AS empty,
  round(greatest(pk, 1e-8) / max(greatest(pk, 1e-8)) OVER p, 6) AS peak
FROM (SELECT v.image_id, v.slice_id, v.y, v.x, h.component, sum(v.value * wt) / sum(wt) AS hw, avg(v.value) AS av, max(v.value) FILTER (v.channel = h.top) AS pk
 FROM vox v JOIN (SELECT component, channel, arg_max(channel, value) OVER p AS top, exp((value - min(value) OVER p) / (max(value) OVER p - min(value) OVER p)) - 1 AS wt FROM hk WHERE component < 3 WINDOW p AS (PARTITION BY component)) h USING (channel) GROUP BY ALL)
WINDOW p AS (PARTITION BY component)""")
def _(spark, sf):
    p, h = fx.pixels_emb(spark, sf), fx.label_spectra(spark, sf, 3)
    out = None
    for mode in ("h_weighted", "average", "empty", "peak"):
        one = _long_w(G.w_seed(p, h, 3, mode)).withColumnRenamed("w", mode)
        out = one if out is None else out.join(one, [*PIXEL, "component"])
    return out


@query("w_seed_downsampled", """
SELECT image_id, slice_id, y, x, round(w / max(w) OVER (), 6) AS w FROM (
SELECT image_id, slice_id, CAST(ty AS INT) AS y, CAST(tx AS INT) AS x, greatest(sum(value * (1 - abs(cy - y)) * (1 - abs(cx - x))), 1e-8) AS w FROM (
  SELECT co.image_id, co.slice_id, co.y, co.x, co.value, a.range AS ty, b.range AS tx, a.range * (sy - 1) / (ny - 1)::DOUBLE AS cy, b.range * (sx - 1) / (nx - 1)::DOUBLE AS cx
  FROM co JOIN sh USING (image_id), range(2000) a, range(25) b WHERE a.range < ny AND abs(a.range * (sy - 1) / (ny - 1)::DOUBLE - co.y) < 1 AND abs(b.range * (sx - 1) / (nx - 1)::DOUBLE - co.x) < 1) GROUP BY ALL)""", """
sh AS (SELECT image_id, ny, nx, ny // 4 AS sy, nx // 4 AS sx FROM meta),
cv AS (SELECT image_id, slice_id, CAST(y // 4 AS INT) AS y, CAST(x // 4 AS INT) AS x, channel, avg(value) AS value FROM vox JOIN meta USING (image_id) WHERE y < ny // 4 * 4 AND x < nx // 4 * 4 GROUP BY ALL),
co AS (SELECT image_id, slice_id, y, x, greatest(sum(cv.value * h.value) / (any_value(hh) + 1e-8), 1e-8) AS value FROM cv JOIN (SELECT channel, value, sum(value * value) OVER () AS hh FROM hk WHERE component = 0) h USING (channel) GROUP BY ALL)""")
def _(spark, sf):
    out = G.w_seed(fx.pixels_emb(spark, sf), fx.label_spectra(spark, sf, 1), 1, "nnls", downsample=4, whole=True)
    return out.select(*PIXEL, rnd(F.element_at("w", 1), "w"))


@query("w_seed_by_source", """
SELECT image_id, slice_id, y, x, CAST(component AS INT) AS component, round(w / max(w) OVER (PARTITION BY component), 6) AS w FROM (
 SELECT s.image_id, s.slice_id, s.y, s.x, h.component, greatest(sum(CASE WHEN h.component = 1 THEN s.value ELSE v.value END * h.wt) / sum(h.wt), 1e-8) AS w
 FROM subvox s JOIN vox v ON v.y = s.y AND v.x = s.x AND v.channel = s.channel JOIN (SELECT component, channel, exp((value - min(value) OVER p) / (max(value) OVER p - min(value) OVER p)) - 1 AS wt FROM hk WHERE component < 2 WINDOW p AS (PARTITION BY component)) h ON h.channel = s.channel GROUP BY ALL)""", HITS_SQL + """,
bg AS (SELECT channel, avg(value) AS b FROM hits WHERE roi_id = 2 GROUP BY ALL),
subvox AS (SELECT v.image_id, v.slice_id, v.y, v.x, v.channel, CASE WHEN v.value - b <= 0 THEN 2.220446049250313e-16 ELSE v.value - b END AS value FROM vox v JOIN bg USING (channel))""")
def _(spark, sf):
    p = fx.pixels_emb(spark, sf)
    p = C.subtract_background(p, R.roi_background(p, fx.rois(spark)))
    h = fx.label_spectra(spark, sf, 2)
    wants = h.select("image_id", "component", (F.col("component") == 1).alias("use_subtracted"))
    return _long_w(G.w_seed(p, h, 2, "h_weighted", use_subtracted=wants))


@query("topk_residual", """
SELECT image_id, slice_id, y, x, round(n, 6) AS strength FROM (SELECT *, row_number() OVER (PARTITION BY slice_id ORDER BY n DESC, y, x) AS rn FROM (
  SELECT v.image_id, v.slice_id, v.y, v.x, sqrt(sum(greatest(v.value - w * h.value, 0) ** 2)) AS n FROM vox4 v JOIN (SELECT channel, value FROM hk WHERE component = 0) h USING (channel)
  JOIN (SELECT slice_id, y, x, sum(v.value * h.value) / (any_value(hh) + 1e-8) AS w FROM vox4 v JOIN (SELECT channel, value, sum(value * value) OVER () AS hh FROM hk WHERE component = 0) h USING (channel) GROUP BY ALL) w
    ON w.slice_id = v.slice_id AND w.y = v.y AND w.x = v.x GROUP BY ALL)) WHERE rn <= 16""")
def _(spark, sf):
    from ..scale import top_n

    h = fx.label_spectra(spark, sf, 1)
    w = U.nnls_fixed_h(fx.pixels_emb4d(spark, sf), h, keep=["spectrum"])
    r = U.residual_of(U.reconstruct(w, h), positive=True).select(*PIXEL, F.sqrt(A.sum_squares("residual")).alias("n"))
    return top_n(r, FIELD, [F.desc("n"), F.asc("y"), F.asc("x")], 16, 16).select(*PIXEL, rnd("n", "strength"))


@query("residual_h_seed")
def _(spark, sf):
    out = G.residual_h_seed(fx.pixels_emb(spark, sf), fx.label_spectra(spark, sf, 3), 2)
    return out.select("image_id", "component", F.posexplode("spectrum").alias("channel", "value")).withColumn("value", rnd("value"))


@query("fill_missing_h")
def _(spark, sf):
    seeds = fx.label_spectra(spark, sf, 3).filter("component <> 1").withColumn("background", F.lit(False))
    out = G.fill_missing_h(fx.pixels_emb(spark, sf), seeds, 4)
    return out.select("image_id", "component", "background", rnd(A.total("spectrum"), "total"))


@query("assemble_seeds")
def _(spark, sf):
    p = fx.pixels_emb(spark, sf)
    p = C.subtract_background(p, R.roi_background(p, fx.rois(spark)))
    res = fx.resonances(spark).withColumn("component", F.col("component") + 2).filter("component < 4")
    _h, w = G.assemble_seeds(p, fx.axis64(spark), 4, rois=fx.rois(spark).filter("component < 2"), resonances=res)
    return w.select(*PIXEL, F.posexplode("w").alias("component", "w")).groupBy(*FIELD, "component").agg(
        rnd(F.min("w"), "low"), rnd(F.max("w"), "high"), rnd(F.avg("w"), "mean"))


@query("assemble_then_factorize")
def _(spark, sf):
    """The whole analysis: seeds from regions and resonances, seeded factorisation, fit report."""
    from ..operators.factorize import nmf_seeded

    p = fx.pixels_emb(spark, sf)
    h, w = G.assemble_seeds(p, fx.axis64(spark), 3, rois=fx.rois(spark), normalize_h=True)
    fit = nmf_seeded(w, h.select("image_id", "component", "spectrum"), 3, max_iter=10, track_error_every=5)
    return fit.report.select(*FIELD, "n_iter", rnd("final_error", "final_error"), rnd("relative_error", "relative_error"))


@query("fixed_w_mean", """
SELECT image_id, component, y, x, round(greatest(w, 1e-8) / max(greatest(w, 1e-8)) OVER (PARTITION BY image_id, component), 6) AS w FROM (
  SELECT image_id, component, y, x, (max(u) FILTER (map_id = 0) + coalesce(max(u) FILTER (map_id = 1), max(u) FILTER (map_id = 0))) / 2 AS w FROM (
    SELECT image_id, channel % 4 AS component, channel // 4 AS map_id, y, x, greatest(value, 1e-8) / max(greatest(value, 1e-8)) OVER (PARTITION BY image_id, channel) AS u FROM ordvox) GROUP BY ALL)""")
def _(spark, sf):
    m = fx.pixels_ord(spark, sf).select(*PIXEL, F.posexplode("spectrum").alias("channel", "w"))
    maps = m.select("image_id", (F.col("channel") % 4).alias("component"), F.expr("CAST(channel div 4 AS INT)").alias("map_id"), "y", "x", "w")
    return G.fixed_w_mean(maps).select("image_id", "component", "y", "x", rnd("w", "w"))


@query("background_component")
def _(spark, sf):
    p = fx.pixels_emb(spark, sf)
    w, h = G.background_component(p, N.field_shape(p), 3, sigma=1.0)
    return w.groupBy(*FIELD).agg(rnd(F.avg("w"), "mean_w"), rnd(F.max("w"), "max_w")).join(
        h.select(*FIELD, rnd(A.total("spectrum"), "h_total")), FIELD)


@query("multislice_fixed_h", """
SELECT image_id, slice_id, y, x, round(greatest(sum(v.value * h.value) / (any_value(hh) + 1e-8), 0), 6) AS w FROM vox4 v
JOIN (SELECT channel, value, sum(value * value) OVER () AS hh FROM hk WHERE component = 0) h USING (channel) GROUP BY ALL""")
def _(spark, sf):
    fit = G.multislice(fx.pixels_emb4d(spark, sf), 1, "fixed_h", spectra=fx.label_spectra(spark, sf, 1))
    return fit.abundance.select(*PIXEL, rnd(F.element_at("w", 1), "w"))


@query("multislice_hybrid")
def _(spark, sf):
    fit = G.multislice(fx.pixels_emb4d(spark, sf), 3, "hybrid", reference_slice=2, max_iter=10)
    return fit.report.select(*FIELD, "n_pixels", rnd("final_error", "final_error"), rnd("relative_error", "relative_error"))


@query("multislice_nmf")
def _(spark, sf):
    fit = G.multislice(fx.pixels_emb4d(spark, sf), 2, "nmf", max_iter=8, track_error_every=4)
    return fit.report.select(*FIELD, "n_iter", "n_pixels", rnd("relative_error", "relative_error"))


@query("promote_result", """
SELECT 'emb' AS image_id, 3 AS component, y, x, round(w1, 6) AS w FROM w2""", NNLS2_SQL)
def _(spark, sf):
    h = fx.label_spectra(spark, sf, 2)
    w = U.nnls_fixed_h(fx.pixels_emb(spark, sf), h)
    _h, maps = G.promote_result(h, w, 1, "both", target=3)
    return maps.withColumn("w", rnd("w"))
