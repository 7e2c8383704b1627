"""Queries over regions, statistics and pixel sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import axis as X
from ..operators import condition as C
from ..operators import rois as R
from ..operators import stats as S
from ..scale import join_dim
from ..tables import FIELD, PIXEL, to_voxels
from . import fixtures as fx
from .registry import query
from .sourcing import rnd

HITS_SQL = """
hits AS (
  SELECT v.image_id, v.slice_id, v.y, v.x, v.channel, v.value, r.roi_id, r.component, r.background, r.scale, r.off, r.sigma, r.name
  FROM vox v JOIN rois r ON r.image_id = v.image_id AND
    CASE WHEN r.shape = 'EllipseROI' THEN
      ((v.x + 0.5::DOUBLE - (r.x0 + r.w / 2)) / (r.w / 2)) ** 2 + ((v.y + 0.5::DOUBLE - (r.y0 + r.h / 2)) / (r.h / 2)) ** 2 <= 1
    ELSE v.x >= trunc(r.x0) AND v.x < trunc(r.x0 + r.w) AND v.y >= trunc(r.y0) AND v.y < trunc(r.y0 + r.h) END),
curves0 AS (
  SELECT image_id, slice_id, roi_id, component, background, name, channel, greatest(avg(value) + any_value(off), 0) * any_value(scale) AS value
  FROM hits GROUP BY ALL)"""


@query("pixels_in_roi", "SELECT image_id, roi_id, y, x FROM hits WHERE channel = 0", HITS_SQL)
def _(spark, sf):
    return R.pixels_in_roi(fx.pixels_emb(spark, sf), fx.rois(spark)).select("image_id", "roi_id", "y", "x")


@query("roi_pixel_copies", """
SELECT image_id, roi_id, y, x, round(spectrum[1], 6) AS v FROM (
  SELECT r.image_id, r.roi_id, CAST(least(greatest(ys.range, 0), m.ny - 1) AS INT) AS y, CAST(least(greatest(xs.range, 0), m.nx - 1) AS INT) AS x
  FROM rois r JOIN meta m USING (image_id), range(100) xs, range(100) ys
  WHERE r.shape = 'RectROI' AND xs.range >= trunc(r.x0) AND xs.range < trunc(r.x0 + r.w) AND ys.range >= trunc(r.y0) AND ys.range < trunc(r.y0 + r.h)) c
JOIN pix USING (image_id, y, x)""")
def _(spark, sf):
    p = fx.pixels_emb(spark, sf)
    copies = R.roi_pixel_copies(fx.image_meta(p), fx.rois(spark).filter("shape = 'RectROI'"))
    return p.join(copies, ["image_id", "y", "x"]).select("image_id", "roi_id", "y", "x", rnd(F.element_at("spectrum", 1), "v"))


@query("roi_mean_spectrum", "SELECT image_id, slice_id, roi_id, channel, round(value, 6) AS value FROM curves0", HITS_SQL)
def _(spark, sf):
    out = R.roi_mean_spectrum(fx.pixels_emb(spark, sf), fx.rois(spark), smooth=False)
    return out.select(*FIELD, "roi_id", "channel", rnd("value", "value"))


SMOOTH_SQL = HITS_SQL + """,
kern AS (SELECT CAST(r AS INT) AS r, exp(-0.5 * r * r) AS k FROM (SELECT unnest(range(-4, 5)) AS r)),
curves AS (
  SELECT c.image_id, c.slice_id, c.roi_id, c.component, c.background, c.name, c.channel,
    CASE WHEN any_value(r.sigma) > 0 THEN sum(s.value * k.k) / (SELECT sum(k) FROM kern) ELSE any_value(c.value) END AS value
  FROM curves0 c JOIN rois r ON r.roi_id = c.roi_id CROSS JOIN kern k
  JOIN curves0 s ON s.roi_id = c.roi_id AND s.channel = CASE WHEN c.channel + k.r < 0 THEN -1 - (c.channel + k.r) WHEN c.channel + k.r > 63 THEN 127 - (c.channel + k.r) ELSE c.channel + k.r END
  GROUP BY ALL)"""


@query("roi_mean_spectrum_smoothed", "SELECT image_id, slice_id, roi_id, channel, round(value, 6) AS value FROM curves", SMOOTH_SQL)
def _(spark, sf):
    out = R.roi_mean_spectrum(fx.pixels_emb(spark, sf), fx.rois(spark))
    return out.select(*FIELD, "roi_id", "channel", rnd("value", "value"))


@query("component_mean_spectra", """
SELECT c.image_id, c.slice_id, c.component, c.channel, round(avg(c.value), 6) AS value, any_value(l.background) AS background, any_value(l.name) AS name
FROM curves c JOIN (SELECT component, arg_max(background, roi_id) AS background, arg_max(name, roi_id) AS name FROM rois GROUP BY ALL) l USING (component) GROUP BY ALL""", SMOOTH_SQL)
def _(spark, sf):
    curves = R.roi_mean_spectrum(fx.pixels_emb(spark, sf), fx.rois(spark))
    out = R.component_mean_spectra(curves, fx.rois(spark))
    return out.select(*FIELD, "component", "channel", rnd("value", "value"), "background", "name")


SUB_SQL = HITS_SQL + """,
bg AS (SELECT channel, avg(value) AS b FROM hits WHERE roi_id = 2 GROUP BY ALL),
subvox AS (SELECT v.image_id, v.slice_id, v.y, v.x, v.channel, CASE WHEN v.value - b <= 0 THEN 2.220446049250313e-16 ELSE v.value - b END AS value
  FROM vox v JOIN bg USING (channel))"""


@query("subtract_background", "SELECT image_id, slice_id, y, x, channel, round(value, 6) AS value FROM subvox", SUB_SQL)
def _(spark, sf):
    p = fx.pixels_emb(spark, sf)
    out = C.subtract_background(p, R.roi_background(p, fx.rois(spark)))
    return out.select(*PIXEL, F.posexplode("spectrum_sub").alias("channel", "value")).withColumn("value", rnd("value"))


@query("line_profile", """
SELECT image_id, slice_id, roi_id, step, round(sum(w * value) / sum(w), 6) AS value FROM (
  SELECT s.step, s.roi_id, p.image_id, p.slice_id, p.spectrum[11] AS value, (CASE WHEN dy.range = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE WHEN dx.range = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) AS w
  FROM (SELECT 9 AS roi_id, CAST(range AS INT) AS step, 1.5::DOUBLE + range / 15::DOUBLE * 12 AS sx, 2.25::DOUBLE + range / 15::DOUBLE * 9 AS sy FROM range(16)) s, range(2) dy, range(2) dx, pix p
  WHERE p.y = floor(sy) + dy.range AND p.x = floor(sx) + dx.range) WHERE w > 0 GROUP BY ALL""")
def _(spark, sf):
    line = fx.rois(spark).limit(1).select("image_id", F.lit(9).alias("roi_id"), F.lit("LineROI").alias("shape"),
        F.lit(1.5).alias("x0"), F.lit(2.25).alias("y0"), F.lit(12.0).alias("w"), F.lit(9.0).alias("h"))
    out = R.line_profile(C.frame(fx.pixels_emb(spark, sf), 10), line)
    return out.select(*FIELD, "roi_id", "step", rnd("value", "value"))


@query("exclude_pixels", "SELECT image_id, y, x FROM pix EXCEPT SELECT image_id, y, x FROM hits WHERE background", HITS_SQL)
def _(spark, sf):
    p = fx.pixels_emb(spark, sf)
    taken = R.pixels_in_roi(p, fx.rois(spark).filter("background"))
    return R.exclude_pixels(p, taken).select("image_id", "y", "x")


@query("union_pixels", "SELECT DISTINCT image_id, y, x FROM hits WHERE component IN (0, 1)", HITS_SQL)
def _(spark, sf):
    p, r = fx.pixels_emb(spark, sf), fx.rois(spark)
    parts = [R.pixels_in_roi(p, r.filter(F.col("component") == c)) for c in (0, 1)]
    return R.union_pixels(*parts)


BOXES_SQL = """
boxes AS (SELECT 'b' || (l_orderkey // 64) AS image_id, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS box_id, CAST(l_partkey % 700 AS INT) AS y, CAST(l_orderkey % 900 AS INT) AS x,
  CAST(4 + l_quantity % 16 AS INT) AS h, CAST(4 + l_linenumber * 3 AS INT) AS w FROM lineitem)"""


@query("bbox_iou", """
SELECT image_id, a_id, b_id, round(inter / (ah * aw + bh * bw - inter), 6) AS iou FROM (
  SELECT a.image_id, a.box_id AS a_id, b.box_id AS b_id, a.h AS ah, a.w AS aw, b.h AS bh, b.w AS bw,
    CAST(greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS DOUBLE) * greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) AS inter
  FROM (SELECT DISTINCT * FROM boxes) a JOIN (SELECT DISTINCT * FROM boxes) b ON a.image_id = b.image_id AND a.box_id < b.box_id) WHERE inter / (ah * aw + bh * bw - inter) > 0.2::DOUBLE""", BOXES_SQL)
def _(spark, sf):
    boxes = fx.table(spark, sf, "lineitem").selectExpr(
        "concat('b', l_orderkey div 64) AS image_id", "l_orderkey * 8 + l_linenumber AS box_id", "CAST(l_partkey % 700 AS INT) AS y",
        "CAST(l_orderkey % 900 AS INT) AS x", "CAST(4 + l_quantity % 16 AS INT) AS h", "CAST(4 + l_linenumber * 3 AS INT) AS w").distinct()
    out = R.overlapping_boxes(boxes, 0.2)
    return out.withColumn("iou", rnd("iou"))


@query("rescale_rois", "SELECT roi_id, x0 * 2 AS x0, y0 * 2 AS y0, w * 2 AS w, h * 2 AS h, n FROM rois JOIN (SELECT roi_id, count(*) AS n FROM hits WHERE channel = 0 GROUP BY ALL) USING (roi_id)", HITS_SQL)
def _(spark, sf):
    n = R.pixels_in_roi(fx.pixels_emb(spark, sf), fx.rois(spark)).groupBy("roi_id").agg(F.count(F.lit(1)).alias("n"))
    return R.rescale_rois(fx.rois(spark), 4, 2).join(n, "roi_id").select("roi_id", "x0", "y0", "w", "h", "n")


AUDIT_SQL = """
used AS (SELECT DISTINCT 'o' || CAST(l_orderkey // 16 AS VARCHAR) AS image_id, CAST(l_suppkey % 9 + (l_orderkey // 16) % 3 AS INT) AS component FROM lineitem)"""


def _used(spark, sf):
    return fx.table(spark, sf, "lineitem").selectExpr(
        "concat('o', CAST(l_orderkey div 16 AS STRING)) AS image_id", "CAST(l_suppkey % 9 + (l_orderkey div 16) % 3 AS INT) AS component")


@query("audit_seeds", """
SELECT image_id, component, CASE WHEN u THEN 'beyond' ELSE 'missing' END AS status FROM (
 (SELECT i.image_id, CAST(c.range AS INT) AS component, false AS u FROM (SELECT DISTINCT image_id FROM used) i, range(1, 11) c
  WHERE NOT EXISTS (SELECT 1 FROM used d WHERE d.image_id = i.image_id AND d.component + 1 = c.range))
 UNION ALL SELECT image_id, component + 1, true FROM used WHERE component + 1 > 10)""", AUDIT_SQL)
def _(spark, sf):
    u = _used(spark, sf)
    even, odd = u.filter("component % 2 = 0"), u.filter("component % 2 = 1")
    return R.audit_seeds(even, odd, 10)


@query("next_free_component", """
SELECT image_id, CAST(min(c) AS INT) AS component FROM (SELECT i.image_id, c.range AS c FROM (SELECT DISTINCT image_id FROM used) i, range(0, 9) c
WHERE c.range = 8 OR NOT EXISTS (SELECT 1 FROM used d WHERE d.image_id = i.image_id AND d.component = c.range)) GROUP BY ALL""", AUDIT_SQL)
def _(spark, sf):
    return R.next_free_component(_used(spark, sf), 8)


@query("project_spectral", """
SELECT image_id, slice_id, y, x, round(avg(value), 6) AS avg, max(value) AS max, min(value) AS min FROM ordvox GROUP BY ALL""")
def _(spark, sf):
    p = fx.pixels_ord(spark, sf)
    return p.select(*PIXEL, rnd(A.mean("spectrum"), "avg"), F.array_max("spectrum").alias("max"), F.array_min("spectrum").alias("min"))


@query("spatial_bin", """
SELECT v.image_id, slice_id, CAST(y // 3 AS INT) AS y, CAST(x // 3 AS INT) AS x, channel, round(avg(value), 6) AS value FROM ordvox v
JOIN (SELECT image_id, max(y) + 1 AS ny, max(x) + 1 AS nx FROM ordpix0 GROUP BY ALL) m ON m.image_id = v.image_id
WHERE y < ny // 3 * 3 AND x < nx // 3 * 3 GROUP BY ALL""")
def _(spark, sf):
    p = fx.pixels_ord(spark, sf)
    out = S.spatial_bin_wide(p, 3, 7, fx.image_meta(p))
    return out.select(*PIXEL, F.posexplode("spectrum").alias("channel", "value")).withColumn("value", rnd("value"))


@query("spatial_bin_long", """
SELECT image_id, slice_id, CAST(y // 4 AS INT) AS y, CAST(x // 4 AS INT) AS x, channel, round(avg(value), 6) AS value FROM livox GROUP BY ALL""")
def _(spark, sf):
    return S.spatial_bin(fx.voxels_li(spark, sf), 4, crop=False).withColumn("value", rnd("value"))


@query("channel_stats", """
SELECT image_id, slice_id, channel, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(var_pop(value), 6) AS variance, min(value) AS low, max(value) AS high FROM ordvox GROUP BY ALL""")
def _(spark, sf):
    out = S.channel_stats(to_voxels(fx.pixels_ord(spark, sf)))
    return out.select(*FIELD, "channel", rnd("mean", "mean"), rnd("std", "std"), rnd("variance", "variance"), "low", "high")


@query("channel_covariance", """
SELECT a.image_id, a.slice_id, a.channel AS channel_a, b.channel AS channel_b, round(covar_pop(a.value, b.value), 6) AS covariance
FROM ordvox a JOIN ordvox b ON a.image_id = b.image_id AND a.y = b.y AND a.x = b.x AND a.channel <= b.channel GROUP BY ALL""")
def _(spark, sf):
    return S.channel_covariance(fx.pixels_ord(spark, sf)).withColumn("covariance", rnd("covariance"))


@query("weighted_mean_spectrum", """
SELECT image_id, slice_id, channel, round(sum(value * (y + 1)) / sum(y + 1), 6) AS value FROM ordvox GROUP BY ALL""")
def _(spark, sf):
    return S.weighted_mean_spectrum(to_voxels(fx.pixels_ord(spark, sf)).withColumn("w", F.col("y") + 1)).withColumn("value", rnd("value"))


BANDS_SQL = """
bandrows AS (SELECT resonance_id, component, unnest(CASE WHEN len(hit) > 0 THEN hit ELSE [near] END) AS channel FROM
  (SELECT resonance_id, component, coalesce(list(a.channel) FILTER (a.value BETWEEN center - width AND center + width), []) AS hit,
     arg_min(a.channel, struct_pack(d := abs(a.value - center), c := a.channel)) AS near
   FROM resonances r JOIN axis64 a USING (image_id) GROUP BY ALL))"""


def bands(spark, unique=False):
    rows = X.resonance_channels(fx.resonances(spark), fx.axis64(spark))
    pick = F.collect_set if unique else F.collect_list
    return rows.groupBy("image_id", "component").agg(F.sort_array(pick("channel")).alias("channels"))


@query("band_mean_map", """
SELECT image_id, slice_id, y, x, component, round(CASE WHEN m <= 1e-8 THEN 1e-8 ELSE greatest(v, 1e-8) / m END, 6) AS w FROM (
  SELECT *, max(greatest(v, 1e-8)) OVER (PARTITION BY component) AS m FROM (
  SELECT image_id, slice_id, y, x, component, avg(value) AS v FROM vox JOIN bandrows USING (channel) GROUP BY ALL))""", BANDS_SQL)
def _(spark, sf):
    out = C.unity_scale(S.band_mean_map(fx.pixels_emb(spark, sf), bands(spark)))
    return out.select(*PIXEL, "component", rnd("w", "w"))


@query("h_weighted_map", """
SELECT v.image_id, v.slice_id, v.y, v.x, h.component, round(sum(v.value * wt) / sum(wt), 6) AS w FROM vox v JOIN (
  SELECT component, channel, exp((value - min(value) OVER p) / (max(value) OVER p - min(value) OVER p)) - 1 AS wt FROM hk WHERE component < 3 WINDOW p AS (PARTITION BY component)) h USING (channel) GROUP BY ALL""")
def _(spark, sf):
    out = S.h_weighted_map(fx.pixels_emb(spark, sf), fx.label_spectra(spark, sf, 3))
    return out.select(*PIXEL, "component", rnd("w", "w"))


@query("percentiles", """
SELECT image_id, round(quantile_cont(v, 0.995), 6) AS p995, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.05), 6) AS p05
FROM (SELECT image_id, y, x, sum(value) AS v FROM ordvox GROUP BY ALL) GROUP BY ALL""")
def _(spark, sf):
    p = fx.pixels_ord(spark, sf).select(*PIXEL, A.total("spectrum").alias("v"))
    out = S.percentiles(p, ["image_id"], "v", [0.995, 0.75, 0.1, 0.05], ["p995", "p75", "p10", "p05"])
    return out.select("image_id", *[rnd(c, c) for c in ("p995", "p75", "p10", "p05")])


@query("gram", """
SELECT 'WtW' AS part, a.label AS i, b.label AS j, round(sum(a.w * b.w), 6) AS value FROM (SELECT y, x, channel AS label, value AS w FROM vox WHERE channel < 4) a JOIN (SELECT y, x, channel AS label, value AS w FROM vox WHERE channel < 4) b USING (y, x) GROUP BY ALL
UNION ALL SELECT 'WtX', a.channel, b.channel, round(sum(a.value * b.value), 6) FROM (SELECT * FROM vox WHERE channel < 4) a JOIN vox b USING (y, x) GROUP BY ALL""")
def _(spark, sf):
    p = fx.pixels_emb(spark, sf).withColumn("w", F.slice("spectrum", 1, 4))
    wtw, wtx = S.gram(p)
    a = wtw.select(F.lit("WtW").alias("part"), "i", "j", rnd("value", "value"))
    return a.unionByName(wtx.select(F.lit("WtX").alias("part"), "i", F.col("channel").alias("j"), rnd("value", "value")))


@query("sigma_clip", """
SELECT e.image_id, e.slice_id, e.y, e.x, e.channel, round(CASE WHEN abs(e.value - m) > 2 * s THEN NULL ELSE e.value END, 6) AS value
FROM evvox e JOIN (SELECT image_id, channel, avg(value) AS m, stddev_pop(value) AS s FROM evvox GROUP BY ALL) t USING (image_id, channel)""")
def _(spark, sf):
    out = S.sigma_clip(fx.voxels_ev(spark, sf), ["image_id", "channel"], ["value"])
    return out.select(*PIXEL, "channel", rnd("value", "value"))


@query("intensity_match_factor", """
SELECT image_id, channel, round(CASE WHEN abs(i) > 1e-8 THEN least(greatest(e / i, 0.1), 10) ELSE 1 END, 6) AS factor FROM (
SELECT image_id, channel, avg(value) AS e, avg(CASE WHEN channel = 3 THEN 0 WHEN channel = 4 THEN value * 100 ELSE value * 1.7::DOUBLE + x END) AS i FROM ordvox GROUP BY ALL)""")
def _(spark, sf):
    v = to_voxels(fx.pixels_ord(spark, sf)).withColumn("existing", F.col("value")).withColumn(
        "incoming", F.when(F.col("channel") == 3, 0.0).when(F.col("channel") == 4, F.col("value") * 100).otherwise(F.col("value") * 1.7 + F.col("x")))
    return S.intensity_match_factor(v, ["image_id"]).withColumn("factor", rnd("factor"))


PROFILE_SQL = """
fld AS (SELECT image_id, slice_id, y, x, avg(value) AS v FROM ordvox GROUP BY ALL),
prof AS (SELECT image_id, slice_id, 'x' AS axis, x AS pos, avg(v) AS value FROM fld GROUP BY ALL UNION ALL SELECT image_id, slice_id, 'y', y, avg(v) FROM fld GROUP BY ALL)"""


@query("axis_profiles", "SELECT image_id, slice_id, axis, pos, round(value, 6) AS value FROM prof", PROFILE_SQL)
def _(spark, sf):
    return S.axis_profiles(S.project_spectral(fx.pixels_ord(spark, sf))).withColumn("value", rnd("value"))


@query("profile_moments", """
SELECT p.image_id, p.slice_id, p.axis, round(any_value(b), 6) AS baseline, any_value(pk) AS peak,
  round(sqrt(sum(greatest(value - b, 0) * (pos - pk) * (pos - pk)) / sum(greatest(value - b, 0))), 6) AS sigma
FROM prof p JOIN (SELECT image_id, axis, quantile_cont(value, 0.05) AS b, arg_max(pos, struct_pack(v := round(value, 9), p := -pos)) AS pk FROM prof GROUP BY ALL) t ON t.image_id = p.image_id AND t.axis = p.axis GROUP BY ALL""", PROFILE_SQL)
def _(spark, sf):
    prof = S.axis_profiles(S.project_spectral(fx.pixels_ord(spark, sf)))
    out = S.profile_moments(prof)
    return out.select(*FIELD, "axis", rnd("baseline", "baseline"), "peak", rnd("sigma", "sigma"))


@query("reference_h_scale", """
SELECT 'emb' AS image_id, round((SELECT median(m) FROM (SELECT component, avg(value) AS m FROM hk WHERE component <> 2 GROUP BY ALL)), 6) AS scale, round((SELECT avg(value) FROM vox), 6) AS fallback""")
def _(spark, sf):
    p = fx.pixels_emb(spark, sf)
    seeds = fx.label_spectra(spark, sf)
    a = S.reference_h_scale(seeds, p, exclude=2)
    b = S.reference_h_scale(seeds.filter("component < 0"), p).withColumnRenamed("scale", "fallback")
    return a.join(b, "image_id").select("image_id", rnd("scale", "scale"), rnd("fallback", "fallback"))


@query("top3_mean_response", """
SELECT image_id, slice_id, y, x, round(list_avg(list_reverse_sort(list(value))[1:3]), 6) AS value FROM ordvox GROUP BY ALL""")
def _(spark, sf):
    return S.top3_mean_response(to_voxels(fx.pixels_ord(spark, sf))).withColumn("value", rnd("value"))


@query("outside_channels", """
SELECT image_id, slice_id, y, x, component, round(avg(value), 6) AS outside FROM vox v JOIN (
  SELECT c.component, CAST(a.range AS INT) AS channel FROM (SELECT DISTINCT component FROM bandrows) c, range(64) a WHERE NOT EXISTS (SELECT 1 FROM bandrows b WHERE b.component = c.component AND b.channel = a.range)) o USING (channel) GROUP BY ALL""", BANDS_SQL)
def _(spark, sf):
    b = bands(spark, unique=True).withColumn("channels", F.array_except(F.sequence(F.lit(0), F.lit(63)), "channels"))
    return S.band_mean_map(fx.pixels_emb(spark, sf), b).select(*PIXEL, "component", rnd("w", "outside"))


@query("unique_channels", "SELECT component, channel, round(avg(value), 6) AS value FROM (SELECT DISTINCT component, channel FROM bandrows) JOIN vox USING (channel) GROUP BY ALL", BANDS_SQL)
def _(spark, sf):
    u = bands(spark, unique=True).select("component", F.explode("channels").alias("channel"))
    return join_dim(to_voxels(fx.pixels_emb(spark, sf)), u, ["channel"]).groupBy("component", "channel").agg(rnd(F.avg("value"), "value"))
