"""Queries over intensity conditioning, seed flags and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import condition as C
from ..operators import stats as S
from ..scale import join_dim
from ..tables import PIXEL, to_voxels
from . import fixtures as fx
from .registry import query
from .sourcing import rnd

KEYS = "image_id, slice_id, y, x"

# The dirty corpus: NaN, infinities and negatives written into the order images by position.
DIRTY_SQL = """
dirty AS (
  SELECT image_id, slice_id, y, x, channel,
    CASE WHEN (x + channel) % 13 = 0 THEN 'NaN'::DOUBLE WHEN (y + channel) % 17 = 0 THEN 'Infinity'::DOUBLE
         WHEN (x + y) % 19 = 0 THEN '-Infinity'::DOUBLE WHEN (x * 3 + y) % 11 = 0 THEN -value ELSE value + 0.25::DOUBLE END AS value
  FROM ordvox)"""


def dirty_pixels(spark, sf):
    make = lambda v, c: (
        F.when((F.col("x") + c) % 13 == 0, F.lit(float("nan"))).when((F.col("y") + c) % 17 == 0, F.lit(float("inf")))
        .when((F.col("x") + F.col("y")) % 19 == 0, F.lit(float("-inf")))
        .when((F.col("x") * 3 + F.col("y")) % 11 == 0, -v).otherwise(v + 0.25)
    )
    return fx.pixels_ord(spark, sf).withColumn("spectrum", F.transform("spectrum", make))


def long(pixels, name="value"):
    return pixels.select(*PIXEL, F.posexplode("spectrum").alias("channel", name))


@query("to_uint16_float", """
SELECT d.image_id, slice_id, y, x, channel, CAST(trunc(CASE WHEN isnan(value) OR value = '-Infinity'::DOUBLE THEN 0
   WHEN value = 'Infinity'::DOUBLE THEN hi - lo ELSE value - lo END * (65535::DOUBLE / (hi - lo))) AS INT) AS value
FROM dirty d JOIN (SELECT image_id, least(min(value), 0) AS lo, max(value) AS hi FROM dirty WHERE isfinite(value) GROUP BY ALL) s ON d.image_id = s.image_id""", DIRTY_SQL)
def _(spark, sf):
    return long(C.to_uint16(dirty_pixels(spark, sf), is_float=True))


@query("to_uint16_int", """
SELECT v.image_id, slice_id, y, x, channel, CAST(trunc((value * 5000 - 3) * 1.0 + 3) AS INT) AS value
FROM (SELECT image_id, slice_id, y, x, channel, value, max(value) OVER (PARTITION BY image_id) AS hi FROM ordvox) v WHERE hi * 5000 <= 65535
UNION ALL SELECT image_id, slice_id, y, x, channel, CAST(trunc(value * 5000 * (65535::DOUBLE / (hi * 5000))) AS INT)
FROM (SELECT image_id, slice_id, y, x, channel, value, max(value) OVER (PARTITION BY image_id) AS hi FROM ordvox) v WHERE hi * 5000 > 65535""")
def _(spark, sf):
    p = fx.pixels_ord(spark, sf).withColumn("spectrum", F.transform("spectrum", lambda v: v * 5000 - 3))
    return long(C.to_uint16(p, is_float=False))


@query("nan_to_zero", "SELECT image_id, slice_id, y, x, channel, CASE WHEN isfinite(value) THEN value ELSE 0 END AS value FROM dirty", DIRTY_SQL)
def _(spark, sf):
    return long(C.nan_to_zero(dirty_pixels(spark, sf)))


@query("clamp_nonneg", "SELECT image_id, slice_id, y, x, channel, CASE WHEN isfinite(value) THEN greatest(value, 0) ELSE 0 END AS value FROM dirty", DIRTY_SQL)
def _(spark, sf):
    return long(C.clamp_nonneg(dirty_pixels(spark, sf)))


@query("normalize_dynamic_range", """
SELECT image_id, slice_id, y, x, channel, round(value * (65535::DOUBLE / max(value) OVER (PARTITION BY image_id)), 6) AS value FROM ordvox""")
def _(spark, sf):
    return long(C.normalize_dynamic_range(fx.pixels_ord(spark, sf))).withColumn("value", rnd("value"))


@query("standardize_channels", """
SELECT image_id, slice_id, y, x, channel, round((v.value - m) / s, 6) AS value FROM odd v
JOIN (SELECT image_id, slice_id, channel, avg(value) FILTER (NOT isnan(value)) AS m, stddev_pop(value) FILTER (NOT isnan(value)) AS s, bool_or(isnan(value)) AS bad FROM odd GROUP BY ALL) t
USING (image_id, slice_id, channel) WHERE NOT bad AND s > 0""", """
odd AS (SELECT image_id, slice_id, y, x, channel, CASE WHEN channel = 2 THEN 4 WHEN channel = 5 AND x = 7 THEN 'NaN'::DOUBLE ELSE value END AS value FROM ordvox)""")
def _(spark, sf):
    v = to_voxels(fx.pixels_ord(spark, sf)).withColumn(
        "value", F.when(F.col("channel") == 2, 4.0).when((F.col("channel") == 5) & (F.col("x") == 7), F.lit(float("nan"))).otherwise(F.col("value")))
    return C.standardize_channels(v).select(*PIXEL, "channel", rnd("value", "value"))


@query("drop_nan_channels", """
SELECT image_id, slice_id, channel, round(s, 6) AS std FROM (
SELECT image_id, slice_id, channel, stddev_pop(value) FILTER (NOT isnan(value)) AS s, bool_or(isnan(value)) AS bad FROM odd GROUP BY ALL) WHERE NOT bad AND s > 0""", """
odd AS (SELECT image_id, slice_id, y, x, channel, CASE WHEN channel = 2 THEN 4 WHEN channel = 5 AND x = 7 THEN 'NaN'::DOUBLE ELSE value END AS value FROM ordvox)""")
def _(spark, sf):
    v = to_voxels(fx.pixels_ord(spark, sf)).withColumn(
        "value", F.when(F.col("channel") == 2, 4.0).when((F.col("channel") == 5) & (F.col("x") == 7), F.lit(float("nan"))).otherwise(F.col("value")))
    return C.kept_channels(C.channel_moments(v)).select("image_id", "slice_id", "channel", rnd("std", "std"))


@query("scale_map_to_unity", """
SELECT image_id, slice_id, y, x, channel AS component, round(CASE WHEN m <= 1e-8 THEN 1e-8 ELSE greatest(value, 1e-8) / m END, 6) AS w
FROM (SELECT *, max(greatest(value, 1e-8)) OVER (PARTITION BY image_id, slice_id, channel) AS m FROM ordvox)""")
def _(spark, sf):
    maps = long(fx.pixels_ord(spark, sf), "w").withColumnRenamed("channel", "component")
    return C.unity_scale(maps).select(*PIXEL, "component", rnd("w", "w"))


@query("scale_h_to_unity", """
SELECT component, channel, round(value / f, 6) AS value, round(f, 6) AS scale_factor
FROM (SELECT *, CASE WHEN max(value) OVER (PARTITION BY component) > 1e-8 THEN max(value) OVER (PARTITION BY component) ELSE 1 END AS f FROM hk)""")
def _(spark, sf):
    out = C.scale_h_to_unity(fx.label_spectra(spark, sf))
    return out.select("component", rnd("scale_factor", "scale_factor"), F.posexplode("spectrum").alias("channel", "value")).withColumn("value", rnd("value"))


RAWH_SQL = """rawh AS (SELECT CAST(label AS INT) AS component, channel, avg(raw) AS value FROM vox GROUP BY ALL)"""


def raw_label_spectra(spark, sf):
    raw = fx.pixels_emb(spark, sf, clamp=False).withColumn("component", F.col("label").cast("int"))
    return S.mean_spectrum(raw, ["image_id", "component"])


@query("prepare_fixed_h", """
SELECT component, channel, round(greatest(value - least(min(value) OVER (PARTITION BY component), 0), 0), 6) AS value FROM rawh""", RAWH_SQL)
def _(spark, sf):
    out = C.prepare_fixed_h(raw_label_spectra(spark, sf))
    return out.select("component", F.posexplode("spectrum").alias("channel", "value")).withColumn("value", rnd("value"))


@query("has_seed_signal", """
SELECT image_id, slice_id, y, x, bool_or(isfinite(value) AND abs(value) > 20) AS signal FROM dirty GROUP BY ALL""", DIRTY_SQL)
def _(spark, sf):
    return dirty_pixels(spark, sf).select(*PIXEL, A.has_signal("spectrum", 20.0).alias("signal"))


@query("column_seeded", """
SELECT image_id, channel AS component, bool_and(v >= 0) AND bool_or(v > 0) AS seeded
FROM (SELECT image_id, channel, CASE WHEN channel = 1 AND x = 3 THEN -1 WHEN channel = 4 THEN 0 ELSE value END AS v FROM ordvox) GROUP BY ALL""")
def _(spark, sf):
    maps = long(fx.pixels_ord(spark, sf), "w").withColumnRenamed("channel", "component").withColumn(
        "w", F.when((F.col("component") == 1) & (F.col("x") == 3), -1.0).when(F.col("component") == 4, 0.0).otherwise(F.col("w")))
    return C.column_seeded(maps)


@query("has_complete_seed_set", """
SELECT 'emb' AS image_id, count(DISTINCT label) FILTER (label < 10 AND label <> 4) = 9 AS nine, count(DISTINCT label) FILTER (label < 3) = 3 AS three FROM embeddings""")
def _(spark, sf):
    seeds = fx.label_spectra(spark, sf)
    hole = seeds.withColumn("spectrum", F.when(F.col("component") == 9, F.transform("spectrum", lambda v: F.lit(0.0))).otherwise(F.col("spectrum")))
    nine = C.has_complete_seed_set(hole, 9).withColumnRenamed("complete", "nine")
    return nine.join(C.has_complete_seed_set(hole, 3).withColumnRenamed("complete", "three"), "image_id")


@query("active_pixels", """
SELECT image_id, count(*) FILTER (m > 30) AS active, count(*) FILTER (NOT m > 30) AS idle FROM (SELECT image_id, y, x, max(value) AS m FROM ordvox GROUP BY ALL) GROUP BY ALL""")
def _(spark, sf):
    on, off = C.split_active(fx.pixels_ord(spark, sf), 30.0)
    a = on.select("image_id", F.lit(1).alias("a"), F.lit(0).alias("i"))
    return a.unionByName(off.select("image_id", F.lit(0).alias("a"), F.lit(1).alias("i"))).groupBy("image_id").agg(
        F.sum("a").alias("active"), F.sum("i").alias("idle"))


@query("select_channels", "SELECT image_id, slice_id, y, x, spectrum[6] AS c5, spectrum[1] AS c0, spectrum[4] AS frame FROM ordpix")
def _(spark, sf):
    p = fx.pixels_ord(spark, sf)
    cut = C.select_channels(p, [5, 0])
    framed = C.frame(p.withColumn("spectrum", p.spectrum), 3)
    return cut.join(framed.withColumnRenamed("value", "frame"), PIXEL).select(
        *PIXEL, F.element_at("spectrum", 1).alias("c5"), F.element_at("spectrum", 2).alias("c0"), "frame")


@query("select_slice", "SELECT slice_id, y, x, label FROM pix4 WHERE slice_id = 4")
def _(spark, sf):
    return C.select_slice(fx.pixels_emb4d(spark, sf), 9, 5).select("slice_id", "y", "x", "label")


@query("sub_bands", """
SELECT image_id, CAST(least(channel // 2, 2) AS INT) AS band, avg(value) AS value FROM ordvox GROUP BY ALL""".replace("avg(value)", "round(avg(value), 6)"))
def _(spark, sf):
    v = to_voxels(fx.pixels_ord(spark, sf))
    return v.groupBy("image_id", C.sub_band(F.col("channel"), 7, 3).alias("band")).agg(rnd(F.avg("value"), "value"))


@query("minmax_to_dtype", """
SELECT image_id, slice_id, y, x, round((w - min(w) OVER p) / (max(w) OVER p - min(w) OVER p) * 65535, 6) AS w
FROM (SELECT image_id, slice_id, y, x, sum(value) AS w FROM ordvox GROUP BY ALL) WINDOW p AS (PARTITION BY image_id)""")
def _(spark, sf):
    m = fx.pixels_ord(spark, sf).select(*PIXEL, A.total("spectrum").alias("w"))
    return C.minmax_to_dtype(m, "w", ["image_id"]).withColumn("w", rnd("w"))


@query("scale_w_uint16", """
SELECT image_id, slice_id, y, x, channel AS component, CAST(trunc(value * (65535::DOUBLE / max(value) OVER (PARTITION BY image_id, slice_id))) AS INT) AS w FROM ordvox""")
def _(spark, sf):
    w = fx.pixels_ord(spark, sf).withColumnRenamed("spectrum", "w")
    return C.scale_w_uint16(w).select(*PIXEL, F.posexplode("w").alias("component", "w"))


@query("choose_source", """
SELECT p_partkey, CASE WHEN p_size % 5 = 0 OR p_partkey % 7 = 0 THEN 'raw' WHEN p_partkey % 3 = 0 THEN 'subtracted'
  WHEN p_size % 2 = 0 THEN 'subtracted' ELSE 'raw' END AS source FROM part""")
def _(spark, sf):
    return fx.table(spark, sf, "part").select("p_partkey", C.choose_source(
        F.col("p_partkey") % 7 == 0, F.col("p_partkey") % 3, F.col("p_size") % 2 == 0, F.col("p_size") % 5 != 0).alias("source"))


@query("resize_seed_set", """
SELECT 'emb' AS image_id, CAST(c.range AS INT) AS component, round(coalesce(s, 0), 6) AS total, false AS background
FROM range(12) c LEFT JOIN (SELECT component, sum(value) AS s FROM hk WHERE component < 8 GROUP BY ALL) h ON h.component = c.range""")
def _(spark, sf):
    seeds = fx.label_spectra(spark, sf, 8).withColumn("background", F.lit(False))
    return C.resize_seed_set(seeds, 12, 64).select("image_id", "component", rnd(A.total("spectrum"), "total"), "background")


@query("scale_spectra_to_dtype", """
SELECT image_id, slice_id, y, x, channel, CAST(CASE WHEN m > 0 THEN trunc(value / m * 65535) ELSE trunc(value) END AS INT) AS value
FROM (SELECT *, max(value) OVER (PARTITION BY image_id, slice_id, y, x) AS m FROM ordvox)""")
def _(spark, sf):
    return long(C.scale_spectra_to_dtype(fx.pixels_ord(spark, sf)))


@query("peak_channel", """
SELECT image_id, slice_id, y, x, CAST(list_position(spectrum, list_max(spectrum)) - 1 AS INT) AS peak FROM ordpix""")
def _(spark, sf):
    return fx.pixels_ord(spark, sf).select(*PIXEL, A.peak_channel("spectrum").alias("peak"))


@query("spectral_gradient", """
SELECT image_id, slice_id, y, x, channel, CASE WHEN channel = 0 THEN lead(value) OVER w - value WHEN channel = 6 THEN value - lag(value) OVER w
  ELSE (lead(value) OVER w - lag(value) OVER w) / 2 END AS value FROM ordvox WINDOW w AS (PARTITION BY image_id, slice_id, y, x ORDER BY channel)""")
def _(spark, sf):
    return long(fx.pixels_ord(spark, sf).withColumn("spectrum", A.gradient("spectrum")))


@query("smooth_spectrum", """
SELECT v.image_id, v.slice_id, v.y, v.x, v.channel, round(sum(s.value * k.w) / (SELECT sum(exp(-0.5 * r * r / 2.25)) FROM (SELECT unnest(range(-6, 7)) AS r)), 6) AS value
FROM ordvox v CROSS JOIN (SELECT r, exp(-0.5 * r * r / 2.25) AS w FROM (SELECT unnest(range(-6, 7)) AS r)) k
JOIN ordvox s ON s.image_id = v.image_id AND s.y = v.y AND s.x = v.x AND
  s.channel = CASE WHEN (v.channel + k.r + 14) % 14 < 7 THEN (v.channel + k.r + 14) % 14 ELSE 13 - (v.channel + k.r + 14) % 14 END
GROUP BY ALL""")
def _(spark, sf):
    return long(fx.pixels_ord(spark, sf).withColumn("spectrum", A.smooth("spectrum", 1.5))).withColumn("value", rnd("value"))
