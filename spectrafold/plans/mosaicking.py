"""Queries over mosaics, illumination and false colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import display as D
from ..operators import illumination as L
from ..operators import mosaic as M
from ..operators import neighborhood as N
from ..operators import stats as S
from ..operators import unmix as U
from ..scale import join_dim, join_wide, materialize
from ..tables import FIELD, PIXEL, to_pixels
from . import fixtures as fx
from .registry import query
from .sourcing import rnd
from .unmixing import NNLS2_SQL

FULL_SQL = """
full64 AS (SELECT 'm' AS mosaic_id, CAST(a.range AS INT) AS y, CAST(b.range AS INT) AS x, CAST(c.range AS INT) AS channel, coalesce(v.value, 0) AS value
  FROM range(64) a, range(64) b, range(7) c LEFT JOIN livox v ON v.y = a.range AND v.x = b.range AND v.channel = c.range),
tl AS (SELECT t.range AS tx, u.range AS ty, CAST(y - 28 * u.range AS INT) AS y, CAST(x - 28 * t.range AS INT) AS x, channel, value FROM full64, range(2) t, range(2) u
  WHERE y >= 28 * u.range AND y < 28 * u.range + 36 AND x >= 28 * t.range AND x < 28 * t.range + 36)"""


def tiles(spark, sf, shift: int = 0):
    """2 x 2 tiles of 36 x 36 with overlap 8 cut from the folded image; the lower row sits ``shift`` rows higher."""
    cells = to_pixels(fx.voxels_li(spark, sf), 7).select("y", "x", "spectrum")
    grid = spark.range(64).select(F.col("id").cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x"))
    image = grid.join(cells, ["y", "x"], "left").withColumn("spectrum", F.coalesce("spectrum", F.array_repeat(F.lit(0.0), 7)))
    cut = image.select("*", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("ty")).select("*", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("tx"))
    y0, x0 = F.col("ty") * (28 - shift), F.col("tx") * 28
    inside = (F.col("y") >= y0) & (F.col("y") < y0 + 36) & (F.col("x") >= x0) & (F.col("x") < x0 + 36)
    return cut.filter(inside).select(F.lit("m").alias("mosaic_id"), "tx", "ty", (F.col("y") - y0).cast("int").alias("y"), (F.col("x") - x0).cast("int").alias("x"), "spectrum")


def unroll(df, key="mosaic_id"):
    return df.select(key, "y", "x", F.posexplode("spectrum").alias("channel", "value")).withColumn("value", rnd("value"))


@query("mosaic_grid", "SELECT mosaic_id, y, x, channel, value FROM full64", FULL_SQL)
def _(spark, sf):
    return unroll(M.mosaic_grid(tiles(spark, sf), 36, 36, 8, 8, 7))


@query("mosaic_grid_linear", "SELECT mosaic_id, y, x, channel, value FROM full64", FULL_SQL)
def _(spark, sf):
    return unroll(M.mosaic_grid(tiles(spark, sf), 36, 36, 8, 8, 7, profile="linear"))


@query("mosaic", "SELECT mosaic_id, y, x, channel, value FROM full64", FULL_SQL)
def _(spark, sf):
    return unroll(M.mosaic(tiles(spark, sf), 36, 36, 8, 8, 7))


@query("mosaic_shifted", "SELECT mosaic_id, y, x, channel, value FROM full64 WHERE y < 62", FULL_SQL)
def _(spark, sf):
    return unroll(M.mosaic(tiles(spark, sf, 2), 36, 36, 8, 8, 7, mode="mean", profile="linear"))


@query("mosaic_matched")
def _(spark, sf):
    t = tiles(spark, sf).withColumn("spectrum", F.transform("spectrum", lambda v: v * (1 + F.col("ty") * 0.5)))
    out = M.mosaic(t, 36, 36, 8, 8, 7, match_intensity=True, as_uint16=True)
    return out.select("mosaic_id", F.posexplode("spectrum").alias("channel", "value")).groupBy("mosaic_id", "channel").agg(
        F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))


PAIR_SQL = FULL_SQL + """,
st AS (SELECT tx, 0 AS side, y - 28 AS y, x, sum(value) AS g FROM tl WHERE ty = 0 AND y >= 28 GROUP BY ALL UNION ALL SELECT tx, 1, y, x, sum(value) FROM tl WHERE ty = 1 AND y < 8 GROUP BY ALL),
ct AS (SELECT tx, side, y, x, g - avg(g) OVER (PARTITION BY tx, side) AS g FROM st),
cc AS (SELECT a.tx, a.y - b.y + 7 - 3 AS iy, a.x - b.x + 35 - 17 AS ix, sum(a.g * b.g) AS c FROM ct a JOIN ct b ON a.tx = b.tx AND a.side = 0 AND b.side = 1 GROUP BY ALL)"""


@query("pair_offset", """
SELECT 'm' AS mosaic_id, CAST(tx AS INT) AS cx, 0 AS ry, 4.0::DOUBLE - arg_max(iy, c) AS oy, 18.0::DOUBLE - arg_max(ix, c) AS ox FROM cc WHERE iy BETWEEN 0 AND 7 AND ix BETWEEN 0 AND 35 GROUP BY ALL""", PAIR_SQL)
def _(spark, sf):
    t = tiles(spark, sf)
    placed = t.join(M.tile_ranks(t), ["mosaic_id", "tx", "ty"])
    return M.pair_offsets(M.vertical_strips(placed, 36, 8), ["mosaic_id", "cx", "ry"])


@query("tile_neighbours", """
SELECT mosaic_id, tx, ty, lead(ty) OVER (PARTITION BY mosaic_id, tx ORDER BY ty) AS below, lead(tx) OVER (PARTITION BY mosaic_id, ty ORDER BY tx) AS "right"
FROM (SELECT DISTINCT 'm' || (l_suppkey % 3) AS mosaic_id, CAST(l_linenumber AS INT) AS tx, CAST(l_orderkey % 101 + 3 * (l_orderkey // 1000) AS INT) AS ty FROM lineitem)""")
def _(spark, sf):
    t = fx.table(spark, sf, "lineitem").selectExpr("concat('m', l_suppkey % 3) AS mosaic_id", "l_linenumber AS tx", "CAST(l_orderkey % 101 + 3 * (l_orderkey div 1000) AS INT) AS ty")
    return M.tile_neighbours(t)


@query("overlap_pairs", """
SELECT a.tx, 0 AS ty, 1 AS below, a.y - 28 AS y, a.x, a.channel, a.value AS top, b.value AS bottom FROM tl a JOIN tl b ON a.ty = 0 AND b.ty = 1 AND a.tx = b.tx AND a.y - 28 = b.y AND a.x = b.x AND a.channel = b.channel""".replace("a.tx,", "CAST(a.tx AS INT) AS tx,"), FULL_SQL)
def _(spark, sf):
    p = M.overlap_pairs(tiles(spark, sf), 36, 8)
    return p.select("tx", "ty", "below", "y", "x", F.posexplode(F.arrays_zip("top", "bottom")).alias("channel", "p")).select(
        "tx", "ty", "below", "y", "x", "channel", "p.top", "p.bottom")


@query("robust_offsets", """
SELECT mosaic_id, id, round(CASE WHEN abs(oy - my) > 1.5::DOUBLE * sy THEN 0 ELSE oy END, 6) AS oy, round(avg(CASE WHEN abs(oy - my) > 1.5::DOUBLE * sy THEN 0 ELSE oy END) OVER (PARTITION BY mosaic_id), 6) AS mean_oy
FROM (SELECT *, avg(oy) OVER p AS my, stddev_pop(oy) OVER p AS sy FROM (SELECT 'm' || (l_suppkey % 5) AS mosaic_id, l_orderkey * 8 + l_linenumber AS id, l_quantity - 25 AS oy FROM lineitem) WINDOW p AS (PARTITION BY mosaic_id))""")
def _(spark, sf):
    o = fx.table(spark, sf, "lineitem").selectExpr("concat('m', l_suppkey % 5) AS mosaic_id", "l_orderkey * 8 + l_linenumber AS id", "l_quantity - 25 AS oy", "l_discount AS ox")
    one = M.robust_offsets(o, ["mosaic_id"], "sigma", 1.5).select("mosaic_id", "id", "oy")
    mean = M.robust_offsets(o, ["mosaic_id"], "SIGMA mean", 1.5).groupBy("mosaic_id").agg(F.max("oy").alias("mean_oy"))
    return one.join(mean, "mosaic_id").select("mosaic_id", "id", rnd("oy", "oy"), rnd("mean_oy", "mean_oy"))


@query("trim_null_edges")
def _(spark, sf):
    p = fx.pixels_ord(spark, sf).select(F.col("image_id").alias("mosaic_id"), "y", "x", "spectrum")
    whole = tiles(spark, sf).select(F.concat("mosaic_id", F.lit("_"), "tx", F.lit("_"), "ty").alias("mosaic_id"), "y", "x", "spectrum").filter("NOT (y = 0 AND x > 3) AND NOT (x = 17 AND y = 9)")
    return M.trim_null_edges(p.unionByName(whole)).groupBy("mosaic_id").agg(
        F.min("y").alias("y0"), F.max("y").alias("y1"), F.count_distinct("x").alias("n_cols"), F.count(F.lit(1)).alias("n"))


GAIN_SQL = """
shp AS (SELECT image_id, slice_id, max(y) + 1 AS ny, max(x) + 1 AS nx FROM ordpix0 GROUP BY ALL),
mdl AS (SELECT *, (nx - 1) / 2.0::DOUBLE + 2.5 AS cx, (ny - 1) / 2.0::DOUBLE - 1.25 AS cy, greatest(1, 0.35::DOUBLE * nx) AS sx, greatest(1, 0.35::DOUBLE * ny) AS sy FROM shp),
tgt AS (SELECT *, 0.1 + 0.9 * exp(-0.5 * ((least(greatest(ceil(cx - 0.5), 0), nx - 1) - cx) / sx) ** 2 - 0.5 * ((least(greatest(ceil(cy - 0.5), 0), ny - 1) - cy) / sy) ** 2) AS t FROM mdl),
gn AS (SELECT p.image_id, p.slice_id, p.y, p.x, least(greatest(1 + 0.8::DOUBLE * (t / (0.1 + 0.9 * exp(-0.5 * ((x - cx) / sx) ** 2 - 0.5 * ((y - cy) / sy) ** 2) + 1e-6) - 1), 1 / 3::DOUBLE), 3) AS gain FROM ordpix0 p JOIN tgt USING (image_id, slice_id))"""


def model(spark, sf):
    p = fx.pixels_ord(spark, sf)
    shape = N.field_shape(p)
    m = L.default_model(shape).withColumns({"dx": F.lit(2.5), "dy": F.lit(-1.25), "amp": F.lit(0.8), "offset": F.lit(0.1)})
    return p, shape, m


@query("illum_gain", "SELECT image_id, slice_id, y, x, round(gain, 6) AS gain FROM gn", GAIN_SQL)
def _(spark, sf):
    p, shape, m = model(spark, sf)
    return L.illum_gain(m, shape, positions=p.select(*PIXEL)).withColumn("gain", rnd("gain"))


@query("apply_illumination", """
SELECT g.image_id, g.slice_id, g.y, g.x, v.channel, round(least(greatest(v.value * gain, 0), 60), 6) AS value FROM gn g JOIN ordvox v ON v.image_id = g.image_id AND v.y = g.y AND v.x = g.x""", GAIN_SQL)
def _(spark, sf):
    p, shape, m = model(spark, sf)
    out = L.apply_illumination(p, shape, "reference", m, dtype_max=60.0)
    return out.select(*PIXEL, F.posexplode("spectrum").alias("channel", "value")).withColumn("value", rnd("value"))


@query("illum_gain_mean", """
SELECT g.image_id, round(avg(least(greatest(t / (e + 1e-6), 1 / 3::DOUBLE), 3)), 6) AS mean_gain FROM (
 SELECT image_id, e, avg(e) OVER (PARTITION BY image_id) AS t FROM (SELECT s.image_id, exp(-0.5 * ((a.range - (nx - 1) / 2.0::DOUBLE) / greatest(1, 0.35::DOUBLE * nx)) ** 2 - 0.5 * ((b.range - (ny - 1) / 2.0::DOUBLE) / greatest(1, 0.35::DOUBLE * ny)) ** 2) AS e
 FROM shp s, range(64) a, range(64) b WHERE a.range < nx AND b.range < ny)) g GROUP BY ALL""", GAIN_SQL)
def _(spark, sf):
    _p, shape, _m = model(spark, sf)
    return L.illum_gain(L.default_model(shape), shape, "mean").groupBy("image_id").agg(rnd(F.avg("gain"), "mean_gain"))


@query("illum_fit")
def _(spark, sf):
    """The mean image, lit by a planted hill, of every image."""
    p, shape, m = model(spark, sf)
    field = p.join(F.broadcast(shape.select(*FIELD, "ny", "nx")), FIELD).select(*PIXEL, ((A.mean("spectrum") + 1) * F.exp(
        -0.5 * F.pow((F.col("x") - F.col("nx") * 0.6) / (F.col("nx") * 0.3), F.lit(2)) - 0.5 * F.pow((F.col("y") - F.col("ny") * 0.45) / (F.col("ny") * 0.25), F.lit(2)))).alias("value"))
    fit = L.illum_fit(field, shape)
    return fit.select(*FIELD, *[F.round(c, 4).alias(c) for c in ("dx", "dy", "sigma_x", "sigma_y")])


@query("illum_blur_modes")
def _(spark, sf):
    p = fx.pixels_emb(spark, sf)
    shape = N.field_shape(p)
    out = None
    for mode in ("blur", "gaussfit"):
        one = L.apply_illumination(p, shape, mode, sigma=4.0).groupBy(*FIELD).agg(rnd(F.avg(A.mean("spectrum")), mode))
        out = one if out is None else out.join(one, FIELD)
    return out


@query("intensity_correction", """
SELECT image_id, slice_id, y, x, round(max(m) OVER (PARTITION BY image_id) / m, 6) AS correction, round(m, 6) AS model FROM (
  SELECT image_id, slice_id, y, x, 900 - 3 * sqrt((x - 30.5::DOUBLE) ** 2 + (y - 28) ** 2) AS m FROM ordpix0)""")
def _(spark, sf):
    out = L.intensity_correction(fx.pixels_ord(spark, sf), "linear", {"xc": 30.5, "yc": 28.0, "peak": 900.0, "slope": -3.0})
    return out.withColumn("correction", rnd("correction")).withColumn("model", rnd("model"))


@query("fit_quadratic")
def _(spark, sf):
    f = fx.pixels_ord(spark, sf).select(*PIXEL, (A.total("spectrum") + 500 - 0.1 * ((F.col("x") - 30) * (F.col("x") - 30) + (F.col("y") - 25) * (F.col("y") - 25))).alias("value"))
    out = L.fit_quadratic(f)
    return out.select(*FIELD, *[F.round(c, 4).alias(c) for c in ("xc", "yc", "peak", "slope")])


@query("fit_radial")
def _(spark, sf):
    p = fx.pixels_ord(spark, sf)
    r = F.sqrt(F.pow(F.col("x") - 30.3, F.lit(2)) + F.pow(F.col("y") - 25.2, F.lit(2)))
    out = L.fit_radial(p.select(*PIXEL, (500 - 2 * r + A.total("spectrum")).alias("value")), "linear")
    return out.select(*FIELD, *[F.round(c, 2).alias(c) for c in ("xc", "yc", "peak", "slope")])


@query("binned_correction")
def _(spark, sf):
    p = fx.pixels_ord(spark, sf)
    f = p.select(*PIXEL, (A.total("spectrum") + 1).alias("value"))
    return L.binned_correction(f, N.field_shape(p), 16).groupBy(*FIELD).agg(rnd(F.min("correction"), "low"), rnd(F.max("correction"), "high"))


@query("masks", """
SELECT image_id, slice_id, CAST(b.range AS INT) AS y, CAST(a.range AS INT) AS x,
  round((1 / (((a.range * nx / (nx - 1)::DOUBLE) - (nx // 2 + 2)) ** 2 + ((b.range * ny / (ny - 1)::DOUBLE) - (ny // 2 - 1)) ** 2 + 250000)) / max(1 / (((a.range * nx / (nx - 1)::DOUBLE) - (nx // 2 + 2)) ** 2 + ((b.range * ny / (ny - 1)::DOUBLE) - (ny // 2 - 1)) ** 2 + 250000)) OVER (PARTITION BY image_id), 6) AS lorentzian,
  round(CASE WHEN nx % 2 = 1 AND a.range = (ny + nx) // 4 AND b.range = (ny + nx) // 4 THEN 1 ELSE 0.5 + 0.5 / ((ny + nx) // 4)::DOUBLE * least(a.range, nx - 1 - a.range, b.range, ny - 1 - b.range, (ny + nx) // 4 - 1) END, 6) AS diamond,
  round((CASE WHEN a.range < nx // 2 THEN (1 - sqrt(0.5)) / (nx // 2) * a.range + sqrt(0.5) ELSE 2 - sqrt(0.5) - (1 - sqrt(0.5)) / (nx // 2) * a.range END) * (CASE WHEN b.range < ny // 2 THEN (1 - sqrt(0.5)) / (ny // 2) * b.range + sqrt(0.5) ELSE 2 - sqrt(0.5) - (1 - sqrt(0.5)) / (ny // 2) * b.range END), 6) AS pyramid
FROM shp, range(64) a, range(64) b WHERE a.range < nx AND b.range < ny""", GAIN_SQL)
def _(spark, sf):
    shape = materialize(N.field_shape(fx.pixels_ord(spark, sf)))
    out = L.mask(shape, "lorentzian", 0.5, 2, -1).withColumn("lorentzian", rnd("value")).drop("value")
    for kind in ("diamond", "pyramid"):
        out = join_wide(out, L.mask(shape, kind, 0.5).withColumn(kind, rnd("value")).drop("value"), PIXEL)
    return out


@query("apply_mask", """
SELECT image_id, slice_id, y, x, round(c * m / max(c * m) OVER (PARTITION BY image_id), 6) AS correction FROM (
  SELECT p.image_id, p.slice_id, p.y, p.x, 1 + x / 64::DOUBLE AS c, 0.5 + 0.5 / ((ny + nx) // 4)::DOUBLE * least(x, nx - 1 - x, y, ny - 1 - y, (ny + nx) // 4 - 1) AS m FROM ordpix0 p JOIN shp USING (image_id, slice_id)
  WHERE NOT (nx % 2 = 1 AND x = (ny + nx) // 4 AND y = (ny + nx) // 4))""", GAIN_SQL)
def _(spark, sf):
    p = fx.pixels_ord(spark, sf)
    shape = materialize(N.field_shape(p))
    centre = (F.col("nx") % 2 == 1) & (F.col("x") == F.expr("(ny + nx) div 4")) & (F.col("y") == F.expr("(ny + nx) div 4"))
    c = join_dim(p, shape, FIELD).filter(~centre).select(*PIXEL, (1 + F.col("x") / 64).alias("correction"))
    return L.apply_mask(c, L.mask(shape, "diamond", 0.5)).withColumn("correction", rnd("correction"))


@query("false_color", """
SELECT image_id, slice_id, y, x, CAST(trunc(least(a * 1.0 + CASE WHEN b < 0.5 THEN b ELSE 0.5 + (b - 0.5) * 0.6 END, 1) * 65535) AS INT) AS r,
  CAST(trunc(least(CASE WHEN b < 0.5 THEN b * 0.4 ELSE 0.2 + (b - 0.5) * 1.2 END, 1) * 65535) AS INT) AS g, CAST(trunc(least(a * 0.25, 1) * 65535) AS INT) AS b
FROM (SELECT image_id, slice_id, y, x, least(greatest((spectrum[1] - 3) / 40, 0), 1) AS a, least(greatest((spectrum[2] - 0) / 50, 0), 1) AS b FROM ordpix)""")
def _(spark, sf):
    w = fx.pixels_ord(spark, sf).withColumnRenamed("spectrum", "w")
    stops = [[(0.0, (0, 0, 0)), (1.0, (1.0, 0, 0.25))], [(0.0, (0, 0, 0)), (0.5, (0.5, 0.2, 0)), (1.0, (0.8, 0.8, 0))], [(0.0, (0, 0, 0)), (1.0, (1, 1, 1))]]
    return D.false_color(w, [(3.0, 43.0), (0.0, 50.0), (5.0, 5.0)], stops)


@query("seed_composite", """
SELECT image_id, slice_id, y, x, CAST(trunc(least(a * 1.0 + c * 0.5, 1) * 65535) AS INT) AS r, CAST(trunc(least(b, 1) * 65535) AS INT) AS g, CAST(trunc(least(c * 0.75, 1) * 65535) AS INT) AS b
FROM (SELECT image_id, slice_id, y, x, spectrum[1] / max(spectrum[1]) OVER p AS a, spectrum[2] / max(spectrum[2]) OVER p AS b, spectrum[3] / max(spectrum[3]) OVER p AS c FROM ordpix WINDOW p AS (PARTITION BY image_id, slice_id))""")
def _(spark, sf):
    w = fx.pixels_ord(spark, sf).withColumnRenamed("spectrum", "w")
    return D.seed_composite(w, [(1.0, 0, 0), (0, 1.0, 0), (0.5, 0, 0.75)], 3)


@query("radial_models", """
SELECT l_orderkey, l_linenumber, round(900 - 2 * sqrt(q), 6) AS linear, round(900 - 0.1::DOUBLE * q, 6) AS quadratic, round(500 / (q + 250000), 6) AS lorentzian,
  round(CASE WHEN q = 0 THEN 1 ELSE least(1 / (q ** (-ln(0.5::DOUBLE) / ln(8000::DOUBLE))), 1) END, 6) AS inverse FROM (SELECT l_orderkey, l_linenumber, l_quantity * l_quantity - 1 AS q FROM lineitem)""")
def _(spark, sf):
    from ..functions.curves import radial_model as rm

    q = F.col("l_quantity") * F.col("l_quantity") - 1
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", rnd(rm("linear", q, {"peak": 900, "slope": -2}), "linear"), rnd(rm("quadratic", q, {"peak": 900, "slope": -0.1}), "quadratic"),
        rnd(rm("lorentzian", q, {"strength": 0.5}), "lorentzian"), rnd(rm("inverse", q, {"strength": 0.5, "farthest": 8000}), "inverse"))
