"""Queries over sources, axis files, tile names and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import units as U
from ..operators import axis as X
from ..operators.unmix import to_long_maps
from ..sources import readers as R
from ..sources.writers import spectra_table
from ..tables import canonicalize_cube, to_pixels, to_voxels, validate_shapes, row_major_index
from ..scale import join_dim
from . import fixtures as fx
from .registry import query


def rnd(c, name=None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


@query("canonicalize_cube", """
SELECT 'cube' AS image_id, CAST(l_linenumber - 1 AS INT) AS channel, CAST(l_suppkey % 10 AS INT) AS slice_id,
       CAST(l_orderkey % 64 AS INT) AS y, CAST(l_partkey % 64 AS INT) AS x, sum(l_quantity) AS value, 'time' AS slice_kind
FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    raw = fx.table(spark, sf, "lineitem").select(
        F.lit("cube").alias("image_id"), (F.col("l_linenumber") - 1).alias("d0"), (F.col("l_suppkey") % 10).alias("d1"),
        (F.col("l_orderkey") % 64).alias("d2"), (F.col("l_partkey") % 64).alias("d3"), F.col("l_quantity").alias("value"),
    )
    cube = canonicalize_cube(raw, spectral_axis="d0", slice_axis="d1", y_axis="d2", x_axis="d3", slice_kind="time")
    return cube.groupBy("image_id", "slice_id", "y", "x", "channel", "slice_kind").agg(F.sum("value").alias("value"))


@query("pixels_to_voxels", "SELECT image_id, slice_id, y, x, channel, value FROM ordvox")
def _(spark, sf):
    return to_voxels(fx.pixels_ord(spark, sf))


@query("voxels_to_pixels", """
SELECT image_id, slice_id, y, x, CAST(y * 25 + x AS BIGINT) AS p, round(list_sum(spectrum[1:8]), 6) AS head, spectrum[64] AS last
FROM (SELECT image_id, slice_id, y, x, list(round(value, 6) ORDER BY channel) AS spectrum FROM vox GROUP BY ALL)""")
def _(spark, sf):
    long = to_voxels(fx.pixels_emb(spark, sf)).withColumn("value", rnd("value"))
    wide = to_pixels(long)
    head = F.aggregate(F.slice("spectrum", 1, 8), F.lit(0.0), lambda a, v: a + v)
    return wide.select("image_id", "slice_id", "y", "x", row_major_index(25).alias("p"), rnd(head, "head"),
                       F.element_at("spectrum", 64).alias("last"))


@query("validate_shapes", """
SELECT image_id, slice_id, y, x, CAST(7 - CAST(x % 2 AS INT) AS INT) AS found, 7 AS expected FROM ordpix WHERE x % 2 = 1""")
def _(spark, sf):
    pixels = fx.pixels_ord(spark, sf)
    cut = pixels.withColumn("spectrum", F.expr("slice(spectrum, 1, 7 - x % 2)"))
    meta = pixels.select("image_id").distinct().withColumn("n_channels", F.lit(7))
    return validate_shapes(cut, meta)


PATHS_SQL = """
paths AS (
  SELECT page_id, CAST(page_id % 3 AS INT) AS mosaic_id,
    CASE CAST(page_id % 5 AS INT)
      WHEN 0 THEN 'run/a_pos_' || (page_id % 7) || '_' || (page_id % 11) || '.tif'
      WHEN 1 THEN 'run/a_pos_-' || (page_id % 7) || '_' || (page_id % 11) || '.TIF'
      WHEN 2 THEN 'run/a_POS-' || (page_id % 7) || '-' || (page_id % 11) || '_z.tif'
      WHEN 3 THEN 'run/notes_' || page_id || '.txt'
      ELSE 'run/a_pos_' || (page_id % 7) || '.5_-' || (page_id % 11) || '.25.tif' END AS path
  FROM pages)"""


def _paths(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", (F.col("page_id") % 3).cast("int").alias("mosaic_id"), F.expr("""
    CASE CAST(page_id % 5 AS INT)
      WHEN 0 THEN concat('run/a_pos_', page_id % 7, '_', page_id % 11, '.tif')
      WHEN 1 THEN concat('run/a_pos_-', page_id % 7, '_', page_id % 11, '.TIF')
      WHEN 2 THEN concat('run/a_POS-', page_id % 7, '-', page_id % 11, '_z.tif')
      WHEN 3 THEN concat('run/notes_', page_id, '.txt')
      ELSE concat('run/a_pos_', page_id % 7, '.5_-', page_id % 11, '.25.tif') END AS path"""))


TILE_SQL = PATHS_SQL + """,
named AS (
  SELECT page_id, mosaic_id, path,
    TRY_CAST(regexp_extract(path, '(?i).*pos[_-](-?\\d+)[_-](-?\\d+).*', 1) AS INT) AS tx,
    TRY_CAST(regexp_extract(path, '(?i).*pos[_-](-?\\d+)[_-](-?\\d+).*', 2) AS INT) AS ty
  FROM paths)"""


def _named(spark, sf):
    return R.parse_tile_names(_paths(spark, sf)).select("page_id", "mosaic_id", "path", "tx", "ty")


@query("tile_catalog", "SELECT path, tx, ty FROM named WHERE tx IS NOT NULL", TILE_SQL)
def _(spark, sf):
    return R.parse_tile_names(_paths(spark, sf)).filter("tx IS NOT NULL").select("path", "tx", "ty")


@query("parse_tile_position", """
SELECT path AS name,
  CASE WHEN k IN (0, 1) AND NOT dotted THEN CAST(sx AS DOUBLE) WHEN k IN (0, 1, 4) THEN CAST(ax AS DOUBLE) END AS tx,
  CASE WHEN k IN (0, 1) AND NOT dotted THEN CAST(sy AS DOUBLE) WHEN k IN (0, 1, 4) THEN CAST(ay AS DOUBLE) END AS ty,
  CASE WHEN k IN (0, 1, 4) THEN number END AS number,
  CASE WHEN k IN (0, 1, 4) THEN 'run/a' END AS base
FROM (SELECT path, page_id % 5 AS k, true AS dotted,
        split_part(path, '_', 3) AS sx, split_part(path, '_', 4) AS sy,
        rtrim(regexp_replace(split_part(path, '_', 3), '[^0-9.]', '', 'g'), '.') AS ax,
        rtrim(regexp_replace(split_part(path, '_', 4), '[^0-9.]', '', 'g'), '.') AS ay,
        split_part(path, '_', 4) AS number FROM paths)""", PATHS_SQL)
def _(spark, sf):
    return R.parse_tile_position(_paths(spark, sf), "path")


@query("grid_completeness", """
SELECT mosaic_id, tx, ty FROM (SELECT DISTINCT mosaic_id, tx FROM named WHERE tx IS NOT NULL)
JOIN (SELECT DISTINCT mosaic_id, ty FROM named WHERE ty IS NOT NULL) USING (mosaic_id)
EXCEPT SELECT mosaic_id, tx, ty FROM named WHERE tx IS NOT NULL""", TILE_SQL)
def _(spark, sf):
    return R.grid_completeness(_named(spark, sf))


@query("grid_summary", """
SELECT mosaic_id, count(*) FILTER (tx IS NOT NULL) AS n_parsed, count(*) FILTER (tx IS NULL) AS n_skipped,
  CAST(count(DISTINCT tx) * count(DISTINCT ty) - count(DISTINCT (tx, ty)) FILTER (tx IS NOT NULL) AS BIGINT) AS n_missing
FROM named GROUP BY ALL""", TILE_SQL)
def _(spark, sf):
    return R.grid_summary(_named(spark, sf))


@query("parse_two_columns", """
SELECT CAST(l_orderkey AS BIGINT) AS id, l_quantity AS axis_value, l_discount AS value FROM lineitem WHERE l_orderkey % 4 < 2""")
def _(spark, sf):
    lines = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.expr("""
      CASE CAST(l_orderkey % 4 AS INT) WHEN 0 THEN concat('  ', l_quantity, '\t', l_discount)
        WHEN 1 THEN concat(l_quantity, ' ', l_discount, ' x') WHEN 2 THEN concat('# ', l_quantity) ELSE '' END AS value"""))
    return R.parse_two_columns(lines)


@query("axis_list_tokens", """
SELECT o_orderkey, CAST(unnest([0, 1, 2]) AS INT) AS channel,
  CASE WHEN o_orderkey % 2 = 0 THEN unnest([CAST(o_custkey AS DOUBLE), round(o_totalprice, 2), 3.5::DOUBLE]) ELSE CAST(unnest([0, 1, 2]) AS DOUBLE) END AS value,
  CASE WHEN o_orderkey % 2 = 1 THEN unnest([o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR)]) END AS label
FROM orders""")
def _(spark, sf):
    lists = fx.table(spark, sf, "orders").select("o_orderkey", F.expr("""
      CASE WHEN o_orderkey % 2 = 0 THEN concat(o_custkey, ';', CAST(round(o_totalprice, 2) AS STRING), ', 3.5,')
      ELSE concat(o_orderstatus, '\n', o_orderpriority, ',', o_custkey) END AS text"""))
    return R.axis_list_tokens(lists)


@query("validate_axis_meta", """
SELECT p_partkey, p_partkey % 2 = 0 AS custom,
  CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS first_value,
  CASE p_partkey % 4 WHEN 0 THEN 'nm' WHEN 1 THEN 'cm⁻¹' WHEN 2 THEN 'index' END AS spectral_unit,
  CASE WHEN p_partkey % 2 = 1 THEN 'pump' END AS tuned_beam
FROM part""")
def _(spark, sf):
    none = F.lit(None)
    odd, even = F.col("p_partkey") % 2 == 1, F.col("p_partkey") % 2 == 0
    meta = fx.table(spark, sf, "part").select(
        "p_partkey",
        F.when(even, F.array("p_retailprice", F.lit(1.0))).alias("custom_values"),
        none.cast("array<double>").alias("custom_points"),
        F.when(even, F.array("p_name", "p_brand")).alias("custom_labels"),
        none.cast("array<string>").alias("labels"),
        F.expr("CASE p_partkey % 4 WHEN 0 THEN ' Wavelength ' WHEN 1 THEN 'Raman Shift' WHEN 2 THEN 'Frames' END").alias("spectral_unit"),
        none.cast("string").alias("unit"),
        F.when(odd, "Pump").alias("tuned_beam"), F.when(odd, 1064.0).alias("fixed_beam_nm"),
        F.when(odd, 780.0).alias("tuned_min_nm"), none.cast("double").alias("tuned_max_nm"), none.cast("double").alias("tuned_step_nm"),
    )
    out = R.validate_axis_meta(meta)
    return out.select("p_partkey", "custom", F.element_at("custom_values", 1).alias("first_value"), "spectral_unit", "tuned_beam")


@query("spectra_table", """
SELECT image_id, channel, max(CASE WHEN component = 0 THEN value END) AS "Component 0",
  max(CASE WHEN component = 1 THEN value END) AS "Component 1", max(CASE WHEN component = 2 THEN value END) AS "Component 2"
FROM (SELECT 'emb' AS image_id, component, channel, round(value, 6) AS value FROM hk) GROUP BY ALL""")
def _(spark, sf):
    long = fx.label_spectra(spark, sf, 3).select("image_id", "component", F.posexplode("spectrum").alias("channel", "value"))
    return spectra_table(long.withColumn("value", rnd("value")), 3)


@query("normalize_spectral_unit", """
SELECT o_orderkey, CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN 'cm⁻¹' WHEN 1 THEN 'nm' WHEN 2 THEN 'index' WHEN 3 THEN 'cm⁻¹'
  WHEN 4 THEN 'cm⁻¹' WHEN 5 THEN 'nm' WHEN 6 THEN 'cm⁻¹' ELSE 'index' END AS unit,
  CASE WHEN o_custkey % 3 = 0 THEN 'Channel Label' WHEN o_orderkey % 8 IN (2, 7) THEN 'Channel' WHEN o_orderkey % 8 IN (1, 5) THEN 'Wavelength (nm)'
  ELSE 'Wavenumber (1/cm)' END AS header
FROM orders""")
def _(spark, sf):
    raw = F.expr("""CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN ' CM−1' WHEN 1 THEN 'Nanometers' WHEN 2 THEN 'Idx'
      WHEN 3 THEN 'cm ⁻¹' WHEN 4 THEN o_orderpriority WHEN 5 THEN ' NM ' WHEN 6 THEN CAST(NULL AS STRING) ELSE 'Fra mes' END""")
    return fx.table(spark, sf, "orders").select(
        "o_orderkey", U.normalize_spectral_unit(raw).alias("unit"),
        U.spectral_csv_header(raw, F.col("o_custkey") % 3 == 0).alias("header"),
    )


@query("length_units", """
SELECT p_partkey, CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'µm' WHEN 1 THEN 'nm' WHEN 2 THEN 'mm' WHEN 3 THEN 'µm' END AS unit,
  round(p_size * CASE CAST(p_partkey % 5 AS INT) WHEN 1 THEN 0.001::DOUBLE WHEN 2 THEN 1000::DOUBLE ELSE 1::DOUBLE END, 6) AS pixel_um
FROM part""")
def _(spark, sf):
    raw = F.expr("CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'Microns' WHEN 1 THEN ' Nanometre' WHEN 2 THEN 'MM' WHEN 3 THEN 'μm' ELSE p_brand END")
    unit = U.normalize_length_unit(raw)
    return fx.table(spark, sf, "part").select("p_partkey", unit.alias("unit"), rnd(U.pixel_size_um(F.col("p_size").cast("double"), unit), "pixel_um"))


@query("physical_units", """
SELECT image_id, round(0.4::DOUBLE, 6) AS pixel_size, 'nm' AS unit, round(floor(nx / 2) * 0.4::DOUBLE, 6) AS fov_width, round(floor(ny / 2) * 0.4::DOUBLE, 6) AS fov_height,
  round(floor(nx / 2) * 0.4::DOUBLE * floor(ny / 2) * 0.4::DOUBLE, 6) AS area, round(0.0004::DOUBLE, 6) AS pixel_size_um,
  round(floor(nx / 2) * floor(ny / 2) * 0.0004::DOUBLE * 0.0004::DOUBLE, 6) AS area_um2
FROM (SELECT image_id, max(y) + 1 AS ny, max(x) + 1 AS nx FROM ordpix0 GROUP BY ALL)""")
def _(spark, sf):
    meta = fx.voxels_ord(spark, sf).groupBy("image_id").agg((F.max("y") + 1).alias("ny"), (F.max("x") + 1).alias("nx"))
    out = U.physical_units(meta.withColumn("pixel_size", F.lit(0.2)).withColumn("unit", F.lit("nm")), 2)
    return out.select(*[rnd(c, c) if c not in ("image_id", "unit") else F.col(c) for c in out.columns])


@query("component_index", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 9 AS INT) WHEN doc_id % 3 = 1 THEN CAST(doc_id % 9 - 1 AS INT) END AS component FROM documents""")
def _(spark, sf):
    label = F.expr("CASE WHEN doc_id % 3 = 0 THEN concat('Component  ', doc_id % 9 + 1) WHEN doc_id % 3 = 1 THEN CAST(doc_id % 9 AS STRING) ELSE concat('no ', lang) END")
    return fx.table(spark, sf, "documents").select("doc_id", U.component_index(label).alias("component"))


@query("raman_axis", """
SELECT image_id, channel, round(CASE WHEN m = 0 THEN 1e7::DOUBLE / wave - 1e7::DOUBLE / 1064 WHEN m = 1 THEN 1e7::DOUBLE / 1064 - 1e7::DOUBLE / wave WHEN m = 2 THEN wave ELSE CAST(channel AS DOUBLE) END, 6) AS value,
  CASE WHEN m < 2 THEN 'cm⁻¹' WHEN m = 2 THEN 'nm' ELSE 'index' END AS unit
FROM (SELECT 's' || s_suppkey AS image_id, s_suppkey % 4 AS m, CAST(c.range AS INT) AS channel,
   CASE WHEN s_suppkey % 8 >= 4 THEN 700 + s_nationkey + 2.5::DOUBLE * c.range
        ELSE 700 + s_nationkey + 100.0::DOUBLE * c.range / 15 END AS wave
  FROM supplier CROSS JOIN range(16) c)""")
def _(spark, sf):
    s = fx.table(spark, sf, "supplier")
    m = F.col("s_suppkey") % 4
    low, high = 700.0 + F.col("s_nationkey"), 800.0 + F.col("s_nationkey")
    stepped = F.col("s_suppkey") % 8 >= 4
    images = s.select(
        F.concat(F.lit("s"), "s_suppkey").alias("image_id"), F.lit(16).alias("n_channels"),
        F.when(~stepped & (F.col("s_suppkey") % 3 == 0), high).otherwise(low).alias("minimum"),
        F.when(~stepped, F.when(F.col("s_suppkey") % 3 == 0, low).otherwise(high)).alias("maximum"),
        F.lit(2.5).alias("step"), F.lit(1064.0).alias("fixed_nm"),
        F.when(m == 1, "stokes").otherwise("pump").alias("beam"),
        F.when(m < 2, "cm-1").when(m == 2, "nm").otherwise("index").alias("unit"),
    )
    out = X.raman_axis(images)
    return out.select("image_id", "channel", rnd("value", "value"), "unit")


@query("attach_axis", """
SELECT v.image_id, v.channel, round(a.value, 6) AS axis_value, a.unit, round(avg(v.value), 6) AS value
FROM vox v JOIN axis64 a ON v.image_id = a.image_id AND v.channel = a.channel GROUP BY ALL""")
def _(spark, sf):
    out = X.attach_axis(to_voxels(fx.pixels_emb(spark, sf)), fx.axis64(spark))
    return out.groupBy("image_id", "channel", rnd("axis_value", "axis_value"), "unit").agg(rnd(F.avg("value"), "value"))


@query("resonance_channels", """
SELECT r.resonance_id, r.component, p.channel, round(p.value, 6) AS band
FROM (SELECT resonance_id, component, unnest(CASE WHEN len(hit) > 0 THEN hit ELSE [near] END) AS channel FROM
  (SELECT resonance_id, component, coalesce(list(a.channel) FILTER (a.value BETWEEN center - width AND center + width), []) AS hit,
     arg_min(a.channel, struct_pack(d := abs(a.value - center), c := a.channel)) AS near
   FROM resonances r JOIN axis64 a USING (image_id) GROUP BY ALL)) r
JOIN (SELECT channel, avg(value) AS value FROM vox GROUP BY ALL) p USING (channel)""")
def _(spark, sf):
    bands = X.resonance_channels(fx.resonances(spark), fx.axis64(spark)).select("resonance_id", "component", "channel")
    means = to_voxels(fx.pixels_emb(spark, sf)).groupBy("channel").agg(F.avg("value").alias("band"))
    return bands.join(means, "channel").select("resonance_id", "component", "channel", rnd("band", "band"))


@query("nearest_channel", """
SELECT o_orderkey, channel, round(value, 6) AS axis_value FROM (
  SELECT o_orderkey, a.channel, a.value, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(a.value - (2700 + o_custkey % 400)), a.channel) AS rn
  FROM orders CROSS JOIN axis64 a) WHERE rn = 1""")
def _(spark, sf):
    targets = fx.table(spark, sf, "orders").select(
        F.lit("emb").alias("image_id"), "o_orderkey", (2700.0 + F.col("o_custkey") % 400).alias("target"))
    out = X.nearest_channel(targets, fx.axis64(spark))
    return out.select("o_orderkey", "channel", rnd("axis_value", "axis_value"))


@query("interpolate_to_axis", """
SELECT image_id, component, t.channel, round(t.t, 6) AS axis_value,
  round(CASE WHEN t.t <= first_x THEN first_v WHEN t.t >= last_x THEN last_v ELSE x0v + (t.t - x0) / (x1 - x0) * (x1v - x0v) END, 6) AS value
FROM (
  SELECT c.image_id, c.component, t.channel, t.t,
    min(c.ax) AS first_x, arg_min(c.value, c.ax) AS first_v, max(c.ax) AS last_x, arg_max(c.value, c.ax) AS last_v,
    max(c.ax) FILTER (c.ax <= t.t) AS x0, arg_max(c.value, c.ax) FILTER (c.ax <= t.t) AS x0v,
    min(c.ax) FILTER (c.ax > t.t) AS x1, arg_min(c.value, c.ax) FILTER (c.ax > t.t) AS x1v
  FROM (SELECT 'emb' AS image_id, h.component, a.value + 7 AS ax, h.value FROM hk h JOIN axis64 a USING (channel)) c
  CROSS JOIN (SELECT CAST(range AS INT) AS channel, 2740 + 5.1::DOUBLE * range AS t FROM range(70)) t
  GROUP BY ALL) t""")
def _(spark, sf):
    axis = fx.axis64(spark)
    curves = fx.label_spectra(spark, sf).select(
        "image_id", "component", F.posexplode("spectrum").alias("channel", "value"))
    placed = curves.join(axis.select("channel", (F.col("value") + 7).alias("axis_value")), "channel").drop("channel")
    target = spark.range(70).select(F.lit("emb").alias("image_id"), F.col("id").cast("int").alias("channel"),
                                    (2740 + F.lit(5.1) * F.col("id")).alias("value"))
    out = X.interpolate_to_axis(placed, target, ["image_id", "component"])
    return out.select("image_id", "component", "channel", rnd("axis_value", "axis_value"), rnd("value", "value"))


@query("sort_axis", """
SELECT image_id, channel, value, CAST(row_number() OVER (PARTITION BY image_id ORDER BY value, channel) - 1 AS INT) AS sorted_channel
FROM (SELECT 'b' || CAST(p_size AS VARCHAR) AS image_id, CAST(p_partkey AS INT) AS channel, p_retailprice AS value FROM part)""")
def _(spark, sf):
    axis = fx.table(spark, sf, "part").select(F.concat(F.lit("b"), F.col("p_size")).alias("image_id"),
                                              F.col("p_partkey").cast("int").alias("channel"), F.col("p_retailprice").alias("value"))
    return X.sort_axis(axis)


@query("default_resonances", """
SELECT f.image_id, CAST(r.range AS INT) AS row,
  round(CASE WHEN f.m = 0 AND d.c BETWEEN lo AND hi THEN d.c WHEN f.m = 2 THEN round_even(q[r.range % 6 + 1], 0) ELSE q[r.range % 6 + 1] END, 6) AS center,
  round(CASE WHEN f.m = 0 AND d.c BETWEEN lo AND hi THEN d.w WHEN f.m = 2 THEN greatest(1, round_even(greatest(sp, 0.02::DOUBLE * (hi - lo)), 0)) ELSE greatest(sp, 0.02::DOUBLE * (hi - lo)) END, 6) AS width
FROM (SELECT image_id, m, min(value) AS lo, max(value) AS hi, median(d) AS sp,
        quantile_cont(value, [1/7::DOUBLE, 2/7::DOUBLE, 3/7::DOUBLE, 4/7::DOUBLE, 5/7::DOUBLE, 6/7::DOUBLE]) AS q
      FROM (SELECT image_id, m, value, value - lag(value) OVER (PARTITION BY image_id ORDER BY value) AS d FROM ax) GROUP BY ALL) f
CROSS JOIN range(8) r
JOIN (VALUES (0, 2850::DOUBLE, 20::DOUBLE), (1, 2930, 15), (2, 3000, 15), (3, 3060, 15), (4, 3120, 15), (5, 3180, 15)) d(i, c, w) ON d.i = r.range % 6""", """
ax AS (SELECT 's' || s_suppkey AS image_id, s_suppkey % 3 AS m,
   CASE s_suppkey % 3 WHEN 0 THEN 2800 + s_nationkey + 25.5::DOUBLE * range WHEN 1 THEN 500 + s_nationkey + 25.5::DOUBLE * range ELSE CAST(range AS DOUBLE) END AS value
   FROM supplier CROSS JOIN range(11))""")
def _(spark, sf):
    m = F.col("s_suppkey") % 3
    axis = fx.table(spark, sf, "supplier").withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(10)))).select(
        F.concat(F.lit("s"), "s_suppkey").alias("image_id"),
        F.when(m == 0, 2800 + F.col("s_nationkey") + F.lit(25.5) * F.col("id"))
        .when(m == 1, 500 + F.col("s_nationkey") + F.lit(25.5) * F.col("id")).otherwise(F.col("id").cast("double")).alias("value"),
        F.when(m == 0, "cm-1").when(m == 1, "nm").otherwise("index").alias("unit"),
    )
    out = X.default_resonances(axis, 8)
    return out.select("image_id", "row", rnd("center", "center"), rnd("width", "width"))
