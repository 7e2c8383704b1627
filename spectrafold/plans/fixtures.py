"""Image tables derived from the provided tables, in Spark and as the same text for the SQL side.

* ``emb``: ``embeddings`` as one image, 25 pixels wide, 64 channels; ``emb4`` splits it in five slices.
* ``ord``: ``lineitem`` as a corpus of 64 x 64 images, one order per pixel, line numbers as 7 channels.
* ``li``: ``lineitem`` folded onto one 64 x 64 image of 7 channels.
* ``ev``: ``events`` as spectra of 5 channels per user and day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..tables import to_pixels

SQL_VIEWS = """
pix AS (
  SELECT 'emb' AS image_id, 0 AS slice_id, CAST(vec_id // 25 AS INT) AS y, CAST(vec_id % 25 AS INT) AS x, label,
         list_transform(embedding, lambda v: greatest(v::DOUBLE, 0)) AS spectrum,
         list_transform(embedding, lambda v: v::DOUBLE) AS rawspec
  FROM embeddings),
vox AS (
  SELECT image_id, slice_id, y, x, label, CAST(unnest(range(len(spectrum))) AS INT) AS channel,
         unnest(spectrum) AS value, unnest(rawspec) AS raw FROM pix),
pix4 AS (
  SELECT 'emb' AS image_id, CAST(vec_id % 5 AS INT) AS slice_id, CAST((vec_id // 5) // 10 AS INT) AS y,
         CAST((vec_id // 5) % 10 AS INT) AS x, label,
         list_transform(embedding, lambda v: greatest(v::DOUBLE, 0)) AS spectrum
  FROM embeddings),
vox4 AS (
  SELECT image_id, slice_id, y, x, label, CAST(unnest(range(len(spectrum))) AS INT) AS channel,
         unnest(spectrum) AS value FROM pix4),
ordvox0 AS (
  SELECT 'o' || CAST(l_orderkey // 4096 AS VARCHAR) AS image_id, 0 AS slice_id,
         CAST((l_orderkey // 64) % 64 AS INT) AS y, CAST(l_orderkey % 64 AS INT) AS x,
         CAST(l_linenumber - 1 AS INT) AS channel, sum(l_quantity) AS value
  FROM lineitem GROUP BY ALL),
ordpix0 AS (SELECT DISTINCT image_id, slice_id, y, x FROM ordvox0),
ordvox AS (
  SELECT p.image_id, p.slice_id, p.y, p.x, CAST(c.range AS INT) AS channel, coalesce(v.value, 0) AS value
  FROM ordpix0 p CROSS JOIN range(7) c
  LEFT JOIN ordvox0 v ON v.image_id = p.image_id AND v.y = p.y AND v.x = p.x AND v.channel = c.range),
ordpix AS (
  SELECT image_id, slice_id, y, x, list(value ORDER BY channel) AS spectrum FROM ordvox GROUP BY ALL),
livox AS (
  SELECT 'li' AS image_id, 0 AS slice_id, CAST(l_orderkey % 64 AS INT) AS y, CAST(l_partkey % 64 AS INT) AS x,
         CAST(l_linenumber - 1 AS INT) AS channel, sum(l_quantity) AS value
  FROM lineitem GROUP BY ALL),
evvox AS (
  SELECT 'ev' || CAST(user_id % 4 AS VARCHAR) AS image_id, CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS INT) AS slice_id,
         CAST(user_id // 16 AS INT) AS y, CAST(user_id % 16 AS INT) AS x,
         CAST(list_position(['click','error','purchase','signup','view'], event_type) - 1 AS INT) AS channel, value
  FROM events),
axis64 AS (SELECT 'emb' AS image_id, CAST(range AS INT) AS channel, 2750 + 300.0::DOUBLE * range / 63 AS value, 'cm⁻¹' AS unit FROM range(64)),
rois AS (
  SELECT 'emb' AS image_id, * FROM (VALUES
   (0, 'RectROI', 0::DOUBLE, 0::DOUBLE, 5::DOUBLE, 5::DOUBLE, 0, false, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 'a'),
   (1, 'RectROI', 10, 4, 6, 3, 1, false, 2.0, 0.1, 0.0, 'b'),
   (2, 'RectROI', 20, 15, 5, 5, 2, true, 1.0, 0.0, 0.0, 'c'),
   (3, 'RectROI', 6, 8, 2, 2, 0, false, 1.0, 0.0, 1.0, 'd'),
   (4, 'EllipseROI', 2, 9, 8, 6, 1, false, 1.0, 0.0, 0.0, 'e'),
   (5, 'RectROI', 23, 18, 6, 6, 2, true, 1.0, 0.0, 0.0, 'f'))
  AS t(roi_id, shape, x0, y0, w, h, component, background, scale, off, sigma, name)),
resonances AS (
  SELECT 'emb' AS image_id, * FROM (VALUES
   (0, 0, 2850::DOUBLE, 20::DOUBLE, 10, NULL::DOUBLE, true, false, 65535::DOUBLE),
   (1, 1, 2930, 15, 0, 0.7, false, false, 65535),
   (2, 1, 2965, 24, 0, 0.5, false, false, 65535),
   (3, 2, 5000, 1, 5, NULL, true, true, 100))
  AS t(resonance_id, component, center, width, n_pixels, threshold, use_subtracted, use_gaussian, amplitude)),
hk AS (SELECT CAST(label AS INT) AS component, channel, avg(value) AS value FROM vox GROUP BY ALL),
hkw AS (SELECT component, list(value ORDER BY channel) AS h FROM hk GROUP BY ALL),
meta AS (SELECT image_id, max(y) + 1 AS ny, max(x) + 1 AS nx FROM pix GROUP BY ALL)
"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pixels_emb(spark: SparkSession, sf: str, clamp: bool = True) -> DataFrame:
    value = (lambda v: F.greatest(v.cast("double"), F.lit(0.0))) if clamp else (lambda v: v.cast("double"))
    return table(spark, sf, "embeddings").select(
        F.lit("emb").alias("image_id"), F.lit(0).alias("slice_id"),
        F.expr("CAST(vec_id div 25 AS INT)").alias("y"), F.expr("CAST(vec_id % 25 AS INT)").alias("x"),
        F.transform("embedding", value).alias("spectrum"), "label",
    )


def pixels_emb4d(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.lit("emb").alias("image_id"), F.expr("CAST(vec_id % 5 AS INT)").alias("slice_id"),
        F.expr("CAST((vec_id div 5) div 10 AS INT)").alias("y"), F.expr("CAST((vec_id div 5) % 10 AS INT)").alias("x"),
        F.transform("embedding", lambda v: F.greatest(v.cast("double"), F.lit(0.0))).alias("spectrum"), "label",
    )


def voxels_ord(spark: SparkSession, sf: str) -> DataFrame:
    """Raw voxels of the order corpus, not summed and not filled."""
    return table(spark, sf, "lineitem").select(
        F.expr("concat('o', CAST(l_orderkey div 4096 AS STRING))").alias("image_id"), F.lit(0).alias("slice_id"),
        F.expr("CAST((l_orderkey div 64) % 64 AS INT)").alias("y"), F.expr("CAST(l_orderkey % 64 AS INT)").alias("x"),
        (F.col("l_linenumber") - 1).cast("int").alias("channel"), F.col("l_quantity").alias("value"),
    )


def pixels_ord(spark: SparkSession, sf: str) -> DataFrame:
    return to_pixels(voxels_ord(spark, sf), 7)


def voxels_li(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(
        F.lit("li").alias("image_id"), F.lit(0).alias("slice_id"),
        F.expr("CAST(l_orderkey % 64 AS INT)").alias("y"), F.expr("CAST(l_partkey % 64 AS INT)").alias("x"),
        (F.col("l_linenumber") - 1).cast("int").alias("channel"),
    ).agg(F.sum("l_quantity").alias("value"))


EVENT_CHANNELS = ["click", "error", "purchase", "signup", "view"]


def voxels_ev(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in EVENT_CHANNELS])
    return table(spark, sf, "events").select(
        F.expr("concat('ev', CAST(user_id % 4 AS STRING))").alias("image_id"),
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("slice_id"),
        F.expr("CAST(user_id div 16 AS INT)").alias("y"), F.expr("CAST(user_id % 16 AS INT)").alias("x"),
        (F.array_position(names, F.col("event_type")) - 1).cast("int").alias("channel"), "value", "ts",
    )


def axis64(spark: SparkSession) -> DataFrame:
    return spark.range(64).select(
        F.lit("emb").alias("image_id"), F.col("id").cast("int").alias("channel"),
        (2750 + F.lit(300.0) * F.col("id") / 63).alias("value"), F.lit("cm⁻¹").alias("unit"),
        F.lit(None).cast("string").alias("label"),
    )


def rois(spark: SparkSession) -> DataFrame:
    rows = [
        ("emb", 0, "RectROI", 0.0, 0.0, 5.0, 5.0, 0.0, 0, False, False, 1.0, 0.0, 0.0, True, "a"),
        ("emb", 1, "RectROI", 10.0, 4.0, 6.0, 3.0, 0.0, 1, False, False, 2.0, 0.1, 0.0, True, "b"),
        ("emb", 2, "RectROI", 20.0, 15.0, 5.0, 5.0, 0.0, 2, True, True, 1.0, 0.0, 0.0, True, "c"),
        ("emb", 3, "RectROI", 6.0, 8.0, 2.0, 2.0, 0.0, 0, False, False, 1.0, 0.0, 1.0, True, "d"),
        ("emb", 4, "EllipseROI", 2.0, 9.0, 8.0, 6.0, 0.0, 1, False, False, 1.0, 0.0, 0.0, True, "e"),
        ("emb", 5, "RectROI", 23.0, 18.0, 6.0, 6.0, 0.0, 2, True, False, 1.0, 0.0, 0.0, True, "f"),
    ]
    from ..tables import ROIS

    return spark.createDataFrame(rows, ROIS)


def resonances(spark: SparkSession) -> DataFrame:
    rows = [
        ("emb", 0, 0, 2850.0, 20.0, None, 10, True, False, 65535.0),
        ("emb", 1, 1, 2930.0, 15.0, 0.7, 0, False, False, 65535.0),
        ("emb", 2, 1, 2965.0, 24.0, 0.5, 0, False, False, 65535.0),
        ("emb", 3, 2, 5000.0, 1.0, None, 5, True, True, 100.0),
    ]
    return spark.createDataFrame(
        rows,
        "image_id STRING, resonance_id INT, component INT, center DOUBLE, width DOUBLE, threshold DOUBLE, "
        "n_pixels INT, use_subtracted BOOLEAN, use_gaussian BOOLEAN, amplitude DOUBLE",
    )


def label_spectra(spark: SparkSession, sf: str, k: int | None = None) -> DataFrame:
    """Reference spectra: the mean spectrum of every label, components 0..k-1."""
    from ..operators.stats import mean_spectrum

    pixels = pixels_emb(spark, sf)
    if k is not None:
        pixels = pixels.filter(F.col("label") < k)
    return mean_spectrum(pixels.withColumn("component", F.col("label").cast("int")), ["image_id", "component"])


def image_meta(pixels: DataFrame) -> DataFrame:
    from ..tables import image_shape

    return image_shape(pixels)
