"""Queries that run the streaming operators over the tables as streams until all input is read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import unmix as U
from ..scale import shared_dir
from ..streaming import streams as M
from ..tables import FIELD, PIXEL
from . import fixtures as fx
from .registry import query
from .sourcing import rnd


def read_stream(spark, sf, name):
    """A table as a stream, whether it is one file or a folder of part files."""
    held = fx.table(spark, sf, name)
    stream = spark.readStream.schema(held.schema)
    if any(path.endswith(f"/{name}.parquet") for path in held.inputFiles()):  # a stream reads folders only
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf)
    return stream.parquet(f"{sf}/{name}.parquet")


def drain(df, spark):
    """Run a stream over everything that is there and read what it wrote."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = (df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def event_voxels(df):
    names = F.array(*[F.lit(n) for n in fx.EVENT_CHANNELS])
    return df.select(
        F.expr("concat('ev', CAST(user_id % 4 AS STRING))").alias("image_id"), F.lit(0).alias("slice_id"),
        F.expr("CAST(user_id div 16 AS INT)").alias("y"), F.expr("CAST(user_id % 16 AS INT)").alias("x"),
        (F.array_position(names, F.col("event_type")) - 1).cast("int").alias("channel"), "value", F.col("ts").cast("timestamp").alias("ts"))


ASM_SQL = """
ewin AS (SELECT image_id, y, x, slice_id AS day, channel, value FROM evvox WHERE slice_id < date_diff('day', TIMESTAMP '2024-01-01', (SELECT max(ts) - INTERVAL 1 HOUR FROM events))),
asm AS (SELECT day, image_id, y, x, c.range AS channel, coalesce(sum(value) FILTER (e.channel = c.range), 0) AS value FROM ewin e, range(5) c GROUP BY ALL)"""


@query("stream_assemble_spectra", "SELECT CAST(day AS INT) AS day, image_id, y, x, CAST(channel AS INT) AS channel, round(value, 6) AS value FROM asm", ASM_SQL)
def _(spark, sf):
    out = drain(M.stream_assemble_spectra(event_voxels(read_stream(spark, sf, "events")), 5), spark)
    return out.select(F.datediff("start", F.lit("2024-01-01")).alias("day"), "image_id", "y", "x",
                      F.posexplode("spectrum").alias("channel", "value")).withColumn("value", rnd("value"))


@query("stream_unmix", """
SELECT image_id, slice_id, y, x, round(greatest(sum(v.value * h.value) / (any_value(hh) + 1e-8), 0), 6) AS w FROM vox v
JOIN (SELECT channel, value, sum(value * value) OVER () AS hh FROM hk WHERE component = 0) h USING (channel) GROUP BY ALL""")
def _(spark, sf):
    stream = read_stream(spark, sf, "embeddings").select(
        F.lit("emb").alias("image_id"), F.lit(0).alias("slice_id"), F.expr("CAST(vec_id div 25 AS INT)").alias("y"),
        F.expr("CAST(vec_id % 25 AS INT)").alias("x"), F.transform("embedding", lambda v: F.greatest(v.cast("double"), F.lit(0.0))).alias("spectrum"))
    out = drain(M.stream_unmix(stream, fx.label_spectra(spark, sf, 1)), spark)
    return out.select(*PIXEL, rnd(F.element_at("w", 1), "w"))


@query("stream_fit_error", """
SELECT CAST(slice_id AS INT) AS day, image_id, count(*) AS n_pixels, round(sqrt(sum((value - m) ** 2)), 6) AS final_error, round(sqrt(sum(value ** 2)), 6) AS data_norm
FROM (SELECT slice_id, image_id, value, value * 0.5::DOUBLE + channel AS m FROM evvox WHERE slice_id < date_diff('day', TIMESTAMP '2024-01-01', (SELECT max(ts) - INTERVAL 1 HOUR FROM events))) GROUP BY ALL""")
def _(spark, sf):
    v = event_voxels(read_stream(spark, sf, "events"))
    fitted = v.select("image_id", "ts", F.array("value").alias("spectrum"), F.array(F.col("value") * 0.5 + F.col("channel")).alias("model"))
    out = drain(M.stream_fit_error(fitted), spark)
    return out.select(F.datediff("start", F.lit("2024-01-01")).alias("day"), "image_id", "n_pixels", rnd("final_error", "final_error"), rnd("data_norm", "data_norm"))


@query("stream_background_subtract", """
SELECT image_id, slice_id, y, x, round(sum(s), 6) AS total FROM (
  SELECT v.image_id, v.slice_id, v.y, v.x, CASE WHEN v.value - b <= 0 THEN 2.220446049250313e-16 ELSE v.value - b END AS s
  FROM vox v JOIN (SELECT channel, avg(value) AS b FROM vox WHERE x >= 20 AND x < 25 AND y >= 15 AND y < 20 GROUP BY ALL) USING (channel)) GROUP BY ALL""")
def _(spark, sf):
    stream = read_stream(spark, sf, "embeddings").select(
        F.lit("emb").alias("image_id"), F.lit(0).alias("slice_id"), F.expr("CAST(vec_id div 25 AS INT)").alias("y"),
        F.expr("CAST(vec_id % 25 AS INT)").alias("x"), F.transform("embedding", lambda v: F.greatest(v.cast("double"), F.lit(0.0))).alias("spectrum"))
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = M.stream_background_subtract(stream, fx.rois(spark), lambda df, epoch: df.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}"))
    writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    total = F.aggregate("spectrum_sub", F.lit(0.0), lambda a, v: a + v)
    return out.select(*PIXEL, rnd(total, "total"))


@query("stream_subtract_slices", """
SELECT image_id, slice_id, y, x, round(sum(CASE WHEN value - b <= 0 THEN 2.220446049250313e-16 ELSE value - b END), 6) AS total
FROM vox4 JOIN back USING (slice_id, channel) WHERE slice_id < 4 GROUP BY ALL""", """
back AS (SELECT slice_id, channel, avg(m) AS b FROM (
  SELECT slice_id, roi, channel, greatest(avg(value) + off, 0) * sc AS m FROM vox4
  JOIN (VALUES (0, 0, 3, 0.1::DOUBLE, 2::DOUBLE), (1, 4, 6, -0.01, 1)) r(roi, xa, xb, off, sc) ON x >= xa AND x < xb AND y < 2 GROUP BY slice_id, roi, channel, off, sc) GROUP BY ALL)""")
def _(spark, sf):
    wide = spark.createDataFrame([(0, 0.0, 3.0, 0.1, 2.0), (1, 4.0, 2.0, -0.01, 1.0)], "roi_id INT, x0 DOUBLE, w DOUBLE, offset DOUBLE, scale DOUBLE")
    regions = wide.selectExpr("'emb' AS image_id", "roi_id", "'RectROI' AS shape", "x0", "CAST(0 AS DOUBLE) AS y0", "w", "CAST(2 AS DOUBLE) AS h", "0 AS component", "true AS background",
                              "scale", "offset", "CAST(0 AS DOUBLE) AS smooth_sigma", "true AS subtract", "CAST(0 AS DOUBLE) AS angle")
    stream = read_stream(spark, sf, "embeddings").select(
        F.lit("emb").alias("image_id"), F.expr("CAST(vec_id % 5 AS INT)").alias("slice_id"), F.expr("CAST((vec_id div 5) div 10 AS INT)").alias("y"),
        F.expr("CAST((vec_id div 5) % 10 AS INT)").alias("x"), F.transform("embedding", lambda v: F.greatest(v.cast("double"), F.lit(0.0))).alias("spectrum"),
        F.expr("timestamp_seconds(1704074400 + (vec_id % 5) * 86400)").alias("ts"))
    out = drain(M.stream_subtract_slices(stream, regions, 64), spark)
    return out.select(*PIXEL, rnd(A.total("spectrum_sub"), "total"))
