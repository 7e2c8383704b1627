"""Structured Streaming operators: spectra are unmixed, assembled and checked as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions import arrays as A
from ..operators.condition import subtract_background
from ..operators.rois import line_weights, pixels_in_roi, roi_background
from ..operators.stats import relative_error
from ..operators.unmix import nnls_fixed_h
from ..scale import SALTS, join_dim
from ..tables import FIELD, PIXEL


def stream_unmix(spectra_stream: DataFrame, spectra: DataFrame, *, column: str = "spectrum", keep: list[str] | None = None) -> DataFrame:
    """Fixed-spectrum abundances of arriving spectra. Stateless, so it runs in append mode without a
    watermark and gives what the batch job gives."""
    return nnls_fixed_h(spectra_stream, spectra, column=column, keep=keep)


def stream_assemble_spectra(voxel_events: DataFrame, n_channels: int, *, ts: str = "ts", window: str = "1 day",
                            watermark: str = "1 hour", keys: list[str] | None = None) -> DataFrame:
    """Voxel events to one spectrum per pixel and tumbling window; channel sums are the only state.

    Events later than the watermark are dropped, a window is emitted when the watermark passes its end.
    """
    keys = keys or PIXEL
    cells = [F.sum(F.when(F.col("channel") == c, F.col("value")).otherwise(0.0)) for c in range(n_channels)]
    return (
        voxel_events.withWatermark(ts, watermark)
        .groupBy(F.window(ts, window).alias("window"), *keys)
        .agg(F.array(*cells).alias("spectrum"), F.count(F.lit(1)).alias("n_events"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "spectrum", "n_events")
    )


def stream_fit_error(fitted_stream: DataFrame, *, ts: str = "ts", window: str = "1 day", watermark: str = "1 hour",
                     keys: list[str] | None = None) -> DataFrame:
    """Residual and data norm of fitted spectra (``spectrum``, ``model``) per window."""
    keys = keys or ["image_id"]
    squares = A.sum_squares(F.zip_with("spectrum", "model", lambda a, b: a - b))
    sums = (
        fitted_stream.withWatermark(ts, watermark)
        .groupBy(F.window(ts, window).alias("window"), *keys)
        .agg(F.sum(squares).alias("_r"), F.sum(A.sum_squares("spectrum")).alias("_x"), F.count(F.lit(1)).alias("n_pixels"))
    )
    return sums.select(
        F.col("window.start").alias("start"), *keys, "n_pixels",
        F.sqrt("_r").alias("final_error"), F.sqrt("_x").alias("data_norm"),
    ).withColumn("relative_error", relative_error("final_error", "data_norm"))


def stream_background_subtract(pixel_stream: DataFrame, rois: DataFrame, sink: Callable[[DataFrame, int], None]):
    """Writer that subtracts the background region of each slice inside every micro-batch.

    The region mean needs the whole slice, so a slice must arrive in one micro-batch (one file per slice);
    ``stream_subtract_slices`` takes slices in any number of pieces. Returns a stream writer; the caller sets its
    trigger and checkpoint and starts it.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        sink(subtract_background(batch, roi_background(batch, rois)), epoch)

    return pixel_stream.writeStream.foreachBatch(handle)


def stream_slice_background(pixel_stream: DataFrame, rois: DataFrame, n_channels: int, *, window: str) -> DataFrame:
    """Background spectrum of every slice and time window: the mean over the regions that are to be subtracted.

    ``pixel_stream`` has ``ts`` under a watermark. The state holds channel sums per region, then per slice; a window
    comes out when the watermark passes its end.
    """
    wanted = rois.filter("subtract")
    line = F.col("shape").eqNullSafe(F.lit("LineROI"))
    raw = pixel_stream.select("ts", *PIXEL, "spectrum")
    cols = ["ts", *FIELD, "roi_id", "spectrum", "_w"]
    inside = pixels_in_roi(raw, wanted.filter(~line)).withColumn("_w", F.lit(1.0)).select(cols)
    on_line = join_dim(raw, line_weights(wanted.filter(line)), ["image_id", "y", "x"]).select(cols)
    each = lambda f: F.array(*[f(F.get("spectrum", F.lit(c))) for c in range(n_channels)])
    curves = (
        inside.unionByName(on_line).groupBy(F.window("ts", window).alias("window"), *FIELD, "roi_id")
        .agg(each(lambda v: F.sum(F.col("_w") * v) / F.sum(F.when(v.isNotNull(), F.col("_w")))).alias("spectrum"))
    )
    info = wanted.select("image_id", "roi_id", F.coalesce("offset", F.lit(0.0)).alias("_o"), F.coalesce("scale", F.lit(1.0)).alias("_s"),
                         F.coalesce(F.col("smooth_sigma").cast("double"), F.lit(0.0)).alias("_sigma"))
    known = join_dim(curves, info, ["image_id", "roi_id"])
    shifted = F.transform("spectrum", lambda v: F.greatest(v + F.col("_o"), F.lit(0.0)) * F.col("_s"))
    smooth = known.withColumn("spectrum", A.let(shifted, lambda v: A.smooth_by(v, F.col("_sigma"))))
    return smooth.groupBy("window", *FIELD).agg(each(F.avg).alias("spectrum"))


def stream_subtract_slices(pixel_stream: DataFrame, rois: DataFrame, n_channels: int, *, ts: str = "ts", window: str = "1 day",
                           watermark: str = "1 hour", salts: int = SALTS) -> DataFrame:
    """Background subtraction of slices that arrive in any number of micro-batches.

    All pixels of a slice lie in one window of event time. They wait in the state of a join until the watermark passes the
    window and its background is known; a slice without a background region comes out with a null ``spectrum_sub``. Pixels wait under ``salts`` keys a slice,
    so one large slice fills many tasks; what is repeated is one spectrum per salt. Pixels later than the watermark are dropped.
    """
    pixels = pixel_stream.withColumn("ts", F.col(ts)).withWatermark("ts", watermark)
    background = stream_slice_background(pixels, rois, n_channels, window=window)
    side = background.select(F.col("window").alias("_window"), *[F.col(k).alias(f"_{k}") for k in FIELD], F.col("spectrum").alias("_background"),
                             F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_of"))
    # the window alone is the event time of the join; the time itself travels as a plain value
    waiting = pixels.select(F.window("ts", window).alias("window"), F.timestamp_micros(F.unix_micros("ts")).alias("ts"), *PIXEL, "spectrum",
                            F.pmod(F.xxhash64("y", "x"), F.lit(salts)).cast("int").alias("_salt"))
    same = (F.col("window") == F.col("_window")) & (F.col("_salt") == F.col("_of"))
    for k in FIELD:
        same = same & (F.col(k) == F.col(f"_{k}"))
    less = F.zip_with("spectrum", "_background", lambda v, b: F.when(v - b <= 0, F.lit(A.DOUBLE_EPS)).otherwise(v - b))
    return waiting.join(side, same, "left").select("ts", *PIXEL, "spectrum", less.alias("spectrum_sub"))
