"""Intensity conditioning: dtype ranges, cleaning, standardising, scaling, background subtraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays as A
from ..scale import join_dim, join_stats
from ..tables import FIELD, PIXEL

UINT16_MAX = 65535.0


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def to_uint16(pixels: DataFrame, is_float: bool, column: str = "spectrum", keys: list[str] | None = None) -> DataFrame:
    """Bring every image into 0..65535 without wrapping.

    The finite range of the image decides: negatives shift the image up, floating images are scaled
    to the full range, integer images only when they overflow. NaN and -inf become 0, +inf the maximum.
    """
    keys = keys or ["image_id"]
    finite = F.filter(F.col(column), _finite)
    stats = pixels.groupBy(*keys).agg(
        F.min(F.array_min(finite)).alias("_low"), F.max(F.array_max(finite)).alias("_high")
    )
    joined = join_stats(pixels, stats, keys)
    shift = F.least(F.coalesce("_low", F.lit(0.0)), F.lit(0.0))
    top = F.coalesce("_high", F.lit(0.0)) - shift
    scale = F.lit(1.0) if not is_float else F.lit(UINT16_MAX) / F.col("_top")
    if not is_float:
        scale = F.when(F.col("_top") <= UINT16_MAX, F.lit(1.0)).otherwise(F.lit(UINT16_MAX) / F.col("_top"))

    def convert(v):
        lifted = (
            F.when(v == F.lit(float("inf")), F.col("_top"))
            .when(_finite(v), v - F.col("_shift"))
            .otherwise(F.lit(0.0))
        )
        return F.least(F.greatest(lifted * scale, F.lit(0.0)), F.lit(UINT16_MAX)).cast("int")

    zeros = F.transform(F.col(column), lambda v: F.lit(0))
    out = F.when(F.col("_top") > 0, F.transform(F.col(column), convert)).otherwise(zeros)
    return (
        joined.withColumn("_shift", shift).withColumn("_top", top)
        .withColumn(column, out).drop("_low", "_high", "_shift", "_top")
    )


def complex_magnitude(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)


def nan_to_zero(pixels: DataFrame, column: str = "spectrum") -> DataFrame:
    return pixels.withColumn(column, A.nan_to_zero(column))


def clamp_nonneg(pixels: DataFrame, column: str = "spectrum") -> DataFrame:
    return pixels.withColumn(column, A.clamp_nonneg(column))


def normalize_dynamic_range(pixels: DataFrame, dtype_max: float = UINT16_MAX, column: str = "spectrum",
                            keys: list[str] | None = None) -> DataFrame:
    """Stretch each image so that its largest value is ``dtype_max``; an all-zero image is kept."""
    keys = keys or ["image_id"]
    stats = pixels.groupBy(*keys).agg(F.max(F.array_max(A.nan_to_zero(column))).alias("_peak"))
    factor = F.when(F.col("_peak") > 0, F.lit(float(dtype_max)) / F.col("_peak")).otherwise(F.lit(1.0))
    joined = join_stats(pixels, stats, keys)
    return joined.withColumn(column, F.transform(F.col(column), lambda v: v * factor)).drop("_peak")


def channel_moments(voxels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """NaN-aware mean and a population deviation that NaN poisons, per channel.

    Merging partial moments rounds, so equal values are known by their ends: their deviation is 0 exactly.
    """
    keys = keys or FIELD
    v = F.col("value")
    real = F.when(~F.isnan(v), v)
    return voxels.groupBy(*keys, "channel").agg(
        F.avg(real).alias("mean"),
        F.when(F.min(real) == F.max(real), F.lit(0.0)).otherwise(F.stddev_pop(real)).alias("std"),
        (F.count_if(F.isnan(v) | v.isNull()) > 0).alias("has_nan"),
    )


def kept_channels(moments: DataFrame) -> DataFrame:
    """Channels that survive standardising: no NaN and a positive deviation."""
    return moments.filter((F.col("std") > 0) & ~F.col("has_nan"))


def standardize_channels(voxels: DataFrame, drop_nan_channels: bool = True, keys: list[str] | None = None) -> DataFrame:
    """(v - mean) / population std per channel; degenerate channels are dropped or become NULL."""
    keys = keys or FIELD
    moments = channel_moments(voxels, keys)
    usable = kept_channels(moments).select(*keys, "channel", "mean", "std")
    how = "inner" if drop_nan_channels else "left"
    joined = join_stats(voxels, usable, [*keys, "channel"], how)
    return joined.withColumn("value", (F.col("value") - F.col("mean")) / F.col("std")).drop("mean", "std")


def unity_scale(maps: DataFrame, column: str = "w", keys: list[str] | None = None, eps: float = A.EPS) -> DataFrame:
    """Scale one value column per group to a maximum of 1, lifted to ``eps`` first."""
    keys = keys or [*FIELD, "component"]
    lifted = maps.withColumn(column, F.greatest(A.finite_or_zero(F.col(column)), F.lit(eps)))
    stats = lifted.groupBy(*keys).agg(F.max(column).alias("_peak"))
    out = F.when(F.col("_peak") <= eps, F.lit(eps)).otherwise(F.col(column) / F.col("_peak"))
    return join_stats(lifted, stats, keys).withColumn(column, out).drop("_peak")


def scale_h_to_unity(spectra: DataFrame, column: str = "spectrum", eps: float = A.EPS) -> DataFrame:
    """Each spectrum divided by its maximum; the divisor is kept as ``scale_factor``."""
    clean = A.clamp_nonneg(column)
    factor = F.when(F.array_max(clean) > eps, F.array_max(clean)).otherwise(F.lit(1.0))
    return (
        spectra.withColumn("scale_factor", factor)
        .withColumn(column, F.transform(clean, lambda v: v / F.col("scale_factor")))
    )


def prepare_fixed_h(spectra: DataFrame, column: str = "spectrum", eps: float = A.EPS) -> DataFrame:
    return spectra.withColumn(column, A.prepare_fixed(column, eps))


def column_seeded(maps: DataFrame, column: str = "w", keys: list[str] | None = None) -> DataFrame:
    """Per component map: no negative entry and at least one positive entry."""
    keys = keys or ["image_id", "component"]
    return maps.groupBy(*keys).agg(
        (F.bool_and(F.col(column) >= 0) & F.bool_or(F.col(column) > 0)).alias("seeded")
    )


def has_complete_seed_set(seeds: DataFrame, k: int, eps: float = A.EPS) -> DataFrame:
    """Per image: are all components 0..k-1 present with a usable spectrum?"""
    usable = A.has_signal("spectrum", eps) & A.prepare_fixed("spectrum", eps).isNotNull()
    inside = F.col("component").between(0, k - 1)
    return seeds.groupBy("image_id").agg(
        (F.count_distinct(F.when(usable & inside, F.col("component"))) == k).alias("complete")
    )


def split_active(pixels: DataFrame, eps: float = A.EPS, column: str = "spectrum") -> tuple[DataFrame, DataFrame]:
    """Pixels with any channel above ``eps``, and the rest."""
    active = A.is_active(column, eps)
    return pixels.filter(active), pixels.filter(~active)


def select_channels(pixels: DataFrame, channels: list[int], column: str = "spectrum") -> DataFrame:
    return pixels.withColumn(column, A.take(column, channels))


def frame(pixels: DataFrame, channel: int, column: str = "spectrum") -> DataFrame:
    return pixels.select(*PIXEL, F.element_at(column, channel + 1).alias("value"))


def select_slice(pixels: DataFrame, index: int, n_slices: int) -> DataFrame:
    """One slice, the index clipped to the range; reaches the scan as a partition filter."""
    return pixels.filter(F.col("slice_id") == max(0, min(int(index), n_slices - 1)))


def sub_band(channel: Column, n_channels: Column | int, n_bands: int) -> Column:
    """Band of a channel among ``n_bands`` equal bands; the last one takes the remainder."""
    n = n_channels if isinstance(n_channels, Column) else F.lit(int(n_channels))
    size = F.greatest(F.floor(n / n_bands), F.lit(1))
    return F.least(F.floor(channel / size), F.lit(n_bands - 1)).cast("int")


def minmax_to_dtype(maps: DataFrame, column: str, keys: list[str], dtype_max: float = UINT16_MAX) -> DataFrame:
    stats = maps.groupBy(*keys).agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    span = F.col("_high") - F.col("_low")
    out = F.when(span > 0, (F.col(column) - F.col("_low")) / span * dtype_max).otherwise(F.lit(0.0))
    return join_stats(maps, stats, keys).withColumn(column, out).drop("_low", "_high")


def scale_w_uint16(abundance: DataFrame, column: str = "w", keys: list[str] | None = None) -> DataFrame:
    """One factor per image for all components, so their ratios survive; truncated integers."""
    keys = keys or FIELD
    stats = abundance.groupBy(*keys).agg(F.max(F.array_max(A.nan_to_zero(column))).alias("_peak"))
    factor = F.when(F.col("_peak") > 0, F.lit(UINT16_MAX) / F.col("_peak")).otherwise(F.lit(1.0))
    clip = lambda v: F.least(F.greatest(A.finite_or_zero(v) * factor, F.lit(0.0)), F.lit(UINT16_MAX)).cast("int")
    return join_stats(abundance, stats, keys).withColumn(column, F.transform(column, clip)).drop("_peak")


def subtract_background(pixels: DataFrame, background: DataFrame, keys: list[str] | None = None,
                        column: str = "spectrum", out: str = "spectrum_sub") -> DataFrame:
    """Subtract one background spectrum per image or slice; anything not above 0 becomes a tiny positive."""
    keys = keys or FIELD
    side = background.select(*keys, F.col("spectrum").alias("_background"))
    diff = F.zip_with(
        column, "_background",
        lambda v, b: F.when(v - b <= 0, F.lit(A.DOUBLE_EPS)).otherwise(v - b),
    )
    return join_dim(pixels, side, keys, "left").withColumn(out, diff).drop("_background")


def choose_source(background: Column, n_rows: Column, any_subtracted: Column, has_subtracted: Column) -> Column:
    """``raw`` or ``subtracted`` for a component, from its flags and its resonance rows."""
    return (
        F.when(~has_subtracted | background, "raw")
        .when(F.coalesce(n_rows, F.lit(0)) == 0, "subtracted")
        .when(any_subtracted, "subtracted")
        .otherwise("raw")
    )


def source_spectrum(source: Column) -> Column:
    return F.when(source == "subtracted", F.coalesce("spectrum_sub", "spectrum")).otherwise(F.col("spectrum"))


def resize_seed_set(seeds: DataFrame, k: int, n_channels: int) -> DataFrame:
    """Exactly components 0..k-1 per image; new ones are zero spectra without the background flag."""
    slots = seeds.select("image_id").distinct().withColumn("component", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    zeros = F.array_repeat(F.lit(0.0), n_channels)
    return slots.join(seeds, ["image_id", "component"], "left").select(
        "image_id", "component",
        F.coalesce("spectrum", zeros).alias("spectrum"),
        F.coalesce("background", F.lit(False)).alias("background"),
    )


def scale_spectra_to_dtype(spectra: DataFrame, dtype_max: int = 65535, column: str = "spectrum") -> DataFrame:
    def convert(v):
        whole = F.transform(v, lambda e: e.cast("int"))
        return A.let(F.array_max(v), lambda top: F.when(
            top > 0, F.transform(v, lambda e: (e / top * F.lit(float(dtype_max))).cast("int"))).otherwise(whole))

    return spectra.withColumn(column, A.let(F.col(column), convert))
