"""Aggregates over channels, pixels, components and slices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays as A
from ..scale import clustered, exact_percentile, join_dim, join_stats, materialize
from ..tables import FIELD, PIXEL
from ._dense import partial_sums


def project_spectral(pixels: DataFrame, mode: str = "avg", column: str = "spectrum") -> DataFrame:
    """Collapse the channels of every pixel; row-local."""
    pick = {"avg": A.mean, "max": F.array_max, "min": F.array_min}
    if mode not in pick:
        raise ValueError(f"unknown projection {mode!r}")
    return pixels.select(*PIXEL, pick[mode](F.col(column)).alias("value"))


def spatial_bin(voxels: DataFrame, n: int, meta: DataFrame | None = None, crop: bool = True) -> DataFrame:
    """Mean of n x n blocks per channel; incomplete blocks at the far edges are dropped."""
    data = voxels
    if crop:
        if meta is None:
            raise ValueError("cropping needs the image shape")
        side = meta.select("image_id", "ny", "nx")
        data = join_dim(voxels, side, ["image_id"]).filter(
            (F.col("y") < F.floor(F.col("ny") / n) * n) & (F.col("x") < F.floor(F.col("nx") / n) * n)
        )
    return data.groupBy(
        *FIELD, F.floor(F.col("y") / n).cast("int").alias("y"), F.floor(F.col("x") / n).cast("int").alias("x"), "channel"
    ).agg(F.avg("value").alias("value"))


def spatial_bin_wide(pixels: DataFrame, n: int, n_channels: int, meta: DataFrame, crop: bool = True,
                     column: str = "spectrum") -> DataFrame:
    """``spatial_bin`` on wide rows: one shuffle of per-block channel sums, no exploding."""
    data = pixels
    if crop:
        data = join_dim(pixels, meta.select("image_id", "ny", "nx"), ["image_id"]).filter(
            (F.col("y") < F.floor(F.col("ny") / n) * n) & (F.col("x") < F.floor(F.col("nx") / n) * n)
        )
    cells = [F.avg(F.element_at(column, c + 1)) for c in range(n_channels)]
    return data.groupBy(
        *FIELD, F.floor(F.col("y") / n).cast("int").alias("y"), F.floor(F.col("x") / n).cast("int").alias("x")
    ).agg(F.array(*cells).alias(column))


def channel_stats(voxels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or FIELD
    return voxels.groupBy(*keys, "channel").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.var_pop("value").alias("variance"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    )


def weighted_mean_spectrum(voxels: DataFrame, weight: str = "w", keys: list[str] | None = None) -> DataFrame:
    keys = keys or FIELD
    return voxels.groupBy(*keys, "channel").agg(
        (F.sum(F.col(weight) * F.col("value")) / F.sum(weight)).alias("value")
    )


def mean_spectrum(pixels: DataFrame, keys: list[str], column: str = "spectrum") -> DataFrame:
    """Mean spectrum per key in wide form. Each task adds up its own rows as matrices, so only one vector
    per task and key is shuffled, however many pixels a key has."""
    named = pixels.select(*keys, F.col(column).alias("_v"))
    parts = partial_sums(named, keys, ["_v"], lambda x: np.append(x.sum(axis=0), len(x)))
    cells = parts.select(*keys, F.posexplode("sums").alias("i", "v")).groupBy(*keys, "i").agg(F.sum("v").alias("v"))
    packed = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_s"))
    count = F.element_at("_s", -1)["v"]
    mean = A.let(count, lambda n: F.transform(F.slice("_s", 1, F.size("_s") - 1), lambda s: s["v"] / n))
    return packed.select(*keys, mean.alias(column))


def band_mean_map(pixels: DataFrame, bands: DataFrame, column: str = "spectrum", source: Column | None = None,
                  weights: Column | None = None) -> DataFrame:
    """Mean over the resonance frames of each component; a frame named twice counts twice.

    ``bands`` has one row per (image, component) with ``channels ARRAY<INT>``; the mean is row-local.
    """
    joined = join_dim(pixels, bands.select("image_id", "component", "channels"), ["image_id"])
    spectrum = source if source is not None else F.col(column)
    picked = F.transform("channels", lambda c: F.element_at(spectrum, c + 1))
    if weights is None:
        value = A.mean(picked)
    else:
        w = F.transform("channels", lambda c: F.element_at(weights, c + 1))
        value = A.dot(picked, w) / A.total(w)
    return joined.select(*PIXEL, "component", value.alias("w"))


def h_weights(h: Column, eps: float = A.EPS) -> Column:
    """Exponential weights of a spectrum, NULL when it is flat."""
    def weigh(v):
        return A.let(F.array_min(v), lambda low: A.let(
            F.array_max(v) - low,
            lambda top: F.when(top > eps, F.transform(v, lambda e: F.exp((e - low) / top) - 1.0)),
        ))

    return A.let(h, weigh)


def h_weighted_map(pixels: DataFrame, spectra: DataFrame, column: str = "spectrum") -> DataFrame:
    """Average over channels weighted by ``exp((h - min) / max) - 1``; a flat spectrum gives the plain mean."""
    side = spectra.select("image_id", "component", h_weights(F.col("spectrum")).alias("_hw"))
    joined = join_dim(pixels, side, ["image_id"])
    value = F.when(F.col("_hw").isNull(), A.mean(column)).otherwise(A.dot(column, "_hw") / A.total("_hw"))
    return joined.select(*PIXEL, "component", value.alias("w"))


def percentiles(df: DataFrame, group: list[str], value: str, fractions: list[float], names: list[str],
                approximate: bool = False, accuracy: int = 10_000) -> DataFrame:
    if approximate:
        aggs = [F.percentile_approx(value, float(p), accuracy).alias(n) for p, n in zip(fractions, names)]
        return df.groupBy(*group).agg(*aggs)
    return exact_percentile(df, group, value, fractions, names)


def gram(pixels: DataFrame, w: str = "w", column: str = "spectrum", keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Normal-equation sums WtW (k x k) and WtX (k x c) in long form; one small matrix per task and key travels."""
    keys = keys or FIELD
    named = pixels.select(*keys, F.col(w).alias("_w"), F.col(column).alias("_x"))

    def sums(a: str, b: str, second: str) -> DataFrame:
        both = [a] if a == b else [a, b]
        fn = (lambda x: np.append((x.T @ x).ravel(), x.shape[1] * len(x))) if a == b else (
            lambda x, y: np.append((x.T @ y).ravel(), y.shape[1] * len(x)))
        parts = partial_sums(named.withColumn("_n", F.size(b)), [*keys, "_n"], both, fn)
        flat = parts.select(*keys, "_n", F.posexplode(F.slice("sums", 1, F.size("sums") - 1)).alias("p", "v"))
        return flat.groupBy(*keys, F.floor(F.col("p") / F.col("_n")).cast("int").alias("i"),
                            (F.col("p") % F.col("_n")).cast("int").alias(second)).agg(F.sum("v").alias("value"))

    return sums("_w", "_w", "j"), sums("_w", "_x", "channel")


def channel_covariance(pixels: DataFrame, keys: list[str] | None = None, column: str = "spectrum") -> DataFrame:
    """Population covariance of every channel pair (first channel <= second).

    The spectra are centred on the mean of their key and multiplied as matrices inside the tasks, which read them in
    ranges of the key, so that a batch holds few keys however many there are.
    """
    keys = keys or FIELD
    spread = pixels.select(*keys, column).withColumn("_spread", F.xxhash64(column))
    pixels = materialize(clustered(spread, keys, ["_spread"]).drop("_spread"))
    centre = mean_spectrum(pixels, keys, column).withColumnRenamed(column, "_m")
    both = join_dim(pixels.select(*keys, F.col(column).alias("_x")), centre, keys)
    both = both.withColumn("_n", F.size("_x"))
    parts = partial_sums(both, [*keys, "_n"], ["_x", "_m"], lambda x, m: np.append(((x - m).T @ (x - m)).ravel(), len(x)))
    sums = parts.select(*keys, "_n", F.posexplode("sums").alias("p", "v")).groupBy(*keys, "_n", "p").agg(F.sum("v").alias("v"))
    count = sums.filter(F.col("p") == F.col("_n") * F.col("_n")).select(*keys, F.col("v").alias("_count"))
    pairs = sums.filter(F.col("p") < F.col("_n") * F.col("_n")).select(
        *keys, F.floor(F.col("p") / F.col("_n")).cast("int").alias("channel_a"), (F.col("p") % F.col("_n")).cast("int").alias("channel_b"), "v")
    return pairs.filter("channel_a <= channel_b").join(count, keys).select(
        *keys, "channel_a", "channel_b", (F.col("v") / F.col("_count")).alias("covariance"))


def fit_error(fitted: DataFrame, keys: list[str] | None = None, algorithm: str = "fixed_h") -> DataFrame:
    """Frobenius norms per field from columns ``spectrum`` and ``model``."""
    keys = keys or FIELD
    residual = A.sum_squares(F.zip_with("spectrum", "model", lambda a, b: a - b))
    sums = fitted.groupBy(*keys).agg(
        F.sqrt(F.sum(residual)).alias("final_error"),
        F.sqrt(F.sum(A.sum_squares("spectrum"))).alias("data_norm"),
        F.count(F.lit(1)).alias("n_pixels"),
        F.count_if(A.is_active("spectrum")).alias("active_pixels"),
    )
    return sums.withColumn("relative_error", relative_error("final_error", "data_norm")).withColumn(
        "algorithm", F.lit(algorithm)
    )


def relative_error(error: str, norm: str) -> Column:
    tiny = F.lit(A.DOUBLE_EPS)
    return F.when(F.col(norm) <= tiny, F.when(F.abs(F.col(error)) <= tiny, F.lit(0.0))).otherwise(
        F.col(error) / F.col(norm)
    )


def fit_series_stats(report: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean, smallest and largest finite relative error over the slices of an image."""
    keys = keys or ["image_id"]
    e = F.when(~F.isnan("relative_error") & (F.abs("relative_error") != F.lit(float("inf"))), F.col("relative_error"))
    return report.groupBy(*keys).agg(
        F.avg(e).alias("mean_error"), F.min(e).alias("min_error"), F.max(e).alias("max_error"),
        F.count(e).alias("n_slices"),
    )


def sigma_clip(df: DataFrame, keys: list[str], columns: list[str], sigma: float = 2.0) -> DataFrame:
    """NULL out values farther than ``sigma`` population deviations from the mean of their group."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"_{c}_m"), F.stddev_pop(c).alias(f"_{c}_s")]
    joined = join_stats(df, df.groupBy(*keys).agg(*aggs), keys)
    out = joined
    for c in columns:
        far = F.abs(F.col(c) - F.col(f"_{c}_m")) > F.lit(float(sigma)) * F.col(f"_{c}_s")
        out = out.withColumn(c, F.when(~far, F.col(c)))
    return out.drop(*[f"_{c}_{t}" for c in columns for t in "ms"])


def intensity_match_factor(overlap: DataFrame, keys: list[str], existing: str = "existing", incoming: str = "incoming",
                           eps: float = A.EPS) -> DataFrame:
    """Per channel factor that brings the incoming mean onto the existing one, clipped to [0.1, 10]."""
    e, i = F.avg(existing), F.avg(incoming)
    raw = F.when(F.abs(i) > eps, e / i)
    ok = raw.isNotNull() & ~F.isnan(raw)
    return overlap.groupBy(*keys, "channel").agg(
        F.when(ok, F.least(F.greatest(raw, F.lit(0.1)), F.lit(10.0))).otherwise(F.lit(1.0)).alias("factor")
    )


def axis_profiles(field: DataFrame, value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """Mean profile along x and along y of every field, in long form (axis, pos, value)."""
    keys = keys or FIELD
    px = field.groupBy(*keys, F.lit("x").alias("axis"), F.col("x").alias("pos")).agg(F.avg(value).alias("value"))
    py = field.groupBy(*keys, F.lit("y").alias("axis"), F.col("y").alias("pos")).agg(F.avg(value).alias("value"))
    return px.unionByName(py)


def profile_moments(profiles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Baseline (5th percentile), peak position and moment sigma of each profile."""
    keys = [*(keys or FIELD), "axis"]
    base = profiles.groupBy(*keys).agg(
        F.percentile("value", F.lit(0.05)).alias("baseline"),
        F.max_by("pos", F.struct("value", -F.col("pos"))).alias("peak"),
        F.max("value").alias("top"), F.count(F.lit(1)).alias("size"),
    )
    lifted = profiles.join(base, keys).withColumn("_p", F.greatest(F.col("value") - F.col("baseline"), F.lit(0.0)))
    d = F.col("pos") - F.col("peak")
    return lifted.groupBy(*keys, "baseline", "peak", "top", "size").agg(
        F.sqrt(F.sum(F.col("_p") * d * d) / F.sum("_p")).alias("sigma")
    )


def reference_h_scale(seeds: DataFrame, pixels: DataFrame, exclude: int | None = None,
                      chosen: DataFrame | None = None, eps: float = A.EPS) -> DataFrame:
    """Typical seed level per image: median of the seed means, else mean of chosen pixels, else of all."""
    usable = seeds.withColumn("_p", A.prepare_fixed("spectrum", eps)).filter("_p IS NOT NULL")
    if exclude is not None:
        usable = usable.filter(F.col("component") != exclude)
    from_seeds = usable.groupBy("image_id").agg(F.median(A.mean("_p")).alias("_a"))
    n, s = F.sum(F.size("spectrum")), F.sum(A.total(A.clamp_nonneg("spectrum")))
    overall = pixels.groupBy("image_id").agg((F.sum(A.total("spectrum")) / n).alias("_c"))
    out = overall.join(from_seeds, "image_id", "left")
    pick = [F.col("_a")]
    if chosen is not None:
        out = out.join(chosen.groupBy("image_id").agg((s / n).alias("_b")), "image_id", "left")
        pick.append(F.col("_b"))
    return out.select("image_id", F.greatest(F.coalesce(*pick, F.col("_c")), F.lit(eps)).alias("scale"))


def top3_mean_response(voxels: DataFrame) -> DataFrame:
    """Mean of the three largest channel values of every pixel."""
    top = F.slice(F.sort_array(F.collect_list("value"), asc=False), 1, 3)
    return voxels.groupBy(*PIXEL).agg(A.mean(top).alias("value"))
