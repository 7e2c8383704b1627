"""Seeds for factorisation: seed pixels, seed maps, model spectra, residual seeds, assembly.

Seed tables hold one spectrum per image and component. The pixel table given to these functions is the
field the seeds are built on: one slice per image, the reference slice of a stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays as A
from ..functions.curves import gaussian_peak
from ..scale import join_dim, join_stats, materialize, top_n
from ..tables import FIELD, PIXEL
from . import stats as S
from . import unmix as U
from .axis import resonance_channels
from .neighborhood import upsample_bilinear
from .rois import component_mean_spectra, pixels_in_roi, roi_mean_spectrum


# --- model spectra -------------------------------------------------------------------------------

def gaussian_model_spectra(resonances: DataFrame, axis: DataFrame, lift_zeros: bool = True) -> DataFrame:
    """Sum of the Gaussian rows of each component on the axis, as wide spectra."""
    rows = resonances.filter("use_gaussian").join(
        axis.select("image_id", "channel", F.col("value").alias("_t")), "image_id"
    )
    value = gaussian_peak("_t", "center", "width", F.coalesce("amplitude", F.lit(65535.0)))
    if not lift_zeros:
        value = F.when(value == A.DOUBLE_EPS, F.lit(0.0)).otherwise(value)
    sums = rows.groupBy("image_id", "component", "channel").agg(F.sum(value).alias("value"))
    return pack_spectra(sums, ["image_id", "component"])


def pack_spectra(long: DataFrame, keys: list[str], out: str = "spectrum") -> DataFrame:
    """Long spectra (keys, channel, value) to one array per key."""
    cells = F.array_sort(F.collect_list(F.struct("channel", "value")))
    return long.groupBy(*keys).agg(F.transform(cells, lambda s: s["value"]).alias(out))


# --- seed pixels ---------------------------------------------------------------------------------

def component_bands(resonances: DataFrame, axis: DataFrame, unique: bool = True, row_id: str = "resonance_id") -> DataFrame:
    """Channels of each component over all its rows, with the combined pixel wish and threshold."""
    rows = resonance_channels(resonances, axis, row_id)
    pick = F.collect_set("channel") if unique else F.collect_list("channel")
    channels = rows.groupBy("image_id", "component").agg(F.sort_array(pick).alias("channels"))
    wish = resonances.groupBy("image_id", "component").agg(
        F.sum(F.when(F.col("n_pixels") > 0, F.col("n_pixels"))).cast("int").alias("n_pixels"),
        F.min(F.when(F.col("threshold") > 0, F.col("threshold"))).alias("threshold"),
        F.min_by("use_subtracted", row_id).alias("use_subtracted"),
    )
    return channels.join(wish, ["image_id", "component"])


def seed_metric(spectrum: Column, channels: Column, metric: str = "intensity") -> Column:
    """``intensity``: largest in-band value. ``score``: contrast of the in-band mean to the rest."""
    inside = F.transform(channels, lambda c: F.element_at(spectrum, c + 1))
    if metric.lower() != "score":
        return F.array_max(inside)
    everything = F.sequence(F.lit(0), F.size(spectrum) - 1)
    outside = F.transform(F.array_except(everything, channels), lambda c: F.element_at(spectrum, c + 1))
    base = F.when(F.size(outside) > 0, A.mean(outside)).otherwise(F.lit(0.0))
    return F.greatest((A.mean(inside) - base) / (base + 1e-6), F.lit(0.0))


def seed_pixels(pixels: DataFrame, bands: DataFrame, *, metric: str = "intensity", excluded: DataFrame | None = None,
                unique: bool = True, column: str = "spectrum") -> DataFrame:
    """Seed pixels of every component, in component order, each pixel used once.

    A component with a pixel wish takes its N best pixels (ties by position); otherwise it takes all
    pixels above threshold x maximum. The metrics of all components are taken in one pass over the
    spectra into a narrow table; the component loop only reads that.
    """
    bands = materialize(bands)
    packed = bands.groupBy("image_id").agg(F.collect_list(F.struct("component", "channels")).alias("_b"))
    metrics = F.transform("_b", lambda b: F.struct(
        b["component"].alias("component"), seed_metric(F.col(column), b["channels"], metric).alias("m")))
    narrow = join_dim(pixels, packed, ["image_id"]).select(*PIXEL, metrics.alias("_m"))
    if excluded is not None:
        narrow = join_dim(narrow, excluded.select("image_id", "y", "x").distinct(), ["image_id", "y", "x"], "left_anti")
    narrow = materialize(narrow)
    components = [r[0] for r in bands.select("component").distinct().orderBy("component").collect()]
    n_max = bands.agg(F.max("n_pixels")).first()[0] or 0
    picked: DataFrame | None = None
    for c in components:
        mine = narrow.select(*PIXEL, F.explode("_m").alias("_e")).filter(F.col("_e.component") == c).select(
            *PIXEL, F.col("_e.m").alias("metric"))
        if picked is not None and unique:
            mine = join_dim(mine, picked.select(*PIXEL), PIXEL, "left_anti")
        info = bands.filter(F.col("component") == c).select("image_id", "n_pixels", "threshold")
        mine = join_dim(mine, info, ["image_id"])
        wished = F.coalesce("n_pixels", F.lit(0)) > 0
        best = top_n(mine.filter(wished), FIELD, [F.desc("metric"), F.asc("y"), F.asc("x")], F.col("n_pixels"), n_max)
        rest = mine.filter(~wished)
        tops = rest.groupBy(*FIELD).agg(F.max("metric").alias("_top"))
        above = join_stats(rest, tops, FIELD).filter(F.col("metric") > F.coalesce("threshold", F.lit(0.0)) * F.col("_top"))
        found = best.select(*PIXEL, "metric").unionByName(above.select(*PIXEL, "metric")).withColumn("component", F.lit(c))
        found = materialize(found)
        picked = found if picked is None else picked.unionByName(found)
    return picked


def seed_pixel_spectra(pixels: DataFrame, picked: DataFrame, bands: DataFrame) -> DataFrame:
    """Mean spectrum of the seed pixels of each component, from its preferred source."""
    joined = join_dim(pixels, picked.select(*PIXEL, "component"), PIXEL)
    joined = join_dim(joined, bands.select("image_id", "component", "use_subtracted"), ["image_id", "component"])
    source = F.col("spectrum")
    if "spectrum_sub" in pixels.columns:
        source = F.when(F.col("use_subtracted"), F.coalesce("spectrum_sub", "spectrum")).otherwise(F.col("spectrum"))
    return S.mean_spectrum(joined.withColumn("spectrum", source), ["image_id", "component"])


def legacy_resonance_seeds(pixels: DataFrame, resonances: DataFrame, axis: DataFrame, *, ratio: bool = False,
                           threshold: float = 0.9, n_pixels: int | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Older seed search: one frame (or its ratio to the previous resonance) per component.

    Pixels above threshold x the frame maximum, never used twice, in component order; the best
    ``n_pixels`` when a number is given.
    """
    from .axis import nearest_channel

    near = nearest_channel(resonances.select("image_id", "component", F.col("center").alias("target")).distinct(), axis)
    packed = near.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("component", "channel"))).alias("_b"))
    at = lambda c: F.element_at("spectrum", c + 1)

    def value(b, i):
        now = at(b["channel"])
        if not ratio:
            return now
        before = at(F.element_at(F.col("_b"), F.greatest(i, F.lit(1)))["channel"])
        return F.when(i > 0, now / (before + 1e-6)).otherwise(now)

    metrics = F.transform("_b", lambda b, i: F.struct(b["component"].alias("component"), value(b, i).alias("m")))
    narrow = join_dim(pixels, packed, ["image_id"]).select(*PIXEL, metrics.alias("_m"))
    if excluded is not None:
        narrow = narrow.join(excluded.select("image_id", "y", "x").distinct(), ["image_id", "y", "x"], "left_anti")
    narrow = materialize(narrow)
    picked: DataFrame | None = None
    for c in [r[0] for r in near.select("component").distinct().orderBy("component").collect()]:
        mine = narrow.select(*PIXEL, F.explode("_m").alias("_e")).filter(F.col("_e.component") == c).select(
            *PIXEL, F.col("_e.m").alias("metric"))
        if picked is not None:
            mine = mine.join(picked.select(*PIXEL), PIXEL, "left_anti")
        tops = mine.groupBy(*FIELD).agg(F.max("metric").alias("_top"))
        hits = join_stats(mine, tops, FIELD)
        hits = hits.filter((F.col("metric") > threshold * F.col("_top")) | (F.col("metric") == F.col("_top")))
        if n_pixels:
            hits = top_n(hits, FIELD, [F.desc("metric"), F.asc("y"), F.asc("x")], n_pixels, n_pixels)
        found = materialize(hits.select(*PIXEL, "metric").withColumn("component", F.lit(c)))
        picked = found if picked is None else picked.unionByName(found)
    return picked


# --- seed maps -----------------------------------------------------------------------------------

def unity_scale_wide(pixels: DataFrame, k: int, column: str = "w", eps: float = A.EPS) -> DataFrame:
    """``unity_scale`` on wide maps: k maxima per field, then a row-local division."""
    lift = lambda v: F.when(v.isNotNull(), F.greatest(A.finite_or_zero(v), F.lit(eps)))
    lifted = pixels.withColumn(column, F.transform(column, lift))
    tops = lifted.groupBy(*FIELD).agg(F.array(*[F.max(F.element_at(column, j + 1)) for j in range(k)]).alias("_top"))
    scale = lambda v, t: F.when(t <= eps, F.when(v.isNotNull(), F.lit(eps))).otherwise(v / t)
    return join_stats(lifted, tops, FIELD).withColumn(column, F.zip_with(column, "_top", scale)).drop("_top")


def _align(column: str, have: str, k: int) -> Column:
    """Values listed for the components ``have`` as an array over 0..k-1 with NULL holes."""
    slots = F.sequence(F.lit(0), F.lit(k - 1))
    place = lambda j: F.array_position(have, j).cast("int")
    return F.transform(slots, lambda j: F.when(place(j) > 0, F.try_element_at(column, F.greatest(place(j), F.lit(1)))))


def w_seed(pixels: DataFrame, spectra: DataFrame, k: int, mode: str = "nnls", *, normalize: bool = True,
           use_subtracted: DataFrame | None = None, downsample: int = 1, whole: bool = False, eps: float = A.EPS) -> DataFrame:
    """Seed maps of all components from their spectra, as a wide column ``w`` beside the spectrum.

    Modes: ``nnls``, ``selective_score``, ``h_weighted``, ``average``, ``empty`` and ``peak``. A component
    without a usable spectrum gets NULL, except in the modes that need none. ``use_subtracted`` lists
    (image_id, component, use_subtracted); components that want the subtracted stack are solved on it.
    ``downsample`` solves on block means and zooms back, an approximation for quick previews. With ``whole`` the zoomed
    maps cover missing pixels too, whose other columns are null.
    """
    mode = {"selective score": "selective_score", "score": "selective_score", "h weighted": "h_weighted",
            "avg": "average", "full": "empty"}.get(mode, mode)
    has_sub = "spectrum_sub" in pixels.columns
    if downsample > 1:
        return _w_seed_small(pixels, spectra, k, mode, normalize, use_subtracted, downsample, whole, eps)
    usable = spectra.filter(F.col("component") < k).withColumn("_h", A.prepare_fixed("spectrum", eps)).filter("_h IS NOT NULL")
    usable = usable.select("image_id", "component", F.col("_h").alias("spectrum"))
    packed = usable.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("component", "spectrum"))).alias("_hs"))
    extra = ["spectrum_sub"] if has_sub else []
    keep = ["spectrum", *extra, *[c for c in pixels.columns if c not in (*PIXEL, "spectrum", "spectrum_sub", "w")]]

    def solve(df, column, out):
        if mode == "nnls":
            solved = U.nnls_fixed_h(df, usable, column=column, keep=[c for c in df.columns if c not in PIXEL], eps=eps)
            names = join_dim(solved, packed.select("image_id", F.transform("_hs", lambda h: h["component"]).alias("_have")), ["image_id"], "left")
            filled = F.transform(_align("w", "_have", k), lambda v: F.greatest(v, F.lit(eps)) if normalize else v)
            return names.withColumn(out, filled).drop("_have", *([] if out == "w" else ["w"]))
        side = packed
        if mode in ("h_weighted", "peak"):
            side = materialize(packed.withColumn("_hs", F.transform("_hs", lambda h: F.struct(
                h["component"].alias("component"), S.h_weights(h["spectrum"], eps).alias("weights"),
                A.peak_channel(h["spectrum"]).alias("peak")))))
        joined = join_dim(df, side, ["image_id"], "left")
        if mode == "selective_score":
            def scores(x):
                return A.let(F.transform("_hs", lambda h: A.dot(x, h["spectrum"])), lambda ts: F.transform(ts, lambda t, i: score(ts, t, i)))

            def score(ts, t, i):
                rival = F.array_max(F.filter(ts, lambda v, j: j != i))
                own = F.greatest(t, F.lit(0.0))
                return F.greatest(F.when(rival.isNull(), own).otherwise(own * (own / (own + rival + eps))), F.lit(eps))

            values = A.let(A.clamp_nonneg(column), scores)
        elif mode == "h_weighted":
            values = F.transform("_hs", lambda h: F.when(h["weights"].isNull(), A.mean(column)).otherwise(
                A.dot(F.col(column), h["weights"]) / A.total(h["weights"])))
        elif mode == "peak":
            values = F.transform("_hs", lambda h: F.element_at("spectrum", h["peak"] + 1))
        elif mode == "average":
            values = F.transform("_hs", lambda h: A.mean(column))
        elif mode == "empty":
            values = F.transform("_hs", lambda h: F.lit(1.0))
        else:
            raise ValueError(f"unknown seed map mode {mode!r}")
        joined = joined.withColumn("_v", values).withColumn("_have", F.transform("_hs", lambda h: h["component"]))
        return joined.withColumn(out, _align("_v", "_have", k)).drop("_v", "_have", "_hs")

    base = pixels.select(*PIXEL, *keep)
    if has_sub and use_subtracted is not None and use_subtracted.filter("use_subtracted").take(1):
        both = solve(solve(base, "spectrum", "_w_raw"), "spectrum_sub", "_w_sub")
        flags = use_subtracted.filter("use_subtracted").groupBy("image_id").agg(F.collect_set("component").alias("_subs"))
        both = join_dim(both, flags, ["image_id"], "left")
        choose = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.when(
            F.coalesce(F.array_contains("_subs", j), F.lit(False)), F.element_at("_w_sub", j + 1)).otherwise(F.element_at("_w_raw", j + 1)))
        out = both.withColumn("w", choose).drop("_subs", "_w_raw", "_w_sub")
    else:
        out = solve(base, "spectrum", "w")
    return unity_scale_wide(out, k, "w", eps) if normalize else out


def _w_seed_small(pixels, spectra, k, mode, normalize, use_subtracted, factor, whole, eps):
    """Solve on block means and zoom the maps back; images smaller than a block are solved in full."""
    from .neighborhood import field_shape

    shape = materialize(field_shape(pixels))
    big = shape.filter((F.col("ny") >= factor) & (F.col("nx") >= factor))
    tiny = join_dim(pixels, shape.join(big, FIELD, "left_anti").select(*FIELD), FIELD, "left_semi")
    large = join_dim(pixels, big.select(*FIELD), FIELD, "left_semi")
    parts = [c for c in ("spectrum", "spectrum_sub") if c in pixels.columns]
    width = pixels.agg(F.max(F.size("spectrum"))).first()[0]
    cut = join_dim(large, big, FIELD).filter(
        (F.col("y") < F.floor(F.col("ny") / factor) * factor) & (F.col("x") < F.floor(F.col("nx") / factor) * factor))
    small = cut.groupBy(*FIELD, F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")).agg(
        *[F.array(*[F.avg(F.element_at(p, c + 1)) for c in range(width)]).alias(p) for p in parts])
    solved = w_seed(small, spectra, k, mode, normalize=False, use_subtracted=use_subtracted, eps=eps)
    maps = solved.select(*PIXEL, F.posexplode("w").alias("component", "value")).filter("value IS NOT NULL")
    maps = maps.withColumn("value", F.greatest("value", F.lit(eps)))
    zoom = big.withColumn("sy", F.floor(F.col("ny") / factor).cast("int")).withColumn("sx", F.floor(F.col("nx") / factor).cast("int"))
    fine = upsample_bilinear(maps, zoom, [*FIELD, "component"])
    wide = fine.groupBy(*PIXEL).agg(F.array(*[F.max(F.when(F.col("component") == j, F.col("value"))) for j in range(k)]).alias("w"))
    back = large.join(wide, PIXEL, "right" if whole else "inner")
    rest = w_seed(tiny, spectra, k, mode, normalize=False, use_subtracted=use_subtracted, eps=eps)
    out = back.unionByName(rest.select(back.columns))
    return unity_scale_wide(out, k, "w", eps) if normalize else out


def fixed_w_mean(maps: DataFrame, order: str = "map_id", eps: float = A.EPS) -> DataFrame:
    """Running mean of several fixed maps of a component, scaled to unity after every map.

    The maps are written once and laid side by side, one row per pixel, in one shuffle; of a pixel that a map has twice the
    larger value counts. The loop is over the number of maps of one component and only adds up maxima.
    """
    from pyspark.sql import Window

    key = ["image_id", "component"]
    lift = lambda w: F.greatest(w, F.lit(eps))
    to_unity = lambda w, peak: F.when(peak <= eps, F.lit(eps)).otherwise(lift(w) / peak)
    narrow = materialize(maps.select(*key, order, "y", "x", lift(A.finite_or_zero(F.col("w"))).alias("w")))
    of_key = Window.partitionBy(*key)
    numbered = narrow.groupBy(*key, order).agg(F.max("w").alias("_peak")).select(
        "*", F.row_number().over(of_key.orderBy(order)).alias("_n"), F.count(F.lit(1)).over(of_key).alias("_maps"))
    numbered = materialize(numbered)
    most = numbered.agg(F.max("_n")).first()[0] or 1
    unit = join_dim(narrow, numbered, [*key, order]).withColumn("w", to_unity(F.col("w"), F.col("_peak")))
    beside = [F.max(F.when(F.col("_n") == n, F.col("w"))).alias(f"_w{n}") for n in range(1, most + 1)]
    current = materialize(unit.groupBy(*key, "y", "x").agg(F.max("_maps").alias("_maps"), *beside).withColumnRenamed("_w1", "w"))
    for n in range(2, most + 1):
        # a pixel that only one side has keeps its value
        new = F.col(f"_w{n}")
        mixed = current.withColumn("w", F.coalesce((F.col("w") * (n - 1) + new) / n, "w", new)).drop(f"_w{n}")
        peaks = mixed.filter(F.col("_maps") >= n).groupBy(*key).agg(F.max(lift(F.col("w"))).alias("_peak"))
        scaled = F.when(F.col("_peak").isNull() | F.col("w").isNull(), F.col("w")).otherwise(to_unity(F.col("w"), F.col("_peak")))
        current = materialize(join_dim(mixed, peaks, key, "left").withColumn("w", scaled).drop("_peak"))
    return current.select(*key, "y", "x", "w")


# --- missing spectra and maps --------------------------------------------------------------------

def residual_h_seed(pixels: DataFrame, spectra: DataFrame, component: int, *, top: int = 16, sigma: float = 5.0,
                    column: str = "spectrum", eps: float = A.EPS) -> DataFrame:
    """Spectrum of what the other seeds leave unexplained: the strongest residual pixels, each scaled to
    its maximum, averaged, smoothed and brought to the level of the other seeds."""
    others = spectra.filter(F.col("component") != component).withColumn("spectrum", A.prepare_fixed("spectrum", eps)).filter("spectrum IS NOT NULL")
    base = pixels.select(*PIXEL, A.clamp_nonneg(column).alias("spectrum"))
    w = U.nnls_fixed_h(base, others, keep=["spectrum"], eps=eps)
    seeded = join_dim(w, others.select("image_id").distinct().withColumn("_s", F.lit(True)), ["image_id"], "left")
    with_model = U.residual_of(U.reconstruct(seeded.filter("_s"), others), positive=True)
    alone = seeded.filter("_s IS NULL").withColumn("residual", F.col("spectrum"))
    rest = with_model.select(*PIXEL, "spectrum", "residual").unionByName(alone.select(*PIXEL, "spectrum", "residual"))
    strong = rest.withColumn("_n", F.sqrt(A.sum_squares("residual"))).filter(F.col("_n") > eps)
    best = materialize(top_n(strong, ["image_id"], [F.desc("_n"), F.asc("slice_id"), F.asc("y"), F.asc("x")], top, top))
    scaled = best.filter(F.array_max("residual") > eps).withColumn(
        "residual", A.let(F.array_max("residual"), lambda top: F.transform("residual", lambda v: v / top)))
    mean = S.mean_spectrum(scaled, ["image_id"], "residual")
    curve = mean.select("image_id", F.transform(A.smooth("residual", sigma), lambda v: F.greatest(v, F.lit(eps))).alias("_c"))
    level = S.reference_h_scale(spectra, pixels.select(*PIXEL, F.col(column).alias("spectrum")), component,
                                best.select("image_id", "spectrum"), eps)
    joined = curve.join(level, "image_id")
    level = F.col("scale") / F.greatest(A.mean("_c"), F.lit(eps))
    out = A.let(level, lambda f: F.transform("_c", lambda v: v * f))
    return joined.select("image_id", F.lit(component).alias("component"), out.alias("spectrum"))


def jitter_seed(pixels: DataFrame, component: int, seed: int = 0, sigma: float = 10.0, column: str = "spectrum") -> DataFrame:
    """Last resort: the mean level plus smoothed noise of half the maximum, rescaled to the mean.

    The noise is a hash of image, component and channel, so a rerun gives the same spectrum.
    """
    import math

    facts = pixels.groupBy("image_id").agg(
        (F.sum(A.total(column)) / F.sum(F.size(column))).alias("_avg"), F.max(F.array_max(column)).alias("_max"),
        F.max(F.size(column)).alias("_c"))
    u = lambda c, salt: (F.shiftrightunsigned(F.xxhash64("image_id", F.lit(component), c, F.lit(seed), F.lit(salt)), 11) + 1) / F.lit(float(2**53) + 1)
    normal = lambda c: F.sqrt(-2.0 * F.ln(u(c, 1))) * F.cos(2.0 * math.pi * u(c, 2))
    noisy = facts.withColumn("_n", F.transform(F.sequence(F.lit(0), F.col("_c") - 1),
                                               lambda c: F.col("_avg") + F.abs(normal(c)) * 0.5 * F.col("_max")))
    smooth = noisy.withColumn("_s", A.smooth("_n", sigma))
    out = A.let(F.col("_avg") / A.mean("_s"), lambda f: F.transform("_s", lambda v: v * f))
    return smooth.select("image_id", F.lit(component).alias("component"), out.alias("spectrum"))


def fill_missing_h(pixels: DataFrame, seeds: DataFrame, k: int, *, seed: int = 0, eps: float = A.EPS) -> DataFrame:
    """Complete the seed spectra of every image to components 0..k-1, in component order.

    A background component takes the mean raw spectrum, another one the residual seed, and an image
    without any residual the jittered mean. Later components see the earlier fills.
    """
    spark = pixels.sparkSession
    current = materialize(seeds.filter((F.col("component") < k) & A.has_signal("spectrum", eps)).select("image_id", "component", "spectrum", "background"))
    images = materialize(pixels.select("image_id").distinct())
    flags = materialize(seeds.groupBy("image_id", "component").agg(F.bool_or("background").alias("background")))
    for c in range(k):
        lacking = images.join(current.filter(F.col("component") == c).select("image_id"), "image_id", "left_anti")
        if not lacking.take(1):
            continue
        lacking = lacking.join(flags.filter(F.col("component") == c).select("image_id", "background"), "image_id", "left").withColumn(
            "background", F.coalesce("background", F.lit(False)))
        lacking = materialize(lacking)
        bg = join_dim(pixels, lacking.filter("background").select("image_id"), ["image_id"], "left_semi")
        fg = join_dim(pixels, lacking.filter("NOT background").select("image_id"), ["image_id"], "left_semi")
        mean = S.mean_spectrum(bg, ["image_id"]).select("image_id", F.lit(c).alias("component"), "spectrum", F.lit(True).alias("background"))
        source = "spectrum"
        if "spectrum_sub" in pixels.columns:
            fg = fg.withColumn("_src", F.coalesce("spectrum_sub", "spectrum"))
            source = "_src"
        rest = residual_h_seed(fg, current.select("image_id", "component", "spectrum"), c, column=source, eps=eps)
        rest = materialize(rest.withColumn("background", F.lit(False)))
        still = lacking.filter("NOT background").select("image_id").join(rest.select("image_id"), "image_id", "left_anti")
        noise = jitter_seed(join_dim(fg, still, ["image_id"], "left_semi"), c, seed).withColumn("background", F.lit(False))
        current = materialize(current.unionByName(mean).unionByName(rest).unionByName(noise))
    return current


def assemble_seeds(
    pixels: DataFrame,
    axis: DataFrame,
    k: int,
    *,
    rois: DataFrame | None = None,
    resonances: DataFrame | None = None,
    model_spectra: DataFrame | None = None,
    seed_maps: DataFrame | None = None,
    w_mode: str = "nnls",
    overwrite: bool = True,
    normalize_h: bool = False,
    normalize_w: bool = True,
    metric: str = "intensity",
    downsample: int = 1,
    h_seed_finalizer: Callable[[DataFrame], DataFrame] | None = None,
    seed: int = 0,
    eps: float = A.EPS,
) -> tuple[DataFrame, DataFrame]:
    """Seed spectra and seed maps of k components from everything the user gave.

    Spectra: mean of the region and model curves, then seed pixels of the resonances, then residuals.
    Maps: a fixed map, then (``overwrite``) the map computed from the spectrum, else the band mean of the
    resonances, else the average image. Returns (seed spectra, pixels with a wide column ``w``).
    """
    from .condition import scale_h_to_unity

    has_sub = "spectrum_sub" in pixels.columns
    curves = []
    if rois is not None:
        means = component_mean_spectra(roi_mean_spectrum(pixels, rois), rois)
        regions = means.groupBy("image_id", "component", "channel").agg(F.avg("value").alias("value"), F.bool_or("background").alias("background"))
        n = rois.filter(F.coalesce("seed_h_enabled", F.lit(True))).groupBy("image_id", "component").agg(F.count(F.lit(1)).alias("_n"))
        curves.append(regions.join(n, ["image_id", "component"]))
    if model_spectra is not None:
        flag = F.col("background") if "background" in model_spectra.columns else F.lit(False)
        curves.append(model_spectra.select("image_id", "component", flag.alias("background"), F.posexplode("spectrum").alias("channel", "value"))
                      .withColumn("_n", F.lit(1).cast("bigint")))
    seeds = None
    if curves:
        rows = curves[0] if len(curves) == 1 else curves[0].unionByName(curves[1].select(curves[0].columns))
        mixed = rows.groupBy("image_id", "component", "channel").agg(
            (F.sum(F.col("value") * F.col("_n")) / F.sum("_n")).alias("value"), F.bool_or("background").alias("background"))
        flags = mixed.groupBy("image_id", "component").agg(F.bool_or("background").alias("background"))
        seeds = pack_spectra(mixed, ["image_id", "component"]).join(flags, ["image_id", "component"]).filter(F.col("component") < k)
        seeds = materialize(seeds)
    bands = None
    if resonances is not None:
        bands = materialize(component_bands(resonances.filter(F.col("component") < k), axis))
        wanted = bands if seeds is None else bands.join(seeds.select("image_id", "component"), ["image_id", "component"], "left_anti")
        taken = pixels_in_roi(pixels, rois.filter("background")) if rois is not None else None
        picked = seed_pixels(pixels, wanted, metric=metric, excluded=taken) if wanted.take(1) else None
        if picked is not None:
            found = seed_pixel_spectra(pixels, picked, bands).withColumn("background", F.lit(False))
            seeds = found if seeds is None else seeds.unionByName(found)
            seeds = materialize(seeds)
    if seeds is None:
        seeds = pixels.select("image_id").distinct().select("image_id", F.lit(0).alias("component"), F.lit(None).cast("array<double>").alias("spectrum"), F.lit(False).alias("background")).limit(0)
    seeds = fill_missing_h(pixels, seeds, k, seed=seed, eps=eps)
    if normalize_h:
        seeds = scale_h_to_unity(seeds)
    if h_seed_finalizer is not None:
        seeds = h_seed_finalizer(seeds)
    wants = None
    if has_sub:
        flags = seeds.select("image_id", "component", "background")
        if bands is not None:
            rows = resonances.groupBy("image_id", "component").agg(F.bool_or("use_subtracted").alias("_any"))
            flags = flags.join(rows, ["image_id", "component"], "left")
        else:
            flags = flags.withColumn("_any", F.lit(None).cast("boolean"))
        wants = flags.select("image_id", "component", (~F.col("background") & F.coalesce("_any", F.lit(True))).alias("use_subtracted"))
    mapped = w_seed(pixels, seeds, k, w_mode, normalize=normalize_w, use_subtracted=wants, downsample=downsample, eps=eps)
    if bands is not None and not overwrite:
        own = component_bands(resonances.filter(F.col("component") < k), axis, unique=False)
        packed = own.groupBy("image_id").agg(F.collect_list(F.struct("component", "channels", "use_subtracted")).alias("_b"))
        source = lambda b: F.when(b["use_subtracted"], F.coalesce("spectrum_sub", "spectrum")).otherwise(F.col("spectrum")) if has_sub else F.col("spectrum")
        band = F.transform("_b", lambda b: A.mean(F.transform(b["channels"], lambda c: F.element_at(source(b), c + 1))))
        joined = join_dim(mapped, packed, ["image_id"], "left").withColumn("_v", band).withColumn(
            "_have", F.transform("_b", lambda b: b["component"]))
        joined = unity_scale_wide(joined.withColumn("_bw", _align("_v", "_have", k)), k, "_bw", eps)
        mapped = joined.withColumn("w", F.zip_with("_bw", "w", lambda a, b: F.coalesce(a, b))).drop("_b", "_v", "_have", "_bw")
    mapped = materialize(mapped)
    average = unity_scale_wide(mapped.withColumn("_avg", F.array(A.mean("spectrum"))), 1, "_avg", eps)
    mapped = average.withColumn("w", F.transform("w", lambda v: F.coalesce(v, F.element_at("_avg", 1)))).drop("_avg")
    if seed_maps is not None:
        fixed = fixed_w_mean(seed_maps if "map_id" in seed_maps.columns else seed_maps.withColumn("map_id", F.lit(0)))
        wide = fixed.groupBy("image_id", "y", "x").agg(
            F.array(*[F.max(F.when(F.col("component") == j, F.col("w"))) for j in range(k)]).alias("_fw"))
        mapped = mapped.join(wide, ["image_id", "y", "x"], "left").withColumn(
            "w", F.when(F.col("_fw").isNull(), F.col("w")).otherwise(F.zip_with("_fw", "w", lambda a, b: F.coalesce(a, b)))).drop("_fw")
    return seeds, materialize(mapped)


# --- background component and stacks -------------------------------------------------------------

def background_component(pixels: DataFrame, shape: DataFrame, radius: int, *, projection: str = "avg", sigma: float = 10.0,
                         downsample: int = 1, eps: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Rolling-ball map of a projection, blurred, and the mean raw spectrum weighted by it."""
    from . import neighborhood as N

    ref = S.project_spectral(pixels, projection)
    if downsample > 1:
        small_shape = shape.withColumn("ny", F.ceil(F.col("ny") / downsample).cast("int")).withColumn("nx", F.ceil(F.col("nx") / downsample).cast("int"))
        ball = N.rolling_ball_background(N.stride_downsample(ref, downsample), small_shape, max(radius // downsample, 1))
        ball = N.upsample_nearest(ball, shape, downsample)
    else:
        ball = N.rolling_ball_background(ref, shape, radius)
    lifted = ball.withColumn("value", F.greatest("value", F.lit(eps)))
    w = N.gaussian_blur_2d(lifted, shape, sigma) if sigma > 0 else lifted
    w = materialize(w.withColumnRenamed("value", "w"))
    weighted = pixels.join(w, PIXEL).select(*FIELD, "w", F.posexplode("spectrum").alias("channel", "value"))
    h = pack_spectra(S.weighted_mean_spectrum(weighted), FIELD)
    h = h.withColumn("spectrum", F.transform(A.smooth("spectrum", sigma), lambda v: F.greatest(v, F.lit(eps))))
    return w, h


def multislice(pixels: DataFrame, k: int, mode: str, *, spectra: DataFrame | None = None, w0: str | None = None,
               reference_slice: int = 0, **options):
    """Stacks: ``nmf`` per slice, ``fixed_h``, ``hybrid`` (fit the reference slice, reuse its spectra on the
    raw data of all slices) or ``pca`` per slice. A slice is a key, so all slices run together."""
    from .factorize import Fit, nmf, pca

    if mode == "nmf":
        return nmf(pixels, k, spectra=spectra, w0=w0, **options)
    if mode == "pca":
        return pca(pixels, k)
    if mode == "hybrid":
        first = nmf(pixels.filter(F.col("slice_id") == reference_slice), k, spectra=spectra, w0=w0, **options)
        spectra = first.spectra.drop("slice_id")
    elif mode != "fixed_h":
        raise ValueError(f"unknown mode {mode!r}")
    w = U.nnls_fixed_h(pixels, spectra, keep=["spectrum"], require=k)
    report = S.fit_error(U.reconstruct(w.withColumn("spectrum", A.clamp_nonneg("spectrum")), spectra), algorithm="fixed_h_nnls")
    return Fit(w.drop("spectrum"), spectra, report)


def promote_result(fit_spectra: DataFrame, abundance: DataFrame, component: int, what: str = "both", target: int | None = None):
    """A fitted spectrum and map as new seed rows: (seed_spectra rows, seed_maps rows)."""
    if what not in ("H", "W", "both"):
        raise ValueError("what is 'H', 'W' or 'both'")
    target = component if target is None else target
    h = fit_spectra.filter(F.col("component") == component).select(
        "image_id", F.lit(target).alias("component"), F.concat(F.lit("Result "), F.lit(str(component + 1))).alias("name"),
        "spectrum", F.lit(False).alias("background"), F.lit("result").alias("source"), F.lit(1.0).alias("scale_factor"))
    w = abundance.select("image_id", F.lit(target).alias("component"), "y", "x", F.element_at("w", component + 1).alias("w"))
    return (h if what in ("H", "both") else None), (w if what in ("W", "both") else None)
