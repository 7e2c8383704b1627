"""Flat-field correction: Gaussian models, blurred fields, gains, radial corrections and masks.

A model is one row per instrument or image: ``dx, dy, sigma_x, sigma_y, amp, offset, ref_ny, ref_nx``,
with the centre given relative to the middle of the reference image.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays as A
from ..functions.curves import elliptic_gaussian, radial_model
from ..scale import exact_percentile, join_dim, join_stats, join_wide, materialize
from ..tables import FIELD, PIXEL
from . import neighborhood as N
from . import stats as S

EPS = 1e-6
MAX_GAIN = 3.0


def default_model(shape: DataFrame) -> DataFrame:
    """Centred model with sigma 0.35 of the image size."""
    keys = [c for c in FIELD if c in shape.columns]
    return shape.select(
        *keys, F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"),
        F.greatest(F.lit(1.0), 0.35 * F.col("nx")).alias("sigma_x"), F.greatest(F.lit(1.0), 0.35 * F.col("ny")).alias("sigma_y"),
        F.lit(1.0).alias("amp"), F.lit(0.0).alias("offset"), F.col("ny").alias("ref_ny"), F.col("nx").alias("ref_nx"))


def _scaled_model(model: DataFrame, shape: DataFrame, keys: list[str]) -> DataFrame:
    """Model centre and widths on the target shape; each axis stretches by its (N - 1) ratio."""
    ratio = lambda n, r: (F.col(n) - 1) / F.greatest(F.lit(1.0), F.col(r) - 1.0)
    rx, ry = ratio("nx", "ref_nx"), ratio("ny", "ref_ny")
    if keys:
        both = shape.select(*keys, "ny", "nx").join(model, keys)
    else:  # one model for every image: its row becomes constants
        rows = model.take(2)
        if len(rows) != 1:
            raise ValueError("a model without an image key must have exactly one row")
        row = rows[0]
        both = shape.withColumns({c: F.lit(row[c]) for c in model.columns})
    out = both.select(
        *[c for c in FIELD if c in both.columns], "ny", "nx", "amp",
        F.least(F.greatest("offset", F.lit(0.0)), F.lit(0.999)).alias("floor"),
        (((F.col("ref_nx") - 1) / 2.0 + F.col("dx")) * rx).alias("cx"), (((F.col("ref_ny") - 1) / 2.0 + F.col("dy")) * ry).alias("cy"),
        F.greatest(F.lit(1e-6), F.col("sigma_x") * rx).alias("sx"), F.greatest(F.lit(1e-6), F.col("sigma_y") * ry).alias("sy"))
    return out


def _with_target(rows: DataFrame, normalize_to: str) -> DataFrame:
    """The level that gets gain 1: the mean of the field (a product of two line means) or its peak pixel."""
    if normalize_to == "mean":
        bell = lambda i, c, s: F.exp(-0.5 * ((i - F.col(c)) / F.col(s)) * ((i - F.col(c)) / F.col(s)))
        line = lambda c, s, n: A.mean(F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda i: bell(i, c, s)))
        top = line("cx", "sx", "nx") * line("cy", "sy", "ny")
    else:
        nearest = lambda c, n: F.least(F.greatest(F.ceil(F.col(c) - 0.5), F.lit(0)), F.col(n) - 1)
        top = _gauss_at(nearest("cx", "nx"), nearest("cy", "ny"))
    return rows.withColumn("_t", F.col("floor") + (1 - F.col("floor")) * top)


def _gauss_at(x, y) -> Column:
    u, v = (x - F.col("cx")) / F.col("sx"), (y - F.col("cy")) / F.col("sy")
    return F.exp(-0.5 * u * u - 0.5 * v * v)


def _clip_gain(g: Column, max_gain: float | None) -> Column:
    if not max_gain or max_gain <= 0:
        return g
    return F.least(F.greatest(g, F.lit(1.0 / max_gain)), F.lit(float(max_gain)))


def illum_gain(model: DataFrame, shape: DataFrame, normalize_to: str = "center", max_gain: float | None = MAX_GAIN,
               eps: float = EPS, positions: DataFrame | None = None) -> DataFrame:
    """Gain of every pixel position of ``shape`` from a Gaussian model: (keys, y, x, gain).

    Nothing is stored: centre and mean targets come from the model row, the gain is an expression of the
    position. ``positions`` limits the output to existing pixels.
    """
    keys = [c for c in FIELD if c in shape.columns and c in model.columns]
    if not keys:
        shape = shape.select(*[c for c in FIELD if c in shape.columns], "ny", "nx")
    rows = _scaled_model(model, shape, keys)
    on = [c for c in FIELD if c in rows.columns]
    rows = _with_target(rows, normalize_to)
    if positions is None:
        grid = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("x"))
    else:
        grid = join_dim(positions.select(*on, "y", "x"), rows, on)
    field = F.col("floor") + (1 - F.col("floor")) * _gauss_at(F.col("x"), F.col("y"))
    grid = grid.withColumn("_g", field)
    if normalize_to == "median":
        grid = join_stats(grid, exact_percentile(grid.select(*on, "_g"), on, "_g", [0.5], ["_m"]), on).withColumn("_t", F.col("_m")).drop("_m")
    gain = 1.0 + F.col("amp") * (F.col("_t") / (F.col("_g") + eps) - 1.0)
    return grid.select(*on, "y", "x", _clip_gain(gain, max_gain).alias("gain"))


def blur_field(pixels: DataFrame, shape: DataFrame, sigma_y: float, sigma_x: float | None = None, downsample: int = 2) -> DataFrame:
    """Mean over channels, every n-th pixel, blurred with the edge value held, repeated to full size."""
    sigma_x = sigma_y if sigma_x is None else sigma_x
    mean = S.project_spectral(pixels)
    ds = max(1, int(downsample))
    small = N.stride_downsample(mean, ds) if ds > 1 else mean
    small_shape = shape.withColumn("ny", F.ceil(F.col("ny") / ds).cast("int")).withColumn("nx", F.ceil(F.col("nx") / ds).cast("int"))
    blurred = N.gaussian_blur_2d(small, small_shape, sigma_y / ds, sigma_x / ds, edge="nearest")
    return N.upsample_nearest(blurred, shape, ds) if ds > 1 else blurred


def fit_profile(x: np.ndarray, p: np.ndarray, start: tuple, rounds: int = 200) -> tuple:
    """Least squares of a exp(-((x - x0) / s)^2 / 2) + c by damped Gauss-Newton steps.

    None if a step cannot be solved or the steps have not settled within ``rounds``; callers then fall back on moments.
    """
    a, x0, s, c = (float(v) for v in start)
    damp = 1e-3
    model = lambda q: q[0] * np.exp(-0.5 * ((x - q[1]) / q[2]) ** 2) + q[3]
    q = np.array([a, x0, max(abs(s), 1e-3), c])
    cost = float(((model(q) - p) ** 2).sum())
    for _ in range(rounds):
        u = (x - q[1]) / q[2]
        e = np.exp(-0.5 * u * u)
        jac = np.column_stack([e, q[0] * e * u / q[2], q[0] * e * u * u / q[2], np.ones_like(x)])
        res = p - model(q)
        h = jac.T @ jac
        try:
            step = np.linalg.solve(h + damp * np.diag(np.maximum(np.diag(h), 1e-12)), jac.T @ res)
        except np.linalg.LinAlgError:
            return None
        new = q + step
        if abs(new[2]) < 1e-6:
            new[2] = 1e-6
        fresh = float(((model(new) - p) ** 2).sum())
        if np.isfinite(fresh) and fresh <= cost:
            done = cost - fresh <= 1e-14 * max(cost, 1e-300)
            q, cost, damp = new, fresh, max(damp / 3, 1e-12)
            if done:
                break
        else:
            damp *= 5
            if damp > 1e12:  # no step of any size improves the fit
                break
    else:
        return None
    return tuple(q)


def illum_fit(field: DataFrame, shape: DataFrame, value: str = "value") -> DataFrame:
    """Gaussian model of a smooth field from its two axis profiles, with moments as the start and fallback.

    The profiles are aggregated on the executors; a fit sees one profile, as long as an image side.
    """
    prof = S.axis_profiles(field, value)
    mom = S.profile_moments(prof)
    packed = prof.groupBy(*FIELD, "axis").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_p")).join(mom, [*FIELD, "axis"])
    rows = packed.select(*FIELD, "axis", F.transform("_p", lambda r: r["value"]).alias("p"), "baseline", "peak", "top", "size", "sigma")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                p = np.asarray(r.p, dtype=float)
                s = float(r.sigma) if r.sigma == r.sigma and r.sigma else max(1.0, 0.35 * len(p))
                s = max(s, 1.0)
                fit = fit_profile(np.arange(len(p), dtype=float), p, (r.top - r.baseline, r.peak, s, r.baseline))
                x0, sig = (fit[1], max(1e-3, abs(fit[2]))) if fit is not None else (float(r.peak), s)
                out.append((r.image_id, r.slice_id, r.axis, x0 - (len(p) - 1) / 2.0, sig))
            yield pd.DataFrame(out, columns=["image_id", "slice_id", "axis", "d", "s"])

    fits = rows.mapInPandas(run, "image_id STRING, slice_id INT, axis STRING, d DOUBLE, s DOUBLE")
    at = lambda ax, c: F.max(F.when(F.col("axis") == ax, F.col(c)))
    both = fits.groupBy(*FIELD).agg(at("x", "d").alias("dx"), at("y", "d").alias("dy"), at("x", "s").alias("sigma_x"), at("y", "s").alias("sigma_y"))
    return both.join(shape.select(*FIELD, F.col("ny").alias("ref_ny"), F.col("nx").alias("ref_nx")), FIELD).withColumn(
        "amp", F.lit(1.0)).withColumn("offset", F.lit(0.0))


def apply_gain(pixels: DataFrame, gain: DataFrame, dtype_max: float | None = 65535.0, truncate: bool = False) -> DataFrame:
    """Multiply all channels of a pixel by its gain, clip to the value range."""
    on = [c for c in FIELD if c in gain.columns] + ["y", "x"]
    joined = join_wide(pixels, gain, on)
    top = (lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(dtype_max)))) if dtype_max else (lambda v: v)
    cast = (lambda v: v.cast("int")) if truncate else (lambda v: v)
    return joined.withColumn("spectrum", F.transform("spectrum", lambda v: cast(top(v * F.col("gain"))))).drop("gain")


def apply_illumination(pixels: DataFrame, shape: DataFrame, mode: str = "reference", model: DataFrame | None = None, *,
                       sigma: float = 50.0, downsample: int = 2, normalize_to: str = "center", max_gain: float | None = MAX_GAIN,
                       dtype_max: float | None = 65535.0, eps: float = EPS) -> DataFrame:
    """Correct a stack: ``reference`` (given model, no shuffle), ``gaussfit`` (model fitted to each field) or
    ``blur`` (the blurred field itself)."""
    if mode == "reference":
        if model is None:
            return pixels
        return _apply_model(pixels, shape, model, normalize_to, max_gain, dtype_max, eps)
    field = materialize(blur_field(pixels, shape, sigma, downsample=downsample))
    if mode == "gaussfit":
        fitted = materialize(illum_fit(field, shape))
        return _apply_model(pixels, shape, fitted, normalize_to, max_gain, dtype_max, eps)
    if mode != "blur":
        raise ValueError(f"unknown mode {mode!r}")
    if normalize_to == "mean":
        target = field.groupBy(*FIELD).agg(F.avg("value").alias("_t"))
    elif normalize_to == "center":
        mid = join_dim(field, shape.select(*FIELD, "ny", "nx"), FIELD)
        target = mid.filter((F.col("y") == F.floor(F.col("ny") / 2)) & (F.col("x") == F.floor(F.col("nx") / 2))).select(*FIELD, F.col("value").alias("_t"))
    else:
        target = exact_percentile(field, FIELD, "value", [0.5], ["_t"])
    gain = join_stats(field, target, FIELD).select(*FIELD, "y", "x", _clip_gain(F.col("_t") / (F.col("value") + eps), max_gain).alias("gain"))
    return apply_gain(pixels, gain, dtype_max)


def _apply_model(pixels, shape, model, normalize_to, max_gain, dtype_max, eps):
    if normalize_to == "median":
        return apply_gain(pixels, illum_gain(model, shape, normalize_to, max_gain, eps), dtype_max)
    keys = [c for c in FIELD if c in model.columns]
    rows = _with_target(_scaled_model(model, shape, keys), normalize_to)
    on = [c for c in FIELD if c in rows.columns]
    joined = join_dim(pixels, rows, on)
    g = F.col("floor") + (1 - F.col("floor")) * _gauss_at(F.col("x"), F.col("y"))
    gain = _clip_gain(1.0 + F.col("amp") * (F.col("_t") / (g + eps) - 1.0), max_gain)
    top_value = (lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(dtype_max)))) if dtype_max else (lambda v: v)
    scaled = A.let(gain, lambda k: F.transform("spectrum", lambda v: top_value(v * k)))
    return joined.withColumn("spectrum", scaled).select(pixels.columns)


# --- radial corrections and masks ----------------------------------------------------------------

def intensity_correction(field: DataFrame, kind: str, params: dict, keys: list[str] | None = None) -> DataFrame:
    """Correction max(model) / model per pixel from saved parameters: (keys, y, x, correction, model)."""
    keys = keys or FIELD
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    if kind == "gaussian":
        model = elliptic_gaussian(x, y, params["xc"], params["yc"], params["a"], params["b"], params["amplitude"])
    else:
        dx, dy = x - params["xc"], y - params["yc"]
        model = radial_model(kind, dx * dx + dy * dy, params)
    rows = field.select(*keys, "y", "x", model.alias("model"))
    top = rows.groupBy(*keys).agg(F.max("model").alias("_top"))
    return join_stats(rows, top, keys).select(*keys, "y", "x", (F.col("_top") / F.col("model")).alias("correction"), "model")


def fit_quadratic(field: DataFrame, value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """Least-squares peak + slope * ((x - xc)^2 + (y - yc)^2) per field.

    In the powers of x and y the model is linear, so sums over pixels give the normal equations; the driver
    is not involved, the 4 x 4 solve is one row per field.
    """
    keys = keys or FIELD
    x, y, v = F.col("x").cast("double"), F.col("y").cast("double"), F.col(value)
    terms = [F.lit(1.0), x, y, x * x + y * y]
    sums = [F.sum(terms[i] * terms[j]).alias(f"a{i}{j}") for i in range(4) for j in range(i, 4)]
    rhs = [F.sum(terms[i] * v).alias(f"b{i}") for i in range(4)]
    agg = field.groupBy(*keys).agg(*sums, *rhs)
    types = ", ".join(f"`{k}` {field.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                a = np.array([[r[f"a{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)])
                c0, c1, c2, c3 = np.linalg.lstsq(a, np.array([r[f"b{i}"] for i in range(4)]), rcond=None)[0]
                xc, yc = (-c1 / (2 * c3), -c2 / (2 * c3)) if c3 else (0.0, 0.0)
                out.append((*[r[k] for k in keys], xc, yc, c0 - c3 * (xc * xc + yc * yc), c3))
            yield pd.DataFrame(out, columns=[*keys, "xc", "yc", "peak", "slope"])

    return agg.mapInPandas(run, f"{types}, xc DOUBLE, yc DOUBLE, peak DOUBLE, slope DOUBLE")


def fit_radial(field: DataFrame, kind: str = "linear", value: str = "value", keys: list[str] | None = None, rounds: int = 30) -> DataFrame:
    """Fit of the ``linear`` cone or the ``gaussian`` hill by Gauss-Newton steps whose sums are aggregated.

    The pixels are saved once; each step is one pass over them, and the parameters of a field are one row and are joined
    back. ``converged`` says whether the last step of a field was small; at most ``rounds`` steps are made.
    """
    keys = keys or FIELD
    field = materialize(field.select(*keys, "y", "x", value))
    n_par = 4 if kind == "linear" else 5
    start = fit_quadratic(field, value, keys)
    size = field.groupBy(*keys).agg(F.max("x").alias("_nx"), F.max("y").alias("_ny"), F.max(value).alias("_vmax"))
    params = start.join(size, keys)
    inside = lambda c, n: F.least(F.greatest(F.col(c), F.lit(0.0)), F.col(n).cast("double"))
    base = [*keys, inside("xc", "_nx").alias("p0"), inside("yc", "_ny").alias("p1")]
    if kind == "linear":
        params = params.select(*base, F.col("_vmax").alias("p2"), F.lit(-1.0).alias("p3"))
    else:
        bend = F.greatest(-F.col("slope") / F.greatest(F.col("peak"), F.lit(1e-9)), F.lit(1e-6))
        params = params.select(*base, bend.alias("p2"), bend.alias("p3"), F.col("_vmax").alias("p4"))
    params = materialize(params)
    x, y, v = F.col("x").cast("double"), F.col("y").cast("double"), F.col(value)
    dx, dy = x - F.col("p0"), y - F.col("p1")
    if kind == "linear":
        r = F.sqrt(dx * dx + dy * dy)
        safe = F.greatest(r, F.lit(1e-9))
        model = F.col("p2") + F.col("p3") * r
        jac = [-F.col("p3") * dx / safe, -F.col("p3") * dy / safe, F.lit(1.0), r]
    else:
        e = F.exp(-F.col("p2") * dx * dx - F.col("p3") * dy * dy)
        model = F.col("p4") * e
        jac = [model * 2 * F.col("p2") * dx, model * 2 * F.col("p3") * dy, -model * dx * dx, -model * dy * dy, e]
    types = ", ".join(f"`{k}` {field.schema[k].dataType.simpleString()}" for k in keys)
    names = [f"p{i}" for i in range(n_par)]

    def step(batches):
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                a = np.array([[r[f"a{min(i, j)}{max(i, j)}"] for j in range(n_par)] for i in range(n_par)])
                b = np.array([r[f"b{i}"] for i in range(n_par)])
                a = a + 1e-9 * np.diag(np.maximum(np.diag(a), 1e-12))
                move = np.linalg.lstsq(a, b, rcond=None)[0]
                old = np.array([r[n] for n in names])
                room = np.maximum(np.abs(old) * 0.5, np.array([4.0, 4.0] + [1e-4 if kind != "linear" else 1.0] * (n_par - 2)))
                new = old + np.clip(move, -room, room)
                if kind != "linear":
                    new[2:4] = np.maximum(new[2:4], 1e-12)
                out.append((*[r[k] for k in keys], *new, float(np.abs(new - old).max())))
            yield pd.DataFrame(out, columns=[*keys, *names, "moved"])

    for _ in range(rounds):
        joined = join_dim(field.select(*keys, "y", "x", value), params.select(*keys, *names), keys)
        sums = [F.sum(jac[i] * jac[j]).alias(f"a{i}{j}") for i in range(n_par) for j in range(i, n_par)]
        rhs = [F.sum(jac[i] * (v - model)).alias(f"b{i}") for i in range(n_par)]
        agg = joined.groupBy(*keys, *names).agg(*sums, *rhs)
        params = materialize(agg.mapInPandas(step, f"{types}, " + ", ".join(f"{n} DOUBLE" for n in names) + ", moved DOUBLE"))
        if (params.agg(F.max("moved")).first()[0] or 0.0) < 1e-8:
            break
    names_out = ["xc", "yc", "peak", "slope"] if kind == "linear" else ["xc", "yc", "a", "b", "amplitude"]
    return params.select(*keys, *[F.col(n).alias(o) for n, o in zip(names, names_out)], (F.col("moved") < 1e-8).alias("converged"))


def binned_correction(field: DataFrame, shape: DataFrame, size: int = 64, keys: list[str] | None = None) -> DataFrame:
    """Correction from block means, zoomed back linearly and scaled to a maximum of 1."""
    keys = keys or FIELD
    cells = field.groupBy(*keys, F.expr(f"CAST(y div {size} AS INT)").alias("y"), F.expr(f"CAST(x div {size} AS INT)").alias("x")).agg(F.avg("value").alias("value"))
    top = cells.groupBy(*keys).agg(F.max("value").alias("_top"))
    inv = join_stats(cells, top, keys).withColumn("value", F.col("_top") / F.col("value")).drop("_top")
    zoom = shape.withColumn("sy", F.ceil(F.col("ny") / size).cast("int")).withColumn("sx", F.ceil(F.col("nx") / size).cast("int"))
    fine = N.upsample_bilinear(inv, zoom, keys)
    high = fine.groupBy(*keys).agg(F.max("value").alias("_m"))
    return join_stats(fine, high, keys).select(*keys, "y", "x", (F.col("value") / F.col("_m")).alias("correction"))


def mask(shape: DataFrame, kind: str, strength: float, offset_x: int = 0, offset_y: int = 0) -> DataFrame:
    """Masks over the positions of each field: ``lorentzian``, ``diamond`` (nested rectangles) or ``pyramid``
    (product of two triangles). Blurring is left to ``gaussian_blur_2d``."""
    keys = [c for c in FIELD if c in shape.columns]
    grid = shape.select(*keys, "ny", "nx", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("y")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("x"))
    if kind == "lorentzian":
        at = lambda p, n: F.col(p) * F.col(n) / F.greatest(F.col(n) - 1, F.lit(1))
        dx = at("x", "nx") - (F.floor(F.col("nx") / 2) + offset_x)
        dy = at("y", "ny") - (F.floor(F.col("ny") / 2) + offset_y)
        rows = grid.select(*keys, "y", "x", radial_model("lorentzian", dx * dx + dy * dy, {"strength": strength}).alias("value"))
        top = rows.groupBy(*keys).agg(F.max("value").alias("_top"))
        return join_stats(rows, top, keys).withColumn("value", F.col("value") / F.col("_top")).drop("_top")
    x, y = F.col("x") - offset_x, F.col("y") - offset_y
    off = (x < 0) | (x >= F.col("nx")) | (y < 0) | (y >= F.col("ny"))
    if kind == "diamond":
        top = F.floor((F.col("ny") + F.col("nx")) / 4) - 1
        ring = F.least(x, F.col("nx") - 1 - x, y, F.col("ny") - 1 - y, top)
        value = F.lit(strength) + (1 - strength) / (top + 1) * ring
        centre = (F.col("nx") % 2 == 1) & (x == top + 1) & (y == top + 1)
        return grid.select(*keys, "y", "x", F.when(off, F.lit(strength)).when(centre, F.lit(1.0)).otherwise(value).alias("value"))
    if kind != "pyramid":
        raise ValueError(f"unknown mask {kind!r}")
    low = math.sqrt(strength)

    def triangle(i, n):
        mid = F.floor(F.col(n) / 2)
        slope = (1 - low) / mid
        return F.when(i < mid, slope * i + low).otherwise(-slope * i + (2 - low))

    edge = lambda p, n: F.least(F.greatest(p, F.lit(0)), F.col(n) - 1)
    return grid.select(*keys, "y", "x", (triangle(edge(x, "nx"), "nx") * triangle(edge(y, "ny"), "ny")).alias("value"))


def apply_mask(correction: DataFrame, masked: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Correction times mask, scaled to a maximum of 1."""
    keys = keys or FIELD
    both = join_wide(correction, masked.withColumnRenamed("value", "_mask"), [*keys, "y", "x"]).withColumn("correction", F.col("correction") * F.col("_mask")).drop("_mask")
    top = both.groupBy(*keys).agg(F.max("correction").alias("_top"))
    return join_stats(both, top, keys).withColumn("correction", F.col("correction") / F.col("_top")).drop("_top")
