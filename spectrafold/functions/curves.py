"""Closed-form curves used as model spectra, blend ramps and radial masks."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .arrays import DOUBLE_EPS


def _c(v) -> Column:
    if isinstance(v, Column):
        return v
    return F.col(v) if isinstance(v, str) else F.lit(float(v))


def gauss(x, amplitude, x0, sigma, offset=0.0) -> Column:
    d = _c(x) - _c(x0)
    return _c(amplitude) * F.exp(-(d * d) / (2.0 * _c(sigma) * _c(sigma))) + _c(offset)


def gaussian_peak(x, center, hwhm, amplitude) -> Column:
    """Peak that falls to half its height at ``center`` +- ``hwhm``; exact zeros are lifted."""
    sigma = _c(hwhm) / F.lit(math.sqrt(2.0 * math.log(2.0)))
    value = gauss(x, amplitude, center, sigma)
    return F.when(value == 0, F.lit(DOUBLE_EPS)).otherwise(value)


def linear_weight(i, n) -> Column:
    """Blend weight of the first image in row ``i`` of ``n`` shared rows: a ramp mirrored about 0.5."""
    i, n = _c(i), _c(n)
    half = F.floor(n / 2)
    slope = F.lit(-0.5) / (n / 2 + 1)
    return (
        F.when(i < half, 1.0 + slope * i)
        .when(i >= n - half, -slope * (n - 1 - i))
        .otherwise(F.lit(0.5))
    )


def cosine_weight(i, n) -> Column:
    i, n = _c(i), _c(n)
    return 0.5 * (1.0 + F.cos(F.lit(math.pi) * (i + 1) / (n + 1)))


def ramp_weight(i, n) -> Column:
    """Plain ramp 1 to 0 over ``n`` rows; a single row weighs 1."""
    i, n = _c(i), _c(n)
    return F.when(n > 1, 1.0 - i / (n - 1)).otherwise(F.lit(1.0))


def radial_model(kind: str, r2, params: dict) -> Column:
    """Brightness as a function of the squared distance from the optical centre.

    ``linear`` and ``quadratic`` take ``peak`` and ``slope``; ``lorentzian`` takes ``strength``;
    ``inverse`` takes ``strength``, ``farthest`` (largest squared distance) and ``gamma``.
    """
    r2 = _c(r2)
    if kind == "linear":
        return F.lit(float(params["peak"])) + F.sqrt(r2) * F.lit(float(params["slope"]))
    if kind == "quadratic":
        return F.lit(float(params["peak"])) + r2 * F.lit(float(params["slope"]))
    if kind == "lorentzian":
        g = F.lit(1000.0 * float(params["strength"]))
        return g / (r2 + g * g)
    if kind == "inverse":
        far = params["farthest"]
        far = far if isinstance(far, Column) else F.lit(float(far))
        power = F.lit(-math.log(float(params["strength"]))) / F.ln(far)
        value = 1.0 / (F.lit(float(params.get("gamma", 1.0))) * F.pow(r2, power))
        return F.when(r2 == 0, F.lit(1.0)).otherwise(F.least(value, F.lit(1.0)))
    raise ValueError(f"unknown radial model {kind!r}")


def elliptic_gaussian(x, y, x0, y0, a, b, amplitude) -> Column:
    dx, dy = _c(x) - _c(x0), _c(y) - _c(y0)
    return _c(amplitude) * F.exp(-_c(a) * dx * dx - _c(b) * dy * dy)
