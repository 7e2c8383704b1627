"""Column expressions over spectra; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPS = 1e-8
DOUBLE_EPS = 2.220446049250313e-16


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; a name used inside a lambda would be recomputed
    for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def finite_or_zero(v: Column) -> Column:
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(v)


def nan_to_zero(s) -> Column:
    """NaN and both infinities become 0; every other value is kept."""
    return F.transform(_c(s), finite_or_zero)


def clamp_nonneg(s) -> Column:
    """``nan_to_zero`` and then ``max(v, 0)``."""
    return F.transform(_c(s), lambda v: F.greatest(finite_or_zero(v), F.lit(0.0)))


def total(s) -> Column:
    return F.aggregate(_c(s), F.lit(0.0), lambda acc, v: acc + v)


def mean(s) -> Column:
    return total(s) / F.size(_c(s))


def dot(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda p, q: p * q))


def sum_squares(s) -> Column:
    return F.aggregate(_c(s), F.lit(0.0), lambda acc, v: acc + v * v)


def constant(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def has_signal(s, eps: float = EPS) -> Column:
    """True when any finite entry is larger than ``eps`` in size."""
    s = _c(s)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return F.coalesce(F.exists(s, lambda v: F.coalesce(finite(v) & (F.abs(v) > eps), F.lit(False))), F.lit(False))


def prepare_fixed(s, eps: float = EPS) -> Column:
    """A spectrum made usable as a fixed row: finite, shifted up if it dips below 0, scale kept.

    NULL when nothing exceeds ``eps``.
    """
    def lift(clean):
        return let(
            F.least(F.array_min(clean), F.lit(0.0)),
            lambda low: F.transform(clean, lambda v: F.greatest(v - low, F.lit(0.0))),
        )

    return let(let(nan_to_zero(s), lift), lambda h: F.when(F.array_max(h) > eps, h))


def is_active(s, eps: float = EPS) -> Column:
    return F.coalesce(F.exists(clamp_nonneg(s), lambda v: v > eps), F.lit(False))


def take(s, channels) -> Column:
    """Channel subset in the given order; an index outside the spectrum is an error."""
    s = _c(s)
    if any(int(c) < 0 for c in channels):
        raise IndexError("channel indices start at 0")
    picks = F.array(*[F.lit(int(c)) for c in channels])
    return F.transform(picks, lambda i: F.element_at(s, i + 1))


def peak_channel(s) -> Column:
    """Index of the first maximum."""
    return let(_c(s), lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def gradient(s) -> Column:
    """Central differences with one-sided ends, unit spacing."""

    def inner(v):
        n = F.size(v)
        at = lambda i: F.element_at(v, i + 1)
        return F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.when(i == 0, at(F.lit(1)) - at(F.lit(0)))
            .when(i == n - 1, at(n - 1) - at(n - 2))
            .otherwise((at(i + 1) - at(i - 1)) / 2.0),
        )

    return let(_c(s), lambda v: F.when(F.size(v) >= 2, inner(v)).otherwise(F.transform(v, lambda e: F.lit(0.0))))


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised Gaussian weights of radius ``int(truncate * sigma + 0.5)``."""
    import math

    radius = int(truncate * float(sigma) + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    scale = sum(raw)
    return [v / scale for v in raw]


def reflect_index(i: Column, n: Column) -> Column:
    """Half-sample symmetric reflection (d c b a | a b c d | d c b a) for any offset."""
    period = n * 2
    m = F.pmod(i, period)
    return F.when(m < n, m).otherwise(period - 1 - m)


def smooth(s, sigma: float) -> Column:
    """1-D Gaussian smoothing of a spectrum with reflecting edges."""
    s = _c(s)
    if not sigma or sigma <= 0:
        return s
    kernel = gaussian_kernel(sigma)
    radius = (len(kernel) - 1) // 2
    offsets = F.sequence(F.lit(-radius), F.lit(radius))

    def run(v):
        n = F.size(v)

        def at(i):
            reach = F.transform(offsets, lambda o: F.element_at(v, reflect_index(i + o, n) + 1))
            return dot(reach, constant(kernel))

        return F.transform(F.sequence(F.lit(0), n - 1), at)

    return let(s, run)


def unit_norm(s) -> Column:
    scale = lambda v: let(F.sqrt(sum_squares(v)), lambda n: F.when(n > 0, F.transform(v, lambda e: e / n)))
    return let(_c(s), scale)


def cosine(a, b) -> Column:
    """Cosine similarity of two unit vectors, clipped to [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def smooth_by(s, sigma: Column) -> Column:
    """Gaussian smoothing as ``smooth``, with the sigma of the row; none where it is not above 0."""
    s = _c(s)
    radius = F.when(sigma > 0, F.floor(4.0 * sigma + 0.5)).otherwise(F.lit(0)).cast("int")
    offsets = F.sequence(-radius, radius)
    weight = lambda k: F.when(sigma > 0, F.exp(-0.5 * (k / sigma) * (k / sigma))).otherwise(F.lit(1.0))
    add = lambda term: F.aggregate(offsets, F.lit(0.0), lambda a, k: a + term(k))
    n = F.size(s)
    at = lambda i: add(lambda k: weight(k) * F.get(s, reflect_index(i + k, n).cast("int")))
    return let(add(weight), lambda norm: F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(i) / norm))
