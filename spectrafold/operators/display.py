"""False colours: components mapped to colour ramps and summed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays as A
from ..scale import join_stats
from ..tables import FIELD, PIXEL


def ramp(norm: Column, stops: list[tuple[float, tuple[float, float, float]]], band: int) -> Column:
    """One colour band of a gradient given as (position, rgb) stops, ends held."""
    stops = sorted(stops)
    if len(stops) == 2 and stops[1][0] <= stops[0][0]:
        return F.when(norm >= stops[1][0], F.lit(float(stops[1][1][band]))).otherwise(F.lit(float(stops[0][1][band])))
    out = F.lit(float(stops[-1][1][band]))
    for (p0, c0), (p1, c1) in reversed(list(zip(stops, stops[1:]))):
        part = F.lit(float(c0[band])) + (norm - p0) / (p1 - p0) * (c1[band] - c0[band])
        out = F.when(norm < p1, part).otherwise(out)
    return F.when(norm <= stops[0][0], F.lit(float(stops[0][1][band]))).otherwise(out)


def false_color(abundance: DataFrame, levels: list[tuple[float, float]], gradients: list[list], scale: float = 65535.0) -> DataFrame:
    """Composite of all components: level window, colour ramp, sum, clip, truncated integers. Row-local."""
    bands = []
    for b in range(3):
        total = F.lit(0.0)
        for i, ((low, high), stops) in enumerate(zip(levels, gradients)):
            if high <= low:
                continue
            norm = F.least(F.greatest((F.element_at("w", i + 1) - low) / (high - low), F.lit(0.0)), F.lit(1.0))
            total = total + ramp(norm, stops, b)
        bands.append((F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)) * scale).cast("int"))
    return abundance.select(*PIXEL, bands[0].alias("r"), bands[1].alias("g"), bands[2].alias("b"))


def seed_composite(abundance: DataFrame, colors: list[tuple[float, float, float]], k: int, scale: float = 65535.0) -> DataFrame:
    """Each map divided by its own maximum, tinted and summed."""
    clean = abundance.withColumn("w", A.clamp_nonneg("w"))
    tops = clean.groupBy(*FIELD).agg(F.array(*[F.max(F.element_at("w", j + 1)) for j in range(k)]).alias("_top"))
    joined = join_stats(clean, tops, FIELD)
    unit = lambda j: F.when(F.element_at("_top", j + 1) > 0, F.element_at("w", j + 1) / F.element_at("_top", j + 1)).otherwise(F.lit(0.0))
    bands = []
    for b in range(3):
        total = F.lit(0.0)
        for j in range(k):
            total = total + unit(j) * float(colors[j][b])
        bands.append((F.least(total, F.lit(1.0)) * scale).cast("int"))
    return joined.select(*PIXEL, bands[0].alias("r"), bands[1].alias("g"), bands[2].alias("b"))
