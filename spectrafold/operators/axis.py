"""The spectral axis: construction, lookup, resonance ranges, interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrays import let
from ..functions.units import CM_INV, normalize_spectral_unit
from ..scale import join_dim, running_total

# Default resonance rows (center, width) on a wavenumber axis.
DEFAULT_RESONANCES = [(2850, 20), (2930, 15), (3000, 15), (3060, 15), (3120, 15), (3180, 15)]


def raman_axis(images: DataFrame) -> DataFrame:
    """One axis row per image and channel from beam settings.

    ``images`` has ``image_id, n_channels, minimum, maximum, step, fixed_nm, beam, unit``. The tuned
    wavelengths are evenly spaced; with no ``maximum`` they follow from ``step``. ``beam`` says which
    beam is tuned.
    """
    low = F.when(F.col("maximum") < F.col("minimum"), F.col("maximum")).otherwise(F.col("minimum"))
    high = F.coalesce(
        F.greatest("minimum", "maximum"), F.col("minimum") + F.col("step") * (F.col("n_channels") - 1)
    )
    high = F.when(F.col("maximum").isNull(), F.col("minimum") + F.col("step") * (F.col("n_channels") - 1)).otherwise(high)
    low = F.when(F.col("maximum").isNull(), F.col("minimum")).otherwise(low)
    unit = normalize_spectral_unit("unit")
    rows = images.select(
        "*", low.alias("_low"), high.alias("_high"), unit.alias("_unit"),
        F.explode(F.sequence(F.lit(0), F.col("n_channels") - 1)).alias("channel"),
    )
    wave = F.when(
        F.col("n_channels") > 1,
        F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("channel") / (F.col("n_channels") - 1),
    ).otherwise(F.col("_low"))
    shift = 1e7 / wave - 1e7 / F.col("fixed_nm")
    value = (
        F.when(F.col("_unit") == "index", F.col("channel").cast("double"))
        .when(F.col("_unit") == "nm", wave)
        .when(F.lower("beam") == "stokes", -shift)
        .otherwise(shift)
    )
    return rows.select("image_id", "channel", value.alias("value"), F.col("_unit").alias("unit"))


def attach_axis(voxels: DataFrame, axis: DataFrame) -> DataFrame:
    side = axis.select("image_id", "channel", F.col("value").alias("axis_value"), *[c for c in ("label", "unit") if c in axis.columns])
    return join_dim(voxels, side, ["image_id", "channel"])


def resonance_channels(resonances: DataFrame, axis: DataFrame, row_id: str = "resonance_id") -> DataFrame:
    """Channels inside center +- width (inclusive) for every row, or the nearest one when none is.

    Both tables are dimensions of an image; the window below sees the channels of one row only.
    """
    pairs = resonances.join(axis.select("image_id", "channel", F.col("value").alias("axis_value")), "image_id")
    inside = F.col("axis_value").between(F.col("center") - F.col("width"), F.col("center") + F.col("width"))
    per_row = Window.partitionBy("image_id", row_id)
    nearest = F.min(F.struct(F.abs(F.col("axis_value") - F.col("center")), "axis_value", "channel")).over(per_row)
    marked = pairs.select(
        "*", inside.alias("_inside"),
        F.max(inside.cast("int")).over(per_row).alias("_any"),
        nearest["channel"].alias("_nearest"),
    )
    keep = F.col("_inside") | ((F.col("_any") == 0) & (F.col("channel") == F.col("_nearest")))
    return marked.filter(keep).drop("_inside", "_any", "_nearest", "axis_value")


def at_or_below(ordered: Column, t: Column) -> Column:
    """How many of the ascending values are at or below ``t``, found by halving inside one expression."""
    start = F.struct(F.lit(0).alias("lo"), F.size(ordered).alias("hi"))

    def halve(s, _):
        mid = F.shiftright(s["lo"] + s["hi"] + 1, 1)
        return F.when(F.get(ordered, mid - 1) <= t, F.struct(mid.alias("lo"), s["hi"].alias("hi"))).otherwise(
            F.struct(s["lo"].alias("lo"), F.greatest(s["lo"], mid - 1).alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(ordered)))), start, halve, lambda s: s["lo"])


def nearest_channel(targets: DataFrame, axis: DataFrame, target: str = "target") -> DataFrame:
    """The channel whose axis value is closest, the first one on ties; one row per target row.

    The axis of an image travels as one sorted array, in which each target is searched by halving, so no target meets
    all channels. Axis points without a value are no candidates; a target without a value has no channel.
    """
    points = axis.filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("image_id", "value").agg(F.min("channel").alias("channel"))
    packed = points.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("value", "channel"))).alias("_a"))
    side = packed.select("image_id", F.col("_a.value").alias("_v"), F.col("_a.channel").alias("_c"))
    t = F.col(target).cast("double")

    def best(n):
        low, high = F.get("_v", n - 1), F.get("_v", n)
        down, up = F.abs(low - t), F.abs(high - t)
        above = low.isNull() | (up < down) | ((up == down) & (F.get("_c", n) < F.get("_c", n - 1)))
        i = F.when(F.coalesce(above, F.lit(False)), n).otherwise(n - 1)
        return F.when(t.isNotNull() & ~F.isnan(t), F.struct(F.get("_c", i).alias("channel"), F.get("_v", i).alias("axis_value")))

    found = join_dim(targets, side, ["image_id"]).withColumn("_b", let(at_or_below(F.col("_v"), t), best))
    return found.select(*targets.columns, F.col("_b.channel").alias("channel"), F.col("_b.axis_value").alias("axis_value"))


def interpolate_to_axis(curves: DataFrame, axis: DataFrame, keys: list[str], value: str = "value",
                        position: str = "axis_value") -> DataFrame:
    """Linear interpolation of long curves onto an axis; outside the curve its end value holds. The keys
    include ``image_id``.

    Source points need no order; of equal positions the one with the largest value counts from there on. A curve
    meets the axis of its image as one row, both as sorted arrays, and each axis value is searched by halving. Points
    without a position and axis values that are null are left out.
    """
    points = curves.filter(F.col(position).isNotNull() & ~F.isnan(position))
    sorted_points = F.array_sort(F.collect_list(F.struct(F.col(position).cast("double").alias("x"), F.col(value).cast("double").alias("v"))))
    packed = points.groupBy(*keys).agg(sorted_points.alias("_p")).select(*keys, F.col("_p.x").alias("_x"), F.col("_p.v").alias("_v"))
    goals = axis.filter(F.col("value").isNotNull()).groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("channel", F.col("value").alias("t")))).alias("_t"))

    def at(goal):
        def between(n):
            x0, x1, v0, v1 = F.get("_x", n - 1), F.get("_x", n), F.get("_v", n - 1), F.get("_v", n)
            part = (goal["t"] - x0) / (x1 - x0)
            return F.when(n == 0, v1).when(n == F.size("_x"), v0).otherwise(v0 + part * (v1 - v0))

        return F.struct(goal["channel"].alias("channel"), goal["t"].alias("axis_value"), let(at_or_below(F.col("_x"), goal["t"]), between).alias("value"))

    hits = join_dim(packed, goals, ["image_id"]).select(*keys, F.explode(F.transform("_t", at)).alias("_o"))
    return hits.select(*keys, "_o.channel", "_o.axis_value", "_o.value")


def sort_axis(axis: DataFrame, key: str = "image_id") -> DataFrame:
    """New channel numbers in ascending order of the axis value, old ones kept beside them.

    Rows are numbered inside ranges of key and value, and the ranges are shifted by what lies before them, so one axis
    may fill many tasks.
    """
    counted = running_total(axis, [key], [F.col("value"), F.col("channel")], F.lit(1), "sorted_channel")
    return counted.select(*axis.columns, (F.col("sorted_channel") - 1).cast("int").alias("sorted_channel"))


def default_resonances(axis: DataFrame, rows: int) -> DataFrame:
    """Default center and width of the first ``rows`` resonance rows of each image.

    Built-in rows apply on a wavenumber axis that contains them, otherwise positions are quantiles of
    the axis and widths the larger of the median spacing and 2 % of the span.
    """
    n_default = len(DEFAULT_RESONANCES)
    table = F.array(*[F.struct(F.lit(float(c)).alias("c"), F.lit(float(w)).alias("w")) for c, w in DEFAULT_RESONANCES])
    order = Window.partitionBy("image_id").orderBy("value")
    steps = axis.select("image_id", "value").distinct().withColumn("_d", F.col("value") - F.lag("value").over(order))
    spacing = steps.groupBy("image_id").agg(F.median("_d").alias("_spacing"))
    quantiles = [
        F.percentile("value", F.lit((i + 1) / (n_default + 1))) for i in range(n_default)
    ]
    facts = axis.groupBy("image_id").agg(
        F.min("value").alias("_min"), F.max("value").alias("_max"), F.count(F.lit(1)).alias("_n"),
        F.array(*quantiles).alias("_q"), F.first("unit").alias("_u"),
        F.bool_and(F.abs(F.col("value") - F.rint("value")) <= 1e-8 + 1e-5 * F.abs(F.rint("value"))).alias("_whole"),
    ).join(spacing, "image_id")
    both = facts.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("_i", F.col("row") % n_default)
    pick = F.element_at(table, F.col("_i") + 1)
    unit = normalize_spectral_unit("_u")
    builtin = (unit == CM_INV) & pick["c"].between(F.col("_min"), F.col("_max"))
    single = F.col("_n") == 1
    center = F.when(single, F.col("_min")).otherwise(F.element_at("_q", F.col("_i") + 1))
    width = F.when(single, F.lit(1.0)).otherwise(
        F.greatest(F.coalesce("_spacing", F.lit(1.0)), 0.02 * (F.col("_max") - F.col("_min")))
    )
    index = (unit == "index") & F.col("_whole")
    return both.select(
        "image_id", "row",
        F.when(builtin, pick["c"]).when(index, F.rint(center)).otherwise(center).alias("center"),
        F.when(builtin, pick["w"]).when(index & ~single, F.greatest(F.rint(width), F.lit(1.0))).otherwise(width).alias("width"),
    )
