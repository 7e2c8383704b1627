"""Mosaics from overlapping tiles.

``tiles`` has one row per tile pixel: ``mosaic_id, tx, ty, y, x, spectrum``. Only overlap strips are sent
to the correlation; what comes back is one offset per tile pair. Pixels then move by arithmetic, and only
pixels inside overlaps are shuffled to be blended.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import arrays as A
from ..functions.curves import cosine_weight, linear_weight
from ..scale import join_dim, materialize
from .stats import sigma_clip


def tile_ranks(tiles: DataFrame, x_direction: str = "right", y_direction: str = "down") -> DataFrame:
    """Column and row number of every tile position; raises on a grid with holes."""
    known = materialize(tiles.select("mosaic_id", "tx", "ty").distinct())
    order = lambda c, up: Window.partitionBy("mosaic_id").orderBy(F.asc(c) if up else F.desc(c))
    ranked = known.select(
        "mosaic_id", "tx", "ty",
        (F.dense_rank().over(order("tx", x_direction == "right")) - 1).alias("cx"),
        (F.dense_rank().over(order("ty", y_direction == "down")) - 1).alias("ry"),
    )
    from ..sources.readers import grid_completeness

    missing = grid_completeness(known).take(3)
    if missing:
        raise ValueError(f"missing tiles: {[(r['mosaic_id'], r['tx'], r['ty']) for r in missing]}")
    size = ranked.groupBy("mosaic_id").agg((F.max("cx") + 1).alias("n_cols"), (F.max("ry") + 1).alias("n_rows"))
    return ranked.join(size, "mosaic_id")


def tile_neighbours(tiles: DataFrame) -> DataFrame:
    """Next tile below in the same column and next tile in the next column, in sorted position order."""
    known = tiles.select("mosaic_id", "tx", "ty").distinct()
    below = Window.partitionBy("mosaic_id", "tx").orderBy("ty")
    right = Window.partitionBy("mosaic_id", "ty").orderBy("tx")
    return known.select("mosaic_id", "tx", "ty", F.lead("ty").over(below).alias("below"), F.lead("tx").over(right).alias("right"))


def overlap_pairs(tiles: DataFrame, ny: int, overlap: int) -> DataFrame:
    """Rows of the upper tile paired with the rows of the lower tile at the nominal overlap."""
    near = materialize(tile_neighbours(tiles).filter("below IS NOT NULL").select("mosaic_id", "tx", "ty", "below"))
    top = join_dim(tiles, near, ["mosaic_id", "tx", "ty"]).filter(F.col("y") >= ny - overlap).select(
        "mosaic_id", "tx", "ty", "below", (F.col("y") - (ny - overlap)).alias("y"), "x", F.col("spectrum").alias("top"))
    bottom = tiles.filter(F.col("y") < overlap).select(
        "mosaic_id", "tx", F.col("ty").alias("below"), "y", "x", F.col("spectrum").alias("bottom"))
    return top.join(bottom, ["mosaic_id", "tx", "below", "y", "x"])


# --- grid mosaic ---------------------------------------------------------------------------------

def _sequential_weight(offset: Column, rank: Column, count: Column, size: int, overlap: int, kind: str = "ramp") -> Column:
    """Weight of a tile row (or column) when tiles are blended one after the other.

    A tile enters with the rising half of the ramp and is faded by every later tile that covers it.
    """
    if overlap <= 0:
        return F.lit(1.0)
    step = size - overlap

    def fall(i):
        if kind == "ramp":
            return F.lit(1.0) - i / F.lit(float(overlap - 1)) if overlap > 1 else F.lit(1.0)
        return (linear_weight if kind == "linear" else cosine_weight)(i, F.lit(overlap))

    enter = F.when((rank > 0) & (offset < overlap), 1.0 - fall(offset)).otherwise(F.lit(1.0))
    weight = enter
    for later in range(1, -(-size // step)):
        at = offset - later * step
        weight = weight * F.when((rank + later < count) & (at >= 0) & (at < overlap), fall(at)).otherwise(F.lit(1.0))
    return weight


def mosaic_grid(tiles: DataFrame, ny: int, nx: int, overlap_y: int, overlap_x: int, n_channels: int, *,
                x_direction: str = "right", y_direction: str = "down", profile: str = "ramp") -> DataFrame:
    """Mosaic at the nominal overlap with a linear ramp; a missing tile is an error."""
    if overlap_y >= ny or overlap_x >= nx:
        raise ValueError("the overlap is as large as a tile")
    placed = join_dim(tiles, tile_ranks(tiles, x_direction, y_direction), ["mosaic_id", "tx", "ty"])
    w = _sequential_weight(F.col("y"), F.col("ry"), F.col("n_rows"), ny, overlap_y, profile) * _sequential_weight(
        F.col("x"), F.col("cx"), F.col("n_cols"), nx, overlap_x, profile)
    shared = ((F.col("ry") > 0) & (F.col("y") < overlap_y)) | ((F.col("ry") < F.col("n_rows") - 1) & (F.col("y") >= ny - overlap_y))
    shared = shared | ((F.col("cx") > 0) & (F.col("x") < overlap_x)) | ((F.col("cx") < F.col("n_cols") - 1) & (F.col("x") >= nx - overlap_x))
    moved = placed.select(
        "mosaic_id", (F.col("ry") * (ny - overlap_y) + F.col("y")).alias("y"), (F.col("cx") * (nx - overlap_x) + F.col("x")).alias("x"),
        "spectrum", w.alias("_w"), shared.alias("_shared"))
    return _blend(moved, n_channels, normalize=False)


def _blend(moved: DataFrame, n_channels: int, normalize: bool = True) -> DataFrame:
    """Weighted sum of pixels that meet; pixels outside overlaps pass without a shuffle."""
    alone = moved.filter("NOT _shared").select("mosaic_id", "y", "x", "spectrum")
    total = F.sum("_w") if normalize else F.lit(1.0)
    cells = [F.sum(F.element_at("spectrum", c + 1) * F.col("_w")) / total for c in range(n_channels)]
    met = moved.filter("_shared AND _w > 0").groupBy("mosaic_id", "y", "x").agg(F.array(*cells).alias("spectrum"))
    return alone.unionByName(met)


# --- correlation ---------------------------------------------------------------------------------

def _grey(spectrum: str, channels: list[int] | None) -> Column:
    s = A.take(spectrum, channels) if channels else F.col(spectrum)
    return A.total(A.nan_to_zero(s))


def correlation_offset(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Half the shape minus the position of the strongest cross-correlation, ``same`` window of ``a``."""
    a, b = a - a.mean(), b - b.mean()
    full = [m + n - 1 for m, n in zip(a.shape, b.shape)]
    c = np.fft.irfft2(np.fft.rfft2(a, full) * np.fft.rfft2(b[::-1, ::-1], full), full)
    start = [(f - m) // 2 for f, m in zip(full, a.shape)]
    same = c[start[0]: start[0] + a.shape[0], start[1]: start[1] + a.shape[1]]
    y, x = np.unravel_index(int(np.argmax(same)), same.shape)
    return a.shape[0] / 2 - y, a.shape[1] / 2 - x


def pair_offsets(strips: DataFrame, keys: list[str]) -> DataFrame:
    """Offset of every pair of strips (keys, side, y, x, g). A group is two overlap strips of two tiles."""
    types = ", ".join(f"`{k}` {strips.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ny, nx = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        grids = []
        for side in (0, 1):
            part = pdf[pdf["side"] == side]
            g = np.zeros((ny, nx))
            g[part["y"].to_numpy(), part["x"].to_numpy()] = part["g"].to_numpy()
            grids.append(g)
        oy, ox = correlation_offset(*grids)
        return pd.DataFrame([(*[pdf[k].iloc[0] for k in keys], oy, ox)], columns=[*keys, "oy", "ox"])

    return strips.groupBy(*keys).applyInPandas(run, f"{types}, oy DOUBLE, ox DOUBLE")


def vertical_strips(placed: DataFrame, ny: int, overlap: int, channels: list[int] | None = None) -> DataFrame:
    """Bottom rows of each tile and top rows of the tile below, as grey values under one pair key."""
    g = _grey("spectrum", channels).alias("g")
    keep = lambda cond, r, side, y: placed.filter(cond).select("mosaic_id", "cx", r.alias("ry"), F.lit(side).alias("side"), y.alias("y"), "x", g)
    top = keep((F.col("y") >= ny - overlap) & (F.col("ry") < F.col("n_rows") - 1), F.col("ry"), 0, F.col("y") - (ny - overlap))
    bottom = keep((F.col("y") < overlap) & (F.col("ry") > 0), F.col("ry") - 1, 1, F.col("y"))
    return top.unionByName(bottom)


def robust_offsets(offsets: DataFrame, keys: list[str], mode: str = "normal", sigma: float = 1.0) -> DataFrame:
    """``normal``, ``mean``, ``sigma`` or ``sigma mean``. A rejected offset counts as 0, also in the mean."""
    parts = set(mode.lower().split())
    out = offsets
    if "sigma" in parts:
        out = sigma_clip(out, keys, ["oy", "ox"], sigma)
        out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("oy", "ox")})
    if "mean" in parts:
        mean = materialize(out.groupBy(*keys).agg(F.avg("oy").alias("_y"), F.avg("ox").alias("_x")))
        out = join_dim(out, mean, keys).withColumn("oy", F.col("_y")).withColumn("ox", F.col("_x")).drop("_y", "_x")
    return out


def place_columns(ranks: DataFrame, offsets: DataFrame, ny: int, overlap: int) -> DataFrame:
    """Origin of every tile inside its column: running sums of step and truncated offset."""
    steps = ranks.join(offsets.select("mosaic_id", "cx", (F.col("ry") + 1).alias("ry"), "oy", "ox"), ["mosaic_id", "cx", "ry"], "left")
    up = Window.partitionBy("mosaic_id", "cx").orderBy("ry").rowsBetween(Window.unboundedPreceding, 0)
    dy = F.when(F.col("ry") > 0, F.lit(ny - overlap) - F.coalesce(F.col("oy"), F.lit(0.0)).cast("int")).otherwise(F.lit(0))
    dx = F.when(F.col("ry") > 0, -F.coalesce(F.col("ox"), F.lit(0.0)).cast("int")).otherwise(F.lit(0))
    return steps.select(
        *ranks.columns, F.sum(dy).over(up).cast("int").alias("oy0"), F.sum(dx).over(up).cast("int").alias("ox0"),
        F.coalesce(F.col("oy"), F.lit(0.0)).cast("int").alias("shift_y"))


def attach_columns(placed: DataFrame, origins: DataFrame, ny: int, nx: int, overlap: int, sigma: float = 1.0,
                   channels: list[int] | None = None, rounds: int = 2) -> DataFrame:
    """Displacement of every column against the one before it.

    Each pair of tiles side by side is one segment: their strips are compared over the rows they share at
    the present vertical displacement. Segment offsets are sigma-clipped (rejected ones are left out) and
    averaged; after at most ``rounds`` vertical re-alignments the horizontal mean is taken.
    """
    here = origins.select("mosaic_id", "cx", "ry", "oy0", "ox0")
    nxt = here.select("mosaic_id", (F.col("cx") - 1).alias("cx"), "ry", F.col("oy0").alias("oy1"), F.col("ox0").alias("ox1"))
    pairs = materialize(here.join(nxt, ["mosaic_id", "cx", "ry"]))
    shift = materialize(pairs.select("mosaic_id", "cx").distinct().withColumn("dy", F.lit(0)).withColumn("mx", F.lit(0.0)))
    edge = materialize(placed.filter((F.col("x") >= nx - overlap) | (F.col("x") < overlap)).select(
        "mosaic_id", "cx", "ry", "y", "x", _grey("spectrum", channels).alias("g")))
    for turn in range(rounds + 1):
        spans = pairs.join(shift, ["mosaic_id", "cx"]).withColumn("start", F.greatest("oy0", F.col("oy1") + F.col("dy"))).withColumn(
            "end", F.least("oy0", F.col("oy1") + F.col("dy")) + ny).filter("start < end")
        cols = ["mosaic_id", "cx", "ry", "start", "end", "dy", "oy0", "oy1"]
        left = join_dim(edge.filter(F.col("x") >= nx - overlap), spans.select(*cols), ["mosaic_id", "cx", "ry"])
        left = left.withColumn("row", F.col("y") + F.col("oy0")).withColumn("x", F.col("x") - (nx - overlap)).withColumn("side", F.lit(0))
        right = join_dim(edge.filter(F.col("x") < overlap).withColumn("cx", F.col("cx") - 1), spans.select(*cols), ["mosaic_id", "cx", "ry"])
        right = right.withColumn("row", F.col("y") + F.col("oy1") + F.col("dy")).withColumn("side", F.lit(1))
        strips = left.unionByName(right).filter("row >= start AND row < end").select(
            "mosaic_id", "cx", "ry", "side", (F.col("row") - F.col("start")).alias("y"), "x", "g")
        measured = pair_offsets(strips, ["mosaic_id", "cx", "ry"]).join(pairs, ["mosaic_id", "cx", "ry"])
        measured = materialize(measured.withColumn("ox", F.col("ox") + F.col("ox1") - F.col("ox0")).select("mosaic_id", "cx", "ry", "oy", "ox"))
        clipped = sigma_clip(measured, ["mosaic_id", "cx"], ["oy", "ox"], sigma)
        mean = clipped.groupBy("mosaic_id", "cx").agg(F.coalesce(F.avg("oy"), F.lit(0.0)).alias("my"), F.coalesce(F.avg("ox"), F.lit(0.0)).alias("nmx"))
        joined = shift.join(mean, ["mosaic_id", "cx"])
        move = F.col("my").cast("int") if turn < rounds else F.lit(0)
        shift = materialize(joined.select("mosaic_id", "cx", (F.col("dy") - move).alias("dy"), F.col("nmx").alias("mx")))
    return shift.select("mosaic_id", (F.col("cx") + 1).alias("cx"), "dy", (F.lit(nx - overlap) - F.col("mx").cast("int")).alias("dx"))


def tile_origins(origins: DataFrame, columns: DataFrame) -> DataFrame:
    """Global origin of every tile, the smallest at 0."""
    ids = origins.select("mosaic_id", "cx").distinct().join(columns, ["mosaic_id", "cx"], "left")
    along = Window.partitionBy("mosaic_id").orderBy("cx").rowsBetween(Window.unboundedPreceding, 0)
    sums = ids.select("mosaic_id", "cx", F.sum(F.coalesce("dy", F.lit(0))).over(along).alias("_cy"), F.sum(F.coalesce("dx", F.lit(0))).over(along).alias("_cx"))
    moved = origins.join(sums, ["mosaic_id", "cx"]).withColumn("top", F.col("oy0") + F.col("_cy")).withColumn("left", F.col("ox0") + F.col("_cx"))
    whole = Window.partitionBy("mosaic_id")
    return moved.withColumn("top", (F.col("top") - F.min("top").over(whole)).cast("int")).withColumn("left", (F.col("left") - F.min("left").over(whole)).cast("int")).drop("_cy", "_cx")


def _chain(ratios: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Running intensity factors along a row of tiles, each step clipped to [0.1, 10]."""
    rows = ratios.groupBy(*keys, "channel").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("ratio").alias("r")))).alias("_l"))
    clip = lambda v: F.least(F.greatest(v, F.lit(0.1)), F.lit(10.0))
    walk = F.aggregate(
        "_l", F.array().cast("array<struct<o:int,f:double>>"),
        lambda acc, s: F.concat(acc, F.array(F.struct(
            s["o"].alias("o"), clip(F.when(F.size(acc) > 0, F.element_at(acc, -1)["f"]).otherwise(F.lit(1.0)) * s["r"]).alias("f")))))
    return rows.select(*keys, "channel", F.explode(walk).alias("_f")).select(*keys, F.col("_f.o").alias(order), "channel", F.col("_f.f").alias("factor"))


def mosaic(tiles: DataFrame, ny: int, nx: int, overlap_y: int, overlap_x: int, n_channels: int, *, mode: str = "sigma",
           sigma: float = 1.0, channels: list[int] | None = None, x_direction: str = "right", y_direction: str = "down",
           profile: str = "cosine", match_intensity: bool = False, as_uint16: bool = False) -> DataFrame:
    """Correlated mosaic: tiles are placed down each column, columns against each other, overlaps blended.

    ``match_intensity`` brings each tile to the level of the tile above it, and each column to the column
    before it, from the means of their overlap. Positions no tile covers have no row.
    """
    ranks = materialize(tile_ranks(tiles, x_direction, y_direction))
    placed = join_dim(tiles, ranks, ["mosaic_id", "tx", "ty"])
    offsets = materialize(pair_offsets(vertical_strips(placed, ny, overlap_y, channels), ["mosaic_id", "cx", "ry"]))
    offsets = robust_offsets(offsets, ["mosaic_id"], mode, sigma)
    origins = materialize(place_columns(ranks, offsets, ny, overlap_y))
    columns = attach_columns(placed, origins, ny, nx, overlap_x, sigma, channels)
    where = materialize(tile_origins(origins, columns))
    side = lambda dc, dr, tag: where.select("mosaic_id", (F.col("cx") - dc).alias("cx"), (F.col("ry") - dr).alias("ry"),
                                            F.col("top").alias(f"top_{tag}"), F.col("left").alias(f"left_{tag}"), F.col("shift_y").alias(f"shift_{tag}"))
    full = where
    for tag, dc, dr in (("u", 0, -1), ("d", 0, 1), ("l", -1, 0), ("r", 1, 0)):
        full = full.join(side(dc, dr, tag), ["mosaic_id", "cx", "ry"], "left")
    full = materialize(full.select("mosaic_id", "tx", "ty", "top", "left", "cx", "ry", "shift_y", "top_u", "top_d", "left_l", "left_r", "shift_d"))
    data = join_dim(tiles, full, ["mosaic_id", "tx", "ty"]).withColumn("gy", F.col("top") + F.col("y")).withColumn("gx", F.col("left") + F.col("x"))
    if match_intensity:
        data = _matched(data, ny, nx, n_channels)
    ramp = linear_weight if profile == "linear" else cosine_weight

    def zone(pos, low, high, trim):
        """(position in the blend zone, its length) between two tiles that overlap in [low, high)."""
        t = F.greatest(trim, F.lit(0))
        return pos - (low + t), F.greatest(high - low - 2 * t, F.lit(0))

    iu, nu = zone(F.col("gy"), F.col("top"), F.col("top_u") + ny, F.col("shift_y"))
    idn, nd = zone(F.col("gy"), F.col("top_d"), F.col("top") + ny, F.col("shift_d"))
    il, nl = zone(F.col("gx"), F.col("left"), F.col("left_l") + nx, F.lit(0))
    ir, nr = zone(F.col("gx"), F.col("left_r"), F.col("left") + nx, F.lit(0))
    rise = lambda has, i, n: F.when(has.isNull() | (n <= 0) & (i >= 0), 1.0).when(i < 0, 0.0).when(i >= n, 1.0).otherwise(1.0 - ramp(i, n))
    fall = lambda has, i, n: F.when(has.isNull(), 1.0).when(i < 0, 1.0).when(i >= n, 0.0).otherwise(ramp(i, n))
    w = rise(F.col("top_u"), iu, nu) * fall(F.col("top_d"), idn, nd) * rise(F.col("left_l"), il, nl) * fall(F.col("left_r"), ir, nr)
    near = lambda c: F.coalesce(c, F.lit(False))
    # a pixel may also meet a diagonal tile, so the test allows for the largest jitter between columns
    slack = where.groupBy("mosaic_id").agg((F.max(F.abs("shift_y")) + F.max(F.abs("ox0")) + 1).alias("_slack"))
    data = join_dim(data, materialize(slack), ["mosaic_id"])
    shared = near(F.col("gy") < F.col("top_u") + ny + F.col("_slack")) | near(F.col("gy") >= F.col("top_d") - F.col("_slack"))
    shared = shared | near(F.col("gx") < F.col("left_l") + nx + F.col("_slack")) | near(F.col("gx") >= F.col("left_r") - F.col("_slack"))
    tiny = F.lit(1e-9)  # keeps a pixel that all its tiles would fade out
    moved = data.select("mosaic_id", F.col("gy").alias("y"), F.col("gx").alias("x"), "spectrum", F.greatest(w, tiny).alias("_w"), shared.alias("_shared"))
    out = _blend(moved, n_channels)
    if as_uint16:
        out = out.withColumn("spectrum", F.transform("spectrum", lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(65535.0)).cast("int")))
    return out


def _matched(data: DataFrame, ny: int, nx: int, n_channels: int) -> DataFrame:
    """Scale tiles by factors chained down the columns and then across them."""

    def ratios(rows, key_high, key_low, cond_high, cond_low, keys):
        long = lambda d, cond, shift, tag: d.filter(cond).select(
            "mosaic_id", *[(F.col(k) + s).alias(k) for k, s in shift.items()], F.posexplode("spectrum").alias("channel", "v")
        ).groupBy(*keys, "channel").agg(F.avg("v").alias(tag))
        e, i = long(rows, cond_high, key_high, "e"), long(rows, cond_low, key_low, "i")
        r = F.when(F.abs(F.col("i")) > A.EPS, F.col("e") / F.col("i"))
        return e.join(i, [*keys, "channel"]).select(*keys, "channel", F.coalesce(r, F.lit(1.0)).alias("ratio"))

    keys = ["mosaic_id", "cx", "ry"]
    up_down = ratios(data, {"cx": 0, "ry": 1}, {"cx": 0, "ry": 0},
                     F.col("top_d").isNotNull() & (F.col("gy") >= F.col("top_d")), F.col("top_u").isNotNull() & (F.col("gy") < F.col("top_u") + ny), keys)
    down = _chain(up_down, ["mosaic_id", "cx"], "ry")
    scaled = _scale_tiles(data, down, ["mosaic_id", "cx", "ry"], n_channels)
    left_right = ratios(scaled, {"cx": 1}, {"cx": 0}, F.col("left_r").isNotNull() & (F.col("gx") >= F.col("left_r")),
                        F.col("left_l").isNotNull() & (F.col("gx") < F.col("left_l") + nx), ["mosaic_id", "cx"])
    return _scale_tiles(scaled, _chain(left_right, ["mosaic_id"], "cx"), ["mosaic_id", "cx"], n_channels)


def _scale_tiles(data: DataFrame, factors: DataFrame, keys: list[str], n_channels: int) -> DataFrame:
    wide = factors.groupBy(*keys).agg(F.array(*[F.max(F.when(F.col("channel") == c, F.col("factor"))) for c in range(n_channels)]).alias("_f"))
    joined = join_dim(data, materialize(wide), keys, "left")
    scaled = F.zip_with("spectrum", "_f", lambda v, f: v * F.coalesce(f, F.lit(1.0)))
    return joined.withColumn("spectrum", F.when(F.col("_f").isNull(), F.col("spectrum")).otherwise(scaled)).drop("_f")


def trim_null_edges(image: DataFrame, key: str = "mosaic_id") -> DataFrame:
    """Cut ragged borders of a mosaic.

    Incomplete rows and incomplete columns at the borders are counted; the side that costs fewer pixels is
    cut, then every column that is still incomplete is dropped. Only row and column counts are compared.
    """
    box = materialize(image.groupBy(key).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")))
    rows = image.groupBy(key, "y").agg(F.count(F.lit(1)).alias("n")).join(box, key)
    cols = image.groupBy(key, "x").agg(F.count(F.lit(1)).alias("n")).join(box, key)
    good_rows = rows.filter(F.col("n") == F.col("x1") - F.col("x0") + 1).groupBy(key).agg(F.min("y").alias("gy0"), F.max("y").alias("gy1"))
    good_cols = cols.filter(F.col("n") == F.col("y1") - F.col("y0") + 1).groupBy(key).agg(F.min("x").alias("gx0"), F.max("x").alias("gx1"))
    plan = box.join(good_rows, key, "left").join(good_cols, key, "left")
    height, width = F.col("y1") - F.col("y0") + 1, F.col("x1") - F.col("x0") + 1
    cost_rows = F.coalesce((height - (F.col("gy1") - F.col("gy0") + 1)) * width, F.lit(2**62))
    cost_cols = F.coalesce((width - (F.col("gx1") - F.col("gx0") + 1)) * height, F.lit(2**62))
    by_rows = cost_rows <= cost_cols
    none = F.col("gy0").isNull() & F.col("gx0").isNull()
    frame = materialize(plan.select(
        key, F.when(none | ~by_rows, F.col("y0")).otherwise(F.col("gy0")).alias("ya"), F.when(none | ~by_rows, F.col("y1")).otherwise(F.col("gy1")).alias("yb"),
        F.when(none | by_rows, F.col("x0")).otherwise(F.col("gx0")).alias("xa"), F.when(none | by_rows, F.col("x1")).otherwise(F.col("gx1")).alias("xb")))
    cut = join_dim(image, frame, [key]).filter("y BETWEEN ya AND yb AND x BETWEEN xa AND xb")
    full = cut.groupBy(key, "x").agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("yb") - F.col("ya") + 1).alias("_h")).filter("_n = _h").select(key, "x")
    return join_dim(cut, materialize(full), [key, "x"], "left_semi").drop("ya", "yb", "xa", "xb")
