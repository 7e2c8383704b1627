"""Spatial neighbourhood operators.

Two-dimensional kernels run on square tiles with a halo: every pixel goes to each tile whose halo
reaches it, a tile is filtered by itself, and only its core is kept. The size of a group is fixed by
tile and halo, so one large image becomes many tasks. A missing pixel counts as ``fill``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrays import gaussian_kernel
from ..scale import join_dim, materialize
from ..tables import FIELD, PIXEL


def field_shape(field: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or FIELD
    return field.groupBy(*keys).agg((F.max("y") + 1).alias("ny"), (F.max("x") + 1).alias("nx"))


def place_tiles(field: DataFrame, shape: DataFrame, halo: int, tile: int, keys: list[str], *columns: Column | str) -> DataFrame:
    """Every pixel once for each tile whose halo reaches it: (keys, y, x, the columns, ny, nx, _ty, _tx)."""
    reach = lambda p, n: F.sequence(
        F.greatest(F.floor((F.col(p) - halo) / tile), F.lit(0)).cast("int"),
        F.least(F.floor((F.col(p) + halo) / tile), F.floor((F.col(n) - 1) / tile)).cast("int"),
    )
    on = [k for k in keys if k in shape.columns]
    sized = join_dim(field.select(*keys, "y", "x", *columns), shape.select(*on, "ny", "nx"), on)
    return (
        sized.select("*", F.explode(reach("y", "ny")).alias("_ty"))
        .select("*", F.explode(reach("x", "nx")).alias("_tx"))
    )


def map_tiles(field: DataFrame, shape: DataFrame, halo: int, kernel: Callable, value: str = "value", tile: int = 128,
              keys: list[str] | None = None, fill: float = 0.0, pad: str = "symmetric", there: bool = False) -> DataFrame:
    """Apply ``kernel(padded) -> core`` to every tile of a long field (keys, y, x, value).

    A missing pixel counts as ``fill`` and gets a row, unless ``there`` asks for rows of the field's own pixels alone.

    ``padded`` is the tile with ``halo`` pixels on each side; outside the image it is padded by the
    NumPy mode ``pad`` (``constant`` pads with infinity, for minima).
    """
    keys = keys or FIELD
    tile = max(int(tile), 2 * int(halo), 16)
    placed = place_tiles(field, shape, halo, tile, keys, F.col(value).alias("value"))
    spans = "ny", "nx"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ny, nx = (int(pdf[s].iloc[0]) for s in spans)
        ty, tx = int(pdf["_ty"].iloc[0]), int(pdf["_tx"].iloc[0])
        y0, y1 = ty * tile, min((ty + 1) * tile, ny)
        x0, x1 = tx * tile, min((tx + 1) * tile, nx)
        ya, yb, xa, xb = max(y0 - halo, 0), min(y1 + halo, ny), max(x0 - halo, 0), min(x1 + halo, nx)
        patch = np.full((yb - ya, xb - xa), fill)
        at = pdf["y"].to_numpy() - ya, pdf["x"].to_numpy() - xa
        patch[at] = pdf["value"].to_numpy(dtype=float)
        widths = ((halo - (y0 - ya), halo - (yb - y1)), (halo - (x0 - xa), halo - (xb - x1)))
        if pad == "constant":
            padded = np.pad(patch, widths, mode="constant", constant_values=np.inf)
        else:
            padded = np.pad(patch, widths, mode=pad)
        core = kernel(padded)
        yy, xx = np.mgrid[y0:y1, x0:x1]
        out = {k: pdf[k].iloc[0] for k in keys}
        frame = pd.DataFrame({"y": yy.ravel().astype("int32"), "x": xx.ravel().astype("int32"), "value": core.ravel()})
        if there:
            known = np.zeros(patch.shape, dtype=bool)
            known[at] = True
            frame = frame[known[y0 - ya: y1 - ya, x0 - xa: x1 - xa].ravel()]
        return frame.assign(**out)[[*keys, "y", "x", "value"]]

    fields = ", ".join(f"`{k}` {field.schema[k].dataType.simpleString()}" for k in keys)
    return placed.groupBy(*keys, "_ty", "_tx").applyInPandas(run, f"{fields}, y INT, x INT, value DOUBLE")


def blur_kernel(sigma_y: float, sigma_x: float | None = None, subtract: bool = False) -> tuple[int, Callable]:
    """Halo and tile kernel of a separable Gaussian blur."""
    sigma_x = sigma_y if sigma_x is None else sigma_x
    ky = np.asarray(gaussian_kernel(sigma_y)) if sigma_y > 0 else np.ones(1)
    kx = np.asarray(gaussian_kernel(sigma_x)) if sigma_x > 0 else np.ones(1)
    ry, rx = len(ky) // 2, len(kx) // 2
    halo = max(ry, rx)

    def kernel(p):
        ny, nx = p.shape[0] - 2 * halo, p.shape[1] - 2 * halo
        rows = sum(w * p[halo - ry + i: halo - ry + i + ny, :] for i, w in enumerate(ky))
        blurred = sum(w * rows[:, halo - rx + i: halo - rx + i + nx] for i, w in enumerate(kx))
        return p[halo: halo + ny, halo: halo + nx] - blurred if subtract else blurred

    return halo, kernel


def gaussian_blur_2d(field: DataFrame, shape: DataFrame, sigma_y: float, sigma_x: float | None = None, edge: str = "reflect",
                     value: str = "value", tile: int = 128, keys: list[str] | None = None, fill: float = 0.0,
                     subtract: bool = False, there: bool = False) -> DataFrame:
    """Separable Gaussian blur; ``edge`` is ``reflect`` (half-sample symmetric) or ``nearest``.

    ``subtract`` gives the field minus its blur, which saves joining the two; ``there`` gives no rows to missing pixels.
    """
    halo, kernel = blur_kernel(sigma_y, sigma_x, subtract)
    mode = {"reflect": "symmetric", "nearest": "edge"}[edge]
    return map_tiles(field, shape, halo, kernel, value, tile, keys, fill, mode, there)


def rolling_ball_background(field: DataFrame, shape: DataFrame, radius: int, value: str = "value", tile: int = 128,
                            keys: list[str] | None = None) -> DataFrame:
    """Height of a ball of ``radius`` rolled under the field: min over the ball of v + r - sqrt(r^2 - d^2).

    A missing pixel does not hold the ball back and has no height itself.
    """
    r = int(radius)
    offsets = [(dy, dx, r - float(np.sqrt(r * r - dy * dy - dx * dx)))
               for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r]

    def kernel(p):
        ny, nx = p.shape[0] - 2 * r, p.shape[1] - 2 * r
        out = np.full((ny, nx), np.inf)
        for dy, dx, lift in offsets:
            np.minimum(out, p[r + dy: r + dy + ny, r + dx: r + dx + nx] + lift, out=out)
        return out

    return map_tiles(field, shape, r, kernel, value, tile, keys, np.inf, "constant", there=True)


def stride_downsample(field: DataFrame, n: int) -> DataFrame:
    """Every n-th row and column."""
    keep = (F.col("y") % n == 0) & (F.col("x") % n == 0)
    return field.filter(keep).withColumn("y", (F.col("y") / n).cast("int")).withColumn("x", (F.col("x") / n).cast("int"))


def upsample_nearest(coarse: DataFrame, shape: DataFrame, factor: int, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """Repeat every cell factor x factor times and crop to the shape; no shuffle of the fine grid."""
    keys = keys or FIELD
    step = F.sequence(F.lit(0), F.lit(factor - 1))
    rows = coarse.select(*keys, "y", "x", F.col(value).alias("value"), F.explode(step).alias("_dy"))
    cells = rows.select(*keys, "y", "x", "value", "_dy", F.explode(step).alias("_dx"))
    fine = cells.select(*keys, (F.col("y") * factor + F.col("_dy")).alias("y"), (F.col("x") * factor + F.col("_dx")).alias("x"), "value")
    return join_dim(fine, shape.select(*[k for k in keys if k in shape.columns], "ny", "nx"),
                    [k for k in keys if k in shape.columns]).filter("y < ny AND x < nx").drop("ny", "nx")


def upsample_bilinear(coarse: DataFrame, shape: DataFrame, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """Linear zoom with aligned end points: every cell adds its share to the pixels next to it.

    ``shape`` holds the fine (ny, nx) and the coarse (sy, sx) extent per field.
    """
    keys = keys or FIELD
    on = [k for k in keys if k in shape.columns]
    sized = join_dim(coarse.select(*keys, "y", "x", F.col(value).alias("value")), shape.select(*on, "ny", "nx", "sy", "sx"), on)

    def reach(p, fine, small):
        ratio = (F.col(fine) - 1) / (F.col(small) - 1)
        low = F.greatest(F.floor((F.col(p) - 1) * ratio) + 1, F.lit(0))
        high = F.least(F.ceil((F.col(p) + 1) * ratio) - 1, F.col(fine) - 1)
        low = F.when(F.col(small) > 1, low).otherwise(F.lit(0)).cast("int")
        high = F.when(F.col(small) > 1, high).otherwise(F.col(fine) - 1).cast("int")
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    def weight(target, p, fine, small):
        at = F.col(target) * (F.col(small) - 1) / F.greatest(F.col(fine) - 1, F.lit(1))
        return F.when(F.col(small) > 1, F.greatest(1 - F.abs(at - F.col(p)), F.lit(0.0))).otherwise(F.lit(1.0))

    spread = (
        sized.select("*", F.explode(reach("y", "ny", "sy")).alias("_Y"))
        .select("*", F.explode(reach("x", "nx", "sx")).alias("_X"))
        .withColumn("_w", weight("_Y", "y", "ny", "sy") * weight("_X", "x", "nx", "sx"))
    )
    return spread.groupBy(*keys, F.col("_Y").alias("y"), F.col("_X").alias("x")).agg(
        F.sum(F.col("_w") * F.col("value")).alias("value")
    )


def local_maxima(field: DataFrame, shape: DataFrame, window: int, value: str = "value", keys: list[str] | None = None,
                 tile: int = 128) -> DataFrame:
    """Pixels that equal the maximum of their odd window (at least 3); edges and gaps see what exists."""
    size = max(3, int(window) | 1)
    r = size // 2

    def kernel(p):
        ny, nx = p.shape[0] - 2 * r, p.shape[1] - 2 * r
        rows = np.max([p[:, i: i + nx] for i in range(size)], axis=0)
        top = np.max([rows[i: i + ny] for i in range(size)], axis=0)
        core = p[r: r + ny, r: r + nx]
        return np.where((core == top) & np.isfinite(core), core, np.nan)

    peaks = map_tiles(field, shape, r, kernel, value, tile, keys, -np.inf, "edge")
    return peaks.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def consecutive_runs(df: DataFrame, keys: list[str], index: str, partitions: int | None = None) -> DataFrame:
    """Runs of consecutive integers per key: first, last and length. Null indices belong to no run.

    Indices are cut into ranges of key and value, so one key may fill many tasks. Runs are found inside each range; only
    the first and last one of a key in a range can go on beyond it, and these few are joined across ranges.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = df.select(*keys, index).filter(F.col(index).isNotNull()).distinct()
    placed = materialize(distinct.repartitionByRange(parts, *keys, index).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_part")
    tagged = placed.withColumn("_g", F.col(index) - F.row_number().over(inside.orderBy(index)))
    runs = tagged.groupBy(*keys, "_part", "_g").agg(F.min(index).alias("first"), F.max(index).alias("last"))
    outer = (F.col("first") == F.min("first").over(inside)) | (F.col("last") == F.max("last").over(inside))
    marked = runs.withColumn("_outer", outer).select(*keys, "first", "last", "_outer")
    along = Window.partitionBy(*keys).orderBy("first")
    new = F.coalesce((F.lag("last").over(along) + 1 < F.col("first")).cast("int"), F.lit(0))
    border = marked.filter("_outer").withColumn("_new", new).withColumn("_run", F.sum("_new").over(along))
    joined = border.groupBy(*keys, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")
    both = marked.filter("NOT _outer").drop("_outer").unionByName(joined)
    return both.withColumn("length", (F.col("last") - F.col("first") + 1).cast("bigint"))


def find_slices(spectrum: Column | str, threshold: float) -> Column:
    """Range around the maximum where the value stays at or above threshold x maximum.

    Each end is the first channel that falls below, or the end of the spectrum.
    """
    s = F.col(spectrum) if isinstance(spectrum, str) else spectrum
    n = F.size(s)
    # the last channel takes no part in the search for the maximum
    head = F.slice(s, 1, F.greatest(n - 1, F.lit(1)))
    peak = F.array_position(head, F.array_max(head)).cast("int") - 1
    limit = F.array_max(head) * F.lit(float(threshold))
    idx = F.sequence(F.lit(0), n - 1)
    below = lambda i: F.element_at(s, i + 1) < limit
    left = F.array_max(F.filter(idx, lambda i: (i <= peak) & below(i)))
    right = F.array_min(F.filter(idx, lambda i: (i >= peak) & below(i)))
    return F.struct(
        F.coalesce(left, F.lit(0)).alias("low"), F.coalesce(right, n - 1).alias("high"), peak.alias("peak")
    )
