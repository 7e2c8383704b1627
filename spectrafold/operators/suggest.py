"""Automatic region suggestion: response maps, candidate boxes, grouping by spectrum.

Response maps, their percentiles, blurs and connected regions are distributed over tiles. Boxes depend on those
before them, so they are accepted in rounds over all images together.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import arrays as A
from ..scale import clustered, dealt, exact_percentile, join_dim, join_stats, join_wide, materialize, theta_join, top_n
from ..tables import FIELD, PIXEL
from . import stats as S
from ._dense import matrix
from .condition import sub_band
from .neighborhood import blur_kernel, field_shape, gaussian_blur_2d, place_tiles
from .rois import bbox_iou, pixels_in_roi


@dataclass
class Settings:
    """Settings of the suggestion. The defaults are fixed values."""

    projection_mode: str = "average"
    background_sigma: float = 8.0
    bin_factor: int = 1
    smoothing_sigma: float = 1.0
    threshold_ratio: float = 0.65
    peak_region_ratio: float = 0.72
    peak_window: int = 5
    min_area: int = 3
    min_diagonal: int = 0
    max_groups: int = 3
    max_rois_per_group: int = 1
    pool_factor: int = 6
    padding: int = 4
    merge_similar: bool = True
    similarity: float = 0.82
    use_gradient: bool = True
    hierarchical: bool = True
    spectral_sigma: float = 1.0
    max_components: int = 9

    @property
    def wanted(self) -> int:
        return max(1, self.max_groups) * max(1, self.max_rois_per_group) * max(2, self.pool_factor)

    def levels(self) -> list[tuple[float, float]]:
        """(share of the maximum, percentile floor) of the eight thresholds; a fixed rule."""
        high = min(max(self.threshold_ratio, 0.05), 0.99)
        low = max(0.05, high * 0.12)
        return list(zip(np.linspace(high, low, 8).tolist(), np.linspace(75.0, 15.0, 8).tolist()))


# --- fingerprints --------------------------------------------------------------------------------

def _array_percentile(v: Column, p: float) -> Column:
    pos = F.lit(float(p)) * (F.size(v) - 1)
    at = lambda s, i: F.element_at(s, (i + 1).cast("int"))
    return A.let(F.sort_array(v), lambda s: at(s, F.floor(pos)) + (pos - F.floor(pos)) * (at(s, F.ceil(pos)) - at(s, F.floor(pos))))


def fingerprint(s: Column, sigma: float = 1.0, use_gradient: bool = True) -> Column:
    """Unit vector of the shape of a spectrum, optionally with its gradient; NULL when flat."""
    smooth = A.smooth(A.nan_to_zero(s), sigma)
    base = lambda v: A.let(_array_percentile(v, 0.1), lambda b: F.transform(v, lambda e: F.greatest(e - b, F.lit(0.0))))
    shape = A.let(smooth, base)
    if not use_gradient:
        return A.unit_norm(shape)
    part = lambda v: F.coalesce(A.unit_norm(v), v)
    both = lambda v: F.when(F.size(v) >= 3, A.unit_norm(F.concat(part(v), part(A.gradient(v))))).otherwise(A.unit_norm(v))
    return A.let(shape, both)


# --- response maps -------------------------------------------------------------------------------

def response_map(field: DataFrame, shape: DataFrame, background_sigma: float = 8.0, keys: list[str] | None = None) -> DataFrame:
    """Local contrast in 0..1: minus a broad blur, negatives to 0, divided by the 99.5th percentile of
    the positive values."""
    keys = keys or FIELD
    clean = field.select(*keys, "y", "x", A.finite_or_zero(F.col("value")).alias("value"))
    if background_sigma > 0:
        clean = gaussian_blur_2d(clean, shape, background_sigma, keys=keys, subtract=True)
    up = materialize(clean.withColumn("value", F.greatest("value", F.lit(0.0))))
    return join_stats(up, _scales(up, keys), keys, "left").withColumn("value", _share("value", "_s")).drop("_s")


def _scales(up: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _s): the 99.5th percentile of the positive values, or the largest one where that is not positive."""
    positive = up.filter("value > 0")
    top = positive.groupBy(*keys).agg(F.max("value").alias("_max"))
    scale = exact_percentile(positive, keys, "value", [0.995], ["_p"]).join(top, keys)
    return scale.select(*keys, F.when(F.col("_p") > 0, F.col("_p")).otherwise(F.col("_max")).alias("_s"))


def _share(value: Column | str, scale: str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.least(value / F.col(scale), F.lit(1.0)), F.lit(0.0))


# Fixed sizes of what a task holds: channels of a tile that are blurred together, and pixels of a strip.
FRAMES, STRIP = 16, 2048


def _strips(rows: DataFrame, shape: DataFrame, sigma: float, keys: list[str], tile: int = 128) -> DataFrame:
    """Every frame minus its broad blur, negatives to 0, in strips of tiles: (keys, channel, y0, x0, w, values).

    ``rows`` are (keys, y, x, _part, start, values): a pixel's values from channel ``start`` on, ``_part`` a group of channels.
    A strip holds whole rows of w pixels. A blur fills missing pixels, without one they are null.
    """
    halo, kernel = blur_kernel(sigma, subtract=True) if sigma > 0 else (0, None)
    tile = max(tile, 2 * halo)
    fill = 0.0 if kernel else np.nan
    spot = [*keys, "_part", "_ty", "_tx"]
    placed = place_tiles(rows, shape, halo, tile, keys, "_part", "start", "values")

    def run(table: pa.Table) -> pa.Table:
        ny, nx, ty, tx = (table[c][0].as_py() for c in ("ny", "nx", "_ty", "_tx"))
        y0, x0 = ty * tile, tx * tile
        y1, x1 = min(y0 + tile, ny), min(x0 + tile, nx)
        ya, yb, xa, xb = max(y0 - halo, 0), min(y1 + halo, ny), max(x0 - halo, 0), min(x1 + halo, nx)
        lists = pa.concat_arrays(table["values"].chunks)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
        row = np.repeat(np.arange(len(lengths)), lengths)
        channel = table["start"].to_numpy()[row] + np.arange(len(row)) - (np.cumsum(lengths) - lengths)[row]
        channels, frame = np.unique(channel, return_inverse=True)
        patches = np.full((len(channels), yb - ya, xb - xa), fill)
        patches[frame, table["y"].to_numpy()[row] - ya, table["x"].to_numpy()[row] - xa] = np.where(np.isfinite(flat), flat, 0.0)
        widths = ((halo - (y0 - ya), halo - (yb - y1)), (halo - (x0 - xa), halo - (xb - x1)))
        cores = [np.maximum(kernel(np.pad(p, widths, mode="symmetric")) if kernel else p, 0.0) for p in patches]
        h, w = y1 - y0, x1 - x0
        step = max(1, STRIP // w)
        parts = [(c, y0 + i, core[i: i + step].ravel()) for c, core in zip(channels.tolist(), cores) for i in range(0, h, step)]
        offsets = np.cumsum([0] + [len(p[2]) for p in parts])
        values = pa.array(np.concatenate([p[2] for p in parts]) if parts else np.zeros(0), from_pandas=True)
        n = len(parts)
        return pa.table({
            **{k: pa.repeat(table[k][0], n) for k in keys}, "channel": pa.array([p[0] for p in parts], pa.int32()),
            "y0": pa.array([p[1] for p in parts], pa.int32()), "x0": pa.array([x0] * n, pa.int32()), "w": pa.array([w] * n, pa.int32()),
            "values": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)})

    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return dealt(placed, spot).groupBy(*spot).applyInArrow(run, f"{types}, channel INT, y0 INT, x0 INT, w INT, values ARRAY<DOUBLE>")


def balanced_projection(frames: DataFrame, shape: DataFrame, background_sigma: float = 8.0, keys: list[str] | None = None) -> DataFrame:
    """Response map of every frame, averaged with the spatial variance of each frame as weight; the
    mean of the three largest responses where no frame varies.

    ``frames`` are voxels, or pixels with a ``spectrum``. They travel as strips of tiles, so no pixel is shuffled once its
    tile is blurred but as part of a strip.
    """
    keys = keys or FIELD
    if "spectrum" in frames.columns:
        cuts = F.expr(f"sequence(0, CAST((size(spectrum) - 1) div {FRAMES} AS INT))")
        parts = frames.filter(F.size("spectrum") > 0).select(*keys, "y", "x", "spectrum", F.explode(cuts).alias("_part"))
        rows = parts.select(*keys, "y", "x", "_part", (F.col("_part") * FRAMES).alias("start"),
                            F.expr(f"CAST(slice(spectrum, _part * {FRAMES} + 1, {FRAMES}) AS ARRAY<DOUBLE>)").alias("values"))
    else:
        rows = frames.select(*keys, "y", "x", F.expr(f"CAST(channel div {FRAMES} AS INT)").alias("_part"), F.col("channel").cast("int").alias("start"),
                             F.array(F.col("value").cast("double")).alias("values"))
    strips = materialize(_strips(rows, shape, background_sigma, keys))
    frame = [*keys, "channel"]
    scaled = join_stats(strips, _scales(strips.select(*frame, F.explode("values").alias("value")), frame), frame, "left")
    each = scaled.select(*frame, "_s", F.explode("values").alias("value")).filter("value IS NOT NULL")
    var = each.groupBy(*frame).agg(F.var_pop(_share("value", "_s")).alias("_v"))
    shares = F.transform("values", lambda v: F.when(v.isNotNull(), _share(v, "_s")))
    both = join_stats(scaled.select(*frame, "y0", "x0", "w", shares.alias("values")), var, frame)
    spot = [*keys, "y0", "x0"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("channel")
        y0, x0, w = (table[c][0].as_py() for c in ("y0", "x0", "w"))
        values = matrix(table["values"])
        weight = table["_v"].to_numpy()[:, None]
        known = ~np.isnan(values)
        total = (known * weight).sum(axis=0)
        high = -np.sort(-np.where(known, values, -np.inf), axis=0)[:3]
        count = np.maximum(np.isfinite(high).sum(axis=0), 1)
        top = np.where(np.isfinite(high), high, 0.0).sum(axis=0) / count
        value = np.divide((np.where(known, values, 0.0) * weight).sum(axis=0), total, out=top, where=total > 0)
        at = np.flatnonzero(known.any(axis=0))
        return pa.table({**{k: pa.repeat(table[k][0], len(at)) for k in keys}, "y": pa.array(y0 + at // w, pa.int32()),
                         "x": pa.array(x0 + at % w, pa.int32()), "value": pa.array(value[at])})

    types = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)
    return dealt(both, spot).groupBy(*spot).applyInArrow(run, f"{types}, y INT, x INT, value DOUBLE")


def spatial_response(pixels: DataFrame, shape: DataFrame, settings: Settings, frame: int = 0) -> DataFrame:
    mode = settings.projection_mode
    if mode == "balanced":
        return balanced_projection(pixels, shape, settings.background_sigma)
    if mode == "frame":
        field = pixels.select(*PIXEL, F.element_at("spectrum", frame + 1).alias("value"))
    else:
        field = S.project_spectral(pixels, {"average": "avg", "max": "max"}[mode])
    return response_map(field, shape, settings.background_sigma)


# --- connected regions ---------------------------------------------------------------------------

def _label(mask: np.ndarray) -> np.ndarray:
    """4-connected regions numbered 1.. in raster order of their first pixel, by runs and union-find."""
    ny, nx = mask.shape
    runs, parent, before = [], [], []

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for y in range(ny):
        edge = np.diff(np.concatenate(([0], mask[y].astype(np.int8), [0])))
        now, j = [], 0
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            i = len(runs)
            runs.append((y, a, b))
            parent.append(i)
            now.append(i)
            while j < len(before) and runs[before[j]][2] <= a:
                j += 1
            q = j
            while q < len(before) and runs[before[q]][1] < b:
                r, s = root(before[q]), root(i)
                parent[max(r, s)] = min(r, s)
                q += 1
        before = now
    out = np.zeros(mask.shape, dtype=np.int32)
    number: dict[int, int] = {}
    for i, (y, a, b) in enumerate(runs):
        out[y, a:b] = number.setdefault(root(i), len(number) + 1)
    return out


_ROW = 1 << 31


def connected_regions(mask: DataFrame, keys: list[str] | None = None, tile: int = 256) -> DataFrame:
    """4-connected regions of a pixel set of any size: columns (keys, y, x, region).

    Tiles are labelled by themselves, touching labels of neighbouring tiles form a small graph, and its
    components are found by passing minima and shortening paths. A region is named by its first pixel in
    raster order (``y * 2^31 + x``), so names sort like the pixels.
    """
    keys = keys or FIELD
    types = {k: mask.schema[k].dataType.simpleString() for k in keys}
    cols = ", ".join(f"`{k}` {t}" for k, t in types.items())

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        grid = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), dtype=bool)
        grid[y - y.min(), x - x.min()] = True
        number = _label(grid)[y - y.min(), x - x.min()]
        code = y.astype(np.int64) * _ROW + x
        first = np.full(number.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, number, code)
        return pdf.assign(_r=first[number])[[*keys, "y", "x", "_r"]]

    tiles = mask.select(*keys, "y", "x").withColumn("_ty", F.expr(f"y div {tile}")).withColumn("_tx", F.expr(f"x div {tile}"))
    labelled = materialize(dealt(tiles, [*keys, "_ty", "_tx"]).groupBy(*keys, "_ty", "_tx").applyInPandas(local, f"{cols}, y INT, x INT, _r BIGINT"))
    names = _names(_touching(labelled, keys, tile), keys)
    if names is None:  # no region crosses a tile
        return labelled.select(*keys, "y", "x", F.col("_r").alias("region"))
    return join_wide(labelled, names, [*keys, "_r"], "left").select(*keys, "y", "x", F.coalesce("name", "_r").alias("region"))


def _touching(labelled: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Pairs (keys, a, b) of labels ``_r`` that meet across a border of tiles."""
    here = labelled.select(*keys, "y", "x", F.col("_r").alias("a"))
    there = lambda dy, dx: labelled.select(*keys, (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col("_r").alias("b"))
    border = lambda df, p: df.filter(F.col(p) % tile == tile - 1)
    down = join_wide(border(here, "y"), border(there(1, 0), "y"), [*keys, "y", "x"])
    right = join_wide(border(here, "x"), border(there(0, 1), "x"), [*keys, "y", "x"])
    return down.unionByName(right).select(*keys, "a", "b").filter("a <> b").distinct()


def _names(edges: DataFrame, keys: list[str]) -> DataFrame | None:
    """(keys, _r, name): for each label of a pair the smallest label that pairs lead to; None without pairs."""
    both = materialize(edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))))
    if not both.take(1):
        return None
    names = materialize(both.select(*keys, F.col("a").alias("node")).distinct().withColumn("name", F.col("node")))
    while True:
        near = both.join(names.select(*keys, F.col("node").alias("b"), "name"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("name").alias("_n"))
        lower = names.join(near, [*keys, "node"]).select(*keys, "node", F.least("name", "_n").alias("_m"), "name")
        jump = names.select(*keys, F.col("node").alias("_m"), F.col("name").alias("_j"))
        new = materialize(lower.join(jump, [*keys, "_m"], "left").select(
            *keys, "node", F.least("_m", F.coalesce("_j", "_m")).alias("new"), "name"))
        changed = new.filter("new <> name").take(1)
        names = new.select(*keys, "node", F.col("new").alias("name"))
        if not changed:
            return names.select(*keys, F.col("node").alias("_r"), "name")


# --- candidates ----------------------------------------------------------------------------------

# Overlap from which a box counts as found already, and the percentiles under the eight thresholds.
FOUND_ALREADY = 0.45


def overlap_with(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Intersection over union of one box (y, x, h, w) with each row of others."""
    low = np.maximum(box[:2], others[:, :2])
    high = np.minimum(box[:2] + box[2:], others[:, :2] + others[:, 2:])
    both = np.prod(np.clip(high - low, 0, None), axis=1)
    whole = np.prod(box[2:]) + np.prod(others[:, 2:], axis=1) - both
    return np.divide(both, whole, out=np.zeros(len(others)), where=whole > 0)


def scale_boxes(boxes: DataFrame, factor: int, padding: int) -> DataFrame:
    """``scale_box`` on a table of binned boxes (y, x, h, w) with the image shape (ny, nx)."""
    low = lambda p: F.greatest(F.lit(0), F.col(p) * factor - padding)
    high = lambda p, s, n: F.least(F.col(n), (F.col(p) + F.col(s)) * factor + padding)
    h = F.greatest(F.lit(1), high("y", "h", "ny") - low("y"))
    w = F.greatest(F.lit(1), high("x", "w", "nx") - low("x"))
    return boxes.withColumns({"_h": h, "_w": w, "_y": low("y"), "_x": low("x")}).drop("y", "x", "h", "w").withColumnsRenamed(
        {"_y": "y", "_x": "x", "_h": "h", "_w": "w"})


def _binned(response: DataFrame, shape: DataFrame, settings: Settings, keys: list[str]) -> DataFrame:
    """The response on the coarse grid, smoothed: (keys, y, x, value), nothing below zero."""
    on = [k for k in keys if k in shape.columns]
    f = max(1, settings.bin_factor)
    data = join_dim(response, shape.select(*on, "ny", "nx"), on)
    if f > 1:
        data = data.filter((F.col("y") < F.floor(F.col("ny") / f) * f) & (F.col("x") < F.floor(F.col("nx") / f) * f))
        data = data.groupBy(*keys, (F.expr(f"CAST(y div {f} AS INT)")).alias("y"), F.expr(f"CAST(x div {f} AS INT)").alias("x")).agg(F.avg("value").alias("value"))
    coarse = data.select(*keys, "y", "x", "value")
    if settings.smoothing_sigma > 0:
        coarse = gaussian_blur_2d(coarse, field_shape(coarse, keys), settings.smoothing_sigma, keys=keys)
    return materialize(coarse.withColumn("value", F.greatest(A.finite_or_zero(F.col("value")), F.lit(0.0))))


def _thresholds(coarse: DataFrame, settings: Settings, keys: list[str]) -> DataFrame:
    """(keys, level, threshold): a share of the largest response, but not under a percentile of the positive ones."""
    positive = coarse.filter("value > 0")
    levels = settings.levels()
    names = [f"p{i}" for i in range(len(levels))]
    floors = exact_percentile(positive, keys, "value", [p / 100 for _, p in levels], names)
    top = positive.groupBy(*keys).agg(F.max("value").alias("top"))
    each = F.array(*[F.greatest(F.col("top") * share, F.col(n)) for (share, _), n in zip(levels, names)])
    return floors.join(top, keys).select(*keys, F.posexplode(each).alias("level", "threshold"))


def component_tree(grid: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """How the cells of a grid join as a threshold falls: the parent of every cell, and what its subtree holds.

    Cells are taken by falling value, then in raster order, and each becomes the parent of the parts it touches. So the
    4-connected cells at or above a threshold around a cell are the subtree of its last ancestor that reaches the threshold.
    Cells that are not finite are roots of their own. A subtree has a size, its first cell in raster order, its best
    cell (largest value, first of equals) and its extent.
    """
    ny, nx = grid.shape
    wide = nx + 1  # one empty column and one empty row keep neighbours from wrapping around
    flat = np.full((ny + 1, wide), -np.inf)
    flat[:ny, :nx] = np.where(np.isfinite(grid), grid, -np.inf)
    flat = flat.ravel()
    cells = np.arange(len(flat))
    order = np.argsort(-flat, kind="stable")
    parent, part = cells.tolist(), [-1] * len(flat)
    size, first, best = [1] * len(flat), cells.tolist(), [0] * len(flat)
    top, left = (cells // wide).tolist(), (cells % wide).tolist()
    low, right = top.copy(), left.copy()
    for i, p in enumerate(order[:int(np.isfinite(flat).sum())].tolist()):
        part[p], best[p] = p, i
        for q in (p - wide, p - 1, p + 1, p + wide):
            r = part[q] if q >= 0 else -1
            if r < 0:
                continue
            while part[r] != r:
                part[r] = part[part[r]]
                r = part[r]
            part[q] = r
            if r == p:
                continue
            parent[r] = part[r] = p
            size[p] += size[r]
            first[p], best[p] = min(first[p], first[r]), min(best[p], best[r])
            top[p], low[p] = min(top[p], top[r]), max(low[p], low[r])
            left[p], right[p] = min(left[p], left[r]), max(right[p], right[r])
    crop = lambda v: np.asarray(v).reshape(ny + 1, wide)[:ny, :nx].ravel()
    at = lambda v: crop(v) // wide * nx + crop(v) % wide
    sides = {"y0": top, "y1": low, "x0": left, "x1": right, "size": size}
    return at(parent), {"first": at(first), "best": at(order[best]), **{k: crop(v) for k, v in sides.items()}}


def _climb(above: list[np.ndarray], value: np.ndarray, cells: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The last ancestor of each cell with a value at its cut or above; ``above[i]`` are the ancestors 2^i steps up."""
    for step in reversed(above):
        up = step[cells]
        cells = np.where(value[up] >= cut, up, cells)
    return cells


def _tile_peaks(settings: Settings, keys: list[str], types: dict[str, str], tile: int, reach: int):
    """The cells of a tile that are tried at each level, with the boxes around them, and what the tile cannot settle.

    A row is a cell with its region, the region's size and number of peaks, its cut and its box. A region that
    reaches into the next tile is not ``whole``: it has a row for its best cell, too (``kind`` 1), and rows of the cells at
    the border (``kind`` 2). A box that reaches the border is ``loose``. Of equal boxes the first is enough: a later one is
    turned down with it, or because of it.
    """
    fields = {**types, "kind": "INT", "level": "INT", "region": "BIGINT", "whole": "BOOLEAN", "n": "BIGINT", "peaks": "BIGINT", "y": "INT", "x": "INT",
              "value": "DOUBLE", "cut": "DOUBLE", "box_y": "INT", "box_x": "INT", "box_h": "INT", "box_w": "INT", "loose": "BOOLEAN"}
    names = list(fields)

    def run(pdf: pd.DataFrame, cuts: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({n: [] for n in names})
        if pdf.empty or cuts.empty:
            return empty
        ty, tx, ny, nx = (int(pdf[c].iloc[0]) for c in ("_ty", "_tx", "ny", "nx"))
        ya, xa = ty * tile, tx * tile
        h, w = min(tile, ny - ya), min(tile, nx - xa)
        padded = np.full((h + 2 * reach, w + 2 * reach), -np.inf)
        padded[pdf["y"].to_numpy() - ya + reach, pdf["x"].to_numpy() - xa + reach] = pdf["value"].to_numpy(dtype=float)
        along = np.max([padded[:, i: i + w] for i in range(2 * reach + 1)], axis=0)
        top = np.max([along[i: i + h] for i in range(2 * reach + 1)], axis=0)
        core = padded[reach: reach + h, reach: reach + w]
        value = core.ravel()
        peak = ((core == top) & (core > 0)).ravel()
        parent, tree = component_tree(core)
        above = [parent]
        for _ in range(max(1, h * w).bit_length()):
            above.append(above[-1][above[-1]])
        border = np.zeros((h, w), dtype=bool)  # cells beside another tile
        border[0, :] |= ya > 0
        border[-1, :] |= ya + h < ny
        border[:, 0] |= xa > 0
        border[:, -1] |= xa + w < nx
        border = np.flatnonzero(border.ravel())
        code = lambda c: (c // w + ya).astype(np.int64) * _ROW + c % w + xa

        def crosses(node):
            return ((tree["y0"][node] == 0) & (ya > 0)) | ((tree["y1"][node] == h - 1) & (ya + h < ny)) | (
                (tree["x0"][node] == 0) & (xa > 0)) | ((tree["x1"][node] == w - 1) & (xa + w < nx))

        rows = []
        for level, cut in zip(cuts["level"].tolist(), cuts["threshold"].tolist()):
            inside = value >= cut
            home = lambda cells: _climb(above, value, cells, np.full(len(cells), cut))
            nodes = np.flatnonzero(inside & ((parent == np.arange(len(value))) | (value[parent] < cut)))
            tops, edge = np.flatnonzero(inside & peak), border[inside[border]]
            of = home(tops)
            count = np.bincount(of, minlength=len(value))
            nodes = nodes[crosses(nodes) | (count[nodes] == 0)]
            for kind, cells, node in ((0, tops, of), (1, tree["best"][nodes], nodes), (2, edge, home(edge))):
                rows.append((cells, node, count[node], *(np.full(len(cells), v) for v in (kind, level, cut))))
        cells, node, peaks, kind, level, cut = (np.concatenate(c) for c in zip(*rows))
        whole = ~crosses(node)
        use = np.flatnonzero(~whole | (tree["size"][node] >= max(1, settings.min_area)))
        region = code(tree["first"][node])
        use = use[np.lexsort((cells[use], -value[cells[use]], region[use], level[use]))]
        cells, node, peaks, kind, level, cut, whole, region = (c[use] for c in (cells, node, peaks, kind, level, cut, whole, region))
        cut = np.maximum(cut, value[cells] * settings.peak_region_ratio)
        box = _climb(above, value, cells, cut)
        found = pd.DataFrame({
            "kind": kind, "level": level, "region": region, "whole": whole, "n": tree["size"][node], "peaks": peaks,
            "y": cells // w + ya, "x": cells % w + xa, "value": value[cells], "cut": cut, "box_y": tree["y0"][box] + ya, "box_x": tree["x0"][box] + xa,
            "box_h": tree["y1"][box] - tree["y0"][box] + 1, "box_w": tree["x1"][box] - tree["x0"][box] + 1, "loose": crosses(box)})
        again = found[found["whole"] & ~found["loose"]].duplicated(["box_y", "box_x", "box_h", "box_w"])
        found = found.drop(index=again.index[again])
        return found.assign(**{k: pdf[k].iloc[0] for k in keys})[names] if len(found) else empty

    return run, ", ".join(f"`{n}` {t}" for n, t in fields.items())


def _ranked_peaks(coarse: DataFrame, thresholds: DataFrame, settings: Settings, keys: list[str], tile: int) -> DataFrame:
    """The peaks of every region that is large enough, or its largest cell if none is a peak, with their place in
    the order of trial: by level, region, falling value and position. ``box`` is unknown (null) where it leaves the tile.

    A tile is settled by its component tree; only regions over tile borders are put together from their parts.
    """
    reach = max(3, int(settings.peak_window) | 1) // 2
    tile = max(tile, 2 * reach)
    shape, spot = materialize(field_shape(coarse, keys)), [*keys, "_ty", "_tx"]
    placed = place_tiles(coarse, shape, reach, tile, keys, "value")
    upto = lambda n: F.sequence(F.lit(0), F.expr(f"CAST(({n} - 1) div {tile} AS INT)"))
    tiles = shape.select(*keys, "nx", F.explode(upto("ny")).alias("_ty")).select(*spot[:-1], F.explode(upto("nx")).alias("_tx"))
    levels = join_wide(tiles, thresholds, keys)
    types = {k: coarse.schema[k].dataType.simpleString() for k in keys}
    run, fields = _tile_peaks(settings, keys, types, tile, reach)
    found = materialize(dealt(placed, spot).groupBy(*spot).cogroup(dealt(levels, spot).groupBy(*spot)).applyInPandas(run, fields))
    region = [*keys, "level", "region"]
    tried = found.filter("whole AND kind < 2")
    split = found.filter("NOT whole")
    if split.take(1):
        on = [*keys, "level"]
        names = _names(_touching(split.filter("kind = 2").select(*on, "y", "x", F.col("region").alias("_r")), on, tile), on)
        if names is not None:
            split = join_wide(split.withColumnRenamed("region", "_r"), names, [*on, "_r"], "left").withColumn("region", F.coalesce("name", "_r")).drop("_r", "name")
        best = F.struct("value", (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))
        sizes = split.filter("kind = 1").groupBy(*region).agg(F.sum("n").alias("_n"), F.sum("peaks").alias("_peaks"), F.max(best).alias("_best"))
        parts = join_wide(split.filter("kind < 2"), sizes.filter(F.col("_n") >= max(1, settings.min_area)), region)
        lone = (F.col("kind") == 1) & (F.col("_peaks") == 0) & (best == F.col("_best"))
        tried = tried.unionByName(parts.filter((F.col("kind") == 0) | lone).select(*found.columns))
    box = F.struct(*[F.col(f"box_{c}").alias(c) for c in "yxhw"])
    return materialize(tried.select(*region, "y", "x", "value", "cut", F.when(~F.col("loose"), box).alias("box"),
                                    F.struct("level", "region", (-F.col("value")).alias("low"), "y", "x").alias("place")))


def _level_cells(coarse: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """The cells at or above the threshold of each level, with their region: (keys, level, region, y, x, value)."""
    above = theta_join(coarse, thresholds, keys, F.col("value") >= F.col("threshold"))
    above = materialize(above.select(*keys, "level", "y", "x", "value"))
    on = [*keys, "level"]
    return materialize(join_wide(connected_regions(above.select(*on, "y", "x"), on), above, [*on, "y", "x"]))


def _boxes_around(cells: DataFrame, peaks: DataFrame, keys: list[str]) -> DataFrame:
    """For each peak the box (y, x, h, w) of the cells connected to it in its region at its cut or above."""
    region = [*keys, "level", "region"]
    near = peaks.select(*region, "rank", "cut", F.col("y").alias("_py"), F.col("x").alias("_px"))
    around = theta_join(cells.select(*region, "y", "x", "value"), near, region, F.col("value") >= F.col("cut"))
    around = materialize(around.select(*keys, "rank", "y", "x"))
    on = [*keys, "rank"]
    start = near.select(*on, F.col("_py").alias("y"), F.col("_px").alias("x"), F.lit(True).alias("_start"))
    parts = join_wide(connected_regions(around, on), start, [*on, "y", "x"], "left")
    sides = parts.groupBy(*on, "region").agg(
        F.min("y").alias("y"), F.min("x").alias("x"), (F.max("y") - F.min("y") + 1).alias("h"), (F.max("x") - F.min("x") + 1).alias("w"),
        F.bool_or("_start").alias("_start"))
    return sides.filter("_start").select(*on, "y", "x", "h", "w")


def _accept(settings: Settings, keys: list[str], batch: int):
    """Go through the boxes of one image in their order, from those taken in earlier rounds on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "rank"], kind="stable")
        boxes = pdf[["y", "x", "h", "w"]].to_numpy(dtype=float)
        old = pdf["taken"].to_numpy(dtype=bool)
        large = settings.min_diagonal <= 0 or np.hypot(pdf["full_h"], pdf["full_w"]).to_numpy() >= settings.min_diagonal
        allowed = np.broadcast_to(large, len(pdf))
        kept = np.flatnonzero(old).tolist()
        for i in np.flatnonzero(~old & allowed):
            if len(kept) == settings.wanted:
                break
            if not kept or overlap_with(boxes[i], boxes[kept]).max() < FOUND_ALREADY:
                kept.append(int(i))
        out = pdf.iloc[kept].assign(taken=True)
        return out.assign(open=len(kept) < settings.wanted and int((~old).sum()) == batch)

    return run


def extract_candidates(response: DataFrame, shape: DataFrame, settings: Settings, keys: list[str] | None = None, tile: int = 128) -> DataFrame:
    """Candidate boxes of every response map: (keys, candidate, y, x, h, w, score).

    The peaks of all levels and the boxes around them come from the component trees of tiles. A box depends on those
    accepted before it, so peaks are tried in rounds: each round takes the next few peaks of every image that still
    wants boxes, labels the surroundings of those whose box leaves its tile together, and accepts boxes in their
    order. What one task holds are the boxes of a round and those already accepted, numbers that the settings fix.
    """
    keys = keys or FIELD
    on = [k for k in keys if k in shape.columns]
    f, batch = max(1, settings.bin_factor), 4 * settings.wanted
    coarse = _binned(response, shape, settings, keys)
    thresholds = materialize(_thresholds(coarse, settings, keys))
    peaks = _ranked_peaks(coarse, thresholds, settings, keys, tile)
    cells = None
    rest, turn, state = peaks, 0, None
    while True:
        now = materialize(top_n(rest, keys, [F.col("place")], batch, batch))
        if not now.take(1):
            break
        boxes = now.filter("box IS NOT NULL").select(*keys, "rank", "box.*")
        loose = now.filter("box IS NULL")
        if loose.take(1):
            if cells is None:
                cells = _level_cells(coarse, thresholds, keys)
            boxes = boxes.unionByName(_boxes_around(cells, loose, keys))
        boxes = boxes.join(shape.select(*on, "ny", "nx"), on)
        full = scale_boxes(boxes, f, settings.padding).select(*keys, "rank", *[F.col(c).alias(f"full_{c}") for c in "yxhw"])
        new = boxes.select(*keys, "rank", "y", "x", "h", "w").join(full, [*keys, "rank"]).join(
            now.select(*keys, "rank", F.col("value").alias("score"), "place"), [*keys, "rank"])
        new = new.select(*keys, F.lit(turn).alias("turn"), "rank", "y", "x", "h", "w", *[f"full_{c}" for c in "yxhw"], "score",
                         F.lit(False).alias("taken"), F.lit(True).alias("open"))
        both = new if state is None else state.unionByName(new)
        state = materialize(dealt(both, keys).groupBy(*keys).applyInPandas(_accept(settings, keys, batch), new.schema))
        wanting = state.filter("open").select(*keys).distinct()
        if not wanting.take(1):
            break
        last = now.groupBy(*keys).agg(F.max("place").alias("_last")).join(wanting, keys)
        rest = materialize(join_dim(rest, last, keys).filter(F.col("place") > F.col("_last")).drop("_last"))
        turn += 1
    if state is None:
        fields = [f"`{k}` {response.schema[k].dataType.simpleString()}" for k in keys]
        return response.sparkSession.createDataFrame([], ", ".join(fields) + ", candidate INT, y INT, x INT, h INT, w INT, score DOUBLE")
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "turn", "rank")
    return state.select(*keys, (F.row_number().over(order) - 1).alias("candidate"), *[F.col(f"full_{c}").cast("int").alias(c) for c in "yxhw"], "score")


def greedy_nms(boxes: DataFrame, keys: list[str], threshold: float = 0.45, order: list[str] | None = None, cell: int = 64) -> DataFrame:
    """Keep boxes in order unless they overlap a kept one.

    Overlapping pairs come from a join on grid cells. In each round the boxes without an undecided better
    one beside them stay, and what they overlap goes; rounds end when all are decided.
    """
    by = [-F.col(c) if c == "score" else F.col(c) for c in (order or ["score"])]
    placed = materialize(boxes.withColumn("_id", F.monotonically_increasing_id()))
    span = lambda p, s: F.sequence(F.floor(F.col(p) / cell).cast("int"), F.floor((F.col(p) + F.col(s) - 1) / cell).cast("int"))
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(by)], "_id")
    spread = placed.select(*keys, "_id", place.alias("_o"), F.struct("y", "x", "h", "w").alias("_b"), F.explode(span("y", "h")).alias("_cy"), span("x", "w").alias("_cxs"))
    spread = spread.select(*keys, "_id", "_o", "_b", "_cy", F.explode("_cxs").alias("_cx"))
    left = spread.select(*keys, "_cy", "_cx", F.col("_id").alias("first"), F.col("_o").alias("_oa"), F.col("_b").alias("a"))
    right = spread.select(*keys, "_cy", "_cx", F.col("_id").alias("second"), F.col("_o").alias("_ob"), F.col("_b").alias("b"))
    pairs = left.join(right, [*keys, "_cy", "_cx"]).filter((F.col("_oa") < F.col("_ob")) & (bbox_iou() >= threshold))
    pairs = materialize(pairs.select("first", "second").distinct())
    undecided, kept = placed.select("_id"), None
    while True:
        live = pairs.join(undecided, pairs["first"] == undecided["_id"], "left_semi")
        stay = materialize(undecided.join(live, undecided["_id"] == live["second"], "left_anti"))
        kept = stay if kept is None else kept.unionByName(stay)
        gone = pairs.join(stay, pairs["first"] == stay["_id"], "left_semi").select(F.col("second").alias("_id")).unionByName(stay)
        undecided = materialize(undecided.join(gone, "_id", "left_anti"))
        if not undecided.take(1):
            return placed.join(kept, "_id", "left_semi").drop("_id")


def multiband_candidates(pixels: DataFrame, shape: DataFrame, settings: Settings, n_bands: int | None = None,
                         occupied: DataFrame | None = None) -> DataFrame:
    """Candidates of equal spectral bands found separately, overlapping boxes merged in band order."""
    bands = n_bands or max(2, settings.max_groups)
    width = pixels.agg(F.max(F.size("spectrum"))).first()[0]
    long = pixels.select(*PIXEL, F.posexplode("spectrum").alias("channel", "value"))
    banded = long.withColumn("band", sub_band(F.col("channel"), width, bands))
    keys = [*FIELD, "band"]
    response = balanced_projection(banded, shape, settings.background_sigma, keys)
    response = _mask(response, occupied)
    found = extract_candidates(response, shape, replace(settings, max_groups=2), keys)
    f = max(1, settings.bin_factor)
    grown = found.withColumns({
        "_y": F.floor(F.col("y") / f), "_x": F.floor(F.col("x") / f),
        "_h": F.floor((F.col("y") + F.col("h")) / f) - F.floor(F.col("y") / f),
        "_w": F.floor((F.col("x") + F.col("w")) / f) - F.floor(F.col("x") / f)})
    coarse = grown.select(*keys, "candidate", F.struct("y", "x", "h", "w").alias("_full"), "score",
                          *[F.col(f"_{c}").cast("int").alias(c) for c in "yxhw"])
    kept = greedy_nms(coarse, FIELD, 0.45, ["band", "candidate"])
    flat = kept.select(*FIELD, "band", "candidate", "_full.y", "_full.x", "_full.h", "_full.w", "score")
    order = Window.partitionBy(*FIELD).orderBy(F.desc("score"), "band", "candidate")
    return flat.withColumn("candidate", F.row_number().over(order) - 1).drop("band")


def _mask(response: DataFrame, occupied: DataFrame | None) -> DataFrame:
    if occupied is None:
        return response
    taken = occupied.select("image_id", "y", "x").distinct().withColumn("_o", F.lit(True))
    return response.join(taken, ["image_id", "y", "x"], "left").withColumn(
        "value", F.when(F.col("_o"), F.lit(0.0)).otherwise(F.col("value"))).drop("_o")


# --- grouping ------------------------------------------------------------------------------------

def candidate_spectra(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Mean raw spectrum of every candidate box."""
    renamed = boxes.select(*FIELD, "candidate", F.col("y").alias("_y0"), F.col("x").alias("_x0"), "h", "w")
    inside = (
        (F.col("y") >= F.col("_y0")) & (F.col("y") < F.col("_y0") + F.col("h"))
        & (F.col("x") >= F.col("_x0")) & (F.col("x") < F.col("_x0") + F.col("w"))
    )
    hits = theta_join(pixels.select(*PIXEL, "spectrum"), renamed, FIELD, inside)
    return S.mean_spectrum(hits, [*FIELD, "candidate"])


def ward_labels(vectors: np.ndarray, k: int) -> np.ndarray:
    """Ward clusters of unit vectors under cosine distance, cut at k clusters."""
    n = len(vectors)
    d = np.clip(1.0 - np.clip(vectors @ vectors.T, -1.0, 1.0), 0.0, 2.0)
    np.fill_diagonal(d, np.inf)
    size = np.ones(n)
    member = np.arange(n)
    alive = list(range(n))
    while len(alive) > k:
        sub = d[np.ix_(alive, alive)]
        i, j = divmod(int(sub.argmin()), len(alive))
        a, b = sorted((alive[i], alive[j]))
        base = d[a, b]
        for c in alive:
            if c in (a, b):
                continue
            total = size[a] + size[b] + size[c]
            new = ((size[a] + size[c]) * d[a, c] ** 2 + (size[b] + size[c]) * d[b, c] ** 2 - size[c] * base**2) / total
            d[a, c] = d[c, a] = np.sqrt(max(new, 0.0))
        size[a] += size[b]
        member[member == b] = a
        alive.remove(b)
    return member


def greedy_labels(vectors: list, k: int, cap: int, threshold: float) -> np.ndarray:
    """Groups of at most ``cap`` members for vectors in their order; -1 for those left out.

    A group is the sum of its members. A vector belongs to the group of the most similar direction if that similarity
    reaches ``threshold``, and is left out if the group is full; otherwise it founds a group while there are fewer than
    k. One without a vector can only found a group, which nothing joins.
    """
    label = np.full(len(vectors), -1)
    width = next((len(v) for v in vectors if v is not None), 0)
    sums, members, used = np.zeros((k, width)), np.zeros(k, dtype=int), 0
    joinable = np.zeros(k, dtype=bool)
    for i, v in enumerate(vectors):
        home = used if used < k else -1
        if v is not None and joinable.any():
            length = np.linalg.norm(sums, axis=1)
            likeness = np.where(joinable, sums @ v / np.where(length > 0, length, 1.0), -np.inf)
            if likeness.max() >= threshold:
                home = int(likeness.argmax())
        if home < 0 or members[home] >= cap:
            continue
        label[i] = home
        members[home] += 1
        used = max(used, home + 1)
        if v is not None:
            sums[home] += v
            joinable[home] = True
    return label


def group_candidates(boxes: DataFrame, spectra: DataFrame, settings: Settings, slots: DataFrame | None = None) -> DataFrame:
    """Group the candidates of each image by spectrum and give the groups free component slots.

    ``slots`` holds the free components per image in ascending order (``free ARRAY<INT>``).
    """
    prints = spectra.select(*FIELD, "candidate", fingerprint(F.col("spectrum"), settings.spectral_sigma, settings.use_gradient).alias("print"))
    rows = boxes.join(prints, [*FIELD, "candidate"], "left")
    if slots is None:
        rows = rows.withColumn("free", F.array(*[F.lit(i) for i in range(settings.max_components)]))
    else:
        rows = join_dim(rows, slots, ["image_id"], "left").withColumn(
            "free", F.coalesce("free", F.array(*[F.lit(i) for i in range(settings.max_components)])))
    st = settings

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "candidate"], ascending=[False, True], kind="stable").reset_index(drop=True)
        free = [int(v) for v in pdf["free"].iloc[0]]
        k = min(max(1, st.max_groups), len(free))
        cap = max(1, st.max_rois_per_group)
        label = np.full(len(pdf), -1)
        vectors = [None if v is None else np.asarray(v, dtype=float) for v in pdf["print"]]
        valid = [i for i, v in enumerate(vectors) if v is not None]
        if k == 0:
            pass
        elif not st.merge_similar or (st.hierarchical and not valid):
            label[:k] = np.arange(min(k, len(pdf)))
        elif st.hierarchical:
            label[valid] = ward_labels(np.vstack([vectors[i] for i in valid]), min(k, len(valid)))
            names, first, counts = np.unique(label[valid], return_index=True, return_counts=True)
            largest = max(zip(counts, -first, names))[2]
            label[[i for i in range(len(pdf)) if vectors[i] is None]] = largest
        else:
            label = greedy_labels(vectors, k, cap, min(max(st.similarity, 0.0), 1.0))
        rows = []
        seen: dict = {}
        for i in range(len(pdf)):
            if label[i] < 0:
                continue
            g = seen.setdefault(label[i], [len(seen), 0])
            g[1] += 1
            if g[1] > cap or g[0] >= len(free):
                continue
            r = pdf.iloc[i]
            rows.append((r["image_id"], r["slice_id"], free[g[0]], g[1], int(r["y"]), int(r["x"]), int(r["h"]), int(r["w"]), float(r["score"])))
        return pd.DataFrame(rows, columns=["image_id", "slice_id", "component", "member", "y", "x", "h", "w", "score"])

    return dealt(rows, FIELD).groupBy(*FIELD).applyInPandas(
        run, "image_id STRING, slice_id INT, component INT, member INT, y INT, x INT, h INT, w INT, score DOUBLE")


def free_slots(rois: DataFrame, n: int) -> DataFrame:
    """Unused component indices per image."""
    used = rois.groupBy("image_id").agg(F.collect_set("component").alias("_u"))
    every = F.sequence(F.lit(0), F.lit(n - 1))
    return used.select("image_id", F.array_except(every, "_u").alias("free"))


def suggest_rois(pixels: DataFrame, settings: Settings | None = None, rois: DataFrame | None = None, frame: int = 0) -> DataFrame:
    """Suggested regions of every field: (component, member, box, score) on free component slots.

    Pixels of existing regions are left out; regions suggested earlier should be removed from ``rois``.
    """
    st = settings or Settings()
    pixels = materialize(clustered(pixels.select(*PIXEL, "spectrum"), FIELD, ["y", "x"]))
    shape = materialize(field_shape(pixels))
    occupied = pixels_in_roi(pixels.select(*PIXEL), rois) if rois is not None else None
    if st.projection_mode == "multiband":
        boxes = multiband_candidates(pixels, shape, st, occupied=occupied)
    else:
        response = _mask(spatial_response(pixels, shape, st, frame), occupied)
        boxes = extract_candidates(response, shape, st)
    boxes = materialize(boxes)
    slots = free_slots(rois, st.max_components) if rois is not None else None
    return group_candidates(boxes, candidate_spectra(pixels, boxes), st, slots)
