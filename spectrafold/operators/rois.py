"""Regions of interest: membership, mean spectra, boxes, pixel sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import arrays as A
from ..scale import join_dim, theta_join
from ..tables import FIELD, PIXEL
from .stats import mean_spectrum


def _trunc(v) -> Column:
    return F.col(v).cast("int") if isinstance(v, str) else v.cast("int")


def inside_roi(shape: Column, x: Column, y: Column) -> Column:
    """Membership test of a pixel in a rectangle, rotated rectangle, ellipse or circle.

    Rectangles keep whole pixels from the truncated start to the truncated end. Round shapes test the
    pixel centre. A rotated rectangle turns the pixel back around its corner (x0, y0).
    """
    x0, y0, w, h = F.col("x0"), F.col("y0"), F.col("w"), F.col("h")
    rect = (x >= _trunc(x0)) & (x < _trunc(x0 + w)) & (y >= _trunc(y0)) & (y < _trunc(y0 + h))
    cx, cy = x + 0.5 - (x0 + w / 2), y + 0.5 - (y0 + h / 2)
    ellipse = (cx / (w / 2)) * (cx / (w / 2)) + (cy / (h / 2)) * (cy / (h / 2)) <= 1.0
    a = F.radians(F.coalesce(F.col("angle"), F.lit(0.0)))
    dx, dy = x + 0.5 - x0, y + 0.5 - y0
    u, v = dx * F.cos(a) + dy * F.sin(a), dy * F.cos(a) - dx * F.sin(a)
    rotated = (u >= 0) & (u < w) & (v >= 0) & (v < h)
    turned = F.coalesce(F.col("angle"), F.lit(0.0)) != 0
    return (
        F.when(shape.isin("EllipseROI", "CircleROI"), ellipse)
        .when((shape == "RotatedRectROI") | ((shape == "RectROI") & turned), rotated)
        .otherwise(rect)
    )


def pixels_in_roi(pixels: DataFrame, rois: DataFrame) -> DataFrame:
    """Every pixel with every region that contains it; each pixel at most once per region.

    A line contains the pixels nearest to its unit-step samples. A region without a shape is a rectangle.
    """
    line = F.col("shape").eqNullSafe(F.lit("LineROI"))
    hits = theta_join(pixels, rois.filter(~line), ["image_id"], inside_roi(F.col("shape"), F.col("x"), F.col("y")))
    lines = rois.filter(line)
    if not lines.take(1):
        return hits
    nearest = lambda c: F.floor(F.col(c) + 0.5).cast("int")
    on_line = line_samples(lines).select("image_id", "roi_id", nearest("sy").alias("y"), nearest("sx").alias("x")).distinct()
    return hits.unionByName(join_dim(pixels, on_line.join(lines, ["image_id", "roi_id"]), ["image_id", "y", "x"]).select(hits.columns))


def roi_pixel_copies(meta: DataFrame, rois: DataFrame) -> DataFrame:
    """Pixel positions of rectangles clipped to the frame: overhanging positions repeat edge pixels.

    A region is written as its pixel list, so its size is the area the user drew.
    """
    grid = rois.join(meta.select("image_id", "ny", "nx"), "image_id").select(
        "image_id", "roi_id", "ny", "nx",
        F.explode(F.sequence(_trunc("x0"), _trunc(F.col("x0") + F.col("w")) - 1)).alias("_x"),
        F.sequence(_trunc("y0"), _trunc(F.col("y0") + F.col("h")) - 1).alias("_ys"),
    )
    full = grid.select("image_id", "roi_id", "ny", "nx", "_x", F.explode("_ys").alias("_y"))
    return full.select(
        "image_id", "roi_id",
        F.greatest(F.lit(0), F.least("_y", F.col("ny") - 1)).alias("y"),
        F.greatest(F.lit(0), F.least("_x", F.col("nx") - 1)).alias("x"),
    )


def line_samples(rois: DataFrame) -> DataFrame:
    """Unit-step sample points of line regions from (x0, y0) to (x0 + w, y0 + h)."""
    length = F.sqrt(F.col("w") * F.col("w") + F.col("h") * F.col("h"))
    lines = rois.filter(F.col("shape") == "LineROI").select(
        "image_id", "roi_id", "x0", "y0", "w", "h", F.greatest(F.ceil(length), F.lit(1)).cast("int").alias("_n")
    )
    steps = lines.select("*", F.explode(F.sequence(F.lit(0), F.col("_n"))).alias("step"))
    part = F.col("step") / F.col("_n")
    return steps.select(
        "image_id", "roi_id", "step",
        (F.col("x0") + part * F.col("w")).alias("sx"), (F.col("y0") + part * F.col("h")).alias("sy"),
    )


def _corner_weights(samples: DataFrame, keys: list[str]) -> DataFrame:
    """The pixels around each sample point with their bilinear weights."""
    corners = samples.select(
        "*",
        F.explode(F.array(*[
            F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1)
        ])).alias("_c"),
    )
    fy, fx = F.col("sy") - F.floor("sy"), F.col("sx") - F.floor("sx")
    wy = F.when(F.col("_c.dy") == 1, fy).otherwise(1 - fy)
    wx = F.when(F.col("_c.dx") == 1, fx).otherwise(1 - fx)
    return corners.select(
        *keys, (F.floor("sy") + F.col("_c.dy")).cast("int").alias("y"),
        (F.floor("sx") + F.col("_c.dx")).cast("int").alias("x"), (wy * wx).alias("_w"),
    ).filter("_w > 0")


def line_weights(lines: DataFrame) -> DataFrame:
    """How much each pixel counts in the mean over a line's samples."""
    near = _corner_weights(line_samples(lines), ["image_id", "roi_id"])
    return near.groupBy("image_id", "roi_id", "y", "x").agg(F.sum("_w").alias("_w"))


def bilinear_samples(field: DataFrame, samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Bilinear value of a field (image_id, slice_id, y, x, value) at sample points."""
    near = _corner_weights(samples, keys)
    joined = join_dim(field, near, ["image_id", "y", "x"])
    group = list(dict.fromkeys([*FIELD, *keys]))
    return joined.groupBy(*group).agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("value"))


def line_profile(field: DataFrame, rois: DataFrame, value: str = "value") -> DataFrame:
    return bilinear_samples(field, line_samples(rois), ["image_id", "roi_id", "step"], value)


def roi_mean_spectrum(pixels: DataFrame, rois: DataFrame, clip_negative: bool = True, smooth: bool = True) -> DataFrame:
    """Mean spectrum of every region: offset, clip at 0, scale, then smoothing, in this order.

    Background regions and images without a subtracted stack read the raw spectrum. Only per-region
    channel sums are shuffled, so a region may cover any share of an image. A line is the mean of its samples, each
    interpolated between the pixels around it.
    """
    line = F.col("shape").eqNullSafe(F.lit("LineROI"))
    lines, areas = rois.filter(line), rois.filter(~line)
    hits = pixels_in_roi(pixels, areas)
    source = F.col("spectrum")
    if "spectrum_sub" in pixels.columns:
        source = F.when(F.col("background"), F.col("spectrum")).otherwise(F.coalesce("spectrum_sub", "spectrum"))
    keys = [*FIELD, "roi_id"]
    means = mean_spectrum(hits.select(*keys, source.alias("spectrum")), keys)
    sums = means.select(*keys, F.posexplode("spectrum").alias("channel", "value"))
    if lines.take(1):
        near = line_weights(lines)
        flags = lines.select("image_id", "roi_id", "background")
        along = join_dim(pixels, near.join(flags, ["image_id", "roi_id"]), ["image_id", "y", "x"])
        long = along.select(*keys, "_w", F.posexplode(source).alias("channel", "value"))
        sums = sums.unionByName(long.groupBy(*keys, "channel").agg((F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).alias("value")))
    info = rois.select("image_id", "roi_id", "component", "background", "scale", "offset", "smooth_sigma")
    shifted = F.col("value") + F.coalesce("offset", F.lit(0.0))
    if clip_negative:
        shifted = F.greatest(shifted, F.lit(0.0))
    curve = sums.join(info, ["image_id", "roi_id"]).withColumn(
        "value", shifted * F.coalesce("scale", F.lit(1.0))
    )
    if not smooth:
        return curve
    return smooth_curves(curve, [*FIELD, "roi_id"], "smooth_sigma")


def smooth_curves(curves: DataFrame, keys: list[str], sigma: str, value: str = "value") -> DataFrame:
    """Gaussian smoothing of long curves with one sigma per row group, reflecting at both ends.

    Every point is spread over the channels its kernel reaches; sums are per curve and channel.
    """
    width = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(width)
    s = F.coalesce(F.col(sigma).cast("double"), F.lit(0.0))
    radius = F.when(s > 0, F.floor(4.0 * s + 0.5)).otherwise(F.lit(0)).cast("int")
    others = [c for c in curves.columns if c not in (*keys, "channel", value)]
    based = curves.withColumn("_n", n.cast("int")).withColumn("_r", radius).withColumn("_s", s)
    weight = lambda k: F.when(F.col("_s") > 0, F.exp(-0.5 * (k / F.col("_s")) * (k / F.col("_s")))).otherwise(F.lit(1.0))
    offsets = F.sequence(-F.col("_r"), F.col("_r"))
    norm = F.aggregate(F.transform(offsets, weight), F.lit(0.0), lambda acc, v: acc + v)
    taps = based.withColumn("_norm", norm).select("*", F.explode(offsets).alias("_k"))
    # target channel t reads source reflect(t + k); enumerate targets and pick the source by join
    reads = taps.select(
        *keys, F.col("channel"),
        A.reflect_index(F.col("channel") + F.col("_k"), F.col("_n")).cast("int").alias("_src"),
        (weight(F.col("_k")) / F.col("_norm")).alias("_w"), *others,
    )
    source = curves.select(*[F.col(k) for k in keys], F.col("channel").alias("_src"), F.col(value).alias("_v"))
    joined = reads.join(source, [*keys, "_src"])
    firsts = [F.first(c).alias(c) for c in others]
    return joined.groupBy(*keys, "channel").agg(F.sum(F.col("_w") * F.col("_v")).alias(value), *firsts)


def component_mean_spectra(curves: DataFrame, rois: DataFrame) -> DataFrame:
    """Unweighted mean of the region curves of each component; name and flag from its last region."""
    usable = rois.filter(F.coalesce("seed_h_enabled", F.lit(True)))
    last = usable.groupBy("image_id", "component").agg(
        F.max_by("background", "roi_id").alias("background"), F.max_by("name", "roi_id").alias("name")
    )
    named = curves.drop("component", "background", "name").join(
        usable.select("image_id", "roi_id", "component"), ["image_id", "roi_id"]
    )
    means = named.groupBy(*FIELD, "component", "channel").agg(F.avg("value").alias("value"))
    return means.join(last, ["image_id", "component"])


def roi_background(pixels: DataFrame, rois: DataFrame) -> DataFrame:
    """One background spectrum per slice: the mean over the regions that are to be subtracted."""
    curves = roi_mean_spectrum(
        pixels.drop("spectrum_sub") if "spectrum_sub" in pixels.columns else pixels,
        rois.filter("subtract"), smooth=True,
    )
    mean = curves.groupBy(*FIELD, "channel").agg(F.avg("value").alias("value"))
    cells = F.array_sort(F.collect_list(F.struct("channel", "value")))
    return mean.groupBy(*FIELD).agg(F.transform(cells, lambda s: s["value"]).alias("spectrum"))


def exclude_pixels(pixels: DataFrame, taken: DataFrame) -> DataFrame:
    """Pixels not in the taken set (image_id, y, x)."""
    return pixels.join(taken.select("image_id", "y", "x").distinct(), ["image_id", "y", "x"], "left_anti")


def union_pixels(*sets: DataFrame) -> DataFrame:
    out = sets[0].select("image_id", "y", "x")
    for s in sets[1:]:
        out = out.unionByName(s.select("image_id", "y", "x"))
    return out.distinct()


def bbox_iou(a: str = "a", b: str = "b") -> Column:
    """Intersection over union of two box structs (y, x, h, w)."""
    g = lambda s, f: F.col(f"{s}.{f}")
    ih = F.least(g(a, "y") + g(a, "h"), g(b, "y") + g(b, "h")) - F.greatest(g(a, "y"), g(b, "y"))
    iw = F.least(g(a, "x") + g(a, "w"), g(b, "x") + g(b, "w")) - F.greatest(g(a, "x"), g(b, "x"))
    inter = F.greatest(ih, F.lit(0)) * F.greatest(iw, F.lit(0))
    union = g(a, "h") * g(a, "w") + g(b, "h") * g(b, "w") - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def overlapping_boxes(boxes: DataFrame, threshold: float = 0.0, cell: int | None = None) -> DataFrame:
    """Pairs of boxes of one image with IoU above ``threshold``.

    Boxes meet through the grid cells they cover, so far boxes are never paired; a pair is reported
    in the cell that holds the top left corner of its intersection.
    """
    cell = cell or 64
    span = lambda p, s: F.sequence(F.floor(F.col(p) / cell).cast("int"), F.floor((F.col(p) + F.col(s) - 1) / cell).cast("int"))
    placed = (
        boxes.select("image_id", "box_id", F.struct("y", "x", "h", "w").alias("box"), F.explode(span("y", "h")).alias("_cy"),
                     span("x", "w").alias("_cxs"))
        .select("image_id", "box_id", "box", "_cy", F.explode("_cxs").alias("_cx"))
    )
    left = placed.select("image_id", "_cy", "_cx", F.col("box_id").alias("a_id"), F.col("box").alias("a"))
    right = placed.select("image_id", "_cy", "_cx", F.col("box_id").alias("b_id"), F.col("box").alias("b"))
    met = left.join(right, ["image_id", "_cy", "_cx"]).filter("a_id < b_id")
    home = (F.floor(F.greatest("a.y", "b.y") / cell) == F.col("_cy")) & (F.floor(F.greatest("a.x", "b.x") / cell) == F.col("_cx"))
    return met.filter(home).select("image_id", "a_id", "b_id", bbox_iou().alias("iou")).filter(F.col("iou") > threshold)


def rescale_rois(rois: DataFrame, old_bin: int, new_bin: int) -> DataFrame:
    f = old_bin / new_bin
    return rois.withColumns({c: F.col(c) * F.lit(f) for c in ("x0", "y0", "w", "h")})


def audit_seeds(rois: DataFrame, resonances: DataFrame, k: int) -> DataFrame:
    """Components 1..k without any region or resonance, and defined components beyond k (1-based)."""
    defined = (
        rois.select("image_id", "component").unionByName(resonances.select("image_id", "component")).distinct()
        .withColumn("component", F.col("component") + 1)
    )
    images = defined.select("image_id").distinct()
    wanted = images.withColumn("component", F.explode(F.sequence(F.lit(1), F.lit(k))))
    w, d = wanted.withColumn("_w", F.lit(True)), defined.withColumn("_d", F.lit(True))
    status = F.when(F.col("_d").isNull(), "missing").when(F.col("_w").isNull(), "beyond")
    return w.join(d, ["image_id", "component"], "full").select("image_id", "component", status.alias("status")).filter("status IS NOT NULL")


def next_free_component(rois: DataFrame, k: int) -> DataFrame:
    """First unused component index per image, k when all are taken."""
    used = rois.select("image_id", "component").distinct()
    slots = used.select("image_id").distinct().withColumn("component", F.explode(F.sequence(F.lit(0), F.lit(k))))
    return slots.join(used.filter(F.col("component") < k), ["image_id", "component"], "left_anti").groupBy("image_id").agg(
        F.min("component").alias("component")
    )
