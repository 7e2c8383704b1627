"""Table schemas and the two physical layouts (wide ``pixels``, long ``voxels``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

FIELD = ["image_id", "slice_id"]
PIXEL = ["image_id", "slice_id", "y", "x"]

PIXELS = (
    "image_id STRING, slice_id INT, y INT, x INT, "
    "spectrum ARRAY<DOUBLE>, spectrum_sub ARRAY<DOUBLE>"
)
VOXELS = "image_id STRING, slice_id INT, y INT, x INT, channel INT, value DOUBLE"
IMAGE_META = (
    "image_id STRING, ny INT, nx INT, n_channels INT, slice_kind STRING, "
    "pixel_size DOUBLE, unit STRING"
)
AXIS = "image_id STRING, channel INT, value DOUBLE, label STRING, unit STRING"
ROIS = (
    "image_id STRING, roi_id INT, shape STRING, x0 DOUBLE, y0 DOUBLE, w DOUBLE, h DOUBLE, "
    "angle DOUBLE, component INT, background BOOLEAN, subtract BOOLEAN, scale DOUBLE, "
    "offset DOUBLE, smooth_sigma DOUBLE, seed_h_enabled BOOLEAN, name STRING"
)
SEED_SPECTRA = (
    "image_id STRING, component INT, name STRING, spectrum ARRAY<DOUBLE>, "
    "background BOOLEAN, source STRING, scale_factor DOUBLE"
)
SEED_MAPS = "image_id STRING, component INT, y INT, x INT, w DOUBLE"
RESONANCES = (
    "image_id STRING, component INT, center DOUBLE, width DOUBLE, threshold DOUBLE, "
    "n_pixels INT, use_subtracted BOOLEAN, use_gaussian BOOLEAN, amplitude DOUBLE"
)
FIT_REPORT = (
    "image_id STRING, slice_id INT, algorithm STRING, n_iter INT, max_iter INT, tol DOUBLE, "
    "n_pixels BIGINT, active_pixels BIGINT, final_error DOUBLE, data_norm DOUBLE, "
    "relative_error DOUBLE, history ARRAY<DOUBLE>, source STRING"
)


class ShapeError(ValueError):
    """A spectrum, map or seed does not have the length its axis asks for."""


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def canonicalize_cube(
    voxels: DataFrame,
    *,
    spectral_axis: str,
    y_axis: str,
    x_axis: str,
    slice_axis: str | None = None,
    value: str = "value",
    slice_kind: str = "z",
) -> DataFrame:
    """Give the index columns of a 3D or 4D voxel table their canonical roles.

    Axis roles are column roles, so the transpose of a dense stack is a projection here.
    A 3D table has no slice axis and becomes slice 0.
    """
    roles = [spectral_axis, y_axis, x_axis] + ([slice_axis] if slice_axis else [])
    if len(set(roles)) != len(roles):
        raise ShapeError(f"axis roles must be distinct, got {roles}")
    if slice_kind not in ("z", "time"):
        raise ValueError("slice_kind is 'z' or 'time'")
    image = F.col("image_id") if "image_id" in voxels.columns else F.lit("image")
    return voxels.select(
        image.alias("image_id"),
        (F.col(slice_axis) if slice_axis else F.lit(0)).cast("int").alias("slice_id"),
        F.col(y_axis).cast("int").alias("y"),
        F.col(x_axis).cast("int").alias("x"),
        F.col(spectral_axis).cast("int").alias("channel"),
        F.col(value).cast("double").alias("value"),
        F.lit(slice_kind if slice_axis else None).cast("string").alias("slice_kind"),
    )


def to_voxels(pixels: DataFrame, column: str = "spectrum", keep: list[str] | None = None) -> DataFrame:
    """Wide to long: one row per pixel and channel, no shuffle."""
    keep = keep or []
    return pixels.select(*PIXEL, *keep, F.posexplode(column).alias("channel", "value"))


def to_pixels(voxels: DataFrame, n_channels: int | None = None) -> DataFrame:
    """Long to wide in one shuffle on the pixel key.

    With ``n_channels`` the spectrum is built from conditional sums, which combine on the
    map side, and a missing voxel counts as 0; without it every pixel must be complete.
    """
    if n_channels is not None:
        cells = [
            F.sum(F.when(F.col("channel") == c, F.col("value")).otherwise(0.0))
            for c in range(n_channels)
        ]
        return voxels.groupBy(*PIXEL).agg(F.array(*cells).alias("spectrum"))
    pairs = F.array_sort(F.collect_list(F.struct("channel", "value")))
    return voxels.groupBy(*PIXEL).agg(F.transform(pairs, lambda s: s["value"]).alias("spectrum"))


def image_shape(pixels: DataFrame) -> DataFrame:
    """One row per image: extent, channel count and pixel count."""
    return pixels.groupBy("image_id").agg(
        (F.max("y") + 1).alias("ny"),
        (F.max("x") + 1).alias("nx"),
        F.max(F.size("spectrum")).alias("n_channels"),
        F.count(F.lit(1)).alias("n_pixels"),
    )


def row_major_index(nx: Column | int) -> Column:
    """Position of a pixel in the row-major flattening, computed, never assumed."""
    nx = nx if isinstance(nx, Column) else F.lit(nx)
    return F.col("y").cast("bigint") * nx + F.col("x")


def validate_shapes(pixels: DataFrame, meta: DataFrame) -> DataFrame:
    """Rows whose spectrum length differs from the channel count of their image."""
    from .scale import join_dim

    wide = join_dim(pixels, meta.select("image_id", "n_channels"), ["image_id"], "left")
    bad = F.col("n_channels").isNull() | (F.size("spectrum") != F.col("n_channels"))
    return wide.filter(bad).select(
        *PIXEL, F.size("spectrum").alias("found"), F.col("n_channels").alias("expected")
    )


def assert_shapes(pixels: DataFrame, meta: DataFrame) -> DataFrame:
    """The pixel table, failing at run time on the first spectrum of a wrong length."""
    from .scale import join_dim

    wide = join_dim(pixels, meta.select("image_id", "n_channels"), ["image_id"], "left")
    ok = F.coalesce(F.size("spectrum") == F.col("n_channels"), F.lit(False))
    checked = F.when(ok, F.col("spectrum")).otherwise(
        F.raise_error(F.concat(F.lit("spectrum length does not match the axis of "), F.col("image_id")))
    )
    return wide.withColumn("spectrum", checked).drop("n_channels")
