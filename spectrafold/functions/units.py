"""Spectral and length units, labels and physical sizes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted spellings of the spectral and length units.
CM_INV = "cm⁻¹"
NM_NAMES = ["nm", "nanometer", "nanometers", "wavelength"]
INDEX_NAMES = ["channel", "channels", "frame", "frames", "idx", "index", "indices"]
MICROMETRE_NAMES = [
    "µm", "um", "micron", "microns", "micrometer", "micrometers", "micrometre", "micrometres",
]
NANOMETRE_NAMES = ["nm", "nanometer", "nanometers", "nanometre", "nanometres"]
MILLIMETRE_NAMES = ["mm", "millimeter", "millimeters", "millimetre", "millimetres"]
# Micrometres per unit.
TO_UM = {"nm": 1e-3, "µm": 1.0, "mm": 1e3}


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def normalize_spectral_unit(unit) -> Column:
    """``cm⁻¹``, ``nm`` or ``index``; NULL and unknown texts are wavenumbers."""
    key = F.lower(F.trim(F.coalesce(_c(unit).cast("string"), F.lit(""))))
    packed = F.replace(F.translate(key, "−⁻¹", "--1"), F.lit(" "), F.lit(""))
    return (
        F.when(packed.isin(NM_NAMES) | key.isin(NM_NAMES), "nm")
        .when(packed.isin(INDEX_NAMES) | key.isin(INDEX_NAMES), "index")
        .otherwise(CM_INV)
    )


def spectral_csv_header(unit, has_labels=False) -> Column:
    """Header of the axis column in exported spectra."""
    labelled = has_labels if isinstance(has_labels, Column) else F.lit(bool(has_labels))
    norm = normalize_spectral_unit(unit)
    return (
        F.when(labelled, "Channel Label")
        .when(norm == "index", "Channel")
        .when(norm == "nm", "Wavelength (nm)")
        .otherwise("Wavenumber (1/cm)")
    )


def normalize_length_unit(unit) -> Column:
    """``µm``, ``nm`` or ``mm``; anything else is NULL."""
    key = F.replace(F.lower(F.trim(_c(unit))), F.lit("\\u00b5"), F.lit("µ"))
    key = F.translate(key, "μ", "µ")
    return (
        F.when(key.isin(MICROMETRE_NAMES), "µm")
        .when(key.isin(NANOMETRE_NAMES), "nm")
        .when(key.isin(MILLIMETRE_NAMES), "mm")
    )


def pixel_size_um(pixel_size, unit) -> Column:
    factor = F.when(_c(unit) == "nm", F.lit(1e-3)).when(_c(unit) == "mm", F.lit(1e3)).otherwise(F.lit(1.0))
    return _c(pixel_size) * factor


def physical_units(df, binning: int = 1):
    """Field of view, area and pixel size of every image; binning enlarges the pixel."""
    px = F.col("pixel_size") * F.lit(float(binning))
    ny, nx = F.floor(F.col("ny") / binning), F.floor(F.col("nx") / binning)
    return df.select(
        "image_id",
        px.alias("pixel_size"),
        "unit",
        (nx * px).alias("fov_width"),
        (ny * px).alias("fov_height"),
        (nx * px * ny * px).alias("area"),
        pixel_size_um(px, "unit").alias("pixel_size_um"),
        (nx * ny * pixel_size_um(px, "unit") * pixel_size_um(px, "unit")).alias("area_um2"),
    )


def pixel_size_from_fov(fov_width, nx) -> Column:
    return _c(fov_width) / _c(nx)


def component_index(label) -> Column:
    """``Component n`` or ``n`` to n - 1; NULL when the last word is no integer."""
    words = F.filter(F.split(_c(label), "\\s+"), lambda w: w != "")
    return F.element_at(words, F.when(F.size(words) > 0, F.lit(-1))).try_cast("int") - 1
