"""Sinks for spectra, component maps, seed libraries, priors and fit reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.arrays import take
from ..functions.units import spectral_csv_header
from ..tables import PIXEL


def spectra_table(spectra: DataFrame, n_components: int, keys: list[str] | None = None) -> DataFrame:
    """Pivot long spectra (component, channel, value) into one column per component."""
    keys = keys or ["image_id"]
    cells = [
        F.max(F.when(F.col("component") == c, F.col("value"))).alias(f"Component {c}")
        for c in range(n_components)
    ]
    return spectra.groupBy(*keys, "channel").agg(*cells)


def write_spectra_csv(spectra: DataFrame, axis: DataFrame, path: str, n_components: int) -> None:
    """One CSV folder per image with the axis (or its labels) first and a column per component.

    The header names each image's own axis, so it is written as the first line of the image's only file; a spectra
    table has one row per channel, so one file is enough.
    """
    table = spectra_table(spectra, n_components).join(axis, ["image_id", "channel"])
    labelled = axis.groupBy("image_id").agg(F.bool_or(F.col("label").isNotNull()).alias("_has"), F.min("unit").alias("_unit"))
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))
    shown = F.when(F.col("_has"), quoted(F.coalesce("label", F.col("value").cast("string")))).otherwise(F.col("value").cast("string"))
    cells = [F.coalesce(F.col(f"Component {c}").cast("string"), F.lit("")) for c in range(n_components)]
    body = table.join(labelled, "image_id").select("image_id", "channel", F.concat_ws(",", shown, *cells).alias("line"))
    heads = labelled.select("image_id", F.lit(-1).alias("channel"), F.concat_ws(
        ",", quoted(spectral_csv_header("_unit", F.col("_has"))), *[F.lit(f"Component {c}") for c in range(n_components)]).alias("line"))
    (
        body.unionByName(heads).repartition("image_id").sortWithinPartitions("image_id", "channel")
        .select("image_id", F.col("line").alias("value")).write.partitionBy("image_id").mode("overwrite").text(path)
    )


def write_maps(abundance: DataFrame, path: str, order: list[int] | None = None) -> None:
    """Component maps as Parquet, one folder per image and slice; ``order`` picks and sorts components."""
    out = abundance.withColumn("w", take("w", order)) if order else abundance
    out.select(*PIXEL, "w").write.mode("overwrite").partitionBy("image_id", "slice_id").parquet(path)


def save_seed_library(seeds: DataFrame, axis: DataFrame, path: str) -> None:
    seeds.write.mode("overwrite").parquet(f"{path}/seed_spectra")
    axis.write.mode("overwrite").parquet(f"{path}/axis")


def load_seed_library(spark: SparkSession, path: str, target_axis: DataFrame) -> DataFrame:
    """Stored seeds, brought onto the axis they are needed on."""
    from ..operators.axis import interpolate_to_axis

    seeds = spark.read.parquet(f"{path}/seed_spectra")
    axis = spark.read.parquet(f"{path}/axis")
    curves = seeds.select(
        "image_id", "component", "name", "background", F.posexplode("spectrum").alias("channel", "intensity")
    ).join(axis.select("image_id", "channel", F.col("value").alias("axis_value")), ["image_id", "channel"])
    back = interpolate_to_axis(curves, target_axis, ["image_id", "component"], value="intensity")
    spectrum = F.transform(
        F.array_sort(F.collect_list(F.struct("channel", "value"))), lambda s: s["value"]
    )
    rebuilt = back.groupBy("image_id", "component").agg(spectrum.alias("spectrum"))
    return seeds.drop("spectrum").join(rebuilt, ["image_id", "component"])


def save_priors(rois: DataFrame, resonances: DataFrame, path: str) -> None:
    rois.write.mode("overwrite").parquet(f"{path}/rois")
    resonances.write.mode("overwrite").parquet(f"{path}/resonances")


def load_priors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/rois"), spark.read.parquet(f"{path}/resonances")


def write_fit_report(report: DataFrame, path: str) -> None:
    report.write.mode("append").parquet(path)
