"""Readers for tile folders, spectra files and axis files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.units import normalize_spectral_unit

# Fixed pattern of tile names: pos_<x>_<y> or pos-<x>-<y>, signed integers.
TILE_REGEX = r"(?i).*pos[_-](-?\d+)[_-](-?\d+).*"


def file_name(path) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.element_at(F.split(path, "[/\\\\]"), -1)


def file_stem(path) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def parse_tile_names(paths: DataFrame, path: str = "path", regex: str = TILE_REGEX) -> DataFrame:
    """Tile position of every path, beside the other columns; names that do not match keep NULL positions."""
    name = file_name(path)
    return paths.select(
        *[c for c in paths.columns if c not in (path, "path", "tx", "ty")], F.col(path).alias("path"),
        F.regexp_extract(name, regex, 1).try_cast("int").alias("tx"),
        F.regexp_extract(name, regex, 2).try_cast("int").alias("ty"),
    )


def tile_catalog(spark: SparkSession, folder: str, glob: str = "*", regex: str = TILE_REGEX) -> DataFrame:
    """List a folder of tiles; file contents are pruned from the scan."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return parse_tile_names(files.select("path"), "path", regex).filter("tx IS NOT NULL")


def load_tiles(spark: SparkSession, folder: str, loader: Callable, schema: str, glob: str = "*") -> DataFrame:
    """Decode tiles with a user function ``loader(path, content) -> pandas.DataFrame`` inside the tasks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)

    def decode(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                yield loader(path, content)

    return files.select("path", "content").mapInPandas(decode, schema)


def parse_tile_position(names: DataFrame, name: str = "name", delimiter: str = "_", key: str = "pos") -> DataFrame:
    """Token-scan variant of the tile position for older names, with integer or decimal positions.

    A decimal position loses its sign, as in the files this convention comes from.
    """
    parts = F.split(F.col(name), "\\Q" + delimiter + "\\E", -1)
    at = F.array_position(F.transform(parts, lambda p: F.lower(p)), key).cast("int")
    has = (at > 0) & (F.size(parts) >= at + 2)
    tok = lambda k: F.when(has, F.try_element_at(parts, at + k))
    whole = lambda t: F.regexp_replace(F.regexp_replace(t, "^-+", ""), "_+$", "").rlike("^[0-9]+$")
    both_whole = whole(tok(1)) & whole(tok(2))
    any_digit = tok(1).rlike("[0-9]") & tok(2).rlike("[0-9]")
    decimal = lambda t: F.regexp_replace(F.regexp_replace(t, "[^0-9.]", ""), r"\.+$", "").try_cast("double")
    pick = lambda t: F.when(both_whole, t.try_cast("double")).when(any_digit, decimal(t))
    found = both_whole | any_digit
    return names.select(
        F.col(name).alias("name"),
        pick(tok(1)).alias("tx"),
        pick(tok(2)).alias("ty"),
        F.when(has, F.element_at(parts, -1)).alias("number"),
        F.when(has & found, F.array_join(F.slice(parts, 1, F.greatest(at - 1, F.lit(0))), delimiter)).alias("base"),
    )


def grid_completeness(tiles: DataFrame, on: str = "mosaic_id") -> DataFrame:
    """Positions of the full tile grid that have no tile. The grid is built from the distinct
    columns and rows of each mosaic, joined on the mosaic."""
    known = tiles.filter("tx IS NOT NULL AND ty IS NOT NULL").select(on, "tx", "ty").distinct()
    grid = known.select(on, "tx").distinct().join(known.select(on, "ty").distinct(), on)
    return grid.join(known, [on, "tx", "ty"], "left_anti")


def grid_summary(tiles: DataFrame, on: str = "mosaic_id") -> DataFrame:
    """Counts of parsed, skipped and missing tiles per mosaic."""
    parsed = F.col("tx").isNotNull() & F.col("ty").isNotNull()
    return tiles.groupBy(on).agg(
        F.count_if(parsed).alias("n_parsed"),
        F.count_if(~parsed).alias("n_skipped"),
        (
            F.count_distinct(F.when(parsed, F.col("tx"))) * F.count_distinct(F.when(parsed, F.col("ty")))
            - F.count_distinct(F.when(parsed, F.struct("tx", "ty")))
        ).alias("n_missing"),
    )


def read_spectra_csv(spark: SparkSession, path: str) -> DataFrame:
    """First column is the axis, every further column a spectrum; unnamed columns get generic names.

    Files of one folder may have different widths and headers. The header is the first line that is not blank, if
    its first cell is no number; other lines without a number in front are skipped.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"),
        F.filter(F.split(F.regexp_replace("value", "^\\ufeff", ""), "\\r\\n|\\r|\\n"), lambda t: F.trim(t) != "").alias("lines"))
    cells = lambda t: F.transform(F.split(t, ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), lambda c: F.regexp_replace(F.trim(c), '"', ""))
    first = cells(F.try_element_at("lines", F.lit(1)))
    named = F.when(F.try_element_at(first, F.lit(1)).try_cast("double").isNull(), first)
    body = files.select("path", named.alias("head"), F.explode("lines").alias("line")).select("path", "head", cells(F.col("line")).alias("cells"))
    body = body.filter(F.element_at("cells", 1).try_cast("double").isNotNull())
    values = body.select("path", "head", F.element_at("cells", 1).cast("double").alias("axis_value"),
                         F.posexplode(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0)))).alias("component", "cell"))
    name = F.try_element_at(F.col("head"), F.col("component") + 2)
    return values.select(
        "path", "component",
        F.when(name.isNotNull() & (name != ""), name)
        .otherwise(F.concat(F.lit("Component "), (F.col("component") + 1).cast("string"))).alias("name"),
        "axis_value", F.col("cell").try_cast("double").alias("value"),
    )


def parse_two_columns(lines: DataFrame, text: str = "value") -> DataFrame:
    """Numeric two-column lines; blank, short and non-numeric lines are skipped."""
    parts = F.split(F.trim(F.regexp_replace(F.col(text), "^\\ufeff", "")), "\\s+")
    keep = [c for c in lines.columns if c != text]
    return (
        lines.select(
            *keep,
            F.try_element_at(parts, F.lit(1)).try_cast("double").alias("axis_value"),
            F.try_element_at(parts, F.lit(2)).try_cast("double").alias("value"),
        )
        .filter("axis_value IS NOT NULL AND value IS NOT NULL")
    )


def read_spectra_text(spark: SparkSession, path: str) -> DataFrame:
    """Two-column .txt / .asc spectra, named after their file; a file without data is an error.

    A file is one row until its lines are known to hold data, so the error does not depend on the columns that are read.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\\r\\n|\\r|\\n").alias("lines"))
    number = lambda t, i: F.try_element_at(F.split(F.trim(F.regexp_replace(t, "^\\ufeff", "")), "\\s+"), F.lit(i)).try_cast("double")
    good = F.filter("lines", lambda t: number(t, 1).isNotNull() & number(t, 2).isNotNull())
    fail = F.raise_error(F.concat(F.lit("no numeric two-column data in "), F.col("path"))).cast("array<string>")
    found = files.select("path", F.explode(F.when(F.size(good) > 0, good).otherwise(fail)).alias("value"))
    return parse_two_columns(found).select("path", file_stem("path").alias("name"), "axis_value", "value")


def map_tiles(tiles: DataFrame, fn: Callable, schema: str, keys: list[str] | None = None, crop: int = 0, bin_factor: int = 1) -> DataFrame:
    """Apply a user function ``fn(key, cube) -> pandas.DataFrame`` to every tile.

    ``tiles`` has one row per pixel (keys, y, x, spectrum); the cube is (y, x, channel), its border of ``crop`` pixels cut
    off and then averaged over blocks of ``bin_factor`` (an incomplete last block is dropped). Missing pixels are 0.
    """
    import numpy as np

    keys = keys or ["mosaic_id", "tx", "ty"]

    def run(pdf):
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        spectra = np.stack(pdf["spectrum"].to_numpy())
        cube = np.zeros((y.max() + 1, x.max() + 1, spectra.shape[1]))
        cube[y, x] = spectra
        if crop:
            cube = cube[crop:-crop, crop:-crop]
        f = max(1, int(bin_factor))
        ny, nx = cube.shape[0] // f * f, cube.shape[1] // f * f
        cube = cube[:ny, :nx].reshape(ny // f, f, nx // f, f, -1).mean(axis=(1, 3))
        return fn(tuple(pdf[k].iloc[0] for k in keys), cube)

    return tiles.select(*keys, "y", "x", "spectrum").groupBy(*keys).applyInPandas(run, schema)


AXIS_JSON = (
    "custom_values ARRAY<DOUBLE>, custom_points ARRAY<DOUBLE>, custom_labels ARRAY<STRING>, "
    "labels ARRAY<STRING>, spectral_unit STRING, unit STRING, tuned_beam STRING, fixed_beam_nm DOUBLE, "
    "tuned_min_nm DOUBLE, tuned_max_nm DOUBLE, tuned_step_nm DOUBLE"
)


def validate_axis_meta(meta: DataFrame) -> DataFrame:
    """Normalise axis metadata rows and fail on contradictory ones."""
    values = F.coalesce("custom_values", "custom_points")
    labels = F.coalesce("custom_labels", "labels")
    custom = values.isNotNull() | labels.isNotNull()
    beam = F.lower(F.coalesce("tuned_beam", F.lit("")))
    problem = (
        F.when(custom & values.isNotNull() & labels.isNotNull() & (F.size(values) != F.size(labels)),
               "custom_values and custom_labels must have the same length")
        .when(~custom & ~beam.isin("stokes", "pump"), "tuned_beam must be 'stokes' or 'pump'")
        .when(~custom & F.col("fixed_beam_nm").isNull(), "fixed_beam_nm is required")
        .when(~custom & F.coalesce("tuned_min_nm", "tuned_max_nm", "tuned_step_nm").isNull(),
              "need tuned_min_nm and tuned_max_nm, or tuned_step_nm")
    )
    unit = F.coalesce("spectral_unit", "unit")
    others = [c for c in meta.columns if c not in AXIS_JSON_FIELDS]
    return meta.select(
        *others,
        F.when(problem.isNotNull(), F.raise_error(problem).cast("boolean")).otherwise(custom).alias("custom"),
        values.alias("custom_values"),
        labels.alias("custom_labels"),
        F.when(unit.isNotNull(), normalize_spectral_unit(unit)).alias("spectral_unit"),
        F.when(~custom, beam).alias("tuned_beam"),
        "fixed_beam_nm", "tuned_min_nm", "tuned_max_nm", "tuned_step_nm",
    )


AXIS_JSON_FIELDS = [part.strip().split(" ")[0] for part in AXIS_JSON.split(", ")]


def read_axis_json(spark: SparkSession, path: str) -> DataFrame:
    return validate_axis_meta(spark.read.schema(AXIS_JSON).json(path, multiLine=True))


def axis_list_tokens(lists: DataFrame, text: str = "text") -> DataFrame:
    """Tokens of pasted axis lists: all numeric means values, else labels over 0, 1, 2, ..."""
    keep = [c for c in lists.columns if c != text]
    pieces = F.transform(F.split(F.col(text), "[;,\\r\\n]"), lambda t: F.trim(t))
    tokens = F.filter(pieces, lambda t: t != "")
    numeric = F.forall(tokens, lambda t: t.try_cast("double").isNotNull())
    return (
        lists.select(*keep, numeric.alias("_numeric"), F.posexplode(tokens).alias("channel", "token"))
        .select(
            *keep,
            "channel",
            F.when(F.col("_numeric"), F.col("token").try_cast("double"))
            .otherwise(F.col("channel").cast("double")).alias("value"),
            F.when(~F.col("_numeric"), F.col("token")).alias("label"),
        )
    )


def read_axis_list(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )
    return axis_list_tokens(files)
