"""Fixed-spectrum unmixing: exact non-negative least squares, projections, scores, reconstruction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import arrays as A
from ..scale import BROADCAST_CELLS, cell_count, join_dim, materialize
from ..tables import FIELD, PIXEL, ShapeError
from ._dense import clean, groups, matrix, nnls_rows, scattered


def basis_keys(spectra: DataFrame) -> list[str]:
    """Spectra belong to images, or to single slices when the table says so."""
    return [c for c in FIELD if c in spectra.columns]


def basis_rows(spectra: DataFrame) -> DataFrame:
    """One row per key with the component spectra as a flat array in component order."""
    keys = basis_keys(spectra)
    rows = F.array_sort(F.collect_list(F.struct("component", "spectrum")))
    flat = F.flatten(F.transform(rows, lambda r: r["spectrum"]))
    return spectra.groupBy(*keys).agg(flat.alias("_basis"), F.count(F.lit(1)).cast("int").alias("_k"))


def nnls_fixed_h(pixels: DataFrame, spectra: DataFrame, *, column: str = "spectrum", keep: list[str] | None = None,
                 require: int | None = None, limit: int | None = None, eps: float = A.EPS) -> DataFrame:
    """Non-negative abundances of every pixel for fixed spectra, solved exactly row by row.

    The basis travels to the tasks as a broadcast while it is measured small; beyond that it is joined
    to the pixels on their image. No pixel is shuffled in the first case, and a pixel's answer never
    depends on its neighbours. ``require`` asks for that many usable components.
    """
    keep = keep or []
    usable = materialize(spectra.withColumn("spectrum", A.prepare_fixed("spectrum", eps)))
    keys = basis_keys(spectra)
    if require is not None:
        count = usable.groupBy(*keys).agg(
            F.count_if(F.col("spectrum").isNotNull() & F.col("component").between(0, require - 1)).alias("n")
        ).filter(F.col("n") < require)
        if count.take(1):
            raise ValueError("a component has no usable fixed spectrum")
        usable = usable.filter(F.col("component").between(0, require - 1))
    usable = materialize(usable.filter("spectrum IS NOT NULL"))
    basis = basis_rows(usable)
    names = [*PIXEL, *keep]
    data = pixels.select(*names, F.col(column).alias("_x"))  # cleaned inside the tasks
    kept = [pixels.schema[c] for c in keep]
    schema = T.StructType([pixels.schema[c] for c in PIXEL] + kept + [T.StructField("w", T.ArrayType(T.DoubleType()))])

    small = cell_count(usable) <= (BROADCAST_CELLS if limit is None else limit)
    if small:
        table = {
            tuple(r[k] for k in keys): np.asarray(r["_basis"], dtype=float).reshape(r["_k"], -1)
            for r in basis.collect()
        }
        held = pixels.sparkSession.sparkContext.broadcast(table)
    else:
        data = join_dim(data, basis, keys, "left")
        held = None

    def solve(batches):
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            xs = batch.column(batch.schema.get_field_index("_x"))
            blocks = []
            for key, rows in groups(batch, keys):
                if held is not None:
                    h = held.value.get(key)
                else:
                    i = batch.schema.get_field_index("_basis")
                    flat = batch.column(i)[int(rows[0])].as_py()
                    k = batch.column(batch.schema.get_field_index("_k"))[int(rows[0])].as_py()
                    h = None if flat is None else np.asarray(flat, dtype=float).reshape(k, -1)
                if h is None:
                    continue
                x = clean(matrix(xs.take(pa.array(rows))))
                if x.shape[1] != h.shape[1]:
                    raise ShapeError(f"spectra have {x.shape[1]} channels, the basis {h.shape[1]}")
                w = np.zeros((len(rows), h.shape[0]))
                active = (x > eps).any(axis=1)
                if h.shape[0] == 1:
                    w[:, 0] = np.maximum(x @ h[0] / (h[0] @ h[0] + eps), 0.0)
                elif active.any():
                    w[active] = nnls_rows(x[active], h)
                blocks.append((rows, w))
            out = scattered(n, blocks)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in names] + [out], names=[*names, "w"]
            )

    return data.mapInArrow(solve, schema)


def nnls_k1(pixels: DataFrame, spectrum: DataFrame, eps: float = A.EPS, column: str = "spectrum") -> DataFrame:
    """Closed form for a single component; stays in the JVM."""
    side = spectrum.select(*basis_keys(spectrum), A.prepare_fixed("spectrum", eps).alias("_h"))
    joined = join_dim(pixels, side, basis_keys(spectrum))
    x = A.clamp_nonneg(column)
    w = F.greatest(A.dot(x, "_h") / (A.sum_squares("_h") + eps), F.lit(0.0))
    return joined.select(*PIXEL, w.alias("w"))


def project_on_basis(pixels: DataFrame, spectra: DataFrame, column: str = "spectrum", eps: float = A.EPS) -> DataFrame:
    """Non-negative projection of every pixel on every usable spectrum, one row per component."""
    keys = basis_keys(spectra)
    side = spectra.select(*keys, "component", A.prepare_fixed("spectrum", eps).alias("_h")).filter("_h IS NOT NULL")
    joined = join_dim(pixels, side, keys)
    return joined.select(*PIXEL, "component", F.greatest(A.dot(A.clamp_nonneg(column), "_h"), F.lit(0.0)).alias("strength"))


def selective_score_map(pixels: DataFrame, spectra: DataFrame, column: str = "spectrum", eps: float = A.EPS) -> DataFrame:
    """Projection on each spectrum, weighed down where another spectrum fits the pixel as well.

    All spectra of the image reach the pixel as one array, so the competition is row-local.
    """
    keys = basis_keys(spectra)
    usable = spectra.withColumn("spectrum", A.prepare_fixed("spectrum", eps)).filter("spectrum IS NOT NULL")
    packed = usable.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("component", "spectrum"))).alias("_hs"))
    joined = join_dim(pixels, packed, keys)
    strengths = lambda x: F.transform(
        "_hs", lambda h: F.struct(h["component"].alias("component"), A.dot(x, h["spectrum"]).alias("t")))

    def scores(ts):
        def one(me, i):
            rival = F.array_max(F.transform(F.filter(ts, lambda o, j: j != i), lambda o: o["t"]))
            t = F.greatest(me["t"], F.lit(0.0))
            value = F.when(rival.isNull(), t).otherwise(t * (t / (t + rival + eps)))
            return F.struct(me["component"].alias("component"), F.greatest(value, F.lit(eps)).alias("w"))

        return F.transform(ts, one)

    scored = A.let(A.let(A.clamp_nonneg(column), strengths), scores)
    return joined.select(*PIXEL, F.explode(scored).alias("_s")).select(*PIXEL, "_s.component", "_s.w")


def reconstruct(abundance: DataFrame, spectra: DataFrame, out: str = "model") -> DataFrame:
    """W times H per pixel, row-local after the basis join."""
    keys = basis_keys(spectra)
    packed = spectra.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("component", "spectrum"))).alias("_hs"))
    joined = join_dim(abundance, packed, keys)
    rows = F.transform("_hs", lambda h: h["spectrum"])
    zero = F.transform(F.element_at(rows, 1), lambda v: F.lit(0.0))
    pairs = F.arrays_zip(F.col("w").alias("w"), rows.alias("h"))
    model = F.aggregate(
        pairs, zero, lambda acc, p: F.zip_with(acc, p["h"], lambda a, v: a + p["w"] * v)
    )
    return joined.withColumn(out, model).drop("_hs")


def residual(pixels: DataFrame, abundance: DataFrame, spectra: DataFrame, positive: bool = False) -> DataFrame:
    """X - WH; with ``positive`` only what the model leaves unexplained from below."""
    both = pixels.join(abundance.select(*PIXEL, "w"), PIXEL)
    return residual_of(reconstruct(both, spectra), positive)


def residual_of(fitted: DataFrame, positive: bool = False) -> DataFrame:
    diff = lambda a, b: F.greatest(a - b, F.lit(0.0)) if positive else a - b
    return fitted.withColumn("residual", F.zip_with("spectrum", "model", diff))


def apply_fixed_w(maps: DataFrame, seed_maps: DataFrame) -> DataFrame:
    """Replace computed values by fixed ones where a fixed map has the pixel (long maps)."""
    fixed = seed_maps.select("image_id", "component", "y", "x", F.col("w").alias("_fixed"))
    return maps.join(fixed, ["image_id", "component", "y", "x"], "left").withColumn(
        "w", F.coalesce("_fixed", "w")
    ).drop("_fixed")


def to_long_maps(abundance: DataFrame) -> DataFrame:
    return abundance.select(*PIXEL, F.posexplode("w").alias("component", "w"))
