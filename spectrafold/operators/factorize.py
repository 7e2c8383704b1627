"""Matrix factorisation X ~ W H over pixel tables: multiplicative updates, coordinate descent, PCA.

The state that grows with the pixels (W) never leaves the executors. The state of one iteration on the
driver is H, k x c numbers per image and slice; images are worked through in batches so that it stays
below a fixed size whatever the corpus.

Images and slices that fit in a task are worked through to their end there, in one job. The others advance
together, one pass over their pixels an iteration.

In a pass W is not rewritten. A row of W depends only on its own start value and on the
sequence of H matrices, so each pass replays the H matrices since the last written W, which is a few
small matrix products per row, and sends back k x (k + c) sums. After ``replay`` iterations W is
written to the shared folder beside its spectrum. A pass is one job without a wide shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import arrays as A
from ..scale import clustered, dealt, join_dim, materialize
from ..tables import FIELD, PIXEL, FIT_REPORT, schema
from ._dense import clean, groups, list_column, matrix, scattered


# At most this many partial sums are fetched without adding them on the executors first.
FEW_PARTIALS = 2_000_000
# Numbers of the state on the driver of one batch of images.
STATE_CELLS = 8_000_000
# Numbers (spectra and maps) of an image and slice that one task works through to its end; larger ones are fitted pass by pass.
TASK_CELLS = 2_000_000


@dataclass
class Fit:
    """Maps, spectra and report of a fit. The maps read a cached table until ``release`` is called."""

    abundance: DataFrame
    spectra: DataFrame
    report: DataFrame
    cached: list = field(default_factory=list)

    def release(self) -> None:
        for df in self.cached:
            df.unpersist()


def random_w(k: int, seed: int) -> Column:
    """Uniform start values from a hash of the pixel key, independent of partitioning."""
    draw = lambda j: F.shiftrightunsigned(F.xxhash64(*PIXEL, j, F.lit(seed)), 11) / F.lit(float(2**53))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), draw)


def random_h(k: int, c: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed + 1).random((k, c), dtype=np.float32).astype(float)


def mu_w(x, w, h, eps):
    return w * ((x @ h.T) / (w @ (h @ h.T) + eps))


def cd_w(x, w, h):
    """One coordinate sweep over the columns of W; also the summed projected gradient per call."""
    hht, xht = h @ h.T, x @ h.T
    w = w.copy()
    violation = 0.0
    for t in range(h.shape[0]):
        grad = w @ hht[:, t] - xht[:, t]
        projected = np.where(w[:, t] == 0, np.minimum(grad, 0.0), grad)
        violation += np.abs(projected).sum()
        if hht[t, t] != 0:
            w[:, t] = np.maximum(w[:, t] - grad / hht[t, t], 0.0)
    return w, violation


def cd_h(h, wtw, wtx):
    h = h.copy()
    violation = 0.0
    for t in range(h.shape[0]):
        grad = wtw[t] @ h - wtx[t]
        projected = np.where(h[t] == 0, np.minimum(grad, 0.0), grad)
        violation += np.abs(projected).sum()
        if wtw[t, t] != 0:
            h[t] = np.maximum(h[t] - grad / wtw[t, t], 0.0)
    return h, violation


def _prepared(data: DataFrame) -> DataFrame:
    """Spectra with NaN, infinities and negatives set to 0, done on whole batches."""

    def work(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            i = batch.schema.get_field_index("_x")
            xs = batch.column(i)
            flat = clean(xs.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            lengths = np.concatenate(([0], np.cumsum(np.diff(xs.offsets.to_numpy())))).astype(np.int32)
            if xs.null_count:
                raise ValueError("NULL spectrum")
            fixed = pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat))
            cols = [fixed if j == i else batch.column(j) for j in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return data.mapInArrow(work, data.schema)


def _replay(x, w, steps, solver, update_w, eps):
    """Bring start values through a list of (H, column scale) steps."""
    violation = 0.0
    for h, scale in steps:
        if update_w:
            if solver == "mu":
                w = mu_w(x, w, h, eps)
            else:
                w, violation = cd_w(x, w, h)
        if scale is not None:
            w = w / scale
    return w, violation


def _run_pass(data: DataFrame, history: dict, solver: str, update_w: bool, eps: float, partials: int) -> dict:
    """One pass over the pixels: per field the sums WtW, WtX, column sums of W and the violation."""
    held = data.sparkSession.sparkContext.broadcast(history)

    def work(batches):
        totals: dict = {}
        for batch in batches:
            xs = batch.column(batch.schema.get_field_index("_x"))
            ws = batch.column(batch.schema.get_field_index("_w"))
            for key, rows in groups(batch, FIELD):
                steps = held.value.get(key)
                if steps is None:
                    continue
                pick = pa.array(rows)
                x, w = matrix(xs.take(pick)), matrix(ws.take(pick))
                w, violation = _replay(x, w, steps, solver, update_w, eps)
                part = np.concatenate([(w.T @ w).ravel(), (w.T @ x).ravel(), w.sum(axis=0), [violation]])
                totals[key] = totals[key] + part if key in totals else part
        if totals:
            keys = list(totals)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], type=pa.int32()),
                 list_column(np.vstack([totals[k] for k in keys])) if len({len(totals[k]) for k in keys}) == 1
                 else pa.array([totals[k].tolist() for k in keys], type=pa.list_(pa.float64()))],
                names=[*FIELD, "sums"],
            )

    sums = _collect_sums(data.mapInArrow(work, "image_id STRING, slice_id INT, sums ARRAY<DOUBLE>"), partials)
    held.unpersist()
    return sums


def _collect_sums(parts: DataFrame, partials: int = FEW_PARTIALS + 1) -> dict:
    """One summed vector per field. ``partials`` bounds the numbers all partitions can send: few enough come
    to the driver as they are, in one stage; otherwise they are added on the executors first."""
    out: dict = {}
    if partials <= FEW_PARTIALS:
        for r in parts.collect():
            key, v = (r["image_id"], r["slice_id"]), np.asarray(r["sums"])
            out[key] = out[key] + v if key in out else v
        return out
    rows = (
        parts.select(*FIELD, F.posexplode("sums").alias("i", "v")).groupBy(*FIELD, "i").agg(F.sum("v").alias("v"))
        .groupBy(*FIELD).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))
        .select(*FIELD, F.transform("s", lambda r: r["v"]).alias("s"))
    )
    return {(r["image_id"], r["slice_id"]): np.asarray(r["s"]) for r in rows.collect()}


def _apply(data: DataFrame, history: dict, solver: str, update_w: bool, eps: float, out_x: bool) -> DataFrame:
    """Rows with W brought up to date; fields without history keep their W."""
    held = data.sparkSession.sparkContext.broadcast(history)
    names = [*PIXEL, "_x"] if out_x else list(PIXEL)
    out = "_w" if out_x else "w"

    def work(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            xs = batch.column(batch.schema.get_field_index("_x"))
            ws = batch.column(batch.schema.get_field_index("_w"))
            parts = []
            for key, rows in groups(batch, FIELD):
                pick = pa.array(rows)
                w = matrix(ws.take(pick))
                steps = held.value.get(key)
                if steps:
                    w, _ = _replay(matrix(xs.take(pick)), w, steps, solver, update_w, eps)
                parts.append((rows, w))
            col = scattered(batch.num_rows, parts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(n)) for n in names] + [col], names=[*names, out]
            )

    fields = [data.schema[n] for n in names] + [T.StructField(out, T.ArrayType(T.DoubleType()))]
    return data.mapInArrow(work, T.StructType(fields))


class _Field:
    """Progress of one image and slice on the driver."""

    def __init__(self, h, norm2, n, active):
        self.h, self.norm2, self.n, self.active = h, norm2, n, active
        self.errors: list[float] = []
        self.previous = None
        self.hits = 0
        self.iterations = 0
        self.done = False
        self.first_violation = None
        self.last_error = None


def _error(field: _Field, wtw, wtx) -> float:
    value = field.norm2 - 2.0 * float((wtx * field.h).sum()) + float((wtw * (field.h @ field.h.T)).sum())
    return float(np.sqrt(max(value, 0.0)))


def nmf(
    pixels: DataFrame,
    k: int,
    *,
    solver: str = "mu",
    spectra: DataFrame | None = None,
    w0: str | None = None,
    column: str = "spectrum",
    max_iter: int = 500,
    tol: float = 1e-4,
    patience: int = 1,
    track_error_every: int = 10,
    eps: float = 1e-8,
    update_w: bool = True,
    update_h: bool = True,
    normalize_w_columns: bool = False,
    seed: int = 0,
    replay: int = 25,
    state_limit: int = STATE_CELLS,
    task_limit: int = TASK_CELLS,
) -> Fit:
    """Factorise every image and slice of a pixel table into k components.

    Without ``spectra`` and ``w0`` the start is random: W from a hash of the pixel key, H from a seeded
    generator. Fields of up to ``task_limit`` numbers are each fitted by one task, the others advance
    together, one pass per iteration. Each stops by its own error.
    """
    if not update_w and not update_h:
        raise ValueError("at least one of update_w and update_h must be True")
    if solver not in ("mu", "cd"):
        raise ValueError("solver is 'mu' or 'cd'")
    if solver == "cd" and normalize_w_columns:
        raise ValueError("column normalisation belongs to the multiplicative solver")
    spark = pixels.sparkSession
    start = F.col(w0) if w0 else random_w(k, seed)
    if solver == "mu":
        start = F.transform(A.clamp_nonneg(start), lambda v: F.greatest(v, F.lit(eps)))
    elif w0:
        start = A.clamp_nonneg(start)
    base = _prepared(clustered(pixels.select(*PIXEL, F.col(column).alias("_x"), start.alias("_w")), FIELD, ["y", "x"]))
    base = base.persist(StorageLevel.MEMORY_AND_DISK)
    shapes = base.groupBy(*FIELD).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_x")).alias("c"), F.max(F.size("_w")).alias("k"))
    moments = _per_field(base, lambda key, x: np.array([(x * x).sum(), x.sum(), (x > eps).any(axis=1).sum()]), "_x")
    sums = moments.groupBy(*FIELD).agg(*[
        F.sum(F.element_at("sums", i + 1)).alias(n) for i, n in enumerate(("norm2", "sum", "active"))])
    facts = materialize(shapes.join(sums, FIELD))
    inside = F.coalesce(F.col("n") * (F.col("c") + F.col("k")) <= task_limit, F.lit(False))
    kinds = facts.groupBy(inside.alias("whole")).agg(F.count(F.lit(1)).alias("fields"), F.max("c").alias("c")).collect()
    if not kinds:
        raise ValueError("no pixels")
    fits = []
    for whole, several, width in kinds:
        chosen = facts.filter(inside == whole)
        of_kind = base if len(kinds) == 1 else join_dim(base, chosen.select(*FIELD), FIELD, "left_semi")
        per_field = k * (width + k) * (1 if whole else replay + 1)
        n_batches = min(several, max(1, -(-several * per_field // state_limit)))
        for b in range(n_batches):
            if n_batches == 1:
                part, part_facts, part_h = of_kind, chosen, spectra
            else:
                here = F.pmod(F.xxhash64(*FIELD), F.lit(n_batches)) == b
                part, part_facts = of_kind.filter(here), chosen.filter(here)
                part_h = spectra  # seeds may lack the slice, so they are chosen by the images of the batch
                if spectra is not None:
                    part_h = spectra.join(part_facts.select("image_id").distinct(), "image_id", "left_semi")
            rows = part_facts.collect()
            if not rows:
                continue
            starts = _start_h(rows, part_h, k, seed, solver, eps)
            state = {key: (starts[key], r["norm2"], r["n"], r["active"]) for r in rows for key in [(r["image_id"], r["slice_id"])]}
            rules = dict(k=k, solver=solver, max_iter=max_iter, tol=tol, patience=patience, every=track_error_every, eps=eps,
                         update_w=update_w, update_h=update_h, normalize=normalize_w_columns)
            fits.append(_fit_in_tasks(part, state, **rules) if whole
                        else _settle(n_batches, _fit_batch(part, state, width, replay=replay, **rules)))
    out = fits[0]
    for f in fits[1:]:
        out = Fit(out.abundance.unionByName(f.abundance), out.spectra.unionByName(f.spectra),
                  out.report.unionByName(f.report))
    out.cached = [base]
    return out


def _settle(n_batches: int, fit: Fit) -> Fit:
    """With many batches each result is written, so the driver keeps none of them."""
    if n_batches == 1:
        return fit
    return Fit(materialize(fit.abundance), materialize(fit.spectra), materialize(fit.report))


def _start_h(rows, spectra, k, seed, solver, eps):
    given = {}
    if spectra is not None:
        for r in spectra.collect():
            key = (r["image_id"], r["slice_id"]) if "slice_id" in spectra.columns else r["image_id"]
            given.setdefault(key, {})[r["component"]] = np.asarray(r["spectrum"], dtype=float)
    out = {}
    for r in rows:
        key = (r["image_id"], r["slice_id"])
        seeds = given.get(key, given.get(r["image_id"]))
        if r["k"] != k:
            raise ValueError(f"start maps of {key} have {r['k']} components, not {k}")
        if spectra is not None:
            if not seeds or any(i not in seeds for i in range(k)):
                raise ValueError(f"start spectra of {key} are not complete")
            h = clean(np.vstack([seeds[i] for i in range(k)]))
            if h.shape[1] != r["c"]:
                raise ValueError(f"start spectra of {key} have {h.shape[1]} channels, not {r['c']}")
        elif solver == "mu":
            h = random_h(k, r["c"], seed)
        else:
            level = np.sqrt(r["sum"] / (r["n"] * r["c"]) / k)
            h = level * np.abs(np.random.default_rng(seed).standard_normal((k, r["c"])))
        out[key] = np.maximum(h, eps) if solver == "mu" else h
    return out


def _advance(f: _Field, sums: np.ndarray, iteration: int, *, k, solver, max_iter, tol, patience, every, eps, update_h, normalize):
    """Finish an iteration from the sums over the pixels: H, error and whether the field is done. Returns the scale of W's columns, if any."""
    c = f.h.shape[1]
    wtw, wtx = sums[: k * k].reshape(k, k), sums[k * k: k * k + k * c].reshape(k, c)
    column_sums, violation, scale = sums[k * k + k * c: -1], sums[-1], None
    if update_h:
        if solver == "mu":
            f.h = f.h * (wtx / (wtw @ f.h + eps))
        else:
            f.h, more = cd_h(f.h, wtw, wtx)
            violation = violation + more
    if normalize:
        scale = np.maximum(column_sums, eps)
        wtw, wtx = wtw / np.outer(scale, scale), wtx / scale[:, None]
        f.h = f.h * scale[:, None]
    f.iterations = iteration
    if solver == "mu":
        if iteration % every == 0 or iteration == max_iter:
            _judge(f, _error(f, wtw, wtx), tol, patience, eps)
    else:
        f.last_error = _error(f, wtw, wtx)
        f.errors.append(f.last_error)
        if f.first_violation is None:
            f.first_violation = violation
        f.done = f.first_violation == 0 or violation / f.first_violation <= tol
    return scale


def _report_row(key: tuple, f: _Field, solver: str, max_iter: int, tol: float) -> tuple:
    norm = float(np.sqrt(f.norm2))
    relative = f.last_error / norm if norm > A.DOUBLE_EPS else (0.0 if abs(f.last_error) <= A.DOUBLE_EPS else None)
    return (key[0], key[1], f"{solver}_nmf", f.iterations, max_iter, float(tol), int(f.n), int(f.active),
            f.last_error, norm, relative, f.errors, "raw")


_REPORT_TYPES = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(),
                 *[pa.float64()] * 3, pa.list_(pa.float64()), pa.string()]


def _fit_in_tasks(base: DataFrame, state: dict, *, solver, max_iter, tol, update_w, eps, **rules) -> Fit:
    """Fields that each fit in a task: all iterations of one are done where its pixels are. W, H and report are written once."""
    held = base.sparkSession.sparkContext.broadcast(state)
    report = schema(FIT_REPORT)
    lists = T.ArrayType(T.ArrayType(T.DoubleType()))
    out = T.StructType([*report.fields, *[T.StructField(n, T.ArrayType(base.schema[n].dataType)) for n in ("y", "x")],
                        T.StructField("w", lists), T.StructField("h", lists)])
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def solve(pixels: pa.Table) -> pa.Table:
        pixels = pixels.sort_by([("y", "ascending"), ("x", "ascending")])
        key = tuple(pixels.column(n)[0].as_py() for n in FIELD)
        f = _Field(*held.value[key])
        x, w = matrix(pixels.column("_x")), matrix(pixels.column("_w"))
        for iteration in range(1, max_iter + 1):
            if f.done:
                break
            w, violation = _replay(x, w, [(f.h, None)], solver, update_w, eps)
            sums = np.concatenate([(w.T @ w).ravel(), (w.T @ x).ravel(), w.sum(axis=0), [violation]])
            scale = _advance(f, sums, iteration, solver=solver, max_iter=max_iter, tol=tol, eps=eps, **rules)
            if scale is not None:
                w = w / scale
        said = [pa.array([v], t) for v, t in zip(_report_row(key, f, solver, max_iter, tol), _REPORT_TYPES)]
        place = [one(pixels.column(n).combine_chunks()) for n in ("y", "x")]
        return pa.Table.from_arrays([*said, *place, one(list_column(w)), one(list_column(f.h))], names=out.names)

    known = base.filter(" AND ".join(f"{n} IS NOT NULL" for n in FIELD))
    done = materialize(dealt(known, FIELD).groupBy(*FIELD).applyInArrow(solve, out))
    pixel = done.select(*FIELD, F.explode(F.arrays_zip("y", "x", "w")).alias("p")).select(*FIELD, "p.y", "p.x", "p.w")
    spectra = done.select(*FIELD, F.posexplode("h").alias("component", "spectrum"))
    return Fit(pixel, spectra, done.select(*report.names))


def _fit_batch(base: DataFrame, state: dict, width: int, *, k, solver, max_iter, tol, update_w, eps, replay, **rules) -> Fit:
    """Fields of any size, which advance together: one pass over the pixels an iteration."""
    spark = base.sparkSession
    state = {key: _Field(*start) for key, start in state.items()}
    data = base
    history: dict = {key: [] for key in state}
    since = 0
    # fields lie in ranges: a field is in one partition, but for those that a partition or file begins or ends with
    bound = lambda d: (len(state) + 4 * d.rdd.getNumPartitions()) * (k * k + k * width + k + 1)
    partials = bound(data)
    for iteration in range(1, max_iter + 1):
        live = [key for key, f in state.items() if not f.done]
        if not live:
            break
        for key in live:
            history[key].append((state[key].h, None))
        sums = _run_pass(data, {key: history[key] for key in live}, solver, update_w, eps, partials)
        for key in live:
            scale = _advance(state[key], sums[key], iteration, k=k, solver=solver, max_iter=max_iter, tol=tol, eps=eps, **rules)
            if scale is not None:
                history[key][-1] = (history[key][-1][0], scale)
        since += 1
        if since >= replay and iteration < max_iter:
            fresh = materialize(_apply(data, history, solver, update_w, eps, out_x=True))
            data, history, since = fresh, {key: [] for key in state}, 0
            partials = bound(data)
    abundance = _apply(data, history, solver, update_w, eps, out_x=False)
    spectra_rows = [
        (key[0], key[1], i, [float(v) for v in f.h[i]]) for key, f in sorted(state.items()) for i in range(k)
    ]
    report_rows = [_report_row(key, f, solver, max_iter, tol) for key, f in sorted(state.items())]
    return Fit(
        abundance,
        spark.createDataFrame(spectra_rows, "image_id STRING, slice_id INT, component INT, spectrum ARRAY<DOUBLE>"),
        spark.createDataFrame(report_rows, schema(FIT_REPORT)),
    )


def _judge(f: _Field, error: float, tol: float, patience: int, eps: float) -> None:
    """Stop after ``patience`` checks in a row whose relative improvement is at most ``tol``."""
    f.errors.append(error)
    f.last_error = error
    if f.previous is not None:
        if (f.previous - error) / max(f.previous, eps) <= tol:
            f.hits += 1
            f.done = f.hits >= max(int(patience), 1)
        else:
            f.hits = 0
    f.previous = error


def nmf_mu(pixels: DataFrame, k: int, **options) -> Fit:
    """Random start, multiplicative updates."""
    return nmf(pixels, k, solver="mu", **options)


def nmf_cd(pixels: DataFrame, k: int, **options) -> Fit:
    """Coordinate descent; seeds keep their exact zeros."""
    return nmf(pixels, k, solver="cd", **options)


def nmf_seeded(pixels: DataFrame, spectra: DataFrame, k: int, w0: str = "w", **options) -> Fit:
    """Start from seed maps and seed spectra; fails when a seed map is not usable."""
    checks = []
    for j in range(k):
        v = F.element_at(F.col(w0), j + 1)
        checks.append(F.bool_and(v >= 0) & F.bool_or(v > 0))
    ready = pixels.groupBy(*FIELD).agg(F.array(*checks).alias("ok")).filter(F.exists("ok", lambda o: ~o))
    if ready.take(1):
        raise ValueError("seed maps are not completely filled")
    return nmf(pixels, k, spectra=spectra, w0=w0, **options)


def nmf_mu_step(pixels: DataFrame, spectra: DataFrame, w0: str = "w", eps: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """One update of W and then of H as plain expressions: new maps and new long spectra."""
    from ..scale import join_dim
    from .stats import gram

    packed = spectra.groupBy("image_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("component", "spectrum"))), lambda r: r["spectrum"]).alias("_h")
    )
    both = join_dim(pixels, packed, ["image_id"])
    hht = F.transform("_h", lambda a: F.transform("_h", lambda b: A.dot(a, b)))
    numer = F.transform("_h", lambda h: A.dot(F.col("spectrum"), h))
    denom = F.transform(hht, lambda row: A.dot(F.col(w0), row) + eps)
    new_w = F.zip_with(F.col(w0), F.zip_with(numer, denom, lambda a, b: a / b), lambda w, r: w * r)
    stepped = both.select(*PIXEL, "spectrum", new_w.alias("w"))
    wtw, wtx = gram(stepped, "w", "spectrum")
    long_h = spectra.select("image_id", "component", F.posexplode("spectrum").alias("channel", "h"))
    mixed = wtw.join(
        long_h.withColumnRenamed("component", "j"), ["image_id", "j"]
    ).groupBy(*FIELD, "i", "channel").agg(F.sum(F.col("value") * F.col("h")).alias("denominator"))
    new_h = (
        wtx.join(mixed, [*FIELD, "i", "channel"])
        .join(long_h.withColumnRenamed("component", "i"), ["image_id", "i", "channel"])
        .select(*FIELD, F.col("i").alias("component"), "channel",
                (F.col("h") * F.col("value") / (F.col("denominator") + eps)).alias("value"))
    )
    return stepped.select(*PIXEL, "w"), new_h


def pca(pixels: DataFrame, k: int, *, column: str = "spectrum", state_limit: int = STATE_CELLS) -> Fit:
    """Principal components of the standardised channels of every image and slice.

    Channel moments and the c x c covariance are summed on the executors; the driver only diagonalises.
    Scores are shifted to start at 0 where they are negative, then scaled by one factor so that the
    largest of all scores is 65535. The sign of a component makes its largest loading positive.
    """
    spark = pixels.sparkSession
    pixels = materialize(clustered(pixels.select(*PIXEL, column), FIELD, ["y", "x"]))
    facts = pixels.groupBy(*FIELD).agg(F.max(F.size(column)).alias("c"))
    count, width = facts.agg(F.count(F.lit(1)), F.max("c")).first()
    n_batches = min(count, max(1, -(-count * width * (width + 4) // state_limit)))
    parts = []
    for b in range(n_batches):
        part = pixels if n_batches == 1 else pixels.filter(F.pmod(F.xxhash64(*FIELD), F.lit(n_batches)) == b)
        parts.append(_settle(n_batches, _pca_batch(part, k, column)))
    out = parts[0]
    for f in parts[1:]:
        out = Fit(out.abundance.unionByName(f.abundance), out.spectra.unionByName(f.spectra), out.report.unionByName(f.report))
    return out


def _per_field(data: DataFrame, fn, column: str) -> DataFrame:
    """Partial vectors of ``fn(key, matrix)`` per partition and field."""

    def work(batches):
        totals: dict = {}
        for batch in batches:
            xs = batch.column(batch.schema.get_field_index(column))
            for key, rows in groups(batch, FIELD):
                part = fn(key, matrix(xs.take(pa.array(rows))))
                if part is not None:
                    totals[key] = totals[key] + part if key in totals else part
        if totals:
            keys = list(totals)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], type=pa.int32()),
                 pa.array([totals[k].tolist() for k in keys], type=pa.list_(pa.float64()))], names=[*FIELD, "sums"])

    return data.select(*FIELD, column).mapInArrow(work, "image_id STRING, slice_id INT, sums ARRAY<DOUBLE>")


def _pca_batch(pixels: DataFrame, k: int, column: str) -> Fit:
    from .condition import channel_moments, kept_channels

    spark = pixels.sparkSession
    long = pixels.select(*FIELD, F.posexplode(column).alias("channel", "value"))
    moments: dict = {}
    for r in kept_channels(channel_moments(long)).collect():
        moments.setdefault((r["image_id"], r["slice_id"]), []).append((r["channel"], r["mean"], r["std"]))
    moments = {key: tuple(np.asarray(col) for col in zip(*sorted(v))) for key, v in moments.items()}
    held = spark.sparkContext.broadcast(moments)

    def standard(key, x):
        ch, mean, std = held.value[key]
        return (x[:, ch.astype(int)] - mean) / std

    def second(key, x):
        if key not in held.value:
            return None
        z = standard(key, x)
        return np.concatenate([(z.T @ z).ravel(), [len(z)]])

    basis = {}
    spectra_rows, report_rows = [], []
    for r in pixels.groupBy(*FIELD).count().collect():
        if (r["image_id"], r["slice_id"]) not in moments:  # no channel varies: the field is reported and has no components
            report_rows.append((r["image_id"], r["slice_id"], "pca", 0, 1, None, r["count"], 0, None, 0.0, None, [], "no usable channel"))
    for key, s in sorted(_collect_sums(_per_field(pixels, second, column)).items()):
        ch = moments[key][0].astype(int)
        c = len(ch)
        values, vectors = np.linalg.eigh(s[:-1].reshape(c, c) / s[-1])
        order = np.argsort(values)[::-1]
        values, vectors = values[order], vectors[:, order]
        size = np.abs(vectors)
        lead = (size >= size.max(axis=0) * (1 - 1e-9)).argmax(axis=0)  # first of equally large loadings
        vectors = vectors * np.where(vectors[lead, np.arange(c)] < 0, -1.0, 1.0)
        basis[key] = vectors
        for i in range(min(k, c)):
            full = [None] * int(ch.max() + 1)
            for j, cc in enumerate(ch):
                full[cc] = float(vectors[j, i])
            spectra_rows.append((key[0], key[1], i, full))
        report_rows.append((key[0], key[1], "pca", 1, 1, None, int(s[-1]), int(s[-1]), None, float(np.sqrt(s[-1] * c)),
                            None, [float(v) for v in values], "raw"))
    vectors_held = spark.sparkContext.broadcast(basis)

    def bounds(batches):
        low: dict = {}
        high: dict = {}
        for batch in batches:
            xs = batch.column(batch.schema.get_field_index(column))
            for key, rows in groups(batch, FIELD):
                if key not in vectors_held.value:
                    continue
                t = standard(key, matrix(xs.take(pa.array(rows)))) @ vectors_held.value[key]
                low[key] = np.minimum(low[key], t.min(axis=0)) if key in low else t.min(axis=0)
                high[key] = np.maximum(high[key], t.max(axis=0)) if key in high else t.max(axis=0)
        if low:
            keys = list(low)
            yield pa.RecordBatch.from_arrays(
                [pa.array([q[0] for q in keys]), pa.array([q[1] for q in keys], type=pa.int32()),
                 pa.array([low[q].tolist() for q in keys], type=pa.list_(pa.float64())),
                 pa.array([high[q].tolist() for q in keys], type=pa.list_(pa.float64()))], names=[*FIELD, "low", "high"])

    ranges = pixels.select(*FIELD, column).mapInArrow(bounds, "image_id STRING, slice_id INT, low ARRAY<DOUBLE>, high ARRAY<DOUBLE>")
    flat = ranges.select(*FIELD, F.posexplode(F.arrays_zip("low", "high")).alias("i", "r"))
    ends = flat.groupBy(*FIELD, "i").agg(F.min("r.low").alias("low"), F.max("r.high").alias("high"))
    shifts: dict = {}
    for r in ends.collect():
        shifts.setdefault((r["image_id"], r["slice_id"]), {})[r["i"]] = (r["low"], r["high"])
    scaling = {}
    for key, d in shifts.items():
        low = np.asarray([min(d[i][0], 0.0) for i in range(len(d))])
        high = np.asarray([d[i][1] for i in range(len(d))])
        scaling[key] = (low, 65535.0 / float((high - low).max()))
    scaling_held = spark.sparkContext.broadcast(scaling)

    def scores(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            xs = batch.column(batch.schema.get_field_index(column))
            for key, rows in groups(batch, FIELD):
                if key not in vectors_held.value:
                    continue
                pick = pa.array(rows)
                t = standard(key, matrix(xs.take(pick))) @ vectors_held.value[key]
                low, factor = scaling_held.value[key]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index(n)).take(pick) for n in PIXEL]
                    + [list_column(((t - low) * factor)[:, :k])], names=[*PIXEL, "w"])

    fields = [pixels.schema[n] for n in PIXEL] + [T.StructField("w", T.ArrayType(T.DoubleType()))]
    abundance = pixels.select(*PIXEL, column).mapInArrow(scores, T.StructType(fields))
    return Fit(
        abundance,
        spark.createDataFrame(spectra_rows, "image_id STRING, slice_id INT, component INT, spectrum ARRAY<DOUBLE>"),
        spark.createDataFrame(report_rows, schema(FIT_REPORT)),
    )
