"""Array batches inside tasks: list columns to matrices and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column) -> np.ndarray:
    """A list<double> column of equal lengths as an (n, c) matrix; NULL elements become NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros((0, 0))
    if column.null_count:
        raise ValueError("NULL spectrum")
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != lengths[0]).any():
        raise ValueError("spectra of one image differ in length")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, int(lengths[0]))


def list_column(values: np.ndarray) -> pa.Array:
    values = np.ascontiguousarray(values, dtype=np.float64)
    n, c = values.shape
    offsets = np.arange(0, (n + 1) * c, c, dtype=np.int32) if c else np.zeros(n + 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))


def scattered(n: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """A list column of n rows from (row numbers, matrix) parts, whose widths may differ; a row of no part is null."""
    width, there = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    for rows, w in parts:
        width[rows], there[rows] = w.shape[1], True
    offsets = np.concatenate(([0], np.cumsum(width)))
    values = np.empty(offsets[-1])
    for rows, w in parts:
        values[offsets[rows][:, None] + np.arange(w.shape[1])] = w
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values), mask=pa.array(~there))


def clean(x: np.ndarray) -> np.ndarray:
    """NaN and infinities to 0, negatives to 0."""
    return np.maximum(np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0), 0.0)


def groups(batch, keys: list[str]):
    """(key tuple, row indices) for every distinct key of a record batch."""
    n = batch.num_rows
    if n == 0:
        return
    code = np.zeros(n, dtype=np.int64)
    for k in keys:
        enc = batch.column(batch.schema.get_field_index(k)).dictionary_encode()
        code = code * (len(enc.dictionary) + 1) + enc.indices.to_numpy(zero_copy_only=False)
    _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    ends = np.cumsum(np.bincount(inverse, minlength=len(first)))
    for f, start, end in zip(first, np.concatenate(([0], ends[:-1])), ends):
        key = tuple(batch.column(batch.schema.get_field_index(k))[int(f)].as_py() for k in keys)
        yield key, order[start:end]


def partial_sums(data, keys: list[str], columns: list[str], fn, max_keys: int = 20_000):
    """Rows (keys, sums) of ``fn(matrix, ...)`` added up per key inside each partition.

    ``fn`` gets one matrix per array column and returns a vector. A task holds at most ``max_keys``
    vectors before it sends them on, so the number of keys is not limited.
    """
    names = [*keys, "sums"]
    from pyspark.sql import types as T

    kinds = [data.schema[k] for k in keys]
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [arrow[k.dataType.simpleString()] for k in kinds]

    def flush(totals):
        cols = [pa.array([k[i] for k in totals], type=t) for i, t in enumerate(types)]
        cols.append(pa.array([v.tolist() for v in totals.values()], type=pa.list_(pa.float64())))
        return pa.RecordBatch.from_arrays(cols, names=names)

    def work(batches):
        totals: dict = {}
        for batch in batches:
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            for key, rows in groups(batch, keys):
                pick = pa.array(rows)
                part = fn(*[matrix(a.take(pick)) for a in arrays])
                totals[key] = totals[key] + part if key in totals else part
            if len(totals) > max_keys:
                yield flush(totals)
                totals = {}
        if totals:
            yield flush(totals)

    schema = T.StructType([*kinds, T.StructField("sums", T.ArrayType(T.DoubleType()))])
    return data.select(*keys, *columns).mapInArrow(work, schema)


def nnls_rows(x: np.ndarray, h: np.ndarray, max_sweeps: int = 10_000) -> np.ndarray:
    """Exact non-negative least squares of every row of ``x`` on the rows of ``h``.

    An active-set method run on all rows at once: rows that share a passive set share one solve. The
    answer of a row depends on that row alone, never on its batch.
    """
    n, k = x.shape[0], h.shape[0]
    g = h @ h.T
    b = x @ h.T
    w = np.zeros((n, k))
    passive = np.zeros((n, k), dtype=bool)
    scale = np.maximum(np.abs(b).max(axis=1), 1e-300)
    tol = 1e-12 * np.maximum(scale, 1.0)
    live = np.arange(n)
    blocked = np.zeros((n, k), dtype=bool)
    for sweep in range(max_sweeps + 1):
        if sweep == max_sweeps and len(live):
            raise ArithmeticError(f"{len(live)} rows have no least-squares solution after {max_sweeps} sweeps")
        grad = b[live] - w[live] @ g
        grad[passive[live] | blocked[live]] = -np.inf
        best = grad.argmax(axis=1)
        gain = grad[np.arange(len(live)), best]
        go = gain > tol[live]
        live, best = live[go], best[go]
        if not len(live):
            break
        passive[live, best] = True
        todo, entered = live, best
        while len(todo):
            s = _solve_passive(g, b[todo], passive[todo])
            p = passive[todo]
            bad = p & (s <= 0)
            # an entering variable that does not move is numerically dependent: give it up
            stuck = bad[np.arange(len(todo)), entered] & (w[todo, entered] == 0)
            if stuck.any():
                rows = todo[stuck]
                passive[rows, entered[stuck]] = False
                blocked[rows, entered[stuck]] = True
            ok = ~bad.any(axis=1)
            done = todo[ok]
            w[done] = s[ok]
            blocked[done] = False
            again = ~ok & ~stuck
            todo, entered, s, bad = todo[again], entered[again], s[again], bad[again]
            if not len(todo):
                break
            cur = w[todo]
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(bad, cur / (cur - s), np.inf)
            alpha = step.min(axis=1)
            new = cur + alpha[:, None] * (s - cur)
            drop = bad & (step <= alpha[:, None])
            new[drop] = 0.0
            w[todo] = np.where(passive[todo], np.maximum(new, 0.0), 0.0)
            passive[todo] &= ~drop
    return w


def _solve_passive(g: np.ndarray, b: np.ndarray, passive: np.ndarray) -> np.ndarray:
    out = np.zeros_like(b)
    patterns, inverse = np.unique(passive, axis=0, return_inverse=True)
    inverse = inverse.reshape(-1)
    for i, pattern in enumerate(patterns):
        idx = np.flatnonzero(pattern)
        if not len(idx):
            continue
        rows = np.flatnonzero(inverse == i)
        sub = g[np.ix_(idx, idx)]
        try:
            sol = np.linalg.solve(sub, b[np.ix_(rows, idx)].T).T
        except np.linalg.LinAlgError:
            sol = b[np.ix_(rows, idx)] @ np.linalg.pinv(sub)
        out[np.ix_(rows, idx)] = sol
    return out
