"""Blocks of text inside a task: bounded slices of Arrow batches, words as numbers, byte counts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.types import StructType

BLOCK_BYTES = 8 << 20
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def _trimmer():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not glibc
        return lambda _: 0


_TRIM = _trimmer()


def give_back() -> None:
    """Free memory goes back to the system: workers are used again, and what they keep counts against their executor."""
    pa.default_memory_pool().release_unused()
    _TRIM(0)


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``limit`` bytes of ``column``, one row at least.

    Null texts come out as empty ones, bytes as they are.
    """
    for batch in batches:
        at = batch.schema.get_field_index(column)
        whole = batch.column(at)
        raw = pa.types.is_binary(whole.type)
        size = pc.fill_null(pc.binary_length(whole), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            base = upto[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(upto, base + limit, side="right")))
            part = batch.slice(start, end - start)
            yield part if raw else part.set_column(at, column, pc.fill_null(pc.cast(part.column(at), pa.string()), ""))
            start = end
        give_back()


def blocks_of_rows(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The slices of ``blocks`` as (rows as they came, their texts without nulls). Memory of a block goes back before the next one."""
    for batch in batches:
        start = 0
        for part in blocks([batch], column, limit):
            yield batch.slice(start, part.num_rows), part.column(part.schema.get_field_index(column))
            start += part.num_rows
            pa.default_memory_pool().release_unused()


def words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of each text: (row of each word, code of each word, the distinct words)."""
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    row = np.repeat(np.arange(len(texts), dtype=np.int64), lists.value_lengths().to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(flat), 0)
    if len(flat) and pc.min(full).as_py() is False:
        flat, row = flat.filter(full), row[full.to_numpy(zero_copy_only=False)]
    coded = flat.dictionary_encode()
    return row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def lengths(strings: pa.Array) -> np.ndarray:
    """Code points of each string."""
    return pc.utf8_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)


def tally(row: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Count (or sum of whole-number weights) for each of n rows."""
    if weight is None:
        return np.bincount(row, minlength=n).astype(np.int64)
    return np.rint(np.bincount(row, weights=weight, minlength=n)).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that near numbers become unrelated ones."""
    z = x.astype(np.uint64) + _MIX[2]
    z = (z ^ (z >> np.uint64(30))) * _MIX[0]
    z = (z ^ (z >> np.uint64(27))) * _MIX[1]
    return z ^ (z >> np.uint64(31))


_ODD = np.uint64(0xD6E8FEB86659FD93)
_ODD_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_SPAN = 1 << 15
_BYTES = mixed(np.arange(256))
_LENGTHS = mixed(np.arange(256))
_MASKS = np.array([256 ** k - 1 for k in range(9)], dtype=np.uint64)
_LONG = 255
_PIECE = 1 << 19
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """n powers of the base at least, and those of its inverse. Tables for the usual span are kept."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS
    made = []
    for base in (_ODD, _ODD_INVERSE):
        table = np.full(max(n, _SPAN + (_SPAN >> 2)), base, dtype=np.uint64)
        table[0] = 1
        made.append(np.multiply.accumulate(table))
    if n <= _SPAN + (_SPAN >> 2):
        _POWERS[:] = made
    return made


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from each start to its end; spans stand in order and do not overlap.

    A polynomial over mixed bytes, modulo 2 ** 64: differences of running sums, shifted to where each span begins by the
    inverse of the base. The sums are taken over pieces of some 32 kB, so that they need little memory.
    """
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(start, base + _SPAN)))
        n = int(end[j - 1] - base)
        power, back = _powers(n + 1)
        upto = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data[base:base + n].astype(np.intp)] * power[:n], out=upto[1:])
        a, b = start[i:j] - base, end[i:j] - base
        out[i:j] = (upto[b] - upto[a]) * back[a]
        i = j
    size = end - start
    return mixed(out ^ (_LENGTHS[size] if len(size) and size.max() < len(_LENGTHS) else mixed(size)))


def hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of strings without nulls, the same in every task."""
    data, bounds = text_bytes(strings)
    return _span_hashes(data, bounds[:-1], bounds[1:])


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where it begins, 64-bit hash) of every word ``[^\\x20\\x09-\\x0D]+`` of the texts that lie between the bounds in ``data``, A-Z lower-cased.

    Words are read eight bytes at a time, very long ones as ``hashes`` reads them.
    """
    # whole texts of some 512 kB at a time: what is made along the way stays small
    cuts = np.unique(np.append(np.searchsorted(bounds, np.arange(0, len(data), _PIECE)), len(bounds) - 1))
    parts = [_word_hashes(data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i]) for i, j in zip(cuts[:-1], cuts[1:])]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = [start + bounds[i] for i, (start, _) in zip(cuts, parts)]
    return np.concatenate(starts), np.concatenate([h for _, h in parts])


def _word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    lowered = np.zeros(n + 8, dtype=np.uint8)
    np.add(data, (data - np.uint8(0x41) < 26).view(np.uint8) << 5, out=lowered[:n])
    inside = np.zeros(n + 2, dtype=bool)
    np.logical_and(data != 0x20, data - np.uint8(0x09) > 4, out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    cut = np.unique(bounds[1:-1])
    cut = cut[inside[cut] & inside[cut + 1]]  # a text ends and the next one begins within a run of word bytes
    if len(cut):
        edge = np.sort(np.concatenate((edge, cut, cut)))
    start, end = edge[::2], edge[1::2]
    size = end - start
    eight = np.ndarray(n + 1, dtype="<u8", buffer=lowered, strides=(1,))
    out = mixed((eight[start] & _MASKS[np.minimum(size, 8)]) ^ _LENGTHS[np.minimum(size, 255)])
    at, far = np.flatnonzero((size > 8) & (size < _LONG)), 8
    while len(at):
        out[at] = mixed(out[at] ^ (eight[start[at] + far] & _MASKS[np.minimum(size[at] - far, 8)]))
        far += 8
        at = at[size[at] > far]
    at = np.flatnonzero(size >= _LONG)
    out[at] = _span_hashes(lowered, start[at], end[at])
    return start, out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the n + 1 places where texts begin and end. Texts hold no nulls."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def counted(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many bytes of each text the mask marks."""
    upto = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return upto[bounds[1:]] - upto[bounds[:-1]]


def ranges(lengths_: np.ndarray) -> np.ndarray:
    """0, 1, ... for every length, joined."""
    lengths_ = np.asarray(lengths_, dtype=np.int64)
    total = int(lengths_.sum())
    starts = np.cumsum(lengths_) - lengths_
    return np.arange(total, dtype=np.int64) - np.repeat(starts, lengths_)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, type=f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def widened(schema: StructType, more: str) -> StructType:
    """A schema with further columns, given as DDL."""
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])
