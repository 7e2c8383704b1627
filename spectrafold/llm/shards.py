"""Sharding: whole groups of equal texts are packed into shards of near-equal bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..scale import materialize
from .blocks import batch_of, mixed, widened


class FreeSpace:
    """A balanced search tree (treap) of (remaining capacity, bin): find the tightest bin in which a size fits."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _order(key: tuple[int, int]) -> int:
        return int(mixed(np.array([key[1] + 1], dtype=np.uint64))[0])  # each bin has a fixed random place in the heap

    def add(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, [key, self._order(key), None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the entry of the least remaining capacity that is at least ``size``."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        first, rest = self._pop_least(high)
        self.root = self._join(low, rest)
        return first

    def _split(self, t, key):
        """(entries below key, the others)"""
        if t is None:
            return None, None
        if t[0] < key:
            a, b = self._split(t[3], key)
            t[3] = a
            return t, b
        a, b = self._split(t[2], key)
        t[2] = b
        return a, t

    def _join(self, a, b):
        if a is None or b is None:
            return a if b is None else b
        if a[1] > b[1]:
            a[3] = self._join(a[3], b)
            return a
        b[2] = self._join(a, b[2])
        return b

    def _pop_least(self, t):
        if t[2] is None:
            return t[0], t[3]
        first, t[2] = self._pop_least(t[2])
        return first, t


def best_fit(sizes: list[int], counts: list[int], capacity: int, most_bins: int | None = None) -> list[tuple[int, int, int]] | None:
    """Best-fit decreasing over classes of equal sizes: (class, bin, how many) in the order of placing.

    ``sizes`` falls. A group goes to the tightest bin that has room; as the next of its size finds the same bin tightest
    until it is full, a whole class is placed by one look-up for each bin it touches. A group larger than
    ``capacity`` gets a bin of its own. With ``most_bins``, None says that more bins would be needed.
    """
    space, bins, out = FreeSpace(), 0, []
    for c, (size, count) in enumerate(zip(sizes, counts)):
        while count:
            found = space.take(size)
            if found is None:
                if most_bins is not None and (bins == most_bins or size > capacity):
                    return None
                found, bins = (max(capacity, size), bins), bins + 1
            room, b = found
            fit = min(count, room // size)
            out.append((c, b, fit))
            count -= fit
            if room - fit * size:
                space.add((room - fit * size, b))
    return out


def least(sizes: list[int], counts: list[int], bins: int, known: tuple[int, list] | None = None) -> tuple[int, list[tuple[int, int, int]]]:
    """The least capacity, found by halving, for which best-fit decreasing needs no more than ``bins`` bins, and its packing.

    ``known`` is a capacity that is known to do, with its packing.
    """
    total = sum(s * c for s, c in zip(sizes, counts))
    if not total:
        return 0, []
    low = max(-(-total // bins), next(s for s, c in zip(sizes, counts) if c))
    best = best_fit(sizes, counts, low, bins)
    if best is not None:
        return low, best
    if known:
        high, best = known
    else:
        high = low
        while best is None:
            high += max(1, (high - low) or low)
            best = best_fit(sizes, counts, high, bins)
    while high - low > 1:
        middle = (low + high) // 2
        found = best_fit(sizes, counts, middle, bins)
        if found is None:
            low = middle
        else:
            high, best = middle, found
    return high, best


def level(sizes: list[int], counts: list[int], bins: int) -> list[tuple[int, int, int]]:
    """Best-fit decreasing into at most ``bins`` bins of near-equal load: (class, bin, how many) in the order of classes.

    A group above the mean of what is left gets a bin of its own. The others share the remaining bins at the least
    capacity that does. Where loads still differ by more than a hundredth of the mean and the smallest group, best fit has
    filled some bins at the expense of others: the fullest one is settled, and what is left is packed anew into the rest, at
    a capacity that is never larger.
    """
    counts, out, used = list(counts), [], 0
    left = sum(s * c for s, c in zip(sizes, counts))
    for c, size in enumerate(sizes):
        while counts[c] and size * (bins - used) > left:
            out.append((c, used, 1))
            counts[c], left, used = counts[c] - 1, left - size, used + 1
    if not left:
        return out
    capacity, runs = least(sizes, counts, bins - used)
    while bins - used > 1:
        load = [0] * (bins - used)
        for c, b, k in runs:
            load[b] += k * sizes[c]
        smallest = next(s for s, c in zip(reversed(sizes), reversed(counts)) if c)
        if max(load) - min(load) <= max(smallest, sum(load) // (100 * len(load))):
            break
        top = load.index(max(load))
        rest = []
        for c, b, k in runs:
            if b == top:
                out.append((c, used, k))
                counts[c] -= k
            else:
                rest.append((c, b - (b > top), k))
        used += 1
        capacity, runs = least(sizes, counts, bins - used, (capacity, rest))
    return sorted(out + [(c, used + b, k) for c, b, k in runs], key=lambda r: r[0])


def _numbered(rows: DataFrame, *by: str) -> DataFrame:
    """The rows, written once, with ``part`` and ``local``: place among the equal values of ``by`` in its task."""
    columns = rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, upto = TaskContext.get().partitionId(), {}
        for batch in batches:
            keys = list(zip(*(batch.column(columns.index(c)).to_pylist() for c in by))) if by else [()] * batch.num_rows
            local = []
            for key in keys:
                local.append(upto.get(key, 0))
                upto[key] = local[-1] + 1
            more = [pa.array([part] * batch.num_rows, pa.int32()), pa.array(local, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*columns, "part", "local"])

    return materialize(rows.mapInArrow(run, widened(rows.schema, "part int, local long")))


def _before(numbered: DataFrame, *by: str) -> DataFrame:
    """Rows of the same ``by`` in earlier parts, for each part: as many rows as parts, or parts times values."""
    sums = numbered.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("n"))
    window = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, "part", F.coalesce(F.sum("n").over(window), F.lit(0)).alias("before"))


def _sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("digest"))


def shard(docs: DataFrame, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each document; the law is ``bytes``.

    A size is the UTF-8 bytes of the text plus one. Documents of equal texts are one indivisible group (null texts
    are empty ones), told apart by SHA-256. Groups enter by falling size the shard with the least room that suffices.
    With ``capacity`` there are as few shards of that many bytes as this gives, and a larger group is a shard by
    itself. With ``shards`` a group above the mean of what is left has a shard to itself, and the others are levelled over the
    remaining shards (see ``level``), so that bytes are as near equal as whole groups allow best fit. Slots number each shard without a gap. Rows that repeat are numbered each; null ids are
    sharded like others; other columns are ignored; an empty table gives no rows.

    The driver gets one row for each distinct group size (fewer than the root of twice the bytes), and packs these
    classes. Which group of a class goes where is decided by its place in a range-partitioned order of groups, and slots by
    counts of tasks, so no group, class or shard is gathered in one task.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    spark = docs.sparkSession
    sized = materialize(_sized(docs))
    groups = sized.groupBy("digest").agg(F.sum("size").alias("bytes"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = _numbered(groups.repartitionByRange(parts, F.col("bytes").desc(), "digest")
                         .sortWithinPartitions(F.col("bytes").desc(), "digest"))
    table = numbered.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pandas().sort_values("bytes", ascending=False)
    sizes, counts = table["bytes"].astype(int).tolist(), table["n"].astype(int).tolist()
    runs = level(sizes, counts, shards) if shards else best_fit(sizes, counts, capacity)
    taken = np.array([r[2] for r in runs], dtype=np.int64)
    ends, bins = np.cumsum(taken), np.array([r[1] for r in runs], dtype=np.int32)
    sent = spark.sparkContext.broadcast((ends, bins))
    placed = numbered.join(_before(numbered), "part").select("digest", (F.col("before") + F.col("local")).alias("place"))
    schema = pa.schema([("digest", pa.binary()), ("shard", pa.int32())])

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, bins = sent.value
        for batch in batches:
            place = batch.column(1).to_numpy(zero_copy_only=False)
            yield batch_of(schema, batch.column(0), bins[np.searchsorted(ends, place, side="right")])

    shard_of = placed.mapInArrow(assign, "digest binary, shard int")
    held = sized.join(shard_of, "digest").select("doc_id", "size", "text_crc32", "shard")
    slotted = _numbered(held, "shard")
    return slotted.join(_before(slotted, "shard"), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("local")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
