"""Near-duplicate documents by 64-bit SimHash fingerprints and a multi-index over their halves."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..scale import materialize
from .blocks import batch_of, blocks
from .graph import components

SEED = 42
CHUNK = 1 << 15
PAIRWISE = 1 << 21  # groups up to so many comparisons are compared directly, larger ones by enumerating balls

SCHEMA = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprint(text: str, size: int = 3) -> int:
    """The fingerprint of one whole text as a signed 64-bit number."""
    from xxhash import xxh64_digest

    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > size:
        starts, ends = starts[:len(words) - size + 1], ends[size - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    count = np.zeros(64, dtype=np.int64)
    for i in range(0, len(starts), CHUNK):
        pairs = zip(starts[i:i + CHUNK].tolist(), ends[i:i + CHUNK].tolist())
        digests = b"".join([xxh64_digest(joined[s:e], SEED) for s, e in pairs])
        bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8), axis=1)
        count += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * count > len(starts)).view(">i8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp) of each document; null and wordless texts have fingerprint zero."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            yield batch_of(SCHEMA, part.column(0), [fingerprint(t, size) for t in part.column(1).to_pylist()])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes and links a-b: the smallest node that each is connected to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(table: np.ndarray, probes: np.ndarray, most: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Links that join whatever is connected by fingerprints of one segment value at ``most`` differing bits.

    ``table`` holds the fingerprints with that value, ``probes`` those one bit away from it. Every pair that meets
    here is compared, but of a connected group only links to its first member come out.
    """
    table, probes = np.unique(table), np.unique(probes)
    every = np.concatenate((table, probes))
    if len(table) * len(every) <= PAIRWISE:
        distance = np.bitwise_count(table[:, None] ^ every[None, :])
        i, j = np.nonzero(distance <= most)
    else:
        i, j = _by_balls(table, probes, most)
    root = _roots(len(every), i, j)
    at = np.flatnonzero(root != np.arange(len(every)))
    return every[at], every[root[at]]


def _by_balls(table: np.ndarray, probes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The same pairs by looking up every fingerprint with up to ``most`` bits flipped in the sorted table."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    masks = [np.zeros(1, np.uint64), one]
    for _ in range(most - 1):
        masks.append(np.unique((masks[-1][:, None] | one[None, :]).ravel()))
    every = np.concatenate((table, probes))
    fixed = np.bitwise_or.reduce(table ^ table[0]) | np.bitwise_or.reduce(every ^ table[0])
    left, right = [], []
    for mask in np.unique(np.concatenate(masks)):
        if mask & ~fixed:
            continue  # a bit in which no member differs
        wanted = every ^ mask
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        hit = np.flatnonzero(table[at] == wanted)
        left.append(at[hit])
        right.append(hit)
    return np.concatenate(left), np.concatenate(right)


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _match(most: int):
    """Read rows sorted by segment value and give the links of each group; only the open group is held."""

    def solve(seg, key, fp, probe) -> Iterator[pa.RecordBatch]:
        new = np.flatnonzero((seg[1:] != seg[:-1]) | (key[1:] != key[:-1])) + 1
        starts = np.concatenate(([0], new))
        sizes = np.diff(np.concatenate((starts, [len(seg)])))
        two = starts[sizes == 2]
        close = (np.bitwise_count(fp[two] ^ fp[two + 1]) <= most) & ~(probe[two] & probe[two + 1]) & (fp[two] != fp[two + 1])
        a, b = [fp[two][close]], [fp[two + 1][close]]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            p = probe[s:s + n]
            if not p.all():
                x, y = linked(fp[s:s + n][~p], fp[s:s + n][p], most)
                a.append(x)
                b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield batch_of(EDGES, a.view(np.int64), b.view(np.int64))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            seg, key, fp, probe = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            fp = fp.view(np.uint64)
            last = np.flatnonzero((seg != seg[-1]) | (key != key[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            now = [seg, key, fp, probe]
            if held and (cut or held[-1][0][-1] != seg[-1] or held[-1][1][-1] != key[-1]):
                yield from solve(*(np.concatenate(x) for x in zip(*held, [c[:cut] for c in now])))
                held = []
            elif cut:
                yield from solve(*(c[:cut] for c in now))
            held.append([c[cut:] for c in now])
        if held:
            yield from solve(*(np.concatenate(x) for x in zip(*held)))

    return run


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints that differ in one or two bits, enough of them to connect every group.

    Of two differing bits in two 32-bit halves, either the low half is equal or the high half differs in one bit at
    most. So the low half is looked up as it is, and the high half in its ball of radius one; of the two ways to
    see one differing bit only the one that sets it is enumerated.
    """
    fp = F.col("fp")
    high, low = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    entry = lambda seg, key, probe: F.struct(F.lit(seg).cast("tinyint").alias("seg"), key.alias("key"), F.lit(probe).alias("probe"))
    bits = F.array(*[F.lit(1 << b).cast("long") for b in range(32)])
    ball = F.transform(F.filter(bits, lambda m: high.bitwiseAND(m) == 0), lambda m: entry(1, high.bitwiseOR(m), True))
    rows = prints.select("fp", F.explode(F.concat(F.array(entry(2, low, False), entry(1, high, False)), ball)).alias("e"))
    dealt = rows.select("e.seg", "e.key", "fp", "e.probe").repartition("seg", "key").sortWithinPartitions("seg", "key")
    return dealt.mapInArrow(_match(2), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each document.

    Texts are lower-cased in A-Z, cut into words at ASCII white space and hashed by shingles of ``size`` words. Two
    fingerprints link at two or fewer differing bits; ``component_id`` is the smallest doc_id reachable over links.
    Null and wordless texts have fingerprint zero and link like any other; rows that repeat come out each; a null id is
    never the smallest (a component of null ids alone has a null id); other columns are ignored; an empty table
    gives an empty result. Copies are one fingerprint in the index, and of a group only connecting links come out.
    """
    prints = materialize(fingerprints(docs, size))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(distinct))
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
