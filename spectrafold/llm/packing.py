"""Packing of token streams into training sequences, with every window filled in the proportions of its sources."""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

import uuid

from ..scale import shared_dir
from .blocks import batch_of, blocks

_EXOTIC = re.compile("[^\x00-ɏ]")
BROADCAST_ROWS = 500_000


class Encoder:
    """Token ids of texts as the ``tokenizers`` library gives them for a tokenizer file.

    With the same vocabulary as a rank file and its pattern, texts of Latin letters go through ``tiktoken``, which gives the same
    ids several times faster. Where its pattern gives up (white space by the million), the text goes through ``tokenizers``.
    """

    def __init__(self, tokenizer_json: bytes, ranks: bytes | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(tokenizer_json.decode("utf-8"))
        self.fast = None
        if ranks:
            import tiktoken

            special = {t["content"]: t["id"] for t in json.loads(tokenizer_json)["added_tokens"]}
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=special)

    def ids(self, text: str) -> list[int]:
        if self.fast and not _EXOTIC.search(text):
            try:
                return self.fast.encode(text, allowed_special="all")
            except ValueError:  # the stack of its pattern's backtracking is full
                pass
        return self.slow.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=1)
def _encoder(*files) -> Encoder:
    return Encoder(*files)


TOKENS = pa.schema([
    ("part", pa.int32()), ("doc_id", pa.int64()), ("source", pa.string()), ("local_start", pa.int64()),
    ("doc_tokens", pa.int64()), ("ids", pa.binary()),
])


def tokenized(docs: DataFrame, tokenizer_file: str, ranks_file: str | None = None, pattern: str | None = None,
              end_id: int = 0) -> DataFrame:
    """Each document's ids with ``end_id`` behind them, and where they begin in the stream of its source and task."""
    read = lambda name: open(name, "rb").read() if name else None
    sent = docs.sparkSession.sparkContext.broadcast((read(tokenizer_file), read(ranks_file), pattern))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(*sent.value), TaskContext.get().partitionId()
        upto: dict[str, int] = {}
        for block in blocks(batches):
            starts, sizes, ids = [], [], []
            sources = block.column(2).to_pylist()
            for text, source in zip(block.column(1).to_pylist(), sources):
                own = encoder.ids(text)
                own.append(end_id)
                ids.append(np.array(own, dtype="<u4").tobytes())
                sizes.append(len(own))
                starts.append(upto.get(source, 0))
                upto[source] = starts[-1] + len(own)
            yield batch_of(TOKENS, [part] * len(ids), block.column(0), sources, starts, sizes, ids)

    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    return docs.select("doc_id", "text", source.alias("source")).mapInArrow(
        run, "part int, doc_id long, source string, local_start long, doc_tokens long, ids binary")


class Mixture:
    """How many tokens of each source stand before each window: deficit round-robin in closed form.

    In a phase every source that still has tokens earns ``window`` times its share for each window; what it has earned
    is floor(k * window * weight / weights) after k windows of the phase, so the part of a token that a window cannot
    give is carried to the next, wherever that one is built. A phase ends when a source runs out; the others then
    share its part. Without weights the shares are those of the corpus and all sources end together.
    """

    def __init__(self, totals: dict[str, int], window: int, weights: dict[str, int] | None = None):
        self.sources = sorted(s for s, n in totals.items() if n)
        self.rank = {s: i for i, s in enumerate(self.sources)}
        self.totals = [totals[s] for s in self.sources]
        weight = [max(1, int((weights or {}).get(s, 1))) if weights else totals[s] for s in self.sources]
        left, done = list(self.totals), [0] * len(self.totals)
        self.phases = []  # (first window, tokens of each source before it, weights, their sum, windows)
        first = 0
        while any(left):
            active = [w if n else 0 for w, n in zip(weight, left)]
            whole = sum(active)
            count = max(1, min(-(-n * whole // (window * w)) for n, w in zip(left, active) if n))
            self.phases.append((first, list(done), active, whole, count))
            for i, w in enumerate(active):
                take = min(left[i], count * window * w // whole)
                done[i] += take
                left[i] -= take
            first += count
        self.window, self.windows = window, first
        self._phase_starts = [p[0] for p in self.phases]
        self._done = [[p[1][i] for p in self.phases] for i in range(len(self.sources))]

    def before(self, window: int) -> list[int]:
        """Tokens of each source in all windows before this one."""
        if window >= self.windows:
            return self.totals
        first, done, active, whole, _ = self.phases[bisect_right(self._phase_starts, window) - 1]
        k = (window - first) * self.window
        return [min(t, d + k * w // whole) for t, d, w in zip(self.totals, done, active)]

    def window_of(self, source: int, at: int) -> int:
        """The window that takes token ``at`` of a source's stream."""
        starts = self._done[source]
        phase = bisect_right(starts, at) - 1
        first, done, active, whole, count = self.phases[phase]
        if not active[source]:  # phases that this source no longer takes part in begin where it ended
            return first
        gone = (at - done[source] + 1) * whole
        return first + min(count - 1, -(-gone // (self.window * active[source])) - 1)

    def layout(self, window: int) -> list[tuple[int, int, int]]:
        """For each source: (first token of its stream in the window, one past the last, place of the first in the output)."""
        a, b = self.before(window), self.before(window + 1)
        place, out = sum(a), []
        for x, y in zip(a, b):
            out.append((x, y, place))
            place += y - x
        return out


PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("source", pa.string()), ("ids", pa.binary()),
])
PIECES_DDL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
              "source string, ids binary")


def _cut(mixture: Mixture, sequence: int, with_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = lru_cache(maxsize=4096)(mixture.layout)
        for batch in batches:
            rows: list[tuple] = []
            for doc, source, at, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                s, begin = mixture.rank[source], at
                while begin < at + n:
                    lo, hi, place = layout(mixture.window_of(s, begin))[s]
                    end = min(hi, at + n)
                    while begin < end:
                        where = place + begin - lo
                        size = min(end - begin, sequence - where % sequence)
                        own = ids[4 * (begin - at):4 * (begin - at + size)]
                        rows.append((doc, begin - at, size, zlib.crc32(own), n, where // sequence, where % sequence, source,
                                     own if with_ids else None))
                        begin += size
            if rows:
                yield batch_of(PIECES, *zip(*rows))

    return run


def pack(docs: DataFrame, tokenizer_file: str, ranks_file: str | None = None, pattern: str | None = None,
         sequence: int = 1024, window: int = 65_536, weights: dict[str, int] | None = None, with_ids: bool = True) -> DataFrame:
    """All documents as pieces of sequences of ``sequence`` tokens, without a gap but behind the last one.

    Each source's documents are one stream. Every ``window`` output tokens take from each stream in proportion
    to ``weights`` (the sources' own sizes, if none are given), and every token of every document is packed once. A null
    text counts as empty and is one end token; null sources are one source of their own (with the empty name); repeated
    rows and null ids are packed as they come; other columns are ignored; an empty table gives no pieces.

    Tokens are written once to the shared folder. What is gathered are sums: one row for each source and task, and
    on the driver one row for each source of the mixture.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    made = tokenized(docs, tokenizer_file, ranks_file, pattern)
    made.write.option("compression", "zstd").parquet(path)
    tokens = spark.read.schema(made.schema).parquet(path)
    sums = tokens.groupBy("source", "part").agg(F.sum("doc_tokens").alias("n"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source", "part", "n", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    base_path = f"{path}-base"
    base.write.parquet(base_path)
    base = spark.read.schema(base.schema).parquet(base_path)
    totals = {r["source"]: r["n"] for r in base.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    mixture = Mixture(totals, window, weights)
    places = base.select("source", "part", "base")
    if places.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    placed = tokens.join(places, ["source", "part"]).select(
        "doc_id", "source", (F.col("base") + F.col("local_start")).alias("at"), "doc_tokens", "ids")
    return placed.mapInArrow(_cut(mixture, sequence, with_ids), PIECES_DDL)


def padded_length(length: int, sequence: int = 1024) -> int:
    """Sequences are padded to ``sequence`` tokens, except at a power of two."""
    return length if length & (length - 1) == 0 else sequence


def assemble(pieces: DataFrame, sequence: int = 1024, pad_id: int = 0) -> DataFrame:
    """(sequence_id, length, ids as little-endian 32-bit numbers, padded) of each sequence, from pieces with their ids."""
    full = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("h")))), lambda p: p.h), "")
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), full.alias("h"))
    power = F.col("length").bitwiseAND(F.col("length") - 1) == 0
    pad = F.when(power, 0).otherwise(sequence - F.col("length")).cast("int")
    return whole.select("sequence_id", "length", F.unhex(F.concat(
        "h", F.expr(f"repeat('{pad_id.to_bytes(4, 'little').hex()}', cast(case when (length & (length - 1)) = 0 then 0 else {sequence} - length end as int))")
    )).alias("ids"), (F.col("length") + pad).alias("padded_length"))
