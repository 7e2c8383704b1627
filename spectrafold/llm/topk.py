"""Exact top-k search by inner product, with the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .blocks import batch_of

SCHEMA = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
DDL = "query_id long, query_key long, vec_id long, score long"
_EXACT = 1 << 53


class SortedLists:
    """One block of integer vectors with its dimensions sorted, and searches in it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, whole = ids[order], vectors[order]
        self.largest = int(np.abs(whole).max(initial=0))
        self.n, self.dims = whole.shape
        self.whole = whole
        self.vectors = whole.astype(np.float64)
        self.order = np.argsort(whole, axis=0, kind="stable").astype(np.int32).T.copy()  # by dimension, lowest first
        self.sorted = np.take_along_axis(whole, self.order.T, axis=0).T.copy()

    def scores(self, rows: np.ndarray | slice, query: np.ndarray, exact_floats: bool) -> np.ndarray:
        if exact_floats:
            return (self.vectors[rows] @ query.astype(np.float64)).astype(np.int64)
        return self.whole[rows] @ query

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, ties to the smaller id.

        Sorted access goes down all lists side by side, from their top where the query is positive and from their
        bottom where it is negative. What is new is scored in full. The values at the current depth bound every
        vector not yet seen; the search ends when that bound is below the kth score.
        """
        used = np.flatnonzero(query)
        exact_floats = self.largest * int(np.abs(query).max(initial=0)) * self.dims < _EXACT
        seen = np.zeros(self.n, dtype=bool)
        best_rows, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = self.ids == query_id
        up = query[used] > 0
        depth, step = 0, max(1, 2 * k // max(1, len(used)) + 1)
        while depth < self.n:
            to = min(self.n, depth + step)
            high, low = used[up], used[~up]
            fresh = np.zeros(self.n, dtype=bool)
            fresh[self.order[high, self.n - to:self.n - depth]] = True
            fresh[self.order[low, depth:to]] = True
            if not len(used):
                fresh[:] = True
                to = self.n
            fresh &= ~seen
            seen |= fresh
            rows = np.flatnonzero(fresh)
            if len(rows):
                got = self.scores(rows if len(rows) < self.n else slice(None), query, exact_floats)
                keep = ~own[rows]
                rows, got = np.concatenate((best_rows, rows[keep])), np.concatenate((best, got[keep]))
                if len(rows) > k:
                    order = np.lexsort((rows, -got))[:k]  # rows are in the order of ids
                    rows, got = rows[order], got[order]
                best_rows, best = rows, got
            if to == self.n:
                break
            if len(best) >= k:
                bound = int(query[high] @ self.sorted[high, self.n - to - 1]) + int(query[low] @ self.sorted[low, to])
                if bound < best.min():
                    break
            depth, step = to, step * 4
        return self.ids[best_rows], best


def _search(k: int):
    """Rows come sorted by block, vectors before queries: the vectors of one block are held, queries pass by."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, vectors, lists = None, [], [], {}

        def ready():
            nonlocal lists, ids, vectors
            if ids:
                flat = sorted(set(map(len, vectors)))
                size = np.array([len(v) for v in vectors])
                all_ids = np.array(ids, dtype=np.int64)
                lists = {d: SortedLists(all_ids[size == d], np.stack([v for v in vectors if len(v) == d])) for d in flat}
                ids, vectors = [], []
            return lists

        for batch in batches:
            out: list[list] = [[], [], [], []]
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            values = batch.column(4)
            flat = values.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))
            for i, (b, is_query, vec_id, key) in enumerate(zip(*columns)):
                vector = flat[(ends[i - 1] if i else 0):ends[i]]
                if b != block:
                    block, ids, vectors, lists = b, [], [], {}
                if not is_query:
                    ids.append(vec_id)
                    vectors.append(vector)
                    continue
                own = ready().get(len(vector))
                if own is None:
                    continue
                found, scores = own.top(vec_id, vector, k)
                for column, value in zip(out, ([vec_id] * len(found), [key] * len(found), found.tolist(), scores.tolist())):
                    column.extend(value)
            if out[0]:
                yield batch_of(SCHEMA, *out)

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, block_rows: int = 8192,
           vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other vectors by integer inner product, ties to the smaller id.

    Components become floor(scale * x), x as double. Vectors that are null, empty or hold null or non-finite components,
    and rows with a null id, take no part; vectors of another length do not compare. A query's own id is never among
    its results; rows that repeat an id and vector ask once, but count each as results; a query id with several
    different vectors is ranked for each. Other columns are ignored; an empty table gives no rows.

    Vectors are dealt into blocks of about ``block_rows``; the queries, a share of the table stated by ``is_query``,
    visit every block, stream past its sorted lists and take away k rows. The ranks of a query are merged by a
    window that Spark cuts to k rows before its shuffle.
    """
    x = F.col(embedding)
    plain = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), is_query.alias("asked"),
        F.transform(x, lambda v: v.cast("double")).alias("v"))
    fit = (F.size("v") > 0) & F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = plain.where(F.col("vec_id").isNotNull() & F.coalesce(fit, F.lit(False))).select(
        "vec_id", F.coalesce("asked", F.lit(False)).alias("asked"),
        F.transform("v", lambda v: F.floor(v * F.lit(float(scale))).cast("long")).alias("v"))
    blocks = max(1, -(-whole.count() // block_rows))
    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    held = whole.select(block.alias("block"), F.lit(False).alias("is_query"), "vec_id", F.lit(0).cast("long").alias("key"), "v")
    asked = whole.where("asked").select("vec_id", "v").distinct().select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("is_query"),
        "vec_id", F.xxhash64("v").alias("key"), "v")
    dealt = held.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "is_query")
    found = dealt.mapInArrow(_search(k), DDL)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
