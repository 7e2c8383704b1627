"""Ranked lexical search: the best position algorithm over impact lists, in blocks of documents."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..scale import materialize, top_n
from .blocks import batch_of, blocks, tally, text_bytes

# Distinct terms that are looked up in one pass over the documents; items with more go in several passes.
MAX_TERMS = 32_000
# Cells (term x document) of a block's table of positions.
BLOCK_CELLS = 16 << 20
TEXT_BLOCK = 2 << 20
FIRST_DEPTH = 8


# -- terms ---------------------------------------------------------------------------------------------------------------


def _byte_table() -> np.ndarray:
    """Bytes of terms as they are, A-Z in lower case, all others as spaces."""
    table = np.arange(256, dtype=np.uint8)
    for first, last in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        table[first:last + 1] = 0x20
    table[ord("A"):ord("Z") + 1] += 0x20
    return table


_BYTES = _byte_table()


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The terms of each text: (row of each term, code of each term, the distinct terms).

    A term is a maximal run of ASCII digits and letters, A-Z in lower case, and of everything beyond ASCII.
    """
    data, bounds = text_bytes(texts)
    plain = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(_BYTES[data].tobytes())])
    lists = pc.ascii_split_whitespace(plain)
    flat = lists.flatten()
    row = np.repeat(np.arange(len(texts), dtype=np.int64), lists.value_lengths().to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(flat), 0)
    if len(flat) and pc.min(full).as_py() is False:
        flat, row = flat.filter(full), row[full.to_numpy(zero_copy_only=False)]
    coded = flat.dictionary_encode()
    return row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def item_terms(items: DataFrame) -> list[tuple[int, list[str]]]:
    """(item_id, its distinct terms) in the order of ids. Items are the stated queries: a table that the driver can hold."""
    out: dict[int, set[str]] = {}
    got = items.where(F.col("item_id").isNotNull()).select("item_id", F.coalesce("text", F.lit("")).alias("text")).toArrow()
    texts = pa.concat_arrays(got["text"].chunks) if got.num_rows else pa.array([], pa.string())
    row, code, distinct = terms(texts.cast(pa.string()))
    spelled = distinct.to_pylist()
    ids = got["item_id"].to_pylist()
    for i in ids:
        out.setdefault(i, set())
    for r, c in zip(row.tolist(), code.tolist()):
        out[ids[r]].add(spelled[c])
    return [(i, sorted(t)) for i, t in sorted(out.items())]


def passes(items: list[tuple[int, list[str]]], most: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Items in runs whose distinct terms are no more than ``most`` together, one item at least."""
    run: list[tuple[int, list[str]]] = []
    held: set[str] = set()
    for item, its in items:
        if run and len(held | set(its)) > most:
            yield run
            run, held = [], set()
        run.append((item, its))
        held |= set(its)
    if run:
        yield run


POSTINGS_DDL = "doc_id long, n long, term array<int>, tf array<long>"


def _forward(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, term, tf): the number of terms of each document, and which of the vocabulary it holds how often."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.string())
        for part in blocks(batches, limit=TEXT_BLOCK):
            m = part.num_rows
            row, code, distinct = terms(part.column(1))
            place = pc.fill_null(pc.index_in(distinct, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            n = tally(row, m)
            term = place[code] if len(code) else code
            hit = term >= 0
            key, tf = np.unique(row[hit] * max(1, len(known)) + term[hit], return_counts=True)
            owner, term = key // max(1, len(known)), key % max(1, len(known))
            bounds = pa.array(np.concatenate(([0], np.cumsum(tally(owner, m)))).astype(np.int32))
            yield batch_of(schema, part.column(0), n, pa.ListArray.from_arrays(bounds, pa.array(term.astype(np.int32))),
                           pa.ListArray.from_arrays(bounds, pa.array(tf.astype(np.int64))))
            del row, code, distinct, term, hit
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, POSTINGS_DDL)


def _document_frequencies(postings: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term; a task counts its own first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "df"])

    got = postings.select("term").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size, dtype=np.int64)
    out[got["term"].to_numpy()] = got["df"].to_numpy()
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# -- the best position algorithm over one block of documents --------------------------------------------------------------


class ImpactLists:
    """The documents of a block with, for each term, its documents from the greatest impact down (ties: as they stand).

    ``position[term, doc]`` is a document's place in a term's list (-1: not there), by which direct accesses are made.
    """

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, size: int):
        order = np.lexsort((doc, -impact, term))
        self.ids, self.doc, self.impact = ids, doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(size + 1))
        self.position = np.full((size, len(ids)), -1, dtype=np.int32)
        of = term[order]
        self.position[of, self.doc] = np.arange(len(of)) - self.start[of]

    def search(self, query: np.ndarray, best: np.ndarray, best_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best of this block and of those found before it (``best``, ``best_ids``).

        Lists are read side by side in growing steps. A document met for the first time is looked up in the other lists, which
        gives its score and marks its position in each of them as seen. The best position of a list is the last one up to which
        all are seen, read or looked up; the impacts there bound every document that is not seen yet. The search ends when this bound
        is strictly below the kth score (equal scores may still have a smaller id).
        """
        lists = query[self.start[query + 1] > self.start[query]]
        m = len(lists)
        if not m:
            return best, best_ids
        start, length = self.start[lists], self.start[lists + 1] - self.start[lists]
        base = np.cumsum(length) - length                 # lists one after another
        owner = np.repeat(np.arange(m), length)
        place = np.arange(len(owner)) - base[owner]
        marked = np.zeros(int(length.sum()) + 1, dtype=bool)  # positions seen; the last cell takes those that are not there
        met = np.zeros(len(self.ids), dtype=bool)
        best_at = np.zeros(m, dtype=np.int64)             # how many positions from the top of each list are seen without a gap
        kth = best[k - 1] if len(best) >= k else 0
        depth, to = 0, FIRST_DEPTH
        while True:
            # sorted access to the positions from depth to to
            span = np.flatnonzero((place >= depth) & (place < to)) if m * (to - depth) > len(owner) else np.concatenate(
                [np.arange(base[j] + depth, base[j] + min(to, length[j])) for j in range(m) if depth < length[j]] or [np.zeros(0, np.int64)])
            fresh = self.doc[start[owner[span]] + place[span]]
            fresh = np.unique(fresh[~met[fresh]])
            met[fresh] = True
            if len(fresh):
                # direct access: score and positions of new documents in all lists
                at = self.position[lists[:, None], fresh[None, :]]
                there = at >= 0
                score = np.where(there, self.impact[np.minimum(start[:, None] + at, len(self.impact) - 1)], 0).sum(axis=0)
                marked[np.where(there, base[:, None] + at, len(marked) - 1)] = True
                good = (score >= max(kth, 1)) if len(best) >= k else score > 0
                if good.any():
                    best, best_ids = merged(np.concatenate((best, score[good])), np.concatenate((best_ids, self.ids[fresh[good]])), k)
                    kth = best[k - 1] if len(best) >= k else 0
            # best positions: on from the last one as long as positions are seen
            for j in np.flatnonzero(best_at < length):
                rest = marked[base[j] + best_at[j]:base[j] + length[j]]
                gap = int(np.argmin(rest))
                best_at[j] += len(rest) if rest[gap] else gap
            open_ = best_at < length
            if not open_.any():
                return best, best_ids
            # below the best position impacts are no greater than at it; before any is seen, than at the top
            bound = int(self.impact[start[open_] + np.maximum(best_at[open_] - 1, 0)].sum())
            if len(best) >= k and bound < kth:
                return best, best_ids
            depth, to = to, to * 2


def merged(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, equal ones by ascending id."""
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


FOUND = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _block_searches(items: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """In each task: documents are gathered into blocks of a fixed number, and every item is searched in each block.

    What an item has found so far in the task is the bar for the blocks that follow.
    """
    size = len(weights)
    width = int(min(1 << 15, max(64, BLOCK_CELLS // max(1, size))))

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        held, count = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, width - count)
                held.append(part)
                at, count = at + part.num_rows, count + part.num_rows
                if count == width:
                    yield held
                    held, count = [], 0
        if held:
            yield held

    def lists_of(held: list[pa.RecordBatch]) -> ImpactLists:
        ids, n = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in held]).astype(np.int64) for c in (0, 1))
        term, tf = (np.concatenate([p.column(c).flatten().to_numpy(zero_copy_only=False) for p in held]).astype(np.int64) for c in (2, 3))
        own = np.concatenate([p.column(2).value_lengths().to_numpy(zero_copy_only=False) for p in held]).astype(np.int64)
        # the integer arithmetic of the score; 90 * n * N may need more than 64 bits for giant texts
        if int(n.max(initial=0)) * 90 * n_docs < 1 << 63:
            m = 10 + 90 * n * n_docs // max(1, n_terms)
        else:
            m = np.array([10 + 90 * int(x) * n_docs // max(1, n_terms) for x in n], dtype=np.int64)
        doc = np.repeat(np.arange(len(ids)), own)
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        useful = impact > 0
        return ImpactLists(ids, doc[useful], term[useful], impact[useful], size)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {i: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for i, _ in items}
        for held in pieces(batches):
            lists = lists_of(held)
            for item, query in items:
                found[item] = lists.search(query, *found[item], k)
        for item, (score, ids) in found.items():
            if len(score):
                yield batch_of(FOUND, np.full(len(score), item), ids, score)

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` highest-scoring documents of each item, with a score above 0.

    Every row of ``docs`` is a document and counts in the statistics; null texts have no terms. Rows without a doc_id
    count but cannot be named and are not ranked; rows that repeat an id are ranked each. Items without an id are not asked; rows
    that repeat an item_id are one item with the terms of all of them. Items without a term that any document has, and empty tables, give no rows. Other
    columns are ignored.

    Texts are read once for each run of items with up to ``MAX_TERMS`` distinct terms; what is written of them is which of
    these terms a document holds. Blocks of documents are searched by themselves, k rows an item come out of a task, and the k best of
    them are found by a salted window.
    """
    asked = item_terms(items)
    spark = docs.sparkSession
    out = None
    for run in passes([(i, t) for i, t in asked if t], MAX_TERMS):
        vocabulary = sorted({t for _, its in run for t in its})
        code = {t: c for c, t in enumerate(vocabulary)}
        postings = materialize(_forward(docs, vocabulary))
        n_docs, n_terms = postings.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequency = _document_frequencies(postings, len(vocabulary))
        weights = np.array([weight(n_docs, int(df)) for df in frequency], dtype=np.int64)
        coded = [(i, np.array([code[t] for t in its], dtype=np.int64)) for i, its in run]
        sent = _block_searches(coded, weights, n_docs, n_terms, k)
        named = postings.where(F.col("doc_id").isNotNull() & (F.size("term") > 0)).select("doc_id", "n", "term", "tf")
        found = named.mapInArrow(sent, "item_id long, doc_id long, score long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = top_n(materialize(out), ["item_id"], [F.desc("score"), F.asc("doc_id")], k, k, spread=("doc_id",))
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
