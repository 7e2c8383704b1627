"""Near-duplicate documents: SimHash fingerprints first, then the exact Jaccard similarity of word shingles for whatever they leave."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..scale import materialize
from .blocks import blocks_of_rows, mixed, text_bytes, widened, word_hashes
from .graph import components
from .lines import _is_marked, _marked, compared_pairs, matched_lines
from .simhash import links

TEXT_BLOCK = 1 << 20
# The place of documents without an id, behind all others.
LAST = (1 << 63) - 1
_WORDLESS = np.uint64(1)


def _shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles of all texts as 64-bit numbers, where those of each text begin, words of each text); a wordless text is one shingle of its own kind."""
    data, bounds = text_bytes(texts)
    start, word = word_hashes(data, bounds)
    upto = np.searchsorted(start, bounds)
    upto[-1] = len(start)
    n = np.diff(upto)
    row = np.repeat(np.arange(len(texts)), n)
    # the place of a word in its text says whether a shingle begins there; a shorter text is one shingle
    at = np.flatnonzero(np.arange(len(row)) - upto[row] <= np.maximum(n - size, 0)[row])
    value, of = np.zeros(len(at), dtype=np.uint64), row[at]
    for k in range(size):
        inside = at + k < upto[of + 1]
        value = np.where(inside, mixed(value ^ word[np.minimum(at + k, len(row) - 1)]), value)
    count = np.bincount(of, minlength=len(texts))
    first = np.cumsum(count) - count
    empty = np.flatnonzero(count == 0)
    value = np.insert(value, first[empty], _WORDLESS)
    count = np.maximum(count, 1)
    return value, np.cumsum(count) - count, n


def _marks(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's shingles in their order."""
    place = np.arange(len(value)) - np.repeat(first, np.diff(np.append(first, len(value))))
    return np.add.reduceat(mixed(value ^ mixed(place)), first).view(np.int64)


def _fingerprints(value: np.ndarray, first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A bit is 1 if it is set in over half of a text's shingles; a wordless text has fingerprint zero."""
    bits = np.unpackbits(value.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    count = np.diff(np.append(first, len(value)))
    more = 2 * np.add.reduceat(bits, first, axis=0, dtype=np.int32) > count[:, None]
    return np.where(words > 0, np.packbits(more, axis=1).view(">u8").ravel().astype(np.uint64), np.uint64(0)).view(np.int64)


def _place() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def repeated_places(docs: DataFrame):
    """A bit table, sent to the tasks, that marks the places that several rows have: ids that repeat, and ``LAST``."""
    several = docs.groupBy(_place().alias("doc")).count().where("count > 1")
    return _marked(several.select("doc", F.lit(0).cast("long").alias("line")))


def _own(table: np.ndarray, place: pa.Array, marks: np.ndarray) -> np.ndarray:
    """What tells rows of one place apart: the hash of their shingles, or 0 where the place alone does."""
    doc = place.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.where(_is_marked(table, doc, np.zeros(len(doc), np.int64)), marks, 0)


def shingled(docs: DataFrame, size: int = 5, repeated=None) -> DataFrame:
    """(doc_id, own, fp, text): of each document what tells it from others of its id, the fingerprint of its shingles and their bytes as numbers.

    A document without an id has ``LAST`` as its id.
    """
    repeated = repeated_places(docs) if repeated is None else repeated

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks_of_rows(batches, limit=TEXT_BLOCK):
            if not len(texts):
                continue
            value, first, words = _shingles(texts, size)
            ends = pa.py_buffer((8 * np.append(first, len(value))).astype(np.int32))
            held = pa.Array.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(value.astype("<u8"))])
            own = _own(repeated.value, rows.column(0), _marks(value, first))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(own), pa.array(_fingerprints(value, first, words)), held],
                                             names=["doc_id", "own", "fp", "text"])

    return docs.select(_place().alias("doc_id"), "text").mapInArrow(run, "doc_id long, own long, fp long, text binary")


def marked(docs: DataFrame, size: int, repeated) -> DataFrame:
    """The documents, all columns, with the hash of their shingles as ``_mark`` and what ``shingled`` calls them as ``_place`` and ``_own``."""
    docs = docs.withColumn("_place", _place())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks_of_rows(batches, limit=TEXT_BLOCK):
            if len(texts):
                mark = _marks(*_shingles(texts, size)[:2])
                own = _own(repeated.value, rows.column(rows.num_columns - 1), mark)
                yield rows.append_column("_mark", pa.array(mark)).append_column("_own", pa.array(own))

    return docs.mapInArrow(run, widened(docs.schema, "_mark long, _own long"))


def linked_by_fingerprint(sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(doc, line) of the documents of ``shingled`` that SimHash links to an earlier one and whose shingles are indeed that similar.

    Fingerprints link at two or fewer differing bits, found by the multi-index of ``simhash``. Each document is compared, exactly,
    with the first one of its fingerprint and the first one of its group of linked fingerprints.
    """
    prints = sets.select(F.struct(F.col("doc_id").alias("doc"), F.col("own").alias("line")).alias("this"), "fp")
    distinct = materialize(prints.groupBy("fp").agg(F.min("this").alias("least")))
    rooted = distinct.join(components(links(distinct)), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("least").alias("first"))
    near = prints.join(rooted.join(first, "root").select("fp", "least", "first"), "fp")
    near = near.select("this", F.explode(F.array_distinct(F.array("least", "first"))).alias("to")).where("to < this")
    pairs = near.select("this.*", F.col("to.doc").alias("to_doc"), F.col("to.line").alias("to_line"), F.lit(False).alias("more")).distinct()
    return compared_pairs(sets, materialize(pairs), similarity)[0].where("matched").select("doc", "line")


def without_near_duplicates(docs: DataFrame, size: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """The documents that no earlier one is similar to, each once.

    Two documents are similar if the sets of their shingles of ``size`` words (white space and case in A-Z aside) have
    at least this Jaccard similarity. Earlier is a smaller doc_id, those without an id last, and of rows with one id or none a
    smaller hash of the shingles. So no two that stay are similar, and each that goes has an earlier one like it. A text of fewer
    words is one shingle; null and wordless texts are all alike.

    SimHash fingerprints of the shingles propose near duplicates, which are checked exactly. Pairs at this similarity often differ in
    more bits than an index can look up, so the documents that are left go through ``lines.matched_lines``, each as one line of
    shingles: an exact join whose lists of common shingles and groups of copies never make all their pairs.
    """
    repeated = repeated_places(docs)
    sets = materialize(shingled(docs, size, repeated))
    gone = matched_lines(sets, similarity, materialize(linked_by_fingerprint(sets, similarity)))
    gone = materialize(gone.select(F.col("doc").alias("_place"), F.col("line").alias("_own")))
    left = marked(docs, size, repeated).join(gone, ["_place", "_own"], "left_anti")
    # of rows alike in id and shingles the least row stays, whatever the order in which they arrive
    columns = ["text", *[c for c in docs.columns if c != "text"]]
    return left.groupBy("doc_id", "_mark").agg(F.min(F.struct(*columns)).alias("row")).select("row.*").select(*docs.columns)
