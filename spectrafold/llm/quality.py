"""A quality classifier: gradient-boosted trees over statistics of a text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .blocks import batch_of, blocks, blocks_of_rows, counted, lengths, tally, text_bytes, words
from .rules import covered, line_table

FEATURES = [
    "log_chars", "log_words", "word_length", "upper", "digits", "symbols", "marks", "stops", "bars", "non_ascii",
    "spaces", "distinct_words", "same_as_last_word", "repeated_triples", "lines_per_word", "repeated_lines", "longest_word",
    "ends_marked",
]

ROW_BLOCK = 2 << 20  # bytes of text that are taken at a time where whole rows travel

_UPPER, _DIGIT, _SYMBOL, _MARK, _STOP, _BAR, _SPACE, _LETTER = 1, 2, 3, 4, 5, 6, 7, 8


def _classes() -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    for chars, kind in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), ("0123456789", _DIGIT), ("#*$%&<>^~@\\=+{}[]", _SYMBOL),
                        ("!?", _MARK), (".,;:", _STOP), ("|", _BAR), (" \t\n\r\v\f", _SPACE), ("abcdefghijklmnopqrstuvwxyz", _LETTER)):
        table[[ord(c) for c in chars]] = kind
    return table


_CLASS = _classes()


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics (FEATURES) for each text; all are zero for an empty one."""
    n = len(texts)
    data, bounds = text_bytes(texts)
    kind = _CLASS[data]
    chars = np.maximum(1, lengths(texts))
    of = lambda k: counted(kind == k, bounds)
    wide_upper = np.zeros(len(data), dtype=bool)  # capital letters of Latin-1, two bytes each
    if len(data) > 1:
        wide_upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    row, code, distinct = words(texts)
    size = lengths(distinct)[code] if len(code) else np.zeros(0, np.int64)
    n_words = tally(row, n)
    some = np.maximum(1, n_words)
    first = ~pd.Series(row * max(1, len(distinct)) + code).duplicated().to_numpy() if len(code) else np.zeros(0, bool)
    same = np.zeros(len(code), dtype=bool)
    if len(code) > 1:
        same[1:] = (row[1:] == row[:-1]) & (code[1:] == code[:-1])
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, row, size)
    ends = np.zeros(len(distinct), dtype=bool)
    if len(distinct):
        raw, at = text_bytes(distinct)
        ends = np.isin(_CLASS[raw[at[1:] - 1]], (_SYMBOL, _MARK, _BAR))
    l_row, l_code, l_distinct, wordy = line_table(texts)
    l_later = pd.Series(l_row * max(1, len(l_distinct)) + l_code).duplicated().to_numpy() & wordy[l_code]
    n_lines = tally(l_row, n)
    out = np.stack([
        np.log1p(chars), np.log1p(n_words), tally(row, n, size) / some, (of(_UPPER) + counted(wide_upper, bounds)) / chars,
        of(_DIGIT) / chars, of(_SYMBOL) / chars, of(_MARK) / chars, of(_STOP) / chars, of(_BAR) / chars,
        counted(data >= 0xC0, bounds) / chars, of(_SPACE) / chars, tally(row[first], n) / some, tally(row[same], n) / some,
        tally(row[covered(row, code, {3: "first"})[3]], n) / some, n_lines / some, tally(l_row[l_later], n) / np.maximum(1, n_lines),
        np.log1p(longest), tally(row[ends[code]], n) / some,
    ], axis=1)
    out[bounds[1:] == bounds[:-1]] = 0
    return out


@dataclass(frozen=True)
class Forest:
    """Boosted trees of one depth as flat arrays: split feature and value of the inner nodes, value of the leaves."""

    start: float
    feature: np.ndarray  # (trees, 2 ** depth - 1)
    value: np.ndarray    # the same; a row goes right if its feature is greater
    leaf: np.ndarray     # (trees, 2 ** depth)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row; all rows go down a tree together."""
        total, at_row = np.full(len(x), self.start), np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        for feature, value, leaf in zip(self.feature, self.value, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[at_row, feature[node]] > value[node])
            total += leaf[node - (len(leaf) - 1)]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64,
        penalty: float = 1.0, least: float = 1.0) -> Forest:
    """Newton boosting of the logistic loss on histograms of binned features.

    Level by level one ``bincount`` gives the gradient and curvature sums of every (node, feature, bin), and each node takes the
    split of the greatest gain. With one label or none, the forest is its prior (0.5 without rows).
    """
    y = np.asarray(y, dtype=np.float64)
    n, width = len(y), x.shape[1] if x.ndim == 2 else 0
    p = min(max(y.mean(), 1e-6), 1 - 1e-6) if n else 0.5
    start = float(np.log(p / (1 - p)))
    empty = (np.zeros((0, 2 ** depth - 1), np.int64), np.zeros((0, 2 ** depth - 1)), np.zeros((0, 2 ** depth)))
    if n < 2 or y.min() == y.max():
        return Forest(start, *empty)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(width) * bins
    margin = np.full(n, start)
    features, values, leaves = [], [], []
    for _ in range(trees):
        prob = 1.0 / (1.0 + np.exp(-margin))
        grad, curve = y - prob, prob * (1 - prob)
        feature, value, node = np.zeros(2 ** depth - 1, np.int64), np.full(2 ** depth - 1, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            key = ((node - first)[:, None] * (width * bins) + flat).ravel()
            shape = (count, width, bins)
            g = np.bincount(key, np.repeat(grad, width), minlength=count * width * bins).reshape(shape).cumsum(axis=2)
            h = np.bincount(key, np.repeat(curve, width), minlength=count * width * bins).reshape(shape).cumsum(axis=2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g ** 2 / (h + penalty) + (all_g - g) ** 2 / (all_h - h + penalty) - all_g ** 2 / (all_h + penalty)
            gain[(h < least) | (all_h - h < least)] = 0
            for f, e in enumerate(edges):
                gain[:, f, len(e):] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for i, b in enumerate(best):
                f, cut = divmod(int(b), bins)
                if gain[i, f, cut] > 1e-9:
                    feature[first + i], value[first + i] = f, edges[f][cut]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > value[node])
        at = node - (2 ** depth - 1)
        leaf = rate * np.bincount(at, grad, 2 ** depth) / (np.bincount(at, curve, 2 ** depth) + penalty)
        margin += leaf[at]
        features.append(feature)
        values.append(value)
        leaves.append(leaf)
    return Forest(start, np.stack(features), np.stack(values), np.stack(leaves))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 1 when divided by 3 (never for null ids)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Forest:
    """Fit on at most ``max_rows`` labelled documents that are not held out, taken in the order of a hash of their id.

    Labels that are null or that contradict each other for one id are left out. Statistics of the sample are computed by the
    tasks; the driver gets its numbers, ``max_rows`` short rows at most, and fits the trees.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).where("y = y2")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("doc_id", "y")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            rows = pa.array(list(statistics(part.column(1))), type=pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), rows], names=["doc_id", "y", "x"])

    rows = texts.mapInArrow(run, "doc_id long, y int, x array<double>")
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(max_rows).toArrow()
    x = np.array(got["x"].to_pylist(), dtype=np.float64).reshape(len(got), len(FEATURES))
    return fit(x, got["y"].to_numpy())


SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document from its whole text alone.

    Null texts count as empty; empty texts have a score too; repeated rows and null ids come out as they went in;
    other columns are ignored. One pass, no shuffle.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            yield batch_of(SCHEMA, part.column(0), forest.scores(statistics(part.column(1))))

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, forest: Forest) -> DataFrame:
    """The documents, all columns, that the classifier predicts to be of quality 1."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks_of_rows(batches, limit=ROW_BLOCK):
            yield rows.filter(pa.array(forest.scores(statistics(texts)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
