"""Quality rules of a text: counts, and how much of it repeats itself."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .blocks import batch_of, blocks, lengths, mixed, tally, words

# Limits for the share of characters inside repeats of earlier n-grams and lines. They are above the limits usually
# published (0.10 to 0.20), because a shared line that stands twice in a short clean text already reaches those.
GRAM_LIMITS = {5: 0.30, 6: 0.30, 7: 0.28, 8: 0.28, 9: 0.25, 10: 0.25}
LINE_LIMIT = 0.30

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
    ("dup_line_chars", pa.int64()), ("line_chars", pa.int64()), ("dup_gram_chars", pa.list_(pa.int64())),
])
DDL = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, line_chars long, dup_gram_chars array<long>"
)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def covered(row: np.ndarray, code: np.ndarray, sizes: dict[int, str | bool]) -> dict[int, np.ndarray]:
    """For each n-gram length: which words lie in an n-gram that its own text holds twice or more.

    ``sizes`` says for each length whether the first such n-gram counts as well (False) or only the repeats of it
    ("first"). One hash rolls along the words and grows by a word for each longer length.
    """
    n_words, out = len(code), {}
    value, salt = mixed(code), mixed(row + 1)
    grown, size = value.copy(), 1
    for size_wanted in sorted(sizes):
        while size < size_wanted and len(grown) > 1:
            grown = grown[:-1] * _BASE + value[size:]
            size += 1
        mark = np.zeros(n_words, dtype=bool)
        if size == size_wanted and len(grown):
            inside = row[:len(grown)] == row[size - 1:]
            key = mixed(grown ^ salt[:len(grown)])
            twice = np.zeros(len(grown), dtype=bool)
            twice[inside] = pd.Series(key[inside]).duplicated(keep=sizes[size_wanted]).to_numpy()
            step = np.zeros(n_words + 1, dtype=np.int64)
            step[:len(grown)] += twice
            step[size:size + len(grown)] -= twice
            mark = np.cumsum(step[:-1]) > 0
        out[size_wanted] = mark
    return out


def line_table(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(row of each line, its code, the distinct lines, which of those hold a word)."""
    lists = pc.split_pattern(texts, "\n")
    row = np.repeat(np.arange(len(texts), dtype=np.int64), lists.value_lengths().to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    wordy = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False).astype(bool)
    return row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, wordy


def measure(texts: pa.Array, gram_sizes: list[int]) -> dict[str, np.ndarray]:
    """Counts of each text. ``grams`` has a row for each text and a column for each n-gram length."""
    n = len(texts)
    row, code, distinct = words(texts)
    size = lengths(distinct)[code] if len(code) else np.zeros(0, np.int64)
    cover = covered(row, code, {g: "first" for g in gram_sizes} | {3: False})
    l_row, l_code, l_distinct, wordy = line_table(texts)
    l_has, l_size = wordy[l_code], lengths(l_distinct)[l_code]
    key = pd.Series(l_row * max(1, len(l_distinct)) + l_code)
    later = key.duplicated(keep="first").to_numpy() & l_has
    return {
        "n_words": tally(row, n), "word_chars": tally(row, n, size),
        "n_symbols": pc.count_substring_regex(texts, r"[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64),
        "n_dup_lines": tally(l_row[later], n), "n_repeat_words": tally(row[cover[3]], n),
        "dup_line_chars": tally(l_row[later], n, l_size[later]), "line_chars": tally(l_row, n, l_size),
        "grams": np.stack([tally(row[cover[g]], n, size[cover[g]]) for g in gram_sizes], axis=1)
        if gram_sizes else np.zeros((n, 0), np.int64),
    }


def apply_rules(docs: DataFrame, gram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT,
                min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """One row for each document with its counts and the verdict ``kept``.

    A document fails the base rules with fewer than ``min_words`` words, or with more than ``repeat_percent``
    per cent of its words inside repeated three-word windows. It fails the method's rules when the share of its
    word characters inside repeats of earlier n-grams, or of its line characters inside repeats of earlier lines,
    is above the limit of that length (lengths other than three). Each row is judged by itself, in one pass without a shuffle; null and empty texts have
    no words and so fail; repeated rows and null ids come out as they went in; other columns are ignored.
    """
    limits = dict(sorted((GRAM_LIMITS if gram_limits is None else gram_limits).items()))

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            m = measure(part.column(1), list(limits))
            failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > repeat_percent * m["n_words"])
            over = m["dup_line_chars"] > line_limit * m["line_chars"]
            for i, limit in enumerate(limits.values()):
                over |= m["grams"][:, i] > limit * m["word_chars"]
            yield batch_of(SCHEMA, part.column(0), m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"],
                           m["n_repeat_words"], failed, ~(failed | over), m["dup_line_chars"], m["line_chars"],
                           pa.array(list(m["grams"]), type=pa.list_(pa.int64())))

    return docs.select("doc_id", "text").mapInArrow(judge, DDL)
