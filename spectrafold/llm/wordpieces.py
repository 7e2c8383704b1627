"""Token counts by greedy longest match, in one walk along each word and without building the pieces."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import batch_of, blocks, tally, words

CACHE_WORDS = 300_000


class Automaton:
    """A trie of the vocabulary whose nodes know where to go on when the next character does not fit.

    ``fail[v]`` is the node that stands for what is left of v after the longest pieces at its front are taken off,
    ``popped[v]`` how many pieces those are; -1 marks nodes from which no piece can be taken. Pieces that begin a
    word start at node 0, the others at ``rest`` (node 0 too, if one vocabulary serves both).
    """

    def __init__(self, initial: Sequence[str], continuing: Sequence[str] | None = None):
        self.go: list[dict[str, int]] = [{}]
        ends: list[bool] = [False]
        self.rest = 0
        if continuing is not None:
            self.rest = 1
            self.go.append({})
            ends.append(False)
        for root, pieces in ((0, initial), (self.rest, continuing or ())):
            for piece in pieces:
                at = root
                for c in piece:
                    nxt = self.go[at].get(c)
                    if nxt is None:
                        nxt = len(self.go)
                        self.go.append({})
                        ends.append(False)
                        self.go[at][c] = nxt
                    at = nxt
                ends[at] = ends[at] or at not in (0, self.rest)
        self.fail, self.popped = [-1] * len(self.go), [0] * len(self.go)
        queue = deque({0, self.rest})
        while queue:
            u = queue.popleft()
            for c, v in self.go[u].items():
                queue.append(v)
                if ends[v]:
                    self.fail[v], self.popped[v] = self.rest, 1
                    continue
                count, z = self.popped[u], self.fail[u]
                while z != -1 and c not in self.go[z]:
                    count += self.popped[z]
                    z = self.fail[z]
                self.fail[v] = self.go[z][c] if z != -1 else -1
                self.popped[v] = count

    def count(self, word: str) -> int:
        """The number of pieces of a word, -1 if greedy longest match gets stuck. Time in proportion to the word."""
        go, fail, popped = self.go, self.fail, self.popped
        at = total = 0
        for c in word:
            nxt = go[at].get(c)
            while nxt is None:
                if fail[at] == -1:
                    return -1
                total += popped[at]
                at = fail[at]
                nxt = go[at].get(c)
            at = nxt
        while at != self.rest:
            if fail[at] == -1:
                return -1 if at else total
            total += popped[at]
            at = fail[at]
        return total


@lru_cache(maxsize=2)
def _automaton(initial: tuple[str, ...], continuing: tuple[str, ...] | None) -> Automaton:
    return Automaton(initial, continuing)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])
DDL = "doc_id long, n_words long, n_tokens long, n_unknown long"


def count_tokens(docs: DataFrame, vocabulary: Sequence[str], prefix: str | None = "##", mark: str = "") -> DataFrame:
    """Words, tokens and unknown words of each document.

    Words are runs without ASCII white space, with ``mark`` put before each. With a ``prefix``, pieces that bear it go on
    a word and the others begin one; without, every piece may stand anywhere. A word that greedy longest match
    cannot finish is one unknown token. Words have no greatest length. Null and empty texts have no words;
    repeated rows and null ids come out as they went in; other columns are ignored. One pass, no shuffle: distinct
    words of a block are counted once and remembered by the task up to a bound.
    """
    pieces = [p for p in dict.fromkeys(vocabulary) if p]
    if prefix:
        shape = (tuple(p for p in pieces if not p.startswith(prefix)),
                 tuple(p[len(prefix):] for p in pieces if p.startswith(prefix) and p != prefix))
    else:
        shape = (tuple(pieces), None)
    sent = docs.sparkSession.sparkContext.broadcast(shape)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = _automaton(*sent.value), {}
        for part in blocks(batches):
            row, code, distinct = words(part.column(1))
            sizes = np.empty(len(distinct), dtype=np.int64)
            for i, word in enumerate(distinct.to_pylist()):
                size = known.get(word)
                if size is None:
                    size = automaton.count(mark + word)
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known[word] = size
                sizes[i] = size
            each, n = sizes[code], part.num_rows
            yield batch_of(SCHEMA, part.column(0), tally(row, n), tally(row, n, np.abs(each)), tally(row[each < 0], n))

    return docs.select("doc_id", "text").mapInArrow(count, DDL)


def vocabulary_of(model_file: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model, which serve as a vocabulary with ``prefix=None, mark="▁"``."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
