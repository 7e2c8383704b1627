"""SentencePiece encoding and decoding of whole texts with a trained model file."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .blocks import batch_of, blocks, counted, ranges, widened

MARK = "▁"
CACHE_WORDS, CACHE_PAIRS = 150_000, 200_000
DECODE_IDS = 1 << 20
_SEGMENTS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Pieces:
    """Pieces of a model, and the best segmentation of sorted words by one walk through their common prefixes.

    Words in sorted order are a depth-first walk of their trie: going to the next word keeps the state of the shared
    prefix and goes on from there. For a unigram model the state of a prefix is its best score (forward Viterbi). For
    a merge model (BPE) scores do not add up to the trained segmentation; there the state is the one piece that can be
    last in it, found by asking which piece may follow the last piece of an earlier prefix.
    """

    def __init__(self, model_proto: bytes, kind: str = "auto"):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto)
        m, n = self.model, self.model.get_piece_size()
        self.text = [m.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.id = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: m.get_score(i) for i in plain}
        self.unknown = m.unk_id()
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = all(m.is_byte(i) for i in self.bytes)
        self.longest = max(map(len, self.id), default=1)
        if kind == "auto":
            ranks = [s for s in self.score.values() if s != 0]
            kind = "bpe" if ranks and all(s == int(s) for s in ranks) else "unigram"
        self.merges = kind == "bpe"
        self.crossing = any(MARK in p.lstrip(MARK) for p in self.id)
        self.ends = self._free_ends()
        self.tails = {p[i:] for p in self.id for i in range(len(p))}
        self.follows: dict[tuple[str, str], bool] = {}
        self.low = min(self.score.values(), default=0.0) - 10.0

    def _free_ends(self) -> dict[str, set[str]]:
        """Marks of punctuation, each with the letters and digits behind which some piece holds it."""
        bonds = {(a, b) for p in self.id for a, b in zip(p, p[1:])}
        self.free_lines = not any("\n" in pair for pair in bonds)
        return {mark: {a for a, b in bonds if b == mark} for mark in ".,;:!?|*#$%&"}

    def cut(self, word: str) -> tuple[str, ...] | list[str]:
        """Parts of a word that can be segmented by themselves, as no piece reaches from one into the next: lines, and a last
        mark of punctuation behind a letter or digit."""
        if "\n" in word and self.free_lines:
            out: list[str] = []
            for i, line in enumerate(word.split("\n")):
                out += ["\n"] * (i > 0)
                out += self.cut(line) if line else ()
            return out
        if len(word) > 1 and word[-1] in self.ends and word[-2].isalnum() and word[-2] not in self.ends[word[-1]]:
            return word[:-1], word[-1]
        return (word,)

    # -- merge models ---------------------------------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """Merge neighbours, the best-ranked pair first and the left one of equals, until nothing merges."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: str, right: str) -> bool:
        """Whether the two pieces stand side by side in the segmentation of what they spell together."""
        if len(self.follows) >= CACHE_PAIRS:
            self.follows.clear()
        good = self.follows[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return good

    # -- both -----------------------------------------------------------------------------------------------------

    def segment(self, ordered: Sequence[str]) -> Iterator[list[str]]:
        """The pieces of each word of a sorted list."""
        score, longest, previous = self.score, self.longest, ""
        tails, known, ask = self.tails, self.follows, self.may_follow
        start, last, total = [0], [""], [0.0]  # of each prefix: its last piece and where that begins; its best score
        for word in ordered:
            shared = 0
            for a, b in zip(previous, word):
                if a != b:
                    break
                shared += 1
            del start[shared + 1:], last[shared + 1:], total[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                chosen = end - 1
                piece = tail = word[chosen:end]
                if self.merges:
                    at = chosen
                    while True:
                        if tail in score or at == end - 1:
                            pair = (last[at], tail)
                            good = known.get(pair)
                            if ask(*pair) if good is None else good:
                                chosen, piece = at, tail
                                break
                        at -= 1
                        if at < 0:
                            break
                        tail = word[at:end]
                        if tail not in tails:
                            break
                else:
                    best = total[chosen] + score.get(piece, self.low)
                    for at in range(max(0, end - longest), end - 1):
                        s = score.get(word[at:end])
                        if s is not None and total[at] + s > best:
                            chosen, best, piece = at, total[at] + s, word[at:end]
                    total.append(best)
                start.append(chosen)
                last.append(piece)
            pieces, end = [], len(word)
            while end:
                pieces.append(last[end])
                end = start[end]
            yield pieces[::-1]
            previous = word

    def ids_of(self, pieces: Sequence[str]) -> list[int]:
        out: list[int] = []
        gap = False
        for p in pieces:
            i = self.id.get(p)
            if i is not None:
                out.append(i)
            elif self.fallback:
                out += [self.bytes[b] for b in p.encode("utf-8")]
            elif not gap:  # neighbouring unknown characters are one unknown piece
                out.append(self.unknown)
            gap = i is None
        return out


class Spelling:
    """What each id of a model spells."""

    def __init__(self, model_proto: bytes):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=model_proto)
        n = m.get_piece_size()
        self.raw = []
        for i in range(n):
            if m.is_control(i):
                self.raw.append(b"")
            elif m.is_byte(i):
                self.raw.append(bytes((int(m.id_to_piece(i)[3:5], 16),)))
            else:
                self.raw.append(m.id_to_piece(i).replace(MARK, " ").encode("utf-8"))
        # bytes above 127 are parts of characters: texts that hold any are joined as bytes
        self.partial = np.array([m.is_byte(i) and self.raw[i] > b"\x7f" for i in range(n)])
        self.text = pa.array([b"" if p else r for r, p in zip(self.raw, self.partial)], type=pa.binary()).cast(pa.string())

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """The texts of lists of ids without nulls: the space in front is left out, wrong bytes become the replacement character."""
        ids, size = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.concatenate(([0], np.cumsum(size)))
        spelled = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), self.text.take(ids))
        out = pc.binary_join(spelled, "")
        flat = ids.to_numpy(zero_copy_only=False)
        odd = np.flatnonzero(counted(self.partial[flat], bounds))
        if len(odd):
            texts = [b"".join([self.raw[i] for i in flat[bounds[r]:bounds[r + 1]]]).decode("utf-8", errors="replace") for r in odd.tolist()]
            mask = np.zeros(len(lists), dtype=bool)
            mask[odd] = True
            out = pc.replace_with_mask(out, pa.array(mask), pa.array(texts, type=pa.string()))
        return pc.if_else(pc.starts_with(out, " "), pc.utf8_slice_codeunits(out, 1), out)


@lru_cache(maxsize=2)
def _spelling(model_proto: bytes) -> Spelling:
    return Spelling(model_proto)


@lru_cache(maxsize=2)
def _pieces(model_proto: bytes, kind: str) -> Pieces:
    return Pieces(model_proto, kind)


def _marked_words(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """(rows taken, row of each marked word, its code, the distinct marked words) for normalised texts.

    Texts whose marks stand alone are split by Arrow; the others, by their runs of marks.
    """
    easy = pc.and_(pc.starts_with(texts, MARK), pc.invert(pc.match_substring(texts, MARK * 2)))
    easy = easy.to_numpy(zero_copy_only=False).astype(bool)
    taken = np.flatnonzero(easy)
    if len(taken):
        lists = pc.split_pattern(texts.take(pa.array(taken)), MARK)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        keep = np.ones(int(sizes.sum()), dtype=bool)
        keep[np.cumsum(sizes) - sizes] = False  # what stands before the first mark: nothing
        coded = lists.flatten().filter(pa.array(keep)).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        yield taken, np.repeat(np.arange(len(taken)), sizes - 1), code, [MARK + w for w in coded.dictionary.to_pylist()]
    taken = np.flatnonzero(~easy)
    if len(taken):
        parts = [_SEGMENTS.findall(t) for t in texts.take(pa.array(taken)).to_pylist()]
        row = np.repeat(np.arange(len(taken)), [len(p) for p in parts])
        coded = pa.array([w for p in parts for w in p], type=pa.string()).dictionary_encode()
        yield taken, row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _encode_block(pieces: Pieces, known: dict[str, tuple[int, ...]], texts: pa.Array) -> pa.Array:
    normal = pa.array(pieces.model.normalize(texts.to_pylist()), type=pa.string())
    if pieces.crossing:  # some piece goes on behind a mark: a text is then one word
        found = [(np.arange(len(normal)), np.arange(len(normal)), np.arange(len(normal)), normal.to_pylist())]
    else:
        found = _marked_words(normal)
    lists, order = [], []
    for taken, row, code, distinct in found:
        cut = [(w,) if w in known else pieces.cut(w) for w in distinct]
        new = sorted({p for parts in cut for p in parts if p not in known})
        fresh = {w: tuple(pieces.ids_of(p)) for w, p in zip(new, pieces.segment(new))}
        room = CACHE_WORDS - len(known)
        known.update(islice(((w, ids) for w, ids in fresh.items() if len(w) <= 64), max(0, room)))
        of = lambda p: fresh[p] if p in fresh else known[p]
        own = [of(parts[0]) if len(parts) == 1 else tuple(chain.from_iterable(map(of, parts))) for parts in cut]
        size = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        table = np.fromiter(chain.from_iterable(own), dtype=np.int32, count=int(size.sum()))
        start = np.cumsum(size) - size
        each = size[code]
        flat = table[np.repeat(start[code], each) + ranges(each)]
        counts = np.bincount(row, weights=each, minlength=len(taken)).astype(np.int64)
        bounds = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        lists.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat, type=pa.int32())))
        order.append(taken)
    if not lists:
        return pa.array([], type=pa.list_(pa.int32()))
    place = np.empty(len(texts), dtype=np.int64)
    place[np.concatenate(order)] = np.arange(len(texts))
    return pa.concat_arrays(lists).take(pa.array(place))


ENCODED = pa.schema([("doc_id", pa.int64()), ("text_crc32", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
ENCODED_DDL = "doc_id long, text_crc32 long, n_tokens long, ids array<int>"


def encode(docs: DataFrame, model_file: str, kind: str = "auto") -> DataFrame:
    """The piece ids of each whole text, as the model's own encoder gives them.

    The model file is read on the driver and sent to the tasks (its size does not depend on the data). A null text
    counts as empty and an empty text has no pieces; repeated rows and null ids come out as they went in; other columns are
    ignored. One pass, no shuffle; tasks remember a bounded number of words.
    """
    with open(model_file, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = _pieces(sent.value, kind), {}
        for part in blocks(batches):
            ids = _encode_block(pieces, known, part.column(1))
            pa.default_memory_pool().release_unused()
            crc = [zlib.crc32(t.encode("utf-8")) for t in part.column(1).to_pylist()]
            yield batch_of(ENCODED, part.column(0), crc, pc.cast(pc.list_value_length(ids), pa.int64()), ids)

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED_DDL)


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """``encoded`` with the column ``text`` read back from ``ids``; null ids give an empty text."""
    with open(model_file, "rb") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())
    columns = [c for c in encoded.columns if c != "text"]
    at = columns.index("ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = _spelling(sent.value)
        for batch in batches:
            upto = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + DECODE_IDS, side="right")))
                part = batch.slice(start, end - start)
                lists = part.column(at)
                if lists.null_count:
                    lists = pa.array([x or [] for x in lists.to_pylist()], type=lists.type)
                yield pa.RecordBatch.from_arrays([*part.columns, spelling.decode(lists)], names=[*batch.schema.names, "text"])
                start = end
            pa.default_memory_pool().release_unused()

    plain = encoded.select(*columns)
    return plain.mapInArrow(run, widened(plain.schema, "text string"))
