"""Line deduplication: an exact set-similarity join of lines, after which later matches are removed."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..scale import materialize
from .blocks import batch_of, blocks, give_back, mixed, ranges, text_bytes, widened, word_hashes

BUCKET_BITS = 20
RARITY_PARTS = 64
RARITY_BUCKETS = 1 << BUCKET_BITS
FILTER_BITS = 1 << 23
HASH20 = (1 << 20) - 1
HOT_LIST = 20_000
FIRST_CANDIDATES, MORE_CANDIDATES, LOOKED_AT = 2, 64, 16
TOKENS_A_PART = 3_000_000
MOST_TASKS = 20_000
OPEN_TOKENS = 1_000_000
PAIRS_AT_ONCE = 1_000_000
LINE_BLOCK = 4 << 20


# -- lines as sets of tokens ----------------------------------------------------------------------------------------


class Lines:
    """The lines of a block of documents (see ``_numbered``) as sets of token hashes, tokens of a line together and rarest first.

    ``rarity`` gives each hash bucket its place in the order of rarity. ``wanted(doc, line)`` may choose the lines that
    are looked into at all, ``listed(token)`` the tokens of which a line has to hold one.
    """

    def __init__(self, block: pa.RecordBatch, rarity: np.ndarray | None, wanted=None, listed=None):
        doc, line, row, token = _tokens(block, wanted)
        if listed is not None:
            held = np.zeros(len(doc), dtype=bool)
            held[row[listed(token)]] = True
            kept, number = held[row], np.cumsum(held) - 1
            row, token, doc, line = number[row[kept]], token[kept], doc[held], line[held]
        n_lines = len(doc)
        # one sort by line, then rarity, then hash
        row_bits = max(1, n_lines).bit_length()
        place = token >> np.uint64(64 - BUCKET_BITS)
        if rarity is not None:
            place = rarity[place.astype(np.int64)].astype(np.uint64)
        rest = np.uint64(64 - BUCKET_BITS - row_bits)
        tail = (token << np.uint64(BUCKET_BITS)) >> np.uint64(BUCKET_BITS + row_bits)
        key = (place << rest) | tail | (row.astype(np.uint64) << np.uint64(64 - row_bits))
        order = np.argsort(key)
        row, token = row[order], token[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
        row, self.token = row[new], token[new]
        size = np.bincount(row, minlength=n_lines).astype(np.int64)
        full = np.flatnonzero(size)  # lines with a word
        self.size, self.doc, self.line = size[full], doc[full], line[full]
        self.start = np.cumsum(self.size) - self.size
        self.of_token = np.repeat(np.arange(len(full)), self.size)


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit numbers that a column of bytes holds, and where those of each row begin and end."""
    data, bounds = text_bytes(column)
    return data.view("<u8"), bounds // 8


def _tokens(block: pa.RecordBatch, wanted=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document of each line, number and text of each line, line of each token, tokens). Bytes hold the tokens of one line.

    A line is known by its number, then by its text's hash, which tells rows of one id apart.
    """
    ids, texts, own = block.columns
    doc, own = ids.to_numpy(zero_copy_only=False).astype(np.int64), own.to_numpy(zero_copy_only=False)
    if pa.types.is_binary(texts.type):
        if wanted is not None:
            at = np.flatnonzero(wanted(doc, own))
            doc, own, texts = doc[at], own[at], texts.take(pa.array(at))
        token, bounds = _numbers(texts)
        return doc, own, np.repeat(np.arange(len(doc)), np.diff(bounds)), token
    data, bounds = text_bytes(texts)
    breaks = np.flatnonzero(data == 0x0A)
    before = np.searchsorted(breaks, bounds)  # line breaks before each text
    per_text = np.diff(before) + 1
    first = before[:-1] + np.arange(len(texts))
    begin = np.empty(len(breaks) + len(texts), dtype=np.int64)
    inner = np.ones(len(begin), dtype=bool)
    inner[first] = False
    begin[first], begin[inner] = bounds[:-1], breaks + 1
    text_of = np.repeat(np.arange(len(texts)), per_text)
    doc, line = doc[text_of], (ranges(per_text) << 20) | own[text_of]
    if wanted is not None:
        at = np.flatnonzero(wanted(doc, line))
        end = np.append(begin[1:], len(data))[at]  # with its line break, or the end of its text
        size, doc, line = end - begin[at], doc[at], line[at]
        data = data[np.repeat(begin[at], size) + ranges(size)]
        bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        begin = bounds[:-1]
    start, token = word_hashes(data, bounds)
    upto = np.append(np.searchsorted(start, begin), len(start))
    return doc, line, np.repeat(np.arange(len(doc)), np.diff(upto)), token


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents that have an id, with 20 bits of their text's hash, or as ``own`` says."""
    own = F.col("own") if "own" in docs.columns else F.xxhash64("text").bitwiseAND(F.lit(HASH20)).alias("own")
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", own)


def _lean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small blocks, with what Arrow no longer needs given back after each."""
    for block in blocks(batches, limit=LINE_BLOCK):
        yield block
        pa.default_memory_pool().release_unused()


def _parities(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each line: how many of its tokens fall on each, odd or even."""
    bit = lines.token & np.uint64(63)
    side = (lines.token >> np.uint64(6) & np.uint64(1)).astype(bool)
    one = np.uint64(1) << bit
    return (np.bitwise_xor.reduceat(np.where(side, np.uint64(0), one), lines.start),
            np.bitwise_xor.reduceat(np.where(side, one, np.uint64(0)), lines.start))


def _summed(lines: Lines, values: np.ndarray) -> np.ndarray:
    """The wrapped sum of values over the tokens of each line."""
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return upto[lines.start + lines.size] - upto[lines.start]


def rarities(docs: DataFrame) -> np.ndarray:
    """How often the tokens of each hash bucket occur in all lines: a table of fixed size, whatever the corpus.

    A bucket is the leading bits of a token's hash.
    """

    width = RARITY_BUCKETS // RARITY_PARTS
    schema = pa.schema([("part", pa.int32()), ("data", pa.binary())])

    def given(part: int, counts: np.ndarray):
        return part, pa.compress(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)

    def taken(data: bytes) -> np.ndarray:
        raw = np.frombuffer(pa.decompress(data, 8 * width, codec="zstd"), dtype=np.uint8)
        return np.ascontiguousarray(raw.reshape(8, width).T).view("<i8").ravel()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RARITY_BUCKETS, dtype=np.int64)
        for part in _lean(batches):
            held = part.column(0)
            token = _numbers(held)[0] if pa.types.is_binary(held.type) else word_hashes(*text_bytes(held))[1]
            total += np.bincount((token >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=RARITY_BUCKETS)
        yield batch_of(schema, *zip(*[given(i, total[i * width:(i + 1) * width]) for i in range(RARITY_PARTS)]))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[part] = sums[part] + taken(data) if part in sums else taken(data)
        if sums:
            yield batch_of(schema, *zip(*[given(i, c) for i, c in sums.items()]))

    ddl = "part int, data binary"
    counts = docs.where(F.col("doc_id").isNotNull()).select("text").mapInArrow(count, ddl)
    got = counts.repartition(RARITY_PARTS, "part").mapInArrow(add, ddl).toArrow()
    out = np.zeros(RARITY_BUCKETS, dtype=np.int64)
    for part, data in zip(got["part"].to_pylist(), got["data"].to_pylist()):
        out[part * width:(part + 1) * width] += taken(data)
    return out


# -- candidates -----------------------------------------------------------------------------------------------------

_FIELDS = (("key", "<u4"), ("doc", "<i8"), ("line", "<i8"), ("size", "<u4"), ("at", "<u4"), ("low", "<u8"), ("high", "<u8"), ("whole", "<u4"))


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns as bytes, the first byte of all values together, then the second, and compressed."""
    raw = b"".join(np.ascontiguousarray(c.astype(t)).view(np.uint8).reshape(len(c), -1).T.tobytes() for c, (_, t) in zip(columns, _FIELDS))
    return pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> list[np.ndarray]:
    widths = [np.dtype(t).itemsize for _, t in _FIELDS]
    raw, out, at = np.frombuffer(pa.decompress(data, n * sum(widths), codec="zstd"), dtype=np.uint8), [], 0
    for width, (_, t) in zip(widths, _FIELDS):
        out.append(np.ascontiguousarray(raw[at:at + n * width].reshape(width, n).T).view(t).ravel())
        at += n * width
    return out


POSTINGS = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])


def _postings(rarity, parts: int, num: int, den: int, listed=None):
    """For each block of texts and each part: the prefix tokens of its lines, with what the filters need.

    With ``listed``, a bit table of tokens, only their lists are made.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, places = rarity.value
        held = None if listed is None else lambda t: _is_marked(listed.value, t.view(np.int64), np.zeros(len(t), np.int64))
        for block in _lean(batches):
            lines = Lines(block, places, listed=held)
            if not len(lines.size):
                continue
            low, high = _parities(lines)
            whole = _summed(lines, mixed(lines.token))
            # of equal sets in this block only the first line is posted; the others are settled here, but not the
            # first line itself where its row is repeated
            order = np.lexsort((lines.line, lines.doc))
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            order = np.lexsort((rank, lines.size, whole))
            again = np.zeros(len(order), dtype=bool)
            again[1:] = (whole[order][1:] == whole[order][:-1]) & (lines.size[order][1:] == lines.size[order][:-1])
            head = order[np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))]
            copy = order[again & ((lines.doc[order] != lines.doc[head]) | (lines.line[order] != lines.line[head]))]
            first = np.ones(len(order), dtype=bool)
            first[order[again]] = False
            prefix = _prefix_length(lines.size, num, den)
            place = np.arange(len(lines.token)) - lines.start[lines.of_token]
            used = (place < prefix[lines.of_token]) & first[lines.of_token]
            if listed is not None:
                used &= held(lines.token)
                copy = copy[:0]  # told in the first wave
            used = np.flatnonzero(used)
            token, line, at = lines.token[used], lines.of_token[used], place[used]
            # lists of tokens that are everywhere are cut into a triangle of cells
            cells = -(-common[(token >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)] // HOT_LIST)
            hot = cells > 1
            keys, kept_line, kept_at = [mixed(token[~hot])], [line[~hot]], [at[~hot]]
            if hot.any():
                g, t, ln = cells[hot].astype(np.int64), token[hot], line[hot]
                mine = (mixed(lines.doc[ln].astype(np.uint64) * np.uint64(31) + lines.line[ln].astype(np.uint64)) % g.astype(np.uint64)).astype(np.int64)
                rep = np.repeat(np.arange(len(g)), g)
                other = np.arange(len(rep)) - np.repeat(np.cumsum(g) - g, g)
                one, two = np.minimum(mine[rep], other), np.maximum(mine[rep], other)
                keys.append(mixed(mixed(t[rep]) ^ mixed((one << 32 | two).astype(np.uint64))))
                kept_line.append(ln[rep])
                kept_at.append(at[hot][rep])
            key, line, at = np.concatenate(keys), np.concatenate(kept_line), np.concatenate(kept_at)
            part = (key % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part << 32 | rank[line])
            key, line, at, part = key[order], line[order], at[order], part[order]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            copies = _packed([np.full(len(copy), 0), lines.doc[copy], lines.line[copy], np.zeros(len(copy)), np.zeros(len(copy)),
                              np.zeros(len(copy)), np.zeros(len(copy)), np.zeros(len(copy))]) if len(copy) else b""
            out: list[list] = [[], [], []]
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                s = slice(cuts[p], cuts[p + 1])
                ln = line[s]
                out[0].append(p)
                out[1].append(len(ln))
                out[2].append(_packed([key[s] >> np.uint64(32), lines.doc[ln], lines.line[ln], lines.size[ln], at[s], low[ln], high[ln], whole[ln] >> np.uint64(32)]))
            if len(copy):
                out[0].append(int(copy[0]) % parts)
                out[1].append(-len(copy))
                out[2].append(copies)
            yield batch_of(POSTINGS, *out)

    return run


CANDIDATES = pa.schema([("doc", pa.int64()), ("line", pa.int64()), ("to_doc", pa.int64()), ("to_line", pa.int64()), ("sure", pa.bool_()), ("more", pa.bool_())])
# Candidates, and lines settled in their block (sure). ``more``: the line has seen only a part of a list.
CANDIDATES_DDL = "doc long, line long, to_doc long, to_line long, sure boolean, more boolean"


def _settled(doc, line) -> pa.RecordBatch:
    n = len(doc)
    return batch_of(CANDIDATES, doc, line, doc, line, np.ones(n, bool), np.zeros(n, bool))


def candidates_of(key, doc, line, size, at, low, high, whole, most: int, num: int, den: int, trust: bool = False, only=None):
    """(later line, earlier line, whether the later one was stopped) of postings, as positions in them.

    In the list of a token lines stand in the order of size, document and number. Each looks for earlier lines: from its
    own place down to the least size that allows the similarity, then at larger ones up to the greatest. A pair passes if the
    tokens from the shared one on suffice for the overlap that is needed, and if not more bits of the parities differ
    than tokens may. A line leaves the list at its ``most``-th candidate, so that a group of near copies costs its length
    and not its pairs. With ``trust`` it looks at more of them and takes the ``most`` nearest, and leaves at one that is very
    near. With ``only(doc, line)`` the other lines look for none.
    """
    size = size.astype(np.int64)
    by = (size, key) if key.itemsize > 4 else (key.astype(np.int64) << 31 | size,)
    order = np.lexsort((line, doc, *by))
    key, doc, line, size, at, low, high, whole = (c[order] for c in (key, doc, line, size, at.astype(np.int64), low, high, whole))
    n = len(key)
    head = np.ones(n, dtype=bool)
    head[1:] = key[1:] != key[:-1]
    width = int(size.max()) * den // num + 2 if n else 1
    base = (np.cumsum(head) - 1) * width
    place = base + size
    lowest = np.searchsorted(place, base - (-num * size // den), side="left")
    larger = np.searchsorted(place, place, side="right")
    down, up = np.arange(n) - lowest, np.searchsorted(place, base + den * size // num, side="right") - larger
    left, got = size - at, np.zeros(n, dtype=np.int64)
    finished, stopped = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    if only is not None:
        finished |= ~only(doc, line)
    later, earlier, distance = [], [], []
    enough = most * LOOKED_AT if trust else most

    def look(begin: np.ndarray, sign: int, count: np.ndarray, behind: np.ndarray):
        step, alive = 0, np.flatnonzero(~finished & (count > 0))
        while len(alive):
            to = begin[alive] + sign * step
            before = (doc[to] < doc[alive]) | (doc[to] == doc[alive]) & (line[to] < line[alive])
            a, b = (alive, to) if before.all() else (alive[before], to[before])
            x, y = size[a], size[b]
            need = -(-num * (x + y) // (num + den))  # the least overlap of this similarity
            good = np.minimum(left[a], left[b]) >= need  # holds at the first shared token of every match
            a, b, room = a[good], b[good], (x + y - 2 * need)[good]
            apart = np.bitwise_count(low[a] ^ low[b]).astype(np.int64) + np.bitwise_count(high[a] ^ high[b])
            good = apart <= room
            if good.any():
                a, b, apart, room = a[good], b[good], apart[good], room[good]
                got[a] += 1
                copy = (apart == 0) & (whole[a] == whole[b]) & (size[a] == size[b]) & trust
                likely = copy | (2 * apart <= room) & (room > 2) & trust
                told = ~copy | (at[a] == 0)  # two equal sets meet in the list of their rarest token, and are told there
                later.append(a[told])
                earlier.append(b[told])
                distance.append(apart[told])
                full = likely | (got[a] >= enough)
                finished[a[full]] = True
                stopped[a[copy | full & ((count[a] > step + 1) | (behind[a] > 0))]] = True
            step += 1
            alive = alive[(count[alive] > step) & ~finished[alive]]

    look(np.arange(n) - 1, -1, down, up)
    look(larger, 1, up, np.zeros(n, dtype=np.int64))
    later, earlier, distance = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (later, earlier, distance))
    # the nearest candidates of each line
    rank = np.lexsort((np.arange(len(later)), distance, later))
    later, earlier = later[rank], earlier[rank]
    begins = np.searchsorted(later, later, side="left")
    near = np.arange(len(later)) - begins < most
    stopped[later[~near]] = True
    later, earlier = later[near], earlier[near]
    return order[later], order[earlier], stopped[later]


def _candidates(most: int, num: int, den: int, trust: bool, open_marks=None):
    def solve(pile: list) -> Iterator[pa.RecordBatch]:
        for n, data in pile:
            if n < 0:
                _, doc, line, *_ = _unpacked(data, -n)
                yield _settled(doc, line)
        loaded = [_unpacked(data, n) for n, data in pile if n > 0]
        pile.clear()
        if loaded:
            columns = [np.concatenate(c) for c in zip(*loaded)]
            del loaded
            _, doc, line, *_ = columns
            only = None if open_marks is None else lambda d, x: _is_marked(open_marks.value, d, x)
            later, earlier, more = candidates_of(*columns, most, num, den, trust, only)
            for i in range(0, len(later), 50_000):
                x, y = later[i:i + 50_000], earlier[i:i + 50_000]
                yield batch_of(CANDIDATES, doc[x], line[x], doc[y], line[y], np.zeros(len(x), bool), more[i:i + 50_000])
        give_back()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pile = None, []
        for batch in batches:
            named, n, data = batch.columns
            for i, (p, k) in enumerate(zip(named.to_pylist(), n.to_pylist())):
                if p != part:
                    yield from solve(pile)
                    part = p
                pile.append((k, data[i].as_buffer()))
        yield from solve(pile)

    return run


# -- verification and removal ---------------------------------------------------------------------------------------


def _bit(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mixed(mixed(doc.view(np.uint64)) ^ line.view(np.uint64)) & np.uint64(FILTER_BITS - 1)


def _marked(keys: DataFrame):
    """A hashed bit table of fixed size in which every (doc, line) of ``keys`` is marked, sent to the tasks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
        for batch in batches:
            bit = _bit(*(c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns))
            np.bitwise_or.at(table, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(table[at].view(np.int64), pa.int64())], names=["word", "bits"])

    got = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(out)


def _is_marked(table: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    bit = _bit(doc, line)
    return (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def _wanted_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, line, tokens) of the lines in ``wanted``; few others pass the bit table and fall out of the join."""
    sent = _marked(wanted)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _lean(batches):
            lines = Lines(block, None, lambda doc, line: _is_marked(sent.value, doc, line))
            bounds = np.concatenate((lines.start, [len(lines.token)])).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(bounds), pa.array(lines.token.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(lines.doc), pa.array(lines.line), tokens], names=["doc", "line", "tokens"])

    return _numbered(docs).mapInArrow(run, "doc long, line long, tokens array<long>")


def _prefixes(rarity, num: int, den: int):
    """(token, 0) of the prefix tokens of (doc, line, tokens), those of equal rarity with the last one included."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = rarity.value[1]
        for batch in batches:
            lists = batch.column(2)
            token = lists.flatten().to_numpy().view(np.uint64)
            size = lists.value_lengths().to_numpy().astype(np.int64)
            line = np.repeat(np.arange(len(size)), size)
            place = places[(token >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
            last = np.lexsort((place, line))[np.cumsum(size) - size + size - -(-num * size // den)]
            token = np.unique(token[place <= place[last][line]]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.zeros(len(token), np.int64))], names=["doc", "line"])

    return run


def compared_pairs(docs: DataFrame, pairs: DataFrame, similarity: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """For pairs (doc, line, to_doc, to_line, more): (doc, line, matched, more) of each line, and the token sets of the lines."""
    num, den = similarity
    wanted = pairs.select("doc", "line").unionByName(pairs.select(F.col("to_doc").alias("doc"), F.col("to_line").alias("line")))
    sets = materialize(_wanted_lines(docs, wanted).dropDuplicates(["doc", "line"]))
    target = sets.select(F.col("doc").alias("to_doc"), F.col("line").alias("to_line"), F.col("tokens").alias("to_tokens"))
    both = pairs.join(sets, ["doc", "line"]).join(target, ["to_doc", "to_line"])
    shared = F.size(F.array_intersect("tokens", "to_tokens"))
    holds = shared * (num + den) >= num * (F.size("tokens") + F.size("to_tokens"))
    return materialize(both.groupBy("doc", "line").agg(F.max(holds).alias("matched"), F.max("more").alias("more"))), sets


def _prefix_length(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """So many tokens of a set that every similar set holds one of them."""
    return size - -(-num * size // den) + 1


def _few(opened: DataFrame, common: np.ndarray, num: int, den: int):
    """The open lines (doc, line, tokens) with their rarest tokens, or None if they are many or their tokens are common.

    What is compared at most is known from the counts of the tokens: an eighth of all tokens.
    """
    lines, numbers = opened.agg(F.count(F.lit(1)), F.sum(F.size("tokens"))).first()
    if lines + numbers > OPEN_TOKENS:
        return None
    got = opened.toArrow()
    lists = got["tokens"].combine_chunks()
    token = lists.flatten().to_numpy().view(np.uint64)
    size = lists.value_lengths().to_numpy().astype(np.int64)
    of = np.repeat(np.arange(len(size)), size)
    often = common[(token >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
    order = np.lexsort((often, of))
    rare = order[ranges(size) < _prefix_length(size, num, den)[of]]
    if int(often[rare].sum()) > int(common.sum()) // 8:
        return None
    rare = rare[np.argsort(token[rare])]
    start = np.cumsum(size) - size
    return dict(doc=got["doc"].to_numpy(), line=got["line"].to_numpy(), size=size, token=token, start=start, rare=token[rare], rare_of=of[rare])


def _compared(few, num: int, den: int):
    """(doc, line) of the few open lines that an earlier line of these documents matches; a line may come from several tasks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = few.value
        doc, line, size, rare, rare_of = (of[k] for k in ("doc", "line", "size", "rare", "rare_of"))
        sets = [np.sort(of["token"][a:a + n]) for a, n in zip(of["start"], size)]
        listed = np.zeros(RARITY_BUCKETS, dtype=bool)
        bucket = lambda t: (t >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        listed[bucket(rare)] = True
        alone = np.ones(len(doc), dtype=bool)
        for block in _lean(batches):
            there = Lines(block, None, listed=lambda t: listed[bucket(t)])
            at = np.flatnonzero(listed[bucket(there.token)])
            low = np.searchsorted(rare, there.token[at], side="left")
            count = np.searchsorted(rare, there.token[at], side="right") - low
            piece, found = np.cumsum(count) // PAIRS_AT_ONCE, []
            for now in np.split(np.arange(len(at)), np.flatnonzero(np.diff(piece)) + 1):
                x = np.repeat(there.of_token[at[now]], count[now])
                y = rare_of[np.repeat(low[now], count[now]) + ranges(count[now])]
                before = (there.doc[x] < doc[y]) | (there.doc[x] == doc[y]) & (there.line[x] < line[y])
                a, b = there.size[x], size[y]
                good = alone[y] & before & (np.minimum(a, b) * (num + den) >= num * (a + b))
                for pair in np.unique(x[good] * len(doc) + y[good]).tolist():
                    i, j = divmod(pair, len(doc))
                    if alone[j]:
                        mine = there.token[there.start[i]:there.start[i] + there.size[i]]
                        shared = len(np.intersect1d(mine, sets[j], assume_unique=True))
                        if shared * (num + den) >= num * (len(mine) + len(sets[j])):
                            alone[j] = False
                            found.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(doc[found], pa.int64()), pa.array(line[found], pa.int64())], names=["doc", "line"])

    return run


def matched_lines(docs: DataFrame, similarity: tuple[int, int] = (4, 5), known: DataFrame | None = None) -> DataFrame:
    """(doc, line) of every line whose token set has at least this Jaccard similarity to that of an earlier line.

    Lines are ordered by doc_id and number; tokens are words, lower-cased in A-Z. ``line`` holds the number times
    2 ** 20 plus a hash of the whole text. Documents may also come as (doc_id, own, text) with ``text`` the bytes of 64-bit
    numbers, the tokens of one line that is then called ``own``. Lines in ``known`` are given as matched without being compared again.

    Tokens are ordered by the corpus count of their hash bucket, rarest first, so the prefixes of lines meet on rare
    tokens. Later lines meet earlier ones in the lists of their prefix tokens, in waves: the first wave gives each the two
    nearest of the first candidates of a list, whose sets are fetched and compared exactly. Lines for which none holds and that have not
    seen the whole of a list stay open. While these are few, they are sent to the tasks and compared with every earlier line that
    holds one of their rarest tokens; if they are many, the next wave makes only their lists and gives 64 times as many.
    So nothing is lost, and a group of copies or near copies never makes all its pairs.
    """
    num, den = similarity
    spark = docs.sparkSession
    common = rarities(docs)
    places = np.empty(RARITY_BUCKETS, dtype=np.int64)
    places[np.argsort(common, kind="stable")] = np.arange(RARITY_BUCKETS)
    rarity = spark.sparkContext.broadcast((common, places))
    # a part holds a bounded number of postings, whatever the corpus
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), int(common.sum()) // TOKENS_A_PART)
    plain = _numbered(docs)
    settled, open_lines, marks, listed, most = None, None, None, None, FIRST_CANDIDATES

    while True:
        posted = plain.mapInArrow(_postings(rarity, parts, num, den, listed), "part int, n long, data binary")
        dealt = posted.repartition(min(parts, MOST_TASKS), "part").sortWithinPartitions("part")
        raw = materialize(dealt.mapInArrow(_candidates(most, num, den, settled is None, marks), CANDIDATES_DDL))
        found = raw.where("NOT sure")
        if known is not None:
            found = found.join(known, ["doc", "line"], "left_anti")
        if open_lines is not None:
            found = found.join(open_lines, ["doc", "line"], "left_semi")
        pairs = materialize(found.groupBy("doc", "line", "to_doc", "to_line").agg(F.max("more").alias("more")))
        checked, sets = compared_pairs(docs, pairs, similarity)
        now = checked.where("matched").select("doc", "line")
        if settled is None:
            now = now.unionByName(raw.where("sure").select("doc", "line"))
            now = now if known is None else now.unionByName(known)
        settled = now if settled is None else settled.unionByName(now)
        open_lines = checked.where("more AND NOT matched").select("doc", "line").join(settled, ["doc", "line"], "left_anti")
        open_lines = materialize(open_lines)
        if not open_lines.take(1):
            return settled.distinct()
        opened = sets.join(open_lines, ["doc", "line"], "left_semi")
        few = _few(opened, common, num, den)
        if few is not None:
            found = plain.mapInArrow(_compared(spark.sparkContext.broadcast(few), num, den), "doc long, line long")
            return settled.unionByName(found).distinct()
        marks = _marked(open_lines)
        listed = _marked(opened.mapInArrow(_prefixes(rarity, num, den), "doc long, line long"))
        most *= MORE_CANDIDATES


def dedup_lines(docs: DataFrame, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """The documents, all columns, with their later matching lines removed, and behind them ``n_lines``, ``n_removed``
    and ``removed`` (numbers of the lines taken out, from 0).

    A line goes if its set of words has at least the Jaccard similarity (4 / 5) to the set of any earlier line, in the
    order of doc_id and line number, in the same or another document. Lines without a word stay. Null texts stay
    null and have no lines; documents without an id take no part and stay as they are. Rows that repeat an id and
    text count as one document and lose the same lines; rows of one id with different texts are matched with each other.
    Columns of these three names are replaced. An empty table gives no rows.
    """
    extra = ("n_lines", "n_removed", "removed")
    gone = materialize(matched_lines(docs, similarity))
    per_doc = gone.groupBy("doc").agg(F.collect_list("line").alias("gone"))
    # a bit table of fixed size says which documents may have lost lines; the others do not travel
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    table = gone.select(bit("doc").alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    others = [c for c in docs.columns if c != "text"]
    row = docs.select(F.struct(*others).alias("row"), F.col("doc_id").alias("doc"), F.col("text").alias("text"), bit("doc_id").alias("bit"))
    seen = row.join(F.broadcast(materialize(table)), F.shiftright("bit", 6) == F.col("word"), "left")
    hit = F.coalesce(F.expr("(shiftrightunsigned(bits, cast(bit & 63 as int)) & 1) = 1"), F.lit(False)) & F.col("doc").isNotNull()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            texts, n_lines, removed = batch.column(1).to_pylist(), [], []
            touched = batch.column(2).to_pylist()
            for i, (text, lines) in enumerate(zip(texts, touched)):
                own: list[int] = []
                if lines:
                    mark = xxh64_intdigest((text or "").encode("utf-8"), 42) & HASH20  # as xxhash64 gives it
                    own = sorted(x >> 20 for x in lines if x & HASH20 == mark)
                n_lines.append(0 if text is None else text.count("\n") + 1)
                if own:
                    drop = set(own)
                    texts[i] = "\n".join([x for n, x in enumerate(text.split("\n")) if n not in drop])
                removed.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, batch.column(1).type), pa.array(n_lines, pa.int64()),
                 pa.array([len(x) for x in removed], pa.int64()), pa.array(removed, pa.list_(pa.int32()))],
                names=["row", "text", *extra])

    joined = seen.where(hit).join(per_doc, "doc", "left").select("row", "text", "gone")
    done = joined.mapInArrow(run, widened(joined.select("row", "text").schema, "n_lines long, n_removed long, removed array<int>"))
    whole = seen.where(~hit).select(
        "row", "text", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"),
        F.array().cast("array<int>").alias("removed"))
    both = done.unionByName(whole)
    kept = [c for c in docs.columns if c not in extra]
    return both.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in kept], *extra)
