"""Language identification: a bidirectional gated recurrent network over bytes that labels every position."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..scale import materialize, top_n
from .blocks import batch_of, blocks, text_bytes

UNDETERMINED = "und"
WINDOW = 128          # most bytes that one run of the network spans; a longer text is cut into equal windows
LANES = 1024          # windows that run side by side
TEXT_BLOCK = 2 << 20


# -- the network -------------------------------------------------------------------------------------------------------


@dataclass
class Cell:
    """One direction: what each byte adds to update gate, reset gate and candidate, their recurrent weights, and the bias of the
    candidate's recurrent part."""

    byte: np.ndarray     # (3, 256, hidden)
    state: np.ndarray    # (3, hidden, hidden)
    bias: np.ndarray     # (hidden,)


@dataclass
class Network:
    """Two cells, one forwards and one backwards, and a layer over both states at each position."""

    languages: list[str]
    cells: tuple[Cell, Cell]
    out: np.ndarray      # (2, hidden, languages)
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [p for c in self.cells for p in (c.byte, c.state, c.bias)] + [self.out, self.out_bias]


def _bent(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: the bounded curve of gates and candidates, a fraction of the cost of a hyperbolic tangent."""
    below = np.abs(x)
    below += 1
    x /= below
    return x


def _gate(x: np.ndarray) -> np.ndarray:
    """The same curve between 0 and 1, in place."""
    _bent(x)
    x *= 0.5
    x += 0.5
    return x


def gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes (step, window), how many windows are at least that long). Windows stand by falling length."""
    step = np.arange(int(length[0]))[:, None]
    return data[np.minimum(start + step, len(data) - 1)], (step < length).sum(axis=1)


def _run(cell: Cell, x: np.ndarray, active: np.ndarray, backwards: bool, kept: dict | None = None, out: np.ndarray | None = None) -> np.ndarray:
    """The state at each position, (step, window, hidden), or with ``out`` what it adds to the logits, (step, language, window).

    Zero beyond the end of a window. At step t the first ``active[t]`` windows go on; backwards, each begins at its own last byte.
    """
    lanes, hidden = x.shape[1], len(cell.bias)
    result = np.zeros((len(x), lanes, hidden) if out is None else (len(x), out.shape[1], lanes), dtype=np.float32)
    h = np.zeros((lanes, hidden), dtype=np.float32)
    for t in range(len(active))[::-1 if backwards else 1]:
        a = active[t]
        before, at = h[:a], x[t, :a]
        update, reset, new = (cell.byte[i].take(at, axis=0) for i in range(3))
        update += before @ cell.state[0]
        reset += before @ cell.state[1]
        through = before @ cell.state[2]
        through += cell.bias
        _gate(update)
        _gate(reset)
        if kept is not None:
            kept[t] = (before.copy(), update, reset, new, through)
            new += reset * through
        else:
            through *= reset
            new += through
        _bent(new)
        before -= new
        before *= update
        before += new
        if out is None:
            result[t, :a] = before
        else:
            np.matmul(out.T, before.T, out=result[t, :, :a])
    return result


def _back(cell: Cell, x: np.ndarray, active: np.ndarray, backwards: bool, kept: dict, d_states: np.ndarray) -> list[np.ndarray]:
    """Gradients of a cell's parameters from those of its states, back through all steps."""
    d_byte, d_state, d_bias = np.zeros_like(cell.byte), np.zeros_like(cell.state), np.zeros_like(cell.bias)
    dh = np.zeros(d_states.shape[1:], dtype=np.float32)
    for t in range(len(active))[::1 if backwards else -1]:
        a = active[t]
        before, update, reset, new, through = kept[t]
        d = dh[:a] + d_states[t, :a]
        d_new = d * (1 - update) * (1 - np.abs(new)) ** 2
        d_update = d * (before - new) * 0.5 * (1 - np.abs(2 * update - 1)) ** 2
        d_reset = d_new * through * 0.5 * (1 - np.abs(2 * reset - 1)) ** 2
        d_through = d_new * reset
        dh[:a] = d * update
        for i, (by_byte, by_state) in enumerate(((d_update, d_update), (d_reset, d_reset), (d_new, d_through))):
            np.add.at(d_byte[i], x[t, :a], by_byte)
            d_state[i] += before.T @ by_state
            dh[:a] += by_state @ cell.state[i].T
        d_bias += d_through.sum(axis=0)
    return [d_byte, d_state, d_bias]


def _softmax(logits: np.ndarray, axis: int) -> np.ndarray:
    """In place."""
    logits -= logits.max(axis=axis, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=axis, keepdims=True)
    return logits


def position_probabilities(net: Network, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities (step, language, window), mask of real positions (step, window)) of every byte of windows, which stand by falling length."""
    x, active = gathered(data, start, length)
    logits = _run(net.cells[0], x, active, False, out=net.out[0])
    logits += _run(net.cells[1], x, active, True, out=net.out[1])
    logits += net.out_bias[:, None]
    return _softmax(logits, 1), np.arange(len(x))[:, None] < length


def loss_and_gradients(net: Network, data: np.ndarray, start: np.ndarray, length: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of all positions against their window's label, and its gradients, by backpropagation through time."""
    x, active = gathered(data, start, length)
    mask = (np.arange(len(x))[:, None] < length).astype(np.float32)
    lane, kept = np.arange(len(length)), ({}, {})
    states = [_run(cell, x, active, back, k) for cell, back, k in zip(net.cells, (False, True), kept)]
    flat = sum(w.T @ h.reshape(-1, h.shape[2]).T for w, h in zip(net.out, states)) + net.out_bias[:, None]
    d = _softmax(flat.reshape(-1, *x.shape), 0)
    loss = float(-(np.log(np.maximum(d[label, :, lane].T, 1e-30)) * mask).sum() / mask.sum())
    d[label, :, lane] -= 1
    d *= mask / mask.sum()
    flat = d.reshape(len(d), -1)
    d_out = np.stack([h.reshape(-1, h.shape[2]).T @ flat.T for h in states])
    grads: list[np.ndarray] = []
    for cell, back, k, w, h in zip(net.cells, (False, True), kept, net.out, states):
        grads += _back(cell, x, active, back, k, (w @ flat).T.reshape(h.shape))
    return loss, [*grads, d_out, flat.sum(axis=1)]


def fresh(languages: list[str], hidden: int, seed: int = 0) -> Network:
    rng = np.random.default_rng(seed)
    make = lambda *shape, s: (s * rng.standard_normal(shape)).astype(np.float32)
    cells = tuple(Cell(make(3, 256, hidden, s=0.5), make(3, hidden, hidden, s=hidden ** -0.5), np.zeros(hidden, np.float32)) for _ in range(2))
    return Network(languages, cells, make(2, hidden, len(languages), s=0.5), np.zeros(len(languages), np.float32))


def fit(windows: list[bytes], labels: list[str], hidden: int = 12, steps: int = 300, lanes: int = 96, rate: float = 0.02) -> Network:
    """Train on labelled windows: each step draws the same number from every language, and rates adapt to the gradients' moments."""
    languages = sorted(set(labels))
    net = fresh(languages, hidden)
    if len(languages) < 2:
        return net
    code = {lang: i for i, lang in enumerate(languages)}
    label = np.array([code[x] for x in labels])
    size = np.array([len(w) for w in windows])
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(windows), dtype=np.uint8)
    of = [np.flatnonzero(label == c) for c in range(len(languages))]
    rng = np.random.default_rng(1)
    parameters = net.parameters()
    first, second = ([np.zeros_like(p) for p in parameters] for _ in range(2))
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(rows, max(1, lanes // len(languages))) for rows in of])
        pick = pick[np.argsort(-size[pick], kind="stable")]
        _, grads = loss_and_gradients(net, data, start[pick], size[pick], label[pick])
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
        now = rate * min(1.0, 2 * (1 - (step - 1) / steps)) * np.sqrt(1 - 0.99 ** step) / (1 - 0.9 ** step)
        for p, g, m, v in zip(parameters, grads, first, second):
            g = g * min(1.0, 1.0 / max(norm, 1e-12))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (now * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
    return net


# -- documents -----------------------------------------------------------------------------------------------------------


def cut(size: np.ndarray, most: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of windows of up to ``most`` bytes that cover texts of these sizes, equal in length but for one byte."""
    pieces = -(-size // most)
    text = np.repeat(np.arange(len(size)), pieces)
    number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin, end = number * size[text] // pieces[text], (number + 1) * size[text] // pieces[text]
    return text, (np.cumsum(size) - size)[text] + begin, end - begin


def document_probabilities(net: Network, texts: pa.Array) -> np.ndarray:
    """Mean over all positions of a text of its labels' probabilities, (text, language); zero for an empty one."""
    data, bounds = text_bytes(texts)
    size = np.diff(bounds)
    text, start, length = cut(size)
    order = np.argsort(-length, kind="stable")
    total = np.zeros((len(texts), len(net.languages)))
    for i in range(0, len(order), LANES):
        at = order[i:i + LANES]
        prob, mask = position_probabilities(net, data, start[at], length[at])
        prob *= mask[:, None]
        np.add.at(total, text[at], prob.sum(axis=0).T)
    return total / np.maximum(1, size)[:, None]


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: 5 divides the crc32 of the id as text (never for null ids)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, per_language: int = 400, max_rows: int = 8000, windows: int = 4, size: int = 64, **settings) -> Network:
    """Fit on a bounded sample of the documents with an id and a language that are not held out.

    Of each language the ``per_language`` first in the order of a hash of their id are taken, ``max_rows`` in all, and of each text ``windows`` evenly
    spaced windows of ``size`` bytes, cut by the tasks; an id with several texts in a language gives one of them. The driver gets these bytes
    and nothing else. Languages that are in no sampled row are not learned.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = known.select("doc_id", "lang").distinct().withColumn("h", F.xxhash64("doc_id"))
    some = top_n(ids, ["lang"], [F.asc("h"), F.asc("doc_id")], per_language, per_language, spread=("doc_id",))
    picked = materialize(some.orderBy("rank", "h", "doc_id", "lang").limit(max_rows).select("doc_id", "lang"))
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("pieces", pa.list_(pa.binary()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, limit=TEXT_BLOCK):
            data, bounds = text_bytes(part.column(1))
            pieces = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                step = max(size, (b - a) // windows)
                pieces.append([data[s:min(s + size, b)].tobytes() for s in list(range(a, b, step))[:windows]])
            yield batch_of(schema, part.column(0), part.column(2), pieces)

    texts = known.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").join(F.broadcast(picked), ["doc_id", "lang"])
    cut_ = texts.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, lang string, pieces array<binary>")
    one = cut_.groupBy("doc_id", "lang").agg(F.max("pieces").alias("pieces")).select("doc_id", "lang", F.explode("pieces").alias("piece"))
    got = one.orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "piece").limit(max_rows * windows).toArrow()
    return fit(got["piece"].to_pylist(), got["lang"].to_pylist(), **settings)


OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each document from its whole text alone.

    Every byte is labelled once, in windows of ``WINDOW`` bytes; the score is the mean probability of the predicted language (of
    equal ones the first by name). Texts that are null or hold no letter are ``und`` with score 0, and so are all if no language was
    learned. Repeated rows and null ids come out as they went in; other columns are ignored. One pass, no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for part in blocks(batches, limit=TEXT_BLOCK):
            texts = part.column(1)
            lettered = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
            names, score = np.full(part.num_rows, UNDETERMINED, dtype=object), np.zeros(part.num_rows)
            at = np.flatnonzero(lettered) if net.languages else np.zeros(0, np.int64)
            if len(at):
                prob = document_probabilities(net, texts.take(pa.array(at)))
                best = prob.argmax(axis=1)
                names[at], score[at] = np.array(net.languages, dtype=object)[best], np.clip(prob[np.arange(len(at)), best], 0, 1)
            yield batch_of(OUT, part.column(0), pa.array(names.tolist(), pa.string()), score)
            pa.default_memory_pool().release_unused()

    done = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
