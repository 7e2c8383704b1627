"""The recurrent network against plain loops and differences, and the query's labels against the given languages."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from spectrafold.llm import language, queries


def double(net):
    cells = tuple(language.Cell(*(p.astype(np.float64) for p in (c.byte, c.state, c.bias))) for c in net.cells)
    return language.Network(net.languages, cells, net.out.astype(np.float64), net.out_bias.astype(np.float64))


def bent(x):
    return x / (1 + np.abs(x))


def plain_states(cell, text):
    """One byte at a time."""
    h, out = np.zeros(len(cell.bias)), []
    for b in text:
        update = 0.5 + 0.5 * bent(cell.byte[0, b] + h @ cell.state[0])
        reset = 0.5 + 0.5 * bent(cell.byte[1, b] + h @ cell.state[1])
        new = bent(cell.byte[2, b] + reset * (h @ cell.state[2] + cell.bias))
        h = (1 - update) * new + update * h
        out.append(h)
    return out


def plain_labels(net, text):
    """Probabilities at every position of one window."""
    ahead, behind = plain_states(net.cells[0], text), plain_states(net.cells[1], text[::-1])[::-1]
    out = []
    for a, b in zip(ahead, behind):
        x = a @ net.out[0] + b @ net.out[1] + net.out_bias
        out.append(np.exp(x - x.max()) / np.exp(x - x.max()).sum())
    return np.array(out)


def plain_document(net, text):
    data = text.encode()
    pieces = -(-len(data) // language.WINDOW)
    cuts = [i * len(data) // pieces for i in range(pieces + 1)]
    return np.concatenate([plain_labels(net, data[a:b]) for a, b in zip(cuts, cuts[1:])]).mean(axis=0)


def test_windows_cover_every_byte_once():
    size = np.array([0, 1, 127, 128, 129, 1000, 0, 3])
    text, start, length = language.cut(size)
    assert length.max() <= 128 and length.min() >= 1
    covered = np.concatenate([np.arange(s, s + n) for s, n in zip(start, length)])
    assert covered.tolist() == list(range(size.sum()))
    assert np.bincount(text, length, len(size)).tolist() == size.tolist()


def test_documents_equal_plain_loops(monkeypatch):
    monkeypatch.setattr(language, "LANES", 7)
    rng = np.random.default_rng(5)
    net = language.fresh(["a", "b", "c"], 6)
    for c in net.cells:
        c.bias[:] = rng.standard_normal(6)
    texts = ["".join(chr(rng.integers(32, 500)) for _ in range(n)) for n in (1, 5, 100, 127, 128, 129, 700, 60, 3)]
    got = language.document_probabilities(net, pa.array(["", *texts]))
    assert got[0].tolist() == [0, 0, 0]
    for g, t in zip(got[1:], texts):
        assert np.abs(g - plain_document(double(net), t)).max() < 1e-4


def test_gradients_equal_differences():
    net = double(language.fresh(["a", "b", "c"], 4))
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 100).astype(np.uint8)
    given = data, np.array([0, 20, 35, 50]), np.array([12, 9, 9, 1]), np.array([0, 2, 1, 1])
    _, grads = language.loss_and_gradients(net, *given)
    for p, g in zip(net.parameters(), grads):
        flat, step = p.reshape(-1), 3e-3
        for i in np.argsort(-np.abs(g.reshape(-1)))[:4]:
            old, around = flat[i], []
            for e in (step, -step):
                flat[i] = old + e
                around.append(language.loss_and_gradients(net, *given)[0])
            flat[i] = old
            assert abs((around[0] - around[1]) / (2 * step) - g.reshape(-1)[i]) < 1e-4


def test_query_predicts_held_out_languages(spark, sf):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op13_language(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    held = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in got if r["held_out"]]
    assert np.mean(held) > 0.95


SCHEMA = "doc_id long, text string, lang string, score string, held_out int, piece string"


def test_awkward_documents(spark):
    long = "the house and the garden " * 40_000
    rows = [(1, "the house and the garden", "en"), (2, "das haus und der garten", "de"), (2, "das haus und der garten", "de"), (4, "der garten und das haus", "de"),
            (5, None, "en"), (6, "", "en"), (7, " 12 345 ***", "en"), (None, "the house", "en"), (8, "the garden", None), (9, "é", None),
            (10, long, "en"), (None, None, None), (13, "the the the and the", "en"), (11, "日本", None)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    net = language.train(df, steps=40, hidden=4)
    assert net.languages == ["de", "en"]
    out = language.predict(df, net)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = out.collect()
    assert sorted(r["doc_id"] or 0 for r in got) == sorted(r[0] or 0 for r in rows)
    named = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i in (5, 6, 7):
        assert (named[i]["lang_pred"], named[i]["score"]) == ("und", 0.0)
    assert all(named[i]["lang_pred"] in ("de", "en") and 0 < named[i]["score"] <= 1 for i in (1, 2, 4, 8, 9, 10, 11, 13))
    assert named[10]["lang_pred"] == "en"
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)


@pytest.mark.parametrize("rows", [[], [(1, "the house", "en", "", 0, "")], [(1, "the house", None, "", 0, "")]])
def test_none_or_one_language(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    net = language.train(df)
    got = language.predict(df, net).collect()
    want = {"en": ("en", 1.0), None: ("und", 0.0)}
    assert [(r["lang_pred"], r["score"]) for r in got] == [want[r[2]] for r in rows]


def test_the_sample_is_bounded(spark):
    df = spark.createDataFrame([(i // 50, f"text number {i}", "en" if i % 3 else "de") for i in range(3000)], "doc_id long, text string, lang string")
    seen = []
    original = language.fit
    language.fit = lambda w, l, **k: seen.append((len(w), set(l))) or original(w[:4], l[:4], steps=1)
    try:
        language.train(df, per_language=10, max_rows=15, windows=2, size=8)
    finally:
        language.fit = original
    assert seen[0][0] <= 30 and seen[0][1] == {"de", "en"}
