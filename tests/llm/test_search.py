"""Ranked search against scoring every document, on made tables with ties, long lists and awkward rows."""

import math
import random
import re

import numpy as np
import pytest

from spectrafold.llm import search

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """{item_id: [(doc_id, score)]} of (doc_id, text) and (item_id, text) rows."""
    spelled = [(d, terms(t)) for d, t in docs]
    n_docs, n_terms = sum(1 for _, ts in spelled if ts), sum(len(ts) for _, ts in spelled)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    df = {}
    for _, ts in spelled:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = {}
    for i, its in asked.items():
        scored = []
        for d, ts in spelled:
            if d is None:
                continue
            score = 0
            for t in its & set(ts):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 90 + (90 * len(ts) * n_docs) // n_terms
                score += w * ((1000000000 * ts.count(t)) // (1000 * ts.count(t) + 8 * m))
            if score > 0:
                scored.append((-score, d))
        if scored:
            out[i] = [(d, -s) for s, d in sorted(scored)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["item_id"], r["rank"])):
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


def tables(spark, docs, items, slices=3):
    d = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in docs], "doc_id long, text string, lang string, n int, term int, tf int").repartition(slices)
    i = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, score string, rank int").repartition(2)
    return d, i


@pytest.mark.parametrize("width", [64, 1 << 15])
def test_made_tables(spark, monkeypatch, width):
    monkeypatch.setattr(search, "BLOCK_CELLS", width * 100)
    monkeypatch.setattr(search, "FIRST_DEPTH", 2)
    rng = random.Random(4)
    words = [f"W{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(250)]
    docs = [(i, t) for i, t in enumerate(texts + texts[:120])]  # copies tie
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for i in range(30)] + [(31, texts[0]), (32, texts[1][:30])]
    d, i = tables(spark, docs, items)
    want = brute(docs, items)
    assert found(search.search(d, i)) == want
    monkeypatch.setattr(search, "MAX_TERMS", 20)  # several passes
    assert found(search.search(d, i, k=3)) == {k: v[:3] for k, v in want.items()}


ROWS = [(1, None), (2, ""), (3, " \n!?"), (4, "One two"), (4, "One two"), (4, "three"), (None, "one two three"), (5, "ONE two é_ü \x00 _ x1"),
        (6, "one " * 3000), (7, "y" * 100_000), (8, "日本 é"), (9, "two,two;two"), (10, "ſtrange İ ONE"), (-3, "two one")]
ITEMS = [(1, "one TWO"), (1, "three"), (2, None), (3, ""), (None, "one"), (4, "absent"), (5, "日本"), (6, "é"), (7, "y" * 100_000), (8, "one one two"), (9, "!!")]


def test_awkward_rows(spark):
    d, i = tables(spark, ROWS, ITEMS)
    assert found(search.search(d, i)) == brute(ROWS, ITEMS)


def test_empty_tables(spark):
    d, i = tables(spark, ROWS, ITEMS)
    for a, b in ((d.limit(0), i), (d, i.limit(0)), (d.limit(0), i.limit(0)), (d.where("doc_id = 1"), i)):
        got = search.search(a, b)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_the_search_stops_before_the_end():
    """With one list that falls steeply the bound drops below the kth score after a few steps, and no document beyond is read."""
    n = 5000
    ids = np.arange(n)
    impact = np.concatenate((np.arange(20, 0, -1) * 1000, np.ones(n - 20, np.int64)))
    lists = search.ImpactLists(ids, np.concatenate((ids, ids)), np.repeat([0, 1], n), np.concatenate((impact, impact[::-1])), 2)
    looked = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            out = super().__getitem__(at)
            looked.append(np.size(out))
            return out

    lists.position = lists.position.view(Watched)
    score, got = lists.search(np.array([0, 1]), np.zeros(0, np.int64), np.zeros(0, np.int64), 10)
    every = np.array(impact) + np.array(impact[::-1])
    order = np.lexsort((ids, -every))[:10]
    assert got.tolist() == ids[order].tolist() and score.tolist() == every[order].tolist()
    assert sum(looked) < n / 10


def test_ties_beyond_the_kth_are_seen():
    """All scores are equal: the bound is never below the kth, so the smallest ids are found wherever they stand."""
    ids = np.random.default_rng(0).permutation(3000)
    lists = search.ImpactLists(ids, np.arange(3000), np.zeros(3000, np.int64), np.full(3000, 7), 1)
    score, got = lists.search(np.array([0]), np.zeros(0, np.int64), np.zeros(0, np.int64), 10)
    assert got.tolist() == list(range(10)) and set(score.tolist()) == {7}
