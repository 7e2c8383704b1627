"""Each stage of the pipeline against its brute-force version, on what its predecessor kept."""

import random

import brute
import pyarrow as pa
import pytest
from test_rows import awkward, check_pieces, key
from pyspark.sql import functions as F

import corpus_pipeline as C
from spectrafold.llm import queries, similar


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(C.STAGES):
        stage(spark, out[-1], sf).write.parquet(f"{folder}/{i}")
        out.append(spark.read.parquet(f"{folder}/{i}"))
    return out


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=key)


def test_columns_and_lengths(steps):
    for df in steps[1:5]:
        assert df.columns == list(C.COLUMNS)
    assert steps[3].where("n_chars <> char_length(text)").count() == steps[0].where("n_chars <> char_length(text)").count()


def test_classifier_drops_what_it_rejects(spark, sf, steps):
    scored = queries.op6_quality(spark, sf).where("predicted = 1").select("doc_id")
    assert sorted(r[0] for r in scored.collect()) == [d for d, _ in pairs(steps[1])]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = labels.where("quality = 1").join(steps[0], "doc_id", "left_semi").count()
    assert steps[1].join(labels.where("quality = 1"), "doc_id", "left_semi").count() >= 0.97 * good


def test_lines_and_emptied_documents(steps):
    rows = pairs(steps[1])
    gone = brute.dedup_lines(rows)
    want = []
    for d, t in rows:
        left = [x for n, x in enumerate(t.split("\n")) if n not in gone[d, t]]
        if left:
            want.append((d, "\n".join(left)))
    assert pairs(steps[2]) == sorted(want, key=key)


def test_one_of_each_near_duplicate_group(steps):
    rows = pairs(steps[2])
    keep = {c for _, _, c in brute.near_duplicates(rows)}
    assert pairs(steps[3]) == [(d, t) for d, t in rows if d in keep]


def test_near_duplicates_of_five_words(spark, sf):
    rng, rows = random.Random(11), [(900, None), (901, " "), (902, "three short words"), (903, "Three  SHORT words")]
    for g in range(12):
        text = [f"w{rng.randrange(9000)}" for _ in range(rng.choice([40, 300, 500]))]
        for c in range(12):
            own = list(text)
            for _ in range(rng.randrange(1 + len(own) // 30)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9000)}"
            rows.append((rng.randrange(800), " ".join(own)))
    rows = sorted({d: t for d, t in rows}.items())

    def grams(text):
        w = brute.words(brute.lower(text or ""))
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets, want, close = [grams(t) for _, t in rows], [], 0
    for i, (d, t) in enumerate(rows):
        like = [j for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
        close += bool(like)
        if not like:
            want.append((d, t))
    assert 20 < close < len(rows) - 20
    assert pairs(C.simhash_near_dedup(spark, awkward(spark, rows), sf)) == want


def test_fingerprints_come_before_the_exact_join(spark, sf, monkeypatch):
    """Near copies within two bits are settled by SimHash; the exact join gets them as known and finds the others."""
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    rows = [(d, " ".join(words(60))) for d in range(40)]
    long = words(3000)
    for d in range(40, 46):
        rows.append((d, " ".join([*long[:-1], f"x{d}"])))  # one shingle of 2996 differs
    base = words(60)
    far = [*base[:-4], *words(4)]  # 52 of 60 shingles
    rows += [(50, " ".join(base)), (51, " ".join(far)), (52, "Copy of A short text here"), (53, "copy of  a short text here")]
    docs = awkward(spark, rows)
    sets = similar.shingled(docs)
    by_bits = {r["doc"] for r in similar.linked_by_fingerprint(sets, (4, 5)).collect()}
    assert by_bits >= {41, 42, 43, 44, 45, 53} and by_bits <= {41, 42, 43, 44, 45, 51, 53}
    given, join = [], similar.matched_lines
    monkeypatch.setattr(similar, "matched_lines", lambda d, s, known: given.extend(r["doc"] for r in known.collect()) or join(d, s, known))
    left = {d for d, _ in pairs(C.simhash_near_dedup(spark, docs, sf))}
    assert set(given) == by_bits
    assert left == {d for d, _ in rows} - {41, 42, 43, 44, 45, 51, 53}


def test_fingerprints_are_majorities_of_shingle_bits():
    texts = pa.array(["a b c d e f a b c d e f g h", "", "one two", " "])
    value, first, words = similar._shingles(texts, 5)
    ends = [*first[1:].tolist(), len(value)]
    assert [e - f for f, e in zip(first.tolist(), ends)] == [10, 1, 1, 1] and words.tolist() == [14, 0, 2, 0]
    want = []
    for f, e, n in zip(first.tolist(), ends, words.tolist()):
        own = [int(v) for v in value[f:e]]
        want.append(sum((2 * sum(v >> b & 1 for v in own) > len(own)) << b for b in range(64)) if n else 0)
    assert similar._fingerprints(value, first, words).view("uint64").tolist() == want


def test_rows_of_one_id_are_kept_by_their_texts(spark, sf):
    one, other = "alpha beta gamma delta epsilon zeta", "an unrelated text that carries the same id by mistake"
    rows = [(4, one), (4, other), (4, one), (4, one.replace(" ", "  ")), (9, other.upper()), (3, "a third text of six words")]
    want = sorted([(3, rows[5][1]), (4, one.replace(" ", "  ")), (4, other)])
    for slices in (1, 3, 6):
        assert pairs(C.simhash_near_dedup(spark, awkward(spark, rows, slices), sf)) == want


def test_documents_without_an_id_are_compared_as_well(spark, sf):
    """They come after those with an id and, of two of them, in the order of a hash of their shingles."""
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    one, two, three = words(60), words(60), words(60)
    text = lambda w, last="": " ".join([*w[:-1], last or w[-1]])
    rows = [(7, text(one)), (None, text(one)), (None, text(one, "other")), (2**62, text(one, "last")),  # alike, the first has an id
            (None, text(two)), (None, text(two)), (None, text(two).upper()), (None, text(two, "other")),  # alike, none has one
            (None, text(three)), (None, None), (None, ""), (8, text(words(60)))]
    got = {slices: pairs(C.simhash_near_dedup(spark, awkward(spark, rows, slices), sf)) for slices in (1, 3, 6)}
    assert got[1] == got[3] == got[6]
    named, other = ([p for p in got[1] if (p[0] is None) == without] for without in (False, True))
    assert named == [rows[0], rows[11]]
    alike = [t for _, t in other if t and t.lower().startswith(text(two[:50]))]
    assert len(alike) == 1 and len(other) == 3
    assert (None, text(three)) in other and any(not t for _, t in other)


def test_rows_of_one_id_are_told_apart_by_whole_hashes(spark, sf):
    """Two texts under one id whose hashes agree in 20 bits: the copy of an earlier document goes, the other stays."""
    texts = [f"text number {i} of some that share a few bits" for i in range(6000)]
    mark = (similar._marks(*similar._shingles(pa.array(texts), 50)[:2]) & ((1 << 20) - 1)).tolist()
    seen = {}
    a, b = next((seen[m], i) for i, m in enumerate(mark) if seen.setdefault(m, i) != i)
    rows = [(1, texts[a]), (5, texts[a]), (5, texts[b])]
    left = similar.without_near_duplicates(awkward(spark, rows), 50)
    assert pairs(left) == [(1, texts[a]), (5, texts[b])]


def test_stages_take_texts_in_small_batches(spark, sf):
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for given, want in (("10000", 1000), ("0", 1000), ("50", 50)):
        spark.conf.set(rows, given)
        C.secret_scans(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
        assert int(spark.conf.get(rows)) == want
    spark.conf.unset(rows)


def test_secrets_are_gone_and_documents_stay(steps):
    before, after = dict(pairs(steps[3])), dict(pairs(steps[4]))
    assert before.keys() == after.keys()
    for d, t in after.items():
        assert brute.base_secrets(t)[:3] == (0, 0, 0)
        assert t == before[d] or brute.base_secrets(before[d])[:3] != (0, 0, 0)


def test_everything_is_packed(steps):
    from tokenizers import Tokenizer

    check_pieces(pairs(steps[4]), [r.asDict() for r in steps[5].collect()], Tokenizer.from_file(queries.packing_files()[0]), 1024)


def test_run_gives_the_last_stage(spark, sf, steps):
    assert C.run(spark, sf).agg(F.sum("length")).first()[0] == steps[5].agg(F.sum("length")).first()[0]


def test_awkward_rows_pass_every_stage(spark, sf):
    rows = [(1, None), (2, ""), (None, "words without an id " * 30), (4, "alpha beta gamma delta " * 3), (4, "alpha beta gamma delta " * 3), (5, "x" * 3000)]
    docs = awkward(spark, rows)
    for _, stage in C.STAGES[1:4]:
        out = stage(spark, docs, sf)
        assert out.columns == list(C.COLUMNS)
        assert out.where("doc_id IS NULL").count() == 1
    assert C.packed(spark, docs, sf).agg(F.sum("doc_tokens")).first()[0] > 0
    assert C.packed(spark, docs.limit(0), sf).count() == 0
