"""Plain one-row-at-a-time versions of the text operators, to hold the distributed ones against."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def fingerprint(text, size=3):
    w = words(lower(text or ""))
    grams = [" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups(n, linked):
    label = list(range(n))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in linked:
        a, b = find(i), find(j)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_duplicates(rows):
    """[(doc_id, fingerprint, component)] of (doc_id, text) rows."""
    fp = [fingerprint(t) for _, t in rows]
    root = groups(len(rows), ((i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2))
    least = defaultdict(list)
    for (d, _), r in zip(rows, root):
        least[r].append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in least.items()}
    return [(d, f"{f:016x}", least[r]) for (d, _), f, r in zip(rows, fp, root)]


def dedup_lines(rows):
    """{(doc_id, text): removed line numbers} of (doc_id, text) rows."""
    every = []
    for doc, text in {r for r in rows if r[0] is not None and r[1] is not None}:
        own = xxhash.xxh64_intdigest(text.encode(), 42) & ((1 << 20) - 1)
        for n, line in enumerate(text.split("\n")):
            tokens = frozenset(words(lower(line)))
            if tokens:
                every.append(((doc, n, own), text, tokens))
    every.sort(key=lambda x: x[0])
    out = {r: [] for r in rows}
    by_token = defaultdict(list)
    for i, ((doc, n, _), text, tokens) in enumerate(every):
        seen = set()
        for t in tokens:
            seen.update(by_token[t])
        if any(5 * len(tokens & every[j][2]) >= 4 * len(tokens | every[j][2]) for j in seen):
            out[doc, text].append(n)
        for t in tokens:
            by_token[t].append(i)
    return {k: sorted(v) for k, v in out.items()}


def rules(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    count = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if count[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


def repeated_chars(text, size):
    """Characters of words inside n-grams that repeat an earlier one."""
    w, seen, inside = words(text or ""), set(), set()
    for i in range(len(w) - size + 1):
        g = tuple(w[i:i + size])
        if g in seen:
            inside.update(range(i, i + size))
        seen.add(g)
    return sum(len(w[i]) for i in inside)


def base_secrets(text):
    text = text or ""
    found = []
    for kind, pattern, ok in (
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        found += [(m.start(), ("assign", "access", "hex").index(kind), m.end(), kind) for m in re.finditer(pattern, text) if ok(m)]
    found.sort()
    spans = [f"{k}:{s}:{e}" for s, _, e, k in found]
    n = Counter(k for *_, k in found)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(spans).encode()).hexdigest(), spans


def crc32(text):
    return zlib.crc32((text or "").encode())
