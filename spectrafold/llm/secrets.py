"""Secrets in texts: plain patterns, and encoded keys and tokens that are reported only when their structure parses."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .blocks import batch_of, blocks

# The kinds in the order in which equal starts are listed, and the plain patterns.
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt", "nested")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of HEX that are long enough

_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([^-]*(?:-(?!----)[^-]*)*)-----END \1-----")
_DOTTED = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\.?")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
_HEX_RUN = re.compile(r"(?:[0-9a-f]{2}){16,}|(?:[0-9A-F]{2}){16,}")
_HEX_PART = re.compile(r"(?:0x)?([0-9a-f]{32,}|[0-9A-F]{32,})")
# Base64 over several lines: full ones of one length, then a last one that is not longer. Each may be indented or quoted.
_FULL_LINE = re.compile(r"[A-Za-z0-9+/_-]{24,}")
_LAST_LINE = re.compile(r"[A-Za-z0-9+/_-]*={0,2}")
_BREAK = re.compile(r"(?:\r?\n|\\r\\n|\\n)[\x20\t>]*")

# Texts without any of these hold no span; they are not looked at by Python.
_WORTH = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/_-]{24}|-----BEGIN|eyJ"

_SSH_MAGIC = b"openssh-key-v1\0"


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the nested values that fill data[at:end] exactly, None if they do not."""
    out = []
    while at < end:
        if end - at < 2:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or end - at < n:
                return None
            size = int.from_bytes(data[at:at + n], "big")
            at += n
        if end - at < size:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """Whether the bytes are one of the DER encodings of a private key, every nested length included."""
    outer = _children(data, 0, len(data)) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    parts = _children(data, *outer[0][1:])
    if not parts:
        return False
    tags = [p[0] for p in parts]
    if tags[0] == 0x02:
        version = data[parts[0][1]:parts[0][2]]
        if version not in (b"\0", b"\1"):
            return False
        if len(tags) >= 6 and set(tags) == {0x02}:  # the integers of an RSA or DSA key
            return all(e > s for _, s, e in parts)
        if tags[1] == 0x04 and version == b"\1":  # an elliptic-curve key
            return parts[1][2] - parts[1][1] >= 16 and all(t in (0xA0, 0xA1) and _children(data, s, e) for t, s, e in parts[2:])
        if tags[1:3] == [0x30, 0x04]:  # a wrapped key: algorithm, then the key itself
            return _is_algorithm(data, parts[1])
        return False
    return tags == [0x30, 0x04] and _is_algorithm(data, parts[0])  # an encrypted wrapped key


def _is_algorithm(data: bytes, part: tuple[int, int, int]) -> bool:
    inner = _children(data, part[1], part[2])
    return bool(inner) and inner[0][0] == 0x06 and inner[0][2] - inner[0][1] >= 3


def is_ssh_key(data: bytes) -> bool:
    """Whether the bytes are an OpenSSH private key: the magic, then strings whose lengths fit."""
    if not data.startswith(_SSH_MAGIC):
        return False
    at = len(_SSH_MAGIC)
    for _ in range(3):  # cipher, key derivation, its options
        at = _string_end(data, at)
        if at is None:
            return False
    if len(data) - at < 4:
        return False
    keys = int.from_bytes(data[at:at + 4], "big")
    at += 4
    if not 1 <= keys <= 64:
        return False
    for _ in range(keys + 1):  # public keys, then the private part
        at = _string_end(data, at)
        if at is None:
            return False
    return at == len(data)


def _string_end(data: bytes, at: int) -> int | None:
    if len(data) - at < 4:
        return None
    end = at + 4 + int.from_bytes(data[at:at + 4], "big")
    return end if end <= len(data) else None


def from_base64(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(token: str) -> bool:
    """Whether header and claims of a three-part token are JSON objects and the header names its algorithm."""
    head, claims = (_json(from_base64(p)) for p in token.split(".")[:2])
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(claims, dict)


def _json(data: bytes | None):
    try:
        return json.loads(data.decode("utf-8")) if data else None
    except (ValueError, RecursionError):
        return None


def _base(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return out


def confirmed(data: bytes | None, depth: int = 2) -> str | None:
    """The kind of secret that decoded bytes are, None if they have no such structure."""
    if not data or len(data) < 12:
        return None
    if is_der_key(data):
        return "der"
    if is_ssh_key(data):
        return "ssh"
    try:
        text = data.decode("ascii")
    except UnicodeDecodeError:
        return None
    if not all(c.isprintable() or c in "\r\n\t" for c in text):
        return None
    if any(kind != "hex" for _, _, kind in _base(text)) or any(is_signed_token(m[0]) for m in _JWT.finditer(text)):
        return "nested"
    if _PEM.search(text):
        return "nested"
    inner = "".join(text.split())
    if depth > 1 and _RUN.fullmatch(inner):
        return "nested" if confirmed(_decoded(inner), depth - 1) or confirmed(from_base64(inner), depth - 1) else None
    return None


def _decoded(run: str) -> bytes | None:
    if _HEX_RUN.fullmatch(run):
        return bytes.fromhex(run)
    return None


def _wrapped(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, joined) of the base64 or hex bodies that go over several lines, all but the last of one length."""
    at = 0
    while m := _FULL_LINE.search(text, at):
        at, lines, width = m.end(), [m[0]], len(m[0])
        while gap := _BREAK.match(text, at):
            full = _FULL_LINE.match(text, gap.end())
            if full and len(full[0]) == width and not text.startswith("=", full.end()):
                lines.append(full[0])
                at = full.end()
                continue
            last = _LAST_LINE.match(text, gap.end())
            if last[0] and len(last[0]) <= width:
                yield m.start(), last.end(), "".join(lines) + last[0]
            break
        if len(lines) > 1:  # what follows a body that ends with a full line may be a word
            yield m.start(), at, "".join(lines)


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Where ``eyJ..., a dot, eyJ..., a dot, anything`` stands: dotted runs are read once each, from their first ``eyJ``."""
    at = text.find("eyJ")
    while at >= 0:
        run = _DOTTED.match(text, at)
        parts, i = run[0].split("."), 0
        while i + 2 < len(parts):
            head = parts[i].find("eyJ")
            if head >= 0 and head + 3 < len(parts[i]) and len(parts[i + 1]) > 3 and parts[i + 1].startswith("eyJ"):
                whole = sum(len(x) + 1 for x in parts[i:i + 3]) - 1
                yield at + head, at + whole
                at, i = at + whole + 1, i + 3
            else:
                at, i = at + len(parts[i]) + 1, i + 1
        at = text.find("eyJ", run.end())


def _inside(spans: list[tuple[int, int]]):
    """Whether a place lies inside any of the spans, by halving."""
    spans = sorted(spans)
    starts, ends = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))

    def told(place: int) -> bool:
        i = bisect_right(starts, place)
        return i > 0 and place < ends[i - 1]

    return told


def spans_of(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) as (start, end, kind) in code points, in order."""
    rank = {k: i for i, k in enumerate(KINDS)}
    base = sorted(_base(text), key=lambda s: (s[0], rank[s[2]]))
    more, taken = [], []
    for m in _PEM.finditer(text):
        body = "".join(x for x in re.split(r"\\n|\s+", m[2]) if x and ":" not in x and "," not in x)
        data = from_base64(body)
        if data and (is_der_key(data) or is_ssh_key(data) or "ENCRYPTED" in m[2]):
            more.append((m.start(), m.end(), "pem"))
            taken.append((m.start(), m.end()))
    for start, end in _tokens(text):
        if is_signed_token(text[start:end]):
            more.append((start, end, "jwt"))
            taken.append((start, end))
    inside, reached = _inside(taken), -1
    for start, end, body in _wrapped(text):
        kind = None if start < reached or inside(start) else confirmed(_decoded(body)) or confirmed(from_base64(body))
        if kind:
            more.append((start, end, kind))
            taken.append((start, end))
            reached = max(reached, end)
    inside = _inside(taken)
    for m in _RUN.finditer(text):
        if inside(m.start()):
            continue
        kind = confirmed(_decoded(m[0])) or confirmed(from_base64(m[0]))
        if kind:
            more.append((m.start(), m.end(), kind))
            continue
        for h in _HEX_PART.finditer(m[0]):  # hex behind 0x or between other characters of the run
            odd = len(h[1]) % 2
            kind = confirmed(bytes.fromhex(h[1][odd:]))
            if kind:
                more.append((m.start() + (h.start(1) + 1 if odd else h.start()), m.start() + h.end(), kind))
    return base, sorted(base + more, key=lambda s: (s[0], rank[s[2]], s[1]))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
    ("base_sha256", pa.string()), ("spans", pa.string()),
])
DDL = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document: counts of the plain kinds, a digest of their spans, and all spans.

    A span is ``kind:start:end`` in code points of the whole match. Besides the plain kinds there are private keys
    in PEM (``pem``), DER (``der``) or OpenSSH form (``ssh``), signed tokens (``jwt``), and base64 or hex runs
    that decode to a text which itself holds a secret (``nested``, two layers deep). A run may be wrapped at one
    length, and hex may stand behind ``0x``. A null text counts as empty; a text without a
    secret has counts of 0, the digest of nothing and an empty list; repeated rows and null ids come out as they
    went in; other columns are ignored. One pass, no shuffle.
    """
    nothing = hashlib.sha256(b"").hexdigest()

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            n = part.num_rows
            counts = {k: [0] * n for k in KINDS[:3]}
            digest, spans = [nothing] * n, [""] * n
            for i in _worth(part.column(1)):
                base, every = spans_of(part.column(1)[i].as_py())
                if base:
                    digest[i] = hashlib.sha256(listed(base).encode()).hexdigest()
                    for _, _, kind in base:
                        counts[kind][i] += 1
                spans[i] = listed(every)
            yield batch_of(SCHEMA, part.column(0), *counts.values(), digest, spans)

    return docs.select("doc_id", "text").mapInArrow(find, DDL)


def _worth(texts: pa.Array) -> list[int]:
    return pc.indices_nonzero(pc.match_substring_regex(texts, _WORTH)).to_pylist()


def redacted(text: str) -> str:
    """The text with every secret replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for start, end, kind in sorted(spans_of(text)[1], key=lambda s: (s[0], -s[1])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents, all columns, with their secrets replaced. Null texts stay null."""
    if text == "row":
        raise ValueError("the text column may not be named row")

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = batch.column(at).to_pylist()
            for i in _worth(pc.fill_null(batch.column(at), "")):
                texts[i] = redacted(texts[i])
            yield batch.set_column(at, text, pa.array(texts, type=batch.column(at).type))

    # Only the text travels beside the packed row, so that other columns may have any name.
    one = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias(text))
    done = one.mapInArrow(clean, one.schema)
    return done.select(*[F.col(text).alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
