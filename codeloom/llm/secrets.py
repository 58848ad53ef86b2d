"""Secret scans: fixed forms of credentials, and strings in a sensitive context that a primed compressor can't shorten."""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import words as W
from codeloom.llm.arrow import mapped

KINDS = ("assign", "access", "hex", "novel")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"
MASK = "[secret]"

# The forms of the base rules, on bytes (so that letter case means ASCII letters only).
_ASSIGN = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
MIN_ASSIGN, MIN_ACCESS = 8, 16

#: Words that make the rest of their line a sensitive context.
CONTEXT = (b"passw", b"pwd", b"secret", b"token", b"apikey", b"api_key", b"api-key", b"auth", b"bearer", b"credential", b"private_key", b"private key", b"signature", b"access_key")
MIN_NOVEL = 16
#: Compressed bytes a byte that make a string novel, or the share of what a random string of its length and letters has, if that is less.
NOVELTY, RANDOM_SHARE = 0.75, 0.9
SURROUNDING = 2048
#: Identifiers common in code, which prime the compressor: a string made of them is no secret.
IDENTIFIERS = (
    b"access_token refresh_token id_token authorization_code client_secret client_id grant_type password_hash"
    b" password_reset_token csrf_token session_token api_key_header secret_key_base private_key_path public_key"
    b" auth_token_provider Authorization Bearer Content-Type application/json application/x-www-form-urlencoded"
    b" getElementById addEventListener createElement configuration environment production development localhost"
    b" 127.0.0.1 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ example placeholder changeme"
    b" your_api_key_here your-secret-here xxxxxxxxxxxxxxxxxxxxxxxx 00000000-0000-0000-0000-000000000000 deadbeef"
)
#: A whole run, and what follows it after dots.
_WORD_AFTER = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}+(?:\.[A-Za-z0-9+/_=-]+)*+" % MIN_NOVEL)
#: A value between quotes, with whatever marks it holds, and a line that is one value, quoted, listed or indented at most.
_QUOTED = re.compile(rb"\"[^\"\s]{%d,}+\"|'[^'\s]{%d,}+'" % (MIN_NOVEL, MIN_NOVEL))
_VALUE_LINE = re.compile(rb"[ \t]*+(?:- )?[\"']?[A-Za-z0-9+/_=.-]{%d,}+[\"']?[,;]?[ \t\r]*+(?=\n|\Z)" % MIN_NOVEL)
_ALPHABETS = (b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_HEXES = (b"0123456789abcdef", b"0123456789ABCDEF")
_CONTEXT = re.compile(rb"(?i:" + b"|".join(re.escape(c) for c in CONTEXT) + rb")")

_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True


def _hex_rows(part: W.Slice) -> np.ndarray:
    """Documents that may hold 32 hex digits in a row: eight in a row at every fourth place."""
    fourth = _IS_HEX[part.data[: part.offsets[-1] : 4]]
    if len(fourth) < 8:
        return np.arange(part.last - part.first)
    all_eight = fourth[: len(fourth) - 7].copy()
    for k in range(1, 8):
        all_eight &= fourth[k : len(fourth) - 7 + k]
    at = np.flatnonzero(all_eight) * 4
    return np.unique(np.searchsorted(part.offsets, at, "right") - 1)


def base_spans(text: bytes, hexes: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base forms, in bytes."""
    lower, found = text.lower(), []
    if any(w in lower for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_ASSIGN]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if hexes:
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def novelty(candidate: bytes, surrounding: bytes) -> float:
    """Marginal compressed bytes a byte of candidate, after a dictionary of identifiers and the surrounding text."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b"\n" + surrounding, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    return (len(packer.compress(candidate)) - len(packer.compress(b""))) / len(candidate)


def alphabet(candidate: bytes) -> bytes:
    """The letters that candidate is drawn from: hex digits, or its classes of letters with the marks that it holds."""
    own = set(candidate)
    for hexes in _HEXES:
        if own <= set(hexes):
            return hexes
    held = b"".join(x for x in _ALPHABETS if own & set(x))
    return held + bytes(sorted(own - set(held)))


@functools.lru_cache(4096)
def _least(letters: bytes, size: int) -> float:
    """The novelty from which a string of a size over letters counts as random."""
    drawn = np.frombuffer(letters, np.uint8)[np.random.default_rng(size).integers(0, len(letters), size)]
    return min(NOVELTY, RANDOM_SHARE * novelty(drawn.tobytes(), b""))


def _contexts(text: bytes) -> list[tuple[int, int]]:
    """(start, end) of the stretches that a context word opens: the rest of its line, and lines behind it that are one value each,
    such as those of a key block."""
    found: list[tuple[int, int]] = []
    for m in _CONTEXT.finditer(text):
        if found and m.start() < found[-1][1]:
            continue
        line = text.find(b"\n", m.end())
        end = line if line >= 0 else len(text)
        while end < len(text) and (value := _VALUE_LINE.match(text, end + 1)):
            end = value.end()
        found.append((m.end(), end))
    return found


def _candidates(text: bytes) -> list[tuple[int, int, bool]]:
    """(start, end, quoted) of the quoted values and the runs in sensitive contexts, and of the parts of a run between context words.

    The parts of a run don't overlap, so that what is judged grows with the text.
    """
    found: set[tuple[int, int, bool]] = set()
    for start, end in _contexts(text):
        for m in _QUOTED.finditer(text, start, end):
            found.add((m.start() + 1, m.end() - 1, True))
        for m in _WORD_AFTER.finditer(text, start, end):
            found.add((*m.span(), False))
            inner = list(_CONTEXT.finditer(text, m.start(), m.end()))
            for k, word in enumerate(inner):
                behind = inner[k + 1].start() if k + 1 < len(inner) else m.end()
                if part := _WORD_AFTER.search(text, word.end(), behind):
                    found.add((*part.span(), False))
    return sorted(found, key=lambda c: (c[0], -c[1]))


def novel_spans(text: bytes, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of strings in a sensitive context that hold letters and digits and stay incompressible.

    A run that the known spans leave less than MIN_NOVEL bytes of is not reported again; a quoted value is, if they leave
    any of it.
    """
    lower = text.lower()
    if not any(c in lower for c in CONTEXT):
        return []
    spans: list[tuple[int, int, int]] = []
    passed, reach = 0, 0  # known spans that end in front of every candidate to come, and how far they reach
    for a, b, quoted in _candidates(text):
        word = text[a:b]
        if spans and a < spans[-1][2]:
            continue
        while passed < len(known) and known[passed][2] <= a:
            reach = max(reach, known[passed][2])
            passed += 1
        left, at = 0, max(a, reach)
        for s, _, e in known[passed:]:
            if s >= b:
                break
            left += max(0, s - at)
            at = max(at, e)
        if left + max(0, b - at) < (1 if quoted else MIN_NOVEL):
            continue
        if not (re.search(rb"[0-9]", word) and re.search(rb"[A-Za-z]", word)):
            continue
        around = text[max(0, a - SURROUNDING) : a] + b"\n" + text[b : b + SURROUNDING]
        if novelty(word, around) >= _least(alphabet(word), len(word)):
            spans.append((a, 3, b))
    return spans


def _found(part: W.Slice, row: int, hexes: set[int]) -> tuple[bytes, list[tuple[int, int, int]]]:
    text = part.text(row)
    base = base_spans(text, row in hexes)
    return text, sorted(base + novel_spans(text, base))


def _points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets as offsets in code points."""
    if not spans:
        return spans
    before = np.zeros(len(text) + 1, np.int64)
    np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, out=before[1:])
    return [(int(before[a]), kind, int(before[b])) for a, kind, b in spans]


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batch: pa.RecordBatch) -> dict:
    out: dict[str, list] = {n: [] for n in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")}
    for part in W.slices(batch.column("text"), words=False):
        hexes = set(_hex_rows(part).tolist())
        for row in range(part.last - part.first):
            spans = _points(*_found(part, row, hexes))
            kinds = [k for _, k, _ in spans]
            for name, kind in (("n_assign", 0), ("n_access", 1), ("n_hex", 2), ("n_novel", 3)):
                out[name].append(kinds.count(kind))
            base = _written([s for s in spans if s[1] < 3])
            out["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
            out["spans"].append(_written(spans))
    return {"doc_id": batch.column("doc_id"), **out}


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans (`kind:start:end`, in code points) of every row of docs.

    A null or empty text has no spans (the digest is that of an empty string). Repeated rows are scanned alike; other
    columns are left out.
    """
    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _scan, SCHEMA)


def _masked(batch: pa.RecordBatch) -> dict:
    out = []
    for part in W.slices(batch.column("text"), words=False):
        hexes = set(_hex_rows(part).tolist())
        for row in range(part.last - part.first):
            text, spans = _found(part, row, hexes)
            pieces, at = [], 0
            for a, _, b in spans:
                if a >= at:
                    pieces += [text[at:a], MASK.encode()]
                at = max(at, b)
            out.append((b"".join(pieces) + text[at:]).decode() if spans else text.decode())
    texts = pa.array(out, pa.string())
    if batch.column("text").null_count:
        texts = pa.compute.if_else(batch.column("text").is_null(), pa.scalar(None, pa.string()), texts)
    rest = {n: batch.column(n) for n in batch.schema.names if n != "text"}
    return rest | {"text": texts}


def masked(docs: DataFrame) -> DataFrame:
    """docs with each secret (overlapping ones as one) replaced by MASK in text; all rows and columns stay."""
    return mapped(docs.withColumn("text", F.col("text").cast("string")), _masked, docs.schema)
