"""Byte-level BPE encoding and decoding of whole texts by a public rank file.

Two tiers: a minimal perfect hash holds the whole vocabulary and resolves every pre-token that is a token itself, for a
batch of pre-tokens at a time; a pre-token that is none is merged by a heap of adjacent pairs over linked bytes. Ranks
are read on the driver and broadcast (a vocabulary file, whatever the corpus).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm import words as W
from codeloom.llm.arrow import mapped

UNIT_BYTES = 4 << 20
CACHE_PIECES = 200_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

_OTHER, _LETTER, _DIGIT, _WHITE = range(4)
#: A space between two visible ASCII characters always starts a pre-token, so a text may be cut before it.
_CUT = re.compile(rb"(?<=[!-~]) (?=[!-~])")


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point, as the pre-token pattern tells them apart."""
    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_WHITE, r"\s+")):
        for found in regex.finditer(pattern, every):
            first, last = (at + 0x800 * (at >= 0xD800) for at in (found.start(), found.end() - 1))
            table[first : last + 1] = kind
    table[0xD800:0xE000] = _OTHER
    return table


def pre_tokens(points: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Which code points start a pre-token; fresh marks the first of each text.

    The matches of `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`, told from runs of
    one class: a run takes a space before it along, the rest of the white space is a match of its own.
    """
    n = len(points)
    kind = _classes()[points]
    runs = fresh.copy()
    runs[1:] |= kind[1:] != kind[:-1]
    starts = runs.copy()
    inner = ~fresh[1:]
    starts[1:] &= ~(runs[1:] & inner & (kind[1:] != _WHITE) & (points[:-1] == 0x20))
    starts[:-1] |= (kind[:-1] == _WHITE) & (kind[1:] != _WHITE) & inner  # the last of a white run before a visible one
    marks = np.flatnonzero((points == 0x27) & starts)
    if len(marks):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        border = np.concatenate([fresh, np.ones(3, bool)])
        one, two = padded[marks + 1], padded[marks + 2]
        same = ~border[marks + 1]
        short = marks[same & np.isin(one, [ord(c) for c in "stmd"])]
        long = marks[same & ~border[marks + 2] & np.isin(one * 0x200000 + two, [ord(a) * 0x200000 + ord(b) for a, b in ("re", "ve", "ll")])]
        starts[short + 1] = False
        starts[short[short + 2 < n] + 2] = True
        starts[long + 1] = False
        starts[long[long + 3 < n] + 3] = True
    return starts


class PerfectHash:
    """A minimal perfect hash of 64-bit names: as many slots as names, one displacement for each small bucket.

    A bucket's displacement moves all its names to free slots; the buckets of one name, placed last, hold their slot
    itself (as a negative number), so that every slot is used.
    """

    def __init__(self, names: np.ndarray):
        self.size = np.uint64(len(names))
        self.buckets = np.uint64(max(1, len(names) // 2))
        bucket = (W.mix(names) % self.buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=int(self.buckets))
        ends = np.cumsum(counts)
        self.moves = np.zeros(int(self.buckets), np.int64)
        self.slots = np.full(len(names), -1, np.int64)  # which name is in a slot
        taken = np.zeros(len(names), bool)
        for b in np.argsort(-counts, kind="stable"):
            own = order[ends[b] - counts[b] : ends[b]]
            if len(own) < 2:
                break
            move, found = 1, np.zeros(0, np.int64)
            while not len(found):  # 64 displacements at a time
                tried = np.arange(move, move + 64).astype(np.uint64)
                at = np.sort(self._at(names[own][None, :], tried[:, None]), axis=1)
                found = np.flatnonzero(~taken[at].any(axis=1) & (at[:, 1:] != at[:, :-1]).all(axis=1))
                move += 64
            self.moves[b] = tried[found[0]]
            at = self._at(names[own], tried[found[0] : found[0] + 1])
            taken[at] = True
            self.slots[at] = own
        free = iter(np.flatnonzero(~taken))
        for b in np.flatnonzero(counts == 1):
            at = next(free)
            self.moves[b] = -1 - at
            self.slots[at] = order[ends[b] - 1]

    def _at(self, names: np.ndarray, move) -> np.ndarray:
        return (W.mix(names + move * W.STEP) % self.size).astype(np.int64)

    def find(self, names: np.ndarray) -> np.ndarray:
        """For each name, the index of the only key that it can be."""
        move = self.moves[(W.mix(names) % self.buckets).astype(np.int64)]
        at = np.where(move < 0, -1 - move, self._at(names, move.astype(np.uint64)))
        return self.slots[at]


class Vocabulary:
    """Tokens by rank, their perfect hash, and the merges of pre-tokens that are no token."""

    def __init__(self, tokens: list[tuple[bytes, int]]):
        self.ranks = dict(tokens)
        keys = [t for t, _ in tokens]
        self.ids = np.array([r for _, r in tokens], np.uint32)
        data = np.frombuffer(b"".join(keys) + bytes(8), np.uint8)
        self.lengths = np.array([len(k) for k in keys], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.names = W.names(data, self.ends - self.lengths, self.ends)
        if len(np.unique(self.names)) < len(keys):
            raise ValueError("two tokens have one name")
        self.hash = PerfectHash(self.names)
        # for decoding: where the bytes of each id lie
        self.data = data
        self.of_id = np.full(int(self.ids.max()) + 1, -1, np.int64)
        self.of_id[self.ids] = np.arange(len(keys))
        self.pairs = {k: r for k, r in tokens if len(k) == 2}
        self.cache: dict[bytes, list[int]] = {}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls([(base64.b64decode(a), int(b)) for a, b in map(bytes.split, lines)])

    def merged(self, piece: bytes) -> list[int]:
        """The ids of a pre-token: the adjacent pair of the lowest rank, leftmost first, is joined until none is a token."""
        ranks, n = self.ranks, len(piece)
        after, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        pairs = self.pairs.get
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := pairs(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, left, end = heappop(heap)
            right = ends[left]  # 0 where left has been joined to what is before it
            if not right or right >= n or ends[right] != end:
                continue
            ends[left], ends[right] = end, 0
            follow = after[left] = after[right]
            if follow < n:
                before[follow] = left
                if (r := ranks.get(piece[left : ends[follow]])) is not None:
                    heappush(heap, (r, left, ends[follow]))
            back = before[left]
            if back >= 0 and (r := ranks.get(piece[back:end])) is not None:
                heappush(heap, (r, back, end))
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : ends[at]]])
            at = after[at]
        return out

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pre-tokens, and how many each has; data has eight bytes to spare."""
        names = W.names(data, starts, ends)
        key = self.hash.find(names)
        whole = (self.names[key] == names) & (self.lengths[key] == ends - starts)
        counts = np.ones(len(names), np.int64)
        missing = np.flatnonzero(~whole)
        if not len(missing):
            return self.ids[key], counts
        _, first, again = np.unique(names[missing], return_index=True, return_inverse=True)
        raw = data.tobytes()
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        cache, parts = self.cache, []
        for a, b in zip(starts[missing[first]].tolist(), ends[missing[first]].tolist(), strict=True):
            piece = raw[a:b]
            ids = cache.get(piece)
            if ids is None:
                ids = self.merged(piece)
                if b - a < 64:
                    cache[piece] = ids
            parts.append(ids)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter((i for ids in parts for i in ids), np.uint32, int(sizes.sum()))
        counts[missing] = sizes[again]
        at = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        out[at[whole]] = self.ids[key[whole]]
        sources = (np.cumsum(sizes) - sizes)[again]
        out[_spans(at[missing], sizes[again])] = flat[_spans(sources, sizes[again])]
        return out, counts

    def decode(self, ids: np.ndarray) -> bytes:
        key = self.of_id[ids]
        lengths = self.lengths[key]
        return self.data[_spans(self.ends[key] - lengths, lengths)].tobytes()


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, length of them."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(total) + shift


def _units(column: pa.Array) -> Iterator[list[tuple[int, bytes]]]:
    """Texts of a column as (row, bytes) in lists of about W.SLICE_BYTES; a text beyond UNIT_BYTES is cut where it may be."""
    held: list[tuple[int, bytes]] = []
    size = 0
    for row, scalar in enumerate(column):
        text = scalar.as_buffer()
        text = text.to_pybytes() if text is not None else b""
        at = 0
        while True:
            found = _CUT.search(text, at + UNIT_BYTES) if len(text) - at > UNIT_BYTES else None
            end = found.start() if found else len(text)
            held.append((row, text[at:end]))
            size += end - at
            if size >= W.SLICE_BYTES:
                yield held
                held, size = [], 0
            at = end
            if at == len(text):
                break
    if held:
        yield held


def tokens(column: pa.Array, vocabulary: Vocabulary) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) in order; a row appears more than once if its text was cut."""
    column = column.cast(pa.large_binary())
    for units in _units(column):
        raw = b"".join(text for _, text in units)
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        places = np.zeros(len(points) + 1, np.int64)
        np.cumsum(widths, out=places[1:])
        lengths = np.array([len(text) for _, text in units])
        edges = np.concatenate([[0], np.cumsum(lengths)])
        fresh = np.zeros(len(points), bool)
        firsts = np.searchsorted(places, edges[:-1])
        fresh[firsts[lengths > 0]] = True
        starts = places[:-1][pre_tokens(points, fresh)] if len(points) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(raw)) if len(starts) else starts
        data = np.frombuffer(raw + bytes(8), np.uint8)
        ids, counts = vocabulary.encode(data, starts, ends)
        cut = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, edges)]
        for k, (row, _) in enumerate(units):
            yield row, ids[cut[k] : cut[k + 1]]


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of every row of docs, ids (array of int, in order), n_tokens, and round_trip.

    round_trip says that the bytes decoded from the ids are those of the text. A null text counts as an empty one,
    which has no ids. Repeated rows are encoded alike; other columns are left out.
    """
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))
    kept = [F.col(name) for name in keep]
    table = docs.select(*kept, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("encoded_text"))

    def work(batch: pa.RecordBatch) -> dict:
        texts = batch.column(len(keep))
        parts: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
        for row, ids in tokens(texts, held.value):
            parts[row].append(ids)
        joined = [np.concatenate(p) for p in parts]
        offsets = np.concatenate([[0], np.cumsum([len(j) for j in joined])]).astype(np.int32)
        same = [held.value.decode(j) == t.as_buffer().to_pybytes() for j, t in zip(joined, texts, strict=True)]
        return {name: batch.column(k) for k, name in enumerate(keep)} | {
            "ids": pa.ListArray.from_arrays(offsets, np.concatenate(joined).view(np.int32)),
            "n_tokens": [len(j) for j in joined],
            "round_trip": same,
        }

    kinds = T.StructType(docs.select(*kept).schema.fields).add("ids", T.ArrayType(T.IntegerType())).add("n_tokens", "long").add("round_trip", "boolean")
    return mapped(table, work, kinds)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of encoded (doc_id, ids); null ids give a null text."""
    held = encoded.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    def work(batch: pa.RecordBatch) -> dict:
        lists = batch.column("ids").to_pylist()
        texts = [None if x is None else held.value.decode(np.array(x, np.uint32)).decode("utf-8", "replace") for x in lists]
        return {"doc_id": batch.column("doc_id"), "text": texts}

    return mapped(encoded.select(F.col("doc_id").cast("long"), "ids"), work, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (little-endian 32-bit ids) and decoded_sha256 (the bytes decoded from the ids)."""
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    def work(batch: pa.RecordBatch) -> dict:
        n = batch.num_rows
        coded, back = [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
        counts = [0] * n
        for row, ids in tokens(batch.column("text"), held.value):
            coded[row].update(ids.astype("<u4").tobytes())
            back[row].update(held.value.decode(ids))
            counts[row] += len(ids)
        return {
            "doc_id": batch.column("doc_id"),
            "n_tokens": counts,
            "ids_sha256": [h.hexdigest() for h in coded],
            "decoded_sha256": [h.hexdigest() for h in back],
        }

    return mapped(_texts(docs), work, SCHEMA)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
