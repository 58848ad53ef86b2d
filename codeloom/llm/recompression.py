"""Substring dedup by recompression: words covered by a window that also starts earlier in the corpus are removed.

Every text is compressed in ROUNDS rounds like any other: runs of one symbol become one, then a symbol of the left half
and a following one of the right half become a pair. Names are hashes of what they stand for, so the naming is global
without a dictionary: equal substrings have equal symbols but near their ends. Each symbol carries the span of words that
decides it; equal windows hold the same symbols among those decided inside them. Of these a window posts the one whose
name is least (most neighbours post the same one), and a window that holds none posts itself, so that no repeat is
missed. One Spark round counts the posted names; only windows around names that occur again are hashed whole and compared
in a second round, which gives each its first document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import words as W
from codeloom.llm.arrow import mapped
from codeloom.llm.steps import settled

WINDOW = 20
ROUNDS = 2
SMALL_ROWS = 1_000_000  # documents (two longs each) that may be broadcast
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_LAST = (1 << 63) - 1

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of _BASE and of its inverse modulo 2**64, up to n."""
    if len(_powers[0]) <= n:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def _windows(names: np.ndarray) -> np.ndarray:
    """The name of each WINDOW consecutive words, from pairs of halves; documents are not told apart."""
    level, size, out, done = names, 1, None, 0
    while size <= WINDOW:
        if WINDOW & size:
            own = level[done:] if out is not None else level
            out = own if out is None else W.pair(out[: len(own)], own[: len(out)])
            done += size
        level = W.pair(level[: len(level) - size], level[size:]) if len(level) > size else level[:0]
        size *= 2
    return out[: max(0, len(names) - WINDOW + 1)]


class Symbols:
    """The symbols of a batch of documents: name, the words that decide it [low, high), and its document."""

    def __init__(self, names: np.ndarray, owner: np.ndarray, first: np.ndarray, last: np.ndarray):
        at = np.arange(len(names))
        self.name, self.owner, self.low, self.high = names, owner, at, at + 1
        self.first, self.last = first, last  # of each document: its first word, and the end

    def _beyond(self, owner: np.ndarray, right: bool) -> np.ndarray:
        """A place outside the document: what lies there can't be seen."""
        return self.last[owner] + 1 if right else self.first[owner] - 1

    def runs(self) -> None:
        """Equal neighbours become one symbol, decided by what stands on either side as well."""
        n = len(self.name)
        new = np.ones(n, bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | (self.owner[1:] != self.owner[:-1])
        a = np.flatnonzero(new)
        b = np.append(a[1:], n) - 1  # the last of each run
        owner, count = self.owner[a], (b - a + 1).astype(np.uint64)
        inner_left = (a > 0) & (self.owner[a - 1] == owner)
        after = np.minimum(b + 1, n - 1)
        inner_right = (b + 1 < n) & (self.owner[after] == owner)
        low = np.where(inner_left, self.low[a - 1], self._beyond(owner, False))
        high = np.where(inner_right, self.high[after], self._beyond(owner, True))
        self.low, self.high = np.minimum(low, self.low[a]), np.maximum(high, self.high[b])
        self.name = np.where(count > 1, W.pair(self.name[a], count), self.name[a])
        self.owner = owner

    def pairs(self, salt: int) -> None:
        """A symbol of the left half and one of the right half after it become one; which half is told by the name."""
        n, owner = len(self.name), self.owner
        right = (W.mix(self.name + np.uint64(salt)) & np.uint64(1)).astype(bool)
        together = np.zeros(n, bool)  # with the next
        together[:-1] = ~right[:-1] & right[1:] & (owner[1:] == owner[:-1])
        second = np.append(False, together[:-1])
        before, after = np.arange(n) - 1, np.minimum(np.arange(n) + 1, n - 1)
        alone_left = ~right & ~together  # decided by what follows
        alone_right = right & ~second  # decided by what stands before
        high = np.where(together | (alone_left & (owner[after] == owner) & (after > before + 1)), self.high[after], self.high)
        high = np.where(alone_left & ((owner[after] != owner) | (np.arange(n) == n - 1)), self._beyond(owner, True), high)
        low = np.where(alone_right & (owner[before] == owner) & (before >= 0), self.low[before], self.low)
        low = np.where(alone_right & ((owner[before] != owner) | (before < 0)), self._beyond(owner, False), low)
        low = np.where(together, np.minimum(self.low, self.low[after]), np.minimum(low, self.low))
        high = np.maximum(high, self.high)
        name = np.where(together, W.pair(self.name, self.name[after]), self.name)
        keep = ~second
        self.name, self.owner, self.low, self.high = name[keep], owner[keep], low[keep], high[keep]


def posted(names: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the windows of a batch post: names, and the spans [low, high) of words that they stand for."""
    counts = np.diff(offsets)
    starts = np.flatnonzero(np.repeat(counts >= WINDOW, counts))
    owner = W.owners(offsets)
    starts = starts[starts + WINDOW <= offsets[owner[starts] + 1]] if len(starts) else starts
    none = np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), none, none
    symbols = Symbols(names, owner, offsets[:-1], offsets[1:])
    for k in range(ROUNDS):
        symbols.runs()
        symbols.pairs(k)
    inside = (symbols.high - symbols.low <= WINDOW) & (symbols.low >= offsets[symbols.owner]) & (symbols.high <= offsets[symbols.owner + 1])
    low, high = symbols.low[inside], symbols.high[inside]
    # both ends grow along the text, so a window's symbols are neighbours
    left = np.searchsorted(low, starts)
    right = np.searchsorted(high, starts + WINDOW, "right")
    some = right > left
    power, inverse = _power(len(names))
    total = np.zeros(len(names) + 1, np.uint64)
    np.cumsum(names * power[: len(names)], out=total[1:])
    anchor = W.mix((total[high] - total[low]) * inverse[low] + (high - low).astype(np.uint64))
    # the least of each range from the least of two overlapping powers of two
    place = np.uint64(max(1, len(anchor) - 1).bit_length())
    value = ((anchor >> place) << place) | np.arange(len(anchor), dtype=np.uint64)
    tables = [value]
    while 1 << len(tables) <= WINDOW:
        half = 1 << (len(tables) - 1)
        last = tables[-1]
        tables.append(np.minimum(last, np.append(last[half:], np.full(min(half, len(last)), ~np.uint64(0)))))
    a, b = left[some], right[some]
    depth = np.log2(b - a).astype(np.int64)
    chosen = np.zeros(len(anchor), bool)
    for k in np.unique(depth):
        at = depth == k
        least = np.minimum(tables[k][a[at]], tables[k][b[at] - (1 << k)])
        chosen[(least & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)] = True
    alone = starts[~some]
    whole = W.mix(_windows(names)[alone] + W.STEP)
    return (
        np.concatenate([anchor[chosen], whole]),
        np.concatenate([low[chosen], alone]),
        np.concatenate([high[chosen], alone + WINDOW]),
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """id (a null doc_id as the largest), text_key and text: rows that are equal in these have one result."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    number = F.col("doc_id").cast("long")
    return docs.select(number.alias("doc_id"), F.coalesce(number, F.lit(_LAST)).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _post(batch: pa.RecordBatch) -> dict:
    ids, keys = batch.column("id").to_numpy(), batch.column("text_key").to_numpy()
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for part in W.slices(batch.column("text")):
        name, low, high = posted(W.word_names(part), part.word_offsets)
        row = np.searchsorted(part.word_offsets, low, "right") - 1
        for held, x in zip(out, (name.view(np.int64), ids[part.first + row], keys[part.first + row], low - part.word_offsets[row], high - low), strict=True):
            held.append(x)
    name, own, key, low, size = (np.concatenate(x) for x in out)
    return {"name": name, "id": own, "text_key": key, "low": low.astype(np.int32), "size": size.astype(np.int8)}


def _candidates(names: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Starts of the windows of one document that hold a posted span."""
    n = len(names) - WINDOW + 1
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(low + size - WINDOW, 0, n), 1)
    np.add.at(edge, np.clip(low + 1, 0, n), -1)
    return np.flatnonzero(np.cumsum(edge[:-1]))


def _each(batch: pa.RecordBatch):
    """row, words' names, their bytes and the candidate windows of every document of a batch with spans."""
    spans = batch.column("spans")
    for part in W.slices(batch.column("text")):
        names, at = W.word_names(part), part.word_offsets
        for k in range(part.last - part.first):
            own = spans[part.first + k].values
            low, size = own.field("low").to_numpy(zero_copy_only=False), own.field("size").to_numpy(zero_copy_only=False)
            inner = names[at[k] : at[k + 1]]
            yield part, k, inner, _candidates(inner, low.astype(np.int64), size.astype(np.int64))


def _repeats(batch: pa.RecordBatch) -> dict:
    """(window, id): each name of a candidate window with its smallest id in the batch."""
    ids = batch.column("id").to_numpy()
    names, owners = [], []
    for part, k, inner, starts in _each(batch):
        names.append(_windows(inner)[starts])
        owners.append(np.full(len(starts), ids[part.first + k]))
    name, owner = np.concatenate(names), np.concatenate(owners)
    order = np.lexsort((owner, name))
    name, owner = name[order], owner[order]
    first = np.ones(len(name), bool)
    first[1:] = name[1:] != name[:-1]
    return {"window": name[first].view(np.int64), "id": owner[first]}


def _kept_digest(part: W.Slice, k: int, gone: np.ndarray) -> str:
    a, b = part.word_offsets[k], part.word_offsets[k + 1]
    words = part.text(k).split()
    if len(gone):
        words = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
    assert b - a == len(gone) or not len(gone)
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _gone(inner: np.ndarray, starts: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Which words are covered by a candidate window that starts earlier too.

    firsts: the windows whose first document this is; of such, the earliest start here stays.
    """
    names = _windows(inner)[starts]
    _, earliest = np.unique(names, return_index=True)
    stays = np.zeros(len(names), bool)
    stays[earliest] = np.isin(names[earliest], firsts)
    n = len(inner)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts[~stays], 1)
    np.add.at(edge, starts[~stays] + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def _removed(batch: pa.RecordBatch) -> dict:
    firsts = batch.column("firsts")
    out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": []}
    for part, k, inner, starts in _each(batch):
        own = firsts[part.first + k].values
        own = own.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) if own is not None else np.zeros(0, np.uint64)
        gone = _gone(inner, starts, own)
        out["n_words"].append(len(inner))
        out["n_removed"].append(int(gone.sum()))
        out["kept_sha256"].append(_kept_digest(part, k, gone))
    return {"doc_id": batch.column("doc_id"), **out}


def _untouched(batch: pa.RecordBatch) -> dict:
    words = [t.as_buffer().to_pybytes().split() for t in batch.column("text").cast(pa.large_binary())]
    n = len(words)
    return {
        "doc_id": batch.column("doc_id"),
        "n_words": [len(w) for w in words],
        "n_removed": [0] * n,
        "kept_sha256": [hashlib.sha256(b" ".join(w)).hexdigest() for w in words],
    }


def _small(table: DataFrame) -> Column | DataFrame:
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (kept words joined by one space) of every row of docs (doc_id, text).

    A word is removed if a window of WINDOW words of its document covers it whose words also start earlier: in a smaller
    doc_id, or earlier in the document. A null or empty text has no words; texts shorter than a window lose none. A null
    doc_id counts as the largest. Repeated rows (equal doc_id and text) are one document and share its result; rows of
    one doc_id with different texts are told apart, and of those neither is earlier. Other columns are left out; an
    empty table gives an empty result.
    """
    keyed = _keyed(docs)
    own = ["id", "text_key"]
    posts = settled(mapped(keyed.select("id", "text_key", "text"), _post, "name long, id long, text_key long, low int, size byte"))
    # settled: read again, it is dealt out for the join, and a name that much of the corpus posts can be split there
    shared = settled(posts.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name"))
    spans = posts.join(shared, "name").select(*own, "low", "size").distinct()
    spans = settled(spans.groupBy(*own).agg(F.collect_list(F.struct("low", "size")).alias("spans")))
    touched = spans.select(*own)
    held = settled(keyed.join(_small(touched), own, "left_semi").join(spans, own))
    windows = mapped(held.select("id", "text", "spans"), _repeats, "window long, id long")
    firsts = windows.groupBy("window").agg(F.min("id").alias("id"))
    firsts = firsts.groupBy("id").agg(F.collect_list("window").alias("firsts"))
    changed = held.join(firsts, "id", "left").select("doc_id", "text", "spans", "firsts")
    plain = keyed.join(_small(touched), own, "left_anti").select("doc_id", "text")
    return mapped(plain, _untouched, SCHEMA).unionByName(mapped(changed, _removed, SCHEMA))
