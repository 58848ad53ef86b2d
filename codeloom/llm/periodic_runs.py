"""Periodic runs of words: seeds are equal k-grams of one document, extended along their diagonal.

A run of smallest period q and length l >= max(m, 3q) makes l - q >= max(m - q, 2q) consecutive words equal to those q
later: its diagonal of lag q. Lags are searched in classes. The first holds the lags up to k, the least overlap that any
run guarantees, and its seeds are k-grams; each further class doubles both, and a lag in (k/2, k] guarantees 2q > k. A gram
of a class is thus never shorter than the class's periods, so inside a run the next occurrence of a gram lies exactly
one smallest period on: only neighbouring occurrences are paired, and the pairs of a class are at most the words. Pairs of a
lag that touch are one seed; what a seed covers on its lag is noted, and later seeds within it are not extended.
Grams that occur once can't be part of a longer repeated gram, so a class looks only at what repeated in the one before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import let
from codeloom.llm import words as W
from codeloom.llm.arrow import mapped

LEAST_LENGTH = 24
EXPONENT = 3  # times a run's period is the least length; the pairing of neighbours needs three

SCHEMA = (
    "doc_id long, n_words long, n_dropped long, n_runs long, start long, length long, period long, exponent_milli long,"
    " runs_sha256 string, collapsed_sha256 string"
)
RUN = "array<struct<start:long,length:long,period:long>>"


def overlap(least_length: int = LEAST_LENGTH) -> int:
    """The least number of words equal to those a period later that a run of any period has."""
    return max(1, min(max(least_length - q, (EXPONENT - 1) * q) for q in range(1, least_length + 1)))


def _grams(names: np.ndarray, size: int) -> np.ndarray:
    """The name of the size words from each place on; at the last places, of words beyond the end."""

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([x[by:], np.zeros(min(by, len(x)), np.uint64)])

    out, done, power, width = None, 0, names, 1
    while True:
        if size & width:
            out = power if out is None else W.pair(out, shifted(power, done))
            done += width
        if done == size:
            return out
        power = W.pair(power, shifted(power, width))
        width *= 2


def _extended(names: np.ndarray, low: int, high: int, at: int, lag: int, step: int) -> tuple[int, int]:
    """The longest stretch of places in [low, high - lag) around at whose words equal those lag later."""
    last = high - lag
    first, size = at, step
    while first > low:
        left = max(low, first - size)
        differs = np.flatnonzero(names[left:first] != names[left + lag : first + lag])
        if len(differs):
            first = left + int(differs[-1]) + 1
            break
        first, size = left, 2 * size
    end, size = at, step
    while end < last:
        right = min(last, end + size)
        differs = np.flatnonzero(names[end:right] != names[end + lag : right + lag])
        if len(differs):
            end += int(differs[0])
            break
        end, size = right, 2 * size
    return first, end


def found(names: np.ndarray, offsets: np.ndarray, least_length: int = LEAST_LENGTH) -> list[tuple[int, int, int, int]]:
    """(document, start, length, period) of every run, in this order; names are those of the words of all documents."""
    owner = W.owners(offsets)
    ends = offsets[1:]
    out = set()
    size, low = overlap(least_length), 0
    grams = _grams(names, size) if len(names) else names
    room = ends[owner] - np.arange(len(names))
    places = np.flatnonzero(room >= size)
    while len(places):
        mixed = W.mix(grams[places] + W.mix(owner[places].astype(np.uint64)))
        order = np.argsort(mixed, kind="stable")
        same = mixed[order[1:]] == mixed[order[:-1]]
        here, there = places[order[:-1][same]], places[order[1:][same]]
        lag = there - here
        chosen = (lag > low) & (lag <= size) & (owner[here] == owner[there])
        out.update(_runs(names, offsets, owner, here[chosen], lag[chosen], size, least_length))
        again = np.zeros(len(names), bool)  # places whose gram occurs twice
        again[here] = again[there] = True
        low, size = size, 2 * size
        repeated = np.flatnonzero(again & (room >= size))
        places = repeated[again[repeated + low]]
        pairs = W.pair(grams[places], grams[places + low])
        grams = np.zeros(len(names), np.uint64)
        grams[places] = pairs
    return sorted(out)


def _runs(
    names: np.ndarray, offsets: np.ndarray, owner: np.ndarray, here: np.ndarray, lag: np.ndarray, size: int, least: int
) -> Iterator[tuple[int, int, int, int]]:
    """The runs on the diagonals of seeds: size words from here on equal those lag later."""
    order = np.lexsort((here, lag, owner[here]))
    here, lag = here[order], lag[order]
    document = owner[here]
    opens = np.ones(len(here), bool)
    opens[1:] = (lag[1:] != lag[:-1]) | (document[1:] != document[:-1]) | (here[1:] > here[:-1] + size)
    covered: dict[tuple[int, int], int] = {}  # how far a document's lag has been looked at
    for at, q, d in zip(here[opens].tolist(), lag[opens].tolist(), document[opens].tolist(), strict=True):
        if at < covered.get((d, q), -1):
            continue
        first, end = _extended(names, int(offsets[d]), int(offsets[d + 1]), at, q, size)
        covered[d, q] = end
        length = end - first + q
        if length >= max(least, EXPONENT * q):
            yield d, first - int(offsets[d]), length, q


def _stays(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words lie in no run beyond its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def _documents(batch: pa.RecordBatch, least_length: int) -> Iterator[tuple[bytes, int, list[tuple[int, int, int]]]]:
    """The text, the number of words and the runs of every row."""
    for part in W.slices(batch.column("text")):
        runs: dict[int, list[tuple[int, int, int]]] = {}
        for d, *run in found(W.word_names(part), part.word_offsets, least_length):
            runs.setdefault(d, []).append(tuple(run))
        for row, n in enumerate(np.diff(part.word_offsets).tolist()):
            yield part.text(row), n, sorted(runs.get(row, []), key=lambda r: (r[0], r[2]))


def _collapsed(text: bytes, n: int, runs: list[tuple[int, int, int]]) -> tuple[bytes, int]:
    """The words that stay, joined by a space, and how many go; bytes are split at the same white space as words."""
    held = text.split()
    if not runs:
        return b" ".join(held), 0
    stays = _stays(n, runs)
    return b" ".join([held[k] for k in np.flatnonzero(stays)]), int(n - stays.sum())


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of the greatest length by period, compared exactly; then the least start and period."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _reported(batch: pa.RecordBatch, least_length: int) -> dict:
    out: dict[str, list] = {n.split()[0]: [] for n in SCHEMA.split(", ")[1:]}
    for text, n, runs in _documents(batch, least_length):
        left, dropped = _collapsed(text, n, runs)
        start, length, period = _best(runs) if runs else (None, None, None)
        milli = 1000 * length // period if runs else None
        listed = "".join(f"{a},{b},{q}\n" for a, b, q in runs)
        row = (n, dropped, len(runs), start, length, period, milli)
        digests = (hashlib.sha256(x).hexdigest() for x in (listed.encode(), left))
        for name, value in zip(out, (*row, *digests), strict=True):
            out[name].append(value)
    return {"doc_id": batch.column("doc_id"), **out}


def report(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """Digests and counts of the runs of every row of docs (doc_id, text): the columns of SCHEMA.

    A run is a stretch of words of smallest period q, at least max(least_length, 3q) long, that neither neighbour
    extends. A null or empty text, or one without runs, has n_runs 0, nulls for the best run, the digest of an empty string
    for its runs, and all its words in the collapsed text. Repeated rows are judged alike; other columns are left out. A row's
    memory is a few times its text; an empty table gives an empty result.
    """
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return mapped(given, partial(_reported, least_length=least_length), SCHEMA)


def _listed(batch: pa.RecordBatch, least_length: int) -> dict:
    runs, texts = [], []
    for text, n, own in _documents(batch, least_length):
        runs.append([{"start": a, "length": b, "period": q} for a, b, q in own])
        texts.append(_collapsed(text, n, own)[0].decode("utf-8", "replace") if own else text.decode("utf-8", "replace"))
    return {"doc_id": batch.column("doc_id"), "runs": runs, "text": texts}


def runs(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """doc_id, runs (by start, then period) and the text, its words collapsed where it has runs; a null text is empty."""
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return mapped(given, partial(_listed, least_length=least_length), f"doc_id long, runs {RUN}, text string")


def repeating(doc_id: Column, text: Column) -> Column:
    """text, or for one document in ten, by the CRC of its id, its words repeating themselves from some word on."""
    check = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def again(held: Column) -> Column:
        n, g = F.size(held), F.floor(check / 10)
        first = g % F.greatest(n, F.lit(1))
        period = 1 + F.floor((n - first) / (3 + g % 8))

        def word(k: Column) -> Column:
            return F.get(held, F.when(k < first, k).otherwise(first + (k - first) % period).cast("int"))

        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")).otherwise(text)

    return F.when(check % 10 == 0, let(words, again)).otherwise(text)


def report_sql() -> str:
    """The same in DuckDB, by all pairs of equal 16-grams of a document and the islands they make on each lag."""
    return r"""
WITH bytes AS (
    SELECT doc_id, text, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT) AS digits FROM documents
), checked AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS given,
        xor(list_reduce(list_prepend(4294967295::BIGINT, digits), lambda crc, byte:
            list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, i:
                CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)), 4294967295::BIGINT) AS h
    FROM bytes
), chosen AS (
    SELECT doc_id, given, len(given) AS n, h, (h // 10) % greatest(len(given), 1) AS a,
        1 + (len(given) - (h // 10) % greatest(len(given), 1)) // (3 + (h // 10) % 8) AS p
    FROM checked
), worded AS (
    SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
        THEN list_transform(range(n), lambda i: given[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE given END AS ws
    FROM chosen
), words AS (
    SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM worded
), grams AS (
    SELECT doc_id, i, list(word) OVER w AS gram, count(*) OVER w AS held
    FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)
), named AS (
    SELECT doc_id, i, md5(array_to_string(gram, ' ')) AS gram FROM grams WHERE held = 16
), pairs AS (
    SELECT x.doc_id, x.i, y.i - x.i AS q FROM named x JOIN named y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i
), islands AS (
    SELECT doc_id, q, min(i) AS start, count(*) + 15 + q AS length
    FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs)
    GROUP BY doc_id, q, island
), long AS (
    SELECT * FROM islands WHERE length >= greatest(24, 3 * q)
), runs AS (
    SELECT * FROM long a WHERE NOT EXISTS (SELECT 1 FROM long b WHERE b.doc_id = a.doc_id AND b.q < a.q
        AND b.start <= a.start AND b.start + b.length >= a.start + a.length)
), listed AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS runs
    FROM runs GROUP BY doc_id
), best AS (
    SELECT doc_id, start, length, q AS period, 1000 * length // q AS exponent_milli FROM runs a
    WHERE NOT EXISTS (SELECT 1 FROM runs b WHERE b.doc_id = a.doc_id AND (b.length * a.q > a.length * b.q
        OR b.length * a.q = a.length * b.q AND (b.start, b.q) < (a.start, a.q)))
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM runs
), collapsed AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n_kept
    FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, n AS n_words, n - coalesce(n_kept, 0) AS n_dropped, coalesce(n_runs, 0) AS n_runs, start, length, period, exponent_milli,
    sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM worded LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN collapsed USING (doc_id)
"""
