"""Quality classifier: a byte-level convolutional network in NumPy over overlapping chunks of the whole text.

A byte enters as a learned vector and two marks: whether the six bytes that end there occurred before in the chunk, near
(32 bytes) or farther off. Filters eight bytes wide, four apart, feed averages over 64 bytes, those feed a second layer,
and its largest values in a chunk are the chunk's; the largest and the mean over the chunks of a text give one
probability through a logistic unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import words as W
from codeloom.llm.arrow import mapped

CHUNK, OVERLAP = 1024, 64
EMBED, FILTERS, HIDDEN = 8, 16, 16
POOL = 16  # positions of the first layer averaged
NEAR = 32
THRESHOLD = 0.3
SAMPLE_ROWS, SAMPLE_CHUNKS, SAMPLE_BYTES = 3_000, 4, 65_536
SAMPLE_PIECES = -(-(SAMPLE_BYTES - OVERLAP) // (CHUNK - OVERLAP))  # chunks of a text in the sample, as many as SAMPLE_BYTES hold
STEPS, BATCH, RATE = 240, 64, 0.01
GROUPS = CHUNK // 4
WINDOWS = GROUPS // POOL
ROWS_AT_ONCE = 256  # chunks in a forward pass

Model = dict[str, np.ndarray]


def initial(seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    width = 4 * (EMBED + 2)
    return {
        "E": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        "A": rng.normal(0, (2 * width) ** -0.5, (width, 2 * FILTERS)).astype(np.float32),  # first and second four bytes
        "a": np.zeros(FILTERS, np.float32),
        "B": rng.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)).astype(np.float32),
        "b": np.zeros(HIDDEN, np.float32),
        "c": rng.normal(0, 0.1, 2 * HIDDEN).astype(np.float32),
        "d": np.zeros(1, np.float32),
    }


def repeats(chunks: np.ndarray) -> np.ndarray:
    """(chunks, CHUNK, 2): whether the six bytes that end at a place occurred before, near and farther off."""
    x = chunks.astype(np.uint32)
    key = np.zeros(x.shape, np.uint32)
    for k in range(6):
        key[:, 5:] = key[:, 5:] * np.uint32(0x01000193) + x[:, k : x.shape[1] - 5 + k] + np.uint32(1)
    key = (key * np.uint32(0x9E3779B1)) >> np.uint32(11)
    place = np.arange(x.shape[1], dtype=np.uint32)
    ordered = np.sort((key << np.uint32(10)) | place, axis=1)
    same = (ordered[:, 1:] >> np.uint32(10)) == (ordered[:, :-1] >> np.uint32(10))
    row, col = np.nonzero(same)
    at = ordered[row, col + 1] & np.uint32(CHUNK - 1)
    lag = at - (ordered[row, col] & np.uint32(CHUNK - 1))
    out = np.zeros((*x.shape, 2), np.float32)
    valid = at >= 11
    out[row[valid], at[valid], (lag[valid] > NEAR).astype(np.int64)] = 1
    return out


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the chunks of texts start, how many bytes each holds, and the first chunk of each text.

    A text of n bytes has ceil((n - OVERLAP) / (CHUNK - OVERLAP)) chunks, at least one; an empty text has none.
    """
    sizes = np.diff(offsets)
    step = CHUNK - OVERLAP
    counts = np.where(sizes > 0, np.maximum(1, -(-(sizes - OVERLAP) // step)), 0)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(sizes)), counts)
    starts = offsets[owner] + (np.arange(len(owner)) - firsts[owner]) * step
    lengths = np.minimum(CHUNK, offsets[owner + 1] - starts)
    return starts, lengths, firsts


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of chunks (chunks, CHUNK), zeros after a text's end."""
    if not len(starts):
        return np.zeros((0, CHUNK), np.uint8)
    inside = np.arange(CHUNK)[None, :] < lengths[:, None]
    return np.where(inside, data[np.minimum(starts[:, None] + np.arange(CHUNK)[None, :], len(data) - 1)], 0).astype(np.uint8)


def forward(model: Model, chunks: np.ndarray, lengths: np.ndarray, keep: bool = False) -> tuple:
    """The chunks' values (chunks, HIDDEN), and what training needs besides."""
    n = len(chunks)
    x = np.concatenate([model["E"][chunks], repeats(chunks)], axis=2).reshape(n, GROUPS, -1)
    both = (x.reshape(n * GROUPS, -1) @ model["A"]).reshape(n, GROUPS, 2 * FILTERS)
    first = both[:, :, :FILTERS] + model["a"]
    first[:, :-1] += both[:, 1:, FILTERS:]
    np.maximum(first, 0, out=first)
    # a place counts if its first byte lies within the text
    places = np.clip(-(-lengths[:, None] // 4) - np.arange(WINDOWS)[None, :] * POOL, 0, POOL)
    valid = (np.arange(GROUPS)[None, :] < -(-lengths[:, None] // 4)).astype(np.float32)
    first *= valid[:, :, None]
    scale = (1 / np.maximum(places, 1)).astype(np.float32)
    mean = first.reshape(n, WINDOWS, POOL, FILTERS).sum(axis=2) * scale[:, :, None]
    second = np.maximum(mean.reshape(-1, FILTERS) @ model["B"] + model["b"], 0).reshape(n, WINDOWS, HIDDEN)
    second[places == 0] = -1
    best = second.argmax(axis=1)
    value = np.take_along_axis(second, best[:, None, :], axis=1)[:, 0]
    return value, ((x, first, mean, second, best, scale) if keep else ())


def combine(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """(texts, 2 * HIDDEN): the largest and the mean value over each text's chunks, 0 without chunks."""
    out = np.zeros((len(firsts) - 1, 2 * HIDDEN), np.float32)
    some = np.flatnonzero(np.diff(firsts))
    if len(some):
        out[some, :HIDDEN] = np.maximum.reduceat(values, firsts[some], axis=0)
        out[some, HIDDEN:] = np.add.reduceat(values, firsts[some], axis=0) / np.diff(firsts)[some, None]
    return out


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The probability of label 1 of each text, ROWS_AT_ONCE chunks at a time."""
    starts, lengths, firsts = cut(data, offsets)
    values = np.zeros((len(starts), HIDDEN), np.float32)
    for i in range(0, len(starts), ROWS_AT_ONCE):
        own = slice(i, i + ROWS_AT_ONCE)
        values[own] = forward(model, gathered(data, starts[own], lengths[own]), lengths[own])[0]
    z = combine(values, firsts) @ model["c"] + model["d"]
    return 1 / (1 + np.exp(-z.astype(np.float64)))


def _gradient(model: Model, chunks, lengths, firsts, target) -> Model:
    value, (x, first, mean, second, best, scale) = forward(model, chunks, lengths, keep=True)
    pooled = combine(value, firsts)
    p = 1 / (1 + np.exp(-(pooled @ model["c"] + model["d"])))
    dz = ((p - target) / len(target)).astype(np.float32)
    out = {"c": pooled.T @ dz, "d": dz.sum(keepdims=True)}
    dpooled = dz[:, None] * model["c"][None, :]
    counts = np.diff(firsts)
    owner = np.repeat(np.arange(len(counts)), counts)
    dvalue = dpooled[owner, HIDDEN:] / counts[owner, None]
    some = np.flatnonzero(counts)
    for i in some:
        top = firsts[i] + value[firsts[i] : firsts[i + 1]].argmax(axis=0)
        dvalue[top, np.arange(HIDDEN)] += dpooled[i, :HIDDEN]
    dsecond = np.zeros_like(second)
    np.put_along_axis(dsecond, best[:, None, :], dvalue[:, None, :], axis=1)
    dsecond *= second > 0
    flat = dsecond.reshape(-1, HIDDEN)
    out["B"], out["b"] = mean.reshape(-1, FILTERS).T @ flat, flat.sum(axis=0)
    dmean = (flat @ model["B"].T).reshape(mean.shape) * scale[:, :, None]
    dfirst = np.repeat(dmean, POOL, axis=1) * (first > 0)
    out["a"] = dfirst.sum(axis=(0, 1))
    dboth = np.zeros((*dfirst.shape[:2], 2 * FILTERS), np.float32)
    dboth[:, :, :FILTERS] = dfirst
    dboth[:, 1:, FILTERS:] = dfirst[:, :-1]
    flat = dboth.reshape(-1, 2 * FILTERS)
    out["A"] = x.reshape(len(flat), -1).T @ flat
    dx = (flat @ model["A"].T).reshape(-1, EMBED + 2)
    ids = chunks.reshape(-1)
    out["E"] = np.stack([np.bincount(ids, dx[:, k], 256) for k in range(EMBED)], axis=1).astype(np.float32)
    return out


def sampled(text: bytes) -> list[bytes]:
    """The chunks of a text in order, SAMPLE_PIECES of them by hash over the whole text if it has more."""
    starts, lengths, _ = cut(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    order = np.argsort(W.mix(np.arange(len(starts), dtype=np.uint64) + np.uint64(len(text))))
    return [text[starts[k] : starts[k] + lengths[k]] for k in np.sort(order[:SAMPLE_PIECES])]


def train(texts: list[list[bytes]], labels: np.ndarray, seed: int = 7, steps: int = STEPS) -> Model:
    """Adam on the log loss over texts given as their chunks, BATCH texts a step, at most SAMPLE_CHUNKS random chunks of a text at a time."""
    model, rng = initial(seed), np.random.default_rng(seed)
    share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    model["d"][:] = np.log(share / (1 - share))
    if not len(texts):
        return model
    held = []
    for text in texts:
        lengths = np.array([len(x) for x in text], np.int64)
        data = np.frombuffer(b"".join(text), np.uint8)
        held.append((gathered(data, np.cumsum(lengths) - lengths, lengths), lengths))
    m = {k: np.zeros_like(v) for k, v in model.items()}
    v = {k: np.zeros_like(x) for k, x in model.items()}
    order: list[int] = []
    for step in range(1, steps + 1):
        if len(order) < min(BATCH, len(texts)):
            order = rng.permutation(len(texts)).tolist()
        rows, order = order[:BATCH], order[BATCH:]
        picks = [np.sort(rng.permutation(len(held[r][0]))[:SAMPLE_CHUNKS]) for r in rows]
        chunks = np.concatenate([held[r][0][p] for r, p in zip(rows, picks, strict=True)])
        lengths = np.concatenate([held[r][1][p] for r, p in zip(rows, picks, strict=True)])
        if not len(chunks):
            continue
        firsts = np.concatenate([[0], np.cumsum([len(p) for p in picks])])
        slope = _gradient(model, chunks, lengths, firsts, labels[rows].astype(np.float32))
        rate = RATE * min(1, step / 20) * (1 - 0.9 * step / steps)
        for k in model:
            m[k] = 0.9 * m[k] + 0.1 * slope[k]
            v[k] = 0.999 * v[k] + 0.001 * slope[k] ** 2
            model[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from; a null id belongs to it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of labels (doc_id, quality) on docs (doc_id, text), learned outside the held-out fold.

    The sample is the `sample_rows` labelled rows with the smallest hashes, one row of a doc_id, with at most SAMPLE_PIECES
    chunks of a text: a documented bound on what reaches the driver. Rows with a null id or label take no part.
    """
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    known = known.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("text", "quality")).alias("one"))
    sample = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "one.text", F.col("one.quality").cast("double").alias("quality"))

    def work(batch: pa.RecordBatch) -> dict:
        chunks = [sampled(t.encode()) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "chunks": chunks, "quality": batch.column("quality")}

    rows = mapped(sample, work, "doc_id long, chunks array<binary>, quality double").collect()
    rows = sorted(rows, key=lambda r: r.doc_id)
    return train([[bytes(x) for x in r.chunks] for r in rows], np.array([r.quality for r in rows], float))


def _texts(column: pa.Array) -> Iterator[W.Slice]:
    return W.slices(column, words=False)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, null for no row) of every row of docs (doc_id, text).

    A null or empty text has no chunks and gets the score of the model's bias. Repeated rows score alike, other
    columns are left out, and an empty table gives an empty result. Only the text enters the score.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict:
        found = [scores(held.value, part.data, part.offsets) for part in _texts(batch.column("text"))]
        return {"doc_id": batch.column("doc_id"), "score": np.concatenate(found)}

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(texts, work, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score threshold or more."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def work(batch: pa.RecordBatch) -> dict:
        found = [scores(held.value, part.data, part.offsets) for part in _texts(batch.column("text"))]
        kept = batch.filter(pa.array(np.concatenate(found) >= threshold))
        return {n: kept.column(n) for n in names}

    return mapped(docs, work, docs.schema)
