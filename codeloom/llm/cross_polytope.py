"""Approximate nearest neighbours by cross-polytope hashing.

A table's hash turns a unit vector by a pseudo-rotation, three rounds of random signs and a fast Hadamard transform, and
takes the nearest signed axis. Every vector is in one bucket of each table; a query looks into the buckets of its PROBES
nearest axes of each table, and inner products in double precision rank what it finds there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.steps import settled

TABLES, PROBES = 16, 8
NEAREST = 20
EVERY = 20
CHUNK = 16_384  # vectors, and queries, of a bucket in one task
SEED = 11


def signs(size: int, tables: int = TABLES) -> np.ndarray:
    """(tables, 3, size) random signs."""
    return np.random.default_rng(SEED).choice(np.array([-1.0, 1.0]), (tables, 3, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    half = 1
    while half < width:
        y = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


def rotated(x: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """Rows of x (padded with zeros to a power of two) after three rounds of signs and transforms."""
    wide = np.zeros((len(x), flips.shape[-1]))
    wide[:, : x.shape[1]] = x
    for sign in flips:
        wide = hadamard(wide * sign)
    return wide


def nearest_axes(x: np.ndarray, flips: np.ndarray, probes: int) -> np.ndarray:
    """The numbers of the nearest signed axes of each row, nearest first: axis i is i, its opposite i + width."""
    turned = rotated(x, flips)
    both = np.concatenate([turned, -turned], axis=1)
    if probes == 1:
        return both.argmax(axis=1)[:, None]
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with q, each added up in one order: equal vectors, equal products."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k] * q[k]
    return out


def _valid(vector: Column) -> Column:
    """A vector takes part if no component is null, NaN or infinite, and some component is not 0."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0)


def _width(length: int) -> int:
    return 1 << (max(1, length) - 1).bit_length()


def _bucketed(vectors: DataFrame, tables: int, probes: int) -> DataFrame:
    """vec_id, vector, length, bucket: a row for each of the vector's buckets (probes of each table of its length)."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for i in range(0, len(batch), 2048):
                for length, part in batch.iloc[i : i + 2048].groupby(batch["vector"].str.len(), sort=True):
                    width = _width(length)
                    x = np.array(part["vector"].tolist(), np.float64)
                    size = np.sqrt((x / np.abs(x).max(axis=1, keepdims=True)) ** 2 @ np.ones(x.shape[1]))[:, None]
                    unit = x / np.abs(x).max(axis=1, keepdims=True) / size
                    flips = signs(width, tables)
                    axes = [nearest_axes(unit, f, probes) + t * 2 * width for t, f in enumerate(flips)]
                    axes = np.concatenate(axes, axis=1)
                    yield pd.DataFrame(
                        {
                            "vec_id": np.repeat(part["vec_id"].to_numpy(), axes.shape[1]),
                            "vector": part["vector"].repeat(axes.shape[1]).to_numpy(),
                            "length": length,
                            "bucket": axes.reshape(-1),
                        }
                    )

    return vectors.mapInPandas(run, "vec_id long, vector array<double>, length int, bucket int")


def _ranked(queries, rows, count: int):
    """Of each query the nearest rows of the block, as one row of arrays."""
    import pandas as pd

    empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_ids": np.zeros(0, object), "scores": np.zeros(0, object)})
    if not len(queries) or not len(rows):
        return empty
    x = np.array(rows["vector"].tolist())
    ids = rows["vec_id"].to_numpy()
    out = []
    for i in range(0, len(queries), 256):
        part = queries.iloc[i : i + 256]
        q = np.array(part["vector"].tolist())
        rough = q @ x.T
        for k, own in enumerate(part["vec_id"].to_numpy()):
            near = rough[k]
            near[ids == own] = -np.inf
            if len(near) > count:
                least = np.partition(near, len(near) - count)[len(near) - count]
                # rounding may order equal products either way, so those about as near are added up alike
                slack = 1e-12 * (1 + np.abs(q[k]).sum() * np.abs(x).max())
                found = np.flatnonzero(near >= least - slack)
            else:
                found = np.arange(len(near))
            found = found[ids[found] != own]
            score = products(x[found], q[k])
            order = np.lexsort((ids[found], -score))[:count]
            if len(order):
                out.append((own, ids[found][order].tolist(), score[order].tolist()))
    return pd.DataFrame(out, columns=["query_id", "vec_ids", "scores"]) if out else empty


def search(
    vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, tables: int = TABLES, probes: int = PROBES
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: of each query the nearest vectors found, nearest first.

    vectors and queries have (vec_id, embedding); a query's own vec_id is no candidate, ties go to the smaller vec_id. A
    vector that is null, zero, or holds a null or a non-finite component takes no part, nor does one with a null vec_id.
    A query's candidates are the vectors of its own length; one that finds fewer than nearest of them in its buckets is
    compared with all. Repeated rows of one vec_id count once, the largest vector of them. A bucket is dealt in blocks of
    CHUNK vectors and queries, so a bucket of any size is searched whole. An empty table gives an empty result.
    """

    def clean(table: DataFrame) -> DataFrame:
        vector = F.col("embedding").cast("array<double>")
        table = table.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
        table = table.filter(F.col("vec_id").isNotNull() & _valid(F.col("vector")))
        return table.groupBy("vec_id").agg(F.max("vector").alias("vector"))

    rows, asks = clean(vectors), clean(queries)
    near = settled(_searched(_bucketed(rows, tables, 1), _bucketed(asks, tables, probes), nearest))
    # all of a length in one bucket, for the queries that lack some of the nearest vectors that there are
    held = near.groupBy("query_id").agg(F.count("*").alias("found")).withColumnRenamed("query_id", "vec_id")
    whole = [t.select("vec_id", "vector", F.size("vector").alias("length"), F.lit(0).alias("bucket")) for t in (rows, asks)]
    there = whole[0].groupBy("length").agg(F.count("*").alias("there"))
    lacking = whole[1].join(held, "vec_id", "left").filter(F.coalesce("found", F.lit(0)) < nearest).join(F.broadcast(there), "length")
    # a query's own vector is no candidate where it is there; to count it in costs a search that finds no more
    lacking = settled(lacking.filter(F.coalesce("found", F.lit(0)) < F.col("there")).select("vec_id", "vector", "length", "bucket"))
    if lacking.isEmpty():
        return near
    rest = _searched(whole[0], lacking, nearest)
    asked = lacking.select(F.col("vec_id").alias("query_id"))
    return near.join(asked, "query_id", "left_anti").unionByName(rest)


def _searched(rows: DataFrame, asks: DataFrame, nearest: int) -> DataFrame:
    """The nearest rows in the buckets of asks, both with vec_id, vector, length and bucket."""
    # tables * 2 * width counts of a length at most
    sizes = rows.groupBy("length", "bucket").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    crowds = asks.groupBy("length", "bucket").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("crowds"))
    plan = F.broadcast(sizes.join(crowds, ["length", "bucket"]))
    rows, asks = rows.join(plan, ["length", "bucket"]), asks.join(plan, ["length", "bucket"])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    rows = rows.select("length", "bucket", own("parts").alias("part"), every("crowds").alias("crowd"), "vec_id", "vector")
    asks = asks.select("length", "bucket", every("parts").alias("part"), own("crowds").alias("crowd"), "vec_id", "vector")
    keys = ["length", "bucket", "part", "crowd"]
    found = (
        asks.groupBy(*keys)
        .cogroup(rows.groupBy(*keys))
        .applyInPandas(lambda a, b: _ranked(a, b, nearest), "query_id long, vec_ids array<long>, scores array<double>")
    )
    return _merged(found, nearest)


def _merged(found: DataFrame, nearest: int) -> DataFrame:
    """The nearest of all blocks: lists of one query are merged a few at a time, each again a list of nearest at most."""

    def merge(batches):
        best: dict[int, dict[int, float]] = {}
        for batch in batches:
            for own, ids, scores in zip(batch["query_id"], batch["vec_ids"], batch["scores"], strict=True):
                held = best.setdefault(own, {})
                held.update(zip(ids.tolist(), scores.tolist(), strict=True))
                if len(held) > 4 * nearest:
                    best[own] = dict(sorted(held.items(), key=lambda x: (-x[1], x[0]))[:nearest])
            if len(best) > 50_000:
                yield table(best)
                best = {}
        if best:
            yield table(best)

    def table(best):
        import pandas as pd

        rows = [(own, sorted(held.items(), key=lambda x: (-x[1], x[0]))[:nearest]) for own, held in best.items()]
        return pd.DataFrame(
            {"query_id": [r[0] for r in rows], "vec_ids": [[i for i, _ in r[1]] for r in rows], "scores": [[s for _, s in r[1]] for r in rows]}
        )

    schema = "query_id long, vec_ids array<long>, scores array<double>"
    # once where the lists are made, once more where all of a query meet
    lists = found.mapInPandas(merge, schema).repartition("query_id").mapInPandas(merge, schema)
    pairs = lists.select("query_id", F.explode(F.arrays_zip("vec_ids", "scores")).alias("near"))
    pairs = pairs.select("query_id", F.col("near.vec_ids").alias("vec_id"), F.col("near.scores").alias("score")).distinct()
    ordered = pairs.groupBy("query_id").agg(
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))), 1, nearest).alias("near")
    )
    out = ordered.select("query_id", F.posexplode("near").alias("at", "near"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "near.vec_id", "near.score")
