"""Mixing sources to target weights: every document is taken floor(rate) times, and once more with the fraction's chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.steps import ranked, settled

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = (3, 2)
REPEATS = 2
SEED = "mix"
SALTS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def chance(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the document and the seed only; null ids share one."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def targets(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: tuple[int, int] = SHARE,
    repeats: int = REPEATS,
) -> DataFrame:
    """source, source_size, weight and target for a table (source, size).

    The sources, by code point and null last, weigh `weights` in turn and share `share` of all sizes. A target stops at
    `repeats` times its source's size, and what it leaves is dealt again by weight until none is above. Only single
    rows of sums reach the driver. Without sizes every target is 0.
    """
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = ranked(table, F.col("source").asc_nulls_last(), "place")
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = settled(table.select("source", "source_size", pick.cast("long").alias("weight")))
    top, bottom = share
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        # level: words a unit of weight, once the sources that reach their limit below the former level are left out
        reaches = F.col("weight") * F.lit(level) >= F.col("source_size") * repeats
        row = table.agg(
            F.coalesce(F.sum(F.when(reaches, 1).otherwise(0)), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(reaches, F.col("source_size") * repeats)), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~reaches, F.col("weight"))), F.lit(0)).alias("free"),
        ).first()
        if row["full"] == full or not row["free"]:
            break
        full, level = row["full"], (total * top / bottom - row["held"]) / row["free"]
    limit = (F.col("source_size") * repeats).cast("double")
    return table.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)))


def _rated(docs: DataFrame, weights: tuple, share: tuple, repeats: int, seed: str) -> DataFrame:
    """row (a struct of docs' columns), size, source_size, target and copies.

    The plan has a row for each source and salt, and a document meets the one of its own salt: where the plan is too
    large to broadcast, a source that holds much of the corpus is dealt to SALTS tasks.
    """
    sized = docs.select(
        F.struct("*").alias("row"),
        F.col("source").alias("of"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
        word_count(F.col("text")).alias("size"),
    )
    plan = targets(docs.select("source", word_count(F.col("text")).alias("size")), weights, share, repeats)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.select("source", "source_size", "target", rate.alias("rate"), salts)
    joined = sized.join(plan, F.col("of").eqNullSafe(F.col("source")) & (F.col("salt") == F.col("part")))
    whole = F.floor("rate")
    extra = (chance(F.col("row.doc_id"), seed) < F.col("rate") - whole).cast("long")
    return joined.select("row", "size", "source_size", "target", (whole + extra).cast("long").alias("copies"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: tuple[int, int] = SHARE,
    repeats: int = REPEATS,
    seed: str = SEED,
) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row of docs (doc_id, source, text).

    A null or empty text has size 0 and is taken with 0 words; a null source is a source of its own; repeated rows are
    rows like others and share their document's chance. Other columns are left out. Reruns agree: the chance depends
    on (seed, doc_id) only. An empty table gives an empty result.
    """
    rated = _rated(docs.select("doc_id", "source", "text"), weights, share, repeats, seed)
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return rated.select("row.doc_id", "size", "source_size", "target", taken, "copies")


def mixed(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: tuple[int, int] = SHARE,
    repeats: int = REPEATS,
    seed: str = SEED,
) -> DataFrame:
    """The rows of the mix: each row of docs as often as it is taken, with all columns of docs and no other."""
    rated = _rated(docs, weights, share, repeats, seed)
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return rated.filter("copies > 0").select("row", times.alias("copy")).select("row.*")
