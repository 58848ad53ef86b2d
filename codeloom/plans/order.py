"""A number for every row of a table in a global order, without gathering the table in one task."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PARTS = 64
SAMPLED = 32  # rows looked at for each part


def _bounds(keyed: DataFrame, names: list[str], parts: int) -> list[tuple]:
    """Keys that cut the table into about even parts, from a bounded sample: they decide how even, not the result."""
    sample = keyed.select(*names).orderBy(F.rand(7)).limit(parts * SAMPLED).collect()
    ordered = sorted(tuple(row) for row in sample)
    return sorted(set(ordered[SAMPLED::SAMPLED]))


def numbered(rows: DataFrame, keys: Mapping[str, Column], name: str = "rank", parts: int = PARTS) -> DataFrame:
    """``rows`` with their number from 1 in the order of ``keys``, columns by name, ascending and without nulls.

    Ranges of keys are numbered each in its task, from the number of rows in the ranges before. The ranges are literals of
    the plan, so a task that runs again numbers alike. Rows with equal keys all lie in one range. The table is read three
    times (bounds, counts, numbers): one that is costly to make is best stored first.
    """
    names = list(keys)
    keyed = rows.withColumns(dict(keys))
    bounds = _bounds(keyed, names, parts)
    kinds = [keyed.schema[n].dataType for n in names]
    key = F.struct(*names)
    literals = [F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in zip(names, b, kinds, strict=True)]) for b in bounds]
    part = F.size(F.filter(F.array(*literals), lambda bound: bound <= key)) if bounds else F.lit(0)
    dealt = keyed.withColumn("_part", part)
    held = dealt.groupBy("_part").agg(F.count("*").alias("_held"))
    # one row per range
    earlier = F.sum("_held").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = held.select("_part", F.coalesce(earlier, F.lit(0)).alias("_start"))
    within = F.row_number().over(W.partitionBy("_part").orderBy(*names))
    found = dealt.withColumn("_within", within).join(F.broadcast(starts), "_part")
    number = (F.col("_start") + F.col("_within")).cast("long")
    return found.withColumn(name, number).drop("_part", "_start", "_within", *[n for n in names if n not in rows.columns])


def ranked_table(table: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """A report table with the rank of each row by a numeric column; missing values count as 0, ties go by path and project."""
    value = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
    keys = {
        "_value": -value if descending else value,
        "_path": F.coalesce("path", F.lit("")),
        "_project": F.coalesce("project", F.lit("")),
    }
    return numbered(table, keys)
