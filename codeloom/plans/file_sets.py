"""Distinct files as bitmaps, which merge over projects, days or patterns without reading the files again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.plans.order import numbered


def file_numbers(files: DataFrame) -> DataFrame:
    """project, path and file_no (from 1, by project and path) of a table with one row per file.

    Stored once, the numbers serve every set made from these files; later files go on from the greatest number.
    """
    keys = {"project": F.coalesce("project", F.lit("")), "path": F.coalesce("path", F.lit(""))}
    return numbered(files.select("project", "path"), keys, "file_no")


def sets_of(hits: DataFrame, numbers: DataFrame, *by: str) -> DataFrame:
    """by, bucket and files (a bitmap of 32,768 numbers) of the files of hits (project, path, by), repeated or not."""
    known = hits.select("project", "path", *[F.col(n).alias(f"_{n}") for n in by]).join(numbers, ["project", "path"])
    bucket = F.bitmap_bucket_number("file_no").alias("bucket")
    place = F.bitmap_bit_position("file_no").alias("place")
    placed = known.select(*[F.col(f"_{n}").alias(n) for n in by], bucket, place)
    return placed.groupBy(*by, "bucket").agg(F.bitmap_construct_agg("place").alias("files"))


def merged(sets: DataFrame, *by: str) -> DataFrame:
    """The sets of fewer columns, or of several tables of sets in one: files of any of them."""
    return sets.groupBy(*by, "bucket").agg(F.bitmap_or_agg("files").alias("files"))


def sizes(sets: DataFrame, *by: str) -> DataFrame:
    """by and n_files, the distinct files of merged sets."""
    each: Column = F.bitmap_count("files")
    return sets.groupBy(*by).agg(F.sum(each).cast("long").alias("n_files"))
