"""Loading of a raw files table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.constants.exclusions import EXCLUDED_DIRS, EXCLUDED_FILES, TEST_DIRS
from codeloom.constants.languages import Extension, extension_rows
from codeloom.functions.text import clean
from codeloom.sources.directory import DirectorySource


def from_table(raw: DataFrame) -> DataFrame:
    """The files table from raw columns: bytes or text decoded, newlines unified, gaps filled."""
    return raw.select(
        "project",
        "path",
        F.coalesce(F.col("size_bytes"), F.lit(0)).cast("long").alias("size_bytes"),
        F.coalesce(F.col("modified_at"), F.timestamp_seconds(F.lit(0))).alias("modified_at"),
        clean(F.col("content")).alias("content"),
    )


def from_directory(
    spark: SparkSession,
    path: str,
    split_depth: int = 2,
    prune: Sequence[str] = (),
    skip: Sequence[str] = (),
    suffixes: Sequence[str] = (),
    slices: int = 1,
    projects: bool = False,
) -> DataFrame:
    """The files table of a directory tree on a file system that all executors share.

    Names with a leading underscore or dot are kept. ``prune`` are directory names not to enter, ``skip`` file globs and
    ``suffixes`` the only suffixes to read, if any; other files are never opened, and neither are those that a filter on
    project or path leaves out. ``slices`` tasks share a subtree below ``split_depth``. With ``projects`` the first
    part of a path is the project.
    """
    spark.dataSource.register(DirectorySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {
        "splitDepth": split_depth, "slices": slices, "projects": str(projects).lower(),
        "prune": "/".join(prune), "skip": "/".join(skip), "suffixes": ",".join(suffixes),
    }
    return from_table(spark.read.format("source_tree").options(**options).load(path))


def source_files(
    spark: SparkSession,
    path: str,
    exclude_dirs: Sequence[str] = (),
    include_tests: bool = False,
    extra: Sequence[Extension] = (),
    **dealing,
) -> DataFrame:
    """The files of a directory tree that ``discover`` would keep; of the others not one is opened."""
    tests = () if include_tests else TEST_DIRS
    suffixes = [row.extension for row in extension_rows(tuple(extra))]
    prune = (*EXCLUDED_DIRS, *tests, *exclude_dirs)
    return from_directory(spark, path, prune=prune, skip=EXCLUDED_FILES, suffixes=suffixes, **dealing)
