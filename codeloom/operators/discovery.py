"""Which files are analysed, and as what: path filters and language detection."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.constants.exclusions import EXCLUDED_DIRS, EXCLUDED_FILES, TEST_DIRS
from codeloom.constants.languages import LANGUAGES, Extension, extension_rows
from codeloom.functions.regex import glob_regex
from codeloom.functions.text import let

WILDCARDS = ("*", "?")


def suffix(path: Column) -> Column:
    """Lower-cased last suffix with its dot; empty for `.name` and for names without a dot."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def short_path(path: Column, root: str | None = None) -> Column:
    """Path below ``root`` if it lies there, else parent directory and name."""
    near = F.substring_index(path, "/", -2)
    if root is None:
        return near
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 2**31 - 1)).otherwise(near)


def is_definition(path: Column) -> Column:
    return path.endswith(".d.ts")


def excluded_dirs(extra: Iterable[str] = (), include_tests: bool = False) -> Column:
    """The excluded names as an array: defaults, test directories and the caller's own."""
    names = F.array_union(
        F.array(*[F.lit(d) for d in EXCLUDED_DIRS]),
        F.array(*[F.lit(d) for d in extra]).cast("array<string>"),
    )
    if include_tests:
        return names
    return F.array_union(names, F.array(*[F.lit(d) for d in TEST_DIRS]))


def in_excluded_dir(
    path: Column, extra: Sequence[str] = (), include_tests: bool = False, glob_dirs: bool = False
) -> Column:
    """Whether a component of the project-relative path is an excluded name.

    Names match exactly; ``glob_dirs`` also lets the names with a wildcard match as globs.
    """
    parts = F.split(path, "/", -1)
    hit = F.arrays_overlap(parts, excluded_dirs(extra, include_tests))
    if glob_dirs:
        globs = [d for d in (*EXCLUDED_DIRS, *extra) if any(w in d for w in WILDCARDS)]
        regex = "^(?:" + "|".join(glob_regex(g) for g in globs) + ")$"
        hit = hit | F.exists(parts, lambda part: part.rlike(regex))
    return hit


def name_matches(name: Column, globs: Sequence[str]) -> Column:
    """Whether a file name matches one of the globs: literals as a set, the rest as one pattern."""
    literals = [g for g in globs if not any(w in g for w in WILDCARDS)]
    patterns = [g for g in globs if any(w in g for w in WILDCARDS)]
    hit = name.isin(*literals) if literals else F.lit(False)
    if patterns:
        hit = hit | name.rlike("^(?s:" + "|".join(glob_regex(g) for g in patterns) + ")$")
    return hit


def excluded_file(path: Column) -> Column:
    return let(basename(path), lambda name: name_matches(name, EXCLUDED_FILES))


def excluded_for_language(path: Column, language: Column) -> Column:
    """The per-language globs of the catalogue, which are off unless asked for."""
    hit = F.lit(False)
    for entry in LANGUAGES:
        if entry.exclude_globs:
            hit = hit | ((language == entry.name) & name_matches(basename(path), entry.exclude_globs))
    return hit


def language_listing(spark: SparkSession) -> DataFrame:
    """Supported languages as shown to the user."""
    quoted = [
        "('{}', '{}', '{}')".format(
            entry.name, ", ".join(entry.extensions),
            "AST Analysis" if entry.name == "python" else "Pattern Matching",
        )
        for entry in LANGUAGES
    ]
    listing = spark.sql(f"SELECT * FROM VALUES {', '.join(quoted)} AS listing(name, extensions, features)")
    return listing.select(F.initcap("name").alias("language"), "extensions", "features")


def with_language(
    files: DataFrame, extra: Sequence[Extension] = (), strict_tsx: bool = False, keep_unknown: bool = False
) -> DataFrame:
    """Add language, family, comment_marker and is_definition; drop files of no known language."""
    # A literal map: the lookup stays in the row, where a join could shuffle contents by some 25 keys.
    entries = {r.extension: (r.language, r.family, r.comment_marker) for r in extension_rows(tuple(extra), strict_tsx)}
    fields = ("language", "family", "comment_marker")
    pairs = [
        item
        for extension, values in entries.items()
        for item in (
            F.lit(extension),
            F.struct(*[F.lit(value).alias(name) for name, value in zip(fields, values, strict=True)]),
        )
    ]
    found = F.try_element_at(F.create_map(*pairs), suffix(F.col("path")))
    known = files.withColumn("_known", found)
    if not keep_unknown:
        known = known.where(F.col("_known").isNotNull())
    known = known.withColumns({name: F.col("_known")[name] for name in fields}).drop("_known")
    if keep_unknown:
        known = known.withColumn("language", F.coalesce("language", F.lit("unknown")))
    return known.withColumn("is_definition", is_definition(F.col("path")))


def discover(
    files: DataFrame,
    exclude_dirs: Sequence[str] = (),
    include_tests: bool = False,
    glob_dirs: bool = False,
    language_globs: bool = False,
    extra: Sequence[Extension] = (),
) -> DataFrame:
    """Files that are analysed, with their language. Path predicates come first, so content of
    excluded files is never read from a columnar table."""
    path = F.col("path")
    kept = files.where(
        ~in_excluded_dir(path, exclude_dirs, include_tests, glob_dirs) & ~excluded_file(path)
    )
    found = with_language(kept, extra)
    if language_globs:
        found = found.where(~excluded_for_language(path, F.col("language")))
    return found
