"""The per-file tables: narrow passes over the content, no shuffle, no Python.

``with_*`` functions each add a group of columns, so a job evaluates only what it reports.
``file_metrics`` is all of them; every project rollup is an aggregate of its columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.constants.rules import SECURITY_RULES, Rule
from codeloom.functions.once import columns_once
from codeloom.functions.text import identifiers, split_lines
from codeloom.operators import complexity as cx
from codeloom.operators import findings as fd
from codeloom.operators import scores as sc
from codeloom.operators.duplicates import duplicated_lines, repeated_chunks
from codeloom.operators.lines import (
    blank_lines, comment_lines, comment_or_string_lines, definition_counts, lexed, touched_lines,
)
from codeloom.operators.structure import rust_keyword_complexity, structure

KEY = ("project", "path", "language")
BASE = (*KEY, "family", "is_definition", "size_bytes", "modified_at", "status")
LINES = ("loc", "blanks", "comments", "sloc", "comment_or_string_lines")
STRUCTURE = ("classes", "functions", "methods", "imports")
COMPLEXITY = (
    "cyclomatic", "cognitive", "halstead", "maintainability_index", "maintainability_level",
    "complexity_score", "complexity_level",
)
SECURITY = ("security_counts", "n_security", "security_score", "security_level")
SMELLS = ("smell_counts", "n_smells", "duplicated_lines", "technical_debt_ratio", "smell_severity")


def _with(files: DataFrame, groups: Sequence[dict[str, Column]]) -> DataFrame:
    """Add groups of columns one after the other; a group may use the ones before it."""
    for group in groups:
        files = files.withColumns(group)
    return files


@columns_once
def _text_columns() -> list[dict[str, Column]]:
    size = F.coalesce(F.col("size_bytes"), F.lit(0))
    status = (
        F.when(F.col("content").isNull(), "unreadable")
        .when(F.length("content") == 0, "empty")
        .otherwise("ok")
    )
    analyzed = (F.col("status") == "ok") & ~F.col("is_definition")
    declared = F.col("is_definition") & F.col("content").isNotNull()
    return [
        {"size_bytes": size, "status": status},
        {
            "text": F.when(analyzed, F.col("content")).otherwise(F.lit("")),
            "definition": F.when(declared, definition_counts(F.col("content"))),
        },
    ]


def with_text(files: DataFrame) -> DataFrame:
    """Add status, text and definition counts to files with a language.

    ``text`` is what the rules see: empty for unreadable and definition files, which only get counts;
    an unreadable file counts 0 of everything.
    """
    return _with(files, _text_columns())


@columns_once
def _spans() -> dict[str, Column]:
    return {"spans": lexed(F.col("text"), F.col("language"), F.col("family"))}


def with_spans(files: DataFrame) -> DataFrame:
    """Add the spans of the text after ``with_text``, once."""
    return files if "spans" in files.columns else _with(files, [_spans()])


@columns_once
def _line_columns() -> list[dict[str, Column]]:
    text, family, definition = F.col("text"), F.col("family"), F.col("definition")

    def count(name: str, value: Column) -> Column:
        return F.when(definition.isNotNull(), definition[name]).otherwise(value).cast("long")

    return [
        {"touched": touched_lines(F.col("spans"))},
        {
            "loc": count("loc", split_lines(text)),
            "blanks": count("blanks", blank_lines(text)),
            "comments": count("comments", comment_lines(text, family, F.col("touched"))),
        },
        {
            "sloc": F.col("loc") - F.col("blanks") - F.col("comments"),
            "comment_or_string_lines": comment_or_string_lines(
                family, F.col("touched"), F.col("comments")
            ),
        },
    ]


def with_lines(files: DataFrame) -> DataFrame:
    """Add loc, blanks, comments, sloc and comment_or_string_lines after ``with_text``."""
    return _with(with_spans(files), _line_columns()).drop("touched")


@columns_once
def _structure_columns() -> list[dict[str, Column]]:
    found, definition = F.col("structure"), F.col("definition")
    functions = F.when(definition.isNotNull(), definition["functions"]).otherwise(found["functions"])
    return [
        {"structure": structure(F.col("text"), F.col("spans"), F.col("language"), F.col("family"))},
        {
            "classes": found["classes"].cast("long"),
            "functions": functions.cast("long"),
            "methods": found["methods"].cast("long"),
            "imports": found["imports"],
        },
    ]


def with_structure(files: DataFrame) -> DataFrame:
    """Add classes, functions, methods, imports (and the struct they come from)."""
    return _with(with_spans(files), _structure_columns())


@columns_once
def _complexity_columns() -> list[dict[str, Column]]:
    text, family, definition = F.col("text"), F.col("family"), F.col("definition")
    analyzed = F.length("text") > 0
    declared = definition["interfaces"] + definition["types"] + definition["functions"]
    # An empty file of a parsed language keeps the parser's base complexity of 1.
    empty_base = F.when((F.col("status") == "empty") & family.isin("python", "js"), 1).otherwise(0)
    index = cx.maintainability_index(F.col("halstead"), F.col("cyclomatic"), F.col("sloc"))
    score = cx.complexity_score(
        F.col("cyclomatic"), F.col("cognitive"), F.col("maintainability_index"),
        F.col("halstead"), F.col("sloc"), F.col("functions"), F.col("classes"),
    )
    return [
        {"tokens": identifiers(text)},
        {
            "cyclomatic": F.when(definition.isNotNull(), declared)
            .when(analyzed, cx.cyclomatic(text, family, F.col("tokens")))
            .otherwise(empty_base)
            .cast("long"),
            "cognitive": cx.cognitive(text, family).cast("long"),
            "halstead_parts": cx.halstead_parts(text, family, F.col("tokens")),
        },
        {"halstead": cx.halstead_volume(F.col("halstead_parts"))},
        {"maintainability_index": F.when(analyzed, index).otherwise(F.lit(0.0))},
        {
            "complexity_score": F.when(
                definition.isNotNull(), (declared + definition["interfaces"]).cast("double")
            )
            .when(analyzed, score)
            .otherwise(empty_base.cast("double"))
        },
        {
            "maintainability_level": cx.maintainability_level(F.col("maintainability_index")),
            "complexity_level": cx.complexity_level(F.col("complexity_score")),
        },
    ]


def with_complexity(files: DataFrame) -> DataFrame:
    """Add the complexity columns after ``with_lines`` and ``with_structure``."""
    return _with(files, _complexity_columns()).drop("tokens")


@columns_once
def _security_columns() -> list[dict[str, Column]]:
    counts = F.col("security_counts")
    return [
        {"security_counts": fd.security_counts("text", "family")},
        {
            "n_security": sc.total(counts).cast("long"),
            "security_score": sc.security_score(counts),
            "security_level": sc.security_level(counts),
        },
    ]


def with_security(files: DataFrame) -> DataFrame:
    """Add security_counts, n_security, security_score and security_level after ``with_text``."""
    return _with(files, _security_columns())


@columns_once
def _smell_columns() -> list[dict[str, Column]]:
    counts, chunks = F.col("smell_counts"), F.col("chunks")
    return [
        {"chunks": repeated_chunks(F.col("text"))},
        {
            "smell_counts": fd.smell_counts("text", "family", "comment_marker", "chunks"),
            "duplicated_lines": duplicated_lines(chunks).cast("long"),
        },
        {
            "n_smells": sc.total(counts).cast("long"),
            "technical_debt_ratio": sc.technical_debt(counts, F.col("sloc")),
            "smell_severity": sc.smell_severity(counts),
        },
    ]


def with_smells(files: DataFrame) -> DataFrame:
    """Add smell_counts, n_smells, duplicated_lines, technical_debt_ratio and smell_severity after
    ``with_lines``."""
    return _with(files, _smell_columns()).drop("chunks")


@columns_once
def _pattern_columns() -> list[dict[str, Column]]:
    return [{"pattern_counts": fd.pattern_counts("text", "family")}]


def with_patterns(files: DataFrame) -> DataFrame:
    """Add pattern_counts after ``with_text``."""
    return _with(files, _pattern_columns())


def with_custom(files: DataFrame, provided: dict[str, Column] | None = None) -> DataFrame:
    """Add the custom map: language-specific counts and the caller's own named expressions. Entries
    that do not apply to a file are left out."""
    typescript = F.col("language").isin("typescript", "tsx")
    rust = F.col("family") == "rust"
    definition, found = F.col("definition"), F.col("structure")
    entries = {
        "typescript.interfaces": F.when(
            typescript, F.coalesce(definition["interfaces"], found["interfaces"])
        ),
        "typescript.types": F.when(typescript, F.coalesce(definition["types"], found["types"])),
        "rust.structs": F.when(rust, found["classes"] - found["traits"]),
        "rust.traits": F.when(rust, found["traits"]),
        "rust.impls": F.when(rust, found["impls"]),
        "rust.keyword_complexity": F.when(rust, rust_keyword_complexity(F.col("text"))),
        **(provided or {}),
    }
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("key"), value.cast("double").alias("value"))
            for name, value in entries.items()
        ]
    )
    return files.withColumn(
        "custom", F.map_from_entries(F.filter(pairs, lambda entry: entry["value"].isNotNull()))
    )


def file_metrics(files: DataFrame, provided: dict[str, Column] | None = None) -> DataFrame:
    """The whole per-file table without content.

    ``files`` come from ``discover`` or ``with_language``. ``provided`` are extra named expressions
    over the file's columns; they become entries of the custom map.
    """
    measured = with_complexity(with_structure(with_lines(with_text(files))))
    judged = with_patterns(with_smells(with_security(measured)))
    return with_custom(judged, provided).select(
        *BASE, *LINES, *STRUCTURE, *COMPLEXITY, *SECURITY, *SMELLS, "pattern_counts", "custom"
    )


@columns_once
def _security_items(rules: tuple[Rule, ...] = tuple(SECURITY_RULES)) -> Column:
    return fd.rule_findings("text", "family", rules)


@columns_once
def _smell_items(extra_rules: tuple[Rule, ...]) -> Column:
    return fd.smell_findings("text", "family", "comment_marker", extra_rules)


@columns_once
def _pattern_items() -> Column:
    return fd.pattern_findings("text", "family")


def security_issues(files: DataFrame, only: Callable[[Rule], bool] | None = None) -> DataFrame:
    """One row per security finding, located; ``only`` picks the rules that are looked for."""
    rules = SECURITY_RULES if only is None else tuple(rule for rule in SECURITY_RULES if only(rule))
    return with_text(files).select(*KEY, F.inline(_security_items(tuple(rules))))


def code_smells(files: DataFrame, extra_rules: Sequence[Rule] = ()) -> DataFrame:
    """One row per code smell, located."""
    return with_text(files).select(*KEY, F.inline(_smell_items(tuple(extra_rules))))


def findings(files: DataFrame, extra_smells: Sequence[Rule] = ()) -> DataFrame:
    """Security findings and code smells in one table, from one pass over the content."""
    kinds = F.array(
        F.struct(F.lit("security").alias("kind"), _security_items().alias("items")),
        F.struct(F.lit("smell").alias("kind"), _smell_items(tuple(extra_smells)).alias("items")),
    )
    return with_text(files).select(*KEY, F.inline(kinds)).select(*KEY, "kind", F.inline("items"))


def pattern_hits(files: DataFrame) -> DataFrame:
    """One row per design-pattern hit, with its context."""
    return with_text(files).select(*KEY, F.inline(_pattern_items()))
