"""Lexical complexity measures of one file as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.constants.levels import (
    BRANCH_WORDS, CHART_BANDS, COMPLEXITY_LEVELS, MAINTAINABILITY_LEVELS, OTHER_OPERATOR_WORDS,
    PYTHON_BRANCH_WORDS, PYTHON_NESTING_WORDS, PYTHON_OPERATOR_WORDS,
)
from codeloom.functions.regex import WORD, WORD_BEHIND
from codeloom.functions.text import (
    banded, contains_any, count_matches, count_where, let, lines_of, matches, occurrences, strip,
)

OPERATOR_RUN = r"[+\-*/=<>!&|^~%]+"
# The keyword first, so that the look-behind is only tried behind it.
ELSE_IF = rf"else(?<!{WORD_BEHIND}else)\s+if\b"
# A digit first: the look-behind is then only tried where a digit stands.
NUMBER = rf"\p{{Nd}}(?<!{WORD_BEHIND}\p{{Nd}})\p{{Nd}}*+(?:\.\p{{Nd}}+)?(?!{WORD})"
STRING_LITERAL = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"' + r"|'[^'\\]*+(?:\\.[^'\\]*+)*+'"


def cyclomatic(content: Column, family: Column, tokens: Column) -> Column:
    """1 plus the branch tokens; ``tokens`` are the file's identifiers. "else if" counts twice."""

    def branches(branch_words: tuple[str, ...]) -> Column:
        return (
            1
            + count_where(tokens, lambda word: word.isin(*branch_words))
            + F.when(content.contains("else"), count_matches(content, ELSE_IF)).otherwise(0)
            + occurrences(content, "&&")
            + occurrences(content, "||")
            + occurrences(content, "?")
        )

    return (
        F.when(family == "python", branches(BRANCH_WORDS + PYTHON_BRANCH_WORDS))
        .when(family == "js", branches(BRANCH_WORDS))
        .otherwise(F.lit(1))
    )


def python_steps(content: Column) -> Column:
    """array<struct<indent,nests>> of the filled lines."""
    stripped = F.filter(
        F.transform(
            lines_of(content),
            lambda line: F.struct(F.length(line).alias("width"), strip(line).alias("text")),
        ),
        lambda line: line["text"] != "",
    )
    return F.transform(
        stripped,
        lambda line: F.struct(
            (line["width"] - F.length(line["text"])).alias("indent"),
            (line["text"].endswith(":") & contains_any(line["text"], PYTHON_NESTING_WORDS)).alias("nests"),
        ),
    )


def python_cognitive(content: Column, depth: Column | None = None) -> Column:
    """A line ending in a colon with a nesting word costs the depth plus one and deepens; another
    line that sits shallower than the depth resets it to its indent / 4. ``depth`` is that in front of the text."""
    start = F.lit(0) if depth is None else depth.cast("int")
    zero = F.struct(F.lit(0).alias("cost"), start.alias("depth"))
    return F.aggregate(
        python_steps(content),
        zero,
        lambda acc, line: F.struct(
            F.when(line["nests"], acc["cost"] + acc["depth"] + 1).otherwise(acc["cost"]).alias("cost"),
            F.when(line["nests"], acc["depth"] + 1)
            .when(line["indent"] < acc["depth"] * 4, F.shiftright(line["indent"], 2))
            .otherwise(acc["depth"])
            .alias("depth"),
        ),
        lambda acc: acc["cost"],
    )


def brace_lines(content: Column) -> Column:
    """The braces of every line, one string per line."""
    return lines_of(F.regexp_replace(content, r"[^{}\n]++", ""))


def opening(braces: Column) -> Column:
    return F.length(F.replace(braces, F.lit("}"), F.lit("")))


def js_cognitive(content: Column, depth: Column | None = None) -> Column:
    """A line with an opening brace costs the depth plus one; braces move the depth, floored at 0. ``depth`` is that in
    front of the text."""
    steps = F.filter(brace_lines(content), lambda braces: braces != "")
    start = F.lit(0) if depth is None else depth.cast("int")
    zero = F.struct(F.lit(0).alias("cost"), start.alias("depth"))

    def merge(acc: Column, braces: Column) -> Column:
        return F.struct(
            F.when(braces.contains("{"), acc["cost"] + acc["depth"] + 1).otherwise(acc["cost"]).alias("cost"),
            F.greatest(F.lit(0), acc["depth"] + 2 * opening(braces) - F.length(braces)).alias("depth"),
        )

    return F.aggregate(steps, zero, merge, lambda acc: acc["cost"])


def cognitive(content: Column, family: Column) -> Column:
    return (
        F.when(family == "python", F.when(content.contains(":"), python_cognitive(content)).otherwise(0))
        .when(family == "js", F.when(content.contains("{"), js_cognitive(content)).otherwise(0))
        .otherwise(F.lit(0))
    )


def halstead_parts(content: Column, family: Column, tokens: Column) -> Column:
    """struct(operators, operands, distinct_operators, distinct_operands).

    Symbol runs, keywords, identifiers, numbers and string literals cannot equal each other, so
    distinct counts add up.
    """

    keywords = F.when(
        family == "python", F.filter(tokens, lambda word: word.isin(*PYTHON_OPERATOR_WORDS))
    ).otherwise(F.filter(tokens, lambda word: word.isin(*OTHER_OPERATOR_WORDS)))
    raw = F.struct(
        F.regexp_extract_all(content, F.lit(OPERATOR_RUN + "+"), F.lit(0)).alias("symbols"),
        keywords.alias("keywords"),
        tokens.alias("words"),
        matches(content, NUMBER).alias("numbers"),
        F.when(
            contains_any(content, ('"', "'")),
            F.regexp_extract_all(content, F.lit("(?d)" + STRING_LITERAL), F.lit(0)),
        ).otherwise(F.expr("cast(array() as array<string>)")).alias("strings"),
    )

    def sizes(parts: Column) -> dict[str, Column]:
        return {name: F.size(parts[name]) for name in ("symbols", "keywords", "words", "numbers", "strings")}

    def distinct(parts: Column) -> dict[str, Column]:
        return {name: F.size(F.array_distinct(parts[name])) for name in sizes(parts)}

    def operators(n: dict[str, Column]) -> Column:
        return n["symbols"] + n["keywords"]

    def operands(n: dict[str, Column]) -> Column:
        # Words that are not keywords.
        return n["words"] - n["keywords"] + n["numbers"] + n["strings"]

    return let(
        raw,
        lambda parts: F.struct(
            operators(sizes(parts)).alias("operators"),
            operands(sizes(parts)).alias("operands"),
            operators(distinct(parts)).alias("distinct_operators"),
            operands(distinct(parts)).alias("distinct_operands"),
        ),
    )


def halstead_volume(parts: Column) -> Column:
    length = parts["operators"] + parts["operands"]
    vocabulary = parts["distinct_operators"] + parts["distinct_operands"]
    measurable = (parts["distinct_operators"] > 0) & (parts["distinct_operands"] > 0)
    return F.when(measurable, length * F.log2(vocabulary.cast("double"))).otherwise(F.lit(0.0))


def maintainability_index(volume: Column, branches: Column, sloc: Column) -> Column:
    """100 without source lines; otherwise the classic formula rescaled and clamped to 0..100."""
    raw = (
        F.lit(171.0)
        - 5.2 * F.log(F.greatest(F.lit(1.0), volume))
        - 0.23 * F.when(branches == 0, 1).otherwise(branches)
        - 16.2 * F.log(F.greatest(F.lit(1), sloc).cast("double"))
    )
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 100 / 171))
    return F.when(sloc == 0, F.lit(100.0)).otherwise(scaled)


def complexity_score(branches, nesting, index, volume, sloc, functions, classes) -> Column:
    score = branches * 10 + nesting * 15 + (100 - index) * 5 + volume / 100 + sloc / 10
    return F.when((functions > 10) | (classes > 5), score * 1.2).otherwise(score)


def complexity_level(score: Column) -> Column:
    return banded(score, COMPLEXITY_LEVELS)


def chart_band(score: Column) -> Column:
    return banded(score, CHART_BANDS)


def maintainability_level(index: Column) -> Column:
    out = None
    for label, low in MAINTAINABILITY_LEVELS:
        hit = F.lit(True) if low is None else index >= low
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def named_metrics(branches, nesting, index, volume) -> Column:
    return F.create_map(
        F.lit("cyclomatic"), branches.cast("double"),
        F.lit("cognitive"), nesting.cast("double"),
        F.lit("maintainability"), index,
        F.lit("halstead"), volume,
    )
