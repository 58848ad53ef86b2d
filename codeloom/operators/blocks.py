"""Measures of huge files, a file dealt to many tasks.

The folds over the lines of a file keep a small state: the nesting depth, or whether a comment is open. What a block of lines
does to that state is a function with a short summary, and summaries of neighbouring blocks compose:

* a Python line takes the depth d to d + 1 or to min(d, m), so a block takes it to min(d + a, b);
* braces take it to max(d + a, b), as it is floored at 0;
* a definition file's block is described by what becomes of an open comment and of none.

Blocks are summarised each in its task, the summaries of a file (one short row per block) give the state in front of each
block, and the blocks are folded again from there. The sums are those of the sequential fold, wherever the file is cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import filled_lines, let, lines_of
from codeloom.operators.complexity import brace_lines, js_cognitive, opening, python_cognitive, python_steps
from codeloom.operators.lines import DEFINITION_STATE, definition_fold

BLOCK_LINES = 20_000
FAR = 1 << 30
KEY = ("project", "path")


def in_blocks(files: DataFrame, lines: int = BLOCK_LINES) -> DataFrame:
    """project, path, block, first_line (from 1) and text of files (project, path, content), ``lines`` lines a block.

    The blocks are dealt by file and number, so that those of one file lie in many tasks.
    """

    def cut(held: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / lines).cast("int"))
        return F.transform(starts, lambda k: F.array_join(F.slice(held, k * lines + 1, F.lit(lines)), "\n"))

    blocks = files.select(*KEY, F.posexplode(let(lines_of(F.col("content")), cut)).alias("block", "text"))
    return blocks.repartition(*KEY, "block").withColumn("first_line", F.col("block") * lines + 1)


def _entered(blocks: DataFrame, summary: Column, zero: Column, after: Callable[[Column, Column], Column]) -> DataFrame:
    """``blocks`` with entry: the state in front of each, from ``zero`` and what ``after(state, summary)`` makes of it."""
    held = blocks.select(*KEY, "block", summary.alias("does")).groupBy(*KEY)
    ordered = held.agg(F.sort_array(F.collect_list(F.struct("block", "does"))).alias("all"))
    start = F.struct(zero.alias("state"), F.array(zero).alias("entries"))

    def step(acc: Column, one: Column) -> Column:
        return let(
            after(acc["state"], one["does"]),
            lambda state: F.struct(state.alias("state"), F.concat(acc["entries"], F.array(state)).alias("entries")),
        )

    entries = F.aggregate("all", start, step, lambda acc: acc["entries"])
    states = ordered.select(*KEY, F.posexplode(F.slice(entries, F.lit(1), F.size("all"))).alias("block", "entry"))
    return blocks.join(states, [*KEY, "block"])


def _python_summary(text: Column) -> Column:
    """struct(a, b): the lines take a depth d to min(d + a, b)."""
    return F.aggregate(
        python_steps(text),
        F.struct(F.lit(0).alias("a"), F.lit(FAR).alias("b")),
        lambda acc, line: F.struct(
            (acc["a"] + line["nests"].cast("int")).alias("a"),
            F.when(line["nests"], acc["b"] + 1)
            .otherwise(F.least(acc["b"], F.shiftright(line["indent"], 2)))
            .alias("b"),
        ),
    )


def _brace_summary(text: Column) -> Column:
    """struct(a, b): the lines take a depth d to max(d + a, b)."""
    steps = F.transform(
        F.filter(brace_lines(text), lambda braces: braces != ""),
        lambda braces: 2 * opening(braces) - F.length(braces),
    )
    return F.aggregate(
        steps,
        F.struct(F.lit(0).alias("a"), F.lit(-FAR).alias("b")),
        lambda acc, net: F.struct(
            (acc["a"] + net).alias("a"), F.greatest(F.lit(0), acc["b"] + net).alias("b")
        ),
    )


def cognitive_in_blocks(files: DataFrame, python: bool, lines: int = BLOCK_LINES) -> DataFrame:
    """project, path and cognitive of files (project, path, content), all Python or all with braces."""
    blocks = in_blocks(files, lines)
    text, entry = F.col("text"), F.col("entry")
    bound = F.least if python else F.greatest
    summary = _python_summary(text) if python else _brace_summary(text)
    entered = _entered(blocks, summary, F.lit(0), lambda depth, does: bound(depth + does["a"], does["b"]))
    cost = python_cognitive(text, entry) if python else js_cognitive(text, entry)
    return entered.select(*KEY, cost.cast("long").alias("cost")).groupBy(*KEY).agg(F.sum("cost").alias("cognitive"))


def definitions_in_blocks(files: DataFrame, lines: int = BLOCK_LINES) -> DataFrame:
    """project, path, loc, blanks, comments, interfaces, types and functions of definition files (project, path, content)."""
    blocks = in_blocks(files, lines)
    text = F.col("text")
    summary = F.struct(
        definition_fold(text, F.lit(False))["open"].alias("closed"), definition_fold(text, F.lit(True))["open"].alias("opened")
    )
    entered = _entered(blocks, summary, F.lit(False), lambda opened, does: F.when(opened, does["opened"]).otherwise(does["closed"]))
    folded = entered.select(
        *KEY, "block", F.size(lines_of(text)).alias("n"), (text == "").alias("bare"), filled_lines(text).alias("filled"),
        F.substring_index(text, "\n", -1).alias("tail"), definition_fold(text, F.col("entry")).alias("found"),
    )
    sums = folded.groupBy(*KEY).agg(
        F.sum("n").alias("n"), F.max(F.struct("block", (F.col("tail") == "").alias("ended"))).alias("last"), F.sum("filled").alias("filled"),
        *[F.sum(f"found.{name}").cast("int").alias(name) for name in DEFINITION_STATE],
    )
    # a final line feed opens no further line
    loc = F.col("n") - F.col("last.ended").cast("int")
    return sums.select(*KEY, loc.cast("int").alias("loc"), (loc - F.col("filled")).cast("int").alias("blanks"), *DEFINITION_STATE)
