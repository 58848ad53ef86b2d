"""Positional regular-expression scans and running folds over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.text import let, newlines

# Appending to an array copies it, so results are gathered in blocks of this size: half a block is copied for each result,
# and the list of blocks for each block.
BLOCK = 64
CONTEXT_CHARS = 20
LOCATION = "struct<position:int,line:int,col:int>"


def running(
    steps: Column,
    zero: Column,
    emit: Callable[[Column, Column], Column],
    advance: Callable[[Column, Column], Column],
    emitted: str,
    keep: Callable[[Column], Column] | None = None,
) -> Column:
    """Fold over ``steps`` and return what ``emit(state, step)`` gives for every kept step."""
    start = F.struct(
        zero.alias("state"),
        F.expr(f"cast(array() as array<{emitted}>)").alias("block"),
        F.expr(f"cast(array() as array<array<{emitted}>>)").alias("done"),
    )

    def merge(acc: Column, step: Column) -> Column:
        item = F.array(emit(acc["state"], step))
        full = F.size(acc["block"]) >= BLOCK
        block = F.when(full, item).otherwise(F.concat(acc["block"], item))
        done = F.when(full, F.concat(acc["done"], F.array(acc["block"]))).otherwise(acc["done"])
        if keep is not None:
            block = F.when(keep(step), block).otherwise(acc["block"])
            done = F.when(keep(step), done).otherwise(acc["done"])
        return F.struct(
            advance(acc["state"], step).alias("state"), block.alias("block"), done.alias("done")
        )

    return F.aggregate(
        steps, start, merge, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["block"])))
    )


def _measure(text: Column, prefix: str) -> list[Column]:
    return [
        F.length(text).alias(f"{prefix}_len"),
        newlines(text).alias(f"{prefix}_nl"),
        F.length(F.substring_index(text, "\n", -1)).alias(f"{prefix}_tail"),
    ]


def _moved(state: Column, step: Column, prefix: str) -> Column:
    length, breaks, tail = (step[f"{prefix}_{part}"] for part in ("len", "nl", "tail"))
    return F.struct(
        (state["position"] + length).alias("position"),
        (state["line"] + breaks).alias("line"),
        F.when(breaks > 0, tail + 1).otherwise(state["col"] + tail).alias("col"),
    )


# Stands at both ends of a match while a text is cut; a text that holds it is cut by two passes.
MARK = "\x01"


def split_by(content: Column, pattern: str) -> Column:
    """struct(gaps, hits): the text between the matches (one more) and the matches.

    One pass over the text puts a mark at both ends of each match, and cutting at the marks gives both in turn.
    """
    marked = F.split(F.regexp_replace(content, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    once = let(
        marked,
        lambda pieces: F.struct(
            F.filter(pieces, lambda _, i: i % 2 == 0).alias("gaps"),
            F.filter(pieces, lambda _, i: i % 2 == 1).alias("hits"),
        ),
    )
    twice = F.struct(
        F.split(content, pattern, -1).alias("gaps"),
        F.regexp_extract_all(content, F.lit(pattern), F.lit(0)).alias("hits"),
    )
    return F.when(content.contains(MARK), twice).otherwise(once)


def _locations(parts: Column) -> Column:
    """0-based position, 1-based line and column of every hit, in one pass over the pieces."""
    steps = F.zip_with(
        F.slice(parts["gaps"], F.lit(1), F.size(parts["hits"])),
        parts["hits"],
        lambda gap, hit: F.struct(*_measure(gap, "gap"), *_measure(hit, "hit")),
    )
    zero = F.struct(
        F.lit(0).alias("position"), F.lit(1).alias("line"), F.lit(1).alias("col")
    )
    return running(
        steps,
        zero,
        emit=lambda state, step: _moved(state, step, "gap"),
        advance=lambda state, step: F.struct(
            (state["position"] + step["gap_len"] + step["hit_len"]).alias("position"),
            (state["line"] + step["gap_nl"] + step["hit_nl"]).alias("line"),
            F.when(step["hit_nl"] > 0, step["hit_tail"] + 1)
            .when(step["gap_nl"] > 0, step["gap_tail"] + 1 + step["hit_tail"])
            .otherwise(state["col"] + step["gap_tail"] + step["hit_tail"])
            .alias("col"),
        ),
        emitted=LOCATION,
    )


def locate(parts: Column) -> Column:
    """array<struct<position,line,col,text>> of the hits in ``split_by`` parts."""
    return F.zip_with(
        _locations(parts),
        parts["hits"],
        lambda at, hit: F.struct(
            at["position"].alias("position"),
            at["line"].alias("line"),
            at["col"].alias("col"),
            hit.alias("text"),
        ),
    )


def scan(content: Column, pattern: str) -> Column:
    """Every match with its location: array<struct<position,line,col,text>>.

    ``pattern`` is a Java pattern whose matches are never empty.
    """
    return let(split_by(content, pattern), locate)


def _before(parts: Column, index: Column) -> Column:
    """The characters in front of hit ``index``, from as many pieces as could be needed."""
    first = F.greatest(index - CONTEXT_CHARS, F.lit(0))
    near = F.zip_with(
        F.slice(parts["gaps"], first + 1, index - first),
        F.slice(parts["hits"], first + 1, index - first),
        lambda gap, hit: F.concat(
            F.right(gap, F.lit(CONTEXT_CHARS)), F.right(hit, F.lit(CONTEXT_CHARS))
        ),
    )
    text = F.concat(
        F.array_join(near, ""), F.right(F.get(parts["gaps"], index), F.lit(CONTEXT_CHARS))
    )
    return F.right(text, F.lit(CONTEXT_CHARS))


def _after(parts: Column, index: Column) -> Column:
    near = F.zip_with(
        F.slice(parts["gaps"], index + 2, F.lit(CONTEXT_CHARS + 1)),
        F.slice(parts["hits"], index + 2, F.lit(CONTEXT_CHARS + 1)),
        lambda gap, hit: F.concat(
            F.left(F.coalesce(gap, F.lit("")), F.lit(CONTEXT_CHARS)),
            F.left(F.coalesce(hit, F.lit("")), F.lit(CONTEXT_CHARS)),
        ),
    )
    return F.left(F.array_join(near, ""), F.lit(CONTEXT_CHARS))


def locate_with_context(parts: Column) -> Column:
    """array<struct<position,line,context>>, the context being the hit and 20 characters around."""
    return F.transform(
        _locations(parts),
        lambda at, i: F.struct(
            at["position"].alias("position"),
            at["line"].alias("line"),
            F.concat(_before(parts, i), F.get(parts["hits"], i), _after(parts, i)).alias("context"),
        ),
    )


def scan_with_context(content: Column, pattern: str) -> Column:
    return let(split_by(content, pattern), locate_with_context)
