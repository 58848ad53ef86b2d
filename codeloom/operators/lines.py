"""Line-grain measures of one file, each a single pass over its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.scan import split_by
from codeloom.functions.text import (
    contains_any, count_where, filled_lines, iterated_lines, let, lines_of, newlines, split_lines, strip,
)

# String literals are skipped so that comment markers inside them do not count. The quantifiers are
# possessive: Java then loops instead of recursing on long literals.
DOUBLE_QUOTED = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"'
SINGLE_QUOTED = r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
TEMPLATE = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"
TRIPLE_QUOTED = r'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''"
HASH = r"#[^\n]*+"
SLASHES = r"//[^\n]*+|/\*[\s\S]*?\*/"


PYTHON_TOKENS = f"{TRIPLE_QUOTED}|{HASH}|{DOUBLE_QUOTED}|{SINGLE_QUOTED}"
SLASH_TOKENS = f"{SLASHES}|{DOUBLE_QUOTED}|{SINGLE_QUOTED}"
JS_TOKENS = f"{SLASH_TOKENS}|{TEMPLATE}"
RUBY_TOKENS = rf"=begin[\s\S]*?=end|{HASH}|{DOUBLE_QUOTED}|{SINGLE_QUOTED}"
PHP_TOKENS = f"{HASH}|{SLASH_TOKENS}"


def lexed(content: Column, language: Column, family: Column) -> Column:
    """The spans of a file, lexed once for all that needs them: struct(gaps, hits), the code between comments and string
    literals, and these. Null for text without a comment mark or a quote, which is code as a whole."""
    parts = (
        F.when(family == "python", split_by(content, PYTHON_TOKENS))
        .when(family == "js", split_by(content, JS_TOKENS))
        .when(language == "ruby", split_by(content, RUBY_TOKENS))
        .when(language == "php", split_by(content, PHP_TOKENS))
        .otherwise(split_by(content, SLASH_TOKENS))
    )
    return F.when(contains_any(content, ("#", "//", "/*", '"', "'", "`", "=begin")), parts)


def _is_literal(hit: Column) -> Column:
    quoted = hit.startswith('"') | hit.startswith("'") | hit.startswith("`")
    return quoted & ~hit.startswith('"""') & ~hit.startswith("'''")


def touched_lines(spans: Column) -> Column:
    """struct(comments, marked): distinct lines touched by a comment, and by a comment or a string
    literal; ``spans`` is ``lexed``. A line counts once, so a token adds its own lines but for one already counted."""
    steps_of = lambda parts: F.zip_with(
        parts["gaps"],
        parts["hits"],
        lambda gap, hit: F.struct(
            (newlines(gap) > 0).alias("broken"),
            newlines(hit).alias("breaks"),
            _is_literal(hit).alias("literal"),
        ),
    )
    zero = F.struct(
        F.lit(0).alias("comments"),
        F.lit(False).alias("on_comment"),
        F.lit(0).alias("marked"),
        F.lit(False).alias("on_mark"),
    )

    def merge(acc: Column, step: Column) -> Column:
        on_comment = acc["on_comment"] & ~step["broken"]
        on_mark = acc["on_mark"] & ~step["broken"]
        return F.struct(
            F.when(step["literal"], acc["comments"])
            .otherwise(acc["comments"] + step["breaks"] + F.when(on_comment, 0).otherwise(1))
            .alias("comments"),
            F.when(step["literal"], on_comment & (step["breaks"] == 0)).otherwise(True).alias("on_comment"),
            (acc["marked"] + step["breaks"] + F.when(on_mark, 0).otherwise(1)).alias("marked"),
            F.lit(True).alias("on_mark"),
        )

    def folded(parts: Column) -> Column:
        # The last gap has no hit behind it.
        steps = F.slice(steps_of(parts), F.lit(1), F.size(parts["hits"]))
        return F.aggregate(steps, zero, merge)

    none = F.struct(F.lit(0).alias("comments"), F.lit(0).alias("marked"))
    found = let(
        folded(spans), lambda acc: F.struct(acc["comments"].alias("comments"), acc["marked"].alias("marked"))
    )
    return F.when(spans.isNull(), none).otherwise(found)


def _edge_comment_lines(content: Column) -> Column:
    """Lines that start with a slash comment or end with its closing mark."""
    return count_where(
        F.transform(lines_of(content), strip),
        lambda line: line.startswith("//") | line.startswith("/*") | line.endswith("*/"),
    )


def comment_lines(content: Column, family: Column, touched: Column) -> Column:
    """Comment lines of a file; ``touched`` is ``touched_lines``."""
    edges = F.when(contains_any(content, ("//", "/*", "*/")), _edge_comment_lines(content)).otherwise(0)
    return F.when(family == "rust", edges).otherwise(touched["comments"])


def comment_or_string_lines(family: Column, touched: Column, comments: Column) -> Column:
    """As ``comment_lines``, but for Python every line touched by a string literal counts too."""
    return F.when(family == "python", touched["marked"].cast("long")).otherwise(comments)


def blank_lines(content: Column) -> Column:
    return split_lines(content) - filled_lines(content)


def definition_counts(content: Column) -> Column:
    """Line and declaration counts of a definition file."""
    return let(iterated_lines(content), lambda n: _definition_fold(content, n))


def _definition(loc, blanks, comments, interfaces, types, functions) -> Column:
    return F.struct(
        loc.cast("int").alias("loc"),
        blanks.cast("int").alias("blanks"),
        comments.cast("int").alias("comments"),
        interfaces.cast("int").alias("interfaces"),
        types.cast("int").alias("types"),
        functions.cast("int").alias("functions"),
    )


DEFINITION_STATE = ("comments", "interfaces", "types", "functions")


def definition_fold(content: Column, opened: Column | None = None) -> Column:
    """struct(open, comments, interfaces, types, functions) after the lines of a text; ``opened`` says that a block comment
    is open in front of it."""
    stripped = F.filter(F.transform(lines_of(content), strip), lambda line: line != "")
    zero = F.struct(
        (F.lit(False) if opened is None else opened).alias("open"),
        *[F.lit(0).alias(name) for name in DEFINITION_STATE],
    )

    def merge(acc: Column, line: Column) -> Column:
        closes = line.contains("*/")
        block = ~acc["open"] & line.startswith("/*")
        comment = acc["open"] | line.startswith("//") | block
        interface = ~comment & line.contains("interface ")
        alias = ~comment & ~interface & line.contains("type ") & line.contains("=")
        function = (
            ~comment & ~interface & ~alias & (line.contains("function ") | line.contains("method("))
        )
        return F.struct(
            ((acc["open"] | block) & ~closes).alias("open"),
            (acc["comments"] + comment.cast("int")).alias("comments"),
            (acc["interfaces"] + interface.cast("int")).alias("interfaces"),
            (acc["types"] + alias.cast("int")).alias("types"),
            (acc["functions"] + function.cast("int")).alias("functions"),
        )

    return F.aggregate(stripped, zero, merge)


def _definition_fold(content: Column, n: Column) -> Column:
    return let(
        definition_fold(content),
        lambda acc: _definition(
            n, n - filled_lines(content), acc["comments"], acc["interfaces"], acc["types"], acc["functions"]
        ),
    )
