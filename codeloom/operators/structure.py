"""Classes, functions, methods and imports, counted lexically once strings and comments are gone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.regex import INLINE_SPACE_RANGES, SPACE_RANGES
from codeloom.functions.text import (
    all_matches, count_matches, let, lstrip, occurrences, rstrip,
)
_LINE = rf"(?m)^[{INLINE_SPACE_RANGES}]*+"
PY_CLASS = r"class\s+\w"
PY_DEF = r"(?:async\s+)?def\s+\w"
# An import starts a line or follows another statement on it, and ends with its statement.
PY_IMPORT = rf"(?m)(?:^|(?<=[;:]))[{INLINE_SPACE_RANGES}]*+(import\s[^\n;]+|from\s[^\n;]*?\simport\b[^\n;]*)"
# The keyword first, so that the look-behind is only tried behind it.
JS_CLASS = r"class(?<![\w$.]class)\s+[A-Za-z_$]"
JS_FUNCTION = r"function(?<![\w$.]function)\b\s*+(?:\*\s*+)?[\w$]*+\s*+[(<]"
JS_METHOD = (
    _LINE
    + r"(?:(?:public|private|protected|static|async|override|abstract|get|set)\s+)*+\*?"
    + r"(?!(?:if|for|while|switch|catch|function|return|with|do|else)\b)"
    + r"[#\w$]+\s*\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)\s*(?::[^{}=;()]+)?\{"
)
JS_IMPORT = rf"(?m)(?:^|(?<=;))[{INLINE_SPACE_RANGES}]*+(import\b(?!\s*[(.])[^\n;]*;?)"
TS_INTERFACE = _LINE + r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?interface\s+\w+"
TS_TYPE = _LINE + r"(?:export\s+)?(?:declare\s+)?type\s+\w+\s*(?:<[^=;]*>)?\s*="


def code_of(content: Column, spans: Column) -> Column:
    """The text without string literals and comments; ``spans`` is ``lexed``."""
    return F.when(spans.isNull(), content).otherwise(F.array_join(spans["gaps"], ""))


def js_statements(content: Column, spans: Column) -> Column:
    """JavaScript text without comments; string literals stay."""

    def kept(gap: Column, hit: Column) -> Column:
        comment = hit.startswith("//") | hit.startswith("/*")
        return F.when(hit.isNull() | comment, gap).otherwise(F.concat(gap, hit))

    pieces = F.zip_with(spans["gaps"], spans["hits"], kept)
    return F.when(spans.isNull(), content).otherwise(F.array_join(pieces, ""))


def _structure(classes, functions, methods, imports, interfaces, types, traits=None, impls=None) -> Column:
    zero = F.lit(0)
    return F.struct(
        classes.alias("classes"),
        functions.alias("functions"),
        methods.alias("methods"),
        imports.alias("imports"),
        interfaces.alias("interfaces"),
        types.alias("types"),
        (zero if traits is None else traits).alias("traits"),
        (zero if impls is None else impls).alias("impls"),
    )


def no_structure() -> Column:
    zero = F.lit(0)
    return _structure(zero, zero, zero, F.expr("cast(array() as array<string>)"), zero, zero)


def python_structure(code: Column) -> Column:
    """``code`` is ``code_of``. A function is a method when a class with a smaller indent is
    still open; the outermost open class decides, so its indent is all the state there is."""
    # Of every filled line: its indent and either its first character or the start of a declaration.
    heads = all_matches(code, rf"{_LINE}(?:{PY_CLASS}|{PY_DEF}|[^{SPACE_RANGES}])")
    lines = F.transform(
        F.transform(heads, lambda head: F.struct(head.alias("head"), lstrip(head).alias("text"))),
        lambda line: F.struct(
            (F.length(line["head"]) - F.length(line["text"])).alias("indent"),
            (line["text"].startswith("c") & (F.length(line["text"]) > 1)).alias("opens"),
            (~line["text"].startswith("c") & (F.length(line["text"]) > 1)).alias("defines"),
        ),
    )
    zero = F.struct(
        F.lit(-1).alias("outer"),
        F.lit(0).alias("classes"),
        F.lit(0).alias("functions"),
        F.lit(0).alias("methods"),
    )

    def merge(acc: Column, line: Column) -> Column:
        inside = (acc["outer"] >= 0) & (line["indent"] > acc["outer"])
        return F.struct(
            F.when(inside, acc["outer"])
            .when(line["opens"], line["indent"])
            .otherwise(F.lit(-1))
            .alias("outer"),
            (acc["classes"] + line["opens"].cast("int")).alias("classes"),
            (acc["functions"] + (line["defines"] & ~inside).cast("int")).alias("functions"),
            (acc["methods"] + (line["defines"] & inside).cast("int")).alias("methods"),
        )

    folded = F.aggregate(lines, zero, merge)
    imports = F.transform(all_matches(code, PY_IMPORT, 1), rstrip)
    return let(
        folded,
        lambda acc: _structure(
            acc["classes"], acc["functions"], acc["methods"], imports, F.lit(0), F.lit(0)
        ),
    )


def js_structure(code: Column, statements: Column, typescript: Column) -> Column:
    """``code`` is ``code_of``; ``statements`` is ``js_statements``, null without an import. Methods count as functions."""
    functions = (
        count_matches(code, JS_FUNCTION) + occurrences(code, "=>") + count_matches(code, JS_METHOD)
    )
    imports = F.when(
        statements.isNotNull(), F.transform(all_matches(statements, JS_IMPORT, 1), rstrip)
    ).otherwise(F.expr("cast(array() as array<string>)"))
    return _structure(
        count_matches(code, JS_CLASS),
        functions,
        F.lit(0),
        imports,
        F.when(typescript, count_matches(code, TS_INTERFACE)).otherwise(0),
        F.when(typescript, count_matches(code, TS_TYPE)).otherwise(0),
    )


def rust_structure(content: Column) -> Column:
    """Counts of items at line start; imports are numbered placeholders."""
    uses = occurrences(content, "\nuse ")
    imports = F.when(
        uses > 0,
        F.transform(F.sequence(F.lit(1), F.greatest(uses, F.lit(1))),
                    lambda i: F.concat(F.lit("use_statement_"), i.cast("string"))),
    ).otherwise(F.expr("cast(array() as array<string>)"))
    structs, traits = occurrences(content, "\nstruct "), occurrences(content, "\ntrait ")
    return _structure(
        structs + traits, occurrences(content, "\nfn "), F.lit(0), imports, F.lit(0), F.lit(0),
        traits, occurrences(content, "\nimpl "),
    )


def rust_keyword_complexity(content: Column) -> Column:
    """1 plus the control-flow words followed by a space."""
    total = F.lit(1)
    for word in ("if ", "else ", "match ", "for ", "while ", "loop "):
        total = total + occurrences(content, word)
    return total


def structure(content: Column, spans: Column, language: Column, family: Column) -> Column:
    """struct(classes, functions, methods, imports, interfaces, types, traits, impls) of a file; ``spans`` is ``lexed``."""
    statements = F.when(content.contains("import"), js_statements(content, spans))
    return (
        F.when(family == "python", let(code_of(content, spans), python_structure))
        .when(
            family == "js",
            let(
                F.struct(code_of(content, spans).alias("code"), statements.alias("statements")),
                lambda js: js_structure(
                    js["code"], js["statements"], language.isin("typescript", "tsx")
                ),
            ),
        )
        .when(family == "rust", rust_structure(content))
        .otherwise(no_structure())
    )
