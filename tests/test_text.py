"""Random text: Spark expressions against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

import models
from codeloom.constants import levels
from codeloom.constants import rules as R
from codeloom.functions.regex import glob_regex, java_regex
from codeloom.functions.scan import BLOCK, scan, scan_with_context
from codeloom.functions.text import clean, filled_lines, identifiers, iterated_lines, split_lines, strip
from codeloom.operators import complexity as cx
from codeloom.operators import duplicates as dp
from codeloom.operators import findings as fd

TEXTS = ["", "\n", "\n\n", " \t\n x", "x", "a=b\r", *models.random_texts(250, seed=7)]
LONG = ["x = 1\n" * (BLOCK * 3 + 5), "{\n" * 300 + "function deep() {\n" + "x\n" * 700 + "}\n" * 301,
        "".join(f"const f{i} = (a) => {{\n  if (a) {{\n" for i in range(300)) + "}\n" * 400,
        "class C:\n" + "".join(f"    def m{i}(self):\n        return {i}\n\n" for i in range(400))]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS + LONG)], "id int, text string").cache()


def evaluate(texts, column):
    return {r.text: r.value for r in texts.select("text", column.alias("value")).collect()}


def test_line_and_word_helpers(texts):
    column = F.struct(
        strip(F.col("text")).alias("strip"), filled_lines(F.col("text")).alias("filled"),
        split_lines(F.col("text")).alias("split"), iterated_lines(F.col("text")).alias("iterated"),
        identifiers(F.col("text")).alias("words"),
    )
    for text, got in evaluate(texts, column).items():
        assert got.strip == text.strip()
        assert got.filled == sum(bool(line.strip()) for line in text.split("\n"))
        assert got.split == (len(text.split("\n")) if text else 0)
        assert got.iterated == len([line for line in text.split("\n")]) - (1 if text.endswith("\n") or not text else 0)
        assert got.words == re.findall(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b", text)


@pytest.mark.parametrize("pattern", [r"=", r"\w+\s*:", r"def\s+(\w+)\s*\(", r"[^=!]=(?!=)[^=]", r"\{[^}]*\}", r"\bif\b"])
def test_scan_equals_finditer(texts, pattern):
    java = java_regex(pattern)
    column = F.struct(scan(F.col("text"), java).alias("hits"), scan_with_context(F.col("text"), java).alias("near"))
    for text, got in evaluate(texts, column).items():
        expected = models.located(pattern, text)
        assert [tuple(h) for h in got.hits] == expected
        assert [tuple(h) for h in got.near] == [
            (p, line, text[max(0, p - 20):p + len(hit) + 20]) for p, line, _, hit in expected
        ]


def test_every_rule_pattern_means_the_same(texts):
    rules = [*R.SECURITY_RULES, *R.SMELL_RULES, *R.PATTERN_RULES, *R.STRICT_RULES]
    wanted = {}
    for rule in rules:
        wanted[rule.rule_id] = (rule.pattern, re.IGNORECASE if rule.ignore_case else 0)
    columns = [
        F.regexp_count("text", F.lit(java_regex(r.pattern, r.ignore_case))).alias(r.rule_id) for r in rules
    ]
    for row in texts.select("text", *columns).collect():
        for rule_id, (pattern, flags) in wanted.items():
            assert row[rule_id] == len(list(re.finditer(pattern, row.text, flags))), (rule_id, row.text)


def test_else_if_starts_with_its_keyword(texts):
    odd = ["else if", "elseif", "xelse if", "\u00e9else if", "else\n\u00a0if", "else ifs", "else if_", "_else if", "else  if else if",
           "\U0001d482else if", "\U0001f600else if"]
    odd = texts.sparkSession.createDataFrame([(t,) for t in odd], "text string")
    column = F.regexp_count("text", F.lit(java_regex(cx.ELSE_IF)))
    for text, got in (evaluate(texts, column) | evaluate(odd, column)).items():
        assert got == len(re.findall(r"\belse\s+if\b", text)), text
    # a look-behind in front is tried at every place of a text
    assert java_regex(cx.ELSE_IF).startswith("(?d)else")


def test_cognitive_complexity(texts):
    column = F.struct(cx.python_cognitive(F.col("text")).alias("py"), cx.js_cognitive(F.col("text")).alias("js"))
    for text, got in evaluate(texts, column).items():
        assert got.py == models.python_cognitive(text, levels.PYTHON_NESTING_WORDS)
        assert got.js == models.js_cognitive(text)


def test_halstead_counts(texts):
    for family, words in (("python", levels.PYTHON_OPERATOR_WORDS), ("js", levels.OTHER_OPERATOR_WORDS)):
        column = cx.halstead_parts(F.col("text"), F.lit(family), identifiers(F.col("text")))
        for text, got in evaluate(texts, column).items():
            assert tuple(got) == models.halstead_sets(text, words), text


def test_python_function_lengths(texts):
    for text, got in evaluate(texts, fd.python_functions(F.col("text"))).items():
        assert [(f.name, f.position, f.length) for f in got] == models.python_function_lengths(text)


def test_js_function_lengths(texts):
    patterns = [pattern for pattern, _ in R.JS_FUNCTIONS]
    for text, got in evaluate(texts, fd.js_functions(F.col("text"))).items():
        assert [(f.name, f.position, f.length) for f in got] == models.js_function_lengths(text, patterns)


@pytest.mark.parametrize("marker", ["#", "//"])
def test_commented_code(texts, marker):
    column = fd.commented_code_findings(F.col("text"), F.lit(marker))
    for text, got in evaluate(texts, column).items():
        expected = models.commented_blocks(text, marker, levels.CODE_INDICATORS)
        assert [(f.line, f.message) for f in got] == [
            (line, f"Found block of {n} lines of commented-out code") for line, n in expected
        ]


def test_repeated_chunks(spark):
    rng_texts = models.random_texts(120, seed=11, longest=30)
    made = ["".join(rng_texts[i % 7:i % 7 + 5]) + "\n" + "same line of text one\n" * (i % 15) for i in range(60)]
    pad = "\n".join(["a" * 24, "", "", "", "", ""])
    made += [f"{pad}\n{pad}\n", f"{'b' * 25}\n\n\n\n\n{'c' * 5}\n" * 3, f"{'b' * 19}\n\n\n\n\n{'c' * 5}\n" * 2]
    frame = spark.createDataFrame([(t,) for t in made], "text string")
    repeated = 0
    for text, got in evaluate(frame, dp.repeated_chunks(F.col("text"))).items():
        expected = models.repeated(text)
        repeated += len(expected)
        assert sorted((c.first, c.second) for c in got) == expected
    assert repeated > 30


def test_clean_decodes_like_a_tolerant_reader(spark):
    raw = [b"a\r\nb\rc\n", b"\xffx\xc3", "é😀".encode(), b"", b"\r\r\n"]
    frame = spark.createDataFrame([(bytearray(r),) for r in raw], "raw binary")
    got = [r.text for r in frame.select(clean(F.col("raw")).alias("text")).collect()]
    assert sorted(got) == sorted(
        r.decode("utf-8", errors="ignore").replace("\r\n", "\n").replace("\r", "\n") for r in raw
    )


def test_glob_regex():
    assert re.fullmatch(glob_regex("*.min.*"), "a.min.js") and not re.fullmatch(glob_regex("*.o"), "a.out")
