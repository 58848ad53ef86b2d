"""Measures that were rewritten to cost less for each file: equal results, and the shape that makes them cheap."""

import random
import re

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeloom.constants import rules as R
from codeloom.functions.regex import java_regex, plain
from codeloom.functions.text import filled_lines, identifiers
from codeloom.operators import duplicates as dp
from codeloom.operators import findings as fd
from codeloom.operators import structure as st

PIECES = [
    "def ", "class ", "function f", "(a, b)", " {", "}", "\n", "\n    ", "\t", "\x1c", "\x1f", "\x0b", "x_1", "1.5", "42", "_", ".", ";",
    "import os", "from a import b", "password = 'p'", "eval(", "static getInstance", "create", "observers", " = ", "'", '"', "$", "else if",
]


def _ascii_texts():
    rng = random.Random(3)
    return ["", *("".join(rng.choice(PIECES) for _ in range(rng.randrange(60))) for _ in range(300))]


def test_plain_patterns_match_the_same_in_ascii_text(spark):
    rules = {java_regex(r.pattern if r.sieve is None else r.sieve.pattern, r.ignore_case)
             for r in [*R.SECURITY_RULES, *R.SMELL_RULES, *R.PATTERN_RULES]}
    own = {java_regex(p) for p in (st.PY_IMPORT, st.JS_CLASS, st.JS_FUNCTION, st.JS_METHOD, st.TS_INTERFACE, st.TS_TYPE)}
    patterns = sorted(p for p in rules | own if plain(p) != p)
    assert len(patterns) > 20 and not any("p{L}" in plain(p) or "x{2028}" in plain(p) for p in patterns)
    found = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    frame = spark.createDataFrame([(t,) for t in _ascii_texts()], "text string")
    unlike = frame.select(*[F.sum((found(p) != found(plain(p))).cast("int")).alias(str(i)) for i, p in enumerate(patterns)])
    assert set(unlike.first()) == {0}


def test_words_and_filled_lines(spark):
    texts = [*_ascii_texts(), "élan 1a _b\n \n x", "áb c"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = frame.select("text", identifiers(F.col("text")).alias("words"), filled_lines(F.col("text")).alias("filled"))
    for row in rows.collect():
        assert row.filled == sum(1 for line in row.text.split("\n") if line.strip()), repr(row.text)
        if row.text.isascii():
            assert row.words == re.findall(r"\b[A-Za-z_]\w*", row.text), repr(row.text)


def test_chunks_sort_as_flat_structs(spark):
    # a struct within a struct makes Spark set up its comparison for every pair that sort_array compares
    kind = spark.createDataFrame([("",)], "text string").select(dp.chunks_of(F.col("text")).alias("c")).schema["c"].dataType.elementType
    assert not any(isinstance(field.dataType, StructType) for field in kind.fields)


def test_chunks_that_overlap_and_chunks_with_common_lines(spark):
    block = "\n".join(f"line number {i} of a block" for i in range(6))
    texts = {
        "\n".join(["one line of text"] * 7): [(1, 2)],
        "\n".join(["one line of text"] * 6): [],
        "\n".join(["abc"] * 7): [],  # 23 characters
        "\n".join(["ab", "cd"] * 20): [],
        f"{block}\n{block}": [(1, 7)],
        f"{block}\nx\n{block}\n{block}": [(1, 8)],
        f"{block}\n" + "\n".join(reversed(block.split("\n"))): [],
        "": [],
    }
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in frame.select("text", dp.repeated_chunks(F.col("text")).alias("found")).collect():
        assert sorted((p.first, p.second) for p in row.found)[:1] == texts[row.text], row.text


def test_function_ends_near_and_far(spark):
    inner = [0, 14, 15, 16, 17, 255, 256, 300]
    texts = ["function f() {\n" + "x\n" * n + "}\nafter()\n" for n in inner]
    frame = spark.createDataFrame([(n, t) for n, t in zip(inner, texts, strict=True)], "n int, text string")
    rows = frame.select("n", fd.js_functions(F.col("text")).alias("found")).collect()
    assert sorted((r.n, [f.length for f in r.found]) for r in rows) == [(n, [n + 1]) for n in inner]
