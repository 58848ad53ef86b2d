"""Rules whose patterns look far ahead: the same matches as the plain pattern, in time proportional to the text."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

import models
from codeloom.constants import rules as R
from codeloom.operators import findings as fd

RULES = [*R.SECURITY_RULES, *R.SMELL_RULES, *R.PATTERN_RULES]
SIEVED = [rule for rule in RULES if rule.sieve is not None]

# What the patterns are made of, and what they stop at.
PARTS = {
    "execute": ["execute(", "cursor.execute(", "f'", 'f"', "'", '"', "{", "}", "+", "%", ",", ")", "x", " ", "\n"],
    "call": ["os.system(", "subprocess.call(", "subprocess.Popen(", "eval(", "yaml.load(", "document.write(",
             "'ls'", '"a"', "x", ")", ",", "\n", " "],
    "default": ["def f(", "def  g (", "=", "= ", "[]", "{}", "()", "{ : }", "[ ]", "( )", ")", ",", "a", "\n", "def"],
    "create": ["def create_a(", "def create_b(\n", "def create_c( ", ")", ":", " :", "\n", "x", " ", "def ", "(", ").\n"],
    "decorator": ["@a(", "@b.c(", "@d", "@e.f ", ")", " def g(", "\ndef h(", "\n", "x", "@", " ", "(", "\n  class K("],
    "module": ["(function(){", "(\nfunction(){", "(function(\n){", "( function ( ) {", "}", ")", "(", "})()", "} ) ( )",
               "\n", "x", " ", ")()"],
    "object": ["return {a:", "return{\nb:", "return\n{ c :", "return { d\n:", "}", "\n", "x", " ", "return", "{", "e:"],
    "chain": ["a", ".prototype.", "create", ".prototype.createX", "b =", "=", " ", "\n", "prototype"],
    "function": ["function f(", "const g = function (", "let h = (", "k: function (", ")", "{", ") {", ") => {", "a", ",",
                 "\n", " ", "=>", ":", "function"],
}


def _texts(seed):
    rng = random.Random(seed)
    return [
        "".join(rng.choices(parts, k=rng.randint(0, 40))) for parts in PARTS.values() for _ in range(250)
    ] + models.random_texts(100, seed)


@pytest.fixture(scope="module")
def rows(spark):
    texts = _texts(5)
    table = [(k, family, text) for k, text in enumerate(texts) for family in ("python", "js")]
    return spark.createDataFrame(table, "id int, family string, text string").repartition(8).cache()


def test_sieves_find_what_the_patterns_find(rows):
    found = rows.select(
        "family", "text", fd.rule_counts("text", "family", RULES).alias("counts"),
        fd.rule_findings("text", "family", [r for r in RULES if r.kind != "pattern"]).alias("findings"),
        fd.pattern_findings("text", "family").alias("hits"),
    )
    seen = dict.fromkeys((r.rule_id for r in SIEVED), 0)
    for row in found.collect():
        counts = {c.rule_id: c.n for c in row.counts}
        places = {}
        for f in row.findings:
            places.setdefault(f.rule_id, []).append((f.position, f.line))
        for h in row.hits:
            places.setdefault(h.rule_id, []).append((h.position, h.line, h.context))
        for rule in SIEVED:
            if rule.family != row.family:
                continue
            wanted = models.located(rule.pattern, row.text, re.IGNORECASE if rule.ignore_case else 0)
            seen[rule.rule_id] += len(wanted)
            assert counts.get(rule.rule_id, 0) == len(wanted), (rule.rule_id, row.text)
            if rule.kind == "pattern":
                expected = [(p, line, row.text[max(0, p - 20):p + len(hit) + 20]) for p, line, _, hit in wanted]
            else:
                expected = [(p, line) for p, line, _, _ in wanted]
            assert places.get(rule.rule_id, []) == expected, (rule.rule_id, row.text)
    assert min(seen.values()) >= 5, seen


def test_function_shapes_find_what_the_patterns_find(rows):
    patterns = [pattern for pattern, _ in R.JS_FUNCTIONS]
    total = 0
    for row in rows.filter("family = 'js'").select("text", fd.js_functions(F.col("text")).alias("found")).collect():
        wanted = models.js_function_lengths(row.text, patterns)
        total += len(wanted)
        assert [(f.name, f.position, f.length) for f in row.found] == wanted, row.text
    assert total > 100


PREFIXES = {
    "python": [
        "os.system(", "subprocess.call(", "subprocess.Popen(x", "eval(", "execute(", "execute(x)", "execute(x+", "execute(%",
        'execute(f"', 'execute(f"{', "cursor.execute(x) ", "pickle.load(", "yaml.load(", "password = '", 'token="x', "secret ",
        "from a import ", "except ", "def f(", "def f(a, b, c\n", "def f(a=", "def f(a=[], ", "def create_a(", "def create_a(x) ",
        "class AFactory", "@a(", "@a.b ", "@classmethod def ", "self._observers = ", "def __init__(self, ", "class aStrategy",
    ],
    "js": [
        "eval(", "document.write(", ".innerHTML = ", "apiKey = '", "console.", "alert(", "= ", "(function(){", "(function(){})",
        "return {a:", "return { a : b ", "define([", "var x = (function(){ var ", "if (!instance) ", "a.prototype.b",
        "a.prototype.create", "prototype", "addEventListener(", "on(", "clone(", "class aFactory", "function f(", "const g = (",
        "let h = function (", "k: function (", "function f(a) ", "function ",
    ],
}


def _seconds(spark, times):
    table = [(family, prefix * times + tail) for family, all_of in PREFIXES.items() for prefix in all_of for tail in ("", ")")]
    frame = spark.createDataFrame(table, "family string, text string").repartition(64).cache()
    frame.count()
    start = time.perf_counter()
    counts = F.size(fd.rule_counts("text", "family", RULES))
    lengths = F.when(F.col("family") == "js", F.size(fd.js_functions(F.col("text"), 30)))
    frame.select(F.sum(counts), F.sum(lengths)).collect()
    seconds = time.perf_counter() - start
    frame.unpersist()
    return seconds


def test_time_grows_with_the_text(spark):
    _seconds(spark, 100)
    short, long = _seconds(spark, 4_000), _seconds(spark, 16_000)
    assert long < 8 * short + 2, (short, long)
