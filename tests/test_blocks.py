"""Folds over blocks of lines against the folds over whole files."""

import pytest
from pyspark.sql import functions as F

import models
from codeloom.constants import levels
from codeloom.operators import blocks as bl
from codeloom.operators.lines import definition_counts

EXTRA = ["interface A {\n", "type B = 1;\n", "/*\n", "x */\n", "function f()\n", "  if x:\n", "        for y:\n", "{ {\n", "} }\n}\n", "class K:\n"]


@pytest.fixture(scope="module")
def files(spark):
    import random

    rng = random.Random(12)
    texts = models.random_texts(60, seed=21, longest=200)
    texts += ["".join(rng.choices(EXTRA + models.ALPHABET, k=rng.randint(0, 150))) for _ in range(120)]
    texts += ["", "\n", "\n\n", "a", "/*\n" * 30, "if x:\n" * 90, "{\n" * 70 + "}\n" * 90 + "{\n" * 5]
    rows = [("p", f"f{k}", text) for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, "project string, path string, content string").repartition(4).cache()


@pytest.mark.parametrize("lines", [1, 3, 7, 10_000])
def test_blocks_equal_whole_files(files, lines):
    held = {r.path: r.content for r in files.collect()}
    for python in (True, False):
        got = {r.path: r.cognitive for r in bl.cognitive_in_blocks(files, python, lines).collect()}
        want = {p: models.python_cognitive(t, levels.PYTHON_NESTING_WORDS) if python else models.js_cognitive(t) for p, t in held.items()}
        assert got == want
    whole = files.select("path", definition_counts(F.col("content")).alias("d")).collect()
    names = ("loc", "blanks", "comments", "interfaces", "types", "functions")
    got = {r.path: tuple(r[n] for n in names) for r in bl.definitions_in_blocks(files, lines).collect()}
    assert got == {r.path: tuple(r.d[n] for n in names) for r in whole}


def test_a_file_is_dealt_to_many_tasks(spark):
    text = "if x:\n    y\n" * 30_000
    files = spark.createDataFrame([("p", "a.py", text)], "project string, path string, content string")
    blocks = bl.in_blocks(files, 1_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        used = blocks.select(F.spark_partition_id().alias("task")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert blocks.count() == 61 and used > 4
    assert blocks.agg(F.sum(F.length("text") + 1)).first()[0] == len(text) + 1
    assert bl.cognitive_in_blocks(files, True, 1_000).first().cognitive == models.python_cognitive(text, levels.PYTHON_NESTING_WORDS)
