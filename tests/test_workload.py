"""Queries against their SQL at the smallest scale, and a corpus that fires every rule."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from codeloom.constants import rules as R  # noqa: E402
from codeloom.plans import file_metrics as fm  # noqa: E402
from conftest import SMALL  # noqa: E402
from tools.check_oracle import compare, connect  # noqa: E402
from workload import corpus, queries  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    line = compare(spark, duck, SMALL, name, entry.queries()[name], entry.oracle_sql()[name])
    assert line.startswith("ok"), line


def test_every_query_is_known():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    frame = entry.entry(spark)
    assert frame.count() > 10 and "code_quality_score" in frame.columns


def test_corpus_fires_every_rule(spark):
    texts = fm.with_text(corpus.typed_files(spark, SMALL))
    rules = fm.with_patterns(fm.with_security(texts)).select(
        F.explode(F.concat("security_counts", "pattern_counts")["rule_id"]).alias("rule_id")
    )
    fired = {r.rule_id for r in rules.distinct().collect()}
    fired |= {r.rule_id for r in fm.code_smells(corpus.typed_files(spark, SMALL)).select("rule_id").distinct().collect()}
    expected = {r.rule_id for r in [*R.SECURITY_RULES, *R.SMELL_RULES, *R.PATTERN_RULES]}
    assert expected - fired == set()


def test_rows_of_one_row_group_are_dealt_to_several_tasks(spark, tmp_path):
    rows = spark.range(25_000).selectExpr(
        "id AS o_orderkey", "id % 100 AS o_custkey", "timestamp '2024-01-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority"
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    number = spark.conf.get(corpus.PARTITIONS)
    spark.conf.unset(corpus.PARTITIONS)
    try:
        files = corpus.files(spark, str(tmp_path), parts=("orders",)).select("path")
        sizes = files.rdd.glom().map(len).collect()
    finally:
        spark.conf.set(corpus.PARTITIONS, number)
    assert sum(sizes) == 25_000 and len(sizes) == 3 and max(sizes) <= 10_000


def test_reports_measure_every_file_once(spark, monkeypatch):
    kept = []
    stored = queries._stored
    monkeypatch.setattr(queries, "_stored", lambda spark, table: kept.append(table.columns) or stored(spark, table))
    report = entry.queries()["json_report"](spark, SMALL)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # files and sums come from the stored table
    entry.queries()["nested_report"](spark, SMALL)
    assert len(kept) == 2 and not any({"content", "text", "spans", "structure"} & set(columns) for columns in kept)
    files, projects = (report.where(F.col("part") == part).count() for part in ("file", "project"))
    metrics = entry.queries()["file_report"](spark, SMALL)
    assert files == metrics.count() and projects == metrics.select("project").distinct().count()
