"""Rules kept as rows of a table, and their use from SQL.

A rule row becomes a guarded literal pattern of the plan, as the built-in rules are. ``register`` makes a SQL table function
of a set of rules, whose body is such an expression: queries call it LATERAL over any table with a text and a family,
and no Python worker takes part.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.constants.rules import Rule
from codeloom.operators.findings import counts_sql

SCHEMA = (
    "rule_id string, kind string, family string, type string, pattern string, literal string, severity string,"
    " level string, message string, ignore_case boolean"
)
MOST_RULES = 10_000  # a plan holds every rule as a literal
_NAME = re.compile(r"[A-Za-z_]\w*")


def rules_of(table: DataFrame) -> list[Rule]:
    """The rules of a table with SCHEMA, by rule_id; a bad pattern, a missing name or a table beyond MOST_RULES is an error.

    Missing texts are empty; without a literal the pattern is tried on every file of its family.
    """
    rows = table.orderBy("rule_id").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out = []
    for row in rows:
        if not (row.rule_id and row.family and row.pattern):
            raise ValueError(f"a rule needs rule_id, family and pattern: {row}")
        try:
            re.compile(row.pattern)
        except re.error as error:
            raise ValueError(f"rule {row.rule_id}: {error}") from error
        out.append(
            Rule(
                row.rule_id, row.kind or "custom", row.family, row.type or row.rule_id, row.pattern, row.literal or None,
                row.severity, row.level, row.message or "", bool(row.ignore_case),
            )
        )
    if len({rule.rule_id for rule in out}) < len(out):
        raise ValueError("a rule_id occurs twice")
    return out


def table_of(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Rules with one literal, or none, as rows."""
    rows = [
        (r.rule_id, r.kind, r.family, r.type, r.pattern, r.literal, r.severity, r.level, r.message, r.ignore_case)
        for r in rules
        if r.literal is None or isinstance(r.literal, str)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def register(spark: SparkSession, name: str, rules: Sequence[Rule]) -> None:
    """Make ``name(text, family)`` a table function of the session: rule_id, type, severity, level and n of the rules that match."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a function name: {name}")
    columns = "rule_id STRING, type STRING, severity STRING, level STRING, n INT"
    body = counts_sql(f"{name}.text", f"{name}.family", rules)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING, family STRING) RETURNS TABLE({columns}) "
        f"RETURN SELECT found.* FROM (SELECT explode({body}) AS found)"
    )


def hits(files: DataFrame, name: str, *columns: str) -> DataFrame:
    """The rows of a registered function for every row of ``files``, with some of its columns in front."""
    view = f"_{name}_files"
    files.createOrReplaceTempView(view)
    kept = "".join(f"f.`{column}`, " for column in columns)
    return files.sparkSession.sql(f"SELECT {kept}h.* FROM {view} f, LATERAL {name}(f.text, f.family) h").select("*")


def matched(files: DataFrame, name: str) -> DataFrame:
    """Matches and files per project and rule of a registered function."""
    return hits(files, name, "project", "path").groupBy("project", "rule_id").agg(
        F.sum("n").cast("long").alias("matches"), F.count("*").alias("files")
    )
