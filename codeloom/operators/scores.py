"""Scores and levels of one file from its finding counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.constants.levels import SECURITY_LEVELS, SMELL_WEIGHTS
from codeloom.functions.text import count_where


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda acc, c: acc + c["n"])


def _weighted(counts: Column, key: str, weights: dict[str, int], default: int) -> Column:
    def weight(c: Column) -> Column:
        out = None
        for name, value in weights.items():
            out = F.when(c[key] == name, value) if out is None else out.when(c[key] == name, value)
        return out.otherwise(default)

    return F.aggregate(counts, F.lit(0), lambda acc, c: acc + c["n"] * weight(c))


def _has(counts: Column, severity: str) -> Column:
    return F.exists(counts, lambda c: F.coalesce(c["severity"] == severity, F.lit(False)))


def security_score(counts: Column) -> Column:
    weights = {level: weight for level, (_, weight) in SECURITY_LEVELS.items()}
    return F.greatest(F.lit(0), 100 - _weighted(counts, "level", weights, 0)).cast("double")


def security_level(counts: Column) -> Column:
    return (
        F.when(_has(counts, "critical"), "critical")
        .when(_has(counts, "high"), "high_risk")
        .when(F.size(counts) > 0, "medium_risk")
        .otherwise("secure")
    )


def technical_debt(counts: Column, sloc: Column) -> Column:
    debt = _weighted(counts, "severity", SMELL_WEIGHTS, 1)
    lines = F.when(sloc == 0, 1).otherwise(sloc)
    ratio = F.least(F.lit(1.0), debt.cast("double") / lines.cast("double") * F.lit(0.02))
    return F.when(count_where(counts, lambda c: c["n"] > 0) > 0, ratio).otherwise(F.lit(0.0))


def smell_severity(counts: Column) -> Column:
    return (
        F.when(_has(counts, "critical"), "critical")
        .when(_has(counts, "major"), "major")
        .when(F.size(counts) > 0, "minor")
        .otherwise("none")
    )


def grade(score: Column) -> Column:
    """Traffic-light band of a 0..100 score."""
    return F.when(score >= 80, "green").when(score >= 60, "yellow").otherwise("red")


def issue_band(issues: Column) -> Column:
    return F.when(issues == 0, "green").when(issues < 3, "yellow").otherwise("red")
