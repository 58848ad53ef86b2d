"""Two projects side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label, column, whether it is shown with one decimal.
COMPARED = (
    ("Files", "total_files", False),
    ("Lines of Code", "total_loc", False),
    ("Source Lines", "total_sloc", False),
    ("Classes", "total_classes", False),
    ("Functions", "total_functions", False),
    ("Methods", "total_methods", False),
    ("Code Quality", "code_quality_score", True),
    ("Maintainability", "maintainability_score", True),
)


def _side_by_side(summary: DataFrame, left: str, right: str) -> DataFrame:
    """metric_no, metric, decimal, left_value and right_value from one pass over the two projects."""
    sides = {"left_value": left, "right_value": right}
    values = [
        F.max(F.when(F.col("project") == project, F.col(column).cast("double"))).alias(f"{side}_{i}")
        for i, (_, column, _) in enumerate(COMPARED)
        for side, project in sides.items()
    ]
    both = summary.where(F.col("project").isin(left, right)).agg(F.count("*").alias("found"), *values)
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("metric_no"), F.lit(label).alias("metric"), F.lit(decimal).alias("decimal"),
                *[F.col(f"{side}_{i}").alias(side) for side in sides],
            )
            for i, (label, _, decimal) in enumerate(COMPARED)
        ]
    )
    return both.where("found > 0").select(F.inline(rows))


def _shown(value: Column) -> Column:
    return F.when(F.col("decimal"), F.format_number(F.bround(value, 1), 1)).otherwise(
        F.format_number(value, 0)
    )


def _shown_difference(value: Column) -> Column:
    sign = F.when(value < 0, "").otherwise("+")
    whole = F.when(value == 0, "0").otherwise(F.concat(sign, F.format_number(value, 0)))
    return F.when(F.col("decimal"), F.concat(sign, F.format_number(F.bround(value, 1), 1))).otherwise(whole)


def compare(summary: DataFrame, left: str, right: str) -> DataFrame:
    """Eight metrics of two projects with their difference; a missing project leaves nulls."""
    both = _side_by_side(summary, left, right)
    difference = F.col("right_value") - F.col("left_value")
    return both.select(
        "metric_no", "metric", "left_value", "right_value", difference.alias("difference"),
        _shown(F.col("left_value")).alias("left_shown"),
        _shown(F.col("right_value")).alias("right_shown"),
        _shown_difference(difference).alias("difference_shown"),
    )
