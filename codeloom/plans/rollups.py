"""Project rollups over the per-file table.

Each is one aggregation that combines on the map side, so a project with a third of all files costs
no more than the others. Fixed bins are counted as columns and unpivoted, which fills empty bins with
zero without joining a dimension.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.constants.levels import CHART_BANDS, COMPLEXITY_LEVELS, SIZE_BANDS
from codeloom.functions.text import title_case
from codeloom.operators.complexity import chart_band
from codeloom.operators.scores import grade

SEVERITY_BINS = ("Critical", "High", "Medium", "Low")
SMELL_BINS = ("Critical", "Major", "Minor")


def share_of(value: str, *over: str) -> Column:
    """Percentage of the sum over a partition; 0 for an empty partition."""
    total = F.sum(value).over(W.partitionBy(*over))
    return F.coalesce(F.try_divide(F.col(value) * 100.0, total), F.lit(0.0))


def filled_bins(frame: DataFrame, label: str, bins: Iterable[str], weight: Column | None = None) -> DataFrame:
    """(project, <label>, bin_no, n) with every bin of every project, empty ones as 0."""
    bins = list(bins)
    value = F.lit(1) if weight is None else weight
    totals = frame.groupBy("project").agg(
        *[
            F.coalesce(F.sum(F.when(F.col(label) == name, value)), F.lit(0)).cast("long").alias(f"bin_{i}")
            for i, name in enumerate(bins)
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(name).alias(label), F.lit(i).alias("bin_no"), F.col(f"bin_{i}").alias("n"))
            for i, name in enumerate(bins)
        ]
    )
    return totals.select("project", F.inline(rows))


def project_totals(metrics: DataFrame) -> DataFrame:
    """Files, lines, bytes and structure totals per project."""
    return metrics.groupBy("project").agg(
        F.count("*").alias("total_files"),
        F.sum("loc").alias("total_loc"),
        F.sum("sloc").alias("total_sloc"),
        F.sum("comments").alias("total_comments"),
        F.sum("blanks").alias("total_blanks"),
        F.sum("size_bytes").alias("project_size"),
        F.sum("classes").alias("total_classes"),
        F.sum("functions").alias("total_functions"),
        F.sum("methods").alias("total_methods"),
    )


def files_by_language(files: DataFrame) -> DataFrame:
    return files.groupBy("project", "language").agg(F.count("*").alias("files"))


def language_share(files: DataFrame) -> DataFrame:
    """Files per language with their share of the project, as displayed."""
    return files_by_language(files).select(
        "project",
        "language",
        title_case(F.col("language")).alias("label"),
        "files",
        share_of("files", "project").alias("percentage"),
    )


def complexity_distribution(metrics: DataFrame) -> DataFrame:
    """Files per complexity level, all six levels, with percentages."""
    bins = filled_bins(metrics, "complexity_level", [name for name, _ in COMPLEXITY_LEVELS])
    return bins.select(
        "project",
        "complexity_level",
        title_case(F.col("complexity_level")).alias("label"),
        F.col("n").alias("files"),
        share_of("n", "project").alias("percentage"),
    )


def complexity_chart(metrics: DataFrame) -> DataFrame:
    banded = metrics.withColumn("band", chart_band(F.col("complexity_score")))
    return filled_bins(banded, "band", [name for name, _ in CHART_BANDS]).select(
        "project", "band", F.col("n").alias("files")
    )


def size_histogram(metrics: DataFrame) -> DataFrame:
    """Files per range of source lines; a negative count falls in none."""
    sloc = F.col("sloc")
    band = None
    for label, low, high in SIZE_BANDS:
        inside = (sloc >= low) if high is None else (sloc >= low) & (sloc < high)
        band = F.when(inside, label) if band is None else band.when(inside, label)
    return filled_bins(metrics.withColumn("size_range", band), "size_range", [b[0] for b in SIZE_BANDS]).select(
        "project", "size_range", F.col("n").alias("files")
    )


def _exploded(metrics: DataFrame, counts: str, *keys: str) -> DataFrame:
    """One row per rule that a file breaks. Outer and a filter behind it, as in ``dependency_counts``."""
    return metrics.select("project", *keys, F.inline_outer(counts)).where(F.col("n").isNotNull())


def security_by_level(metrics: DataFrame) -> DataFrame:
    level = F.coalesce(F.col("level"), F.lit("medium_risk"))
    return (
        _exploded(metrics, "security_counts")
        .groupBy("project", level.alias("level"))
        .agg(F.sum(F.col("n").cast("long")).alias("issues"))
    )


def _by_type(metrics: DataFrame, counts: str) -> DataFrame:
    """Issues and affected files per type. The file is a whole row of the per-file table, so rule
    counts of one type fold within the row and no distinct count is needed."""
    typed = F.transform(F.col(counts), lambda c: F.coalesce(c["type"], F.lit("unknown")))
    per_file = metrics.select(
        "project", F.col(counts).alias("counts"), F.explode(F.array_distinct(typed)).alias("type")
    )
    issues = F.aggregate(
        "counts",
        F.lit(0),
        lambda acc, c: acc
        + F.when(F.coalesce(c["type"], F.lit("unknown")) == F.col("type"), c["n"]).otherwise(0),
    )
    return (
        per_file.select("project", "type", issues.cast("long").alias("n"))
        .groupBy("project", "type")
        .agg(F.sum("n").alias("issues"), F.count("*").alias("files_affected"))
    )


def security_by_type(metrics: DataFrame) -> DataFrame:
    """Issues per vulnerability type with display label; files_affected counts distinct files."""
    return _by_type(metrics, "security_counts").select(
        "project", "type", title_case(F.col("type")).alias("label"), "issues", "files_affected"
    )


def smell_counts_by_type(metrics: DataFrame) -> DataFrame:
    return _by_type(metrics, "smell_counts")


def security_chart(metrics: DataFrame) -> DataFrame:
    """Issues in four severity bins; level or severity decides, the more severe first."""
    level = F.coalesce(F.col("level"), F.lit("medium_risk"))
    severity = F.lower(F.coalesce(F.col("severity"), F.lit("medium")))
    severity_bin = (
        F.when((level == "critical") | (severity == "critical"), "Critical")
        .when((level == "high_risk") | (severity == "high"), "High")
        .when((level == "medium_risk") | (severity == "medium"), "Medium")
        .otherwise("Low")
    )
    rows = metrics.select("project", F.inline_outer("security_counts"))
    binned = rows.withColumn("severity_bin", F.when(F.col("n").isNotNull(), severity_bin))
    return filled_bins(binned, "severity_bin", SEVERITY_BINS, F.col("n")).select(
        "project", "severity_bin", F.col("n").alias("issues")
    )


def smell_chart(metrics: DataFrame) -> DataFrame:
    severity = F.lower(F.coalesce(F.col("severity"), F.lit("minor")))
    severity_bin = (
        F.when(severity == "critical", "Critical").when(severity == "major", "Major").otherwise("Minor")
    )
    rows = metrics.select("project", F.inline_outer("smell_counts"))
    binned = rows.withColumn("severity_bin", F.when(F.col("n").isNotNull(), severity_bin))
    return filled_bins(binned, "severity_bin", SMELL_BINS, F.col("n")).select(
        "project", "severity_bin", F.col("n").alias("smells")
    )


def critical_vulnerabilities(issues: DataFrame) -> DataFrame:
    """The located critical issues."""
    return issues.where(F.col("level") == "critical").select(
        "project", "path", "type", "message", "line", "col", "position"
    )


def duplicate_blocks(metrics: DataFrame) -> DataFrame:
    """Files with duplicated lines. Exploding a filtered array keeps the count evaluated once, where a
    plain filter would be pushed below the projection that computes it."""
    kept = F.filter(F.array("duplicated_lines"), lambda n: n > 0)
    return metrics.select("project", "path", F.explode(kept).alias("duplicated_lines"))


def duplicated_ratio(metrics: DataFrame) -> DataFrame:
    totals = metrics.groupBy("project").agg(
        F.sum("duplicated_lines").alias("duplicated_lines"), F.sum("sloc").alias("sloc")
    )
    ratio = F.when(F.col("sloc") > 0, F.col("duplicated_lines") / F.col("sloc")).otherwise(F.lit(0.0))
    return totals.select("project", "duplicated_lines", "sloc", ratio.alias("duplicated_lines_ratio"))


def pattern_stats(metrics: DataFrame) -> DataFrame:
    """Hits and files per design pattern and project."""
    return _by_type(metrics, "pattern_counts").select(
        "project", F.col("type").alias("pattern"), F.col("issues").alias("hits"),
        F.col("files_affected").alias("files"),
    )


def pattern_files(metrics: DataFrame) -> DataFrame:
    """The distinct files of each pattern, as rows."""
    types = F.array_distinct(F.transform("pattern_counts", lambda c: c["type"]))
    return metrics.select("project", F.explode(types).alias("pattern"), "path")


def dependency_counts(metrics: DataFrame) -> DataFrame:
    """How often each import occurs in a project.

    An inner explode of a named column makes Spark infer a filter on its size, which sinks below the projection and
    evaluates the structure expression a second time; an outer one and a filter on what it gives do not.
    """
    return (
        metrics.select("project", F.explode_outer("imports").alias("module"))
        .where(F.col("module").isNotNull())
        .groupBy("project", "module")
        .agg(F.count("*").alias("uses"))
    )


def _score_columns() -> list[Column]:
    issues = F.col("n_security_total") + F.col("n_smells_total")
    density = F.try_divide(issues.cast("double"), F.col("total_sloc").cast("double"))
    quality = 100 * (1 - F.least(F.lit(1.0), density * 5))
    security = F.greatest(
        F.lit(0.0), 100 - F.col("n_security_total") / F.col("total_files").cast("double") * 20
    )
    scored = F.col("total_sloc") > 0
    index = F.when(scored, F.coalesce(F.col("avg_mi"), F.lit(0.0))).otherwise(F.lit(0.0))
    cyclomatic = F.when(scored, F.coalesce(F.col("avg_cc"), F.lit(0.0))).otherwise(F.lit(0.0))
    return [
        F.when(scored & (F.col("n_security_total") > 0), security).otherwise(F.lit(100.0)).alias("security_score"),
        F.when(scored, F.greatest(F.lit(0.0), quality)).otherwise(F.lit(100.0)).alias("code_quality_score"),
        F.greatest(F.lit(0), F.least(F.lit(100), F.floor(index).cast("int"))).cast("long").alias("maintainability_score"),
        index.alias("avg_maintainability_index"),
        cyclomatic.alias("avg_cyclomatic_complexity"),
    ]


_LEVELS = [name for name, _ in COMPLEXITY_LEVELS]
SUMMARY = (
    "total_files", "total_loc", "total_sloc", "total_comments", "total_blanks", "project_size", "total_classes",
    "total_functions", "total_methods", "n_security_total", "n_smells_total", *[f"files_{name}" for name in _LEVELS],
    "security_score", "code_quality_score", "maintainability_score", "avg_maintainability_index",
    "avg_cyclomatic_complexity", "duplicated_lines_ratio",
)


def summary_sums() -> dict[str, Column]:
    """What a summary is made of: sums and counts over files, so that those of parts of a project add up."""
    index, branches = F.col("maintainability_index"), F.col("cyclomatic")
    return {
        "total_files": F.count("*"),
        "total_loc": F.sum("loc"),
        "total_sloc": F.sum("sloc"),
        "total_comments": F.sum("comments"),
        "total_blanks": F.sum("blanks"),
        "project_size": F.sum("size_bytes"),
        "total_classes": F.sum("classes"),
        "total_functions": F.sum("functions"),
        "total_methods": F.sum("methods"),
        "n_security_total": F.sum("n_security"),
        "n_smells_total": F.sum("n_smells"),
        "duplicated_lines_total": F.sum("duplicated_lines"),
        "sum_mi": F.sum(F.when(index > 0, index)),
        "n_mi": F.count_if(index > 0),
        "sum_cc": F.sum(F.when(branches > 0, branches)),
        "n_cc": F.count_if(branches > 0),
        **{f"files_{name}": F.count_if(F.col("complexity_level") == name) for name in _LEVELS},
    }


def summary_of(totals: DataFrame, *others: str) -> DataFrame:
    """The summary of a table with ``summary_sums`` per project, and the other columns of the table asked for."""
    ratio = F.when(
        F.col("total_sloc") > 0, F.col("duplicated_lines_total") / F.col("total_sloc")
    ).otherwise(F.lit(0.0))
    averaged = totals.withColumns(
        {"avg_mi": F.try_divide("sum_mi", "n_mi"), "avg_cc": F.try_divide("sum_cc", "n_cc")}
    )
    scored = averaged.select("*", *_score_columns(), ratio.alias("duplicated_lines_ratio"))
    return scored.select("project", *SUMMARY, *others)


def project_summary(metrics: DataFrame, hooks: Mapping[str, Column] | None = None) -> DataFrame:
    """Totals, finding counts, level counts and scores per project in one aggregation, which also takes the ``hooks``:
    further aggregates by name.

    A project without source lines keeps the default scores.
    """
    sums = [column.alias(name) for name, column in summary_sums().items()]
    named = {f"hook.{name}": (aggregate, name) for name, aggregate in (hooks or {}).items()}
    totals = metrics.groupBy("project").agg(*sums, *[aggregate.alias(own) for own, (aggregate, _) in named.items()])
    out = summary_of(totals, *[f"`{own}`" for own in named])
    return out.select("project", *SUMMARY, *[F.col(f"`{own}`").alias(name) for own, (_, name) in named.items()])


def project_scores(metrics: DataFrame) -> DataFrame:
    summary = project_summary(metrics)
    return summary.select(
        "project", "security_score", "code_quality_score", "maintainability_score",
        "avg_maintainability_index", "avg_cyclomatic_complexity",
        grade(F.col("code_quality_score")).alias("quality_grade"),
        grade(F.col("maintainability_score")).alias("maintainability_grade"),
    )


def summary_panel(summary: DataFrame) -> DataFrame:
    """The ten numbers of the summary panel, formatted."""
    counts = (
        "total_files", "total_loc", "total_sloc", "total_comments", "total_blanks",
        "total_classes", "total_functions", "total_methods",
    )
    return summary.select(
        "project",
        *[F.format_number(name, 0).alias(name) for name in counts],
        F.format_number(F.col("code_quality_score"), 1).alias("code_quality"),
        F.format_number(F.col("maintainability_score").cast("double"), 1).alias("maintainability"),
    )
