"""User extensions: metric providers, languages and rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from codeloom.constants.languages import Extension
from codeloom.operators.discovery import discover
from codeloom.plans.file_metrics import file_metrics
from codeloom.plans.rollups import SUMMARY, project_summary


@dataclass(frozen=True)
class Provider:
    """``columns`` are named expressions over a prepared file (text, language, loc, sloc ...) that
    become custom metrics; ``project`` are named aggregates over the per-file table."""

    name: str
    columns: dict[str, Column] = field(default_factory=dict)
    project: dict[str, Column] = field(default_factory=dict)


class Analyzer:
    """A configured analysis: exclusions, extra languages and registered providers."""

    def __init__(self, exclude_dirs: tuple[str, ...] = (), include_tests: bool = False):
        self.exclude_dirs = tuple(exclude_dirs)
        self.include_tests = include_tests
        self.providers: dict[str, Provider] = {}
        self.extensions: list[Extension] = []

    def register_provider(self, provider: Provider) -> None:
        """Add a provider; a name counts once."""
        self.providers.setdefault(provider.name, provider)

    def register_extension(self, extension: Extension) -> None:
        if extension not in self.extensions:
            self.extensions.append(extension)

    def discover(self, files: DataFrame) -> DataFrame:
        return discover(files, self.exclude_dirs, self.include_tests, extra=self.extensions)

    def file_metrics(self, files: DataFrame) -> DataFrame:
        """The per-file table of a raw files table."""
        provided = {
            f"{provider.name}.{name}": column
            for provider in self.providers.values()
            for name, column in provider.columns.items()
        }
        return file_metrics(self.discover(files), provided)

    def project_metrics(self, metrics: DataFrame) -> DataFrame:
        """``project_summary`` with the project hooks of all providers, from the one aggregation that it takes anyway.

        A hook is ``<provider>.<name>``, unless its name alone is free.
        """
        taken = {"project", *SUMMARY}
        hooks: dict[str, Column] = {}
        for provider in self.providers.values():
            for name, aggregate in provider.project.items():
                free = name not in taken and name not in hooks
                hooks[name if free else f"{provider.name}.{name}"] = aggregate
        return project_summary(metrics, hooks)
