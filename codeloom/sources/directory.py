"""A data source over directory trees.

Spark's own file listing drops names that start with `_` or `.`, such as `__init__.py`, so the tree is walked here. The
driver lists only the top levels; their wide folders are dealt in ranges of names, and each subtree below is dealt to `slices`
tasks, which all list it and each open their share of its files. A file is opened only if its path passes the options
(directories to prune, file names to skip, suffixes to keep) and the filters that Spark pushes down.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from codeloom.functions.regex import glob_regex
from codeloom.schema import RAW_FILES

BATCH_BYTES = 8 * 1024 * 1024
NAMES_PER_PARTITION = 500
LISTED = frozenset(("project", "path"))  # what is known before a file is opened


@dataclass
class Subtree(ds.InputPartition):
    """A folder: all below it, in the share `part` of `parts`; or its own files with names in [first, last]."""

    path: str
    recursive: bool
    part: int = 0
    parts: int = 1
    first: str = ""
    last: str | None = None


def _test(condition: ds.Filter) -> Callable[[dict], bool] | None:
    """A pushed filter as a test of a file's project and path; None if it needs more than these."""
    if isinstance(condition, ds.Not):
        inner = _test(condition.child)
        # neither project nor path is ever null
        return None if inner is None else lambda row: not inner(row)
    column = getattr(condition, "attribute", ())
    if len(column) != 1 or column[0] not in LISTED:
        return None
    name, value = column[0], getattr(condition, "value", None)
    if isinstance(condition, ds.IsNotNull):
        return lambda row: True
    if isinstance(condition, ds.In):
        values = frozenset(v for v in value if v is not None)
        return None if None in value else lambda row: row[name] in values
    if not isinstance(value, str):
        return None
    tests: dict[type, Callable[[dict], bool]] = {
        ds.EqualTo: lambda row: row[name] == value,
        ds.EqualNullSafe: lambda row: row[name] == value,
        ds.StringStartsWith: lambda row: row[name].startswith(value),
        ds.StringEndsWith: lambda row: row[name].endswith(value),
        ds.StringContains: lambda row: value in row[name],
    }
    return tests.get(type(condition))


class DirectorySource(ds.DataSource):
    """Options: path; splitDepth, slices and namesPerPartition (how the work is dealt); prune (directory names) and skip (file
    globs), each joined by "/"; suffixes, joined by ","; projects, "true" to take the first part of a path as the project."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> StructType:
        return RAW_FILES

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        return TreeReader(self.options)


class TreeReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        listed = lambda name, sign: [x for x in options.get(name, "").split(sign) if x]
        self.root = os.path.abspath(options["path"])
        self.split_depth = int(options.get("splitDepth", "2"))
        self.slices = int(options.get("slices", "1"))
        self.width = int(options.get("namesPerPartition", str(NAMES_PER_PARTITION)))
        self.prune = frozenset(listed("prune", "/"))
        self.suffixes = frozenset(s.lower() for s in listed("suffixes", ","))
        self.skip = "|".join(f"(?:{glob_regex(glob)})" for glob in listed("skip", "/"))
        self.projects = options.get("projects", "false").lower() == "true"
        self.conditions: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for condition in filters:
            if _test(condition) is None:
                yield condition
            else:
                self.conditions.append(condition)

    def partitions(self) -> list[ds.InputPartition]:
        out: list[ds.InputPartition] = []
        level = [self.root]
        for _ in range(self.split_depth):
            below = []
            for path in level:
                names, folders = self._listed(path)
                chunks = [names[i : i + self.width] for i in range(0, len(names), self.width)]
                out += [Subtree(path, False, first=c[0], last=c[-1]) for c in chunks]
                below += [os.path.join(path, folder) for folder in folders]
            level = below
        return out + [Subtree(path, True, part, self.slices) for path in level for part in range(self.slices)]

    def _listed(self, path: str) -> tuple[list[str], list[str]]:
        """The sorted names of the files and of the folders that are entered."""
        with os.scandir(path) as entries:
            known = [(e.name, e.is_dir(follow_symlinks=False)) for e in entries]
        folders = sorted(name for name, folder in known if folder and name not in self.prune)
        return sorted(name for name, folder in known if not folder and self._named(name)), folders

    def _named(self, name: str) -> bool:
        """Whether a file of this name is looked at; a suffix is that of ``operators.discovery.suffix``."""
        if self.skip and re.fullmatch(self.skip, name, re.DOTALL):
            return False
        dot = name.rfind(".")
        return not self.suffixes or (dot > 0 and name[dot:].lower() in self.suffixes)

    def _files(self, partition: Subtree) -> Iterator[str]:
        for folder, folders, names in os.walk(partition.path):
            folders[:] = sorted(f for f in folders if f not in self.prune) if partition.recursive else []
            for name in sorted(filter(self._named, names)):
                path = os.path.join(folder, name)
                mine = zlib.crc32(path.encode("utf-8", "surrogateescape")) % partition.parts == partition.part
                if mine and partition.first <= name and (partition.last is None or name <= partition.last):
                    yield path

    def _identity(self, path: str) -> dict:
        relative = os.path.relpath(path, self.root)
        first, separator, rest = relative.partition(os.sep)
        if self.projects and separator:
            return {"project": first, "path": rest}
        return {"project": os.path.basename(self.root), "path": relative}

    def read(self, partition: Subtree):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(RAW_FILES)
        tests = [_test(condition) for condition in self.conditions]
        rows: list[dict] = []
        held = 0
        for path in self._files(partition):
            row = self._identity(path)
            if not all(test(row) for test in tests):
                continue
            rows.append(row | self._content(path))
            held += len(rows[-1]["content"] or b"")
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def _content(self, path: str) -> dict:
        from datetime import datetime, timezone

        try:
            stat = os.stat(path)
            size, modified = stat.st_size, datetime.fromtimestamp(stat.st_mtime, timezone.utc)
        except OSError:
            size, modified = None, None
        try:
            with open(path, "rb") as handle:
                content = handle.read()
        except OSError:
            content = None
        return {"size_bytes": size, "modified_at": modified, "content": content}
