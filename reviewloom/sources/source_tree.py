"""A Python DataSource over source trees.

Spark's own file sources skip names that begin with ``_`` or ``.``, which drops
``__init__.py``; this source does not. Files with a known suffix are listed on the
driver, names and sizes only, and dealt in runs of up to ``FILES`` files or ``BYTES`` to partitions, so a tree with
one large folder is read by many tasks. Directories of fixed names are pruned below the root; paths without a
known suffix are not opened; files that are not UTF-8 are given with a null
content and the reason, instead of ending the scan. The tree has to be a mount
that all executors see.

Filters on path and language are pushed to the source, which then lists no partition
with a file that they rule out, and opens none. The others are left to Spark.

    register(spark); spark.read.format("source_tree").load("/path/to/tree")
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not, StringContains, StringEndsWith, StringStartsWith

from reviewloom.functions.vocabulary import LANGUAGE_SUFFIXES

#: Directories that are never entered below the root.
PRUNED = frozenset((".git", "node_modules", "target", "dist", "coverage"))
SCHEMA = "path string, language string, content string, error string"


def language_by_suffix(path: str) -> str | None:
    return next((language for language, suffixes in LANGUAGE_SUFFIXES if path.endswith(suffixes)), None)


#: Files and bytes of a partition; one file may be larger.
FILES, BYTES = 64, 32 << 20
#: What a pushed filter says of a value that is not null.
_TESTS: dict[type, Callable[[str, object], bool]] = {
    EqualTo: lambda v, wanted: v == wanted,
    EqualNullSafe: lambda v, wanted: v == wanted,
    In: lambda v, wanted: v in wanted,
    StringStartsWith: lambda v, wanted: v.startswith(wanted),
    StringEndsWith: lambda v, wanted: v.endswith(wanted),
    StringContains: lambda v, wanted: wanted in v,
    IsNotNull: lambda v, _: True,
    IsNull: lambda v, _: False,
}


def _test(f: Filter) -> tuple[str, Callable[[str], bool]] | None:
    """(column, test) of a filter on path or language that this source can decide by a file's name; else None."""
    if isinstance(f, Not):
        inner = _test(f.child)
        # Neither column is ever null, so the opposite of a test is its negation, unless it compares with null.
        against = getattr(f.child, "value", "")
        if inner is None or against is None or (isinstance(f.child, In) and None in against):
            return None
        return inner[0], lambda v: not inner[1](v)
    attribute = getattr(f, "attribute", ())
    if attribute not in (("path",), ("language",)) or type(f) not in _TESTS:
        return None
    wanted = getattr(f, "value", None)
    if isinstance(f, (StringStartsWith, StringEndsWith, StringContains)) and wanted is None:
        return None
    return attribute[0], lambda v: _TESTS[type(f)](v, wanted)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class SourceTreeReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root.removeprefix("file://")
        self.tests: list[tuple[str, Callable[[str], bool]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if (test := _test(f)) is None:
                yield f
            else:
                self.tests.append(test)

    def _wanted(self, path: str) -> bool:
        values = {"path": path, "language": language_by_suffix(path)}
        return values["language"] is not None and all(test(values[column]) for column, test in self.tests)

    def _names(self) -> Iterator[str]:
        if os.path.isfile(self.root):
            yield self.root
            return
        for folder, folders, names in os.walk(self.root):
            folders[:] = sorted(f for f in folders if f not in PRUNED)
            yield from (os.path.join(folder, n) for n in sorted(names) if language_by_suffix(n))

    def partitions(self) -> list[InputPartition]:
        runs: list[list[str]] = [[]]
        size = 0
        for path in filter(self._wanted, self._names()):
            mine = os.path.getsize(path) if os.path.exists(path) else 0
            if runs[-1] and (len(runs[-1]) >= FILES or size + mine > BYTES):
                runs.append([])
                size = 0
            runs[-1].append(path)
            size += mine
        return [_Files(r) for r in runs]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            yield from self._file(path)

    def _file(self, path: str) -> Iterator[tuple]:
        if (language := language_by_suffix(path)) is None:
            return
        try:
            with open(path, encoding="utf-8", newline="") as f:
                yield path, language, f.read(), None
        except (UnicodeDecodeError, OSError) as e:
            yield path, language, None, type(e).__name__


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SourceTreeReader:
        return SourceTreeReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets Spark offer its filters to Python sources, which it doesn't by itself."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
