"""Source files of a mounted folder as a data source: `spark.read.format("sources").load(root)`, and a stream of the files that change."""

from __future__ import annotations

import os
import posixpath
import re
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from graphloom.sources import ignore_files
from graphloom.sources.files import EXTENSIONS, MOST_BYTES, MOST_DEPTH, check_root

SCHEMA = "path string, length long, content string"
#: Bytes of a task, what opening a file counts as, and bytes of a batch within a task.
TASK_BYTES, OPEN_BYTES, BATCH_BYTES = 64 << 20, 64 << 10, 8 << 20

_TESTS = {
    EqualTo: lambda x, v: x == v,
    In: lambda x, v: x in v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v),
    StringEndsWith: lambda x, v: x.endswith(v),
    StringContains: lambda x, v: v in x,
    IsNotNull: lambda x, v: True,
}


@dataclass
class Tree:
    """A folder and what is wanted of it: the walk opens no file and enters no folder that can hold nothing wanted."""

    root: str
    git: bool = True
    extensions: tuple[str, ...] = EXTENSIONS
    tests: list[tuple[str, type, object]] = field(default_factory=list)  # (column, filter, value)

    def push(self, filters: Iterable[Filter]) -> Iterator[Filter]:
        """Takes the filters that paths and lengths alone can answer, and gives back the others."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else None
            if type(f) in _TESTS and (column in ("path", "length") or isinstance(f, IsNotNull) and column == "content"):
                if not isinstance(f, IsNotNull):  # no column is ever null
                    self.tests.append((column, type(f), getattr(f, "value", None)))
            else:
                yield f

    def _enters(self, folder: str) -> bool:
        """Whether a folder can hold a path that passes: of two prefixes one has to begin the other."""
        at = folder + "/"
        for column, kind, value in self.tests:
            if column == "path" and kind in (StringStartsWith, EqualTo, In):
                if not any(x.startswith(at) or kind is StringStartsWith and at.startswith(x) for x in (value if kind is In else (value,)) if x is not None):
                    return False
        return True

    def _wanted(self, path: str, length: int) -> bool:
        row = {"path": path, "length": length}
        return all(_TESTS[kind](row[column], value) for column, kind, value in self.tests)

    def files(self) -> Iterator[tuple[str, int, int]]:
        """(path, length, time of change in nanoseconds), folder by folder in order: by the rules of files.discover."""
        rules = [(folder, *found) for folder, _, line in (ignore_files.lines_above(self.root) if self.git else []) if (found := ignore_files.git_regex(line))]
        yield from self._below("", 1, [(f, re.compile(r), n, d) for f, r, n, d in rules])

    def _below(self, folder: str, depth: int, rules: list) -> Iterator[tuple[str, int, int]]:
        here = os.path.join(self.root, folder)
        own = os.path.join(here, ignore_files.NAME)
        if self.git and os.path.isfile(own):
            lines = filter(None, map(ignore_files.git_regex, Path(own).read_text(errors="replace").splitlines()))
            rules = rules + [(folder, re.compile(r), n, d) for r, n, d in lines]
        with os.scandir(here) as found:
            entries = sorted(found, key=lambda e: e.name)
        for e in entries:
            path = posixpath.join(folder, e.name)
            is_folder = e.is_dir(follow_symlinks=False)
            if e.name.startswith(".") or e.is_symlink() or _ignored(path, is_folder, rules):
                continue
            if is_folder:
                if depth < MOST_DEPTH and self._enters(path):
                    yield from self._below(path, depth + 1, rules)
            elif e.is_file(follow_symlinks=False) and e.name.rpartition(".")[2] in self.extensions and "." in e.name:
                stat = e.stat(follow_symlinks=False)
                if stat.st_size <= MOST_BYTES and self._wanted(path, stat.st_size):
                    yield path, stat.st_size, stat.st_ctime_ns


def _ignored(path: str, is_folder: bool, rules: list) -> bool:
    """Whether the last line that matches ignores the path; lines of deeper files come later."""
    for folder, regex, negated, folders in reversed(rules):
        if (is_folder or not folders) and regex.match(path[len(folder) + 1 :] if folder else path):
            return not negated
    return False


class Paths(InputPartition):
    """Some paths of one task."""

    def __init__(self, paths: list[str]):
        super().__init__(paths)


def _packed(files: Iterable[tuple[str, int, int]], most: int) -> list[Paths]:
    """Neighbouring files in tasks of about `most` bytes."""
    out, bytes_ = [[]], 0
    for path, length, _ in files:
        cost = length + OPEN_BYTES
        if out[-1] and bytes_ + cost > most:
            out.append([])
            bytes_ = 0
        out[-1].append(path)
        bytes_ += cost
    return [Paths(x) for x in out if x]


def _batches(root: str, paths: list[str], lost: bool):
    """Arrow batches of the files; with `lost`, a file that is gone is left out, else it is an error."""
    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.string())])
    rows: list[tuple[str, int, str]] = []
    bytes_ = 0
    for path in paths:
        try:
            data = Path(root, path).read_bytes()
        except FileNotFoundError:
            if not lost:
                raise
            continue
        rows.append((path, len(data), data.decode("utf-8", "replace")))
        bytes_ += len(data)
        if bytes_ > BATCH_BYTES:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            rows, bytes_ = [], 0
    if rows:
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class TreeReader(DataSourceReader):
    def __init__(self, tree: Tree, most: int):
        self.tree, self.most = tree, most

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return list(self.tree.push(filters))

    def partitions(self) -> list[InputPartition]:
        return _packed(self.tree.files(), self.most) or [Paths([])]

    def read(self, partition):
        return _batches(self.tree.root, partition.value, lost=False)


class ChangedReader(DataSourceStreamReader):
    """Offsets are times of change: a batch holds the files last changed after its start and not after its end."""

    def __init__(self, tree: Tree, most: int, settle: float):
        self.tree, self.most, self.settle = tree, most, settle

    def initialOffset(self) -> dict:
        return {"ns": -1}

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(self.settle * 1e9)
        return {"ns": max((at for *_, at in self.tree.files() if at <= until), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _packed((x for x in self.tree.files() if start["ns"] < x[2] <= end["ns"]), self.most) or [Paths([])]

    def read(self, partition):
        return _batches(self.tree.root, partition.value, lost=True)


class TreeSource(DataSource):  # A1, A5, L1
    """Rows (path, length, content) as files.discover gives them, of a folder that the driver and all executors have mounted.

    Paths are listed when the query is planned; tasks get neighbouring files of about `bytes` (option, 64 MiB). Filters on path and
    length (equality, order, prefix, suffix, part) are answered by the listing, where spark.sql.python.filterPushdown.enabled is set:
    files that fail are never opened, and folders that cannot match are not entered. Other options: `git` (true: ignore files hold) and
    `extensions` (comma-separated). Bytes that are no UTF-8 are replaced. An empty folder gives no rows.

    A stream gives each file when it is first seen and again, whole, when it was changed (time of change of its inode, so moved files
    and old copies count; files below a renamed folder do not), at the earliest `settle` seconds (option, 2) later, so that no file
    of the same moment is missed. Of several changes between two batches the last one counts. Deletions are not reported.
    """

    @classmethod
    def name(cls) -> str:
        return "sources"

    def schema(self) -> str:
        return SCHEMA

    def _tree(self) -> Tree:
        if "path" not in self.options:
            raise ValueError("sources: a folder is needed, as in load(folder)")
        root = check_root(re.sub("^file:/*", "/", self.options["path"]))
        if not os.path.isdir(root):
            raise ValueError(f"sources: no such folder: {root}")
        extensions = tuple(x.strip() for x in self.options.get("extensions", ",".join(EXTENSIONS)).split(",") if x.strip())
        return Tree(root, self.options.get("git", "true").lower() == "true", extensions)

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreeReader(self._tree(), int(self.options.get("bytes", TASK_BYTES)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ChangedReader(self._tree(), int(self.options.get("bytes", TASK_BYTES)), float(self.options.get("settle", 2)))


def register_source(spark: SparkSession) -> None:
    """Make format("sources") known to the session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
