"""Large source trees, walked and read by executors.

A table holds the directories of one level with the ignore patterns that reach them; each round lists them in tasks, reads
their ignore files, and writes what they hold: kept files, and the directories of the next level with the patterns carried
down.  The driver holds no list of the tree, whatever its size, and no name is left out.  A round that loses an executor
lists its directories again.  Contents are read by tasks too, dealt out by size.

Trees are reached through Arrow's file systems, so the root must be one that they open on every executor (a shared disk,
or a store); others are walked by files.walk.
"""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import glob_regex
from ..operators.storage import stored

Pattern = tuple[str, bool, bool]  # glob, negated, directories only
_PATTERN = pa.struct([("glob", pa.string()), ("negated", pa.bool_()), ("only_dirs", pa.bool_())])
_ROW = "path string, length long, is_dir boolean, patterns array<struct<glob:string,negated:boolean,only_dirs:boolean>>"
_SCHEMA = pa.schema([("path", pa.string()), ("length", pa.int64()), ("is_dir", pa.bool_()), ("patterns", pa.list_(_PATTERN))])
#: Directories that one task of a round lists, and bytes of contents that one task reads and one batch holds.
DIRECTORIES, TASK_BYTES, BATCH_BYTES = 64, 128 << 20, 16 << 20


def _opened(root: str):
    """The file system of a root, and the root's path in it."""
    from pyarrow import fs

    if root.startswith("/") or root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root.removeprefix("file:").strip("/")
    return fs.FileSystem.from_uri(root)


def patterns_of(text: str) -> list[Pattern]:
    """The patterns of an ignore file, in order."""
    out = []
    for line in text.split("\n"):
        line = line.strip()
        if line and not line.startswith("#"):
            glob = line.removeprefix("!")
            out.append((glob.rstrip("/"), line.startswith("!"), glob.endswith("/")))
    return out


def ignored(patterns: Sequence[Pattern], path: str, is_dir: bool) -> bool:
    """Whether a path (from the root, without a slash before) is ignored: the last pattern that matches it or its name decides."""
    name = posixpath.basename(path)
    for glob, negated, only_dirs in reversed(patterns):
        if (is_dir or not only_dirs) and (re.match(_regex(glob), path) or re.match(_regex(glob), name)):
            return not negated
    return False


_regexes: dict[str, str] = {}


def _regex(glob: str) -> str:
    if glob not in _regexes:
        _regexes[glob] = glob_regex(glob)
    return _regexes[glob]


def _text(store, path: str) -> str:
    from pyarrow import fs

    if store.get_file_info(path).type != fs.FileType.File:
        return ""
    with store.open_input_stream(path) as f:
        return f.read().decode("utf-8", "replace")


def _level(root: str, wanted: Sequence[str], layers: bool) -> Callable:
    """The task of a round: rows of directories (path, patterns) to rows of what they hold and keep."""
    inside = lambda p: not wanted or any(p == w or p.startswith(w + "/") for w in wanted)
    on_the_way = lambda p: any(w.startswith(p + "/") for w in wanted)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = _opened(root)
        for batch in batches:
            for path, patterns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                known = [(p["glob"], p["negated"], p["only_dirs"]) for p in patterns]
                found = store.get_file_info(fs.FileSelector(posixpath.join(top, path) if path else top))
                if layers and any(f.base_name == ".gitignore" and f.type == fs.FileType.File for f in found):
                    known += patterns_of(_text(store, posixpath.join(top, path, ".gitignore")))
                carried = [dict(zip(("glob", "negated", "only_dirs"), p, strict=True)) for p in known]
                rows = []
                for f in found:
                    p = f"{path}/{f.base_name}" if path else f.base_name
                    is_dir = f.type == fs.FileType.Directory
                    if (inside(p) or (is_dir and on_the_way(p))) and not ignored(known, p, is_dir) and (is_dir or f.type == fs.FileType.File):
                        rows.append({"path": p, "length": 0 if is_dir else f.size, "is_dir": is_dir, "patterns": carried if is_dir else []})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return task


def walked(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] | None = None) -> DataFrame:
    """(path, length) of the kept files of a tree, paths from the root; without `exclude` ignore files do not count.

    `.git` and `exclude` come first, then .git/info/exclude, then each directory's .gitignore for what lies below it; an
    ignored directory is not entered.
    """
    store, top = _opened(root)
    first: list[Pattern] = [(".git", False, False)]
    if exclude is not None:
        first += patterns_of("\n".join(exclude))
        pointer = _text(store, posixpath.join(top, ".git")).strip()
        at = pointer.removeprefix("gitdir:").strip() if pointer.startswith("gitdir:") else posixpath.join(top, ".git")
        first += patterns_of(_text(store, posixpath.join(at if at.startswith("/") else posixpath.join(top, at), "info/exclude")))
    task = _level(root, [p.strip("/") for p in include if p.strip("/")], exclude is not None)
    level = spark.createDataFrame([("", [dict(zip(("glob", "negated", "only_dirs"), p, strict=True)) for p in first])], "path string, patterns array<struct<glob:string,negated:boolean,only_dirs:boolean>>")
    count, found = 1, []
    while count:
        parts = -(-count // DIRECTORIES)
        rows = stored(level.repartition(parts).mapInArrow(task, _ROW))
        found.append(rows.where("NOT is_dir").select("path", "length"))
        level = rows.where("is_dir").select("path", "patterns")
        count = level.count()
        if len(found) == 8:  # few tables to read, however deep the tree is
            found = [stored(_union(found))]
    return _union(found)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def contents(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """files (path, length) with content, read by as many tasks as their bytes ask for; a file that is gone by then is an error."""
    total = files.agg(F.sum("length")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _opened(root)
        schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_stream(posixpath.join(top, row["path"]), compression=None) as f:
                    held.append(row | {"content": f.read()})
                size += len(held[-1]["content"])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return files.select("path", "length").repartition(int(parts)).mapInArrow(task, "path string, length long, content binary")


def opens(spark: SparkSession, root: str) -> bool:
    """Whether executors open a root through Arrow: one of them tries."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            try:
                store, top = _opened(root)
                ok = store.get_file_info(top).type == fs.FileType.Directory
            except (pa.ArrowException, OSError, ValueError):
                ok = False
            yield pa.RecordBatch.from_arrays([pa.array([ok] * batch.num_rows)], ["ok"])

    return bool(spark.range(1).mapInArrow(task, "ok boolean").first()["ok"])


def absolute(root: str) -> str:
    """A local root as an absolute path; others as they are."""
    return os.path.abspath(root.removeprefix("file:")) if root.startswith(("/", "file:", ".")) or ":" not in root else root
