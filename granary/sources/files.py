"""Source trees as DataFrames of files.

A walk over the directories settles which of them are kept, as ignore files are
layered by directory; Spark then lists and reads the kept ones only, each file
once, and patterns on files are a filter on that read.  Trees of more directories
than DRIVER_DIRECTORIES are walked and read by executors (tree.py), with the same
result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import glob_regex, utf8
from ..functions.lexer import line_counts
from ..operators.graphs import stored
from ..operators.rules import last_match
from . import tree

# The extension (or whole name) of a file, and its language and kind.
LANGUAGES = {
    ".py": ("Python", "programming"), ".js": ("JavaScript", "programming"), ".ts": ("TypeScript", "programming"), ".tsx": ("TSX", "programming"), ".jsx": ("JavaScript", "programming"),
    ".go": ("Go", "programming"), ".rs": ("Rust", "programming"), ".java": ("Java", "programming"), ".kt": ("Kotlin", "programming"), ".scala": ("Scala", "programming"), ".c": ("C", "programming"), ".h": ("C", "programming"),
    ".cpp": ("C++", "programming"), ".cc": ("C++", "programming"), ".hpp": ("C++", "programming"), ".cs": ("C#", "programming"), ".rb": ("Ruby", "programming"), ".php": ("PHP", "programming"), ".swift": ("Swift", "programming"),
    ".dart": ("Dart", "programming"), ".ex": ("Elixir", "programming"), ".exs": ("Elixir", "programming"), ".pl": ("Perl", "programming"), ".r": ("R", "programming"), ".pas": ("Delphi", "programming"), ".sh": ("Shell", "programming"),
    ".sql": ("SQL", "data"), ".json": ("JSON", "data"), ".yaml": ("YAML", "data"), ".yml": ("YAML", "data"), ".toml": ("TOML", "data"), ".xml": ("XML", "data"), ".csv": ("CSV", "data"), ".tf": ("HCL", "programming"),
    ".html": ("HTML", "markup"), ".css": ("CSS", "markup"), ".scss": ("SCSS", "markup"), ".vue": ("Vue", "markup"), ".md": ("Markdown", "prose"), ".rst": ("reStructuredText", "prose"), ".txt": ("Text", "prose"),
    "Dockerfile": ("Dockerfile", "programming"), "Makefile": ("Makefile", "programming"), "Gemfile": ("Ruby", "programming"),
}
#: Files that may hold licenses are read up to this size.
MOST_LICENSE_BYTES = 512 * 1024
#: Bytes of hidden files' contents that the driver holds at a time: each part is written as a table before the next is read.
PART_BYTES = 32 << 20
#: Directories up to which the driver walks a tree: for few, a round of tasks per level takes longer.
DRIVER_DIRECTORIES = 2000


def _of_file(part: int) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in LANGUAGES.items() for x in (k, v[part])])
    return F.coalesce(table[F.col("name")], table[F.col("ext")])


@dataclass
class Walk:
    """What is kept of a tree: directories and files that Spark lists, names that it leaves out, and the ignore patterns.

    A pattern is (glob, negated, directories only, base): the base directory's paths see it, from the root without slash.
    """

    roots: list[str] = field(default_factory=list)
    hidden: list[tuple[str, int]] = field(default_factory=list)
    patterns: list[tuple[str, bool, bool, str]] = field(default_factory=list)


def _store(spark: SparkSession, root: str) -> tuple[Callable, Callable]:
    """Functions that list a directory, as (name, is a directory, length, uri), and that read a file ('' without one)."""
    if re.match(r"(file:)?/", root) and os.path.isdir(root.removeprefix("file:").replace("//", "/")):  # a disk that the driver sees

        def entries(uri: str) -> list[tuple[str, bool, int, str]]:
            with os.scandir(uri.removeprefix("file:")) as found:
                return [(e.name, e.is_dir(), e.stat().st_size if e.is_file() else 0, f"{uri.rstrip('/')}/{e.name}") for e in found]

        def content(uri: str) -> str:
            path = uri.removeprefix("file:")
            if not os.path.isfile(path):
                return ""
            with open(path, encoding="utf-8", errors="replace") as f:
                return f.read()

        return entries, content
    jvm = spark.sparkContext._jvm
    store = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def listed(uri: str) -> list[tuple[str, bool, int, str]]:
        return [(s.getPath().getName(), s.isDirectory(), s.getLen(), s.getPath().toString()) for s in store.listStatus(jvm.org.apache.hadoop.fs.Path(uri))]

    def opened(uri: str) -> str:
        path = jvm.org.apache.hadoop.fs.Path(uri)
        return bytes(_read_hidden(spark, [uri])[0][1]).decode("utf-8", "replace") if store.exists(path) and store.getFileStatus(path).isFile() else ""

    return listed, opened


def _left_out(name: str) -> bool:
    """Whether Spark's own listings leave a name out."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _excluded(patterns: Sequence[tuple[str, bool, bool, str]], path: str, name: str) -> bool:
    """Whether a directory is ignored: the last pattern that matches its path or name decides."""
    for glob, negated, _, _ in reversed(patterns):
        if re.match(glob_regex(glob), path) or re.match(glob_regex(glob), name):
            return not negated
    return False


def walk(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] | None = None, most: int | None = None) -> Walk | None:
    """Walk the directories of a tree, None if they are more than `most`; without `exclude` only .git is left out, else what ignore files and `exclude` name.

    `.git` and `exclude` come first, then .git/info/exclude, then each directory's .gitignore for what lies below it.  An
    ignored directory is not entered.  Directories whose whole subtree is kept are listed by Spark from their top.
    """
    top = root.rstrip("/") or "/"
    if top.startswith("/"):
        top = "file:" + os.path.abspath(top)
    entries, content = _store(spark, top)
    wanted = [p.strip("/") for p in include if p.strip("/")]
    inside = lambda path: not wanted or any(path == p or path.startswith(p + "/") for p in wanted)
    on_the_way = lambda path: any(p.startswith(path + "/") for p in wanted)
    out = Walk()
    first = ignore_patterns([], exclude or ())
    if exclude is not None:
        pointer = content(f"{top}/.git").strip()
        at = pointer.removeprefix("gitdir:").strip() if pointer.startswith("gitdir:") else f"{top}/.git"
        first += ignore_patterns([("", content(f"{at if at.startswith('/') or ':' in at else top + '/' + at}/info/exclude"))])[1:]
    out.patterns += first
    level = [("", top, first, -1)]
    folders: list[tuple[str, int, bool]] = []  # uri, parent, left out by name
    whole: list[bool] = []
    visible: list[list[str]] = []
    while level:
        below = []
        for path, uri, patterns, parent in level:
            me = len(folders)
            name = path.rpartition("/")[2]
            folders.append((uri, parent, _left_out(name)))
            if most is not None and len(folders) > most:
                return None
            whole.append(inside(path))
            visible.append([])
            found = entries(uri)
            if exclude is not None and any(n == ".gitignore" for n, is_dir, _, _ in found if not is_dir):
                own = [(*p[:3], path) for p in ignore_patterns([("", content(f"{uri}/.gitignore"))])[1:]]
                out.patterns += own
                patterns = patterns + own
            for n, is_dir, size, at in found:
                p = f"{path}/{n}" if path else n
                if is_dir and (inside(p) or on_the_way(p)) and not (n == ".git" if exclude is None else _excluded(patterns, p, n)):
                    below.append((p, at, patterns, me))
                elif is_dir:
                    whole[me] = False
                elif inside(p) and _left_out(n):
                    out.hidden.append((at, size))
                elif inside(p):
                    visible[me].append(at)
        level = below
    for k in range(len(folders) - 1, 0, -1):  # children come after their parents
        if not whole[k]:
            whole[folders[k][1]] = False
    for k, (uri, parent, left_out) in enumerate(folders):
        if not whole[k]:
            out.roots += visible[k]
        elif parent < 0 or left_out or not whole[parent]:
            out.roots.append(uri)
    return out


def _read_hidden(spark: SparkSession, uris: Sequence[str]) -> list[tuple[str, bytearray]]:
    jvm = spark.sparkContext._jvm
    out = []
    for uri in uris:
        path = jvm.org.apache.hadoop.fs.Path(uri)
        stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
        try:
            out.append((uri, bytearray(stream.readAllBytes())))
        finally:
            stream.close()
    return out


def _parts(found: Sequence[tuple[str, int]], most: int = PART_BYTES) -> list[list[str]]:
    """The files in parts of up to `most` bytes; a larger file is a part of its own."""
    out, size = [], 0
    for uri, n in found:
        if not out or size + n > most:
            out.append([])
            size = 0
        out[-1].append(uri)
        size += n
    return out


def _binary(spark: SparkSession, kept: Walk, *columns: str) -> DataFrame:
    """(path, length and maybe content) of the files that a walk keeps, hidden ones too."""
    out = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(kept.roots).select(*columns) if kept.roots else None
    if "content" in columns:
        size = dict(kept.hidden)
        parts = _parts(kept.hidden)
        more = [spark.createDataFrame([(uri, size[uri], raw) for uri, raw in _read_hidden(spark, uris)], "path string, length long, content binary") for uris in parts[:1]]
        more += [stored(spark.createDataFrame([(uri, size[uri], raw) for uri, raw in _read_hidden(spark, uris)], "path string, length long, content binary")) for uris in parts[1:]]
    else:
        more = [spark.createDataFrame(kept.hidden, "path string, length long")] if kept.hidden else []
    for rows in more:
        out = rows.select(*columns) if out is None else out.unionByName(rows.select(*columns))
    return out if out is not None else spark.createDataFrame([], "path string, length long, content binary").select(*columns)


def walk_key(directory: Column, name: Column) -> Column:
    """A text that sorts as a walk goes: a directory's files by name, then its directories, each with all below it."""
    return F.concat(F.translate(F.when(directory == "/", F.lit("")).otherwise(directory), "/", "\x02"), F.lit("\x01"), name)


def _listed(raw: DataFrame, root: str) -> DataFrame:
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    path = F.concat(F.lit("/"), F.regexp_replace(F.substring_index(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?", ""), base, -1), "^/+", ""))
    files = raw.select(F.col("path").alias("uri"), F.regexp_replace(path, "%20", " ").alias("path"), *[c for c in raw.columns if c != "path"])
    name = F.regexp_replace("path", "^.*/", "")
    up = F.regexp_replace("path", "/[^/]*$", "")
    return files.select("uri", "path", F.when(up == "", F.lit("/")).otherwise(up).alias("dir"), name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("ext"), *[c for c in raw.columns if c != "path"])


def listing(spark: SparkSession, root: str, paths: Sequence[str] = ()) -> DataFrame:
    """(uri, path, dir, name, ext, length) of the files under root, or under some paths of it; no content is read."""
    return _listed(_binary(spark, walk(spark, root, paths), "path", "length"), root)


def ignore_patterns(texts: Sequence[tuple[str, str]], extra: Sequence[str] = ()) -> list[tuple[str, bool, bool, str]]:
    """Ordered patterns (glob, negated, directories only, base): `.git`, the extra ones, then the ignore files from the root down.

    texts: (directory, content) of each ignore file.
    """
    lines = [(x, "") for x in (".git", *extra)]
    for base, text in sorted(texts, key=lambda x: (x[0].count("/"), x[0])):
        lines += [(x, base.strip("/")) for x in text.split("\n")]
    out = []
    for line, base in lines:
        line = line.strip()
        if line and not line.startswith("#"):
            negated = line.startswith("!")
            glob = line.removeprefix("!")
            out.append((glob.rstrip("/"), negated, glob.endswith("/"), base))
    return out


def reclassified(files: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """files (path, language, language_type) after rules (match, language, type): the first whose glob matches the path from the root.

    A rule without a language leaves it empty, so the file counts by its type only.
    """
    kinds = dict(LANGUAGES.values())
    language, kind = F.col("language"), F.col("language_type")
    for r in reversed(list(rules)):
        hit = F.regexp_replace("path", "^/", "").rlike(glob_regex(r["match"]))
        own = r.get("language") or None
        language = F.when(hit, F.lit(own)).otherwise(language)
        kind = F.when(hit, F.lit(r.get("type") or kinds.get(own, "unknown"))).otherwise(kind)
    return files.withColumns({"language": language, "language_type": kind}) if rules else files


def _kept(files: DataFrame, patterns: Sequence[tuple[str, bool, bool, str]], rules: Sequence[dict] = ()) -> DataFrame:
    """files that the patterns keep (their directories are settled), with language, kind and place in the walk."""
    kept = last_match(files.withColumn("is_dir", F.lit(False)), patterns, above=False).where("NOT ignored").drop("ignored", "is_dir")
    kept = kept.withColumns({"language": _of_file(0), "language_type": F.coalesce(_of_file(1), F.lit("unknown")), "walk_order": walk_key(F.col("dir"), F.col("name"))})
    return reclassified(kept, rules)


def scan(spark: SparkSession, root: str, exclude: Sequence[str] = (), include: Sequence[str] = ()) -> DataFrame:
    """The files of a tree that its ignore files keep: listing columns, language and kind; no content is read."""
    kept = _few(spark, root, include, exclude)
    if kept is None:
        return _kept(_by_executors(tree.walked(spark, tree.absolute(root), include, exclude), root), [])
    return _kept(_listed(_binary(spark, kept, "path", "length"), root), kept.patterns)


def read(spark: SparkSession, root: str, exclude: Sequence[str] = (), include: Sequence[str] = (), reclassify: Sequence[dict] = ()) -> DataFrame:
    """The same with text, byte-order marks settled: one read of each kept file, without a join."""
    kept = _few(spark, root, include, exclude)
    if kept is None:
        top = tree.absolute(root)
        files = _kept(_by_executors(tree.contents(spark, top, tree.walked(spark, top, include, exclude)), root), [], reclassify)
    else:
        files = _kept(_listed(_binary(spark, kept, "path", "length", "content"), root), kept.patterns, reclassify)
    return files.withColumn("text", utf8(F.col("content"))).drop("content")


def _few(spark: SparkSession, root: str, include: Sequence[str], exclude: Sequence[str]) -> Walk | None:
    """The driver's walk, or None where executors are to walk: trees of many directories that they open themselves."""
    kept = walk(spark, root, include, exclude, DRIVER_DIRECTORIES)
    return kept if kept or tree.opens(spark, tree.absolute(root)) else walk(spark, root, include, exclude)


def _by_executors(files: DataFrame, root: str) -> DataFrame:
    """Files (path from the root, length and maybe content) with the columns of a listing."""
    path = F.concat(F.lit("/"), "path")
    up, name = F.regexp_replace(path, "/[^/]*$", ""), F.regexp_replace("path", "^.*/", "")
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    more = [c for c in files.columns if c != "path"]
    return files.select(F.concat(F.lit(tree.absolute(root).rstrip("/")), path).alias("uri"), path.alias("path"), F.when(up == "", F.lit("/")).otherwise(up).alias("dir"), name.alias("name"), ext.alias("ext"), *more)


def with_text(spark: SparkSession, root: str, files: DataFrame, include: Sequence[str] = ()) -> DataFrame:
    """files, however they were chosen, with their text, byte-order marks settled; only their contents are joined, by path."""
    raw = _binary(spark, walk(spark, root, include), "path", "content").withColumnRenamed("path", "r_uri")
    return files.join(raw, F.col("uri") == F.col("r_uri")).withColumn("text", utf8(F.col("content"))).drop("r_uri", "content")


def code_lines(files: DataFrame) -> DataFrame:
    """files (language, text) with lines, blanks, comments, code and complexity."""
    return line_counts(files)
