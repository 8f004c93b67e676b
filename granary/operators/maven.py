"""Maven models over many POMs: parent chains, imported version lists, and the children that mediation walks.

POMs are read once each (on the executors); parents and imports are joins by
coordinate, one round per level, so a chain of any project is resolved at once
with those of all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.versions import resolved
from ..sources import manifests
from .graphs import stored

MAX_PARENTS = 10
_ROW = "struct<name:string,version:string,scope:string,optional:boolean,ord:int,exclusions:array<string>>"
_POM = f"path string, name string, version string, parent string, parent_version string, properties map<string,string>, dependencies array<{_ROW}>, managed array<{_ROW}>"


def read_poms(files: DataFrame) -> DataFrame:
    """One row per POM among files (path, text); what does not parse is left out."""

    def rows(found: list[dict]) -> list[dict]:
        return [{"name": f"{d['groupId']}:{d['artifactId']}", "version": d["version"], "scope": d["scope"], "optional": d["optional"] == "true", "ord": k, "exclusions": d["exclusions"]} for k, d in enumerate(found)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = pa.list_(pa.struct([("name", pa.string()), ("version", pa.string()), ("scope", pa.string()), ("optional", pa.bool_()), ("ord", pa.int32()), ("exclusions", pa.list_(pa.string()))]))
        for batch in batches:
            out = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    p = manifests.pom(text or "")
                except (ValueError, SyntaxError):
                    continue
                up = p["parent"]
                out.append((path, f"{p['groupId']}:{p['artifactId']}", p["version"], f"{up['groupId']}:{up['artifactId']}" if up["artifactId"] else None, up["version"], list(p["properties"].items()), rows(p["dependencies"]), rows(p["managed"])))
            cols = list(zip(*out, strict=True)) if out else [[] for _ in range(8)]
            kinds = [pa.string()] * 5 + [pa.map_(pa.string(), pa.string()), row, row]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "name", "version", "parent", "parent_version", "properties", "dependencies", "managed"])

    return files.where(F.col("path").rlike(r"(^|/|\.)pom(\.xml)?$")).select("path", "text").mapInArrow(task, _POM)


def parent_chain(poms: DataFrame) -> DataFrame:
    """(path, name, depth, a_properties, a_managed): each POM with itself (depth 0) and its parents; a parent is found by its name."""
    # Of POMs with one name the least by path, so that reruns agree.
    first = poms.groupBy("name").agg(F.min("path").alias("path"))
    home = poms.join(first, ["name", "path"], "left_semi").dropDuplicates(["name", "path"])
    home = home.select(F.col("name").alias("h_name"), F.col("parent").alias("h_parent"), F.col("properties").alias("h_properties"), F.col("managed").alias("h_managed"))
    level = poms.select("path", "name", F.lit(0).alias("depth"), F.col("parent").alias("up"), F.col("properties").alias("a_properties"), F.col("managed").alias("a_managed"))
    out = level
    for depth in range(1, MAX_PARENTS + 1):
        level = stored(level.where("up IS NOT NULL").join(home, F.col("up") == F.col("h_name")).select("path", "name", F.lit(depth).alias("depth"), F.col("h_parent").alias("up"), F.col("h_properties").alias("a_properties"), F.col("h_managed").alias("a_managed")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.drop("up")


def _fill(value: Column, properties: Column, rounds: int = 4) -> Column:
    """value with ${name} references looked up, those inside values too, a few levels deep; unknown ones stay."""
    for _ in range(rounds):
        name = F.regexp_extract(value, r"\$\{([^}]+)\}", 1)
        known = F.try_element_at(properties, name)
        value = F.when((name != "") & known.isNotNull(), F.replace(value, F.concat(F.lit("${"), name, F.lit("}")), known)).otherwise(value)
    return value


def effective_dependencies(poms: DataFrame) -> DataFrame:
    """(path, name, version, scope, optional, ord, exclusions): dependencies with properties and managed versions of the parent chain.

    The nearest definition wins, and what it excludes is excluded beside what the dependency does; lists that a POM imports (scope import) come after its own and its parents' entries.
    """
    chain = stored(parent_chain(poms))
    near = chain.select("path", "depth", F.explode("a_properties").alias("k", "v")).groupBy("path", "k").agg(F.min(F.struct("depth", "v"))["v"].alias("v"))
    properties = near.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("all_properties"))
    entries = chain.select("path", "depth", F.explode("a_managed").alias("m")).select("path", "depth", "m.*")
    filled = entries.join(properties, "path", "left").withColumn("version", _fill(F.col("version"), F.coalesce("all_properties", F.create_map().cast("map<string,string>")))).drop("all_properties")
    imports = filled.where("scope = 'import'").select("path", "depth", F.col("name").alias("bom"))
    listed = chain.select(F.col("name").alias("b_name"), F.col("path").alias("b_path")).distinct()
    listed = listed.join(filled.where("scope <> 'import'").select(F.col("path").alias("l_path"), F.col("name"), F.col("version"), F.col("exclusions")), F.col("b_path") == F.col("l_path"))
    imported = imports.join(listed, F.col("bom") == F.col("b_name")).select("path", (F.col("depth") + 100).alias("depth"), "name", "version", "exclusions")
    managed = filled.where("scope <> 'import'").select("path", "depth", "name", "version", "exclusions").unionByName(imported)
    managed = managed.groupBy("path", "name").agg(F.min(F.struct("depth", "version", "exclusions")).alias("m")).select("path", "name", F.col("m.version").alias("managed"), F.col("m.exclusions").alias("m_exclusions"))
    own = poms.select("path", F.explode("dependencies").alias("d")).select("path", "d.*").join(properties, "path", "left")
    own = own.withColumn("version", _fill(F.col("version"), F.coalesce("all_properties", F.create_map().cast("map<string,string>"))))
    joined = own.join(managed, ["path", "name"], "left")
    version = F.when(resolved(F.col("version")) == "", F.coalesce("managed", "version")).otherwise(F.col("version"))
    scope = F.when(F.col("scope") == "test", "dev").when(F.col("scope").isin("system", "import"), F.col("scope")).otherwise("prod")
    return joined.select("path", "name", version.alias("version"), scope.alias("scope"), "optional", "ord", F.array_union("exclusions", F.coalesce("m_exclusions", F.array().cast("array<string>"))).alias("exclusions"))


def child_table(poms: DataFrame) -> DataFrame:
    """(parent, parent_version, child, child_version, ord, exclusions): what mediation walks; test and optional dependencies are not inherited."""
    deps = effective_dependencies(poms).where("scope = 'prod' AND NOT optional")
    home = poms.select("path", F.col("name").alias("parent"), F.col("version").alias("parent_version"))
    return home.join(deps, "path").select("parent", "parent_version", F.col("name").alias("child"), F.col("version").alias("child_version"), "ord", "exclusions")


def hybrid(first: DataFrame, second: DataFrame) -> DataFrame:
    """The edges of two sources, each (from, to) once; the first source's row stays."""
    both = first.select("from", "to", "source", F.lit(0).alias("rank")).unionByName(second.select("from", "to", "source", F.lit(1).alias("rank")))
    return both.groupBy("from", "to").agg(F.min(F.struct("rank", "source"))["source"].alias("source"))


def source_index(poms: DataFrame) -> DataFrame:
    """(name, paths): where in the tree each coordinate is built."""
    return poms.groupBy("name").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def mirror_for(mirrors: list[tuple[str, str]], repository: str) -> str | None:
    """The URL of the first mirror (pattern, URL) for a repository id; `*`, `external:*`, lists and `!id` are patterns."""
    for pattern, url in mirrors:
        parts = [p.strip() for p in pattern.split(",")]
        if f"!{repository}" not in parts and any(p in ("*", "external:*", repository) for p in parts):
            return url
    return None
