"""Components in relation: parents, declared and locked versions, references, and the tree for one document."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ancestors
from ..functions.versions import resolved
from .documents import tree_documents
from .listings import nearest_versions, package_key

#: Lockfiles, whose versions stand before those that manifests declare.
LOCKFILES = r"(^|/)(package-lock\.json|pnpm-lock\.yaml|yarn\.lock|poetry\.lock|uv\.lock|Cargo\.lock|Gemfile\.lock|Podfile\.lock|pubspec\.lock|gradle\.lockfile|dependency-list\.txt)$"


def with_parents(components: DataFrame, root_id: str) -> DataFrame:
    """components (component_id, dir, …) with parent_id and depth: the nearest component in a directory above, else the root."""
    others = components.where(F.col("component_id") != root_id)
    here = others.groupBy("dir").agg(F.min("component_id").alias("up"))
    above = others.select("component_id", "dir", F.explode(ancestors(F.concat("dir", F.lit("/x")))).alias("a")).where("a.prefix <> dir")
    hit = above.join(here.withColumnRenamed("dir", "u_dir"), F.col("a.prefix") == F.col("u_dir")).groupBy("component_id").agg(F.max(F.struct(F.col("a.depth").alias("d"), "up"))["up"].alias("up"), F.count("*").alias("n"))
    joined = components.join(hit, "component_id", "left")
    parent = F.when(F.col("component_id") == root_id, F.lit(None).cast("string")).otherwise(F.coalesce("up", F.lit(root_id)))
    return joined.withColumn("parent_id", parent).withColumn("depth", F.when(F.col("component_id") == root_id, F.lit(0)).otherwise(F.coalesce("n", F.lit(0)).cast("int") + 1)).drop("up", "n")


def settled_dependencies(deps: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """deps (component_id, type, name, version, scope, direct, source, …) with one row per package of a component: the
    locked version, what the manifest declares beside it, and the manifest's scope.

    A package that only a lockfile has stays as it is; versions a manifest repeats (two concrete ones) stay apart.
    A member of an npm workspace has no lockfile beside it: there the nearest one in a directory above speaks; shared: its
    versions (l_dir, l_name, l_version).
    """
    is_lock = F.col("source").rlike(LOCKFILES)
    lock = deps.where(is_lock)
    manifest = deps.where(~is_lock)
    keys = ["component_id", "type", "name"]
    locked = lock.groupBy(*keys).agg(F.min(F.struct("walk_order", "version"))["version"].alias("l_version"))
    if shared is None:
        manifest = manifest.withColumn("near", F.lit(None).cast("string"))
    else:
        up = F.regexp_replace("source", "/[^/]*$", "")
        folder = F.when(up == "", F.lit("/")).otherwise(up)
        places = manifest.where("type = 'npm'").select(folder.alias("dir")).distinct()
        manifest = nearest_versions(manifest.withColumn("dir", F.when(F.col("type") == "npm", folder)), places, shared).drop("dir")
    declared = manifest.join(locked, keys, "left").withColumn("l_version", F.coalesce("l_version", "near")).drop("near").withColumn("declared", F.when(F.col("l_version").isNotNull() & (F.col("l_version") != F.col("version")), F.col("version"))).withColumn("version", F.coalesce("l_version", "version")).drop("l_version")
    rest = lock.join(manifest.select(*keys).distinct(), keys, "left_anti").withColumn("declared", F.lit(None).cast("string"))
    return declared.unionByName(rest).select(*deps.columns, "declared")


def references(deps: DataFrame, components: DataFrame) -> DataFrame:
    """(component_id, target_id, package): dependencies that name another component of the scan, by the type's own rule for names."""
    from ..functions.columns import dependency_type

    kind = dependency_type(F.col("type"))
    packages = components.where("type <> ''").select(kind.alias("p_type"), package_key(kind, F.col("name")).alias("package"), F.col("component_id").alias("target_id"), F.col("dir").alias("d")).where("p_type <> ''")
    last = packages.groupBy("p_type", "package").agg(F.max(F.struct("d", "target_id"))["target_id"].alias("target_id"))
    joined = deps.join(last, (F.col("type") == F.col("p_type")) & (package_key(F.col("type"), F.col("name")) == F.col("package")))
    return joined.where("component_id <> target_id").select("component_id", "target_id", "package").distinct()


def unresolved(deps: DataFrame) -> DataFrame:
    """Dependencies without a concrete version."""
    return deps.where(resolved(F.col("version")) == "")


def tree(components: DataFrame, root_id: str, parts: Mapping[str, DataFrame]) -> str:
    """The nested document of one system: each component with its rows of `parts` (by component_id) and its children.

    Put together by executors (documents.py, for many systems at once); its one row comes to the driver.
    """
    tech = F.coalesce("tech", F.array().cast("array<string>")) if "tech" in components.columns else F.array().cast("array<string>")
    root = F.lit(root_id).alias("root_id")
    nodes = components.withColumn("tech", tech).withColumn("parent_id", F.when(F.col("component_id") != root_id, F.coalesce("parent_id", F.lit(root_id)))).select("*", root)
    return tree_documents(nodes, {name: rows.select("*", root) for name, rows in parts.items()}).first()["document"]
