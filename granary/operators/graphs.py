"""Edges, closures, mediation and resolution of dependency graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ancestors
from ..functions.versions import resolved
from .storage import stored as stored  # also under this name

MAX_DEPTH = 64


def root_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """('.', node) for the nodes that no edge points to."""
    return nodes.join(edges.select(F.col("to").alias("node")), "node", "left_anti").select(F.lit(".").alias("from"), F.col("node").alias("to"))


def closure(edges: DataFrame, start: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(root, node, depth): what each start node (column `node`) reaches, at its least depth; cycles end.

    One join per level of the new nodes only; levels stop when nothing new is found.
    """
    edges = edges.select(F.col("from").alias("e_from"), F.col("to").alias("e_to")).distinct()
    level = stored(start.select(F.col("node").alias("root"), "node").distinct().withColumn("depth", F.lit(0)))
    levels = [level]
    for depth in range(1, max_depth + 1):
        seen = levels[0]
        for more in levels[1:]:
            seen = seen.unionByName(more)
        if len(levels) == 8:  # few tables to read, however deep the graph is
            seen = stored(seen)
            levels = [seen]
        step = level.join(edges, F.col("node") == F.col("e_from")).select("root", F.col("e_to").alias("node")).distinct()
        level = stored(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        levels.append(level)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def nearest_wins(children: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(name, version, depth): the version of each name met first, by depth and then by order.

    children: (parent, parent_version, child, child_version, ord); roots: (name, version, ord).  A name that is chosen is
    expanded once, with the chosen version, so cycles end.
    """
    kids = children.select(F.col("parent").alias("c_parent"), F.col("parent_version").alias("c_version"), "child", "child_version", F.col("ord").alias("c_ord"))

    def choose(rows: DataFrame) -> DataFrame:
        return rows.groupBy("name").agg(F.min(F.struct("ord", "version")).alias("x")).select("name", F.col("x.version").alias("version"), F.col("x.ord").alias("ord"))

    level = stored(choose(roots.select("name", "version", F.col("ord").cast("string").alias("ord"))).withColumn("depth", F.lit(0)))
    chosen = level
    for depth in range(1, max_depth + 1):
        step = level.join(kids, (F.col("name") == F.col("c_parent")) & (F.col("version") == F.col("c_version")))
        found = step.select(F.col("child").alias("name"), F.col("child_version").alias("version"), F.concat_ws("/", "ord", F.lpad(F.col("c_ord").cast("string"), 19, "0")).alias("ord"))
        level = stored(choose(found.join(chosen.select("name"), "name", "left_anti")).withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        chosen = chosen.unionByName(level)
    return chosen.select("name", "version", "depth")


def first_source(rows: DataFrame, keys: list[str], rank: str, *columns: str) -> DataFrame:
    """Per key the columns of the source with the least rank that answers; summed before the shuffle."""
    best = F.min(F.struct(F.col(rank), *[F.col(c) for c in columns])).alias("x")
    return rows.groupBy(*keys).agg(best).select(*keys, f"x.{rank}", *[f"x.{c}" for c in columns])


def propagate_versions(deps: DataFrame, kinds: tuple[str, ...] = ("maven", "gradle"), ties: tuple[str, ...] = ()) -> DataFrame:
    """deps with the first concrete version of the same name where there is none; one namespace for all kinds.

    First by walk order, then by the columns `ties`; of rows that these do not tell apart, the least version.
    """
    own = deps.where(F.col("type").isin(*kinds))
    known = own.where(resolved(F.col("version")) != "").groupBy("name").agg(F.min(F.struct("walk_order", *ties, "version"))["version"].alias("known"))
    joined = deps.join(known.withColumnRenamed("name", "k_name"), F.col("type").isin(*kinds) & (F.col("name") == F.col("k_name")), "left")
    return joined.withColumn("version", F.when((resolved(F.col("version")) == "") & F.col("known").isNotNull(), F.col("known")).otherwise(F.col("version"))).select(*deps.columns)


def backfill_managed(deps: DataFrame, managed: DataFrame, any_case: bool = False) -> DataFrame:
    """deps with the managed version of their name where they have no pin; managed: (name, version)."""
    key = (lambda c: F.lower(c)) if any_case else (lambda c: c)
    table = managed.groupBy(key(F.col("name")).alias("m_name")).agg(F.min("version").alias("managed"))
    joined = deps.join(table, key(F.col("name")) == F.col("m_name"), "left")
    return joined.withColumn("version", F.when((resolved(F.col("version")) == "") & F.col("managed").isNotNull(), F.col("managed")).otherwise(F.col("version"))).select(*deps.columns)


def component_refs(deps: DataFrame, packages: DataFrame) -> DataFrame:
    """(component_id, target_id, package): dependencies that another component provides; the last one registered wins.

    deps: (component_id, type, name); packages: (type, package, component_id, walk_order).
    """
    last = packages.groupBy("type", "package").agg(F.max(F.struct("walk_order", "component_id"))["component_id"].alias("target_id"))
    joined = deps.join(last.withColumnRenamed("type", "p_type"), (F.col("type") == F.col("p_type")) & (F.col("name") == F.col("package")))
    return joined.where("component_id <> target_id").select("component_id", "target_id", "package").distinct()


def nearest_ancestor(paths: DataFrame, owners: DataFrame, key: str = "path") -> DataFrame:
    """paths with the owner whose directory is the longest prefix; owners: (dir, owner).

    A path meets its own directories only (an equi-join on prefixes), not every owner.
    """
    above = paths.select(key, F.explode(ancestors(F.col(key))).alias("x"))
    hit = above.join(owners, F.col("x.prefix") == F.col("dir")).groupBy(key).agg(F.max(F.struct(F.col("x.depth").alias("depth"), "dir", "owner")).alias("o"))
    return paths.join(hit, key, "left").select(*[paths[c] for c in paths.columns], F.col("o.dir").alias("owner_dir"), F.col("o.owner").alias("owner"))


def merge_components(components: DataFrame) -> DataFrame:
    """Components of one parent that share their name and a path, and are not both without technology, as one.

    components: (parent_id, component_id, name, paths array, tech array, walk_order).  Names and paths bring candidates
    together by an equi-join; the first in walk order takes the others' paths and technologies.
    """
    at = components.select("parent_id", "name", "component_id", "walk_order", (F.size("tech") > 0).alias("has_tech"), F.explode("paths").alias("p"))
    groups = at.groupBy("parent_id", "name", "p").agg(F.min(F.struct("walk_order", "component_id"))["component_id"].alias("keep"), F.bool_or("has_tech").alias("some"))
    keep = at.join(groups, ["parent_id", "name", "p"]).where("some OR keep = component_id").groupBy("component_id").agg(F.min("keep").alias("keep"))
    joined = components.join(keep, "component_id", "left").withColumn("keep", F.coalesce("keep", "component_id"))
    return joined.groupBy("parent_id", "name", F.col("keep").alias("component_id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("paths")))).alias("paths"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tech")))).alias("tech"), F.count("*").alias("merged"))


def valid_cache(keys: DataFrame, cache: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """keys (system, name) with what the cache holds and has not expired (nothing, if forced); cache: (system, name, latest, not_found, fetched_at, ttl_seconds)."""
    last = cache.groupBy("system", "name").agg(F.max(F.struct("fetched_at", "latest", "not_found", "ttl_seconds")).alias("x"))
    live = F.coalesce(F.col("x.fetched_at") + F.col("x.ttl_seconds") >= now, F.lit(False)) & F.lit(not force)
    return keys.join(last, ["system", "name"], "left").select(*keys.columns, F.when(live, F.col("x.latest")).alias("latest"), F.when(live, F.col("x.not_found")).alias("not_found"), live.alias("hit"))


def upsert_cache(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """The cache with the latest row per (system, name)."""
    rows = cache.unionByName(fetched)
    rest = [c for c in rows.columns if c not in ("system", "name", "fetched_at")]
    return rows.groupBy("system", "name").agg(F.max(F.struct("fetched_at", *rest)).alias("x")).select("system", "name", *[f"x.{c}" for c in ("fetched_at", *rest)]).select(*cache.columns)


def online_edges(wanted: DataFrame, fetch, parallel: int = 16) -> DataFrame:
    """(name, version, from, to, found): the graph that fetch(system, name, version) gives for wanted packages.

    fetch returns (from, to) pairs, or None for a package it does not know; a failure (OSError) gives no row, so the
    package stays unresolved.  It runs on the executors, in at most `parallel` tasks at a time.
    """

    def task(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for system, name, version in zip(frame["system"], frame["name"], frame["version"], strict=True):
                try:
                    edges = fetch(system, name, version)
                except OSError:
                    continue
                rows += [(name, version, a, b, True) for a, b in edges] if edges is not None else [(name, version, None, None, False)]
            yield pd.DataFrame(rows, columns=["name", "version", "from", "to", "found"])

    return wanted.select("system", "name", "version").distinct().repartition(parallel).mapInPandas(task, "name string, version string, `from` string, `to` string, found boolean")
