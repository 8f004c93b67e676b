"""Mediation of dependency graphs whose edges exclude packages below them.

Many projects are mediated at once, level by level.  A state is a package reached in a project together with the set of
exclusions gathered on the way; an edge's own exclusions hold below it only.  So a package is blocked on the paths that
exclude it and is found by any other.  Of the states of one package only the least sets go on: a state is dominated, and
dropped, when an earlier one (of a level above, or of the same level and before it by order) excludes no more, for all that
it reaches the other reaches as early.  That bounds the states of a package by the sets none of which holds another, and
ends cycles: going round can only add to the set.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graphs import MAX_DEPTH
from .storage import stored

#: Tables of earlier levels that are read side by side before they are written as one.
MOST_TABLES = 8


def _or_none(exclusions: str) -> Column:
    return F.coalesce(exclusions, F.array().cast("array<string>"))


def covers(name: Column) -> Column:
    """The exclusions that block a package `group:artifact`: itself, and those with `*` for either part or both."""
    group, artifact = F.substring_index(name, ":", 1), F.substring_index(name, ":", -1)
    return F.array(name, F.concat(group, F.lit(":*")), F.concat(F.lit("*:"), artifact), F.lit("*:*"))


def least_exclusions(exclusions: Column) -> Column:
    """The set in order, each once, without those that a wider one of the set covers."""
    wider = lambda x: F.array_except(covers(x), F.array(x))
    return F.array_sort(F.array_distinct(F.filter(exclusions, lambda x: ~F.arrays_overlap(exclusions, wider(x)))))


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _few(tables: list[DataFrame]) -> list[DataFrame]:
    return [stored(_union(tables))] if len(tables) >= MOST_TABLES else tables


def _order(column: Column) -> Column:
    return F.lpad(column.cast("string"), 19, "0")


def _undominated(states: DataFrame, seen: list[DataFrame]) -> DataFrame:
    """States (project, name, version, excluded, ord) that no state of a level above, and none before them, makes superfluous."""
    key = [F.col("project").alias("o_project"), F.col("name").alias("o_name"), F.col("excluded").alias("o_excluded")]
    others = _union([*(s.select(*key, F.lit("").alias("o_ord")) for s in seen), states.select(*key, F.col("ord").alias("o_ord"))])
    within = F.size(F.array_except("o_excluded", "excluded")) == 0
    before = (F.col("o_ord") == "") | ((F.col("o_excluded") != F.col("excluded")) & (F.col("o_ord") <= F.col("ord")))
    return states.join(others, F.col("project").eqNullSafe(F.col("o_project")) & (F.col("name") == F.col("o_name")) & within & before, "left_anti")


def mediate(children: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(project, name, version, depth): per project, the version of each package met first, by depth and then by order.

    children: (parent, parent_version, child, child_version, ord, exclusions); roots: (project, name, version, ord,
    exclusions); exclusions: array of `group:artifact`, either part may be `*`, null is none.  Where the chosen version of a
    package is met again with other exclusions, what it needs is walked under these too; other versions are left.
    Rows without a name or version are not walked; an empty table of roots gives no rows.
    """
    kids = children.select(F.col("parent").alias("c_parent"), F.col("parent_version").alias("c_version"), "child", "child_version", _order(F.col("ord")).alias("c_ord"), _or_none("exclusions").alias("c_excluded"))
    found = stored(roots.where("name IS NOT NULL AND version IS NOT NULL").select("project", "name", "version", _order(F.col("ord")).alias("ord"), least_exclusions(_or_none("exclusions")).alias("excluded")))
    chosen: list[DataFrame] = []
    seen: list[DataFrame] = []
    for depth in range(max_depth + 1):
        new = found
        if chosen:
            have = _union(chosen).select(F.col("project").alias("h_project"), F.col("name").alias("h_name"))
            new = found.join(have, F.col("project").eqNullSafe(F.col("h_project")) & (F.col("name") == F.col("h_name")), "left_anti")
        new = new.groupBy("project", "name").agg(F.min(F.struct("ord", "version"))["version"].alias("version")).withColumn("depth", F.lit(depth))
        chosen = _few([*chosen, stored(new)])
        have = _union(chosen).select(F.col("project").alias("h_project"), F.col("name").alias("h_name"), F.col("version").alias("h_version"))
        own = found.join(have, F.col("project").eqNullSafe(F.col("h_project")) & (F.col("name") == F.col("h_name")) & (F.col("version") == F.col("h_version")), "left_semi")
        states = stored(own.groupBy("project", "name", "version", "excluded").agg(F.min("ord").alias("ord")))
        live = stored(_undominated(states, seen))
        if depth == max_depth or live.isEmpty():
            break
        seen = _few([*seen, live])
        step = live.join(kids, (F.col("name") == F.col("c_parent")) & (F.col("version") == F.col("c_version"))).where(~F.arrays_overlap("excluded", covers(F.col("child"))))
        step = step.where("child IS NOT NULL AND child_version IS NOT NULL")
        found = stored(step.select("project", F.col("child").alias("name"), F.col("child_version").alias("version"), F.concat_ws("/", "ord", "c_ord").alias("ord"), least_exclusions(F.concat("excluded", "c_excluded")).alias("excluded")))
    return _union(chosen).select("project", "name", "version", "depth")
