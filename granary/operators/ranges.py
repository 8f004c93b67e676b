"""Versions that satisfy ranges, by one sort of both and an equi-join; no pair is compared in vain.

Versions and bounds of intervals of a name are sorted together; a bound's place is the number of versions before it, so an
interval is a stretch of places and its versions are met by (name, place).  Distinct ranges and versions only take part:
however many rows repeat them, a name's sort is of what it has published and of the ranges that name it, and rows meet the
answer by an equi-join that may be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import DIALECTS, range_intervals
from .storage import stored


def _node(name: Column, version: Column) -> Column:
    return F.concat_ws("@", name, version)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _versions(versions: DataFrame, dialect: str) -> DataFrame:
    """(name, version, key, is_pre, core, place): distinct versions in order; place is null for what is no version."""
    have = DIALECTS[dialect][0](versions.where("name IS NOT NULL AND version IS NOT NULL").select("name", "version").distinct())
    place = F.when(F.col("key").isNotNull(), F.row_number().over(Window.partitionBy("name").orderBy(F.col("key").asc_nulls_last(), "version")) - 1)
    return stored(have.withColumn("place", place))


def _matches(wanted: DataFrame, have: DataFrame, dialect: str) -> DataFrame:
    """(name, spec, version, key) of the distinct (name, spec) and the versions that satisfy them."""
    intervals = stored(range_intervals(wanted.select("spec").distinct(), dialect))
    parts = wanted.join(intervals.withColumnRenamed("spec", "i_spec"), F.col("spec") == F.col("i_spec")).drop("i_spec")
    # Each bound once per name, however many ranges have it.
    bounds = parts.select("name", F.explode(F.array("lo", "hi")).alias("key")).distinct().withColumn("is_version", F.lit(0))
    both = bounds.unionByName(have.where("place IS NOT NULL").select("name", "key", F.lit(1).alias("is_version")))
    # A bound stands before the versions that equal it: they are at or above it.
    before = F.sum("is_version").over(Window.partitionBy("name").orderBy("key", "is_version").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = stored(both.withColumn("before", before).where("is_version = 0").select("name", "key", "before"))
    low, high = (placed.select(F.col("name").alias(f"{c}_name"), F.col("key").alias(f"{c}_key"), F.col("before").alias(f"{c}_place")) for c in ("lo", "hi"))
    stretch = parts.join(low, (F.col("name") == F.col("lo_name")) & (F.col("lo") == F.col("lo_key"))).join(high, (F.col("name") == F.col("hi_name")) & (F.col("hi") == F.col("hi_key"))).where("lo_place < hi_place")
    hits = stretch.select("name", "spec", "allows_pre", "cores", F.explode(F.sequence(F.col("lo_place"), F.col("hi_place") - 1)).alias("place"))
    return hits.join(have.withColumn("place", F.col("place").cast("long")), ["name", "place"]).where("NOT is_pre OR allows_pre OR array_contains(cores, core)").select("name", "spec", "version", "key").distinct()


def _wanted(specs: DataFrame) -> DataFrame:
    return stored(specs.where("name IS NOT NULL").select("name", "spec").distinct())


def satisfying(specs: DataFrame, versions: DataFrame, dialect: str = "pep440", keep_unmatched: bool = True) -> DataFrame:
    """(name, spec, version, matched): for each distinct (name, spec) all versions of the name that satisfy it.

    specs: (name, spec); versions: (name, version).  Pre-releases satisfy a range only if it names one (semver: one of the same
    release).  Where none satisfies, or spec is no range (null too), all versions stay, unmatched, if keep_unmatched; else
    none.  Rows without a name take no part; a version that is none satisfies nothing but stays among all.
    """
    wanted, have = _wanted(specs), _versions(versions, dialect)
    found = stored(_matches(wanted, have, dialect).select("name", "spec", "version", F.lit(True).alias("matched")))
    if not keep_unmatched:
        return found
    done = found.select(F.col("name").alias("d_name"), F.col("spec").alias("d_spec")).distinct()
    rest = wanted.join(done, (F.col("name") == F.col("d_name")) & _same("spec", "d_spec"), "left_anti")
    return found.unionByName(rest.join(have.select("name", "version"), "name").select("name", "spec", "version", F.lit(False).alias("matched")))


def best_satisfying(specs: DataFrame, versions: DataFrame, dialect: str = "pep440") -> DataFrame:
    """(name, spec, version): the highest version that satisfies each distinct (name, spec); none for those without one."""
    found = _matches(_wanted(specs), _versions(versions, dialect), dialect)
    return found.groupBy("name", "spec").agg(F.max(F.struct("key", "version"))["version"].alias("version"))


def range_edges(packages: DataFrame, requirements: DataFrame, dialect: str = "pep440") -> DataFrame:
    """(lock, from, to): an edge from each locked package to every locked version of what it needs that satisfies the range.

    packages: (lock, name, version); requirements: (lock, name, version, needs, spec).  A name that is locked once is met
    whatever the range; where no version satisfies, all stay.  Needs that the lock does not have give no edge.
    """
    key = lambda name: F.concat_ws("\0", F.coalesce("lock", F.lit("")), name)
    locked = packages.where("name IS NOT NULL AND version IS NOT NULL").select(key(F.col("name")).alias("name"), "version").distinct()
    several = locked.groupBy(F.col("name").alias("s_name")).agg(F.count("*").alias("n"), F.min("version").alias("only"))
    asked = requirements.select("lock", _node(F.col("name"), F.col("version")).alias("from"), F.col("needs"), "spec", key(F.col("needs")).alias("k")).where("needs IS NOT NULL").distinct()
    asked = stored(asked.join(several, F.col("k") == F.col("s_name")))
    alone = asked.where("n = 1").select("lock", "from", _node(F.col("needs"), F.col("only")).alias("to"))
    many = asked.where("n > 1").select("lock", "from", "needs", "spec", "k")
    found = satisfying(many.select(F.col("k").alias("name"), "spec"), locked, dialect).select(F.col("name").alias("f_name"), F.col("spec").alias("f_spec"), F.col("version").alias("f_version"))
    matched = many.join(found, (F.col("k") == F.col("f_name")) & _same("spec", "f_spec")).select("lock", "from", _node(F.col("needs"), F.col("f_version")).alias("to"))
    return alone.unionByName(matched).distinct()
