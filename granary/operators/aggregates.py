"""Rollups of components, dependencies, code statistics and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import LANGUAGE_TECH, dir_group, ratio2, round2, scope_priority
from ..functions.versions import lookup


def merged_dependencies(deps: DataFrame, *keys: str) -> DataFrame:
    """One row per (keys, type, name, version): direct anywhere is direct, the most exposed scope, the first source and license by walk order.

    Every part is commutative and associative, so it is summed before the shuffle and does not depend on the order of rows.
    """

    def first_text(column: str) -> Column:
        return F.min(F.when(F.coalesce(F.col(column), F.lit("")) != "", F.struct("walk_order", column)))[column]

    # Scopes outside the table share a rank; the earliest of them stays.
    scope = F.min(F.struct((-scope_priority(F.col("scope"))).alias("p"), "walk_order", F.coalesce("scope", F.lit("")).alias("scope")))["scope"]
    return deps.groupBy(*keys, "type", "name", "version").agg(F.bool_or("direct").alias("direct"), scope.alias("scope"), first_text("source").alias("source"), first_text("license").alias("license"), F.count("*").alias("occurrences"))


def merged_edges(edges: DataFrame, *keys: str) -> DataFrame:
    """One row per (keys, from, to) with the source and scope of the last in walk order."""
    last = F.max(F.struct("walk_order", "source", "scope"))
    return edges.groupBy(*keys, "from", "to").agg(last.alias("x")).select(*keys, "from", "to", F.col("x.source").alias("source"), F.col("x.scope").alias("scope"))


def distinct_values(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """The distinct non-empty values of an array column, long form."""
    return df.select(*keys, F.explode(column).alias("value")).where("value <> ''").distinct()


def reasons_by_tech(reasons: DataFrame) -> DataFrame:
    """tech with its distinct reasons, in order of first appearance, joined by '; '."""
    first = reasons.groupBy("tech", "reason").agg(F.min("walk_order").alias("w"))
    return first.groupBy("tech").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w", "reason"))), lambda x: x["reason"]), "; ").alias("reasons"))


def line_counts(files: DataFrame, text: str = "text", comment: str = "#") -> DataFrame:
    """files with lines, blanks, comments and code of their text.

    A line is what stands between newlines; a last empty one does not count.  A line whose first mark is `comment` is one.
    """
    lines = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\n$", ""), "\n")
    lines = F.when(F.coalesce(F.col(text), F.lit("")) == "", F.array().cast("array<string>")).otherwise(lines)
    out = files.withColumn("line_list", lines)
    out = out.withColumns({
        "lines": F.size("line_list").cast("long"),
        "blanks": F.size(F.filter("line_list", lambda x: F.trim(x) == "")).cast("long"),
        "comments": F.size(F.filter("line_list", lambda x: F.ltrim(x).startswith(comment))).cast("long"),
    })
    return out.withColumn("code", F.col("lines") - F.col("blanks") - F.col("comments")).drop("line_list")


_MEASURES = ("files", "lines", "code", "comments", "blanks", "complexity")


def code_stats(files: DataFrame, *levels: str) -> DataFrame:
    """Sums of the measures by language and for each level (a column), the whole corpus too, as grouping sets in one pass.

    files: (language, *levels, lines, code, comments, blanks, complexity).  The level column says which grouping a row is of.
    """
    sets = [["language"], []] + [[level, *x] for level in levels for x in (["language"], [])]
    columns = ["language", *levels]
    grouped = files.withColumn("files", F.lit(1).cast("long")).groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    out = grouped.agg(*[F.sum(m).cast("long").alias(m) for m in _MEASURES], *[F.grouping(c).cast("int").alias(f"all_{c}") for c in columns])
    level = F.coalesce(*[F.when(F.col(f"all_{c}") == 0, F.lit(c)) for c in levels], F.lit("all"))
    key = F.coalesce(*[F.when(F.col(f"all_{c}") == 0, F.col(c)) for c in levels], F.lit(""))
    return out.select(level.alias("level"), key.alias("key"), F.when(F.col("all_language") == 0, F.col("language")).otherwise(F.lit("")).alias("language"), *_MEASURES)


def metrics(stats: DataFrame) -> DataFrame:
    """stats with the ratios of its measures, two decimals each, 0 where they would divide by 0."""
    code, lines, files = F.col("code"), F.col("lines"), F.col("files")
    return stats.withColumns({
        "comment_ratio": ratio2(F.col("comments"), code),
        "code_density": ratio2(code, lines),
        "avg_file_size": ratio2(lines, files),
        "complexity_per_kloc": F.when(code == 0, F.lit(0.0)).otherwise(round2(F.col("complexity") / (code / 1000.0))),
        "avg_complexity": ratio2(F.col("complexity"), files),
    })


def primary_languages(by_language: DataFrame, top: int = 5, threshold: float = 0.05) -> DataFrame:
    """The largest languages (language, lines) with their share of all lines, down to the threshold; ties by name."""
    total = by_language.agg(F.sum("lines").alias("total"))
    share = by_language.crossJoin(F.broadcast(total)).select("language", "lines", ratio2(F.col("lines"), F.col("total")).alias("pct"))  # one row
    return share.where(F.col("pct") >= threshold).orderBy(F.desc("lines"), "language").limit(top)


def language_tech(language: Column) -> Column:
    return lookup(language, LANGUAGE_TECH)


def primary_techs(components: DataFrame, eligible: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """The technologies that make up most of a system.

    components: (component_id, type, tech array, code); eligible: (tech); languages: (language, pct).  Weighed by code if
    at least half of the typed components have some, else counted; dominant languages without a typed component join.
    """
    typed = components.where("coalesce(type, '') <> ''")
    sizes = typed.agg(F.count("*").alias("typed"), F.count_if(F.col("code") > 0).alias("with_code"), F.coalesce(F.sum(F.when(F.col("code") > 0, F.col("code"))), F.lit(0)).cast("long").alias("total"))
    mode = sizes.select("*", ((F.col("with_code") > 0) & (F.col("with_code") * 2 >= F.col("typed"))).alias("by_code"))
    per = typed.select("component_id", "code", F.explode(F.array_distinct("tech")).alias("tech")).join(eligible.select("tech").distinct(), "tech")
    per = per.groupBy("tech").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("code") > 0, F.col("code"))), F.lit(0)).cast("long").alias("code"))
    joined = per.crossJoin(F.broadcast(mode))  # one row
    by_code = (F.col("code") > 0) & (F.col("code") >= F.greatest(F.lit(1), F.expr("total div 100")))
    by_count = F.col("n") >= F.when(F.col("typed") <= 10, F.lit(1)).otherwise(F.greatest(F.lit(2), F.expr("3 * typed div 100")))
    out = joined.where(F.when(F.col("by_code"), by_code).otherwise(by_count)).select("tech")
    if languages is None:
        return out
    in_typed = typed.select(F.explode("tech").alias("tech")).distinct()
    dominant = languages.where("pct >= 0.5").select(language_tech(F.col("language")).alias("tech")).where("tech IS NOT NULL").join(eligible.select("tech").distinct(), "tech", "left_semi")
    return out.unionByName(dominant.join(in_typed, "tech", "left_anti")).distinct()


def ecosystems(components: DataFrame, languages: DataFrame, of_type: DataFrame, of_tech: DataFrame, of_language: DataFrame) -> DataFrame:
    """(ecosystem, components): typed components by type; untyped ones once per ecosystem of a technology; languages where nothing else speaks.

    of_*: dimension tables (type|tech|language, ecosystem).
    """
    typed = components.where("coalesce(type, '') <> ''").join(of_type, "type").select("component_id", "ecosystem")
    untyped = components.where("coalesce(type, '') = ''").select("component_id", F.explode("tech").alias("tech")).join(of_tech, "tech").select("component_id", "ecosystem").distinct()
    counted = typed.unionByName(untyped).groupBy("ecosystem").agg(F.count("*").alias("components"))
    spoken = languages.select("language").distinct().join(of_language, "language").select("ecosystem").distinct().join(counted, "ecosystem", "left_anti")
    return counted.unionByName(spoken.select("ecosystem", F.lit(1).cast("long").alias("components")))


def subsystem_rollup(components: DataFrame) -> DataFrame:
    """components (subsystem, component_id, tech array, code) by subsystem, the largest first."""
    techs = components.select("subsystem", F.explode("tech").alias("t")).groupBy("subsystem").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("techs"))
    counts = components.groupBy("subsystem").agg(F.count("*").alias("component_count"), F.sum("code").cast("long").alias("code"))
    return counts.join(techs, "subsystem", "left").select("subsystem", "component_count", "code", F.coalesce("techs", F.lit("")).alias("techs")).orderBy(F.desc("code"), "subsystem")


def directory_counts(files: DataFrame, signal: Column, least: int = 5, top: int = 5) -> DataFrame:
    """The directories (two deep) with the most files that show a signal, from `least` files on; ties by name."""
    return files.where(signal).groupBy(dir_group(F.col("path")).alias("dir")).agg(F.count("*").alias("files")).where(F.col("files") >= least).orderBy(F.desc("files"), "dir").limit(top)


def dominance(counts: DataFrame, key: str, n: str, share: float = 0.85, more_than: int = 2) -> DataFrame:
    """The top key of (key, n) if there are more than `more_than` keys and it has more than `share` of the sum."""
    total = counts.agg(F.count("*").alias("keys"), F.sum(n).alias("total"))
    top = counts.orderBy(F.desc(n), key).limit(1)
    return top.crossJoin(F.broadcast(total)).where((F.col("keys") > more_than) & (F.col(n) / F.col("total") > share)).select(key, n, round2(F.col(n) / F.col("total")).alias("share"))  # one row


def repeated_names(rows: DataFrame, name: str, least: int = 5, top: int = 3) -> DataFrame:
    """The names that occur at least `least` times, the most frequent `top`; ties by name."""
    return rows.groupBy(name).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), name).limit(top)


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; for keys with many rows prefer min_by, which sums before the shuffle."""
    return rows.withColumn("granary_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("granary_rn = 1").drop("granary_rn")
