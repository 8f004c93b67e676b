"""Listings and rollups of rules, technologies, resources and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dependency_type
from .sizing import small_side

# Languages that are no surprise anywhere.
COMMON_LANGUAGES = (
    "C", "C#", "C++", "CSS", "Dart", "Dockerfile", "Elixir", "Erlang", "Go", "Groovy", "HTML", "Haskell", "Java", "JavaScript", "JSON", "Kotlin", "Lua", "Makefile", "Markdown", "Objective-C", "PHP",
    "Perl", "PowerShell", "Python", "R", "Ruby", "Rust", "Sass", "SCSS", "SQL", "Scala", "Shell", "Swift", "TOML", "TSX", "TSQL", "TypeScript", "VB.NET", "Visual Basic 6.0", "XML", "YAML", "XAML",
)
# Infrastructure resources by category; a resource in two categories is in the first here.
RESOURCE_CATEGORIES = {
    "compute": (
        "aws_instance", "aws_autoscaling_group", "aws_launch_template", "google_compute_instance", "google_compute_instance_group",
        "azurerm_virtual_machine", "azurerm_linux_virtual_machine", "azurerm_windows_virtual_machine",
    ),
    "storage": (
        "aws_s3_bucket", "aws_ebs_volume", "aws_efs_file_system", "google_storage_bucket", "google_compute_disk", "azurerm_storage_account",
        "azurerm_storage_blob", "azurerm_storage_container",
    ),
    "database": (
        "aws_db_instance", "aws_rds_cluster", "aws_dynamodb_table", "google_sql_database_instance", "google_bigtable_instance", "azurerm_sql_database",
        "azurerm_cosmosdb_account", "azurerm_mysql_server",
    ),
    "networking": (
        "aws_vpc", "aws_subnet", "aws_security_group", "aws_lb", "aws_route_table", "google_compute_network", "google_compute_firewall",
        "google_compute_subnetwork", "azurerm_virtual_network", "azurerm_network_security_group", "azurerm_subnet",
    ),
    "container": (
        "aws_ecs_cluster", "aws_eks_cluster", "aws_ecr_repository", "google_container_cluster", "google_cloud_run_service", "google_container_registry",
        "azurerm_kubernetes_cluster", "azurerm_container_registry", "azurerm_container_group",
    ),
    "serverless": (
        "aws_lambda_function", "aws_api_gateway_rest_api", "google_cloudfunctions_function", "azurerm_function_app", "azurerm_app_service",
    ),
}


def resource_category(kind: Column) -> Column:
    table = {x: category for category, names in RESOURCE_CATEGORIES.items() for x in names}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[kind], F.lit("other"))


def resource_rollup(resources: DataFrame) -> DataFrame:
    """resources (type) by provider and by category: (by, value, n), in one pass over the rows."""
    rows = resources.select(F.substring_index("type", "_", 1).alias("provider"), resource_category(F.col("type")).alias("category"))
    out = rows.groupingSets([[F.col("provider")], [F.col("category")], []], F.col("provider"), F.col("category")).agg(F.count("*").alias("n"), F.grouping("provider").alias("gp"), F.grouping("category").alias("gc"))
    by = F.when(F.col("gp") == 0, "provider").when(F.col("gc") == 0, "category").otherwise("total")
    return out.select(by.alias("by"), F.coalesce("provider", "category", F.lit("")).alias("value"), "n")


def techs_by_category(rules: DataFrame) -> DataFrame:
    """rules (tech, type): the technologies of each category."""
    return rules.groupBy("type").agg(F.array_join(F.array_sort(F.collect_set("tech")), ",").alias("techs"), F.count_distinct("tech").alias("n"))


def implicit_components(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """matches (component_id, tech) of rules that make a component of their own: (parent_id, name, tech, is_primary_tech, create_edges).

    rules: (tech, name, type, is_component, is_primary_tech, create_edges, rule_order), flags settled; the first rule of a technology counts.
    """
    first = rules.groupBy("tech").agg(F.min(F.struct("rule_order", "name", "is_component", "is_primary_tech", "create_edges")).alias("r"))
    made = small_side(first.where("r.is_component").select(F.col("tech").alias("r_tech"), "r.name", "r.is_primary_tech", "r.create_edges"))
    return matches.select("component_id", "tech").distinct().join(made, F.col("tech") == F.col("r_tech")).select(F.col("component_id").alias("parent_id"), "name", "tech", "is_primary_tech", "create_edges")


def niche_languages(files: DataFrame, least: int = 10) -> DataFrame:
    """Languages (language) of at least `least` files that are not among the common ones."""
    return files.where(~F.col("language").isin(*COMMON_LANGUAGES)).groupBy("language").agg(F.count("*").alias("files")).where(F.col("files") >= least)


def metadata_counts(components: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files, components (and the root), languages, technologies; components (tech array), files (language)."""
    c = components.agg((F.count("*") + 1).alias("components"))
    t = components.select(F.explode("tech").alias("t")).agg(F.count_distinct("t").alias("techs"))
    f = files.where("language IS NOT NULL").agg(F.count("*").alias("files"), F.count_distinct("language").alias("languages"))
    return f.crossJoin(F.broadcast(c)).crossJoin(F.broadcast(t))  # one row each


def package_key(type_: Column, name: Column) -> Column:
    """The name that references to a package are compared by: Python names canonical, .NET and C++ ones in lower case."""
    python = F.lower(F.regexp_replace(name, "[-_.]+", "-"))
    return F.when(type_ == "pypi", python).when(type_.isin("nuget", "dotnet-ref", "vcxproj-ref"), F.lower(name)).otherwise(name)


def nearest_values(places: DataFrame, values: DataFrame, most: int = 12) -> DataFrame:
    """(dir, key, value): for each place (dir) the values of the nearest directory above that sets the key, at most `most` levels up.

    values: (v_dir, key, value).
    """
    parts = F.filter(F.split("dir", "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.greatest(F.lit(0), F.size(parts) - most), F.size(parts)), lambda i: F.struct(F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("d"), i.alias("depth")))
    up = places.select("dir").distinct().select("dir", F.explode(above).alias("x"))
    hit = up.join(values, F.col("x.d") == F.col("v_dir"))
    return hit.groupBy("dir", "key").agg(F.max(F.struct(F.col("x.depth").alias("depth"), "value"))["value"].alias("value"))


def nearest_versions(rows: DataFrame, places: DataFrame, listed: DataFrame, name: Column | None = None, most: int = 12) -> DataFrame:
    """rows (dir, name, ...) with `near`, the version that the nearest directory with a list, at most `most` levels up, gives the name.

    places: the dirs that ask; listed: (l_dir, l_name, l_version), each name of a directory once.  Only the nearest list is
    asked: null where it has not the name, as for rows whose dir is null.
    """
    lists = listed.select(F.col("l_dir").alias("v_dir"), F.lit("").alias("key"), F.col("l_dir").alias("value")).distinct()
    near = nearest_values(places, lists, most).select(F.col("dir").alias("n_place"), F.col("value").alias("n_dir"))
    given = near.join(listed, F.col("n_dir") == F.col("l_dir")).select("n_place", "l_name", F.col("l_version").alias("near"))
    name = F.col("name") if name is None else name
    return rows.join(given, (F.col("dir") == F.col("n_place")) & (name == F.col("l_name")), "left").drop("n_place", "l_name")


#: A reference to a property, ${name} or $name.
REFERENCE = r"\$\{?([A-Za-z_][\w.]*)\}?"


def filled(value: Column, properties: Column, rounds: int = 3) -> Column:
    """value with references looked up in a map, those inside replacements too, some rounds deep; unknown ones stay."""
    for _ in range(rounds):
        known = lambda ref: F.try_element_at(properties, F.regexp_extract(ref, REFERENCE, 1))
        value = F.aggregate(F.regexp_extract_all(value, F.lit(REFERENCE), F.lit(0)), value, lambda v, ref: F.replace(v, ref, F.coalesce(known(ref), ref)))
    return value


def with_properties(rows: DataFrame, places: DataFrame, values: DataFrame, most: int = 12) -> DataFrame:
    """rows (dir, version, ...) with the references in their versions filled from the nearest directory above that sets each.

    places: the dirs that ask; values: (v_dir, key, value); rows whose dir is null stay as they are.
    """
    maps = nearest_values(places, values, most).groupBy(F.col("dir").alias("p_dir")).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("granary_known"))
    joined = rows.join(maps, F.col("dir") == F.col("p_dir"), "left")
    version = F.when(F.col("granary_known").isNull(), F.col("version")).otherwise(filled(F.col("version"), F.col("granary_known")))
    return joined.withColumn("version", version).select(*rows.columns)


def source_index(components: DataFrame) -> DataFrame:
    """(ecosystem, coordinate, paths): where each package is built, in every ecosystem whose names are packages; components: (type, name, path)."""
    kind = dependency_type(F.col("type"))
    rows = components.select(kind.alias("ecosystem"), package_key(kind, F.col("name")).alias("coordinate"), "path").where("ecosystem <> ''")
    return rows.groupBy("ecosystem", "coordinate").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def vendored(path: Column) -> Column:
    """Whether a path lies in a directory of code brought from elsewhere, and not below a hidden one at the top."""
    rel = F.regexp_replace(path, "^/", "")
    return rel.rlike(r"(^|/)(node_modules|vendor|third[-_]party|bower_components|Godeps|Pods|Carthage)/") & ~rel.startswith(".")


#: What a lookup may come to.
OUTCOMES = ("cached", "fetched", "missing", "denied", "failed")


def resolver_counts(lookups: DataFrame) -> DataFrame:
    """lookups (source, outcome) by source, a column for each outcome; sums, so snapshots may be taken at any time."""
    return lookups.groupBy("source").agg(F.count("*").alias("lookups"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])


def resolver_delta(now: DataFrame, before: DataFrame) -> DataFrame:
    """What resolver_counts has grown by since an earlier snapshot."""
    columns = ["lookups", *OUTCOMES]
    old = before.select(F.col("source").alias("b_source"), *[F.col(c).alias(f"b_{c}") for c in columns])
    joined = now.join(old, F.col("source") == F.col("b_source"), "left")
    return joined.select("source", *[(F.col(c) - F.coalesce(F.col(f"b_{c}"), F.lit(0))).alias(c) for c in columns])


def merged_properties(rows: DataFrame, concatenate: tuple[str, ...] = ("docker", "terraform")) -> DataFrame:
    """rows (component_id, key, value array, walk_order): arrays of some keys are joined end to end, of others the last stays."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("walk_order", "value"))), lambda x: x["value"])
    return rows.groupBy("component_id", "key").agg(ordered.alias("v")).select("component_id", "key", F.when(F.col("key").isin(*concatenate), F.flatten("v")).otherwise(F.element_at("v", -1)).alias("value"))


