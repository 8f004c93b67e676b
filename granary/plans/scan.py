"""A scan: a source tree to components, technologies, dependencies, edges and code statistics."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggregates as A
from ..operators import components as K
from ..operators import graphs as G
from ..operators import listings as L
from ..operators import rules as R
from ..operators.storage import side_by_side
from ..sources import config, licenses, lockgraphs, manifests
from ..sources import files as S
from ..sources import rules as rule_source


def _json_name(text: Column) -> Column:
    """The top-level name of a JSON object, not one of an author's or a script's."""
    return F.get_json_object(text, "$.name")


def _toml_name(*sections: str) -> Callable[[Column], Column]:
    """The name in the first of some TOML sections that has one; a section ends where the next begins."""

    def name(text: Column) -> Column:
        bodies = [F.regexp_extract(text, rf"(?m)^[ \t]*\[{re.escape(s)}\][ \t]*(?:#[^\n]*)?\r?$([\s\S]*?)(?=^[ \t]*\[|\z)", 1) for s in sections]
        return F.coalesce(*[F.nullif(F.regexp_extract(b, r"""(?m)^[ \t]*name[ \t]*=[ \t]*["']([^"']+)["']""", 1), F.lit("")) for b in bodies])

    return name


def _without_remarks(text: Column) -> Column:
    return F.regexp_replace(text, r"<!--[\s\S]*?-->", "")


#: Elements of a POM that hold artifacts of others.
_OTHERS = r"<(parent|dependencies|dependencyManagement|build|profiles|reporting|distributionManagement)\b[^>]*>[\s\S]*?</\1\s*>"


def _pom_name(text: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(_without_remarks(text), _OTHERS, ""), r"<artifactId>\s*([^<\s]+)\s*</artifactId>", 1)


def _element(tag: str) -> Callable[[Column], Column]:
    return lambda text: F.regexp_extract(_without_remarks(text), rf"<{tag}>\s*([^<]*?)\s*</{tag}>", 1)


def _nx_name(text: Column) -> Column:
    return F.when(F.get_json_object(text, "$.projectType").isin("library", "application"), _json_name(text))


def _deno_name(text: Column) -> Column:
    """With comments it is no JSON: then the first name at the start of a line or of the object."""
    return F.coalesce(_json_name(text), F.when(F.get_json_object(text, "$").isNull(), F.regexp_extract(text, r'(?m)(?:^|\{)[ \t]*"name"\s*:\s*"([^"]+)"', 1)))


#: Manifests that make a component: pattern on the path, component type, and its name by a function of the text or a regular expression ('' for the directory's).
DETECTORS: list[tuple[str, str, str | Callable[[Column], Column]]] = [
    (r"(^|/)package\.json$", "nodejs", _json_name),
    (r"(^|/)pyproject\.toml$", "python", _toml_name("project", "tool.poetry")),
    (r"(^|/)requirements\.txt$", "python", ""),
    (r"(^|/)setup\.py$", "python", r"\bsetup\s*\([\s\S]*?\bname\s*=\s*['\"]([^'\"]+)['\"]"),
    (r"(^|/)pom\.xml$", "maven", _pom_name),
    (r"(^|/)build\.gradle(\.kts)?$", "gradle", ""),
    (r"\.(cs|vb|fs)proj$", "dotnet", _element("AssemblyName")),
    (r"(^|/)go\.mod$", "golang", r"(?m)^module\s+(\S+)"),
    (r"(^|/)main\.go$", "golang", ""),
    (r"(^|/)Cargo\.toml$", "rust", _toml_name("package")),
    (r"(^|/)composer\.json$", "php", _json_name),
    (r"(^|/)Gemfile$", "ruby", ""),
    (r"(^|/)conanfile\.py$", "cplusplus", r"name\s*=\s*['\"]([^'\"]+)['\"]"),
    (r"\.vcxproj$", "msbuild-cpp", _element("ProjectName")),
    (r"(^|/)Podfile$|\.podspec$", "cocoapods", r"\.name\s*=\s*['\"]([^'\"]+)['\"]"),
    (r"(^|/)pubspec\.yaml$", "dart", r"(?m)^name:\s*(\S+)"),
    (r"(^|/)mix\.exs$", "elixir", r"app:\s*:(\w+)"),
    (r"(^|/)Package\.swift$", "swift", r'name:\s*"([^"]+)"'),
    (r"(^|/)cpanfile$", "perl", ""),
    (r"(^|/)renv\.lock$", "r", ""),
    (r"(^|/)deno\.jsonc?$", "deno", _deno_name),
    (r"\.dproj$", "delphi", r"<MainSource>([^<.]+)"),
    (r"(^|/)project\.json$", "nx", _nx_name),
]


@dataclass
class Scan:
    """The relations of a scan, in long form.  What several rollups read is written once to spark.checkpoint.dir; texts are not."""

    root_id: str
    files: DataFrame
    components: DataFrame
    dependencies: DataFrame
    edges: DataFrame
    reasons: DataFrame
    references: DataFrame
    licenses: DataFrame
    errors: DataFrame


def root_id(root: str, settings: config.Settings) -> str:
    """The explicit id, else one of the git remote and the path below it, else one of the absolute path."""
    import hashlib

    if settings.root_id:
        return settings.root_id
    remote = config.git_info(root).get("remote_url", "")
    text = remote.lower().removesuffix(".git") if remote else os.path.abspath(root)
    return hashlib.sha256(text.encode()).hexdigest()[:20]


def detect(files: DataFrame, root: str) -> DataFrame:
    """(component_id, name, type, path, dir, walk_order) of the manifests among files (path, dir, text)."""
    text = F.coalesce("text", F.lit(""))
    own = lambda n: F.coalesce(n(text) if callable(n) else F.regexp_extract(text, n, 1) if n else F.lit(""), F.lit(""))
    cases = [F.when(F.col("path").rlike(p), F.struct(F.lit(kind).alias("type"), F.lit(k).alias("rank"), own(n).alias("own"), F.lit(bool(n) and kind == "nx").alias("named"))) for k, (p, kind, n) in enumerate(DETECTORS)]
    found = files.where(F.col("path").rlike("|".join(f"(?:{p})" for p, _, _ in DETECTORS))).withColumn("x", F.coalesce(*cases))
    found = found.where("NOT (x.named AND x.own = '')").select("path", "dir", "x.type", "x.rank", "x.own")
    # One component per directory and type: the manifest that the detectors list first.
    best = found.groupBy("dir", "type").agg(F.min(F.struct("rank", "path", "own")).alias("m")).select("dir", "type", F.col("m.path").alias("path"), F.col("m.rank").alias("walk_order"), F.col("m.own").alias("own"))
    folder = F.when(F.col("dir") == "/", F.lit("main")).otherwise(F.regexp_replace("dir", "^.*/", ""))
    name = F.when(F.col("own") != "", F.col("own")).otherwise(folder)
    return best.select(C.component_id(F.lit(root), name, F.col("path")).alias("component_id"), name.alias("name"), "type", "path", "dir", "walk_order")


#: Names of files that give versions to the directories below them.
SHARED_FILES = ("gradle.properties", "Directory.Packages.props", "package-lock.json", "pnpm-lock.yaml", "yarn.lock")


def filled_versions(deps: DataFrame, parsed: DataFrame) -> DataFrame:
    """deps (type, name, version, source, ...) with versions that stand in files of directories above: gradle.properties for
    references in Gradle versions, the nearest Directory.Packages.props for NuGet packages without a version."""
    up = F.regexp_replace("source", "/[^/]*$", "")
    folder = F.when(up == "", F.lit("/")).otherwise(up)
    pair = r"^\s*([\w.]+)\s*[=:]\s*(.*?)\s*$"
    lines = parsed.where("name = 'gradle.properties'").select(F.col("dir").alias("v_dir"), F.posexplode(F.split("text", r"\r?\n")).alias("k", "line")).where(F.col("line").rlike(pair))
    values = lines.groupBy("v_dir", F.regexp_extract("line", pair, 1).alias("key")).agg(F.max(F.struct("k", F.regexp_extract("line", pair, 2).alias("value")))["value"].alias("value"))
    builds = parsed.where(F.col("name").rlike(r"^build\.gradle(\.kts)?$")).select("dir").distinct()
    deps = L.with_properties(deps.withColumn("dir", F.when(F.col("type").startswith("gradle"), folder)), builds, values)
    items = parsed.where("name = 'Directory.Packages.props'").select(F.col("dir").alias("l_dir"), F.explode(F.regexp_extract_all("text", F.lit(r"<PackageVersion\s[^>]*>"), F.lit(0))).alias("item"))
    items = items.select("l_dir", F.lower(F.regexp_extract("item", r'\sInclude\s*=\s*"([^"]+)"', 1)).alias("l_name"), F.regexp_extract("item", r'\sVersion\s*=\s*"([^"]+)"', 1).alias("l_version")).where("l_name <> '' AND l_version <> ''")
    listed = items.groupBy("l_dir", "l_name").agg(F.min("l_version").alias("l_version"))
    projects = parsed.where(F.col("name").rlike(r"\.(cs|vb|fs)proj$")).select("dir").distinct()
    open_ = (F.col("type") == "nuget") & (F.col("version") == "latest")
    deps = L.nearest_versions(deps.withColumn("dir", F.when(open_, folder)), projects, listed, F.lower("name"))
    return deps.withColumn("version", F.coalesce("near", "version")).drop("near", "dir")


def scan(spark: SparkSession, root: str, settings: config.Settings = config.Settings(), rules: rule_source.Rules | None = None, report: Callable | None = None) -> Scan:
    """Scan a tree; `report` is called with each event (plans/progress.py) and what is known of it."""
    rules = rules or rule_source.Rules(only=settings.only_rules)
    report = report or (lambda event, **about: None)
    report("scan_start", root=root)
    read = S.read(spark, root, settings.exclude, settings.include, settings.reclassify)
    later = F.col("path").rlike("|".join((manifests.ANY_MANIFEST, lockgraphs.ANY_LOCK, *(f"(?:{p})" for p, _, _ in DETECTORS)))) | F.col("name").rlike(licenses.NAMES) | F.col("name").rlike(r"\.nuspec$|^\.env\.example$|^gradle\.properties$|^Directory\.Packages\.props$")
    hits = R.content_hits(rules.content) if rules.content else F.array().cast("array<struct<tech:string,rule_order:int>>")
    # One pass over the contents: what is counted and matched stays, and the few texts that are parsed below.
    read = S.code_lines(read).withColumn("hits", hits).withColumn("text", F.when(later, F.col("text")))
    read = G.stored(read.hint("rebalance"))  # as many parts as the rows need, not as the files did
    parsed = read.where("text IS NOT NULL")
    rid = root_id(root, settings)
    own, extracted = side_by_side(lambda: G.stored(detect(parsed, rid)), lambda: G.stored(manifests.extract(parsed)))
    # The last detector's component of a directory owns the files below it.
    owners = own.groupBy("dir").agg(F.max(F.struct("walk_order", "component_id"))["component_id"].alias("owner"))
    report("components", found=own, files=read)
    main = spark.createDataFrame([(rid, "main", "", "/", "/", -1)], own.schema)
    components = own.unionByName(main)
    root_owner = owners.unionByName(spark.createDataFrame([("/", rid)], "dir string, owner string").join(owners.where("dir = '/'"), "dir", "left_anti"))
    owned = G.stored(G.nearest_ancestor(read.drop("text"), root_owner))

    place = owned.select(F.col("path").alias("o_path"), "owner", F.col("walk_order").alias("o_walk"))
    turn = lambda k: F.concat("o_walk", F.lit("\x01"), F.lpad(F.col(k).cast("string"), 10, "0"))
    deps = extracted.where("error IS NULL").join(place, F.col("path") == F.col("o_path")).select(
        F.col("owner").alias("component_id"), "type", "name", "version", "scope", "direct", F.col("path").alias("source"), F.lit("").alias("license"), turn("ord").alias("walk_order"))
    # Files that speak for directories below them, by name: trees without any need none of the joins.
    shared = {r["name"] for r in parsed.where(F.col("name").isin(*SHARED_FILES)).select("name").distinct().collect()}
    deps = filled_versions(deps, parsed) if shared & set(SHARED_FILES[:2]) else deps
    graph = lockgraphs.edges_and_errors(parsed, settings.graph)
    edges = graph.where("error IS NULL").join(place, F.col("path") == F.col("o_path")).select(F.col("owner").alias("component_id"), "component_type", "from", "to", F.col("path").alias("source"), "scope", turn("walk_order").alias("walk_order"))

    named = deps.groupBy("component_id", "type", "name").agg(F.min("walk_order").alias("walk_order"))
    by_dep = R.match_dependencies(named, rules.exact_table(spark), rules.regexes).select("component_id", "tech", "reason", "walk_order")
    base = owned.select("path", "dir", "name", "ext")
    found = [R.match_names(base, rules.names_table(spark), rules.globs, rules.directories)]
    if rules.late_names:
        found.append(R.match_late_names(base, rules.late_table(spark), found[0]))
    if rules.content:
        found.append(owned.select("path", F.explode("hits").alias("x")).select("path", "x.tech", F.lit("matched content").alias("reason")))
    if rules.variables:
        lines = parsed.where("name = '.env.example'").select("path", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) NOT LIKE '#%' AND line LIKE '%=%'")
        variables = lines.select("path", F.trim(F.regexp_extract("line", "^([^=]*)=", 1)).alias("var"))
        found.append(R.match_variables(variables, rules.variables).select("path", "tech", F.concat_ws(" ", F.lit("matched env:"), "var").alias("reason")))
    if settings.extension_rules and rules.extensions:
        found.append(R.match_extensions(base, spark.createDataFrame(rules.extensions, "tech string, ext string")).select("path", "tech", F.lit("matched extension").alias("reason")))
    by_file = found[0]
    for more in found[1:]:
        by_file = by_file.unionByName(more)
    by_file = by_file.join(place, F.col("path") == F.col("o_path")).select(F.col("owner").alias("component_id"), "tech", "reason", F.col("o_walk").alias("walk_order"))
    reasons = by_dep.unionByName(by_file).groupBy("component_id", "tech", "reason").agg(F.min("walk_order").alias("walk_order"))
    settled = G.propagate_versions(licenses.harvest(K.settled_dependencies(deps, manifests.shared_versions(parsed) if shared & set(SHARED_FILES[2:]) else None), licenses.from_package_json(parsed).unionByName(licenses.from_nuspec(parsed))))
    reasons, settled = side_by_side(lambda: G.stored(reasons), lambda: G.stored(settled))

    techs = reasons.groupBy("component_id").agg(F.array_sort(F.collect_set("tech")).alias("tech"))
    code = owned.groupBy(F.col("owner").alias("component_id")).agg(F.sum("code").alias("code"), F.count("*").alias("files"))
    full = components.join(techs, "component_id", "left").join(code, "component_id", "left").select(*components.columns, F.coalesce("tech", F.array().cast("array<string>")).alias("tech"), F.coalesce("code", F.lit(0)).alias("code"), F.coalesce("files", F.lit(0)).alias("files"))
    full = G.stored(K.with_parents(full, rid))
    licensed = licenses.detect_files(parsed).join(place.select("o_path", "owner"), F.col("path") == F.col("o_path")).select(F.col("owner").alias("component_id"), "path", "license", "detection_type", "confidence", "category")
    report("scan_complete", root_id=rid)
    return Scan(rid, owned.drop("hits").withColumnRenamed("owner", "component_id"), full, settled, edges, reasons, K.references(settled, full), licensed, extracted.where("error IS NOT NULL").select("path", "error").unionByName(graph.where("error IS NOT NULL").select("path", "error")).distinct())


def aggregate(spark: SparkSession, s: Scan, settings: config.Settings = config.Settings(), ecosystems: Sequence[dict] = rule_source.ECOSYSTEMS) -> dict[str, DataFrame]:
    """The rollups of a scan by name; each is lazy, so only those that are asked for run."""
    programming = s.files.where("language_type = 'programming'").groupBy("language").agg(F.sum("lines").alias("lines"))
    primary = A.primary_languages(programming, settings.primary_languages, settings.primary_threshold)
    stats = s.files.select(F.coalesce("language", F.lit("unknown")).alias("language"), "component_id", "lines", "code", "comments", "blanks", "complexity")
    techs = A.distinct_values(s.components, "tech").withColumnRenamed("value", "tech")
    out = {
        "techs": techs,
        "reasons": A.reasons_by_tech(s.reasons),
        "languages": s.files.where("language IS NOT NULL").groupBy("language").agg(F.count("*").alias("files")),
        "licenses": s.licenses.select("license", "category").distinct(),
        "dependencies": A.merged_dependencies(s.dependencies).orderBy("type", "name", "version"),
        "dependency_edges": A.merged_edges(s.edges).orderBy("from", "to"),
        "components": s.components.where(F.col("component_id") != s.root_id),
        "code_stats": A.metrics(A.code_stats(stats, "component_id")),
        "by_type": s.files.where("language_type <> 'unknown'").groupBy("language_type").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("code").alias("code")),
        "primary_languages": primary,
        "primary_techs": A.primary_techs(s.components, techs, primary),
        "ecosystems": A.ecosystems(s.components, s.files.select("language"), *rule_source.ecosystem_tables(spark, ecosystems)).orderBy(F.desc("components"), "ecosystem"),
    }
    if settings.subsystem_depth or settings.subsystem_groups:
        by_depth = C.depth_prefix(F.col("path"), settings.subsystem_depth) if settings.subsystem_depth else F.lit("")
        named = s.components.withColumn("subsystem", by_depth)
        if settings.subsystem_groups:
            groups = spark.createDataFrame([("/" + g.strip("/"), "/" + g.strip("/")) for g in settings.subsystem_groups], "dir string, owner string")
            named = G.nearest_ancestor(s.components, groups).withColumn("subsystem", F.coalesce("owner", by_depth)).drop("owner", "owner_dir")
        out["subsystems"] = A.subsystem_rollup(named.where("subsystem <> ''"))
    return {k: v for k, v in out.items() if not settings.aggregate or k in settings.aggregate}
