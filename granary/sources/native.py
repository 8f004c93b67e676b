"""Manifest formats that are plain JSON objects or lines, read by DataFrame functions alone.

Each takes files (path, text) of one format and gives the columns of `manifests.extract` that matter: path, type, name,
version, scope, direct.  Rows stay in the JVM, in whole-stage code; for corpora of one format this is the way to read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.versions import npm_normal
from .manifests import _NPM_SCOPES

_MAP = "map<string,string>"


def _section(text: str, key: str) -> Column:
    return F.from_json(F.get_json_object(F.col(text), f"$['{key}']"), _MAP)


def _sections(files: DataFrame, sections: tuple[tuple[str, str], ...]) -> DataFrame:
    """(path, scope, name, version) of the maps under some keys of a JSON object."""
    parts = F.array(*[F.struct(F.lit(scope).alias("scope"), _section("text", key).alias("deps")) for key, scope in sections])
    return files.select("path", F.explode(parts).alias("s")).where("s.deps IS NOT NULL").select("path", "s.scope", F.explode("s.deps").alias("name", "version"))


def _rows(df: DataFrame, type_: str, version: Column, direct: Column | None = None) -> DataFrame:
    return df.select("path", F.lit(type_).alias("type"), "name", version.alias("version"), "scope", (F.lit(True) if direct is None else direct).alias("direct"))


def package_json(files: DataFrame) -> DataFrame:
    return _rows(_sections(files, _NPM_SCOPES), "npm", npm_normal(F.col("version")))


def composer_json(files: DataFrame) -> DataFrame:
    found = _sections(files, (("require", "prod"), ("require-dev", "dev")))
    platform = F.col("name").rlike(r"^(php(-64bit|-ipv6|-zts|-debug)?|hhvm|(ext|lib)-.+|composer(-plugin-api|-runtime-api)?)$")
    return _rows(found.where(~platform), "composer", F.col("version"))


def package_lock(files: DataFrame) -> DataFrame:
    """Direct dependencies of version 2 and 3 lockfiles with their locked versions."""
    entry = "struct<version:string,dev:boolean,optional:boolean,peer:boolean,inBundle:boolean,dependencies:map<string,string>,devDependencies:map<string,string>,peerDependencies:map<string,string>,optionalDependencies:map<string,string>>"
    packages = F.from_json(F.get_json_object("text", "$.packages"), f"map<string,{entry}>")
    lock = files.select("path", packages.alias("p")).where("p IS NOT NULL").select("path", "p", F.try_element_at("p", F.lit("")).alias("root"))
    keys = {key: F.coalesce(F.map_keys(F.col(f"root.{key}")), F.array().cast("array<string>")) for key, _ in _NPM_SCOPES}
    one = lock.select("path", F.explode("p").alias("at", "e"), *[k.alias(name) for name, k in keys.items()])
    one = one.where("at RLIKE '^node_modules/' AND e.version IS NOT NULL").withColumn("name", F.regexp_replace("at", "^.*node_modules/", ""))
    nested = F.regexp_count("at", F.lit("node_modules/")) > 1
    has = {key: F.array_contains(F.col(key), F.col("name")) for key, _ in _NPM_SCOPES}
    any_root = F.size(F.concat(*[F.col(k) for k in keys])) > 0
    own = has["dependencies"] | has["devDependencies"] | has["peerDependencies"] | has["optionalDependencies"]
    flag = lambda f: F.coalesce(F.col(f"e.{f}"), F.lit(False))
    scope = F.when(has["peerDependencies"] | flag("peer"), "peer").when(has["optionalDependencies"] | flag("optional"), "optional").when(has["devDependencies"] | flag("dev"), "dev").otherwise("prod")
    kept = one.where(~nested & ~flag("inBundle") & (own | ~any_root)).withColumn("scope", scope)
    return _rows(kept, "npm", F.col("e.version"))


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("k", "line"))


def requirements_txt(files: DataFrame) -> DataFrame:
    line = F.trim(F.regexp_replace(F.regexp_replace(F.trim("line"), r" --.*$", ""), r"\s+#.*$", ""))
    rows = _lines(files).select("path", line.alias("line")).where("line <> '' AND NOT line RLIKE '^(#|-|https?://)'")
    pattern = r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(\([^)]*\)|[^;]*)"
    name = F.lower(F.regexp_replace(F.regexp_extract("line", pattern, 1), "[-_.]+", "-"))
    clauses = F.regexp_replace(F.trim(F.regexp_extract("line", pattern, 2)), r"^\(|\)$", "")
    pin = F.regexp_extract(clauses, r"^(?:===|==|~=)\s*([^,\s*^~><=!|]+)$", 1)
    version = F.when(clauses == "", F.lit("latest")).when(pin != "", pin).otherwise(F.regexp_replace(clauses, r"\s+", ""))
    return _rows(rows.where(F.col("line").rlike(pattern)).select("path", F.lit("prod").alias("scope"), name.alias("name"), version.alias("v")), "pypi", F.col("v"))


def go_mod(files: DataFrame) -> DataFrame:
    """Lines of require blocks and single requirements, indirect ones left out."""
    block = F.array_join(F.regexp_extract_all("text", F.lit(r"(?s)(?:^|\n)\s*require\s*\((.*?)\n\s*\)"), F.lit(1)), "\n")
    single = F.array_join(F.regexp_extract_all("text", F.lit(r"(?m)^\s*require\s+([^\s(]+\s+v\S+.*)$"), F.lit(1)), "\n")
    rows = files.select("path", F.explode(F.split(F.concat_ws("\n", block, single), "\n")).alias("line"))
    pattern = r"^\s*(\S+)\s+(v\S+)\s*(?://(.*))?$"
    rows = rows.where(F.col("line").rlike(pattern) & ~F.regexp_extract("line", pattern, 3).contains("indirect"))
    return _rows(rows.select("path", F.lit("prod").alias("scope"), F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("v")), "golang", F.col("v"))


#: Formats with a native form.
NATIVE = {"package.json": package_json, "composer.json": composer_json, "package-lock.json": package_lock, "requirements.txt": requirements_txt, "go.mod": go_mod}
