"""Which packages belong to which workspace: globs of workspace manifests met by the directories of packages.

A glob is cut at its first wildcard; what is before it is a directory, and a package meets it by equality with one of its own
ancestors, so no package is tried against globs of elsewhere.  The whole glob is then tried once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ancestors
from .sizing import small_side

#: Directories whose packages belong to no workspace.
IGNORED = ("node_modules",)
_STRINGS = r"""["']([^"'\n]*)["']"""


def _list(x: Column) -> Column:
    return F.coalesce(F.filter(x, lambda g: g.isNotNull() & (F.trim(g) != "")), F.array().cast("array<string>"))


def _json_globs(text: Column) -> Column:
    at = lambda path: F.from_json(F.get_json_object(text, path), "array<string>")
    return F.when(F.get_json_object(text, "$.workspaces").startswith("["), _list(at("$.workspaces"))).otherwise(_list(at("$.workspaces.packages")))


def _toml_globs(text: Column) -> Column:
    """Members of the section [workspace], then what it excludes with all below, as negations."""
    plain = F.regexp_replace(F.concat(F.lit("\n"), text), r"(?m)(?:^|(?<=[\s,\[]))#[^\n]*", "")
    section = F.regexp_extract(plain, r"\n[ \t]*\[workspace\]([\s\S]*?)(?:\n[ \t]*\[[^\]\n\"',]+\][ \t]*\r?(?:\n|\z)|\z)", 1)
    of = lambda key: _list(F.regexp_extract_all(F.regexp_extract(section, rf"(?m)^[ \t]*{key}[ \t]*=[ \t]*\[([^\]]*)\]", 1), F.lit(_STRINGS), F.lit(1)))
    out = of("exclude")
    return F.concat(of("members"), F.transform(out, lambda g: F.concat(F.lit("!"), F.rtrim(g, F.lit("/")), F.lit("/**"))))


def globs(manifests: DataFrame) -> DataFrame:
    """(kind, root, glob) of manifests (dir, name, text): npm by package.json, cargo by Cargo.toml, nx by nx.json (all below).

    Texts that do not parse, or name no workspace, have none.
    """
    text, name = F.coalesce("text", F.lit("")), F.col("name")
    kind = F.when(name == "package.json", F.lit("npm")).when(name == "Cargo.toml", F.lit("cargo")).when(name == "nx.json", F.lit("nx"))
    found = F.when(name == "package.json", _json_globs(text)).when(name == "Cargo.toml", _toml_globs(text)).when(name == "nx.json", F.array(F.lit("**")))
    return manifests.select(kind.alias("kind"), F.col("dir").alias("root"), F.explode(found).alias("glob")).distinct()


def glob_pattern(glob: Column) -> Column:
    """The regular expression of a path glob: `**` any directories, `*` and `?` within one, classes and {a,b} alternatives."""
    braces = (F.regexp_count(glob, F.lit(r"\{")) == F.regexp_count(glob, F.lit(r"\}"))) & glob.contains("{")
    inner = lambda x: F.regexp_replace(F.regexp_replace(x, r"^\[[!^]", "[^"), r"(?<=.)([\[&\\])", r"\\$1")

    def form(x: Column) -> Column:
        return (
            F.when(x.isin("/**", "**/"), F.when(x == "/**", F.lit("(?:/.*)?")).otherwise(F.lit("(?:.*/)?")))
            .when(x.startswith("**"), F.lit(".*")).when(x == "*", F.lit("[^/]*")).when(x == "?", F.lit("[^/]"))
            .when(braces & x.isin("{", "}", ","), F.when(x == "{", F.lit("(?:")).when(x == "}", F.lit(")")).otherwise(F.lit("|")))
            .when(x.startswith("[") & (F.length(x) > 1), inner(x)).when(x.rlike(r"^[.+^$|()\\{}\[\]]$"), F.concat(F.lit("\\"), x)).otherwise(x)
        )

    tokens = F.regexp_extract_all(glob, F.lit(r"/\*\*$|\*\*/|\*\*+|\[[!^]?[^\]/]+\]|[\s\S]"), F.lit(0))
    return F.concat(F.lit("^"), F.array_join(F.transform(tokens, form), ""), F.lit("$"))


def _below(root: Column, rest: Column) -> Column:
    """A directory below another one, '/'-led, without an end slash."""
    x = F.regexp_replace(F.concat(root, F.lit("/"), rest), "/+", "/")
    return F.when(x == "/", x).otherwise(F.regexp_replace(x, "/$", ""))


def members(packages: DataFrame, patterns: DataFrame) -> DataFrame:
    """(kind, dir, root): each package (kind, dir) of a workspace with the nearest root whose globs (kind, root, glob) name it.

    What a negated glob (`!`) names is out of that workspace, wherever the glob stands; so is what lies in IGNORED directories
    below the root, and the root itself.  Globs that leave the root (`..`) name nothing.  Repeated rows count once, null
    directories and globs not at all.  Roots of the same depth above one directory are the same root, so there are no ties.
    """
    glob = F.regexp_replace(F.regexp_replace(F.regexp_replace("glob", "^!", ""), "^(?:\\./|/)+", ""), "/+$", "")
    g = patterns.where("glob IS NOT NULL AND root IS NOT NULL").select(F.col("kind").alias("g_kind"), F.col("root").alias("g_root"), F.startswith("glob", F.lit("!")).alias("negated"), glob.alias("g")).distinct()
    g = g.select("g_kind", "g_root", "negated", glob_pattern(F.col("g")).alias("pattern"), _below(F.col("g_root"), F.regexp_extract("g", r"^(?:[^*?\[{/]+/)*", 0)).alias("base"))
    found = packages.where("dir IS NOT NULL").select("kind", "dir").distinct().withColumn("up", F.explode(ancestors(F.concat("dir", F.lit("/x")))))
    met = found.join(small_side(g), (F.col("kind") == F.col("g_kind")) & (F.col("up.prefix") == F.col("base")))
    rel = F.substr(F.col("dir"), F.when(F.col("g_root") == "/", F.lit(2)).otherwise(F.length("g_root") + 2))
    ignored = F.exists(F.split(rel, "/"), lambda x: x.isin(*IGNORED))
    hits = met.where((F.col("dir") != F.col("g_root")) & ~ignored & F.rlike(rel, F.col("pattern")))
    kept = hits.groupBy("kind", "dir", "g_root").agg(F.bool_or("negated").alias("out")).where("NOT out")
    return kept.groupBy("kind", "dir").agg(F.max_by("g_root", F.length("g_root")).alias("root"))
