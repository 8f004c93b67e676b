"""Version predicates, sort keys and currency buckets as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, characters and prefixes that mark a version as not pinned.
TAG_WORDS = ("latest", "git", "workspace", "local", "tarball", "RELEASE", "LATEST")
RANGE_CHARACTERS = r"[\^~><=*|$ {}\[\](),]"
URL_PREFIXES = ("git:", "path:", "file:", "link:", "http://", "https://")


def resolved(version: Column) -> Column:
    """The trimmed version if it is a concrete pin, else ''."""
    v = F.trim(F.coalesce(version, F.lit("")))
    bad = v.isin(*TAG_WORDS) | v.rlike(RANGE_CHARACTERS) | ~v.rlike("^[vV]?[0-9]")
    for prefix in URL_PREFIXES:
        bad |= v.startswith(prefix)
    return F.when(bad, F.lit("")).otherwise(v)


def numeric_components(version: Column) -> Column:
    """Leading dotted integers without build or pre-release, or null if there is none."""
    head = F.regexp_extract(F.coalesce(version, F.lit("")), r"^[^-+]*", 0)
    lead = F.regexp_extract(head, r"^[+-]?[0-9]+(\.[0-9]+)*(?=\.|$)", 0)
    return F.when(lead != "", F.transform(F.split(lead, r"\."), lambda p: p.try_cast("int")))


def _component(parts: Column, i: int) -> Column:
    return F.coalesce(F.get(parts, F.lit(i)), F.lit(0))


def level(installed: Column, latest: Column) -> Column:
    """major, minor or patch by the first differing numeric component; unknown without any."""
    a, b = numeric_components(installed), numeric_components(latest)
    return (
        F.when(a.isNull() | b.isNull(), F.lit("unknown"))
        .when(_component(a, 0) != _component(b, 0), F.lit("major"))
        .when(_component(a, 1) != _component(b, 1), F.lit("minor"))
        .otherwise(F.lit("patch"))
    )


def _padded(parts: Column, like: Column) -> Column:
    """parts with zeros up to the length of `like`, so arrays compare as versions do."""
    return F.concat(parts, F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.size(like) - F.size(parts))))


def numeric_bucket(installed: Column, latest: Column) -> Column:
    a, b = numeric_components(installed), numeric_components(latest)
    return F.when(a.isNull() | b.isNull(), F.lit("unknown")).when(_padded(a, b) >= _padded(b, a), F.lit("up_to_date")).otherwise(level(installed, latest))


def npm_key(version: Column) -> Column:
    """A struct that orders npm versions, or null if the text is none.

    Parts: major, minor, patch, whether it is a release, and the pre-release identifiers (numeric before alphabetic).
    """
    v = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(version), "^v", ""), "^V", ""), "^=", "")
    v = F.regexp_replace(v, r"\+.*$", "")
    ok = v.rlike(r"^[0-9]+(\.[0-9]+)?(\.[0-9]+)?(-[0-9A-Za-z.-]+)?$")
    core = F.split(F.regexp_extract(v, r"^[0-9.]*", 0), r"\.")
    number = lambda i: F.coalesce(F.get(core, F.lit(i)).try_cast("long"), F.lit(0))
    pre = F.regexp_extract(v, r"^[0-9.]*-(.+)$", 1)
    parts = F.transform(
        F.filter(F.split(pre, r"\."), lambda p: p != ""),
        lambda p: F.struct((~p.rlike("^[0-9]+$")).alias("alpha"), F.coalesce(F.when(p.rlike("^[0-9]+$"), p.try_cast("long")), F.lit(0)).alias("num"), F.when(p.rlike("^[0-9]+$"), F.lit("")).otherwise(p).alias("str")),
    )
    return F.when(ok, F.struct(number(0).alias("major"), number(1).alias("minor"), number(2).alias("patch"), (pre == "").alias("release"), parts.alias("pre")))


def npm_normal(declared: Column) -> Column:
    """What an npm specifier says: a word for sources other than the registry, else the version or range itself."""
    v = F.trim(F.coalesce(declared, F.lit("")))
    plain = F.regexp_replace(v, "^npm:", "")
    return (
        F.when((plain == "") | (plain == "*"), F.lit("latest"))
        .when(v.startswith("workspace:"), F.lit("workspace"))
        .when(v.startswith("file:"), F.lit("local"))
        .when(v.startswith("link:"), F.lit("link"))
        .otherwise(plain)
    )


_PEP440 = r"^[vV]?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(a|b|rc|alpha|beta|c|pre|preview)[-_.]?([0-9]*))?(?:-([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]*))?(?:[-_.]?(dev)[-_.]?([0-9]*))?(?:\+.*)?$"


def pep440_key(version: Column) -> Column:
    """A struct that orders PEP 440 versions as the reference does: longer releases after their prefixes; local parts ignored."""
    v = F.lower(F.trim(version))
    part = lambda k: F.regexp_extract(v, _PEP440, k)
    number = lambda k: F.coalesce(part(k).try_cast("long"), F.lit(0))
    none, top = F.lit(-1).cast("long"), F.lit(2**62)
    pre = F.when(part(3) == "", F.lit(9)).when(part(3).isin("a", "alpha"), F.lit(0)).when(part(3).isin("b", "beta"), F.lit(1)).otherwise(F.lit(2))
    post = F.when(part(5) != "", number(5)).when(part(6) != "", number(7)).otherwise(none)
    dev = F.when(part(8) != "", number(9)).otherwise(top)
    return F.when(
        v.rlike(_PEP440),
        F.struct(number(1).alias("epoch"), F.transform(F.split(part(2), r"\."), lambda p: p.cast("long")).alias("release"), pre.alias("pre"), number(4).alias("pre_n"), post.alias("post"), dev.alias("dev")),
    )


def maven_canon(version: Column) -> Column:
    """The version without release words and -SNAPSHOT; an open range as its lower bound."""
    v = F.trim(F.coalesce(version, F.lit("")))
    v = F.regexp_replace(v, r"(?i)[.-]?(RELEASE|FINAL|GA)$", "")
    v = F.regexp_replace(v, r"(?i)-snapshot$", "")
    return F.when(v.rlike(r"^\[[^,\])]+\]$"), F.regexp_extract(v, r"^\[([^,\])]+)\]$", 1)).when(v.rlike(r"^[\[(][^,]+,"), F.concat(F.lit(">="), F.regexp_extract(v, r"^[\[(]\s*([^,]+?)\s*,", 1))).otherwise(v)


def bucket(system: Column, installed: Column, latest: Column, numeric_maven: bool = False) -> Column:
    """The currency of an installed version: unknown, unpinned, up_to_date, patch, minor or major.

    numeric_maven compares Maven versions by their numbers; the default compares their canonical text.
    """
    a, b = F.trim(F.coalesce(installed, F.lit(""))), F.trim(F.coalesce(latest, F.lit("")))
    plain = numeric_bucket(a, b)

    def by_key(key) -> Column:
        x, y = key(a), key(b)
        return F.when(x.isNull() | y.isNull(), plain).when(x >= y, F.lit("up_to_date")).otherwise(level(a, b))

    maven = plain if numeric_maven else F.when(maven_canon(a) >= maven_canon(b), F.lit("up_to_date")).otherwise(level(a, b))
    return (
        F.when((a == "") | (b == ""), F.lit("unknown"))
        .when(resolved(a) == "", F.lit("unpinned"))
        .when(a == b, F.lit("up_to_date"))
        .when(system == "npm", by_key(npm_key))
        .when(system == "pypi", by_key(pep440_key))
        .when(system == "maven", maven)
        .otherwise(plain)
    )


def managed(version: Column, managed_version: Column) -> Column:
    """The version, or the managed one where the version is not a pin."""
    return F.when(resolved(version) != "", version).otherwise(F.coalesce(managed_version, version))


# Ecosystem to the system that is asked for latest versions.
PACKAGE_SYSTEMS = {"npm": "npm", "maven": "maven", "gradle": "maven", "pypi": "pypi", "nuget": "nuget", "cargo": "cargo", "golang": "go", "gem": "rubygems"}
# Component type to the system that resolves graphs.
GRAPH_SYSTEMS = {"nodejs": "npm", "python": "pypi", "rust": "cargo", "java": "maven", "maven": "maven", "gradle": "maven"}


def lookup(key: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """table[key] as a chain of conditions; null (or default) for other keys."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out if default is None else out.otherwise(default)


def package_system(ecosystem: Column) -> Column:
    return lookup(F.lower(ecosystem), PACKAGE_SYSTEMS)


# The Visual Studio of each platform toolset.
TOOLSETS = {"v100": "VS2010", "v110": "VS2012", "v120": "VS2013", "v140": "VS2015", "v141": "VS2017", "v142": "VS2019", "v143": "VS2022"}


def toolset_version(toolset: Column) -> Column:
    """The Visual Studio of an MSBuild platform toolset, or '' for one that is not known."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in TOOLSETS.items() for x in kv])[toolset], F.lit(""))
