"""Paths, ids, package URLs, scopes and numbers as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .versions import lookup, resolved

# How exposed each scope is.
SCOPE_PRIORITY = {"prod": 100, "import": 90, "system": 80, "peer": 70, "optional": 60, "build": 50, "dev": 40, "test": 30}
OTHER_SCOPE = 10
# Dependency types with a package URL, those an SBOM lists, and component types that are named otherwise.
PURL_TYPES = ("npm", "maven", "pypi", "nuget", "cargo", "golang", "gem", "composer", "pub", "conan", "docker", "golang-direct")
SBOM_TYPES = ("npm", "pypi", "gem", "composer", "cargo", "golang", "maven", "gradle", "nuget", "conan", "cocoapods", "pub", "hex", "swift", "cpan", "cran", "docker")
COMPONENT_DEPENDENCY = {"nodejs": "npm", "python": "pypi", "ruby": "gem", "php": "composer", "rust": "cargo"}
# Languages that may be primary without a build manifest, and their technology.
LANGUAGE_TECH = {"C++": "cplusplus", "C": "c", "Delphi": "delphi", "COBOL": "cobol", "Fortran": "fortran", "Assembly": "assembly"}


def round2(x: Column) -> Column:
    """Two decimals, half away from zero on the binary product (for x >= 0)."""
    return F.floor(x * 100 + 0.5) / 100


def ratio2(a: Column, b: Column) -> Column:
    """round2(a / b), 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(round2(F.try_divide(a.cast("double"), b)))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def relative(path: Column, root: Column) -> Column:
    """'/'-led path under root."""
    cut = F.regexp_replace(F.when(path.startswith(root), F.substring(path, F.length(root) + 1, F.length(path))).otherwise(path), "^/+", "")
    return F.concat(F.lit("/"), cut)


def source_dir(path: Column) -> Column:
    up = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(up == "", F.lit("/")).otherwise(up)


def depth_prefix(path: Column, n: int) -> Column:
    """The first n segments of a '/'-led path, '' if there are fewer."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > n, F.concat(F.lit("/"), F.array_join(F.slice(parts, 2, n), "/"))).otherwise(F.lit(""))


def dir_group(path: Column, n: int = 2) -> Column:
    """The first n directories of a file's path, (root) for files that lie there."""
    dirs = F.filter(F.split(F.regexp_replace(path, "/[^/]*$", ""), "/"), lambda p: p != "")
    return F.when(F.size(dirs) == 0, F.lit("(root)")).otherwise(F.array_join(F.slice(dirs, 1, n), "/"))


def top_dir(path: Column) -> Column:
    return dir_group(path, 1)


def ancestors(path: Column) -> Column:
    """The directories above a '/'-led path, as structs of prefix and depth ('/' has depth 0)."""
    dirs = F.filter(F.split(F.regexp_replace(path, "/[^/]*$", ""), "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(dirs)), lambda i: F.struct(F.concat(F.lit("/"), F.array_join(F.slice(dirs, F.lit(1), i), "/")).alias("prefix"), i.alias("depth")))


def digest(n: int, *parts: Column) -> Column:
    """The first n hex digits of the SHA-256 of the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, n)


def component_id(root: Column, name: Column, path: Column) -> Column:
    return digest(20, root, name, path)


def multi_path_id(base: Column, paths: Column) -> Column:
    """An id that does not depend on the order of the paths."""
    return digest(20, base, F.array_join(F.array_sort(paths), ":"))


def remote_url(url: Column) -> Column:
    """A git remote without credentials, protocol, user, case of letters and .git."""
    v = F.regexp_replace(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    v = F.regexp_replace(F.regexp_replace(v, "^[^@/]*@", ""), r"^([^/:]+):(?![0-9]+/)", "$1/")
    return F.lower(F.regexp_replace(F.regexp_replace(v, "/+$", ""), r"\.git$", ""))


def without_credentials(url: Column) -> Column:
    return F.regexp_replace(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://)[^@/]*@", "$1")


def scope_priority(scope: Column) -> Column:
    out = F.when(F.coalesce(scope, F.lit("")) == "", F.lit(0))
    for name, n in SCOPE_PRIORITY.items():
        out = out.when(scope == name, F.lit(n))
    return out.otherwise(F.lit(OTHER_SCOPE))


def cyclonedx_scope(scope: Column) -> Column:
    return F.when(scope == "prod", F.lit("required")).when(scope == "optional", F.lit("optional")).otherwise(F.lit(""))


def dependency_type(component_type: Column) -> Column:
    return F.coalesce(lookup(component_type, COMPONENT_DEPENDENCY), F.when(component_type.isin(*SBOM_TYPES), component_type), F.lit(""))


def declared(version: Column, declared_version: Column) -> Column:
    """The declared version where it says other than the resolved one."""
    return F.when((F.coalesce(declared_version, F.lit("")) != "") & ~declared_version.eqNullSafe(version), declared_version)


def _escape(text: Column, at: bool) -> Column:
    """Percent-encoding of what package names and versions hold beyond -_.~$&+:=@ and '/'."""
    for raw, code in (("%", "%25"), (" ", "%20"), ('"', "%22"), ("#", "%23"), ("(", "%28"), (")", "%29"), ("*", "%2A"), (",", "%2C"), (";", "%3B"), ("<", "%3C"), (">", "%3E"), ("?", "%3F"), ("[", "%5B"), ("]", "%5D"), ("^", "%5E"), ("{", "%7B"), ("|", "%7C"), ("}", "%7D"), ("!", "%21"), ("'", "%27")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return F.replace(text, F.lit("@"), F.lit("%40")) if at else text


def purl(type_: Column, name: Column, version: Column) -> Column:
    """The package URL of a dependency, '' for types without one; only pinned versions are in it."""
    kind = F.when(type_ == "gradle", F.lit("maven")).when(type_.isin(*PURL_TYPES), type_).otherwise(F.lit(""))
    maven = F.regexp_extract(name, "^([^:]*):(.*)$", 1), F.when(name.contains(":"), F.regexp_replace(name, "^[^:]*:", "")).otherwise(name)
    scoped = name.startswith("@") & name.contains("/")
    npm = F.when(scoped, F.regexp_replace(name, "/.*$", "")).otherwise(F.lit("")), F.when(scoped, F.regexp_replace(name, "^[^/]*/", "")).otherwise(name)
    go = F.when(name.contains("/"), F.regexp_replace(name, "/[^/]*$", "")).otherwise(F.lit("")), F.regexp_replace(name, "^.*/", "")
    space = F.when(kind == "maven", maven[0]).when(kind == "npm", npm[0]).when(kind == "golang", go[0]).otherwise(F.lit(""))
    base = F.when(kind == "maven", maven[1]).when(kind == "npm", npm[1]).when(kind == "golang", go[1]).otherwise(name)
    pin = resolved(version)
    whole = F.concat(F.lit("pkg:"), kind, F.lit("/"), F.when(space != "", F.concat(_escape(space, True), F.lit("/"))).otherwise(F.lit("")), _escape(base, True), F.when(pin != "", F.concat(F.lit("@"), F.replace(_escape(pin, False), F.lit("/"), F.lit("%2F")))).otherwise(F.lit("")))
    return F.when((kind == "") | (F.coalesce(base, F.lit("")) == ""), F.lit("")).otherwise(whole)


def node_parts(node: Column) -> tuple[Column, Column]:
    """Name and version of a name@version node; both '' if there is no version."""
    return F.regexp_extract(node, "^(.+)@([^@]*)$", 1), F.regexp_extract(node, "^(.+)@([^@]*)$", 2)


def pep503(name: Column) -> Column:
    """A Python package name in canonical form."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]", ""), "[-_.]+", "-"))


def glob_regex(glob: str) -> str:
    """A regular expression for a whole path: ** crosses directories, * and ? do not; a/** is also a itself."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if i and glob[i:] == "/**":
            out.append("(?:/.*)?")
            i += 3
        elif glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c))
            i += 1
    return "^" + "".join(out) + "$"


def utf8(content: Column) -> Column:
    """Text of a binary column: UTF-8 or UTF-16 by its byte-order mark, UTF-8 without one."""
    head = F.hex(F.substring(content, 1, 3))
    return (
        F.when(head == "EFBBBF", F.decode(content.substr(F.lit(4), F.length(content)), "UTF-8"))
        .when(head.startswith("FFFE"), F.decode(content.substr(F.lit(3), F.length(content)), "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(content.substr(F.lit(3), F.length(content)), "UTF-16BE"))
        .otherwise(F.decode(content, "UTF-8"))
    )
