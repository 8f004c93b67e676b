"""Manifests and lockfiles as dependency rows.

One plain function per file format turns a text into (type, name, version,
scope, direct) rows; `extract` runs them over a files DataFrame in Arrow
batches, each file where it is, without a shuffle.  Formats that are plain JSON
objects or lines also have native forms in `native.py`, for corpora of one kind.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator
from typing import NamedTuple
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame


class Dep(NamedTuple):
    type: str
    name: str
    version: str
    scope: str = "prod"
    direct: bool = True


def _object(text: str) -> dict:
    found = json.loads(text)
    return found if isinstance(found, dict) else {}


def _yaml(text: str) -> dict:
    import yaml

    found = yaml.safe_load(text)
    return found if isinstance(found, dict) else {}


def _section(doc: dict, key: str) -> dict:
    found = doc.get(key)
    return found if isinstance(found, dict) else {}


# --- npm ---------------------------------------------------------------------

_NPM_SCOPES = (("dependencies", "prod"), ("devDependencies", "dev"), ("peerDependencies", "peer"), ("optionalDependencies", "optional"))


def npm_version(v: str) -> str:
    """What an npm specifier says: a word for other sources than the registry, else the specifier."""
    v = (v or "").strip().removeprefix("npm:")
    if v in ("", "*"):
        return "latest"
    for prefix, word in (("workspace:", "workspace"), ("file:", "local"), ("link:", "link")):
        if v.startswith(prefix):
            return word
    return v


def package_json(text: str) -> Iterator[Dep]:
    doc = _object(text)
    for key, scope in _NPM_SCOPES:
        for name, version in _section(doc, key).items():
            yield Dep("npm", name, npm_version(str(version)), scope)


def _node_name(path: str) -> str:
    return path.rpartition("node_modules/")[2] if "node_modules/" in path else ""


def package_lock(text: str, manifest: str = "", transitive: bool = False) -> Iterator[Dep]:
    """Versions of the direct dependencies (all, if transitive); bundled and nested packages only if transitive."""
    doc = _object(text)
    packages = _section(doc, "packages")
    root = packages.get("") or (_object(manifest) if manifest else {})
    scopes: dict[str, set[str]] = {}
    for key, scope in _NPM_SCOPES:
        for name in _section(root, key):
            scopes.setdefault(name, set()).add(scope)
    entries = [(_node_name(p), p.count("node_modules/") > 1, e) for p, e in packages.items() if p] or [(n, False, e) for n, e in _section(doc, "dependencies").items()]
    for name, nested, entry in entries:
        own = scopes.get(name, set())
        if not name or not entry.get("version") or ((nested or entry.get("inBundle") or entry.get("bundled")) and not transitive) or (scopes and not own and not transitive):
            continue
        scope = "peer" if "peer" in own or entry.get("peer") else "optional" if "optional" in own or entry.get("optional") else "dev" if "dev" in own or entry.get("dev") else "prod"
        yield Dep("npm", name, entry["version"], scope, bool(own) or not scopes)


def pnpm_lock(text: str) -> Iterator[Dep]:
    doc = _yaml(text)
    root = _section(_section(doc, "importers"), ".") or doc
    for key, scope in _NPM_SCOPES:
        for name, entry in _section(root, key).items():
            version = entry.get("version", "") if isinstance(entry, dict) else entry
            yield Dep("npm", name, str(version).partition("(")[0].partition("_")[0], scope)


def yarn_entries(text: str) -> list[tuple[list[str], str, dict[str, str]]]:
    """(specifiers, version, dependencies) of each entry, of either yarn format."""
    out = []
    for block in re.split(r"\n(?=\S)", text):
        head, _, body = block.partition("\n")
        version = re.search(r"^\s{2}version:?\s+\"?([^\"\s]+)\"?", body, re.M)
        if not version or not head.endswith(":") or head.startswith("__metadata"):
            continue
        keys = [k.strip().strip('"').replace("@npm:", "@") for k in head[:-1].strip('"').split(",")]
        deps, inside = {}, False
        for line in body.split("\n"):
            if re.match(r"\s{2}(dependencies|optionalDependencies):", line):
                inside = True
            elif inside and (m := re.match(r'\s{4}"?((?:@[^/"\s]+/)?[^"\s:]+)"?:?\s+"?([^"]+)"?', line)):
                deps[m[1]] = m[2].strip().removeprefix("npm:")
            elif not line.startswith("    "):
                inside = False
        out.append((keys, version[1], deps))
    return out


def yarn_lock(text: str, manifest: str = "") -> Iterator[Dep]:
    wanted = {name: scope for key, scope in reversed(_NPM_SCOPES) for name in (_section(_object(manifest), key) if manifest else {})}
    for keys, version, _ in yarn_entries(text):
        name = keys[0].rpartition("@")[0]
        if not wanted or name in wanted:
            yield Dep("npm", name, version, wanted.get(name, "prod"), name in wanted)


#: Lockfiles that hold the versions of a whole npm workspace.
SHARED_LOCKS = r"(^|/)(package-lock\.json|pnpm-lock\.yaml|yarn\.lock)$"


def shared_lock(path: str, text: str) -> Iterator[tuple[str, str, str]]:
    """(directory, name, version) that a lockfile gives to the members of its workspace; pnpm keeps a list for each member."""
    top = path.rpartition("/")[0]
    if path.endswith("package-lock.json"):
        for place, entry in _section(_object(text), "packages").items():
            if place.startswith("node_modules/") and place.count("node_modules/") == 1 and entry.get("version"):
                yield top or "/", _node_name(place), entry["version"]
    elif path.endswith("pnpm-lock.yaml"):
        for member, entry in _section(_yaml(text), "importers").items():
            for key, _ in _NPM_SCOPES:
                for name, found in _section(entry, key).items():
                    version = found.get("version", "") if isinstance(found, dict) else found
                    yield (top if member == "." else f"{top}/{member}") or "/", name, str(version).partition("(")[0].partition("_")[0]
    else:
        for keys, version, _ in yarn_entries(text):
            yield top or "/", keys[0].rpartition("@")[0], version


def deno_lock(text: str) -> Iterator[Dep]:
    for url, digest in _section(_object(text), "remote").items():
        yield Dep("deno", url, digest)


# --- python ------------------------------------------------------------------


def pep503(name: str) -> str:
    return re.sub(r"[-_.]+", "-", re.sub(r"[^A-Za-z0-9._-]", "", name)).lower()


def pin(constraint: str) -> str:
    """The version of a single exact clause, `latest` without any clause, else the clauses."""
    c = constraint.strip()
    if not c:
        return "latest"
    m = re.fullmatch(r"(?:===|==|~=)\s*([^,\s*^~><=!|]+)", c)
    return m[1] if m else re.sub(r"\s+", "", c)


def requirement(line: str, scope: str = "prod") -> Dep | None:
    m = re.match(r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(\([^)]*\)|[^;]*)", line)
    return Dep("pypi", pep503(m[1]), pin(m[2].strip().strip("()")), scope) if m else None


def requirements_txt(text: str) -> Iterator[Dep]:
    for line in text.split("\n"):
        line = line.strip()
        if " --" in line:
            line = line.partition(" --")[0].strip()
        if not line or line.startswith(("#", "-", "http://", "https://")):
            continue
        if found := requirement(re.sub(r"\s+#.*$", "", line)):
            yield found


def pyproject_toml(text: str) -> Iterator[Dep]:
    doc = tomllib.loads(text)
    project = _section(doc, "project")
    for line in project.get("dependencies", []):
        if found := requirement(line):
            yield found
    for group, lines in _section(project, "optional-dependencies").items():
        for line in lines:
            if found := requirement(line, "dev" if group in ("dev", "test", "tests") else "optional"):
                yield found
    for lines in _section(doc, "dependency-groups").values():
        for line in lines:
            if isinstance(line, str) and (found := requirement(line, "dev")):
                yield found
    poetry = _section(_section(doc, "tool"), "poetry")
    sections = [(_section(poetry, "dependencies"), "prod"), (_section(poetry, "dev-dependencies"), "dev")]
    sections += [(_section(g, "dependencies"), "dev") for g in _section(poetry, "group").values()]
    for deps, scope in sections:
        for name, entry in deps.items():
            if name.lower() != "python":
                version = entry.get("version", "latest") if isinstance(entry, dict) else entry
                yield Dep("pypi", pep503(name), "latest" if version == "*" else str(version), scope)


def _names_of(manifest: str) -> dict[str, str]:
    return {d.name: d.scope for d in pyproject_toml(manifest)} if manifest else {}


def poetry_lock(text: str, manifest: str = "") -> Iterator[Dep]:
    wanted = _names_of(manifest)
    for p in tomllib.loads(text).get("package", []):
        name = pep503(p["name"])
        if not wanted or name in wanted:
            yield Dep("pypi", name, p["version"], wanted.get(name, "dev" if p.get("category") == "dev" else "prod"), name in wanted or not wanted)


def uv_lock(text: str) -> Iterator[Dep]:
    packages = tomllib.loads(text).get("package", [])
    versions = {p["name"]: p.get("version", "") for p in packages}
    for p in packages:
        if "editable" in p.get("source", {}) or "virtual" in p.get("source", {}):
            for d in p.get("dependencies", []):
                yield Dep("pypi", pep503(d["name"]), versions.get(d["name"], ""), "")


# --- rust, go, php -----------------------------------------------------------


def cargo_toml(text: str) -> Iterator[Dep]:
    doc = tomllib.loads(text)
    sections = [_section(doc, k) for k in ("dependencies", "dev-dependencies", "build-dependencies")] + [_section(_section(doc, "workspace"), "dependencies")]
    for section in sections:
        for name, entry in section.items():
            version = entry
            if isinstance(entry, dict):
                ref = entry.get("branch") or entry.get("tag") or entry.get("rev")
                version = ":".join(["path", entry["path"], *([entry["version"]] if "version" in entry else [])]) if "path" in entry else (f"git:{entry['git']}#{ref}" if ref else "latest") if "git" in entry else entry.get("version", "")
            if version:
                yield Dep("cargo", name, str(version))


def cargo_packages(text: str) -> list[dict]:
    return tomllib.loads(text).get("package", [])


def cargo_lock(text: str) -> Iterator[Dep]:
    """The registry packages that the packages without a source (the members) ask for."""
    packages = cargo_packages(text)
    wanted = {d.split(" ")[0] for p in packages if "source" not in p for d in p.get("dependencies", [])}
    for p in packages:
        if "source" in p and (p["name"] in wanted or not wanted):
            yield Dep("cargo", p["name"], p["version"])


def go_mod(text: str) -> Iterator[Dep]:
    inside = False
    for line in text.split("\n"):
        code, _, comment = line.partition("//")
        code = code.strip()
        if re.match(r"require\s*\($", code):
            inside = True
        elif code == ")":
            inside = False
        elif (m := re.match(r"(?:require\s+)?(\S+)\s+(v\S+)$", code)) and (inside or code.startswith("require ")) and "indirect" not in comment:
            yield Dep("golang", m[1].strip('"'), m[2])


def is_platform(name: str) -> bool:
    """What composer asks of the machine rather than of a package."""
    return bool(re.fullmatch(r"php(-64bit|-ipv6|-zts|-debug)?|hhvm|(ext|lib)-.+|composer(-plugin-api|-runtime-api)?", name))


def composer_json(text: str) -> Iterator[Dep]:
    doc = _object(text)
    for key, scope in (("require", "prod"), ("require-dev", "dev")):
        for name, version in _section(doc, key).items():
            if not is_platform(name):
                yield Dep("composer", name, str(version), scope)


# --- ruby, apple, dart, elixir, swift, perl, r, delphi -------------------------


def gemfile(text: str) -> Iterator[Dep]:
    groups: list[list[str]] = []
    for line in map(str.strip, text.split("\n")):
        if m := re.match(r"group\s+(.+?)\s+do\b", line):
            groups.append(re.findall(r":?(\w+)", m[1]))
        elif re.search(r"\bdo\b(\s*\|[^|]*\|)?$", line):
            groups.append([])
        elif line == "end" and groups:
            groups.pop()
        elif m := re.match(r"gem\s+['\"]([^'\"]+)['\"](?:\s*,\s*['\"]([^'\"]+)['\"])?", line):
            dev = any(g in ("test", "development") for names in groups for g in names)
            yield Dep("gem", m[1], m[2] or "latest", "dev" if dev else "prod")


def gem_sections(text: str) -> tuple[list[tuple[str, str, list[str]]], set[str]]:
    """(name, version, needs) of each spec, and the names under DEPENDENCIES."""
    specs: list[tuple[str, str, list[str]]] = []
    direct, section = set(), ""
    for line in text.split("\n"):
        if re.match(r"\S", line):
            section = line.strip()
        elif section == "DEPENDENCIES" and line.strip():
            direct.add(line.split()[0].rstrip("!"))
        elif section in ("GEM", "GIT", "PATH"):
            if m := re.match(r"\s{4}(\S+)\s+\(([^)]+)\)", line):
                specs.append((m[1], m[2], []))
            elif specs and (m := re.match(r"\s{6}(\S+)", line)):
                specs[-1][2].append(m[1])
    return specs, direct


def gemfile_lock(text: str, transitive: bool = False) -> Iterator[Dep]:
    specs, direct = gem_sections(text)
    for name, version, _ in specs:
        if transitive or name in direct:
            yield Dep("gem", name, version, "prod", name in direct)


def _pods(text: str, pattern: str) -> Iterator[Dep]:
    for line in map(str.strip, text.split("\n")):
        if not line.startswith("#") and (m := re.search(pattern + r"\s*['\"]([^'\"]+)['\"](?:\s*,\s*['\"]([^'\"]+)['\"])?", line)):
            yield Dep("cocoapods", m[1], m[2] or "latest", "", False)


def podfile(text: str) -> Iterator[Dep]:
    return _pods(text, r"\bpod")


def podspec(text: str) -> Iterator[Dep]:
    return _pods(text, r"\.dependency")


def podfile_lock(text: str) -> Iterator[Dep]:
    pods = text.partition("PODS:")[2]
    for m in re.finditer(r"^ {2}- \"?([^:\s(\"]+) \(([^)]+)\)", re.split(r"\n(?=[A-Z])", pods)[0], re.M):
        yield Dep("cocoapods", m[1], m[2], "", False)


def pubspec_lock(text: str) -> Iterator[Dep]:
    for name, p in _section(_yaml(text), "packages").items():
        if p.get("version"):
            kind = p.get("dependency", "")
            yield Dep("pub", name, str(p["version"]), "dev" if kind == "direct dev" else "prod", kind in ("direct main", "direct dev"))


def pubspec_yaml(text: str) -> Iterator[Dep]:
    doc = _yaml(text)
    for key, scope in (("dependencies", "prod"), ("dev_dependencies", "dev")):
        for name, v in _section(doc, key).items():
            yield Dep("pub", name, v if isinstance(v, str) and v else "latest", scope)


# Words that stand where a package name could, in a hex lock entry.
MIX_TOOLS = ("hex", "git", "mix", "rebar", "rebar3", "make", "hexpm")


def mix_entries(text: str) -> list[tuple[str, str, list[str]]]:
    """(name, version, needs) of each entry."""
    out = []
    for block in re.split(r"(?m)^(?=\s*\"[^\"]+\":\s*\{)", text):
        if not (head := re.match(r"\s*\"([^\"]+)\":\s*\{", block)):
            continue
        version = re.search(r":hex,\s*:\w+,\s*\"([^\"]+)\"", block)
        needs = [n for n in dict.fromkeys(re.findall(r"\{:(\w+),\s*\"", block)) if n not in MIX_TOOLS]
        out.append((head[1], version[1] if version else "", needs))
    return out


def mix_lock(text: str) -> Iterator[Dep]:
    for name, version, _ in mix_entries(text):
        if version:
            yield Dep("hex", name, version, "", False)


def swift_pins(text: str) -> list[tuple[str, str]]:
    doc = _object(text)
    pins = _section(doc, "object").get("pins", []) if doc.get("version", 0) <= 1 and doc.get("object") else doc.get("pins", [])
    out = []
    for p in pins or []:
        name = p.get("identity") or (p.get("repositoryURL") or p.get("package") or "").removesuffix(".git").rpartition("/")[2].lower()
        state = p.get("state") or {}
        if name and (version := state.get("version") or state.get("branch")):
            out.append((name, version))
    return out


def package_resolved(text: str) -> Iterator[Dep]:
    for name, version in swift_pins(text):
        yield Dep("swift", name, version, "", False)


def cpan_distributions(text: str) -> list[tuple[str, str, list[str], list[str]]]:
    """(name, version, provides, requires) of each distribution of a snapshot."""
    out: list[tuple[str, str, list[str], list[str]]] = []
    part = ""
    for line in text.split("\n"):
        if m := re.match(r"^ {2}([A-Za-z0-9_.+-]+)-(v?[0-9][\w.]*)$", line):
            out.append((m[1], m[2], [], []))
        elif m := re.match(r"^ {4}(\w+):", line):
            part = m[1]
        elif out and (m := re.match(r"^ {6}(\S+)", line)):
            (out[-1][2] if part == "provides" else out[-1][3] if part == "requirements" else []).append(m[1])
    return out


def cpanfile_snapshot(text: str) -> Iterator[Dep]:
    for name, version, _, _ in cpan_distributions(text):
        yield Dep("cpan", name, version, "", False)


def renv_lock(text: str) -> Iterator[Dep]:
    for name, p in _section(_object(text), "Packages").items():
        if p.get("Version"):
            yield Dep("cran", p.get("Package") or name, p["Version"], "", False)


def dproj(text: str) -> Iterator[Dep]:
    for m in re.finditer(r"<DCC_UsePackage>([^<]*)</DCC_UsePackage>", text):
        for name in dict.fromkeys(n.strip() for n in m[1].split(";")):
            if name and "$(" not in name:
                yield Dep("delphi", name, "latest")


# --- java --------------------------------------------------------------------


def _strip(tag: str) -> str:
    return tag.rpartition("}")[2]


def _child(node, name: str):
    return next((c for c in node if _strip(c.tag) == name), None) if node is not None else None


def _text(node, name: str) -> str:
    found = _child(node, name)
    return (found.text or "").strip() if found is not None else ""


def substitute(value: str, properties: dict[str, str], pattern: str = r"\$\{([^}]+)\}", fold: Callable[[str], str] = str) -> str:
    """value with references replaced, those inside replacements too; a cycle leaves its reference as it is."""

    def go(v: str, seen: frozenset) -> str:
        def one(m: re.Match) -> str:
            key = fold(m[1])
            return go(properties[key], seen | {key}) if key in properties and key not in seen else m[0]

        return re.sub(pattern, one, v)

    return go(value, frozenset())


def pom(text: str) -> dict:
    """Coordinates, parent, properties, dependencies and managed dependencies of one POM, its own properties applied."""
    root = ElementTree.fromstring(re.sub(r"<!DOCTYPE[^>]*>", "", text).encode())
    parent = _child(root, "parent")
    found = {k: _text(root, k) for k in ("groupId", "artifactId", "version")}
    up = {k: _text(parent, k) for k in ("groupId", "artifactId", "version")}
    properties = {_strip(c.tag): (c.text or "").strip() for c in (_child(root, "properties") if _child(root, "properties") is not None else [])}
    for k in ("groupId", "artifactId", "version"):
        found[k] = found[k] or up[k]
        properties |= {f"project.{k}": found[k], f"pom.{k}": found[k], f"project.parent.{k}": up[k]}

    def rows(node) -> list[dict]:
        out = []
        for d in node if node is not None else []:
            if _strip(d.tag) == "dependency":
                one = {k: substitute(_text(d, k), properties) for k in ("groupId", "artifactId", "version", "scope", "type", "optional")}
                one["exclusions"] = [f"{_text(e, 'groupId')}:{_text(e, 'artifactId')}" for e in (_child(d, "exclusions") if _child(d, "exclusions") is not None else [])]
                out.append(one)
        return out

    active = []
    profiles = [p for p in (_child(root, "profiles") if _child(root, "profiles") is not None else [])]
    for p in profiles:
        if _text(_child(p, "activation"), "activeByDefault") == "true":
            active += rows(_child(p, "dependencies"))
    return found | {"parent": up, "properties": properties, "dependencies": rows(_child(root, "dependencies")) + active, "managed": rows(_child(_child(root, "dependencyManagement"), "dependencies"))}


# Maven scope to scope.
MAVEN_SCOPES = {"test": "dev", "system": "system", "import": "import"}


def pom_xml(text: str) -> Iterator[Dep]:
    doc = pom(text)
    managed = {f"{d['groupId']}:{d['artifactId']}": d["version"] for d in doc["managed"]}
    for d in doc["dependencies"]:
        name = f"{d['groupId']}:{d['artifactId']}"
        yield Dep("maven", name, d["version"] or managed.get(name) or "latest", MAVEN_SCOPES.get(d["scope"], "prod"))
    for d in doc["managed"]:
        if d["scope"] == "import":
            yield Dep("maven", f"{d['groupId']}:{d['artifactId']}", d["version"] or "latest", "import")


def dependency_list(text: str) -> Iterator[Dep]:
    for m in re.finditer(r"^(?:\[INFO\])?\s+([\w.-]+):([\w.-]+):[\w-]+:(?:[\w.-]+:)?([\w.-]+):(\w+)", text, re.M):
        yield Dep("maven", f"{m[1]}:{m[2]}", m[3], {"test": "dev", "system": "system", "import": "import"}.get(m[4], "prod"), False)


def gradle_scope(configuration: str) -> str:
    if configuration.startswith(("test", "androidTest")):
        return "dev"
    return "build" if configuration in ("compileOnly", "annotationProcessor", "kapt") else "prod"


def build_gradle(text: str, properties: dict[str, str] | None = None) -> Iterator[Dep]:
    own = dict(properties or {}) | dict(re.findall(r"(?m)^\s*(?:ext\.|def\s+|val\s+|ext\s*\.\s*)?(\w+)\s*=\s*['\"]([^'\"]+)['\"]\s*$", text))
    fill = lambda v: substitute(v, own, r"\$\{?([A-Za-z_][\w.]*)\}?")
    for m in re.finditer(r"(?m)^\s*(\w+)[\s(]+(platform\s*\(|enforcedPlatform\s*\()?\s*['\"]([\w.$\{\}-]+):([\w.$\{\}-]+)(?::([^'\"@:]+))?[^'\"]*['\"]", text):
        yield Dep("gradle", fill(f"{m[3]}:{m[4]}"), fill(m[5]) if m[5] else "latest", "import" if m[2] else gradle_scope(m[1]))
    for m in re.finditer(r"(?m)^\s*(\w+)[\s(]+group:\s*['\"]([^'\"]+)['\"],\s*name:\s*['\"]([^'\"]+)['\"](?:,\s*version:\s*['\"]([^'\"]+)['\"])?", text):
        yield Dep("gradle", f"{m[2]}:{m[3]}", fill(m[4]) if m[4] else "latest", gradle_scope(m[1]))
    for m in re.finditer(r"(?m)^\s*id[\s(]+['\"]([\w.-]+)['\"]\)?(?:\s+version\s+['\"]([^'\"]+)['\"])?", text):
        yield Dep("gradle.plugin", m[1], m[2] or "latest", "build")


def gradle_lockfile(text: str) -> Iterator[Dep]:
    for m in re.finditer(r"(?m)^([\w.-]+:[\w.-]+):([^=\s]+)=(\S*)$", text):
        uses = [c for c in m[3].split(",") if c]
        yield Dep("gradle", m[1], m[2], "dev" if uses and all(c.startswith("test") for c in uses) else "prod", False)


# --- .net, c++ ---------------------------------------------------------------


def _msbuild(text: str):
    return ElementTree.fromstring(re.sub(r"^﻿", "", text).encode())


def csproj(text: str, central: dict[str, str] | None = None) -> Iterator[Dep]:
    root = _msbuild(text)
    properties = {_strip(p.tag).lower(): (p.text or "").strip() for g in root.iter() if _strip(g.tag) == "PropertyGroup" for p in g}
    managed = {k.lower(): v for k, v in (central or {}).items()}
    for node in root.iter():
        kind, name = _strip(node.tag), node.get("Include") or node.get("Update") or ""
        if kind == "PackageReference" and name:
            version = node.get("Version") or node.get("VersionOverride") or _text(node, "Version") or managed.get(name.lower()) or "latest"
            private = (node.get("PrivateAssets") or _text(node, "PrivateAssets")).lower()
            condition = (node.get("Condition") or "").lower()
            scope = "build" if private == "all" else "dev" if "debug" in condition or "test" in condition else "prod"
            yield Dep("nuget", name, substitute(version, properties, r"\$\(([^)]+)\)", str.lower), scope)
        elif kind == "Reference" and name:
            yield Dep("dotnet-ref", name.partition(",")[0].strip(), "latest")


def packages_config(text: str) -> Iterator[Dep]:
    for node in _msbuild(text).iter():
        if _strip(node.tag) == "package" and node.get("id"):
            yield Dep("nuget", node.get("id"), node.get("version") or "latest", "dev" if (node.get("developmentDependency") or "").lower() == "true" else "prod")


def central_packages(text: str) -> dict[str, str]:
    return {n.get("Include"): n.get("Version", "") for n in _msbuild(text).iter() if _strip(n.tag) == "PackageVersion" and n.get("Include")}


def vcxproj(text: str) -> Iterator[Dep]:
    for m in re.finditer(r"<AdditionalDependencies>([^<]*)</AdditionalDependencies>", text):
        for name in dict.fromkeys(n.strip() for n in m[1].split(";")):
            if name and not name.startswith(("%(", "$(")):
                yield Dep("native-lib", name, "latest")


def conanfile(text: str) -> Iterator[Dep]:
    for m in re.finditer(r"(requires|tool_requires|build_requires|test_requires)\s*[(=]\s*((?:[\[(]?\s*['\"][^'\"]+['\"]\s*,?\s*[\])]?)+)", text):
        for name, version in re.findall(r"['\"]([\w.+-]+)/([^@#'\"]+)", m[2]):
            yield Dep("conan", name, version, "prod" if m[1] == "requires" else "build")


# --- containers, workflows, infrastructure -----------------------------------


def image_parts(image: str) -> tuple[str, str]:
    """Name and version at the first colon; `latest` without one."""
    name, _, version = image.partition(":")
    return name, version or "latest"


def dockerfile(text: str) -> Iterator[Dep]:
    arguments, stages = {}, set()
    for line in re.sub(r"\\\n", " ", text).split("\n"):
        if m := re.match(r"\s*ARG\s+(\w+)=(\S+)", line, re.I):
            arguments[m[1]] = m[2].strip("\"'")
        elif m := re.match(r"\s*FROM\s+(?:--\S+\s+)?(\S+)(?:\s+AS\s+(\S+))?", line, re.I):
            image = re.sub(r"\$\{?(\w+)(?::-([^}]*))?\}?", lambda x: arguments.get(x[1], x[2] or x[0]), m[1])
            if image.lower() not in stages and image != "scratch" and "$" not in image:
                yield Dep("docker", *image_parts(image))
            if m[2]:
                stages.add(m[2].lower())


def docker_compose(text: str) -> Iterator[Dep]:
    for service in _section(_yaml(text), "services").values():
        image = service.get("image") if isinstance(service, dict) else None
        if image and "$" not in image:
            yield Dep("docker", *image_parts(image))


def workflow(text: str) -> Iterator[Dep]:
    for job in _section(_yaml(text), "jobs").values():
        if not isinstance(job, dict):
            continue
        images = [job.get("container"), *_section(job, "services").values()]
        for image in images:
            image = image.get("image") if isinstance(image, dict) else image
            if image:
                yield Dep("docker", *image_parts(image))
        for uses in [job.get("uses"), *(s.get("uses") for s in job.get("steps") or [] if isinstance(s, dict))]:
            if uses and uses.startswith("docker://"):
                yield Dep("docker", *image_parts(uses.removeprefix("docker://")))
            elif uses and not uses.startswith("./"):
                name, _, ref = uses.partition("@")
                yield Dep("githubAction", name, ref or "latest")


def terraform_lock(text: str) -> Iterator[Dep]:
    for m in re.finditer(r"provider\s+\"([^\"]+)\"\s*\{(.*?)^\}", text, re.S | re.M):
        version = re.search(r"version\s*=\s*\"([^\"]+)\"", m[2])
        yield Dep("terraform", m[1], version[1] if version else "latest")


def terraform(text: str) -> Iterator[Dep]:
    """Resources, their own name as version; files over 500,000 bytes are not read."""
    if len(text.encode()) <= 500_000:
        for m in re.finditer(r"(?m)^\s*resource\s+\"([^\"]+)\"\s+\"([^\"]+)\"", text):
            yield Dep("terraform.resource", m[1], m[2])


def env_variables(text: str) -> list[str]:
    """Names of the variables that a dotenv file sets."""
    return [line.partition("=")[0].strip().removeprefix("export ").strip() for line in map(str.strip, text.split("\n")) if line and not line.startswith("#") and "=" in line]


#: File name (or a pattern, as a regular expression on the path) to component type and parser.
PARSERS: list[tuple[str, str, Callable[[str], Iterator[Dep]]]] = [
    (r"(^|/)package\.json$", "nodejs", package_json),
    (r"(^|/)package-lock\.json$", "nodejs", package_lock),
    (r"(^|/)pnpm-lock\.yaml$", "nodejs", pnpm_lock),
    (r"(^|/)yarn\.lock$", "nodejs", yarn_lock),
    (r"(^|/)deno\.lock$", "deno", deno_lock),
    (r"(^|/)requirements[^/]*\.txt$", "python", requirements_txt),
    (r"(^|/)pyproject\.toml$", "python", pyproject_toml),
    (r"(^|/)poetry\.lock$", "python", poetry_lock),
    (r"(^|/)uv\.lock$", "python", uv_lock),
    (r"(^|/)Cargo\.toml$", "rust", cargo_toml),
    (r"(^|/)Cargo\.lock$", "rust", cargo_lock),
    (r"(^|/)go\.mod$", "golang", go_mod),
    (r"(^|/)composer\.json$", "php", composer_json),
    (r"(^|/)Gemfile$", "ruby", gemfile),
    (r"(^|/)Gemfile\.lock$", "ruby", gemfile_lock),
    (r"(^|/)Podfile$", "cocoapods", podfile),
    (r"(^|/)Podfile\.lock$", "cocoapods", podfile_lock),
    (r"\.podspec$", "cocoapods", podspec),
    (r"(^|/)pubspec\.lock$", "dart", pubspec_lock),
    (r"(^|/)pubspec\.yaml$", "dart", pubspec_yaml),
    (r"(^|/)mix\.lock$", "elixir", mix_lock),
    (r"(^|/)Package\.resolved$", "swift", package_resolved),
    (r"(^|/)cpanfile\.snapshot$", "perl", cpanfile_snapshot),
    (r"(^|/)renv\.lock$", "r", renv_lock),
    (r"\.dproj$", "delphi", dproj),
    (r"(^|/)pom\.xml$", "maven", pom_xml),
    (r"(^|/)dependency-list\.txt$", "maven", dependency_list),
    (r"(^|/)build\.gradle(\.kts)?$", "gradle", build_gradle),
    (r"(^|/)gradle\.lockfile$", "gradle", gradle_lockfile),
    (r"\.(cs|vb|fs)proj$", "dotnet", csproj),
    (r"(^|/)packages\.config$", "dotnet", packages_config),
    (r"\.vcxproj$", "msbuild-cpp", vcxproj),
    (r"(^|/)conanfile\.py$", "cplusplus", conanfile),
    (r"(^|/)Dockerfile[^/]*$", "docker", dockerfile),
    (r"(^|/)(docker-)?compose[^/]*\.ya?ml$", "docker", docker_compose),
    (r"(^|/)\.github/workflows/[^/]+\.ya?ml$", "githubactions", workflow),
    (r"(^|/)\.terraform\.lock\.hcl$", "terraform", terraform_lock),
    (r"\.tf$", "terraform", terraform),
]
#: A path that any of the parsers reads.
ANY_MANIFEST = "|".join(f"(?:{p})" for p, _, _ in PARSERS)
_COMPILED = [(re.compile(p), kind, f) for p, kind, f in PARSERS]
_OUT = "path string, component_type string, type string, name string, version string, scope string, direct boolean, ord int, error string"


def parse(path: str, text: str) -> tuple[str, list[Dep], str]:
    """The component type, the rows and the error ('' if none) of one file."""
    for pattern, kind, f in _COMPILED:
        if pattern.search(path):
            try:
                return kind, list(f(text)), ""
            except Exception as e:  # whatever a broken file makes its parser raise is the file's error, not the scan's
                return kind, [], f"{type(e).__name__}: {e}"[:200]
    return "", [], ""


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            kind, deps, error = parse(path, text or "")
            rows += [(path, kind, *d, k, None) for k, d in enumerate(deps)]
            if error:
                rows.append((path, kind, None, None, None, None, None, None, error))
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(9)]
        kinds = [pa.string()] * 6 + [pa.bool_(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _OUT.split(", ")])


def _shared_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                rows += list(shared_lock(path, text or ""))
            except (ValueError, KeyError, TypeError, AttributeError):
                continue  # extract reports what does not parse
            except Exception as e:  # yaml's own error classes, where yaml is installed
                if not type(e).__module__.startswith("yaml"):
                    raise
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["l_dir", "l_name", "l_version"])


def shared_versions(files: DataFrame) -> DataFrame:
    """(l_dir, l_name, l_version), each name of a directory once: what npm lockfiles among files (path, text) give to workspaces."""
    from pyspark.sql import functions as F

    rows = files.where(F.col("path").rlike(SHARED_LOCKS)).select("path", "text").mapInArrow(_shared_task, "l_dir string, l_name string, l_version string")
    return rows.groupBy("l_dir", "l_name").agg(F.min("l_version").alias("l_version"))


def extract(files: DataFrame) -> DataFrame:
    """Dependency rows of files (path, text); a file that does not parse gives one row with an error."""
    from pyspark.sql import functions as F

    return files.where(F.col("path").rlike(ANY_MANIFEST)).select("path", "text").mapInArrow(_task, _OUT)
