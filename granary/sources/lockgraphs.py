"""Lockfiles as edges between packages.

Each function takes a lockfile (and a manifest where direct dependencies are not
in the lockfile) and yields (from, to, scope) edges between name@version nodes;
"." is the root.  mode: "direct" (the root's edges) or "full".
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import manifests as M

Edge = tuple[str, str, str]
_SCOPES = (("dependencies", "prod"), ("devDependencies", "dev"), ("optionalDependencies", "optional"), ("peerDependencies", "peer"))


def _direct(names, versions: dict[str, str], scope: str = "") -> Iterator[Edge]:
    for n in names:
        if versions.get(n):
            yield ".", f"{n}@{versions[n]}", scope


def _unreferenced(nodes: list[tuple[str, str, list[str]]], versions: dict[str, str]) -> Iterator[Edge]:
    """Root edges to the packages that no other names."""
    named = {d for _, _, deps in nodes for d in deps}
    return _direct([n for n, v, _ in nodes if n not in named], versions)


def _between(nodes: list[tuple[str, str, list[str]]], versions: dict[str, str]) -> Iterator[Edge]:
    for name, version, deps in nodes:
        for d in deps:
            if version and versions.get(d):
                yield f"{name}@{version}", f"{d}@{versions[d]}", ""


def npm(text: str, manifest: str = "", mode: str = "full") -> Iterator[Edge]:
    """A dependency is what the nearest enclosing node_modules holds."""
    packages = M._section(M._object(text), "packages")

    def resolve(path: str, name: str) -> str:
        while True:
            entry = packages.get(f"{path}/node_modules/{name}" if path else f"node_modules/{name}", {})
            if entry.get("version"):
                return f"{name}@{entry['version']}"
            if not path:
                return ""
            path = path.rpartition("/node_modules/")[0] if "/node_modules/" in path else ""

    for path, entry in packages.items():
        if (path == "") != (mode == "direct"):
            continue
        node = "." if path == "" else f"{M._node_name(path)}@{entry.get('version', '')}"
        if path and (not entry.get("version") or not M._node_name(path)):
            continue
        for key, scope in _SCOPES:
            if path and key == "devDependencies":
                continue
            for name in entry.get(key) or {}:
                if to := resolve(path, name):
                    yield node, to, scope if mode == "direct" else ""


def pnpm(text: str, manifest: str = "", mode: str = "full") -> Iterator[Edge]:
    doc = M._yaml(text)
    clean = lambda v: str(v).partition("(")[0]
    if mode == "direct":
        root = M._section(M._section(doc, "importers"), ".")
        for key, scope in _SCOPES:
            for name, e in M._section(root, key).items():
                yield ".", f"{name}@{clean(e.get('version') if isinstance(e, dict) else e)}", scope
        return
    for node, entry in M._section(doc, "snapshots").items():
        for key, scope in (("dependencies", ""), ("optionalDependencies", "optional")):
            for name, version in M._section(entry or {}, key).items():
                yield clean(node), f"{name}@{clean(version)}", scope


def yarn(text: str, manifest: str = "", mode: str = "full") -> Iterator[Edge]:
    entries = M.yarn_entries(text)
    by = {k: (k.rpartition("@")[0], v) for keys, v, _ in entries for k in keys}
    if mode == "full":
        for keys, version, deps in entries:
            for name, wanted in deps.items():
                if f"{name}@{wanted}" in by:
                    yield f"{keys[0].rpartition('@')[0]}@{version}", f"{name}@{by[f'{name}@{wanted}'][1]}", ""
        return
    if manifest:
        doc = M._object(manifest)
        for key, scope in _SCOPES[:3]:
            for name, wanted in M._section(doc, key).items():
                if f"{name}@{wanted}" in by:
                    yield ".", f"{name}@{by[f'{name}@{wanted}'][1]}", scope
    else:
        nodes = [(k[0].rpartition("@")[0], v, list(d)) for k, v, d in entries]
        yield from _unreferenced(nodes, {n: v for n, v, _ in nodes})


def bun(text: str, manifest: str = "", mode: str = "full") -> Iterator[Edge]:
    doc = json.loads(re.sub(r",(\s*[}\]])", r"\1", text))
    versions = {k: v[0].rpartition("@")[2] for k, v in M._section(doc, "packages").items()}
    if mode == "direct":
        root = M._section(M._section(doc, "workspaces"), "")
        for key, scope in _SCOPES:
            yield from _direct(M._section(root, key), versions, scope)
        return
    seen = set()
    for name, entry in M._section(doc, "packages").items():
        info = next((x for x in entry if isinstance(x, dict)), {})
        for key in ("dependencies", "optionalDependencies", "peerDependencies"):
            for d in info.get(key) or {}:
                edge = (f"{name}@{versions[name]}", f"{d}@{versions.get(d, '')}", "")
                if d in versions and d != name and edge not in seen:
                    seen.add(edge)
                    yield edge


def cargo(text: str, manifest: str = "", mode: str = "full") -> Iterator[Edge]:
    packages = M.cargo_packages(text)
    last = {p["name"]: p["version"] for p in packages}

    def node(ref: str) -> str:
        name, _, rest = ref.partition(" ")
        version = rest.partition(" ")[0] or last.get(name, "")
        return f"{name}@{version}" if version else ""

    for p in packages:
        member = "source" not in p
        for ref in p.get("dependencies", []):
            if node(ref) and (mode == "full" or member):
                yield ("." if mode == "direct" else f"{p['name']}@{p['version']}"), node(ref), ""


def poetry(text: str, manifest: str = "", mode: str = "full") -> Iterator[Edge]:
    import tomllib

    packages = tomllib.loads(text).get("package", [])
    versions: dict[str, list[str]] = {}
    for p in packages:
        versions.setdefault(M.pep503(p["name"]), []).append(p["version"])
    if mode == "direct":
        wanted = M._names_of(manifest)
        named = {M.pep503(d) for p in packages for d in p.get("dependencies", {})}
        for name in wanted or [n for n in versions if n not in named]:
            for v in versions.get(name, []):
                yield ".", f"{name}@{v}", wanted.get(name, "")
        return
    for p in packages:
        for d, spec in p.get("dependencies", {}).items():
            have = versions.get(M.pep503(d), [])
            spec = spec.get("version", "*") if isinstance(spec, dict) else spec
            fit = [v for v in have if isinstance(spec, str) and satisfies(v, spec)] or have  # none fits: all stay
            for v in fit:
                yield f"{M.pep503(p['name'])}@{p['version']}", f"{M.pep503(d)}@{v}", ""


def release(version: str) -> tuple[int, ...]:
    return tuple(int(x) for x in re.match(r"[vV]?(?:\d+!)?(\d+(?:\.\d+)*)", version)[1].split(".")) if re.match(r"[vV]?(?:\d+!)?\d", version) else ()


def satisfies(version: str, spec: str) -> bool:
    """Whether the release numbers of a version meet all clauses of a PEP 440 or poetry range."""
    v = release(version)
    for clause in spec.split(","):
        m = re.match(r"\s*(===|==|!=|>=|<=|~=|\^|~|>|<)?\s*([^\s]+)\s*$", clause)
        if not m or m[2] == "*":
            continue
        op, text = m[1] or "==", m[2]
        want = release(text)
        n = max(len(v), len(want))
        a, b = v + (0,) * (n - len(v)), want + (0,) * (n - len(want))
        if text.endswith(".*"):
            same = v[: len(want)] == want
            ok = same if op in ("==", "===") else not same
        elif op in ("^", "~", "~="):
            keep = next((i for i, x in enumerate(want) if x), len(want) - 1) + 1 if op == "^" else max(1, len(want) - 1) if op == "~=" or len(want) > 2 else len(want)
            ok = a >= b and v[:keep] == want[:keep]
        else:
            ok = {"==": a == b, "===": a == b, "!=": a != b, ">=": a >= b, "<=": a <= b, ">": a > b, "<": a < b}[op]
        if not ok:
            return False
    return True


def uv(text: str, manifest: str = "", mode: str = "full") -> Iterator[Edge]:
    import tomllib

    packages = tomllib.loads(text).get("package", [])
    versions = {p["name"]: p.get("version", "") for p in packages}
    for p in packages:
        root = bool({"editable", "virtual"} & set(p.get("source", {})))
        if mode == "direct" and not root:
            continue
        groups = [("", p.get("dependencies", []))] + [("optional", x) for x in p.get("optional-dependencies", {}).values()] + [("dev", x) for x in p.get("dev-dependencies", {}).values()]
        for scope, deps in groups:
            for d in deps:
                to = d.get("version") or versions.get(d["name"], "")
                if to:
                    yield ("." if mode == "direct" else f"{p['name']}@{p.get('version', '')}"), f"{d['name']}@{to}", scope if mode == "direct" else ""


def gem(text: str, manifest: str = "", mode: str = "full") -> Iterator[Edge]:
    specs, direct = M.gem_sections(text)
    versions = {n: v for n, v, _ in specs}
    yield from _direct(sorted(direct), versions) if mode == "direct" else _between(specs, versions)


def composer(text: str, manifest: str = "", mode: str = "full") -> Iterator[Edge]:
    doc = M._object(text)
    packages = (doc.get("packages") or []) + (doc.get("packages-dev") or [])
    versions = {p["name"]: p["version"] for p in packages}
    if mode == "direct":
        root = M._object(manifest) if manifest else {}
        yield from _direct(M._section(root, "require"), versions, "prod")
        yield from _direct(M._section(root, "require-dev"), versions, "dev")
        return
    for p in packages:
        for d in p.get("require") or {}:
            if not M.is_platform(d) and d in versions:
                yield f"{p['name']}@{p['version']}", f"{d}@{versions[d]}", ""


def nuget(text: str, manifest: str = "", mode: str = "full") -> Iterator[Edge]:
    seen = set()
    for packages in M._section(M._object(text), "dependencies").values():
        versions = {n: p.get("resolved", "") for n, p in packages.items()}
        fold = {n.lower(): n for n in versions}
        for name, p in packages.items():
            if mode == "direct":
                edges = [(".", f"{name}@{versions[name]}", "")] if p.get("type") == "Direct" and versions[name] else []
            else:
                edges = [(f"{name}@{versions[name]}", f"{fold[d.lower()]}@{versions[fold[d.lower()]]}", "") for d in p.get("dependencies") or {} if versions[name] and versions.get(fold.get(d.lower(), ""))]
            for e in edges:
                if e not in seen:
                    seen.add(e)
                    yield e


def deps_json(text: str, manifest: str = "", mode: str = "full") -> Iterator[Edge]:
    doc = M._object(text)
    kinds = {k: v.get("type") for k, v in M._section(doc, "libraries").items()}
    for target in M._section(doc, "targets").values():
        for node, entry in target.items():
            project = kinds.get(node) == "project"
            if mode == "direct" and not project:
                continue
            for name, version in (entry.get("dependencies") or {}).items():
                yield ("." if project else node.replace("/", "@")), f"{name}@{version}", ""


def conan(text: str, manifest: str = "", mode: str = "full") -> Iterator[Edge]:
    nodes = M._section(M._section(M._object(text), "graph_lock"), "nodes")
    ref = {k: re.sub(r"[@#].*$", "", n.get("ref") or "").replace("/", "@") for k, n in nodes.items()}
    for key, n in nodes.items():
        if mode == "direct" and key != "0":
            continue
        for need in n.get("requires") or []:
            source = "." if key == "0" else ref[key]
            if source and ref.get(need):
                yield source, ref[need], ""


def podfile(text: str, manifest: str = "", mode: str = "full") -> Iterator[Edge]:
    pods = re.split(r"\n(?=[A-Z])", text.partition("PODS:")[2])[0]
    root = lambda n: n.partition("/")[0]
    versions = {root(m[1]): m[2] for m in re.finditer(r"^ {2}- \"?([^\s(\":]+) \(([^)]+)\)", pods, re.M)}
    if mode == "direct":
        section = re.split(r"\n(?=[A-Z])", text.partition("DEPENDENCIES:")[2])[0]
        yield from _direct(dict.fromkeys(root(n) for n in re.findall(r"^ {2}- \"?([^\s(\"]+)", section, re.M)), versions)
        return
    seen, owner = set(), ""
    for line in pods.split("\n"):
        if m := re.match(r"^ {2}- \"?([^\s(\":]+)", line):
            owner = root(m[1])
        elif (m := re.match(r"^ {4}- \"?([^\s(\"]+)", line)) and root(m[1]) != owner and root(m[1]) in versions:
            edge = (f"{owner}@{versions[owner]}", f"{root(m[1])}@{versions[root(m[1])]}", "")
            if edge not in seen:
                seen.add(edge)
                yield edge


def mix(text: str, manifest: str = "", mode: str = "full") -> Iterator[Edge]:
    nodes = M.mix_entries(text)
    versions = {n: v for n, v, _ in nodes}
    yield from _unreferenced(nodes, versions) if mode == "direct" else _between(nodes, versions)


def star(parser: Callable) -> Callable:
    """Root edges to all packages of formats that hold no edges; direct leaves out transitive ones where the format says."""

    def edges(text: str, manifest: str = "", mode: str = "full") -> Iterator[Edge]:
        rows = list(parser(text))
        marked = any(d.direct for d in rows)
        for d in rows:
            if d.direct or mode == "full" or not marked:
                yield ".", f"{d.name}@{d.version}", d.scope

    return edges


def cpan(text: str, manifest: str = "", mode: str = "full") -> Iterator[Edge]:
    dists = M.cpan_distributions(text)
    home = {m: n for n, _, provides, _ in dists for m in provides}
    nodes = [(n, v, list(dict.fromkeys(home[r] for r in needs if r in home and home[r] != n))) for n, v, _, needs in dists]
    versions = {n: v for n, v, _ in nodes}
    yield from _unreferenced(nodes, versions) if mode == "direct" else _between(nodes, versions)


# Packages that come with R.
R_BASE = {"R", "base", "compiler", "datasets", "graphics", "grDevices", "grid", "methods", "parallel", "splines", "stats", "stats4", "tcltk", "tools", "utils", "MASS", "Matrix"}


def renv(text: str, manifest: str = "", mode: str = "full") -> Iterator[Edge]:
    packages = M._section(M._object(text), "Packages")
    nodes = [(n, p.get("Version", ""), [d for d in dict.fromkeys(p.get("Requirements") or []) if d not in R_BASE]) for n, p in packages.items()]
    versions = {n: v for n, v, _ in nodes}
    yield from _unreferenced(nodes, versions) if mode == "direct" else _between(nodes, versions)


def go_graph(text: str, manifest: str = "", mode: str = "full") -> Iterator[Edge]:
    for line in text.split("\n"):
        a, _, b = line.strip().partition(" ")
        if a and b:
            root = "@" not in a
            if mode == "full" or root:
                yield "." if root else a, b, ""


def go_mod(text: str, manifest: str = "", mode: str = "full") -> Iterator[Edge]:
    for d in M.go_mod(text):
        yield ".", f"{d.name}@{d.version}", "prod"


def maven_tree(text: str, manifest: str = "", mode: str = "full") -> Iterator[Edge]:
    name = lambda n: f"{n['groupId']}:{n['artifactId']}@{n['version']}"
    root = M._object(text)
    todo = [(root, True)]
    while todo:
        node, top = todo.pop()
        for child in node.get("children") or []:
            if mode == "full" or top:
                yield "." if mode == "direct" else name(node), name(child), {"test": "dev"}.get(child.get("scope"), "prod") if mode == "direct" else ""
            todo.append((child, False))


def gradle_tree(text: str, manifest: str = "", mode: str = "full") -> Iterator[Edge]:
    """Five columns of indentation a level; `a -> b` takes the version on the right."""
    above: list[str] = []
    seen = set()
    for line in text.split("\n"):
        m = re.match(r"^((?:[| ]    )*)[+\\]--- (\S+)(?: -> (\S+))?", line)
        if not m:
            above = above if line.strip() else []
            continue
        depth = len(m[1]) // 5
        parts = m[2].split(":")
        version = (m[3] or parts[-1]).rpartition(":")[2]
        name = ":".join(parts[:2])
        node = f"{name}@{version}"
        above = [*above[:depth], node]
        edge = (above[depth - 1] if depth else ".", node, "")
        if (mode == "full" or not depth) and edge not in seen:
            seen.add(edge)
            yield edge


def cyclonedx(text: str, manifest: str = "", mode: str = "full") -> Iterator[Edge]:
    doc = M._object(text)
    node = {c.get("bom-ref"): f"{':'.join(x for x in (c.get('group'), c.get('name')) if x)}@{c.get('version', '')}" for c in doc.get("components") or [] if c.get("version")}
    for d in doc.get("dependencies") or []:
        source = node.get(d.get("ref"), ".")
        if mode == "direct" and source != ".":
            continue
        for to in d.get("dependsOn") or []:
            if to in node:
                yield source, node[to], ""


#: Pattern on the path, component type, and edges; the first that fits reads the file.
GRAPHS: list[tuple[str, str, Callable]] = [
    (r"(^|/)package-lock\.json$", "nodejs", npm),
    (r"(^|/)pnpm-lock\.yaml$", "nodejs", pnpm),
    (r"(^|/)yarn\.lock$", "nodejs", yarn),
    (r"(^|/)bun\.lock$", "nodejs", bun),
    (r"(^|/)Cargo\.lock$", "rust", cargo),
    (r"(^|/)poetry\.lock$", "python", poetry),
    (r"(^|/)uv\.lock$", "python", uv),
    (r"(^|/)Gemfile\.lock$", "ruby", gem),
    (r"(^|/)composer\.lock$", "php", composer),
    (r"(^|/)packages\.lock\.json$", "dotnet", nuget),
    (r"\.deps\.json$", "dotnet", deps_json),
    (r"(^|/)conan\.lock$", "cplusplus", conan),
    (r"(^|/)Podfile\.lock$", "cocoapods", podfile),
    (r"(^|/)mix\.lock$", "elixir", mix),
    (r"(^|/)pubspec\.lock$", "dart", star(M.pubspec_lock)),
    (r"(^|/)Package\.resolved$", "swift", star(M.package_resolved)),
    (r"(^|/)cpanfile\.snapshot$", "perl", cpan),
    (r"(^|/)renv\.lock$", "r", renv),
    (r"(^|/)go\.mod\.graph$", "golang", go_graph),
    (r"(^|/)go\.mod$", "golang", go_mod),
    (r"(^|/)dependency-tree\.json$", "maven", maven_tree),
    (r"(^|/)gradle-dependencies\.txt$", "gradle", gradle_tree),
    (r"(^|/)bom\.json$", "maven", cyclonedx),
]
ANY_LOCK = "|".join(f"(?:{p})" for p, _, _ in GRAPHS)
#: Manifests that say which packages are direct where the lockfile does not.
MANIFEST_OF = {"yarn.lock": "package.json", "poetry.lock": "pyproject.toml", "composer.lock": "composer.json"}


def edges_of(path: str, text: str, manifest: str = "", mode: str = "full") -> tuple[str, list[Edge], str]:
    """The component type, the edges and the error ('' if none) of one file; what a broken file makes a parser raise is its error."""
    for pattern, kind, f in GRAPHS:
        if re.search(pattern, path):
            try:
                return kind, list(f(text, manifest, mode)), ""
            except Exception as e:
                return kind, [], f"{type(e).__name__}: {e}"[:200]
    return "", [], ""


def extract_edges(files: DataFrame, mode: str = "full") -> DataFrame:
    """(path, component_type, from, to, scope, walk_order) of the lockfiles among files (path, text) that parse; mode "off" gives none."""
    return edges_and_errors(files, mode).where("error IS NULL").drop("error")


#: Rows of edges that a task holds at a time, and those of one file more.
EDGE_ROWS = 8192


def edge_batches(batches: Iterator[pa.RecordBatch], mode: str) -> Iterator[pa.RecordBatch]:
    """The edges and errors of (path, text, manifest); files become Python objects one by one, edges leave before they pile up."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.string()] * 5 + [pa.int64(), pa.string()], strict=True)], ["path", "component_type", "from", "to", "scope", "walk_order", "error"])

    for batch in batches:
        rows: list[tuple] = []
        for i in range(batch.num_rows):
            path, text, manifest = (batch.column(k)[i].as_py() for k in range(3))
            kind, edges, error = edges_of(path, text or "", manifest or "", mode)
            rows += [(path, kind, *e, k, None) for k, e in enumerate(edges)]
            if error:
                rows.append((path, kind, None, None, None, None, error))
            if len(rows) >= EDGE_ROWS:
                yield packed(rows)
                rows = []
        if rows:
            yield packed(rows)


def edges_and_errors(files: DataFrame, mode: str = "full") -> DataFrame:
    """(path, component_type, from, to, scope, walk_order, error) of the lockfiles among files (path, text); mode "off" gives none.

    A file that does not parse is one row with its error and no edge.
    """
    from pyspark.sql import functions as F

    locks = files.where(F.col("path").rlike(ANY_LOCK)).select("path", "text", F.regexp_replace("path", "/[^/]*$", "").alias("dir"))
    pair = F.create_map(*[F.lit(x) for kv in MANIFEST_OF.items() for x in kv])[F.regexp_replace("path", "^.*/", "")]
    manifests = files.where(F.col("path").rlike(r"(^|/)(package\.json|pyproject\.toml|composer\.json)$")).select(F.col("path").alias("m_path"), F.col("text").alias("manifest"))
    joined = locks.join(manifests, F.concat_ws("/", F.col("dir"), pair) == F.col("m_path"), "left").select("path", "text", "manifest")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return edge_batches(batches, mode)

    return (joined.limit(0) if mode == "off" else joined).mapInArrow(task, "path string, component_type string, `from` string, `to` string, scope string, walk_order long, error string")
