"""Mediation with exclusions against all paths, ranges against PEP 440 and tables of cases, documents of many systems."""

import json
import random

import pytest

from granary.functions import ranges as V
from granary.operators import documents, maven, mediation
from granary.operators import ranges as N

KIDS = "parent string, parent_version string, child string, child_version string, ord int, exclusions array<string>"
ROOTS = "project string, name string, version string, ord int, exclusions array<string>"


def blocked(name, excluded):
    group, _, artifact = name.partition(":")
    artifact = artifact or group
    return bool({name, f"{group}:*", f"*:{artifact}", "*:*"} & excluded)


def brute_mediation(children, roots, most=64):
    """{name: (version, depth)} of one project, every state (name, set) walked, none dropped as dominated."""
    found = [((o,), n, v, frozenset(x or ())) for n, v, o, x in roots]
    chosen, seen = {}, set()
    for depth in range(most + 1):
        for name in {f[1] for f in found} - chosen.keys():
            order, version = min((f[0], f[2]) for f in found if f[1] == name)
            chosen[name] = (version, depth)
        live = {}
        for order, name, version, excluded in found:
            if chosen[name][0] == version and (name, excluded) not in seen:
                live[name, excluded] = min(live.get((name, excluded), order), order)
        if not live:
            break
        seen |= live.keys()
        found = [
            (order + (o,), child, cv, excluded | frozenset(x or ()))
            for (name, excluded), order in live.items()
            for parent, pv, child, cv, o, x in children
            if (parent, pv) == (name, chosen[name][0]) and not blocked(child, excluded)
        ]
    return chosen


def mediated(spark, children, roots):
    out = {}
    for r in mediation.mediate(spark.createDataFrame(children, KIDS), spark.createDataFrame(roots, ROOTS)).collect():
        out.setdefault(r.project, {})[r.name] = (r.version, r.depth)
    return out


def test_a_diamond_is_blocked_on_one_side_only(spark):
    """top -> left (excludes x) -> low, top -> right -> more -> low, low -> x: x is found by the longer way."""
    children = [("g:top", "1", "g:left", "1", 0, ["g:x"]), ("g:top", "1", "g:right", "1", 1, None), ("g:left", "1", "g:low", "1", 0, []), ("g:right", "1", "g:more", "1", 0, []), ("g:more", "1", "g:low", "1", 0, []), ("g:low", "1", "g:x", "1", 0, [])]
    both = [("p", "g:top", "1", 0, None), ("q", "g:top", "1", 0, ["g:right"]), ("r", "g:top", "1", 0, ["*:x"])]
    got = mediated(spark, children, both)
    assert got["p"] == {"g:top": ("1", 0), "g:left": ("1", 1), "g:right": ("1", 1), "g:low": ("1", 2), "g:more": ("1", 2), "g:x": ("1", 4)}
    assert got["q"] == {"g:top": ("1", 0), "g:left": ("1", 1), "g:low": ("1", 2)}
    assert got["r"] == {k: v for k, v in got["p"].items() if k != "g:x"}


def test_cycles_wildcards_and_versions_against_all_paths(spark):
    rng = random.Random(11)
    children, roots, want = [], [], {}
    for g in range(25):
        n = rng.randint(3, 7)
        name = lambda k: f"g{g}x{k % 2}:a{k}"  # noqa: B023, E731
        tokens = [f"g{g}x0:*", f"*:a{n - 1}", name(1), name(2), "*:*"][: rng.randint(2, 5)]
        own = []
        for k in range(n):
            for v in "12":
                for o in range(rng.randint(0, 3)):
                    own.append((name(k), v, name(rng.randrange(n)), rng.choice("12"), o, rng.sample(tokens, rng.choice([0, 0, 1, 2])) or rng.choice([None, []])))
        top = [(name(0), "1", 0, None), (name(1), rng.choice("12"), 1, rng.sample(tokens, 1))]
        children += own
        roots += [(f"p{g}", *r) for r in top]
        want[f"p{g}"] = brute_mediation(own, top)
    assert mediated(spark, children, roots) == want
    assert sum(len(x) for x in want.values()) > 60


def test_mediation_of_odd_rows(spark):
    children = [("g:a", "1", None, "1", 0, None), ("g:a", "1", "g:b", None, 1, None), (None, "1", "g:c", "1", 2, None), ("g:a", "1", "g:d", "1", 3, []), ("g:a", "1", "g:d", "1", 3, [])]
    roots = [(None, "g:a", "1", 0, None), ("p", None, "1", 0, None), ("p", "g:z", "9", 0, None), ("p", "g:z", "9", 0, None)]
    assert mediated(spark, children, roots) == {None: {"g:a": ("1", 0), "g:d": ("1", 1)}, "p": {"g:z": ("9", 0)}}
    assert mediated(spark, [], roots[:1]) == {None: {"g:a": ("1", 0)}} and mediated(spark, children, []) == {}


def test_exclusions_of_poms_reach_mediation(spark):
    dep = lambda g, a, more="": f"<dependency><groupId>{g}</groupId><artifactId>{a}</artifactId><version>1</version>{more}</dependency>"
    out = "<exclusions><exclusion><groupId>{}</groupId><artifactId>{}</artifactId></exclusion></exclusions>"
    pom = lambda a, deps, more="": f"<project><groupId>g</groupId><artifactId>{a}</artifactId><version>1</version>{more}<dependencies>{deps}</dependencies></project>"
    managed = f"<dependencyManagement><dependencies>{dep('g', 'c', out.format('*', 'y'))}</dependencies></dependencyManagement>"
    texts = [pom("top", dep("g", "b", out.format("g", "x")) + dep("g", "c"), managed), pom("b", dep("g", "x") + dep("g", "y")), pom("c", dep("g", "y") + dep("g", "z")), pom("x", ""), pom("y", ""), pom("z", "")]
    poms = maven.read_poms(spark.createDataFrame([(f"/{k}/pom.xml", t) for k, t in enumerate(texts)], "path string, text string"))
    got = mediation.mediate(maven.child_table(poms), spark.createDataFrame([("p", "g:top", "1", 0, None)], ROOTS))
    assert {r.name: r.depth for r in got.collect()} == {"g:top": 0, "g:b": 1, "g:c": 1, "g:y": 2, "g:z": 2}


PEP440 = ["0", "0.0", "1.dev0", "1.0.dev3", "1.0a1.dev1", "1.0a1", "1.0alpha2", "1.0b1", "1.0rc1", "1.0rc1.post2.dev1", "1.0rc1.post2", "1.0", "1", "1.0.0", "v1.0", "1.0+local.1", "1.0.post1.dev2", "1.0.post1", "1.0-2", "1.0.1.dev1", "1.0.1", "1.0.10", "1.1", "1.1.1", "1.2.3", "1.10", "2", "2.0rc1", "2.2", "2.2.post3", "2.2.3", "10.0", "2023.10.11", "20230101123456", "1!0.1", "1!2.0rc1"]


def keys(spark, versions, order):
    return {r.version: r.key for r in order(spark.createDataFrame([(v,) for v in versions], "version string")).collect()}


def test_keys_sort_as_pep440_does(spark):
    version = pytest.importorskip("pip._vendor.packaging.version").Version
    key = keys(spark, [*PEP440, "not one", "", None, "1.x", "1..2"], V.pep440_order)
    assert all(key[x] is None for x in ("not one", "", None, "1.x", "1..2"))
    public = lambda v: version(version(v).public)
    for a in PEP440:
        for b in PEP440:
            assert (key[a] < key[b]) == (public(a) < public(b)) and (key[a] == key[b]) == (public(a) == public(b)), (a, b)


def found(spark, specs, versions, dialect):
    names = spark.createDataFrame([("n", s) for s in specs], "name string, spec string")
    out = {}
    for r in N.satisfying(names, spark.createDataFrame([("n", v) for v in versions], "name string, version string"), dialect).collect():
        out.setdefault(r.spec, (r.matched, set()))[1].add(r.version)
    return out


def test_ranges_as_pep440_says(spark):
    specifiers = pytest.importorskip("pip._vendor.packaging.specifiers")
    rng = random.Random(3)
    bases = ["0", "1.0", "1", "1.0a1", "1.0rc1", "1.0.post1", "1.0.1", "1.1", "1.2.3", "2.2", "2.0rc1", "1.dev0", "1!0.1", "2023.10"]
    specs = {f"{op}{b}" for op in ("==", "!=", ">=", "<=", ">", "<") for b in bases}
    specs |= {f"{op}{b}.*" for op in ("==", "!=") for b in ("1", "1.0", "1.2", "2", "2023", "1!0", "0")} | {f"~={b}" for b in ("1.0", "1.2.3", "2.2", "1.0rc1", "1!0.1", "1.0.post1")}
    some = sorted(specs)
    specs |= {", ".join(rng.sample(some, rng.randint(2, 3))) for _ in range(150)}
    have = [v for v in PEP440 if "rc1.post" not in v]  # of which `>` leaves out more than its own post-releases there
    got = found(spark, sorted(specs), have, "pep440")
    for spec in specs:
        want = {v for v in have if specifiers.SpecifierSet(spec).contains(v) or ("+" in v and specifiers.SpecifierSet(spec).contains(v.split("+")[0]))}
        assert got[spec] == ((True, want) if want else (False, set(have))), spec


def test_poetry_and_odd_ranges(spark):
    have = ["0.0.3", "0.0.4", "0.2.0", "0.2.9", "0.3.0", "1.2.0", "1.2.9", "1.3.0", "1.9", "2.0", "2.0rc1", "odd"]
    every = set(have)
    want = {
        "^1.2": {"1.2.0", "1.2.9", "1.3.0", "1.9"}, "^0.2": {"0.2.0", "0.2.9"}, "^0.0.3": {"0.0.3"}, "^0": {v for v in have if v.startswith("0.")},
        "~1.2": {"1.2.0", "1.2.9"}, "~1": {"1.2.0", "1.2.9", "1.3.0", "1.9"}, "~1.2.0": {"1.2.0", "1.2.9"}, "*": every - {"odd", "2.0rc1"}, "": every - {"odd", "2.0rc1"},
        "^0.2 || ^2.0": {"0.2.0", "0.2.9", "2.0"}, "^0.2|>=2.0rc1": {"0.2.0", "0.2.9", "2.0", "2.0rc1"}, "1.9": {"1.9"}, " >= 1.3 , != 1.9 ": {"1.3.0", "2.0"},
    }
    none = [">=1,,x", "nonsense here", "~=1", ">=1.*", "^9", ">2,<1", None]
    got = found(spark, [*want, *none], have, "pep440")
    assert {k: v[1] for k, v in got.items() if k in want} == want and all(got[k][0] for k in want)
    assert all(got[k] == (False, every) for k in none)


def test_semver_ranges(spark):
    have = ["0.0.1", "0.0.2", "0.1.0", "0.1.9", "0.2.0", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-2", "1.0.0-11", "1.0.0", "1.2.0", "1.2.3-beta.2", "1.2.3", "1.2.9", "1.3.0", "2.0.0-rc.1", "2.0.0", "v2.3.4+build", "10.0.0", "odd"]
    final = [v for v in have if "-" not in v and v != "odd"]
    key = keys(spark, have, V.semver_order)
    order = ["1.0.0-2", "1.0.0-11", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0", "1.2.0", "1.2.3-beta.2", "1.2.3", "2.0.0-rc.1", "2.0.0", "v2.3.4+build", "10.0.0"]
    assert [key[v] for v in order] == sorted(key[v] for v in order) and key["odd"] is None
    between = lambda a, b: set(final[final.index(a) : final.index(b) + 1])
    want = {
        "^1.2.0": between("1.2.0", "1.3.0"), "^0.1.0": {"0.1.0", "0.1.9"}, "^0.0.1": {"0.0.1"}, "^0.0": {"0.0.1", "0.0.2"}, "^0.x": between("0.0.1", "0.2.0"), "~1.2.3": {"1.2.3", "1.2.9"}, "~1.2": {"1.2.0", "1.2.3", "1.2.9"}, "~1": between("1.0.0", "1.3.0"), "~> 1.2": {"1.2.0", "1.2.3", "1.2.9"},
        "1.2.x": {"1.2.0", "1.2.3", "1.2.9"}, "1": between("1.0.0", "1.3.0"), "1.X": between("1.0.0", "1.3.0"), "*": set(final), "": set(final), "x": set(final), "=1.2.3": {"1.2.3"}, "v1.2.3": {"1.2.3"},
        ">1.2": between("1.3.0", "10.0.0"), ">1": between("2.0.0", "10.0.0"), ">=1.2": between("1.2.0", "10.0.0"), "<1.2": between("0.0.1", "1.0.0"), "<=1.2": between("0.0.1", "1.2.9"), "<0.1.9": {"0.0.1", "0.0.2", "0.1.0"}, "> 1.2.3 < 2": {"1.2.9", "1.3.0"},
        "1.2.3 - 2": between("1.2.3", "v2.3.4+build"), "1.2 - 1.2.3": {"1.2.0", "1.2.3"}, "^0.1.0 || ^2.0.0": {"0.1.0", "0.1.9", "2.0.0", "v2.3.4+build"}, ">=1.2.0, <1.3.0": {"1.2.0", "1.2.3", "1.2.9"},
        "^1.2.3-beta.1": {"1.2.3-beta.2", "1.2.3", "1.2.9", "1.3.0"}, ">=1.0.0-alpha.1 <1.0.0": {"1.0.0-alpha.1", "1.0.0-alpha.beta"}, ">=2.0.0-rc.0 <2.0.1": {"2.0.0-rc.1", "2.0.0"}, "1.0.0-11": {"1.0.0-11"},
    }
    none = ["latest", "git+ssh://x/y.git", "workspace:*", "<0.0.0", ">*", "1.2.3.4"]
    got = found(spark, [*want, *none], have, "semver")
    assert {k: v[1] for k, v in got.items() if k in want} == want and all(got[k][0] for k in want)
    assert all(got[k] == (False, set(have)) for k in none)


def test_rows_of_ranges_that_take_no_part(spark):
    specs = spark.createDataFrame([(None, ">=1"), ("a", ">=1"), ("a", ">=1"), ("gone", ">=1")], "name string, spec string")
    versions = spark.createDataFrame([("a", "1.0"), ("a", "1.0"), ("a", None), (None, "3"), ("b", "2")], "name string, version string")
    assert [tuple(r) for r in N.satisfying(specs, versions).collect()] == [("a", ">=1", "1.0", True)]
    assert [tuple(r) for r in N.best_satisfying(specs, versions).collect()] == [("a", ">=1", "1.0")]
    assert N.satisfying(specs.limit(0), versions).count() == 0 and N.satisfying(specs, versions.limit(0)).count() == 0


def test_edges_of_a_lock_with_several_versions(spark):
    packages = [("l", "numpy", "1.24.4"), ("l", "numpy", "1.26.4"), ("l", "pandas", "2.0"), ("l", "scipy", "1.9"), ("m", "numpy", "3.0"), (None, "numpy", "1.0")]
    needs = [("l", "pandas", "2.0", "numpy", ">=1.25"), ("l", "scipy", "1.9", "numpy", "odd range"), ("l", "scipy", "1.9", "pandas", ">=99"), ("l", "scipy", "1.9", "absent", "*"), ("m", "x", "1", "numpy", "<1"), (None, "y", "1", "numpy", "*"), ("l", "z", "1", None, "*")]
    got = N.range_edges(spark.createDataFrame(packages, "lock string, name string, version string"), spark.createDataFrame(needs, "lock string, name string, version string, needs string, spec string"))
    want = [("l", "pandas@2.0", "numpy@1.26.4"), ("l", "scipy@1.9", "numpy@1.24.4"), ("l", "scipy@1.9", "numpy@1.26.4"), ("l", "scipy@1.9", "pandas@2.0"), ("m", "x@1", "numpy@3.0"), (None, "y@1", "numpy@1.0")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_documents_of_many_systems(spark):
    nodes = [("r", "r", None, 0, "top", "/", 1, 'quote " and \n'), ("r", "b", "r", 1, "b", "/b", 2, None), ("r", "a", "r", 1, "a", "/a", 3, "é"), ("r", "c", "a", 2, "c", "/a/c", 4, None), ("s", "r", None, 0, "alone", "/", 5, None), ("r", "lost", "nowhere", 1, "lost", "/x", 6, None)]
    df = spark.createDataFrame(nodes, "root_id string, component_id string, parent_id string, depth int, name string, dir string, walk_order int, note string")
    deps = spark.createDataFrame([("r", "c", "y", 2), ("r", "c", "x", None), ("s", "r", "z", 1), ("s", "nobody", "w", 1)], "root_id string, component_id string, name string, n int")
    got = {r.root_id: json.loads(r.document) for r in documents.tree_documents(df, {"deps": deps}).collect()}
    assert got == {
        "r": {"component_id": "r", "name": "top", "dir": "/", "note": 'quote " and \n', "children": [{"component_id": "a", "name": "a", "dir": "/a", "note": "é", "children": [{"component_id": "c", "name": "c", "dir": "/a/c", "deps": [{"name": "x", "n": None}, {"name": "y", "n": 2}]}]}, {"component_id": "b", "name": "b", "dir": "/b"}]},
        "s": {"component_id": "r", "name": "alone", "dir": "/", "deps": [{"name": "z", "n": 1}]},
    }
    assert documents.tree_documents(df.limit(0)).count() == 0


def test_bills_of_roots_without_components(spark):
    components = spark.createDataFrame([("a", "pkg:npm/x@1", "x", "1", "required", "MIT"), ("a", "", "y", "", "", "")], "root string, purl string, name string, version string, scope string, license string")
    roots = spark.createDataFrame([("a", "A", [("k", "v"), ("b", "w")]), ("b", None, None)], "root string, name string, properties array<struct<name:string,value:string>>")
    got = {r.root: json.loads(r.document) for r in documents.cyclonedx_documents(components, roots).collect()}
    assert got["a"]["components"] == [{"type": "library", "name": "y"}, {"type": "library", "name": "x", "version": "1", "purl": "pkg:npm/x@1", "scope": "required", "licenses": [{"license": {"id": "MIT"}}]}]
    assert got["a"]["metadata"] == {"component": {"type": "application", "name": "A"}, "properties": [{"name": "b", "value": "w"}, {"name": "k", "value": "v"}]}
    assert got["b"]["components"] == [] and "metadata" not in got["b"]
    bills = {r.root: json.loads(r.document) for r in documents.spdx_documents(components, roots).collect()}
    assert [len(bills[k]["packages"]) for k in "ab"] == [3, 1] and [len(bills[k]["relationships"]) for k in "ab"] == [3, 1]
