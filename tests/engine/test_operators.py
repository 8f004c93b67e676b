import random

import pytest
from pyspark.sql import functions as F

from granary.operators import aggregates as A
from granary.operators import documents
from granary.operators import graphs as G
from granary.operators import rules as R
from granary.operators import sbom

DEPS = "component_id string, type string, name string, version string, scope string, direct boolean, source string, license string, walk_order long"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_dependency_merge_does_not_depend_on_order(spark, seed):
    data = [("a", "npm", "x", "1", "dev", False, "", "", 1), ("b", "npm", "x", "1", "prod", False, "b.json", "", 2), ("c", "npm", "x", "1", "strange", True, "c.json", "MIT", 3), ("d", "npm", "y", "1", "", False, "", "", 4), ("e", "npm", "y", "1", "strange", False, "", "", 5)]
    random.Random(seed).shuffle(data)
    got = rows(A.merged_dependencies(spark.createDataFrame(data, DEPS).repartition(seed + 1)))
    assert got == [("npm", "x", "1", True, "prod", "b.json", "MIT", 3), ("npm", "y", "1", False, "strange", None, None, 2)]


def test_last_edge_wins(spark):
    e = spark.createDataFrame([("a", "b", "s1", "dev", 1), ("a", "b", "s2", "prod", 2), ("a", "c", "s1", "", 1)], "`from` string, `to` string, source string, scope string, walk_order long")
    assert rows(A.merged_edges(e)) == [("a", "b", "s2", "prod"), ("a", "c", "s1", "")]


def test_code_stats_levels_agree(spark):
    f = spark.createDataFrame([("py", "c1", 10, 7, 2, 1, 3), ("py", "c2", 5, 5, 0, 0, 1), ("go", "c1", 4, 4, 0, 0, 0)], "language string, component string, lines long, code long, comments long, blanks long, complexity long")
    got = {(r.level, r.key, r.language): r.lines for r in A.code_stats(f, "component").collect()}
    assert got == {("all", "", ""): 19, ("all", "", "py"): 15, ("all", "", "go"): 4, ("component", "c1", ""): 14, ("component", "c1", "py"): 10, ("component", "c1", "go"): 4, ("component", "c2", ""): 5, ("component", "c2", "py"): 5}


def test_metrics_of_nothing(spark):
    f = spark.createDataFrame([("", "", "", 0, 0, 0, 0, 0, 0)], "level string, key string, language string, files long, lines long, code long, comments long, blanks long, complexity long")
    r = A.metrics(f).first()
    assert (r.comment_ratio, r.code_density, r.avg_file_size, r.complexity_per_kloc, r.avg_complexity) == (0, 0, 0, 0, 0)


def test_primary_techs(spark):
    schema = "component_id long, type string, tech array<string>, code long"
    eligible = spark.createDataFrame([("a",), ("b",), ("cplusplus",)], "tech string")
    by_code = spark.createDataFrame([(1, "x", ["a"], 9900), (2, "x", ["b"], 50), (3, "x", [], 0), (4, "", ["b"], 99999)], schema)
    assert rows(A.primary_techs(by_code, eligible)) == [("a",)]
    by_count = spark.createDataFrame([(k, "x", ["a"] if k else ["b"], 0) for k in range(12)], schema)
    assert rows(A.primary_techs(by_count, eligible)) == [("a",)]
    speaks = spark.createDataFrame([("C++", 0.6), ("Python", 0.4)], "language string, pct double")
    assert rows(A.primary_techs(by_code, eligible, speaks)) == [("a",), ("cplusplus",)]


def test_ecosystem_signals(spark):
    c = spark.createDataFrame([(1, "nodejs", ["x"]), (2, "nodejs", []), (3, "", ["typescript", "nodejs"]), (4, "", ["python"])], "component_id long, type string, tech array<string>")
    lang = spark.createDataFrame([("Go",), ("Python",)], "language string")
    dims = [spark.createDataFrame(x, f"{n} string, ecosystem string") for n, x in (("type", [("nodejs", "node")]), ("tech", [("typescript", "node"), ("nodejs", "node"), ("python", "python")]), ("language", [("Go", "go"), ("Python", "python")]))]
    assert rows(A.ecosystems(c, lang, *dims)) == [("go", 1), ("node", 3), ("python", 1)]


def test_observations(spark):
    f = spark.createDataFrame([(f"/a/b/f{k}",) for k in range(6)] + [(f"/c/f{k}",) for k in range(5)] + [("/x",)], "path string")
    assert [tuple(r) for r in A.directory_counts(f, F.lit(True)).collect()] == [("a/b", 6), ("c", 5)]
    n = spark.createDataFrame([("x", 90), ("y", 5), ("z", 5)], "k string, n long")
    assert rows(A.dominance(n, "k", "n")) == [("x", 90, 0.9)] and not rows(A.dominance(n.where("k <> 'z'"), "k", "n"))
    assert rows(A.first_per_key(n.withColumn("g", F.lit(1)), ["g"], [F.desc("n")])) == [("x", 90, 1)]


def test_rule_joins(spark):
    deps = spark.createDataFrame([("c", "gradle", "g:a"), ("c", "npm", "@aws-sdk/s3"), ("c", "npm", "react"), ("c", "pypi", "react")], "component_id string, type string, name string")
    exact = spark.createDataFrame([("react", "npm", "react"), ("spring", "maven", "g:a")], "tech string, dep_type string, pattern string")
    got = rows(R.match_dependencies(deps, exact, [("aws", "npm", "^@aws-sdk/")]).select("type", "name", "tech"))
    assert got == [("gradle", "g:a", "spring"), ("npm", "@aws-sdk/s3", "aws"), ("npm", "react", "react")]


def test_ignore_last_match_wins(spark):
    paths = spark.createDataFrame([(p, False) for p in ("/a.log", "/keep.log", "/build/x.py", "/src/build/y.py", "/src/a.py", "/.git/config")], "path string, is_dir boolean")
    got = {r.path: r.ignored for r in R.last_match(paths, [(".git", False, False), ("*.log", False, False), ("keep.log", True, False), ("build", False, True)]).collect()}
    assert got == {"/a.log": True, "/keep.log": False, "/build/x.py": True, "/src/build/y.py": True, "/src/a.py": False, "/.git/config": True}


def test_content_first_rule_per_tech(spark):
    files = spark.createDataFrame([("/a.py", "a.py", ".py", "import pytest"), ("/b.go", "b.go", ".go", "import pytest"), ("/p.json", "p.json", ".json", '{"a": {"b": "x1"}}')], "path string, name string, ext string, text string")
    rules = [{"tech": "t", "rule_order": 2, "ext": ".py", "pattern": "import"}, {"tech": "t", "rule_order": 1, "ext": ".py", "pattern": "pytest"}, {"tech": "j", "rule_order": 3, "file": "p.json", "kind": "json-path", "path": "a.b", "value": "/^x/"}, {"tech": "u", "rule_order": 4, "ext": ".py", "kind": "no such kind", "pattern": "pytest$"}]
    assert rows(R.match_content(files, rules)) == [("/a.py", "t", 1), ("/a.py", "u", 4), ("/p.json", "j", 3)]


def test_flags(spark):
    r = spark.createDataFrame([("a", "db", None, None), ("b", "db", False, None), ("c", "other", None, None), ("d", "cloud", True, None)], "tech string, type string, is_component boolean, is_primary_tech boolean")
    c = spark.createDataFrame([("db", True, None, True)], "type string, is_component boolean, is_primary_tech boolean, create_edges boolean")
    assert rows(R.flags(r, c)) == [("a", "db", True, True, True), ("b", "db", False, False, True), ("c", "other", False, False, True), ("d", "cloud", True, True, False)]


EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c"), ("x", "y")]


def test_closure_of_a_cycle(spark):
    e = spark.createDataFrame(EDGES, "`from` string, `to` string")
    assert rows(G.closure(e, spark.createDataFrame([("a",)], "node string"))) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 1)]
    nodes = e.select(F.explode(F.array("from", "to")).alias("node")).distinct()
    assert rows(G.root_edges(nodes, e)) == [(".", "x")]
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(20)], "`from` string, `to` string")
    assert len(rows(G.closure(chain, spark.createDataFrame([("n0",)], "node string")))) == 21


def brute_nearest(children, roots):
    """Level by level: of a name's offers the first in order, unless an earlier level chose it."""
    chosen, level = {}, {}
    for name, version, order in roots:
        if name not in level or (str(order), version) < level[name]:
            level[name] = (str(order), version)
    depth = 0
    while level:
        chosen |= {n: (v, depth) for n, (_, v) in level.items()}
        offers = {}
        for n, (order, v) in level.items():
            for p, pv, c, cv, k in children:
                if (p, pv) == (n, v) and c not in chosen:
                    offer = (f"{order}/{k:06d}", cv)
                    offers[c] = min(offers.get(c, offer), offer)
        level, depth = offers, depth + 1
    return sorted((n, v, d) for n, (v, d) in chosen.items())


@pytest.mark.parametrize("seed", range(2))
def test_nearest_wins(spark, seed):
    rng = random.Random(seed)
    children = [(f"p{rng.randint(0, 12)}", f"v{rng.randint(0, 1)}", f"p{rng.randint(0, 12)}", f"v{rng.randint(0, 1)}", k) for k in range(50)]
    roots = [("p1", "v0", 0), ("p2", "v1", 1)]
    got = rows(G.nearest_wins(spark.createDataFrame(children, "parent string, parent_version string, child string, child_version string, ord int"), spark.createDataFrame(roots, "name string, version string, ord int")))
    assert got == brute_nearest(children, roots)


def test_nearest_wins_with_large_orders(spark):
    children = [("a", "1", "b", "first", 1_000_001), ("a", "1", "b", "a later one", 1_000_009)]
    got = rows(G.nearest_wins(spark.createDataFrame(children, "parent string, parent_version string, child string, child_version string, ord long"), spark.createDataFrame([("a", "1", 0)], "name string, version string, ord int")))
    assert got == [("a", "1", 0), ("b", "first", 1)]


def test_registered_mediation(spark):
    from granary.plans import catalog, relations

    d = "/root/testdata/sf0.001"
    children = [tuple(r) for r in relations.child_packages(spark, d).collect()]
    assert rows(catalog.nearest_wins(spark, d)) == brute_nearest(children, [("g1", "v1", 0), ("g2", "v2", 1)])


def test_versions_from_elsewhere(spark):
    d = spark.createDataFrame([(1, "maven", "a", ""), (2, "gradle", "a", "1.0"), (3, "maven", "a", "2.0"), (4, "npm", "a", ""), (5, "maven", "b", "latest")], "walk_order long, type string, name string, version string")
    assert rows(G.propagate_versions(d)) == [(1, "maven", "a", "1.0"), (2, "gradle", "a", "1.0"), (3, "maven", "a", "2.0"), (4, "npm", "a", ""), (5, "maven", "b", "latest")]
    m = spark.createDataFrame([("B", "9")], "name string, version string")
    assert rows(G.backfill_managed(d.where("walk_order = 5"), m, any_case=True)) == [(5, "maven", "b", "9")]
    assert rows(G.backfill_managed(d.where("walk_order = 5"), m)) == [(5, "maven", "b", "latest")]


def test_references_leave_self_out(spark):
    d = spark.createDataFrame([("c1", "npm", "lib"), ("c2", "npm", "lib"), ("c3", "npm", "none")], "component_id string, type string, name string")
    p = spark.createDataFrame([("npm", "lib", "c9", 1), ("npm", "lib", "c2", 2)], "type string, package string, component_id string, walk_order long")
    assert rows(G.component_refs(d, p)) == [("c1", "c2", "lib")]


def test_nearest_ancestor(spark):
    p = spark.createDataFrame([("/a/b/c.py",), ("/a/x.py",), ("/z.py",), ("/ab/y.py",)], "path string")
    o = spark.createDataFrame([("/", "root"), ("/a", "A"), ("/a/b", "B")], "dir string, owner string")
    assert {r.path: r.owner for r in G.nearest_ancestor(p, o).collect()} == {"/a/b/c.py": "B", "/a/x.py": "A", "/z.py": "root", "/ab/y.py": "root"}


def test_cache_validity_and_upsert(spark):
    schema = "system string, name string, latest string, not_found boolean, fetched_at long, ttl_seconds long"
    c = spark.createDataFrame([("npm", "a", "1", False, 100, 50), ("npm", "b", "2", False, 10, 50), ("npm", "c", None, True, 100, 50), ("npm", "a", "0", False, 1, 999)], schema)
    k = spark.createDataFrame([("npm", x) for x in "abcd"], "system string, name string")
    assert {r.name: (r.latest, r.not_found, r.hit) for r in G.valid_cache(k, c, F.lit(120)).collect()} == {"a": ("1", False, True), "b": (None, None, False), "c": (None, True, True), "d": (None, None, False)}
    assert {(r.name, r.latest) for r in G.upsert_cache(c, spark.createDataFrame([("npm", "b", "3", False, 200, 5)], schema)).collect()} == {("a", "1"), ("b", "3"), ("c", None)}


def test_forced_lookups_miss(spark):
    c = spark.createDataFrame([("npm", "a", "1", False, 100, 50)], "system string, name string, latest string, not_found boolean, fetched_at long, ttl_seconds long")
    k = spark.createDataFrame([("npm", "a")], "system string, name string")
    assert [r.hit for r in G.valid_cache(k, c, F.lit(120), force=True).collect()] == [False]


def test_online_edges(spark):
    def fetch(system, name, version):
        if name == "down":
            raise OSError("429")
        return [(".", f"{name}@{version}"), (f"{name}@{version}", "x@1")] if name == "a" else None

    w = spark.createDataFrame([("npm", "a", "1"), ("npm", "gone", "2"), ("npm", "down", "3")], "system string, name string, version string")
    assert rows(G.online_edges(w, fetch).fillna("")) == [("a", "1", ".", "a@1", True), ("a", "1", "a@1", "x@1", True), ("gone", "2", "", "", False)]


def test_yaml_paths(spark):
    f = spark.createDataFrame([("a: {b: x1, c: true}",), ("a: [1",), ("- a",), (None,)], "text string")
    ask = lambda p, v: [r[0] for r in f.select(R.content_predicate(F.col("text"), "yaml-path", path=p, value=v)).collect()]
    assert ask("a.b", None) == ask("a.b", "/^x/") == ask("a.c", "true") == [True, False, False, False] and ask("a.b", "x") == [False] * 4


def test_first_source(spark):
    r = spark.createDataFrame([("c", 2, "x"), ("c", 1, "y"), ("d", 3, "z")], "component string, rank int, source string")
    assert rows(G.first_source(r, ["component"], "rank", "source")) == [("c", 1, "y"), ("d", 3, "z")]


def test_bills_of_materials(spark):
    import json
    from datetime import datetime

    d = spark.createDataFrame([("c", "npm", "@s/a", "1.0.0", "prod", True, "", "MIT", 1), ("c", "maven", "g:bom", "1", "import", True, "", "", 2), ("c", "delphi", "x", "1", "", True, "", "", 3), ("c", "hex", "h", "1", "optional", False, "", "", 4)], DEPS)
    comps = sbom.sbom_components(d)
    doc = json.loads(documents.cyclonedx(comps, "root"))
    assert [(c["name"], c.get("purl"), c.get("scope")) for c in doc["components"]] == [("h", None, "optional"), ("@s/a", "pkg:npm/%40s/a@1.0.0", "required")]
    assert doc["metadata"]["component"]["name"] == "root" and doc["components"][1]["licenses"][0]["license"]["id"] == "MIT"
    assert json.loads(sbom.stamp(json.dumps(doc), datetime(2024, 1, 2)))["metadata"]["timestamp"] == "2024-01-02T00:00:00Z"
    assert len(rows(sbom.sbom_components(d, direct_only=True))) == 1
    e = spark.createDataFrame([("nodejs", ".", "@s/a@1.0.0"), ("nodejs", "@s/a@1.0.0", "b@2"), ("dotnet", ".", "n@1"), ("nodejs", ".", "broken")], "component_type string, `from` string, `to` string")
    assert rows(sbom.transitive_components(d, e)) == [("npm", "b", "2", "pkg:npm/b@2")]
    out = json.loads(documents.spdx(comps, "root"))
    assert len(out["packages"]) == 3 and [r["relationshipType"] for r in out["relationships"]] == ["DESCRIBES", "CONTAINS", "CONTAINS"]


def test_package_urls_are_made_once_a_package(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def url(kind, name, version):
        made.add(1)
        return f"pkg:{kind}/{name}@{version}"

    monkeypatch.setattr(sbom, "purl", lambda *columns: F.udf(url)(*columns))
    n = F.col("id") % 3
    d = spark.range(300).select(F.lit("npm").alias("type"), F.concat(F.lit("a"), n).alias("name"), F.lit("1").alias("version"))
    e = spark.range(300).select(F.lit("nodejs").alias("component_type"), F.lit(".").alias("from"), F.concat(F.lit("a"), n + 1, F.lit("@1")).alias("to"))
    assert rows(sbom.transitive_components(d, e)) == [("npm", "a3", "1", "pkg:npm/a3@1")]
    assert made.value == 6  # three packages, three nodes
