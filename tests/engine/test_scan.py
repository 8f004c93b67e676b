import json

import pytest
from pyspark.sql import functions as F

from granary.operators import components
from granary.plans import info, outputs
from granary.plans.scan import aggregate, scan
from granary.sources import config, files, licenses, rules
from granary.streaming import incremental

TREE = {
    "package.json": '{"name": "web", "dependencies": {"react": "^18.0.0", "pg": "8.0.0"}}',
    "package-lock.json": '{"packages": {"": {"dependencies": {"react": "^18.0.0"}}, "node_modules/react": {"version": "18.2.0", "dependencies": {"loose": "1"}}, "node_modules/loose": {"version": "1.4.0"}}}',
    "src/app.ts": "// start\nconst a = 1;\n\nif (a) { go(); }\n/* block\n more */\n",
    "api/pyproject.toml": '[project]\nname = "api"\ndependencies = ["django==4.2", "boto3"]\n',
    "api/main.py": "# note\nimport pytest\nfor x in y:\n    pass\n",
    "api/.env.example": "# c\nREDIS_URL=x\nPOSTGRES_DB=y\n",
    "api/deep/er/util.py": "x = 1\n",
    "svc/go.mod": "module example.com/svc\nrequire github.com/a/b v1.0.0\n",
    "svc/main.go": "package main\n",
    ".gitignore": "dist/\n*.log\n!keep.log\n",
    "dist/out.js": "var x;\n",
    "a.log": "x",
    "keep.log": "x",
    "Dockerfile": "FROM postgres:16\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def test_listing_keeps_what_ignore_files_keep(spark, tree):
    got = {r.path for r in files.scan(spark, tree).collect()}
    assert got == {"/" + n for n in TREE} - {"/dist/out.js", "/a.log"}
    assert {r.path for r in files.scan(spark, tree, exclude=["**/*.py"]).collect()} == got - {"/api/main.py", "/api/deep/er/util.py"}
    assert {r.path for r in files.scan(spark, tree, include=["svc"]).collect()} == {"/svc/go.mod", "/svc/main.go"}


def test_listing_has_underscore_names(spark, tmp_path):
    names = ["main.py", "pkg/__init__.py", "__tests__/x.js", "__tests__/_deep/.y/z.js", "_config.yml", ".github/_a/b.yml", ".git/config", "_metadata", "_p=1/q.py", "_p=1.py", "a=1/_x/k.py"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    want = sorted("/" + n for n in names if n != ".git/config")
    assert sorted(r.path for r in files.listing(spark, str(tmp_path)).collect()) == want
    kept = files.scan(spark, str(tmp_path))
    assert sorted(r.path for r in files.with_text(spark, str(tmp_path), kept).collect()) == want


def test_large_and_deep_hidden_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PART_BYTES", 1000)
    assert files._parts([("z", 0), ("a", 600), ("b", 400), ("c", 5000), ("d", 1)], 1000) == [["z", "a", "b"], ["c"], ["d"]]
    deep = tmp_path.joinpath(*[f"d{k}" for k in range(14)])
    deep.mkdir(parents=True)
    (deep / ".gitignore").write_text("gone.py\n")
    (deep / "gone.py").write_text("x = 1\n")
    (tmp_path / ".pnp.cjs").write_text("x\n" * files.MOST_LICENSE_BYTES)
    texts = {r.name: len(r.text) for r in files.with_text(spark, str(tmp_path), files.scan(spark, str(tmp_path))).collect()}
    assert texts == {".gitignore": 8, ".pnp.cjs": 2 * files.MOST_LICENSE_BYTES}


def test_listing_reads_no_content(spark, tree):
    plan = files.listing(spark, tree)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan


def test_lines(spark, tree):
    got = {r.path: (r.lines, r.blanks, r.comments, r.code, r.complexity) for r in files.code_lines(files.with_text(spark, tree, files.scan(spark, tree))).collect()}
    assert got["/src/app.ts"] == (6, 1, 3, 2, 1)
    assert got["/api/main.py"] == (4, 0, 1, 3, 1)


def test_scan(spark, tree):
    settings = config.Settings(graph="full", subsystem_depth=1)
    s = scan(spark, tree, settings)
    found = {(r["name"], r["type"]): sorted(r["tech"]) for r in s.components.collect()}
    assert set(found) == {("web", "nodejs"), ("api", "python"), ("example.com/svc", "golang"), ("svc", "golang"), ("main", "")} - {("svc", "golang")}
    assert {"react", "postgresql", "docker", "typescript"} - {"typescript"} <= set(found["web", "nodejs"])
    assert {"aws", "django", "postgresql", "pytest", "python", "redis"} <= set(found["api", "python"])
    owner = {r.path: r.component_id for r in s.files.collect()}
    assert owner["/api/deep/er/util.py"] == owner["/api/main.py"] != owner["/src/app.ts"]
    assert ("react@18.2.0", "loose@1.4.0") in {(r["from"], r["to"]) for r in s.edges.collect()}
    nested = json.loads(components.tree(s.components, s.root_id, {"dependencies": s.dependencies, "licenses": s.licenses}))
    assert nested["name"] == "main" and {c["name"] for c in nested["children"]} == {"web"}
    web = nested["children"][0]
    assert {c["name"] for c in web["children"]} == {"api", "example.com/svc"}
    assert {d["name"]: (d["version"], d["declared"]) for d in web["dependencies"] if d["type"] == "npm"} == {"react": ("18.2.0", "^18.0.0"), "pg": ("8.0.0", None)}
    parts = aggregate(spark, s, settings)
    assert {(r["name"], r["version"]) for r in parts["dependencies"].collect()} >= {("react", "18.2.0"), ("django", "4.2"), ("github.com/a/b", "v1.0.0"), ("postgres", "16")}
    eco = {r["ecosystem"]: r["components"] for r in parts["ecosystems"].collect()}
    assert eco["python"] == 1 and eco["node"] == 1 and eco["go"] == 1
    doc = json.loads(outputs.full_json(s.root_id, parts, omit=["reasons"]))
    assert "reasons" not in doc and len(doc["techs"]) >= 6
    text = outputs.summary(parts)
    assert "Python" in text and "Primary" in text
    assert parts["subsystems"].count() >= 2


def test_parents_and_references(spark):
    c = spark.createDataFrame([("r", "main", "", "/"), ("a", "a", "nodejs", "/a"), ("b", "b", "nodejs", "/a/x/b"), ("c", "My_Lib", "python", "/c")], "component_id string, name string, type string, dir string")
    assert {r.component_id: (r.parent_id, r.depth) for r in components.with_parents(c, "r").collect()} == {"r": (None, 0), "a": ("r", 1), "b": ("a", 2), "c": ("r", 1)}
    d = spark.createDataFrame([("a", "npm", "b"), ("b", "npm", "b"), ("a", "pypi", "my-lib")], "component_id string, type string, name string")
    assert sorted(tuple(r) for r in components.references(d, c).collect()) == [("a", "b", "b"), ("a", "c", "my-lib")]


def test_license_files(spark):
    f = spark.createDataFrame([("/LICENSE", "LICENSE", 10, "Apache License\n   Version 2.0, January"), ("/x/COPYING.txt", "COPYING.txt", 10, "GNU GENERAL PUBLIC LICENSE\nVersion 3"), ("/y/license.py", "license.py", 10, "nothing"), ("/z/LICENSE", "LICENSE", 10**9, "Apache License Version 2.0")], "path string, name string, length long, text string")
    assert sorted((r.path, r.license, r.category) for r in licenses.detect_files(f).collect()) == [("/LICENSE", "Apache-2.0", "notice"), ("/x/COPYING.txt", "GPL-3.0", "restricted")]


def test_listings(capsys):
    from granary.__main__ import main

    assert main(["info", "techs", "--format", "json"]) == 0
    assert {t["tech"] for t in json.loads(capsys.readouterr().out)} >= {"react", "django"}
    assert "Python" in info.show(info.languages()) and info.categories()[0]["techs"] >= 1
    assert info.rule("react")[0]["name"] == "React" and "node" in info.show(info.ecosystems(), "yaml")


def test_only_rules(spark, tree):
    s = scan(spark, tree, config.Settings(), rules.Rules(only=["django"]))
    assert {r.tech for r in s.reasons.collect()} == {"django"}


def test_rule_folder(tmp_path):
    (tmp_path / "database").mkdir()
    (tmp_path / "database" / "x.yaml").write_text("tech: x\nname: X\ndependencies:\n  - type: npm\n    name: /^x-/\n  - type: npm\n    name: x\nfiles: [x.conf, '*.xx', '.x/y']\n")
    (tmp_path / "database" / "_types.yaml").write_text("a: b\n")
    found = rules.read_rules(str(tmp_path))
    assert found[0]["type"] == "database" and rules.check(found) == []
    parts = rules.Rules(found)
    assert (parts.exact, parts.regexes, parts.names, parts.globs, parts.directories) == ([("x", "npm", "x")], [("x", "npm", "^x-")], [("x", "x.conf")], [("x", "*.xx")], [("x", "/.x/y")])
    assert rules.check([{"tech": "a"}]) == ["rule 0: no name", "rule 0: no type"]
    assert rules.check(rules.STARTER) == []


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("exclude: [a]\nroot_id: ${ID}\n")
    values = config.read(str(tmp_path / "c.yaml"), {"ID": "me"})
    s = config.layered(values, config.from_environment({"GRANARY_EXCLUDE": "b, c", "GRANARY_PRIMARY_LANGUAGES": "3"}), {"graph": "direct"})
    assert (s.root_id, s.exclude, s.primary_languages, s.graph) == ("me", ("a", "b", "c"), 3, "direct")
    assert config.read('{"graph": "x"}') == {"graph": "x"} and config.check({"graph": "x", "y": 1}) == ["unknown setting y", "graph is one of off, direct, full"]


def test_git_info(tmp_path):
    git = tmp_path / ".git"
    (git / "refs/heads").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    (git / "refs/heads/main").write_text("0123456789abcdef" * 2 + "01234567\n")
    (git / "config").write_text('[remote "origin"]\n\turl = https://u:p@h.com/o/r.git\n')
    assert config.git_info(str(tmp_path)) == {"branch": "main", "commit": "0123456", "remote_url": "https://h.com/o/r.git"}
    assert config.git_info(str(tmp_path / "sub")) == {}
    assert config.common_parent(["/a/b/c", "/a/d"]) == ("/a", ["b/c", "d"])


def test_wire_form(spark):
    d = spark.createDataFrame([("npm", 'a"b', "1", "dev", True, "f", ""), ("pypi", "c", "", "", False, "", "MIT")], "type string, name string, version string, scope string, direct boolean, source string, license string")
    wire = outputs.dependency_wire(d)
    assert sorted(json.loads(r.wire) for r in wire.collect()) == [["npm", 'a"b', "1", "dev", True, {"source": "f"}], ["pypi", "c", "", "", False, {"license": "MIT"}]]
    assert sorted(tuple(r) for r in outputs.read_wire(wire).collect()) == [("npm", 'a"b', "1", "dev", True), ("pypi", "c", "", "", False)]
    objects = spark.createDataFrame([('{"type":"npm","name":"x","direct":true}',)], "wire string")
    assert [tuple(r) for r in outputs.read_wire(objects).collect()] == [("npm", "x", "", "", True)]


def test_saved_scan(spark, tmp_path):
    doc = {"id": "r", "name": "main", "tech": [], "children": [{"id": "c", "name": "x", "type": "nodejs", "tech": ["a"], "dependencies": [["npm", "y", "1", "prod", True, {}]], "children": [{"id": "d", "name": "z"}]}]}
    (tmp_path / "s.json").write_text(json.dumps(doc))
    got = {r.component_id: (r.parent_id, r.depth, r.dependencies) for r in outputs.saved_components(spark, str(tmp_path / "s.json")).collect()}
    assert got["c"][:2] == ("r", 1) and got["d"][:2] == ("c", 2) and json.loads(got["c"][2][0])[1] == "y"


def test_currency(spark):
    d = spark.createDataFrame([("npm", "a", "1.0.0", True), ("npm", "b", "^1", True), ("npm", "c", "1.0.0", True), ("npm", "d", "1.0.0", True), ("delphi", "e", "1", True), ("npm", "f", "1.0.0", False)], "type string, name string, version string, direct boolean")
    cache = spark.createDataFrame([("npm", "a", "1.2.0", False, 100, 50), ("npm", "c", None, True, 100, 50), ("npm", "d", "2.0.0", False, 1, 5)], "system string, name string, latest string, not_found boolean, fetched_at long, ttl_seconds long")
    rows = outputs.currency(d, cache, F.lit(120))
    assert {r.name: r.bucket for r in rows.collect()} == {"a": "minor", "b": "unpinned", "c": "unknown", "d": "error", "e": "unsupported"}
    total = outputs.currency_summary(rows).first()
    assert (total.total, total.minor, total.error) == (5, 1, 1)

    def fetch(system, name):
        if name == "c":
            raise OSError("down")
        return "9.0.0", True

    fresh = outputs.refresh(cache, rows.where("bucket IN ('error', 'unknown')"), fetch, 200)
    assert {r.name: (r.latest, r.fetched_at) for r in fresh.collect()} == {"a": ("1.2.0", 100), "c": (None, 100), "d": ("9.0.0", 200)}


def test_license_harvest(spark):
    d = spark.createDataFrame([("npm", "a", "1", "MIT"), ("npm", "b", "1", ""), ("npm", "c", "1", "")], "type string, name string, version string, license string")
    f = spark.createDataFrame([("/node_modules/b/package.json", '{"name":"b","version":"1","license":"apache2"}'), ("/node_modules/a/package.json", '{"name":"a","version":"1","license":"ISC"}'), ("/x.nuspec", "<package><id>n</id><version>1</version><license type=\"expression\">MIT</license></package>")], "path string, text string")
    assert {r.name: r.license for r in licenses.harvest(d, licenses.from_package_json(f)).collect()} == {"a": "MIT", "b": "Apache-2.0", "c": ""}
    assert [tuple(r) for r in licenses.from_nuspec(f).collect()] == [("nuget", "n", "1", "MIT")]


def test_manifest_stream(spark, tree):
    q = incremental.manifest_stream(spark, tree).writeStream.format("memory").queryName("deps_seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.name for r in spark.sql("SELECT name FROM deps_seen WHERE error IS NULL").collect()} >= {"react", "django", "boto3"}


def test_windowed_stream_and_cache_sink(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = incremental.windowed_counts(stream, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("counts_seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = src.groupBy(F.window("ts", "10 minutes"), "event_type").count().count()
    assert spark.sql("SELECT count(*) FROM counts_seen").first()[0] == want
    rows = stream.selectExpr("event_type AS system", "concat('u', user_id % 5) AS name", "cast(event_id AS string) AS latest", "false AS not_found", "event_id AS fetched_at", "10L AS ttl_seconds")
    q = rows.writeStream.foreachBatch(incremental.cache_sink(str(tmp_path / "cache"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "cache/epoch=0")).count() == src.selectExpr("event_type", "user_id % 5").distinct().count()


def test_ignore_files_hold_below_their_directory(spark, tmp_path, monkeypatch):
    """Layers: a directory's patterns hold for what lies below it; .git/info/exclude before them; ignored directories are not entered."""
    texts = {
        ".gitignore": "*.log\nnode_modules/\nvendor/**\n!vendor/keep.go\n", "a/.gitignore": "*.txt\n!debug.log\n", ".git/info/exclude": "*.tmp\n!b/kept.log\n", ".git/config": "x",
        "a/x.txt": "1", "a/debug.log": "1", "a/deep/y.txt": "1", "b/y.txt": "1", "r.txt": "1", "debug.log": "1", "b/kept.log": "1", "b/z.tmp": "1", "b/c/error.log": "1",
        "node_modules/m/i.js": "1", "b/node_modules/j.js": "1", "b/node_modules/.bin/k": "1", "b/_p/__init__.py": "1", "vendor/keep.go": "1", "vendor/junk.go": "1", "x=1/a.py": "1",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    want = ["/.gitignore", "/r.txt", "/a/.gitignore", "/a/debug.log", "/b/y.txt", "/b/_p/__init__.py", "/x=1/a.py"]
    kept = files.read(spark, str(tmp_path)).orderBy("walk_order").collect()
    assert [r.path for r in kept] == want and all(r.text == texts[r.path[1:]] for r in kept)
    assert sorted(r.path for r in files.scan(spark, str(tmp_path)).collect()) == sorted(want)
    assert sorted(r.path for r in files.scan(spark, str(tmp_path), include=["b", "a/debug.log"]).collect()) == ["/a/debug.log", "/b/_p/__init__.py", "/b/y.txt"]
    # Executors that walk and read give the same.
    monkeypatch.setattr(files, "DRIVER_DIRECTORIES", 3)
    assert files.walk(spark, str(tmp_path), exclude=(), most=3) is None
    walked = files.read(spark, str(tmp_path)).orderBy("walk_order").collect()
    columns = [c for c in kept[0].asDict() if c != "uri"]
    assert [[r[c] for c in columns] for r in walked] == [[r[c] for c in columns] for r in kept]
    assert sorted(r.path for r in files.scan(spark, str(tmp_path)).collect()) == sorted(want)
    assert sorted(r.path for r in files.scan(spark, str(tmp_path), include=["b", "a/debug.log"]).collect()) == ["/a/debug.log", "/b/_p/__init__.py", "/b/y.txt"]
    assert sorted(r.path for r in files.scan(spark, str(tmp_path), exclude=["*.py", "!b/c/error.log"]).collect()) == sorted(p for p in want if not p.endswith(".py"))
    monkeypatch.undo()
    # A walk by the store's client gives the same as one by the driver's own disk.
    local, store = files.walk(spark, str(tmp_path), exclude=()), None
    before = files.os.path.isdir
    try:
        files.os.path.isdir = lambda _: False
        store = files.walk(spark, str(tmp_path), exclude=())
    finally:
        files.os.path.isdir = before
    assert sorted(store.roots) == sorted(local.roots) and sorted(store.hidden) == sorted(local.hidden) and store.patterns == local.patterns


def test_properties_of_users():
    from granary.operators.sbom import user_properties

    got = user_properties({"team": "core", "a": 3, "on": True, "list": [1], "none": None, "map": {}})
    assert got == [{"name": "a", "value": "3"}, {"name": "on", "value": "true"}, {"name": "team", "value": "core"}]


def test_single_file(spark, tree):
    got = files.read(spark, tree + "/api", include=["main.py"]).collect()
    assert [(r.path, r.text) for r in got] == [("/main.py", TREE["api/main.py"])]


def test_broken_files_are_errors_and_the_scan_goes_on(spark, tmp_path):
    deep = '{"a":' * 3000 + "1" + "}" * 3000
    texts = {"a/pnpm-lock.yaml": "lockfileVersion: '9.0'\npackages: {unclosed: [", "b/package-lock.json": deep, "c/Cargo.lock": 'version = 3\n[[package]]\nname = "x"\nversion = "1.0.0"\ndependencies = ["y"]\n[[package]]\nname = "y"\nversion = "2.0.0"\n', "d/poetry.lock": "[[package]\nname=", "e/package.json": '{"dependencies": {"react": "18.0.0"}}'}
    for path, text in texts.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    s = scan(spark, str(tmp_path), config.Settings(graph="full"))
    assert ("x@1.0.0", "y@2.0.0") in {(r["from"], r["to"]) for r in s.edges.collect()}
    assert {"/a/pnpm-lock.yaml", "/d/poetry.lock"} <= {r.path for r in s.errors.collect()}
    assert "react" in {r.name for r in s.dependencies.collect()}


def test_executors_walk_deep_trees_with_odd_names(spark, tmp_path, monkeypatch):
    """More levels than tables are kept apart, blanks and marks in names, empty directories and files, a UTF-16 text."""
    deep = "/".join(f"d{k}" for k in range(11))
    texts = {f"{deep}/end.txt": b"deep", "a b/c%20d#.py": b"x = 1\n", "_x/.hidden/__init__.py": b"", "é/ü.md": "# ü".encode("utf-16"), ".git/config": b"x", "z.txt": b""}
    for name, raw in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "empty").mkdir()
    monkeypatch.setattr(files, "DRIVER_DIRECTORIES", 1)
    got = {r.path: (r.length, r.text) for r in files.read(spark, str(tmp_path)).collect()}
    assert got == {f"/{n}": (len(raw), "# ü" if n.endswith(".md") else raw.decode()) for n, raw in texts.items() if not n.startswith(".git/")}
    assert files.read(spark, str(tmp_path / "empty")).count() == 0


def test_names_of_components_are_their_own(spark):
    """Names of authors, tools, parents and remarks are no component's; without one the directory's stands."""
    texts = {
        "/a/package.json": ('{"author":{"name":"Bob"},"name":"app"}', "app"), "/b/package.json": ('{"author":{"name":"Bob"}}', "b"), "/c/package.json": ("broken {", "c"),
        "/d/composer.json": ('{"authors":[{"name":"Bob"}],"name":"x/y"}', "x/y"), "/e/Cargo.toml": ('[package]\nversion = "1"\n[[bin]]\nname = "tool"\n', "e"), "/f/Cargo.toml": ("[lib]\nname = 'l'\n [package] # it\nname = 'own'\n", "own"),
        "/g/pyproject.toml": ('[tool.black]\nname = "no"\n[tool.poetry]\nname = "po"\n', "po"), "/h/pyproject.toml": ('[tool.poetry]\nname = "po"\n[project]\nname = "pro"\n', "pro"),
        "/i/pom.xml": ("<project><build><plugins><plugin><artifactId>p</artifactId></plugin></plugins></build>" + "<!-- x -->" * 5000 + "<artifactId> own </artifactId></project>", "own"),
        "/j/project.json": ('{"targets":{"name":"t"},"name":"lib","projectType":"library"}', "lib"), "/k/project.json": ('{"name":"other"}', None), "/l/deno.jsonc": ('{ // c\n "name": "d" }', "d"), "/m/setup.py": ("name = 'no'\n", "m"),
    }
    files_ = spark.createDataFrame([(p, p.rsplit("/", 1)[0], t) for p, (t, _) in texts.items()], "path string, dir string, text string")
    from granary.plans.scan import detect

    assert {r.path: r["name"] for r in detect(files_, "root").collect()} == {p: n for p, (_, n) in texts.items() if n}
