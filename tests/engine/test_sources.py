import io
import json

import pytest
from pyspark.sql import functions as F

from granary.__main__ import main
from granary.operators import listings, maven
from granary.plans import outputs, progress
from granary.plans.scan import scan
from granary.sources import config, poms, rules
from granary.streaming import incremental


def put(root, tree):
    for name, text in tree.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


TREE = {
    "package.json": '{"name": "top", "workspaces": ["packages/*"], "dependencies": {"left": "^1.0.0"}}',
    "package-lock.json": '{"packages": {"": {"dependencies": {"left": "^1.0.0"}}, "node_modules/left": {"version": "1.3.0"}, "node_modules/right": {"version": "2.5.0"}}}',
    "packages/a/package.json": '{"name": "a", "dependencies": {"right": "^2.0.0", "absent": "^3.0.0"}}',
    "gradle.properties": "# versions\nkt=1.9\nkt = 2.0\nboot: 3.${kt}\n",
    "svc/gradle.properties": "own=9\n",
    "svc/build.gradle": 'dependencies {\n  implementation "g:one:$kt"\n  implementation "g:two:${boot}"\n  implementation "g:three:$own"\n  implementation "g:four:$nowhere"\n}\n',
    "net/Directory.Packages.props": '<Project><ItemGroup><PackageVersion Include="Serilog" Version="3.1.1" /></ItemGroup></Project>',
    "net/App/App.csproj": '<Project Sdk="x"><ItemGroup><PackageReference Include="serilog" /><PackageReference Include="Other" /></ItemGroup></Project>',
    "gen/out.py": "x = 1\n",
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    heard = []
    settings = config.layered({"reclassify": [{"match": "gen/**", "type": "generated"}]})
    root = put(tmp_path_factory.mktemp("above"), TREE)
    return scan(spark, root, settings, report=lambda event, **about: heard.append(event)), heard


def test_versions_from_directories_above(found):
    got = {(r["type"], r["name"]): (r["version"], r["declared"]) for r in found[0].dependencies.collect()}
    assert got["npm", "right"] == ("2.5.0", "^2.0.0") and got["npm", "left"] == ("1.3.0", "^1.0.0") and got["npm", "absent"] == ("^3.0.0", None)
    assert {n: got["gradle", f"g:{n}"][0] for n in ("one", "two", "three", "four")} == {"one": "2.0", "two": "3.2.0", "three": "9", "four": "$nowhere"}
    assert got["nuget", "serilog"][0] == "3.1.1" and got["nuget", "Other"][0] == "latest"


def test_package_managers_and_reclassified_files(found):
    s, heard = found
    assert {"npm", "gradle"} <= {r.tech for r in s.reasons.collect()}
    assert {r.path: (r.language, r.language_type) for r in s.files.collect()}["/gen/out.py"] == (None, "generated")
    assert heard == ["scan_start", "components", "scan_complete"]
    assert config.check({"reclassify": [{"match": "a"}, {"match": "a", "type": "b"}]}) == ["reclassify 0: no match, or neither language nor type"]


def test_starter_rules_are_of_known_kinds():
    kinds = {c for c, *_ in rules.CATEGORIES}
    assert {r["type"] for r in rules.STARTER} <= kinds and len({r["tech"] for r in rules.STARTER}) == len(rules.STARTER)
    assert ("npm", "package-lock.json") in rules.Rules().late_names and not rules.Rules(only=["react"]).late_names


def test_progress_handlers(spark):
    parts = {"found": spark.createDataFrame([("/", "m", "nodejs"), ("/a/b", "n", "python")], "dir string, name string, type string"), "files": spark.range(1234)}
    for name, wanted in {"none": [], "simple": ["scan_start root=r", "components"], "tree": ["/  m (nodejs)", "    /a/b  n (python)"], "summary": ["1,234 files, 2 components", "scan i in 0.0 s"]}.items():
        out = io.StringIO()
        handle = progress.HANDLERS[name](out, lambda: 0.0) if name != "none" else progress.HANDLERS[name](out)
        handle("scan_start", root="r")
        handle("components", **parts)
        handle("scan_complete", root_id="i")
        assert all(x in out.getvalue() for x in wanted) and (wanted or not out.getvalue())


def test_documents_beside_a_scan(spark, tmp_path, capsys):
    root = put(tmp_path / "t", {"package.json": '{"name": "w", "dependencies": {"react": "18.0.0", "zod": "^3"}}'})
    cache = str(tmp_path / "cache")
    spark.createDataFrame([("npm", "react", "18.0.1", False, 1, 10**11)], outputs.CACHE_SCHEMA).write.parquet(cache)
    out = str(tmp_path / "o.json")
    assert main(["tree", root, "--output", out, "--also", "aggregate,sbom,currency", "--currency-cache", cache, "--progress", "simple"]) == 0
    assert outputs.companions(out) == {"aggregate": str(tmp_path / "o-agg.json"), "sbom": str(tmp_path / "o.cdx.json"), "currency": str(tmp_path / "o.currency.json")}
    assert outputs.companions("x.json", "spdx")["sbom"] == "x.spdx.json"
    docs = {n: json.loads((tmp_path / n).read_text()) for n in ("o.json", "o-agg.json", "o.cdx.json", "o.currency.json")}
    assert docs["o.json"]["name"] == "main" and "react" in docs["o-agg.json"]["techs"][0].values() or "react" in str(docs["o-agg.json"]["techs"])
    assert docs["o.cdx.json"]["bomFormat"] == "CycloneDX"
    report = docs["o.currency.json"]
    assert {d["name"]: d["currency"] for d in report["dependencies"]} == {"react": "patch", "zod": "unpinned"}
    assert report["summary"]["total"] == 2 and report["summary"]["resolved"] == 1
    assert "scan_start" in capsys.readouterr().err
    assert main(["currency", str(tmp_path / "o-agg.json"), "--currency-cache", cache]) == 0
    again = json.loads(capsys.readouterr().out)
    assert again["dependencies"] == report["dependencies"] and again["ttl_hours"] == 24
    with pytest.raises(SystemExit):
        main(["scan", root, "--also", "sbom"])


def test_cache_sink_goes_on_after_a_restart(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, outputs.CACHE_SCHEMA)
    write, path = incremental.cache_sink(str(tmp_path / "c")), str(tmp_path / "c")
    assert incremental.last_epoch(spark, path) is None
    write(rows(("npm", "a", "1", False, 1, 9)), 0)
    write(rows(("npm", "b", "1", False, 1, 9)), 1)
    write(rows(("npm", "b", "1", False, 1, 9)), 1)  # the same batch once more
    write(rows(("npm", "a", "2", False, 5, 9)), 0)  # a stream that begins anew
    (tmp_path / "c/epoch=9").mkdir()  # a write that did not end
    last = incremental.last_epoch(spark, path)
    assert sorted((r.name, r.latest) for r in spark.read.parquet(f"{path}/epoch={last}").collect()) == [("a", "2"), ("b", "1")]


def pom(name, version, parent="", deps=(), managed=()):
    one = lambda n, v, scope="": f"<dependency><groupId>{n.split(':')[0]}</groupId><artifactId>{n.split(':')[1]}</artifactId>{f'<version>{v}</version>' if v else ''}{f'<scope>{scope}</scope>' if scope else ''}</dependency>"
    up = f"<parent><groupId>{parent.split(':')[0]}</groupId><artifactId>{parent.split(':')[1]}</artifactId><version>{parent.split(':')[2]}</version></parent>" if parent else ""
    return f"<project>{up}<groupId>{name.split(':')[0]}</groupId><artifactId>{name.split(':')[1]}</artifactId><version>{version}</version><dependencies>{''.join(one(*d) for d in deps)}</dependencies><dependencyManagement><dependencies>{''.join(one(*d) for d in managed)}</dependencies></dependencyManagement></project>"


def test_poms_are_fetched_level_by_level(spark, tmp_path):
    repository = {("q.up:parent", "1"): pom("q.up:parent", "1", managed=[("q:two", "2")]), ("q:two", "2"): pom("q:two", "2", deps=[("q:three", "3"), ("q:gone", "1"), ("q:testing", "1", "test")]), ("q:three", "3"): pom("q:three", "3", deps=[("q:two", "2")])}
    put(tmp_path, {poms.pom_path(*k): v for k, v in repository.items()})
    own = maven.read_poms(spark.createDataFrame([("/pom.xml", pom("q:one", "1", "q.up:parent:1", deps=[("q:two", "")]))], "path string, text string"))

    def down(name, version):
        return "failed", ""

    every, lookups = poms.crawl(spark, own, [("broken", down), ("disk", poms.local(str(tmp_path)))], parallel=2)
    assert sorted(r.name for r in every.collect()) == ["q.up:parent", "q:one", "q:three", "q:two"]
    counts = {r.source: r.asDict() for r in listings.resolver_counts(lookups).collect()}
    assert counts["broken"]["failed"] == counts["disk"]["lookups"] == 4 and (counts["disk"]["fetched"], counts["disk"]["missing"]) == (3, 1)
    kids = {(r.parent, r.child, r.child_version) for r in maven.child_table(every).collect()}
    assert {("q:one", "q:two", "2"), ("q:two", "q:three", "3"), ("q:three", "q:two", "2")} <= kids


def test_no_pom_wanted(spark):
    every, lookups = poms.crawl(spark, maven.read_poms(spark.createDataFrame([], "path string, text string")), [])
    assert every.count() == 0 and lookups.count() == 0


def test_places_and_settings_of_repositories(tmp_path):
    assert poms.pom_path("a.b:c", "1") == "a/b/c/1/c-1.pom" and poms.local(str(tmp_path))("a:b", "1") == ("missing", "")
    assert [poms.pom_path(*x) for x in (("a:b", ""), ("a", "1"), ("..:b", "1"), ("a:b", "../1"))] == [""] * 4
    settings = poms.read_settings("""<settings xmlns="x"><servers><server><id>m</id><username>u</username><password>p</password></server></servers>
<mirrors><mirror><id>m</id><mirrorOf>*,!in</mirrorOf><url>http://m</url></mirror></mirrors>
<profiles><profile><repositories><repository><id>in</id><url>http://in</url></repository><repository><id>r</id><url>http://r</url></repository></repositories></profile></profiles></settings>""")
    assert poms.remotes(settings, lambda *x: x) == [("http://in", "", ""), ("http://m", "u", "p")]


def test_remote_answers(monkeypatch):
    import urllib.error
    import urllib.request

    asked = []

    def answer(request, timeout):
        asked.append((request.full_url, request.get_header("Authorization")))
        code = {"gone": 404, "busy": 503, "no": 403}.get(request.full_url.split("/")[4])
        if code:
            raise urllib.error.HTTPError(request.full_url, code, "", {}, None)
        return io.BytesIO(b"<project/>")

    monkeypatch.setattr(urllib.request, "urlopen", answer)
    fetch = poms.remote("http://h/", "u", "p")
    assert fetch("g:ok", "1") == ("fetched", "<project/>") and asked[0] == ("http://h/g/ok/1/ok-1.pom", "Basic dTpw")
    assert [fetch(f"g:{n}", "1")[0] for n in ("gone", "busy", "no", "ok")] == ["missing", "failed", "denied", "denied"] and len(asked) == 4
