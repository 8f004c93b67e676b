import json

import pytest

from granary.sources import lockgraphs as G
from granary.sources import manifests as M


def deps(f, text, *more):
    return sorted((d.name, d.version, d.scope, d.direct) for d in f(text, *more))


CASES = {
    "package.json": ('{"name":"x","dependencies":{"a":"^1","w":"workspace:*"},"devDependencies":{"b":""},"peerDependencies":{"c":"npm:2"}}', {("npm", "a", "^1", "prod"), ("npm", "w", "workspace", "prod"), ("npm", "b", "latest", "dev"), ("npm", "c", "2", "peer")}),
    "package-lock.json": ('{"packages":{"":{"dependencies":{"a":"^1"},"devDependencies":{"b":"1"}},"node_modules/a":{"version":"1.2.0"},"node_modules/b":{"version":"1.0.0","dev":true},"node_modules/t":{"version":"3"},"node_modules/a/node_modules/b":{"version":"0.1"}}}', {("npm", "a", "1.2.0", "prod"), ("npm", "b", "1.0.0", "dev")}),
    "requirements.txt": ("# c\nDjango==4.2  # web\nrequests[security]>=2.0,<3 ; python_version > '3'\n-r other.txt\nPy_Yaml\nhttps://x/y\nnumpy~=1.2 --hash=sha256:1\n", {("pypi", "django", "4.2", "prod"), ("pypi", "requests", ">=2.0,<3", "prod"), ("pypi", "py-yaml", "latest", "prod"), ("pypi", "numpy", "1.2", "prod")}),
    "pyproject.toml": ('[project]\ndependencies=["a>=1","b"]\n[project.optional-dependencies]\ntest=["c==2"]\n[tool.poetry.dependencies]\npython="^3"\nd="^1"\n', {("pypi", "a", ">=1", "prod"), ("pypi", "b", "latest", "prod"), ("pypi", "c", "2", "dev"), ("pypi", "d", "^1", "prod")}),
    "poetry.lock": ('[[package]]\nname="A_b"\nversion="1"\n[[package]]\nname="c"\nversion="2"\ncategory="dev"\n', {("pypi", "a-b", "1", "prod"), ("pypi", "c", "2", "dev")}),
    "uv.lock": ('[[package]]\nname="me"\nversion="0"\nsource={editable="."}\ndependencies=[{name="a"}]\n[[package]]\nname="a"\nversion="3"\n', {("pypi", "a", "3", "")}),
    "Cargo.toml": ('[package]\nname="x"\n[dependencies]\nserde="1.0"\nlocal={path="../l"}\ngit={git="u",tag="t"}\n[dev-dependencies]\nt={version="2"}\n', {("cargo", "serde", "1.0", "prod"), ("cargo", "local", "path:../l", "prod"), ("cargo", "git", "git:u#t", "prod"), ("cargo", "t", "2", "prod")}),
    "go.mod": ("module m\ngo 1.22\nrequire (\n\tgithub.com/a/b v1.0.0\n\tgithub.com/c/d v2.0.0 // indirect\n)\nrequire x.y/z v0.1.0\n", {("golang", "github.com/a/b", "v1.0.0", "prod"), ("golang", "x.y/z", "v0.1.0", "prod")}),
    "composer.json": ('{"require":{"php":">=8","ext-json":"*","a/b":"^1"},"require-dev":{"c/d":"2"}}', {("composer", "a/b", "^1", "prod"), ("composer", "c/d", "2", "dev")}),
    "Gemfile": ("source 'x'\ngem 'rails', '~> 7'\ngroup :development, :test do\n  gem 'rspec'\nend\ngem \"pg\"\n", {("gem", "rails", "~> 7", "prod"), ("gem", "rspec", "latest", "dev"), ("gem", "pg", "latest", "prod")}),
    "Gemfile.lock": ("GEM\n  remote: x\n  specs:\n    a (1.0)\n      b (>= 1)\n    b (2.0)\n\nDEPENDENCIES\n  a\n", {("gem", "a", "1.0", "prod")}),
    "Podfile": ("pod 'A', '~> 1'\n# pod 'X'\npod \"B\"\n", {("cocoapods", "A", "~> 1", ""), ("cocoapods", "B", "latest", "")}),
    "Podfile.lock": ("PODS:\n  - A (1.0):\n    - B\n  - B (2.0)\n\nDEPENDENCIES:\n  - A\n", {("cocoapods", "A", "1.0", ""), ("cocoapods", "B", "2.0", "")}),
    "mix.lock": ('%{\n  "a": {:hex, :a, "1.0", "h", [:mix], [{:b, "~> 1", [hex: :b]}], "hexpm"},\n  "b": {:hex, :b, "2.0", "h", [:mix], [], "hexpm"},\n}\n', {("hex", "a", "1.0", ""), ("hex", "b", "2.0", "")}),
    "Package.resolved": ('{"version":2,"pins":[{"identity":"a","state":{"version":"1.0"}},{"identity":"b","state":{"branch":"main"}}]}', {("swift", "a", "1.0", ""), ("swift", "b", "main", "")}),
    "cpanfile.snapshot": ("# x\nDISTRIBUTIONS\n  A-B-1.2\n    pathname: p\n    provides:\n      A::B 1.2\n    requirements:\n      C 0\n  C-3\n    provides:\n      C 3\n", {("cpan", "A-B", "1.2", ""), ("cpan", "C", "3", "")}),
    "renv.lock": ('{"Packages":{"a":{"Package":"a","Version":"1","Requirements":["b","utils"]},"b":{"Package":"b","Version":"2"}}}', {("cran", "a", "1", ""), ("cran", "b", "2", "")}),
    "pom.xml": ('<project xmlns="x"><parent><groupId>g</groupId><artifactId>p</artifactId><version>1</version></parent><artifactId>a</artifactId><properties><v>2.0</v></properties><dependencyManagement><dependencies><dependency><groupId>m</groupId><artifactId>n</artifactId><version>5</version></dependency><dependency><groupId>b</groupId><artifactId>bom</artifactId><version>7</version><type>pom</type><scope>import</scope></dependency></dependencies></dependencyManagement><dependencies><dependency><groupId>x</groupId><artifactId>y</artifactId><version>${v}</version><scope>test</scope></dependency><dependency><groupId>m</groupId><artifactId>n</artifactId></dependency></dependencies></project>', {("maven", "x:y", "2.0", "dev"), ("maven", "m:n", "5", "prod"), ("maven", "b:bom", "7", "import")}),
    "build.gradle": ("ext.ver = '3.1'\nplugins {\n  id 'java'\n  id('org.x') version '2'\n}\ndependencies {\n  implementation 'a:b:1.0'\n  testImplementation \"c:d:$ver\"\n  compileOnly('e:f')\n  implementation platform('g:h:2')\n}\n", {("gradle", "a:b", "1.0", "prod"), ("gradle", "c:d", "3.1", "dev"), ("gradle", "e:f", "latest", "build"), ("gradle", "g:h", "2", "import"), ("gradle.plugin", "java", "latest", "build"), ("gradle.plugin", "org.x", "2", "build")}),
    "gradle.lockfile": ("# c\na:b:1=compileClasspath\nc:d:2=testRuntime,testCompile\nempty=\n", {("gradle", "a:b", "1", "prod"), ("gradle", "c:d", "2", "dev")}),
    "x.csproj": ('<Project><PropertyGroup><V>1.5</V></PropertyGroup><ItemGroup><PackageReference Include="A" Version="$(v)"/><PackageReference Include="B" PrivateAssets="All"><Version>2</Version></PackageReference></ItemGroup></Project>', {("nuget", "A", "1.5", "prod"), ("nuget", "B", "2", "build")}),
    "packages.config": ('<packages><package id="A" version="1"/><package id="B" version="2" developmentDependency="true"/></packages>', {("nuget", "A", "1", "prod"), ("nuget", "B", "2", "dev")}),
    "conanfile.py": ('class X:\n    requires = "zlib/1.2@u/c", "b/2"\n    def build_requirements(self):\n        self.tool_requires("cmake/3")\n', {("conan", "zlib", "1.2", "prod"), ("conan", "b", "2", "prod"), ("conan", "cmake", "3", "build")}),
    "Dockerfile": ("ARG V=3.1\nFROM python:$V AS base\nFROM base\nFROM scratch\nFROM redis\n", {("docker", "python", "3.1", "prod"), ("docker", "redis", "latest", "prod")}),
    "docker-compose.yml": ("services:\n  a:\n    image: postgres:16\n  b:\n    image: $X\n  c:\n    build: .\n", {("docker", "postgres", "16", "prod")}),
    ".github/workflows/ci.yml": ("jobs:\n  a:\n    container: node:20\n    services:\n      db:\n        image: redis\n    steps:\n      - uses: actions/checkout@v4\n      - uses: ./local\n      - run: x\n", {("docker", "node", "20", "prod"), ("docker", "redis", "latest", "prod"), ("githubAction", "actions/checkout", "v4", "prod")}),
    ".terraform.lock.hcl": ('provider "registry/aws" {\n  version = "5.0"\n  hashes = []\n}\n', {("terraform", "registry/aws", "5.0", "prod")}),
    "main.tf": ('resource "aws_s3_bucket" "b" {\n}\n', {("terraform.resource", "aws_s3_bucket", "b", "prod")}),
    "deno.lock": ('{"version":"3","remote":{"https://x/y.ts":"h"}}', {("deno", "https://x/y.ts", "h", "prod")}),
    "pubspec.yaml": ("name: n\ndependencies:\n  a: ^1\n  b:\n    sdk: flutter\ndev_dependencies:\n  c: 2\n", {("pub", "a", "^1", "prod"), ("pub", "b", "latest", "prod"), ("pub", "c", "latest", "dev")}),
    "pubspec.lock": ('packages:\n  a:\n    dependency: "direct main"\n    version: "1.0"\n  b:\n    dependency: transitive\n    version: "2"\n', {("pub", "a", "1.0", "prod"), ("pub", "b", "2", "prod")}),
    "yarn.lock": ('# yarn lockfile v1\n\n"@s/a@^1", "@s/a@^1.1":\n  version "1.2"\n  dependencies:\n    b "^2"\n\nb@^2:\n  version "2.5"\n', {("npm", "@s/a", "1.2", "prod"), ("npm", "b", "2.5", "prod")}),
    "pnpm-lock.yaml": ("lockfileVersion: '9.0'\nimporters:\n  .:\n    dependencies:\n      a:\n        specifier: ^1\n        version: 1.2.0(b@2)\nsnapshots:\n  a@1.2.0(b@2):\n    dependencies:\n      b: 2.0.0\n", {("npm", "a", "1.2.0", "prod")}),
    "Cargo.lock": ('[[package]]\nname="me"\nversion="0.1"\ndependencies=["a","b 2.0"]\n[[package]]\nname="a"\nversion="1.0"\nsource="r"\ndependencies=["b 1.0"]\n[[package]]\nname="b"\nversion="1.0"\nsource="r"\n[[package]]\nname="b"\nversion="2.0"\nsource="r"\n', {("cargo", "a", "1.0", "prod"), ("cargo", "b", "1.0", "prod"), ("cargo", "b", "2.0", "prod")}),
    "gradle/dependency-list.txt": ("[INFO] The following files:\n[INFO]    g:a:jar:1.0:compile\n[INFO]    g:b:jar:2.0:test\n", {("maven", "g:a", "1.0", "prod"), ("maven", "g:b", "2.0", "dev")}),
    "x.dproj": ("<P><DCC_UsePackage>rtl;vcl;$(DCC_UsePackage)</DCC_UsePackage></P>", {("delphi", "rtl", "latest", "prod"), ("delphi", "vcl", "latest", "prod")}),
    "x.vcxproj": ("<L><AdditionalDependencies>a.lib;%(AdditionalDependencies)</AdditionalDependencies></L>", {("native-lib", "a.lib", "latest", "prod")}),
    "x.podspec": ("s.dependency 'A', '1'\n", {("cocoapods", "A", "1", "")}),
}


@pytest.mark.parametrize("name", CASES)
def test_manifest(name):
    text, want = CASES[name]
    kind, found, error = M.parse("/p/" + name, text)
    assert kind and not error and {(d.type, d.name, d.version, d.scope) for d in found} == want


@pytest.mark.parametrize("name", ["package.json", "composer.json", "package-lock.json", "requirements.txt", "go.mod"])
def test_native_forms_agree(spark, name):
    from granary.sources.native import NATIVE

    text, want = CASES[name]
    files = spark.createDataFrame([("/a/" + name, text), ("/b/" + name, ""), ("/c/" + name, None), ("/d/" + name, "{ broken")], "path string, text string")
    got = NATIVE[name](files).collect()
    assert {(r.type, r.name, r.version, r.scope) for r in got if r.path.startswith("/a")} == want
    assert name == "requirements.txt" or all(r.path.startswith("/a") for r in got)


def test_extract(spark):
    rows = [(f"/p{k}/{n}", t) for k, (n, (t, _)) in enumerate(CASES.items())] + [("/bad/package.json", "{"), ("/x/readme.md", "text"), ("/e/package.json", ""), ("/n/go.mod", None)]
    got = M.extract(spark.createDataFrame(rows, "path string, text string")).collect()
    assert sum(r.error is None for r in got) == sum(len(w) for _, w in CASES.values())
    assert sorted(r.path for r in got if r.error) == ["/bad/package.json", "/e/package.json"]


def test_variables():
    assert M.env_variables("# c\nA=1\n\nexport B = 2\nnot\n") == ["A", "B"]


def test_substitution_ends_in_cycles():
    assert M.substitute("${a}", {"a": "${b}", "b": "${a}"}) == "${a}"
    assert M.substitute("${a}-${c}", {"a": "${b}", "b": "x"}) == "x-${c}"


def edges(f, text, manifest="", mode="full"):
    return {(a, b) for a, b, _ in f(text, manifest, mode)}


NPM = json.dumps({"packages": {"": {"dependencies": {"a": "1"}, "devDependencies": {"d": "1"}}, "node_modules/a": {"version": "1.0", "dependencies": {"b": "1", "c": "1"}}, "node_modules/b": {"version": "2.0"}, "node_modules/a/node_modules/b": {"version": "1.0", "dependencies": {"c": "1"}}, "node_modules/c": {"version": "3.0"}, "node_modules/d": {"version": "4.0"}}})
GRAPHS = {
    "npm": (G.npm, NPM, "", {("a@1.0", "b@1.0"), ("a@1.0", "c@3.0"), ("b@1.0", "c@3.0")}, {(".", "a@1.0"), (".", "d@4.0")}),
    "pnpm": (G.pnpm, CASES["pnpm-lock.yaml"][0], "", {("a@1.2.0", "b@2.0.0")}, {(".", "a@1.2.0")}),
    "yarn": (G.yarn, CASES["yarn.lock"][0], "", {("@s/a@1.2", "b@2.5")}, {(".", "@s/a@1.2")}),
    "yarn+": (G.yarn, CASES["yarn.lock"][0], '{"dependencies":{"b":"^2"}}', {("@s/a@1.2", "b@2.5")}, {(".", "b@2.5")}),
    "bun": (G.bun, '{"workspaces":{"":{"dependencies":{"a":"1"},},},"packages":{"a":["a@1.0","",{"dependencies":{"b":"1"}},"h"],"b":["b@2.0","",{},"h"],}}', "", {("a@1.0", "b@2.0")}, {(".", "a@1.0")}),
    "cargo": (G.cargo, CASES["Cargo.lock"][0], "", {("me@0.1", "a@1.0"), ("me@0.1", "b@2.0"), ("a@1.0", "b@1.0")}, {(".", "a@1.0"), (".", "b@2.0")}),
    "poetry": (G.poetry, '[[package]]\nname="a"\nversion="1"\n[package.dependencies]\nb=">=2"\n[[package]]\nname="b"\nversion="1.0"\n[[package]]\nname="b"\nversion="2.1"\n', "", {("a@1", "b@2.1")}, {(".", "a@1")}),
    "uv": (G.uv, CASES["uv.lock"][0], "", {("me@0", "a@3")}, {(".", "a@3")}),
    "gem": (G.gem, CASES["Gemfile.lock"][0], "", {("a@1.0", "b@2.0")}, {(".", "a@1.0")}),
    "composer": (G.composer, '{"packages":[{"name":"a/a","version":"1","require":{"php":"8","b/b":"*"}},{"name":"b/b","version":"2"}]}', '{"require":{"a/a":"1"}}', {("a/a@1", "b/b@2")}, {(".", "a/a@1")}),
    "nuget": (G.nuget, '{"dependencies":{"net8":{"A":{"type":"Direct","resolved":"1","dependencies":{"b":"2"}},"B":{"type":"Transitive","resolved":"2"}}}}', "", {("A@1", "B@2")}, {(".", "A@1")}),
    "deps": (G.deps_json, '{"libraries":{"me/1":{"type":"project"},"A/2":{"type":"package"}},"targets":{"t":{"me/1":{"dependencies":{"A":"2"}},"A/2":{"dependencies":{"B":"3"}}}}}', "", {(".", "A@2"), ("A@2", "B@3")}, {(".", "A@2")}),
    "conan": (G.conan, '{"graph_lock":{"nodes":{"0":{"requires":["1"]},"1":{"ref":"a/1@u/c#r","requires":["2"]},"2":{"ref":"b/2"}}}}', "", {(".", "a@1"), ("a@1", "b@2")}, {(".", "a@1")}),
    "pods": (G.podfile, "PODS:\n  - A/Core (1.0):\n    - B/X (= 2)\n    - A/Y\n  - B/X (2.0)\n\nDEPENDENCIES:\n  - A/Core (~> 1)\n", "", {("A@1.0", "B@2.0")}, {(".", "A@1.0")}),
    "mix": (G.mix, CASES["mix.lock"][0], "", {("a@1.0", "b@2.0")}, {(".", "a@1.0")}),
    "pub": (G.star(M.pubspec_lock), CASES["pubspec.lock"][0], "", {(".", "a@1.0"), (".", "b@2")}, {(".", "a@1.0")}),
    "swift": (G.star(M.package_resolved), CASES["Package.resolved"][0], "", {(".", "a@1.0"), (".", "b@main")}, {(".", "a@1.0"), (".", "b@main")}),
    "cpan": (G.cpan, CASES["cpanfile.snapshot"][0], "", {("A-B@1.2", "C@3")}, {(".", "A-B@1.2")}),
    "renv": (G.renv, CASES["renv.lock"][0], "", {("a@1", "b@2")}, {(".", "a@1")}),
    "go graph": (G.go_graph, "m a@v1\na@v1 b@v2\n", "", {(".", "a@v1"), ("a@v1", "b@v2")}, {(".", "a@v1")}),
    "maven": (G.maven_tree, '{"groupId":"g","artifactId":"r","version":"0","children":[{"groupId":"g","artifactId":"a","version":"1","scope":"compile","children":[{"groupId":"g","artifactId":"b","version":"2"}]}]}', "", {("g:r@0", "g:a@1"), ("g:a@1", "g:b@2")}, {(".", "g:a@1")}),
    "gradle": (G.gradle_tree, "compile\n+--- g:a:1 -> 1.1\n|    \\--- g:b:2 (*)\n\\--- g:c:3\n", "", {(".", "g:a@1.1"), ("g:a@1.1", "g:b@2"), (".", "g:c@3")}, {(".", "g:a@1.1"), (".", "g:c@3")}),
    "cyclonedx": (G.cyclonedx, '{"components":[{"bom-ref":"1","group":"g","name":"a","version":"1"},{"bom-ref":"2","name":"b","version":"2"}],"dependencies":[{"ref":"root","dependsOn":["1"]},{"ref":"1","dependsOn":["2"]}]}', "", {(".", "g:a@1"), ("g:a@1", "b@2")}, {(".", "g:a@1")}),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_graph(name):
    f, text, manifest, full, direct = GRAPHS[name]
    assert edges(f, text, manifest) == full
    assert edges(f, text, manifest, "direct") == direct


@pytest.mark.parametrize("v,spec,ok", [("2.1", ">=2,<3", True), ("3.0", ">=2,<3", False), ("1.4", "^1.2", True), ("2.0", "^1.2", False), ("0.2.9", "^0.2.3", True), ("0.3", "^0.2.3", False), ("1.2.9", "~1.2.3", True), ("1.3", "~1.2.3", False), ("1.9", "~=1.2", True), ("1.2.4", "==1.2.*", True), ("1.3", "!=1.3", False), ("9", "*", True)])
def test_ranges(v, spec, ok):
    assert G.satisfies(v, spec) == ok


def test_extract_edges(spark):
    files = spark.createDataFrame([("/a/package-lock.json", NPM), ("/b/yarn.lock", CASES["yarn.lock"][0]), ("/b/package.json", '{"dependencies":{"b":"^2"}}'), ("/c/Cargo.lock", "broken ["), ("/d/x.txt", "")], "path string, text string")
    got = {(r.path, r["from"], r["to"], r.scope) for r in G.extract_edges(files, "direct").collect()}
    assert got == {("/a/package-lock.json", ".", "a@1.0", "prod"), ("/a/package-lock.json", ".", "d@4.0", "dev"), ("/b/yarn.lock", ".", "b@2.5", "prod")}
    assert G.extract_edges(files, "off").collect() == []
