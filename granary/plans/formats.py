"""Registered queries of every manifest format, lockfile graph and component detector.

The parts make packages, 25 to a project; a template writes a project's packages as the text of one format, the parser
reads them back, and the SQL says straight from the parts what it must find.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import lockgraphs, manifests
from . import relations as T
from .registry import QUERIES, SQL

#: Packages of one project.
SIZE = 25
#: A package: project o, number k in it, name n, version v, use d (0, 1 or 2), and the next package's name nn, version nv and number m.
PACKAGES = f"""
SELECT *, lead(n) OVER w AS nn, lead(v) OVER w AS nv, lag(n) OVER w IS NULL AS is_first FROM (
  SELECT p_partkey // {SIZE} AS o, p_partkey % {SIZE} AS k, 'pkg' || p_partkey AS n, p_size || '.' || (p_partkey % 7) || '.' || (p_partkey % 11) AS v, p_partkey % {SIZE} % 3 AS d FROM part)
WINDOW w AS (PARTITION BY o ORDER BY k)
"""


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    version = F.concat_ws(".", F.col("p_size").cast("string"), (key % 7).cast("string"), (key % 11).cast("string"))
    rows = T.table(spark, sf_dir, "part").select(F.floor(key / SIZE).alias("o"), (key % SIZE).alias("k"), F.concat(F.lit("pkg"), key).alias("n"), version.alias("v"), (key % SIZE % 3).alias("d"))
    after = Window.partitionBy("o").orderBy("k")
    return rows.withColumns({"nn": F.lead("n").over(after), "nv": F.lead("v").over(after), "m": F.col("k") + 1})


def _filled(template: str) -> Column:
    """The template with $n, $v, ... replaced by the columns."""
    return F.concat(*[F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(re.split(r"\$(nn|nv|[nvkmo])", template))])


def texts(rows: DataFrame, path: str, template: str, sections: dict[str, tuple]) -> DataFrame:
    """(path, text) of one file per project.

    sections: what stands for <name> in the template: (uses, line, separator[, line of a package without a next one]).
    """
    lists = []
    for name, (uses, line, _, *last) in sections.items():
        one = F.when(F.col("nn").isNull(), _filled(last[0])).otherwise(_filled(line)) if last else _filled(line)
        lists.append(F.sort_array(F.collect_list(F.when(F.col("d").isin(*uses), F.struct("k", one.alias("line"))))).alias(name))
    held = rows.groupBy("o").agg(*lists)
    parts = [F.array_join(F.col(x)["line"], sections[x][2]) if i % 2 else F.lit(x) for i, x in enumerate(re.split(r"<(" + "|".join(sections) + r")>", template))]
    return held.select(_filled("/c$o/" + path).alias("path"), F.concat(*parts).alias("text"))


ALL, USED = (0, 1, 2), (0, 1)
#: name: (path, template, sections, SQL of type, name, version, scope, direct[, condition])
MANIFESTS: dict[str, tuple] = {
    "package_json": ("package.json", '{"name":"x","dependencies":{<A>},"devDependencies":{<B>},"peerDependencies":{<C>}}', {x: ((k,), '"$n":"^$v"', ",") for k, x in enumerate("ABC")}, "'npm'", "n", "'^' || v", "['prod', 'dev', 'peer'][d + 1]", "true"),
    "package_lock": ("package-lock.json", '{"lockfileVersion":3,"packages":{"":{"dependencies":{<A>},"devDependencies":{<B>}},<L>}}', {"A": ((0,), '"$n":"^$v"', ","), "B": ((1,), '"$n":"^$v"', ","), "L": (ALL, '"node_modules/$n":{"version":"$v"}', ",")}, "'npm'", "n", "v", "['prod', 'dev'][d + 1]", "true", "d < 2"),
    "pnpm_lock": ("pnpm-lock.yaml", "lockfileVersion: '9.0'\nimporters:\n  .:\n    dependencies:\n<A>\n    devDependencies:\n<B>\n    optionalDependencies:\n<C>\n", {x: ((k,), "      $n:\n        specifier: ^$v\n        version: $v(react@18.0.0)", "\n") for k, x in enumerate("ABC")}, "'npm'", "n", "v", "['prod', 'dev', 'optional'][d + 1]", "true"),
    "yarn_lock": ("yarn.lock", "# yarn lockfile v1\n\n\n<L>\n", {"L": (ALL, '$n@^$v:\n  version "$v"\n  resolved "x"\n', "\n")}, "'npm'", "n", "v", "'prod'", "false"),
    "yarn_berry_lock": ("yarn.lock", '__metadata:\n  version: 8\n\n<L>\n', {"L": (ALL, '"$n@npm:^$v":\n  version: $v\n  resolution: "$n@npm:$v"\n', "\n")}, "'npm'", "n", "v", "'prod'", "false"),
    "deno_lock": ("deno.lock", '{"version":"3","remote":{<L>}}', {"L": (ALL, '"https://deno.land/x/$n/mod.ts":"$v"', ",")}, "'deno'", "'https://deno.land/x/' || n || '/mod.ts'", "v", "'prod'", "true"),
    "requirements_txt": ("requirements.txt", "# needs\n-r other.txt\n<A>\n<B>\n<C>\n", {"A": ((0,), "$n==$v  # pinned", "\n"), "B": ((1,), "$n[extra] >= $v ; python_version > '3'", "\n"), "C": ((2,), "$n", "\n")}, "'pypi'", "n", "[v, '>=' || v, 'latest'][d + 1]", "'prod'", "true"),
    "pyproject_toml": ("pyproject.toml", '[project]\nname = "x"\ndependencies = [<A>]\n[project.optional-dependencies]\ndev = [<B>]\nplots = [<C>]\n', {x: ((k,), '"$n==$v"', ", ") for k, x in enumerate("ABC")}, "'pypi'", "n", "v", "['prod', 'dev', 'optional'][d + 1]", "true"),
    "poetry_lock": ("poetry.lock", "<L>\n", {"L": (ALL, '[[package]]\nname = "$n"\nversion = "$v"\n', "\n")}, "'pypi'", "n", "v", "'prod'", "true"),
    "uv_lock": ("uv.lock", 'version = 1\n[[package]]\nname = "root"\nversion = "0.0.0"\nsource = { editable = "." }\ndependencies = [<A>]\n<L>\n', {"A": (USED, '{ name = "$n" }', ", "), "L": (ALL, '[[package]]\nname = "$n"\nversion = "$v"', "\n")}, "'pypi'", "n", "v", "''", "true", "d < 2"),
    "cargo_toml": ("Cargo.toml", '[package]\nname = "x"\n[dependencies]\n<A>\n[dev-dependencies]\n<B>\n[build-dependencies]\n<C>\n', {"A": ((0,), '$n = "$v"', "\n"), "B": ((1,), '$n = { version = "$v", features = ["a"] }', "\n"), "C": ((2,), '$n = { git = "https://x/$n", tag = "t$v" }', "\n")}, "'cargo'", "n", "CASE WHEN d = 2 THEN 'git:https://x/' || n || '#t' || v ELSE v END", "'prod'", "true"),
    "cargo_lock": ("Cargo.lock", 'version = 3\n[[package]]\nname = "root"\nversion = "0.1.0"\ndependencies = [<A>]\n<L>\n', {"A": (USED, '"$n"', ", "), "L": (ALL, '[[package]]\nname = "$n"\nversion = "$v"\nsource = "registry+x"', "\n")}, "'cargo'", "n", "v", "'prod'", "true", "d < 2"),
    "go_mod": ("go.mod", "module example.com/x\n\ngo 1.22\n\nrequire (\n<A>\n<C>\n)\n", {"A": (USED, "\texample.com/$n v$v", "\n"), "C": ((2,), "\texample.com/$n v$v // indirect", "\n")}, "'golang'", "'example.com/' || n", "'v' || v", "'prod'", "true", "d < 2"),
    "composer_json": ("composer.json", '{"require":{"php":">=8.1","ext-json":"*","a/a":"1.0"<A>},"require-dev":{"composer-plugin-api":"^2"<B>}}', {"A": ((0, 2), ',"acme/$n":"^$v"', ""), "B": ((1,), ',"acme/$n":"^$v"', "")}, "'composer'", "'acme/' || n", "'^' || v", "['prod', 'dev', 'prod'][d + 1]", "true"),
    "gemfile": ("Gemfile", "source 'https://rubygems.org'\n<A>\ngroup :development, :test do\n<B>\nend\n<C>\n", {"A": ((0,), "gem '$n', '~> $v'", "\n"), "B": ((1,), '  gem "$n", "$v"', "\n"), "C": ((2,), "gem '$n'", "\n")}, "'gem'", "n", "['~> ' || v, v, 'latest'][d + 1]", "['prod', 'dev', 'prod'][d + 1]", "true"),
    "gemfile_lock": ("Gemfile.lock", "GEM\n  remote: https://rubygems.org/\n  specs:\n<L>\n\nPLATFORMS\n  ruby\n\nDEPENDENCIES\n<A>\n", {"L": (ALL, "    $n ($v)", "\n"), "A": (USED, "  $n (~> $v)", "\n")}, "'gem'", "n", "v", "'prod'", "true", "d < 2"),
    "podfile": ("Podfile", "platform :ios\n# pod 'no', '1'\ntarget 'x' do\n<A>\n<C>\nend\n", {"A": (USED, "  pod '$n', '~> $v'", "\n"), "C": ((2,), "  pod '$n'", "\n")}, "'cocoapods'", "n", "CASE WHEN d = 2 THEN 'latest' ELSE '~> ' || v END", "''", "false"),
    "podfile_lock": ("Podfile.lock", "PODS:\n<L>\n\nDEPENDENCIES:\n  - x\n", {"L": (ALL, "  - $n ($v):\n    - $nn (>= 0)", "\n", "  - $n ($v)")}, "'cocoapods'", "n", "v", "''", "false"),
    "podspec": ("x.podspec", "Pod::Spec.new do |s|\n  s.name = 'x'\n<L>\nend\n", {"L": (ALL, "  s.dependency '$n', '~> $v'", "\n")}, "'cocoapods'", "n", "'~> ' || v", "''", "false"),
    "pubspec_lock": ("pubspec.lock", "packages:\n<A>\n<B>\n<C>\n", {"A": ((0,), '  $n:\n    dependency: "direct main"\n    version: "$v"', "\n"), "B": ((1,), '  $n:\n    dependency: "direct dev"\n    version: "$v"', "\n"), "C": ((2,), '  $n:\n    dependency: transitive\n    version: "$v"', "\n")}, "'pub'", "n", "v", "['prod', 'dev', 'prod'][d + 1]", "d < 2"),
    "pubspec_yaml": ("pubspec.yaml", "name: x\ndependencies:\n  flutter:\n    sdk: flutter\n<A>\ndev_dependencies:\n  lints: any\n<B>\n", {"A": ((0, 2), "  $n: ^$v", "\n"), "B": ((1,), "  $n: ^$v", "\n")}, "'pub'", "n", "'^' || v", "['prod', 'dev', 'prod'][d + 1]", "true"),
    "mix_lock": ("mix.lock", "%{\n<L>\n}\n", {"L": (ALL, '  "$n": {:hex, :$n, "$v", "h", [:mix], [], "hexpm", "h2"},', "\n")}, "'hex'", "n", "v", "''", "false"),
    "package_resolved": ("Package.resolved", '{"pins":[<L>],"version":2}', {"L": (ALL, '{"identity":"$n","kind":"remoteSourceControl","state":{"revision":"r","version":"$v"}}', ",")}, "'swift'", "n", "v", "''", "false"),
    "package_resolved_v1": ("Package.resolved", '{"object":{"pins":[<L>]},"version":1}', {"L": (ALL, '{"package":"$n","repositoryURL":"https://x.org/a/$n.git","state":{"branch":null,"version":"$v"}}', ",")}, "'swift'", "n", "v", "''", "false"),
    "cpanfile_snapshot": ("cpanfile.snapshot", "# carton snapshot format: version 1.0\nDISTRIBUTIONS\n<L>\n", {"L": (ALL, "  $n-$v\n    pathname: a/$n-$v.tar.gz\n    provides:\n      $n $v\n    requirements:\n      perl 5.008", "\n")}, "'cpan'", "n", "v", "''", "false"),
    "renv_lock": ("renv.lock", '{"R":{"Version":"4.3.0"},"Packages":{<L>}}', {"L": (ALL, '"$n":{"Package":"$n","Version":"$v","Source":"Repository"}', ",")}, "'cran'", "n", "v", "''", "false"),
    "dproj": ("x.dproj", "<Project><PropertyGroup><DCC_UsePackage><L>;$(DCC_UsePackage)</DCC_UsePackage></PropertyGroup></Project>", {"L": (ALL, "$n", ";")}, "'delphi'", "n", "'latest'", "'prod'", "true"),
    "pom_xml": ("pom.xml", '<project xmlns="http://maven.apache.org/POM/4.0.0"><groupId>org.acme</groupId><artifactId>x</artifactId><version>1</version><dependencyManagement><dependencies><M></dependencies></dependencyManagement><dependencies><A><B><C></dependencies></project>', {"M": ((2,), "<dependency><groupId>org.acme</groupId><artifactId>$n</artifactId><version>$v</version></dependency>", ""), "A": ((0,), "<dependency><groupId>org.acme</groupId><artifactId>$n</artifactId><version>$v</version></dependency>", ""), "B": ((1,), "<dependency><groupId>${project.groupId}</groupId><artifactId>$n</artifactId><version>$v</version><scope>test</scope></dependency>", ""), "C": ((2,), "<dependency><groupId>org.acme</groupId><artifactId>$n</artifactId></dependency>", "")}, "'maven'", "'org.acme:' || n", "v", "['prod', 'dev', 'prod'][d + 1]", "true"),
    "dependency_list": ("dependency-list.txt", "[INFO] The following files have been resolved:\n<A>\n<B>\n", {"A": ((0, 2), "[INFO]    org.acme:$n:jar:$v:compile", "\n"), "B": ((1,), "[INFO]    org.acme:$n:jar:tests:$v:test", "\n")}, "'maven'", "'org.acme:' || n", "v", "['prod', 'dev', 'prod'][d + 1]", "false"),
    "build_gradle": ("build.gradle", "dependencies {\n<A>\n<B>\n<C>\n}\n", {"A": ((0,), "    implementation 'org.acme:$n:$v'", "\n"), "B": ((1,), '    testImplementation("org.acme:$n:$v")', "\n"), "C": ((2,), "    compileOnly group: 'org.acme', name: '$n', version: '$v'", "\n")}, "'gradle'", "'org.acme:' || n", "v", "['prod', 'dev', 'build'][d + 1]", "true"),
    "gradle_lockfile": ("gradle.lockfile", "# Gradle\n<A>\n<B>\nempty=annotationProcessor\n", {"A": ((0, 2), "org.acme:$n:$v=compileClasspath,testCompileClasspath", "\n"), "B": ((1,), "org.acme:$n:$v=testCompileClasspath,testRuntimeClasspath", "\n")}, "'gradle'", "'org.acme:' || n", "v", "['prod', 'dev', 'prod'][d + 1]", "false"),
    "csproj": ("x.csproj", '<Project Sdk="Microsoft.NET.Sdk"><ItemGroup><A><B><C></ItemGroup></Project>', {"A": ((0,), '<PackageReference Include="$n" Version="$v" />', ""), "B": ((1,), '<PackageReference Include="$n"><Version>$v</Version><PrivateAssets>all</PrivateAssets></PackageReference>', ""), "C": ((2,), '<Reference Include="$n, Version=$v" />', "")}, "['nuget', 'nuget', 'dotnet-ref'][d + 1]", "n", "CASE WHEN d = 2 THEN 'latest' ELSE v END", "['prod', 'build', 'prod'][d + 1]", "true"),
    "packages_config": ("packages.config", "<packages><A><B></packages>", {"A": ((0, 2), '<package id="$n" version="$v" />', ""), "B": ((1,), '<package id="$n" version="$v" developmentDependency="true" />', "")}, "'nuget'", "n", "v", "['prod', 'dev', 'prod'][d + 1]", "true"),
    "vcxproj": ("x.vcxproj", "<Project><Link><AdditionalDependencies><L>;%(AdditionalDependencies)</AdditionalDependencies></Link></Project>", {"L": (ALL, "$n.lib", ";")}, "'native-lib'", "n || '.lib'", "'latest'", "'prod'", "true"),
    "conanfile": ("conanfile.py", "class X:\n    requires = <A>\n    tool_requires = <B>, 'last/1.0'\n", {"A": ((0, 2), '"$n/$v"', ", "), "B": ((1,), "'$n/$v@user/stable'", ", ")}, "'conan'", "n", "v", "['prod', 'build', 'prod'][d + 1]", "true"),
    "dockerfile": ("Dockerfile", "# image\n<L>\nRUN x\n", {"L": (ALL, "FROM --platform=linux/amd64 acme/$n:$v AS s$k", "\n")}, "'docker'", "'acme/' || n", "v", "'prod'", "true"),
    "docker_compose": ("docker-compose.yml", "services:\n<A>\n<C>\n", {"A": (USED, "  s$k:\n    image: acme/$n:$v", "\n"), "C": ((2,), "  s$k:\n    image: $n", "\n")}, "'docker'", "CASE WHEN d = 2 THEN n ELSE 'acme/' || n END", "CASE WHEN d = 2 THEN 'latest' ELSE v END", "'prod'", "true"),
    "workflow": (".github/workflows/ci.yml", "on: push\njobs:\n  build:\n    runs-on: x\n    steps:\n      - run: make\n<A>\n<C>\n", {"A": (USED, "      - uses: acme/$n@v$v", "\n"), "C": ((2,), "      - uses: docker://$n:$v", "\n")}, "CASE WHEN d = 2 THEN 'docker' ELSE 'githubAction' END", "CASE WHEN d = 2 THEN n ELSE 'acme/' || n END", "CASE WHEN d = 2 THEN v ELSE 'v' || v END", "'prod'", "true"),
    "terraform_lock": (".terraform.lock.hcl", "<L>\n", {"L": (ALL, 'provider "registry.terraform.io/acme/$n" {\n  version     = "$v"\n  hashes = [\n    "h1:x",\n  ]\n}\n', "\n")}, "'terraform'", "'registry.terraform.io/acme/' || n", "v", "'prod'", "true"),
    "terraform": ("main.tf", "<L>\n", {"L": (ALL, 'resource "aws_instance" "$n" {\n  ami = "$v"\n}\n', "\n")}, "'terraform.resource'", "'aws_instance'", "n", "'prod'", "true"),
}
#: What a format's fixed text adds: (manifest, rows of type, name, version, scope, direct).
BESIDE = {
    "composer_json": [("composer", "a/a", "1.0", "prod", True)],
    "pubspec_yaml": [("pub", "flutter", "latest", "prod", True), ("pub", "lints", "any", "dev", True)],
    "conanfile": [("conan", "last", "1.0", "build", True)],
}

_CHAIN = ("n || '@' || v", "nn || '@' || nv", "''", "nn IS NOT NULL")
_ROOT = ("'.'", "n || '@' || v", "''", "d < 2")
_SCOPED = ("'.'", "n || '@' || v", "['prod', 'dev'][d + 1]", "d < 2")
_FIRST = ("'.'", "n || '@' || v", "''", "is_first")
_JSON_NEXT = '"dependencies":{"$nn":"^$nv"}'


def _acme(edge: tuple, prefix: str, version: str = "") -> tuple:
    """The edge between packages whose names (and versions) have a prefix in the format."""
    return tuple(re.sub(r"'@' \|\| ", f"'@{version}' || ", re.sub(r"\b(nn?) \|\| '@'", rf"'{prefix}' || \1 || '@'", x)) for x in edge)


#: name: (path, template, sections, edges of the mode direct, of the mode full[, (path, template, sections) of a file beside])
GRAPHS: dict[str, tuple] = {
    "npm": ("package-lock.json", '{"packages":{"":{"dependencies":{<A>},"devDependencies":{<B>}},<L>}}', {"A": ((0,), '"$n":"^$v"', ","), "B": ((1,), '"$n":"^$v"', ","), "L": (ALL, '"node_modules/$n":{"version":"$v",' + _JSON_NEXT + "}", ",", '"node_modules/$n":{"version":"$v"}')}, [_SCOPED], [_CHAIN]),
    "pnpm": ("pnpm-lock.yaml", "importers:\n  .:\n    dependencies:\n<A>\n    devDependencies:\n<B>\nsnapshots:\n<L>\n", {"A": ((0,), "      $n:\n        version: $v", "\n"), "B": ((1,), "      $n:\n        version: $v(x@1.0.0)", "\n"), "L": (ALL, "  $n@$v:\n    dependencies:\n      $nn: $nv", "\n", "  $n@$v: {}")}, [_SCOPED], [_CHAIN]),
    "yarn": ("yarn.lock", "<L>\n", {"L": (ALL, '$n@^$v:\n  version "$v"\n  dependencies:\n    $nn "^$nv"\n', "\n", '$n@^$v:\n  version "$v"\n')}, [_FIRST], [_CHAIN]),
    "bun": ("bun.lock", '{"lockfileVersion":1,"workspaces":{"":{"dependencies":{<A>},"devDependencies":{<B>},},},"packages":{<L>,}}', {"A": ((0,), '"$n":"^$v"', ","), "B": ((1,), '"$n":"^$v"', ","), "L": (ALL, '"$n":["$n@$v","",{' + _JSON_NEXT + '},"sha"]', ",", '"$n":["$n@$v","",{},"sha"]')}, [_SCOPED], [_CHAIN]),
    "cargo": ("Cargo.lock", '[[package]]\nname = "root"\nversion = "0.1.0"\ndependencies = [<A>]\n<L>\n', {"A": (USED, '"$n"', ", "), "L": (ALL, '[[package]]\nname = "$n"\nversion = "$v"\nsource = "r"\ndependencies = ["$nn $nv"]', "\n", '[[package]]\nname = "$n"\nversion = "$v"\nsource = "r"')}, [_ROOT], [("'root@0.1.0'", *_ROOT[1:]), _CHAIN]),
    "poetry": ("poetry.lock", "<L>\n", {"L": (ALL, '[[package]]\nname = "$n"\nversion = "$v"\n[package.dependencies]\n$nn = ">=$nv"\n', "\n", '[[package]]\nname = "$n"\nversion = "$v"\n')}, [_FIRST], [_CHAIN]),
    "uv": ("uv.lock", '[[package]]\nname = "root"\nversion = "0.0.0"\nsource = { virtual = "." }\ndependencies = [<A>]\n<L>\n', {"A": (USED, '{ name = "$n" }', ", "), "L": (ALL, '[[package]]\nname = "$n"\nversion = "$v"\ndependencies = [{ name = "$nn" }]', "\n", '[[package]]\nname = "$n"\nversion = "$v"')}, [_ROOT], [("'root@0.0.0'", *_ROOT[1:]), _CHAIN]),
    "gem": ("Gemfile.lock", "GEM\n  specs:\n<L>\n\nDEPENDENCIES\n<A>\n", {"L": (ALL, "    $n ($v)\n      $nn (>= 0)", "\n", "    $n ($v)"), "A": (USED, "  $n", "\n")}, [_ROOT], [_CHAIN]),
    "composer": ("composer.lock", '{"packages":[<L>],"packages-dev":[]}', {"L": (ALL, '{"name":"acme/$n","version":"$v","require":{"php":">=8","acme/$nn":"^$nv"}}', ",", '{"name":"acme/$n","version":"$v","require":{"php":">=8"}}')}, [_acme(_SCOPED, "acme/")], [_acme(_CHAIN, "acme/")], ("composer.json", '{"require":{"php":">=8"<A>},"require-dev":{"ext-x":"*"<B>}}', {"A": ((0,), ',"acme/$n":"^$v"', ""), "B": ((1,), ',"acme/$n":"^$v"', "")})),
    "nuget": ("packages.lock.json", '{"version":1,"dependencies":{"net8.0":{<A><C>"Last":{"type":"Transitive"}}}}', {"A": (USED, '"$n":{"type":"Direct","resolved":"$v",' + _JSON_NEXT + "},", "", '"$n":{"type":"Direct","resolved":"$v"},'), "C": ((2,), '"$n":{"type":"Transitive","resolved":"$v",' + _JSON_NEXT + "},", "", '"$n":{"type":"Transitive","resolved":"$v"},')}, [_ROOT], [_CHAIN]),
    "deps_json": ("x.deps.json", '{"libraries":{"app/1.0.0":{"type":"project"}},"targets":{"net8.0":{"app/1.0.0":{"dependencies":{<A>}},<L>}}}', {"A": (USED, '"$n":"$v"', ","), "L": (ALL, '"$n/$v":{"dependencies":{"$nn":"$nv"}}', ",", '"$n/$v":{}')}, [_ROOT], [_ROOT, _CHAIN]),
    "conan": ("conan.lock", '{"graph_lock":{"nodes":{"0":{"requires":[<A>]},<L>}}}', {"A": (USED, '"r$k"', ","), "L": (ALL, '"r$k":{"ref":"$n/$v#rev","requires":["r$m"]}', ",", '"r$k":{"ref":"$n/$v"}')}, [_ROOT], [_ROOT, _CHAIN]),
    "podfile": ("Podfile.lock", "PODS:\n<L>\n\nDEPENDENCIES:\n<A>\n\nCOCOAPODS: 1.15\n", {"L": (ALL, "  - $n ($v):\n    - $nn (>= 0)", "\n", "  - $n ($v)"), "A": (USED, "  - $n (~> $v)", "\n")}, [_ROOT], [_CHAIN]),
    "mix": ("mix.lock", "%{\n<L>\n}\n", {"L": (ALL, '  "$n": {:hex, :$n, "$v", "h", [:mix], [{:$nn, "~> 1.0", [hex: :$nn, repo: "hexpm", optional: false]}], "hexpm", "h2"},', "\n", '  "$n": {:hex, :$n, "$v", "h", [:mix], [], "hexpm", "h2"},')}, [_FIRST], [_CHAIN]),
    "pubspec": ("pubspec.lock", MANIFESTS["pubspec_lock"][1], MANIFESTS["pubspec_lock"][2], [_SCOPED], [("'.'", "n || '@' || v", "['prod', 'dev', 'prod'][d + 1]", "true")]),
    "swift": ("Package.resolved", MANIFESTS["package_resolved"][1], MANIFESTS["package_resolved"][2], [("'.'", "n || '@' || v", "''", "true")], [("'.'", "n || '@' || v", "''", "true")]),
    "cpan": ("cpanfile.snapshot", "DISTRIBUTIONS\n<L>\n", {"L": (ALL, "  $n-$v\n    provides:\n      $n $v\n    requirements:\n      $nn 0", "\n", "  $n-$v\n    provides:\n      $n $v")}, [_FIRST], [_CHAIN]),
    "renv": ("renv.lock", '{"Packages":{<L>}}', {"L": (ALL, '"$n":{"Version":"$v","Requirements":["R","utils","$nn"]}', ",", '"$n":{"Version":"$v","Requirements":["R"]}')}, [_FIRST], [_CHAIN]),
    "go_graph": ("go.mod.graph", "<A>\n<L>\n", {"A": (USED, "example.com/x example.com/$n@v$v", "\n"), "L": (ALL, "example.com/$n@v$v example.com/$nn@v$nv", "\n", "")}, [_acme(_ROOT, "example.com/", "v")], [_acme(_ROOT, "example.com/", "v"), _acme(_CHAIN, "example.com/", "v")]),
    "go_mod": ("go.mod", MANIFESTS["go_mod"][1], MANIFESTS["go_mod"][2], *[[_acme(("'.'", "n || '@' || v", "'prod'", "d < 2"), "example.com/", "v")]] * 2),
    "maven_tree": ("dependency-tree.json", '{"groupId":"org.acme","artifactId":"root","version":"1","children":[<A><B>{"groupId":"org.acme","artifactId":"end","version":"1","scope":"compile"}]}', {x: ((k,), f'{{"groupId":"org.acme","artifactId":"$n","version":"$v","scope":"{s}","children":[{{"groupId":"org.acme","artifactId":"$nn","version":"$nv"}}]}},', "", f'{{"groupId":"org.acme","artifactId":"$n","version":"$v","scope":"{s}"}},') for k, (x, s) in enumerate((("A", "compile"), ("B", "test")))}, [_acme(_SCOPED, "org.acme:")], [("'org.acme:root@1'", _acme(_ROOT, "org.acme:")[1], "''", "d < 2"), (*_acme(_CHAIN, "org.acme:")[:3], "d < 2 AND nn IS NOT NULL")]),
    "gradle_tree": ("gradle-dependencies.txt", "compileClasspath - Compile classpath.\n<A>\n", {"A": (USED, "+--- org.acme:$n:$v\n|    \\--- org.acme:$nn:0.1 -> $nv", "\n", "+--- org.acme:$n:$v")}, [_acme(_ROOT, "org.acme:")], [_acme(_ROOT, "org.acme:"), (*_acme(_CHAIN, "org.acme:")[:3], "d < 2 AND nn IS NOT NULL")]),
    "cyclonedx": ("bom.json", '{"bomFormat":"CycloneDX","components":[<L>],"dependencies":[{"ref":"root","dependsOn":[<A>]},<E>]}', {"L": (ALL, '{"bom-ref":"r$k","group":"org.acme","name":"$n","version":"$v"}', ","), "A": (USED, '"r$k"', ","), "E": (ALL, '{"ref":"r$k","dependsOn":["r$m"]}', ",", '{"ref":"r$k"}')}, [_acme(_ROOT, "org.acme:")], [_acme(_ROOT, "org.acme:"), _acme(_CHAIN, "org.acme:")]),
}
#: Fixed edges beside those of the packages: (graph, mode, from, to, scope).
EDGES_BESIDE = {"maven_tree": [("direct", ".", "org.acme:end@1", "prod"), ("full", "org.acme:root@1", "org.acme:end@1", "")]}

#: name: (path, text, component type, SQL of the name)
DETECTED: dict[str, tuple[str, str, str, str]] = {
    "nodejs": ("package.json", '{"author": {"name": "Bob"}, "scripts": {"name": "x"}, "name": "@acme/app$o", "version": "1.0.0"}', "nodejs", "'@acme/app' || o"),
    "python": ("pyproject.toml", '[build-system]\nname = "no"\n[project]\nauthors = [{name = "Bob"}]\nversion = "1"\nname = "app$o"\n[tool.x]\nname = "tool"\n', "python", "'app' || o"),
    "python_requirements": ("requirements.txt", "django==4.2\n", "python", "'c' || o"),
    "python_setup": ("setup.py", "from setuptools import setup\nauthor_name = 'Bob'\nname = 'no'\nsetup(version='1', name='app$o')\n", "python", "'app' || o"),
    "maven": ("pom.xml", "<project><!-- <artifactId>no</artifactId> --><parent><artifactId>up</artifactId></parent><dependencies><dependency><artifactId>dep</artifactId></dependency></dependencies><groupId>g</groupId><artifactId>app$o</artifactId></project>", "maven", "'app' || o"),
    "gradle": ("build.gradle.kts", 'plugins { id("java") }\n', "gradle", "'c' || o"),
    "dotnet": ("x.csproj", "<Project><PropertyGroup><!-- <AssemblyName>No</AssemblyName> --><AssemblyName>App$o</AssemblyName></PropertyGroup></Project>", "dotnet", "'App' || o"),
    "golang": ("go.mod", "module example.com/app$o\n\ngo 1.22\n", "golang", "'example.com/app' || o"),
    "golang_main": ("main.go", "package main\n", "golang", "'c' || o"),
    "rust": ("Cargo.toml", '[[bin]]\nname = "tool"\n[package]\nedition = "2021"\nname = "app$o"\n[lib]\nname = "lib"\n', "rust", "'app' || o"),
    "php": ("composer.json", '{"authors": [{"name": "Bob"}], "name": "acme/app$o"}', "php", "'acme/app' || o"),
    "ruby": ("Gemfile", "source 'x'\n", "ruby", "'c' || o"),
    "cplusplus": ("conanfile.py", "class X(ConanFile):\n    name = 'app$o'\n", "cplusplus", "'app' || o"),
    "msbuild_cpp": ("x.vcxproj", "<Project><ProjectName>App$o</ProjectName></Project>", "msbuild-cpp", "'App' || o"),
    "cocoapods": ("x.podspec", "Pod::Spec.new do |s|\n  s.name = 'app$o'\nend\n", "cocoapods", "'app' || o"),
    "dart": ("pubspec.yaml", "name: app$o\nversion: 1.0.0\n", "dart", "'app' || o"),
    "elixir": ("mix.exs", "def project do\n  [app: :app$o]\nend\n", "elixir", "'app' || o"),
    "swift": ("Package.swift", 'let package = Package(\n  name: "app$o"\n)\n', "swift", "'app' || o"),
    "perl": ("cpanfile", "requires 'Moose';\n", "perl", "'c' || o"),
    "r": ("renv.lock", '{"Packages":{}}', "r", "'c' || o"),
    "deno": ("deno.json", '{"name": "@acme/app$o"}', "deno", "'@acme/app' || o"),
    "delphi": ("x.dproj", "<Project><MainSource>App$o.dpr</MainSource></Project>", "delphi", "'App' || o"),
    "nx": ("project.json", '{"name": "app$o", "projectType": "library"}', "nx", "'app' || o"),
}


def _manifest(name: str) -> Callable[[SparkSession, str], DataFrame]:
    path, template, sections, *_ = MANIFESTS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = texts(packages(spark, sf_dir), path, template, sections)
        return manifests.extract(files).select("path", "type", "name", "version", "scope", "direct", "error")

    return run


def _manifest_sql(name: str) -> str:
    path, _, _, kind, n, v, scope, direct, *where = MANIFESTS[name]
    out = f"WITH p AS ({PACKAGES}) SELECT '/c' || o || '/{path}' AS path, {kind} AS type, {n} AS name, {v} AS version, {scope} AS scope, {direct} AS direct, NULL::VARCHAR AS error FROM p WHERE {where[0] if where else 'true'}"
    for row in BESIDE.get(name, ()):
        *text, direct = row
        cells = ", ".join(f"'{x}'" for x in text)
        out += f" UNION ALL SELECT DISTINCT '/c' || o || '/{path}', {cells}, {str(direct).lower()}, NULL FROM p"
    return out


def _graph(name: str) -> Callable[[SparkSession, str], DataFrame]:
    path, template, sections, _, _, *beside = GRAPHS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = packages(spark, sf_dir)
        files = texts(rows, path, template, sections)
        for more in beside:
            files = files.unionByName(texts(rows, *more))
        direct, full = (lockgraphs.extract_edges(files, mode).select("path", F.lit(mode).alias("mode"), "from", "to", "scope") for mode in ("direct", "full"))
        return direct.unionByName(full)

    return run


def _graph_sql(name: str) -> str:
    path, _, _, direct, full, *_ = GRAPHS[name]
    selects = [f"SELECT '/c' || o || '/{path}' AS path, '{mode}' AS mode, {a} AS \"from\", {b} AS \"to\", {scope} AS scope FROM p WHERE {where}" for mode, edges in (("direct", direct), ("full", full)) for a, b, scope, where in edges]
    selects += [f"SELECT DISTINCT '/c' || o || '/{path}', '{mode}', '{a}', '{b}', '{scope}' FROM p" for mode, a, b, scope in EDGES_BESIDE.get(name, ())]
    return f"WITH p AS ({PACKAGES}) " + " UNION ALL ".join(selects)


def _detector(name: str) -> Callable[[SparkSession, str], DataFrame]:
    path, text, _, _ = DETECTED[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .scan import detect

        projects = packages(spark, sf_dir).select("o").distinct()
        files = projects.select(_filled("/c$o/" + path).alias("path"), _filled("/c$o").alias("dir"), _filled(text).alias("text"))
        return detect(files, "root").select("path", "name", "type")

    return run


def _detector_sql(name: str) -> str:
    path, _, kind, own = DETECTED[name]
    return f"WITH p AS ({PACKAGES}) SELECT DISTINCT '/c' || o || '/{path}' AS path, {own} AS name, '{kind}' AS type FROM p"


def register(groups: Sequence[tuple[str, dict, Callable, Callable]]) -> None:
    for prefix, table, build, sql in groups:
        for name in table:
            QUERIES[f"{prefix}_{name}"] = build(name)
            SQL[f"{prefix}_{name}"] = sql(name)


register([("manifest", MANIFESTS, _manifest, _manifest_sql), ("graph", GRAPHS, _graph, _graph_sql), ("detector", DETECTED, _detector, _detector_sql)])
