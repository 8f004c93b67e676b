from granary.operators import graphs as G
from granary.operators import listings as Z
from granary.operators import maven as V

PARENT = "<project><groupId>g</groupId><artifactId>parent</artifactId><version>1</version><properties><lib>2.5</lib><deep>${lib}</deep></properties><dependencyManagement><dependencies><dependency><groupId>x</groupId><artifactId>lib</artifactId><version>${deep}</version></dependency><dependency><groupId>g</groupId><artifactId>bom</artifactId><version>1</version><type>pom</type><scope>import</scope></dependency></dependencies></dependencyManagement></project>"
BOM = "<project><groupId>g</groupId><artifactId>bom</artifactId><version>1</version><dependencyManagement><dependencies><dependency><groupId>x</groupId><artifactId>fromBom</artifactId><version>7</version></dependency><dependency><groupId>x</groupId><artifactId>lib</artifactId><version>9</version></dependency></dependencies></dependencyManagement></project>"
CHILD = "<project><parent><groupId>g</groupId><artifactId>parent</artifactId><version>1</version></parent><artifactId>child</artifactId><properties><lib>3.0</lib></properties><dependencies><dependency><groupId>x</groupId><artifactId>lib</artifactId></dependency><dependency><groupId>x</groupId><artifactId>fromBom</artifactId></dependency><dependency><groupId>x</groupId><artifactId>own</artifactId><version>${project.version}</version><scope>test</scope></dependency><dependency><groupId>x</groupId><artifactId>none</artifactId></dependency></dependencies></project>"


def test_parents_and_imports(spark):
    files = spark.createDataFrame([("/pom.xml", PARENT), ("/bom/pom.xml", BOM), ("/child/pom.xml", CHILD), ("/bad/pom.xml", "<project>"), ("/x.txt", "")], "path string, text string")
    poms = V.read_poms(files)
    assert poms.count() == 3
    got = {r.name: (r.version, r.scope) for r in V.effective_dependencies(poms).where("path = '/child/pom.xml'").collect()}
    # A managed version is filled by the properties of the POM that lists it.
    assert got == {"x:lib": ("2.5", "prod"), "x:fromBom": ("7", "prod"), "x:own": ("1", "dev"), "x:none": ("", "prod")}
    kids = V.child_table(poms)
    assert {(r.parent, r.child) for r in kids.collect()} == {("g:child", "x:lib"), ("g:child", "x:fromBom"), ("g:child", "x:none")}
    walked = G.nearest_wins(kids, spark.createDataFrame([("g:child", "1", 0)], "name string, version string, ord int"))
    assert {r.name for r in walked.collect()} == {"g:child", "x:lib", "x:fromBom", "x:none"}
    assert {r.name: r.paths for r in V.source_index(poms).collect()}["g:bom"] == ["/bom/pom.xml"]


def test_hybrid_keeps_the_first_source(spark):
    a = spark.createDataFrame([("a", "b", "online")], "`from` string, `to` string, source string")
    b = spark.createDataFrame([("a", "b", "crawl"), ("a", "c", "crawl")], "`from` string, `to` string, source string")
    assert sorted(tuple(r) for r in V.hybrid(a, b).collect()) == [("a", "b", "online"), ("a", "c", "crawl")]


def test_mirrors():
    m = [("*,!internal", "u1"), ("internal", "u2")]
    assert V.mirror_for(m, "central") == "u1" and V.mirror_for(m, "internal") == "u2" and V.mirror_for([], "central") is None


def test_resources(spark):
    r = spark.createDataFrame([("aws_vpc",), ("aws_vpc",), ("google_cloud_run_service",), ("odd",)], "type string")
    assert {(x.by, x.value): x.n for x in Z.resource_rollup(r).collect()} == {("provider", "aws"): 2, ("provider", "google"): 1, ("provider", "odd"): 1, ("category", "networking"): 2, ("category", "container"): 1, ("category", "other"): 1, ("total", ""): 4}


def test_properties_merge(spark):
    p = spark.createDataFrame([(1, "docker", ["a"], 2), (1, "docker", ["b"], 1), (1, "x", ["a"], 1), (1, "x", ["b"], 2)], "component_id int, key string, value array<string>, walk_order long")
    assert {r.key: r.value for r in Z.merged_properties(p).collect()} == {"docker": ["b", "a"], "x": ["b"]}


def test_nearest_values(spark):
    places = spark.createDataFrame([("/a/b/c",), ("/z",)], "dir string")
    values = spark.createDataFrame([("/a", "k", "1"), ("/a/b", "k", "2"), ("/", "r", "3")], "v_dir string, key string, value string")
    assert sorted(tuple(r) for r in Z.nearest_values(places, values).collect()) == [("/a/b/c", "k", "2"), ("/a/b/c", "r", "3"), ("/z", "r", "3")]
