"""Registered queries of mediation with exclusions, version ranges, and documents of many systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import mediation as M
from ..operators import ranges as N
from . import relations as T
from .registry import query


def _text(*parts: Column | str | int) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def _package(k: Column) -> Column:
    return _text("g", k % 5, ":a", k)


def excluding_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages (part keys modulo 97, in five groups) and what they need, of two parts in seven; four edges in five exclude something below them."""
    p = F.col("p_partkey")
    token = F.when(p % 4 == 0, F.lit("g1:*")).when(p % 4 == 1, F.lit("g2:a12")).when(p % 4 == 2, F.lit("*:a30")).otherwise(F.lit("g3:*"))
    return T.table(spark, sf_dir, "part").where("p_partkey % 7 < 2").select(
        _package(p % 97).alias("parent"),
        _text("v", p % 3).alias("parent_version"),
        _package((p * 7 + p % 5 * 3) % 97).alias("child"),
        _text("v", (p + 1) % 3).alias("child_version"),
        p.alias("ord"),
        F.when(p % 5 != 0, F.array(token)).alias("exclusions"),
    )


EXCLUDING_PACKAGES = """
SELECT 'g' || (p_partkey % 97 % 5) || ':a' || (p_partkey % 97) AS parent, 'v' || (p_partkey % 3) AS parent_version,
  'g' || ((p_partkey * 7 + p_partkey % 5 * 3) % 97 % 5) || ':a' || ((p_partkey * 7 + p_partkey % 5 * 3) % 97) AS child, 'v' || ((p_partkey + 1) % 3) AS child_version, p_partkey AS ord,
  CASE WHEN p_partkey % 5 <> 0 THEN [CASE p_partkey % 4 WHEN 0 THEN 'g1:*' WHEN 1 THEN 'g2:a12' WHEN 2 THEN '*:a30' ELSE 'g3:*' END] ELSE [] END AS excluded
FROM part WHERE p_partkey % 7 < 2
"""


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two direct packages of each region's project; the first project excludes a package from the start."""
    r = F.col("r_regionkey")
    both = F.array(F.struct((r * 19 % 97).cast("long").alias("k"), F.lit(0).alias("ord")), F.struct((r * 7 + 3).cast("long").alias("k"), F.lit(1).alias("ord")))
    rows = T.table(spark, sf_dir, "region").select(_text("p", r).alias("project"), "r_regionkey", F.explode(both).alias("x"))
    return rows.select("project", _package(F.col("x.k")).alias("name"), _text("v", F.col("x.k") % 3).alias("version"), F.col("x.ord").alias("ord"), F.when((r == 0) & (F.col("x.ord") == 1), F.array(F.lit("*:a5"))).alias("exclusions"))


PROJECTS = """
SELECT 'p' || r_regionkey AS project, 'g' || (k % 5) || ':a' || k AS name, 'v' || (k % 3) AS version, ord, CASE WHEN r_regionkey = 0 AND ord = 1 THEN ['*:a5'] ELSE [] END AS excluded
FROM (SELECT r_regionkey, r_regionkey * 19 % 97 AS k, 0 AS ord FROM region UNION ALL SELECT r_regionkey, r_regionkey * 7 + 3, 1 FROM region)
"""


def mediation_sql(kids: str, roots: str) -> str:
    """One row a level: the states that go on, what is chosen, and every state met, dominated or not; orders compare as lists."""
    return f"""WITH RECURSIVE kids AS ({kids}), roots AS ({roots}), first AS (SELECT project, name, arg_min(version, ord) AS version FROM roots GROUP BY ALL), start AS (SELECT r.* FROM roots r JOIN first f ON r.project = f.project AND r.name = f.name AND r.version = f.version),
t AS (
  SELECT 0 AS depth, (SELECT list(struct_pack(project := project, name := name, version := version, excluded := excluded::VARCHAR[], ord := [ord::BIGINT])) FROM start) AS live,
    (SELECT list(struct_pack(project := project, name := name, version := version, depth := 0)) FROM first) AS chosen, (SELECT list(struct_pack(project := project, name := name, excluded := excluded::VARCHAR[])) FROM start) AS seen
  UNION ALL
  (WITH s AS (SELECT unnest(live, recursive := true) FROM t), c AS (SELECT unnest(chosen, recursive := true) FROM t),
  found AS (SELECT s.project, k.child AS name, k.child_version AS version, list_append(s.ord, k.ord::BIGINT) AS ord, list_sort(list_distinct(list_concat(s.excluded, k.excluded::VARCHAR[]))) AS excluded
    FROM (SELECT x.project, x.name, x.version, x.excluded, x.ord FROM (SELECT unnest(live) AS x FROM t)) s JOIN kids k ON s.name = k.parent AND s.version = k.parent_version
    WHERE NOT list_has_any(s.excluded, [k.child, split_part(k.child, ':', 1) || ':*', '*:' || split_part(k.child, ':', 2), '*:*'])),
  fresh AS (SELECT project, name, arg_min(version, ord) AS version FROM found f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.project = f.project AND c.name = f.name) GROUP BY ALL),
  every AS (SELECT project, name, version FROM c UNION ALL SELECT * FROM fresh),
  met AS (SELECT f.project, f.name, f.version, f.excluded, min(f.ord) AS ord FROM found f JOIN every e ON f.project = e.project AND f.name = e.name AND f.version = e.version GROUP BY ALL),
  gone AS (SELECT m.* FROM met m WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(seen) AS x FROM t) d WHERE d.x.project = m.project AND d.x.name = m.name AND d.x.excluded = m.excluded))
  SELECT t.depth + 1, (SELECT list(struct_pack(project := project, name := name, version := version, excluded := excluded, ord := ord)) FROM gone),
    list_concat(t.chosen, (SELECT list(struct_pack(project := project, name := name, version := version, depth := t.depth + 1)) FROM fresh)), list_concat(t.seen, (SELECT list(struct_pack(project := project, name := name, excluded := excluded)) FROM gone))
  FROM t WHERE len(t.live) > 0 AND t.depth < 64)
)
SELECT x.project, x.name, x.version, x.depth FROM (SELECT unnest(chosen) AS x FROM t WHERE depth = (SELECT max(depth) FROM t))"""


@query(mediation_sql(EXCLUDING_PACKAGES, PROJECTS))
def mediated_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mediate(excluding_packages(spark, sf_dir), projects(spark, sf_dir))


def published(spark: SparkSession, sf_dir: str, candidate: str, other: str) -> DataFrame:
    """Versions of packages (part brands): one part in seven is a candidate, one in eleven of the rest something else."""
    p = F.col("p_partkey")
    tail = F.when(p % 7 == 0, F.lit(candidate)).when(p % 11 == 0, F.lit(other)).otherwise(F.lit(""))
    return T.table(spark, sf_dir, "part").select(F.lower(F.regexp_replace("p_brand", "#", "-")).alias("name"), _text(F.col("p_size") % 4, ".", p % 5, ".", p % 3, tail).alias("version"))


def _published_sql(candidate: str, other: str, stages: str) -> str:
    return f"""SELECT DISTINCT lower(replace(p_brand, '#', '-')) AS name, (p_size % 4) || '.' || (p_partkey % 5) || '.' || (p_partkey % 3) || CASE WHEN p_partkey % 7 = 0 THEN '{candidate}' WHEN p_partkey % 11 = 0 THEN '{other}' ELSE '' END AS version,
  [p_size % 4, p_partkey % 5, p_partkey % 3] AS core, CASE WHEN p_partkey % 7 = 0 THEN {stages.split(",")[0]} WHEN p_partkey % 11 = 0 THEN {stages.split(",")[1]} ELSE {stages.split(",")[2]} END AS stage FROM part"""


def asked(spark: SparkSession, sf_dir: str, kinds: list[tuple]) -> DataFrame:
    """Ranges that line items ask of a brand, in as many kinds."""
    kind = F.col("l_orderkey") % len(kinds)
    spec = None
    for k, (text, *_) in enumerate(kinds):
        text = text(F.col("a"), F.col("b"))
        spec = F.when(kind == k, text) if spec is None else spec.when(kind == k, text)
    items = T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    parts = T.table(spark, sf_dir, "part").select("p_partkey", F.lower(F.regexp_replace("p_brand", "#", "-")).alias("name"))
    rows = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumns({"a": F.col("l_suppkey") % 4, "b": F.col("l_partkey") % 5})
    return rows.select("l_orderkey", "name", spec.alias("spec"))


def _asked_sql(kinds: list[str]) -> str:
    cases = " ".join(f"WHEN {k} THEN {text}" for k, text in enumerate(kinds))
    return f"SELECT DISTINCT lower(replace(p_brand, '#', '-')) AS name, l_orderkey % {len(kinds)} AS kind, l_suppkey % 4 AS a, l_partkey % 5 AS b, CASE l_orderkey % {len(kinds)} {cases} END AS spec FROM lineitem JOIN part ON l_partkey = p_partkey"


PEP440_KINDS = [
    (lambda a, b: _text(">=", a, ".", b, ",<", a + 1), "'>=' || a || '.' || b || ',<' || (a + 1)", "v >= [a, b, 0, 1] AND v < [a + 1, 0, 0, 0] AND final"),
    (lambda a, b: _text("~= ", a, ".", b, ".0"), "'~= ' || a || '.' || b || '.0'", "v >= [a, b, 0, 1] AND v[:2] = [a, b] AND final"),
    (lambda a, b: _text("==", a, ".", b, ".*"), "'==' || a || '.' || b || '.*'", "v[:2] = [a, b] AND final"),
    (lambda a, b: _text("!=", a, ".", b, ".1, >=", a), "'!=' || a || '.' || b || '.1, >=' || a", "v <> [a, b, 1, 1] AND v >= [a, 0, 0, 1] AND final"),
    (lambda a, b: _text("^", a, ".", b), "'^' || a || '.' || b", "v >= [a, b, 0, 1] AND v[:CASE WHEN a > 0 THEN 1 ELSE 2 END] = [a, b][:CASE WHEN a > 0 THEN 1 ELSE 2 END] AND final"),
    (lambda a, b: _text(">", a, ".", b, ".1"), "'>' || a || '.' || b || '.1'", "core > [a, b, 1] AND final"),
    (lambda a, b: _text("<=", a, ".", b, ".2rc1"), "'<=' || a || '.' || b || '.2rc1'", "v <= [a, b, 2, 0]"),
    (lambda a, b: _text("~", a, ".", b, " || >=3.4"), "'~' || a || '.' || b || ' || >=3.4'", "(v[:2] = [a, b] OR v >= [3, 4, 0, 1]) AND final"),
    (lambda a, b: _text("not a range of ", a), "'not a range of ' || a", "false"),
]
SEMVER_KINDS = [
    (lambda a, b: _text("^", a, ".", b, ".0"), "'^' || a || '.' || b || '.0'", "core >= [a, b, 0] AND core[:n] = [a, b, 0][:n] AND final"),
    (lambda a, b: _text("~", a, ".", b), "'~' || a || '.' || b", "core[:2] = [a, b] AND final"),
    (lambda a, b: _text(a, ".x"), "a || '.x'", "core[1] = a AND final"),
    (lambda a, b: _text(">= ", a, ".", b, ".1 <3.0.0"), "'>= ' || a || '.' || b || '.1 <3.0.0'", "core >= [a, b, 1] AND core < [3, 0, 0] AND final"),
    (lambda a, b: _text(a, ".", b, ".0 - 2"), "a || '.' || b || '.0 - 2'", "core >= [a, b, 0] AND core < [3, 0, 0] AND final"),
    (lambda a, b: _text(">=", a, ".", b, ".1-rc.1"), "'>=' || a || '.' || b || '.1-rc.1'", "v >= [a, b, 1, 1] AND (final OR core = [a, b, 1])"),
    (lambda a, b: _text("<", a, ".", b, " || ^3.1.0"), "'<' || a || '.' || b || ' || ^3.1.0'", "(core < [a, b, 0] OR (core >= [3, 1, 0] AND core < [4, 0, 0])) AND final"),
    (lambda a, b: F.lit("*"), "'*'", "final"),
    (lambda a, b: F.lit("git+ssh://host/x"), "'git+ssh://host/x'", "false"),
]


def _ranges_sql(versions: str, kinds: list[tuple], final: str) -> str:
    """Each kind of range as a condition on the numbers of a version, tried on all pairs; none matches: all versions stay."""
    asked_sql = _asked_sql([k[1] for k in kinds]).replace("|| a", "|| (l_suppkey % 4)").replace("|| b", "|| (l_partkey % 5)").replace("(a + 1)", "(l_suppkey % 4 + 1)").replace("THEN a ||", "THEN (l_suppkey % 4) ||")
    match = " ".join(f"WHEN {k} THEN {x[2]}" for k, x in enumerate(kinds))
    return f"""WITH p AS ({versions}), s AS ({asked_sql}), m AS (SELECT s.name, spec, version, CASE kind {match} END AS fits FROM (SELECT *, CASE WHEN a > 0 THEN 1 WHEN b > 0 THEN 2 ELSE 3 END AS n FROM s) s JOIN (SELECT *, list_append(core, stage) AS v, {final} AS final FROM p) p ON s.name = p.name),
g AS (SELECT name, spec, version, bool_or(fits) AS fits FROM m GROUP BY ALL), w AS (SELECT *, bool_or(fits) OVER (PARTITION BY name, spec) AS hit FROM g)
SELECT name, spec, version, hit AS matched FROM w WHERE fits OR NOT hit"""


@query(_ranges_sql(_published_sql("rc1", ".post1", "0,2,1"), PEP440_KINDS, "stage > 0"))
def pep440_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.satisfying(asked(spark, sf_dir, PEP440_KINDS), published(spark, sf_dir, "rc1", ".post1"), "pep440")


@query(_ranges_sql(_published_sql("-rc.1", "-beta", "1,0,2"), SEMVER_KINDS, "stage > 1"))
def semver_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.satisfying(asked(spark, sf_dir, SEMVER_KINDS), published(spark, sf_dir, "-rc.1", "-beta"), "semver")


@query(f"""WITH f AS ({_ranges_sql(_published_sql("rc1", ".post1", "0,2,1"), PEP440_KINDS, "stage > 0")}), v AS ({_published_sql("rc1", ".post1", "0,2,1")})
SELECT f.name, spec, arg_max(f.version, list_append(core, stage)) AS version FROM f JOIN v ON f.name = v.name AND f.version = v.version WHERE matched GROUP BY f.name, spec""")
def best_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.best_satisfying(asked(spark, sf_dir, PEP440_KINDS), published(spark, sf_dir, "rc1", ".post1"), "pep440")


@query("""WITH l AS (SELECT DISTINCT 'l' || (p_partkey % 9) AS lock, lower(replace(p_brand, '#', '-')) AS name, (p_size % 4) || '.' || (p_partkey % 5) AS version, [p_size % 4, p_partkey % 5] AS v FROM part),
q AS (SELECT DISTINCT 'l' || (p_partkey % 9) AS lock, lower(replace(p_brand, '#', '-')) || '@' || (p_size % 4) || '.' || (p_partkey % 5) AS "from", 'brand-' || (p_partkey % 60) AS needs, p_size % 3 AS a FROM part),
m AS (SELECT q.*, l.version, l.v >= [q.a + 1, 0] AND l.v < [q.a + 2, 0] AS fits, count(*) OVER (PARTITION BY q.lock, "from", needs, a) AS n FROM q JOIN l ON q.lock = l.lock AND q.needs = l.name),
w AS (SELECT *, bool_or(fits) OVER (PARTITION BY lock, "from", needs, a) AS hit FROM m)
SELECT DISTINCT lock, "from", needs || '@' || version AS "to" FROM w WHERE n = 1 OR fits OR NOT hit""")
def locked_range_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    lock, name, version = _text("l", p % 9).alias("lock"), F.lower(F.regexp_replace("p_brand", "#", "-")).alias("name"), _text(F.col("p_size") % 4, ".", p % 5).alias("version")
    parts = T.table(spark, sf_dir, "part")
    needs = parts.select(lock, name, version, _text("brand-", p % 60).alias("needs"), _text(">=", F.col("p_size") % 3 + 1, ",<", F.col("p_size") % 3 + 2).alias("spec"))
    return N.range_edges(parts.select(lock, name, version), needs)


def _node_sql(id: str, name: str, folder: str) -> str:
    return f"""'{{"component_id":' || to_json({id}) || ',"name":' || to_json({name}) || ',"dir":"{folder}"'"""



@query(f"""WITH o AS (SELECT o_custkey, '[' || string_agg(x, ',' ORDER BY x) || ']' AS list FROM (SELECT o_custkey, '{{"key":' || o_orderkey || ',"status":' || to_json(o_orderstatus) || '}}' AS x FROM orders) GROUP BY 1),
c AS (SELECT c_nationkey, c_name, {_node_sql("'c' || c_custkey", "c_name", "/r/n")} || coalesce(',"orders":' || list, '') || '}}' AS x FROM customer LEFT JOIN o ON c_custkey = o_custkey),
cs AS (SELECT c_nationkey, ',"children":[' || string_agg(x, ',' ORDER BY c_name, x) || ']' AS list FROM c GROUP BY 1),
n AS (SELECT n_regionkey, n_name, {_node_sql("'n' || n_nationkey", "n_name", "/r")} || coalesce(list, '') || '}}' AS x FROM nation LEFT JOIN cs ON n_nationkey = c_nationkey),
ns AS (SELECT n_regionkey, ',"children":[' || string_agg(x, ',' ORDER BY n_name, x) || ']' AS list FROM n GROUP BY 1)
SELECT 'r' || r_regionkey AS root_id, {_node_sql("'r' || r_regionkey", "r_name", "/")} || coalesce(list, '') || '}}' AS document FROM region LEFT JOIN ns ON r_regionkey = n_regionkey""")
def tree_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as systems: nations and customers as nested components, orders as what a component lists."""
    r, n, c, o = (T.table(spark, sf_dir, name) for name in ("region", "nation", "customer", "orders"))
    of = n.select(F.col("n_nationkey").alias("of_nation"), F.col("n_regionkey").alias("of_region"))
    customers = c.join(of, F.col("c_nationkey") == F.col("of_nation"))
    row = lambda root, key, up, depth, name, folder: [root.alias("root_id"), key.alias("component_id"), up.alias("parent_id"), F.lit(depth).alias("depth"), F.col(name).alias("name"), F.lit(folder).alias("dir")]
    region = _text("r", F.col("r_regionkey"))
    nodes = r.select(*row(region, region, F.lit(None).cast("string"), 0, "r_name", "/"))
    nodes = nodes.unionByName(n.select(*row(_text("r", F.col("n_regionkey")), _text("n", F.col("n_nationkey")), _text("r", F.col("n_regionkey")), 1, "n_name", "/r")))
    nodes = nodes.unionByName(customers.select(*row(_text("r", F.col("of_region")), _text("c", F.col("c_custkey")), _text("n", F.col("c_nationkey")), 2, "c_name", "/r/n")))
    owner = customers.select("c_custkey", _text("r", F.col("of_region")).alias("root_id"), _text("c", F.col("c_custkey")).alias("component_id"))
    orders = o.join(owner, F.col("o_custkey") == F.col("c_custkey")).select("root_id", "component_id", F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    return D.tree_documents(nodes, {"orders": orders})


def _bill(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Brands as what the parts' sizes depend on; sizes up to 60, some without parts, as systems."""
    p = F.col("p_partkey")
    name, version = F.lower(F.regexp_replace("p_brand", "#", "-")), _text(p % 5, ".", p % 3)
    components = T.table(spark, sf_dir, "part").select(_text("s", F.col("p_size")).alias("root"), F.when(p % 8 == 0, F.lit("")).otherwise(F.concat(F.lit("pkg:npm/"), name, F.lit("@"), version)).alias("purl"), name.alias("name"), version.alias("version"), F.when(p % 3 == 0, F.lit("required")).otherwise(F.lit("")).alias("scope"), F.when(p % 4 == 1, F.lit("MIT")).otherwise(F.lit("")).alias("license"))
    roots = T.table(spark, sf_dir, "supplier").select(_text("s", F.col("s_suppkey") % 60).alias("root")).distinct()
    owner = F.array(F.struct(F.lit("owner").alias("name"), F.col("root").alias("value")))
    return components.distinct(), roots.select("root", F.when(F.col("root") != "s7", F.col("root")).alias("name"), F.when(F.col("root").endswith("1"), owner).alias("properties"))


_BILL = """SELECT DISTINCT 's' || p_size AS root, CASE WHEN p_partkey % 8 = 0 THEN '' ELSE 'pkg:npm/' || lower(replace(p_brand, '#', '-')) || '@' || (p_partkey % 5) || '.' || (p_partkey % 3) END AS purl, lower(replace(p_brand, '#', '-')) AS name,
  (p_partkey % 5) || '.' || (p_partkey % 3) AS version, CASE WHEN p_partkey % 3 = 0 THEN 'required' ELSE '' END AS scope, CASE WHEN p_partkey % 4 = 1 THEN 'MIT' ELSE '' END AS license FROM part"""
_ROOTS = "SELECT DISTINCT 's' || (s_suppkey % 60) AS root FROM supplier"


@query(f"""WITH c AS ({_BILL}), r AS ({_ROOTS}),
x AS (SELECT *, '{{"type":"library","name":' || to_json(name) || ',"version":' || to_json(version) || CASE WHEN purl <> '' THEN ',"purl":' || to_json(purl) ELSE '' END || CASE WHEN scope <> '' THEN ',"scope":' || to_json(scope) ELSE '' END || CASE WHEN license <> '' THEN ',"licenses":[{{"license":{{"id":' || to_json(license) || '}}}}]' ELSE '' END || '}}' AS item FROM c),
l AS (SELECT root, string_agg(item, ',' ORDER BY purl, name, version, item) AS list FROM x GROUP BY 1),
m AS (SELECT root, concat_ws(',', CASE WHEN root <> 's7' THEN '"component":{{"type":"application","name":' || to_json(root) || '}}' END, CASE WHEN root LIKE '%1' THEN '"properties":[{{"name":"owner","value":' || to_json(root) || '}}]' END) AS inner_ FROM r)
SELECT root, '{{"$schema":"http://cyclonedx.org/schema/bom-1.7.schema.json","bomFormat":"CycloneDX","specVersion":"1.7","version":1' || CASE WHEN inner_ <> '' THEN ',"metadata":{{' || inner_ || '}}' ELSE '' END || ',"components":[' || coalesce(list, '') || ']}}' AS document FROM m LEFT JOIN l USING (root)""")
def cyclonedx_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.cyclonedx_documents(*_bill(spark, sf_dir))


_FREE = '"downloadLocation":"NOASSERTION","licenseConcluded":"NOASSERTION","licenseDeclared":"NOASSERTION"'


@query(f"""WITH c AS (SELECT root, 'SPDXRef-Package-' || substr(sha256(CASE WHEN purl <> '' THEN purl ELSE name || '@' || version END), 1, 16) AS id, name, version, purl FROM ({_BILL})),
d AS (SELECT root, id, min({{'name': name, 'version': version, 'purl': purl}}) AS x FROM c GROUP BY 1, 2),
l AS (SELECT root, string_agg('{{"SPDXID":"' || id || '","name":' || to_json(x.name) || ',"versionInfo":' || to_json(x.version) || ',{_FREE}' || CASE WHEN x.purl <> '' THEN ',"externalRefs":[{{"referenceCategory":"PACKAGE-MANAGER","referenceType":"purl","referenceLocator":' || to_json(x.purl) || '}}]' ELSE '' END || '}}', ',' ORDER BY id) AS packages,
  string_agg('{{"spdxElementId":"SPDXRef-RootPackage","relationshipType":"CONTAINS","relatedSpdxElement":"' || id || '"}}', ',' ORDER BY id) AS relations FROM d GROUP BY 1)
SELECT r.root, '{{"spdxVersion":"SPDX-2.3","dataLicense":"CC0-1.0","SPDXID":"SPDXRef-DOCUMENT","name":' || to_json(r.root) || ',"packages":[{{"SPDXID":"SPDXRef-RootPackage","name":' || to_json(r.root) || ',{_FREE}}}' || coalesce(',' || packages, '') || '],"relationships":[{{"spdxElementId":"SPDXRef-DOCUMENT","relationshipType":"DESCRIBES","relatedSpdxElement":"SPDXRef-RootPackage"}}' || coalesce(',' || relations, '') || ']}}' AS document FROM ({_ROOTS}) r LEFT JOIN l USING (root)""")
def spdx_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    components, roots = _bill(spark, sf_dir)
    return D.spdx_documents(components, roots.select("root", F.col("root").alias("name")))
