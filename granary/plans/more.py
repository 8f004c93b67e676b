"""Registered queries of listings, maps and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import versions as V
from ..functions.licenses import toml_license
from ..functions.versions import toolset_version
from ..operators import aggregates as A
from ..operators import graphs as G
from ..operators import listings as Z
from ..operators import rules as R
from ..sources import files
from . import relations as T
from .registry import query

RESOURCES = ("aws_instance", "aws_s3_bucket", "google_cloud_run_service", "azurerm_sql_database", "aws_vpc", "random_id", "google_compute_disk")
_PICK = "list_extract(['aws_instance', 'aws_s3_bucket', 'google_cloud_run_service', 'azurerm_sql_database', 'aws_vpc', 'random_id', 'google_compute_disk'], (p_partkey % 7 + 1)::INT)"


@query(f"""WITH r AS (SELECT {_PICK} AS t FROM part), c AS (SELECT string_split(t, '_')[1] AS provider, CASE t WHEN 'aws_instance' THEN 'compute' WHEN 'aws_s3_bucket' THEN 'storage' WHEN 'google_compute_disk' THEN 'storage' WHEN 'google_cloud_run_service' THEN 'container' WHEN 'azurerm_sql_database' THEN 'database' WHEN 'aws_vpc' THEN 'networking' ELSE 'other' END AS category FROM r)
SELECT 'provider' AS "by", provider AS value, count(*) AS n FROM c GROUP BY provider UNION ALL SELECT 'category', category, count(*) FROM c GROUP BY category UNION ALL SELECT 'total', '', count(*) FROM c""")
def resource_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, RESOURCES)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return Z.resource_rollup(T.table(spark, sf_dir, "part").select(kind.alias("type")))


@query("SELECT p_type AS type, string_agg(DISTINCT lower(p_brand), ',' ORDER BY lower(p_brand)) AS techs, count(DISTINCT lower(p_brand)) AS n FROM part GROUP BY 1")
def techs_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.techs_by_category(T.table(spark, sf_dir, "part").select(F.lower("p_brand").alias("tech"), F.col("p_type").alias("type")))


@query("""WITH m AS (SELECT DISTINCT o_custkey AS parent_id, lower(o_orderstatus) AS tech FROM orders) SELECT parent_id, upper(tech) AS name, tech, tech = 'o' AS is_primary_tech, tech <> 'f' AS create_edges FROM m WHERE tech IN ('o', 'f')""")
def implicit_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("o", "O", "db", True, True, True, 0), ("f", "F", "db", True, False, False, 1), ("p", "P", "x", False, False, True, 2), ("o", "other", "db", False, False, False, 3)], "tech string, name string, type string, is_component boolean, is_primary_tech boolean, create_edges boolean, rule_order int")
    return Z.implicit_components(T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("component_id"), F.lower("o_orderstatus").alias("tech")), rules)


@query("SELECT 'L' || (doc_id % 30) AS language, count(*) AS files FROM documents WHERE 'L' || (doc_id % 30) <> 'L3' GROUP BY 1 HAVING count(*) >= 10")
def niche_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "documents").select(F.concat(F.lit("L"), (F.col("doc_id") % 30).cast("string")).alias("language"))
    return Z.niche_languages(rows.withColumn("language", F.when(F.col("language") == "L3", "Python").otherwise(F.col("language"))))


@query(f"WITH c AS ({T.COMPONENTS}) SELECT (SELECT count(*) FROM documents WHERE lang IS NOT NULL) AS files, (SELECT count(DISTINCT lang) FROM documents) AS languages, (SELECT count(*) + 1 FROM c) AS components, (SELECT count(DISTINCT t) FROM (SELECT unnest(tech) AS t FROM c)) AS techs")
def metadata_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.metadata_counts(T.components(spark, sf_dir), T.table(spark, sf_dir, "documents").select(F.col("lang").alias("language")))


@query("SELECT DISTINCT 'https://h/' || (c_nationkey % 7) AS remote_url, c_mktsegment AS branch, substr(sha256(c_mktsegment), 1, 7) AS commit FROM customer")
def git_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "customer").select(F.concat(F.lit("https://h/"), (F.col("c_nationkey") % 7).cast("string")).alias("remote_url"), F.col("c_mktsegment").alias("branch"), F.substring(F.sha2("c_mktsegment", 256), 1, 7).alias("commit"))
    return rows.distinct()


@query("SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '/+$', ''), '\\.git$', '')) AS remote FROM pages")
def remote_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "pages").select("page_id", C.remote_url(F.col("url")).alias("remote"))


@query("""SELECT c_nationkey, substr(sha256('base:' || array_to_string(list_sort(list('/' || c_mktsegment || '/' || c_custkey)), ':')), 1, 20) AS id FROM customer GROUP BY 1""")
def multi_path_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = F.collect_list(F.concat(F.lit("/"), "c_mktsegment", F.lit("/"), F.col("c_custkey").cast("string")))
    return T.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(paths.alias("paths")).select("c_nationkey", C.multi_path_id(F.lit("base"), F.col("paths")).alias("id"))


@query("SELECT lang AS language, sum(n)::BIGINT AS n FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT split_part(role, 'x', 1), count(*) FROM conversations GROUP BY 1) GROUP BY 1")
def union_with_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("n"))
    b = T.table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("language")).agg(F.count("*").alias("n"))
    return a.unionByName(b).groupBy("language").agg(F.sum("n").alias("n"))


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "customer").select("c_custkey").distinct().join(T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query(f"""WITH deps AS ({T.DEPENDENCIES}) SELECT DISTINCT type, CASE type WHEN 'npm' THEN 'npm' WHEN 'maven' THEN 'maven' ELSE 'pypi' END AS system, name, CASE WHEN type = 'pypi' THEN regexp_replace(name, '[-_.]+', '-', 'g') ELSE name END AS key FROM deps""")
def package_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.dependencies(spark, sf_dir).select("type", V.package_system(F.col("type")).alias("system"), "name", Z.package_key(F.col("type"), F.col("name")).alias("key")).distinct()


@query(f"""WITH p AS ({T.PAGE_PATHS}), places AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM p), v AS (SELECT regexp_extract(path, '^/[^/]+', 0) AS v_dir, 'k' AS key, max(page_id)::VARCHAR AS value FROM p GROUP BY 1 UNION ALL SELECT regexp_extract(path, '^/[^/]+/fr', 0), 'k', 'deep' || max(page_id) FROM p GROUP BY 1)
SELECT dir, key, arg_max(value, length(v_dir)) AS value FROM places JOIN v ON v_dir <> '' AND (dir = v_dir OR starts_with(dir, v_dir || '/')) GROUP BY 1, 2""")
def nearest_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.page_paths(spark, sf_dir).select("page_id", "path")
    up = p.groupBy(F.regexp_extract("path", "^/[^/]+", 0).alias("v_dir")).agg(F.lit("k").alias("key"), F.max("page_id").cast("string").alias("value"))
    deep = p.groupBy(F.regexp_extract("path", "^/[^/]+/fr", 0).alias("v_dir")).agg(F.lit("k").alias("key"), F.concat(F.lit("deep"), F.max("page_id").cast("string")).alias("value"))
    return Z.nearest_values(p.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir")), up.unionByName(deep))


@query("""WITH r AS (SELECT user_id % 50 AS component_id, CASE event_type WHEN 'click' THEN 'docker' ELSE event_type END AS key, 'v' || (event_id % 5) AS v, event_id AS w FROM events)
SELECT component_id, key, CASE WHEN key = 'docker' THEN string_agg(v, ',' ORDER BY w) ELSE arg_max(v, w) END AS value FROM r GROUP BY 1, 2""")
def merged_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events")
    rows = e.select((F.col("user_id") % 50).alias("component_id"), F.when(F.col("event_type") == "click", "docker").otherwise(F.col("event_type")).alias("key"), F.array(F.concat(F.lit("v"), (F.col("event_id") % 5).cast("string"))).alias("value"), F.col("event_id").alias("walk_order"))
    return Z.merged_properties(rows).select("component_id", "key", F.array_join("value", ",").alias("value"))


@query("""SELECT doc_id, format('{:,}', n_chars) AS pretty, floor(n_chars::DOUBLE / 7 * 100 + 0.5) / 100 AS sevenths FROM documents""")
def number_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents").select("doc_id", C.thousands(F.col("n_chars")).alias("pretty"), C.round2(F.col("n_chars") / 7).alias("sevenths"))


@query(f"""WITH deps AS ({T.DEPENDENCIES}), e AS (SELECT 'brand-' || (o_orderkey % 5) AS "from", 'brand-' || (o_custkey % 9) AS "to", 'online' AS source FROM orders UNION ALL SELECT DISTINCT name, 'brand-1', 'crawl' FROM deps)
SELECT "from", "to", max(source) AS source FROM e GROUP BY 1, 2""")
def hybrid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.maven import hybrid

    o = T.table(spark, sf_dir, "orders")
    first = o.select(F.concat(F.lit("brand-"), (F.col("o_orderkey") % 5).cast("string")).alias("from"), F.concat(F.lit("brand-"), (F.col("o_custkey") % 9).cast("string")).alias("to"), F.lit("online").alias("source"))
    second = T.dependencies(spark, sf_dir).select(F.col("name").alias("from"), F.lit("brand-1").alias("to"), F.lit("crawl").alias("source")).distinct()
    return hybrid(first, second)


@query(f"""WITH e AS ({T.TREE_EDGES}), n AS (SELECT "from" AS node FROM e UNION SELECT "to" FROM e) SELECT node FROM n""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.sbom import graph_nodes as nodes

    return nodes(T.tree_edges(spark, sf_dir))


@query("""SELECT doc_id, text LIKE '%' || chr(13) || '%' AS has_cr, n_chars > 5000 AS large, length(text) <> octet_length(encode(text)) AS wide FROM documents""")
def text_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return T.table(spark, sf_dir, "documents").select("doc_id", t.contains("\r").alias("has_cr"), (F.col("n_chars") > 5000).alias("large"), (F.length(t) != F.octet_length(t)).alias("wide"))


@query(f"""WITH c AS ({T.COMPONENTS}) SELECT top_dir, count(*) AS components, sum(code)::BIGINT AS code FROM (SELECT 'd' || (group_id % 6) AS top_dir, code FROM c) GROUP BY 1 ORDER BY code DESC, top_dir LIMIT 5""")
def component_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.components(spark, sf_dir).select(C.top_dir(F.concat(F.lit("/d"), (F.col("group_id") % 6).cast("string"), F.lit("/x"))).alias("top_dir"), "code")
    return c.groupBy("top_dir").agg(F.count("*").alias("components"), F.sum("code").alias("code")).orderBy(F.desc("code"), "top_dir").limit(5)


@query("""WITH r AS (SELECT o_custkey AS component, o_orderstatus AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) SELECT component, value FROM r WHERE rn = 1""")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("component"), F.col("o_orderstatus").alias("value"), "o_orderkey")
    return A.first_per_key(o, ["component"], [F.col("o_orderkey")]).select("component", "value")


@query("""SELECT user_id, event_type, max(struct_pack(t := ts, v := value)).v AS value FROM events GROUP BY 1, 2""")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("system"), F.col("user_id").cast("string").alias("name"), F.col("ts").alias("fetched_at"), "value")
    return G.upsert_cache(rows.limit(0), rows).select(F.col("name").cast("long").alias("user_id"), F.col("system").alias("event_type"), "value")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'MIT' WHEN 1 THEN 'Apache-2.0' WHEN 2 THEN 'GPL-3.0' WHEN 3 THEN 'BSD-2-Clause' ELSE 'Own-' || p_size END AS license FROM part""")
def toml_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License values of project files in their forms: quoted either way, tables with a text, plain."""
    forms = F.element_at(F.array(F.lit('"MIT License"'), F.lit("'apache 2.0'"), F.lit('{ text = "gpl v3" }'), F.lit("{text='BSD 2 Clause', x = 1}"), F.concat(F.lit(" Own-"), "p_size")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return T.table(spark, sf_dir, "part").select("p_partkey", toml_license(forms).alias("license"))


@query("""SELECT toolset, count(*) AS n, any_value(CASE toolset WHEN 'v100' THEN 'VS2010' WHEN 'v110' THEN 'VS2012' WHEN 'v120' THEN 'VS2013' WHEN 'v140' THEN 'VS2015' WHEN 'v141' THEN 'VS2017' WHEN 'v142' THEN 'VS2019' WHEN 'v143' THEN 'VS2022' ELSE '' END) AS studio
FROM (SELECT 'v' || (100 + CASE WHEN p_size < 20 THEN p_size % 5 * 10 ELSE 40 + p_size % 4 END) AS toolset FROM part) GROUP BY toolset""")
def toolset_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = 100 + F.when(F.col("p_size") < 20, F.col("p_size") % 5 * 10).otherwise(40 + F.col("p_size") % 4)
    toolsets = T.table(spark, sf_dir, "part").select(F.concat(F.lit("v"), number.cast("string")).alias("toolset"))
    return toolsets.groupBy("toolset").agg(F.count("*").alias("n")).select("toolset", "n", toolset_version(F.col("toolset")).alias("studio"))


_FOLDER = "'/a' || (p_partkey % 3) || '/b' || (p_partkey % 5)"


def _folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as packages in directories of two levels."""
    k = F.col("p_partkey")
    folder = F.concat(F.lit("/a"), (k % 3).cast("string"), F.lit("/b"), (k % 5).cast("string"))
    return T.table(spark, sf_dir, "part").select("p_partkey", folder.alias("dir"), F.col("p_brand").alias("name"), "p_size")


@query(f"""WITH r AS (SELECT p_partkey, {_FOLDER} AS dir, p_brand AS name FROM part),
l AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN '/a0' ELSE '/a1/b2' END AS l_dir, p_brand AS l_name, min(p_size)::VARCHAR AS l_version FROM part WHERE p_partkey % 7 < 2 GROUP BY 1, 2)
SELECT p_partkey, dir, l_version AS near FROM r LEFT JOIN l ON l_name = name AND l_dir = CASE WHEN dir = '/a1/b2' THEN '/a1/b2' WHEN dir LIKE '/a0/%' THEN '/a0' END""")
def nearest_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _folders(spark, sf_dir)
    listed = rows.where("p_partkey % 7 < 2").withColumn("l_dir", F.when(F.col("p_partkey") % 2 == 0, "/a0").otherwise("/a1/b2")).groupBy("l_dir", F.col("name").alias("l_name")).agg(F.min("p_size").cast("string").alias("l_version"))
    return Z.nearest_versions(rows, rows.select("dir").distinct(), listed).select("p_partkey", "dir", "near")


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '1.' || CASE WHEN dir LIKE '/a2/%' THEN 'two' ELSE 'one' END WHEN p_partkey % 4 = 1 THEN 'one-${{unknown}}' WHEN p_partkey % 4 = 2 AND dir LIKE '/a2/%' THEN 'two.x' WHEN p_partkey % 4 = 2 THEN '$deep.x' ELSE p_size::VARCHAR END AS version
FROM (SELECT p_partkey, p_size, {_FOLDER} AS dir FROM part)""")
def filled_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = spark.createDataFrame([("/", "own", "one"), ("/", "base", "one"), ("/a2", "own", "two"), ("/a2", "deep", "${own}"), ("/elsewhere", "unknown", "x")], "v_dir string, key string, value string")
    rows = _folders(spark, sf_dir)
    forms = F.element_at(F.array(F.lit("1.$own"), F.lit("${base}-${unknown}"), F.lit("${deep}.x"), F.col("p_size").cast("string")), (F.col("p_partkey") % 4 + 1).cast("int"))
    forms = F.when((F.col("p_partkey") % 4 == 2) & ~F.col("dir").startswith("/a2/"), F.lit("$deep.x")).otherwise(forms)
    return Z.with_properties(rows.withColumn("version", forms), rows.select("dir").distinct(), values).select("p_partkey", "version")


@query("""SELECT ecosystem, coordinate, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' END AS ecosystem,
CASE p_partkey % 3 WHEN 1 THEN lower(replace(p_brand, '_', '-')) ELSE p_brand END AS coordinate, '/d' || (p_partkey % 20) || '/manifest' AS path FROM part WHERE p_partkey % 3 < 2) GROUP BY 1, 2""")
def source_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("nodejs"), F.lit("python"), F.lit("terraform-root")), (F.col("p_partkey") % 3 + 1).cast("int"))
    built = T.table(spark, sf_dir, "part").select(kind.alias("type"), F.col("p_brand").alias("name"), F.concat(F.lit("/d"), (F.col("p_partkey") % 20).cast("string"), F.lit("/manifest")).alias("path"))
    return Z.source_index(built).withColumn("paths", F.array_join("paths", ","))


@query("""SELECT dir, count(*) AS files FROM (SELECT 'd' || (p_partkey % 9) || '/' || CASE p_partkey % 4 WHEN 0 THEN 'vendor' WHEN 1 THEN 'node_modules' WHEN 2 THEN 'third-party' ELSE 'vendors' END AS dir, p_partkey FROM part)
WHERE dir NOT LIKE '%vendors' AND p_partkey % 9 <> 5 GROUP BY 1 HAVING count(*) >= 5 ORDER BY files DESC, dir LIMIT 5""")
def vendored_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    top = F.concat(F.when(k % 9 == 5, F.lit("/.d")).otherwise(F.lit("/d")), (k % 9).cast("string"), F.lit("/"))
    path = F.concat(top, F.element_at(F.array(F.lit("vendor"), F.lit("node_modules"), F.lit("third-party"), F.lit("vendors")), (k % 4 + 1).cast("int")), F.lit("/x.c"))
    return A.directory_counts(T.table(spark, sf_dir, "part").select(path.alias("path")), Z.vendored(F.col("path")))


_OUTCOME = "CASE WHEN value IS NULL OR value < 20 THEN 'cached' WHEN value < 60 THEN 'fetched' WHEN value < 80 THEN 'missing' WHEN value < 90 THEN 'denied' ELSE 'failed' END"


@query(f"""SELECT event_type AS source, count(*) AS lookups, {', '.join(f"count(*) FILTER (o = '{o}') AS {o}" for o in Z.OUTCOMES)} FROM (SELECT event_type, {_OUTCOME} AS o, event_id FROM events WHERE event_id % 3 <> 0) GROUP BY 1""")
def resolver_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the counters have grown by between two snapshots."""
    rows = T.table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.expr(_OUTCOME).alias("outcome"), "event_id")
    return Z.resolver_delta(Z.resolver_counts(rows), Z.resolver_counts(rows.where("event_id % 3 = 0")))


@query("""WITH f AS (SELECT p_partkey, '/d' || (p_partkey % 50) || '/' || CASE p_partkey % 3 WHEN 0 THEN 'tool.lock' WHEN 1 THEN 'tool.toml' ELSE 'other' || p_partkey END AS path FROM part),
hit AS (SELECT DISTINCT '/d' || (p_partkey % 50) AS dir FROM part WHERE p_partkey % 3 = 1 AND p_partkey % 50 < 25)
SELECT DISTINCT path FROM f WHERE path LIKE '%/tool.lock' AND replace(path, '/tool.lock', '') NOT IN (SELECT dir FROM hit)""")
def late_file_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second pass over names: only where the first has not found the technology in the directory."""
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.lit("tool.lock")).when(k % 3 == 1, F.lit("tool.toml")).otherwise(F.concat(F.lit("other"), k.cast("string")))
    files = T.table(spark, sf_dir, "part").select(k.alias("k"), F.concat(F.lit("/d"), (k % 50).cast("string"), F.lit("/"), name).alias("path"), name.alias("name"), F.concat(F.lit("/d"), (k % 50).cast("string")).alias("dir"))
    rules = lambda x: spark.createDataFrame([("tool", x)], "tech string, pattern string")
    first = R.match_names(files.where("k % 50 < 25"), rules("tool.toml"))
    return R.match_late_names(files, rules("tool.lock"), first).select("path")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'SQL' WHEN doc_id % 3 = 1 THEN NULL ELSE 'Text' END AS language, CASE WHEN doc_id % 3 = 0 THEN 'data' WHEN doc_id % 3 = 1 THEN 'generated' ELSE 'prose' END AS language_type FROM documents""")
def reclassified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages after rules on paths: the first that matches; one with a type only leaves the language empty."""
    path = F.concat(F.lit("/"), F.element_at(F.array(F.lit("db/x/"), F.lit("gen/"), F.lit("doc/")), (F.col("doc_id") % 3 + 1).cast("int")), F.col("doc_id").cast("string"), F.lit(".txt"))
    rows = T.table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.lit("Text").alias("language"), F.lit("prose").alias("language_type"))
    rules = [{"match": "db/**/*.txt", "language": "SQL"}, {"match": "gen/*", "type": "generated"}, {"match": "{db,gen}/**", "language": "Go"}]
    return files.reclassified(rows, rules).select("doc_id", "language", "language_type")
