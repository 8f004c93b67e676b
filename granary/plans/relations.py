"""The engine's relations, read off the star-schema tables: dependencies, files, components, edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How columns of the tables stand for the vocabulary of the engine.
TYPE_OF_FLAG = {"A": "npm", "R": "maven", "N": "pypi"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dependencies(spark: SparkSession, sf_dir: str, places: bool = False) -> DataFrame:
    """One row per line item: a package (part brand) of a type (return flag) in a component (supplier).

    With places also the file and the row in it, which tell items of one order and line apart.
    """
    place = {"file": "_metadata.file_path", "row": "_metadata.row_index"} if places else {}
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", *[F.col(c).alias(k) for k, c in place.items()])
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    n = F.col("l_linenumber")
    kind = F.when(F.col("l_returnflag") == "A", "npm").when(F.col("l_returnflag") == "R", "maven").otherwise("pypi")
    scope = F.when(n == 1, "prod").when(n == 2, "dev").when(n == 3, "optional").when(n == 4, "").otherwise(F.when(F.col("l_linestatus") == "O", "test").otherwise("build"))
    version = F.when(n == 5, F.lit("latest")).when(n == 6, F.concat(F.lit("^"), F.col("p_size").cast("string"), F.lit(".0"))).otherwise(F.concat_ws(".", F.col("p_size").cast("string"), (F.col("l_orderkey") % 7).cast("string"), n.cast("string")))
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("component_id"),
        kind.alias("type"),
        F.lower(F.regexp_replace("p_brand", "#", "-")).alias("name"),
        version.alias("version"),
        scope.alias("scope"),
        (n == 1).alias("direct"),
        F.when(n % 2 == 0, F.concat(F.lit("manifest-"), (F.col("l_orderkey") % 13).cast("string"))).otherwise(F.lit("")).alias("source"),
        F.when(n % 3 == 0, F.lit("MIT")).otherwise(F.lit("")).alias("license"),
        (F.col("l_orderkey") * 10 + n).alias("walk_order"),
        *place,
    )


DEPENDENCIES = """
SELECT l_suppkey AS component_id,
       CASE l_returnflag WHEN 'A' THEN 'npm' WHEN 'R' THEN 'maven' ELSE 'pypi' END AS type,
       lower(replace(p_brand, '#', '-')) AS name,
       CASE WHEN l_linenumber = 5 THEN 'latest' WHEN l_linenumber = 6 THEN '^' || p_size || '.0' ELSE p_size || '.' || (l_orderkey % 7) || '.' || l_linenumber END AS version,
       CASE WHEN l_linenumber = 1 THEN 'prod' WHEN l_linenumber = 2 THEN 'dev' WHEN l_linenumber = 3 THEN 'optional' WHEN l_linenumber = 4 THEN ''
            WHEN l_linestatus = 'O' THEN 'test' ELSE 'build' END AS scope,
       l_linenumber = 1 AS direct,
       CASE WHEN l_linenumber % 2 = 0 THEN 'manifest-' || (l_orderkey % 13) ELSE '' END AS source,
       CASE WHEN l_linenumber % 3 = 0 THEN 'MIT' ELSE '' END AS license,
       l_orderkey * 10 + l_linenumber AS walk_order
FROM lineitem JOIN part ON l_partkey = p_partkey
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: a file of a component (source), in a language, with its text."""
    d = table(spark, sf_dir, "documents")
    ext = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "de", ".go").when(F.col("lang") == "fr", ".rs").otherwise(".md")
    name = F.concat(F.lit("file"), F.col("doc_id").cast("string"), ext)
    return d.select("doc_id", F.concat(F.lit("/"), "source", F.lit("/d"), (F.col("doc_id") % 5).cast("string"), F.lit("/"), name).alias("path"), name.alias("name"), ext.alias("ext"), F.col("lang").alias("language"), F.col("source").alias("component"), "text")


FILES = """
SELECT doc_id, '/' || source || '/d' || (doc_id % 5) || '/' || 'file' || doc_id || e AS path, 'file' || doc_id || e AS name, e AS ext, lang AS language, source AS component, text
FROM (SELECT *, CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.go' WHEN 'fr' THEN '.rs' ELSE '.md' END AS e FROM documents)
"""


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: its URL as a path, host first, without query and fragment."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", "/"), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), "html")


PAGE_PATHS = "SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', '/'), '[?#].*$', '') AS path, html FROM pages"


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: a component of a type (priority; none for the last), with technologies and code."""
    o = table(spark, sf_dir, "orders")
    techs = F.array(F.lower("o_orderstatus"), F.concat(F.lit("t"), (F.col("o_custkey") % 9).cast("string")))
    kind = F.when(F.col("o_orderpriority").startswith("5"), F.lit("")).otherwise(F.lower(F.substring("o_orderpriority", 3, 20)))
    return o.select(F.col("o_orderkey").alias("component_id"), kind.alias("type"), techs.alias("tech"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(0)).otherwise(F.floor("o_totalprice")).cast("long").alias("code"), (F.col("o_custkey") % 20).alias("group_id"))


COMPONENTS = """
SELECT o_orderkey AS component_id, CASE WHEN o_orderpriority LIKE '5%' THEN '' ELSE lower(substr(o_orderpriority, 3, 20)) END AS type,
       [lower(o_orderstatus), 't' || (o_custkey % 9)] AS tech, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE floor(o_totalprice)::BIGINT END AS code, o_custkey % 20 AS group_id
FROM orders
"""


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region → nation → customer, as node names."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("from"), F.concat(F.lit("n"), "n_nationkey").alias("to"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("from"), F.concat(F.lit("c"), "c_custkey").alias("to"))
    return n.unionByName(c)


TREE_EDGES = "SELECT 'r' || n_regionkey AS \"from\", 'n' || n_nationkey AS \"to\" FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer"


def child_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages (part keys modulo 97) and the packages they need: a graph with diamonds and cycles."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("g"), (F.col("p_partkey") % 97).cast("string")).alias("parent"),
        F.concat(F.lit("v"), (F.col("p_partkey") % 3).cast("string")).alias("parent_version"),
        F.concat(F.lit("g"), ((F.col("p_partkey") * 7 + F.col("p_partkey") % 5 * 3) % 97).cast("string")).alias("child"),
        F.concat(F.lit("v"), ((F.col("p_partkey") + 1) % 3).cast("string")).alias("child_version"),
        F.col("p_partkey").alias("ord"),
    )


CHILD_PACKAGES = """
SELECT 'g' || (p_partkey % 97) AS parent, 'v' || (p_partkey % 3) AS parent_version, 'g' || ((p_partkey * 7 + p_partkey % 5 * 3) % 97) AS child,
       'v' || ((p_partkey + 1) % 3) AS child_version, p_partkey AS ord
FROM part
"""
