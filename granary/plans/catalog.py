"""Every registered query of the engine, with the SQL that DuckDB checks it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import licenses as L
from ..functions import versions as V
from ..operators import aggregates as A
from ..operators import graphs as G
from ..operators import rules as R
from . import formats as formats  # registers its queries
from . import matching as matching  # registers its queries
from . import more as more  # registers its queries
from . import resolution as resolution  # registers its queries
from . import sourcecode as sourcecode  # registers its queries
from . import relations as T
from .registry import QUERIES, SQL, query

# Rules that the queries match by: (technology, dependency type, pattern).
EXACT_RULES = [("react", "npm", "brand-1"), ("vue", "npm", "brand-2"), ("spring", "maven", "brand-3"), ("ktor", "gradle", "brand-4"), ("django", "pypi", "brand-5"), ("flask", "pypi", "brand-6"), ("webpack", "npm", "brand-3")]
REGEX_RULES = [("aws", "npm", "^brand-1[0-9]$"), ("azure", "maven", "^brand-2"), ("testing", "pypi", "-(7|8|9)$")]


def _values(rows: list[tuple], names: str) -> str:
    cells = ", ".join("(" + ", ".join("NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {cells}) AS v({names}))"


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


_RULE_SQL = f"""
WITH deps AS ({T.DEPENDENCIES}), rules AS {_values(EXACT_RULES, 'tech, dep_type, pattern')},
every AS (SELECT tech, dep_type, pattern FROM rules UNION SELECT tech, CASE dep_type WHEN 'maven' THEN 'gradle' ELSE 'maven' END, pattern FROM rules WHERE dep_type IN ('maven', 'gradle'))
"""
_REGEX_SQL = f"""{_RULE_SQL}, regexes AS {_values(REGEX_RULES, 'tech, dep_type, pattern')},
found AS (
  SELECT component_id, type, name, tech FROM deps JOIN every ON type = dep_type AND name = pattern
  UNION SELECT component_id, type, name, tech FROM deps JOIN regexes ON type = dep_type AND regexp_matches(name, pattern)
)"""


def _rules(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return _frame(spark, rows, "tech string, dep_type string, pattern string")


@query(f"{_RULE_SQL} SELECT component_id, type, name, tech FROM deps JOIN every ON type = dep_type AND name = pattern GROUP BY ALL")
def rule_join_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = T.dependencies(spark, sf_dir).select("component_id", "type", "name")
    return R.match_dependencies(deps, _rules(spark, EXACT_RULES)).select("component_id", "type", "name", "tech").distinct()


@query(f"{_REGEX_SQL} SELECT component_id, type, name, tech FROM found")
def rule_join_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = T.dependencies(spark, sf_dir).select("component_id", "type", "name")
    return R.match_dependencies(deps, _rules(spark, EXACT_RULES), REGEX_RULES).select("component_id", "type", "name", "tech")


@query(f"{_REGEX_SQL} SELECT component_id, string_agg(DISTINCT tech, ',' ORDER BY tech) AS techs, count(DISTINCT tech)::BIGINT AS n_techs FROM found GROUP BY component_id")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies matched against exact and regular-expression rules: the technologies of each component."""
    deps = T.dependencies(spark, sf_dir).select("component_id", "type", "name")
    found = R.match_dependencies(deps, _rules(spark, EXACT_RULES), REGEX_RULES)
    return found.groupBy("component_id").agg(F.array_join(F.array_sort(F.collect_set("tech")), ",").alias("techs"), F.count_distinct("tech").alias("n_techs"))


@query(f"""{_REGEX_SQL}, r AS (SELECT tech, 'matched dependency: ' || name AS reason, min(component_id) AS w FROM found GROUP BY ALL)
SELECT tech, string_agg(reason, '; ' ORDER BY w, reason) AS reasons FROM r GROUP BY tech""")
def reasons_by_tech(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = T.dependencies(spark, sf_dir).select("component_id", "type", "name")
    found = R.match_dependencies(deps, _rules(spark, EXACT_RULES), REGEX_RULES)
    return A.reasons_by_tech(found.select("tech", "reason", F.col("component_id").alias("walk_order")))


_PRIORITY = "CASE scope WHEN 'prod' THEN 100 WHEN 'import' THEN 90 WHEN 'system' THEN 80 WHEN 'peer' THEN 70 WHEN 'optional' THEN 60 WHEN 'build' THEN 50 WHEN 'dev' THEN 40 WHEN 'test' THEN 30 WHEN '' THEN 0 ELSE 10 END"


@query(f"""WITH deps AS ({T.DEPENDENCIES})
SELECT type, name, version, bool_or(direct) AS direct, arg_max(scope, ({_PRIORITY})::BIGINT * 100000000000 - walk_order) AS scope,
       arg_min(source, walk_order) FILTER (source <> '') AS source, arg_min(license, walk_order) FILTER (license <> '') AS license, count(*) AS occurrences
FROM deps GROUP BY type, name, version""")
def dependency_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.merged_dependencies(T.dependencies(spark, sf_dir))


@query("SELECT DISTINCT lang AS value FROM documents WHERE lang <> ''")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distinct_values(T.table(spark, sf_dir, "documents").select(F.array("lang").alias("techs")), "techs")


@query("SELECT lang AS language, count(*) AS files, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def languages_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))


@query("""SELECT "from", "to", arg_max(source, walk_order) AS source, arg_max(scope, walk_order) AS scope FROM (
  SELECT 'c' || o_custkey AS "from", 'p' || (o_orderkey % 11) AS "to", o_orderstatus AS source, o_orderpriority AS scope, o_orderkey AS walk_order FROM orders) GROUP BY ALL""")
def edges_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = T.table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("from"), F.concat(F.lit("p"), (F.col("o_orderkey") % 11).cast("string")).alias("to"), F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("scope"), F.col("o_orderkey").alias("walk_order"))
    return A.merged_edges(edges)


@query("""SELECT r_name AS region, n_name AS nation, count(c_custkey) AS components FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def flatten_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, c = (T.table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    counted = c.groupBy("c_nationkey").agg(F.count("*").alias("components"))
    return r.join(n, F.col("n_regionkey") == F.col("r_regionkey")).join(counted, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.coalesce("components", F.lit(0)).alias("components"))


_LINES = f"""files AS ({T.FILES}), ls AS (
  SELECT *, CASE WHEN coalesce(text, '') = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(text, '\\n$', ''), chr(10)) END AS l FROM files
), counted AS (
  SELECT * EXCLUDE (l, text), len(l)::BIGINT AS lines, len(list_filter(l, lambda x: trim(x) = ''))::BIGINT AS blanks, len(list_filter(l, lambda x: ltrim(x)[1] IN ('L', 'E')))::BIGINT AS comments,
         len(list_filter(l, lambda x: contains(x, ', ')))::BIGINT AS complexity FROM ls
), measured AS (SELECT *, lines - blanks - comments AS code FROM counted)"""


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with line counts; a line that begins with E or L counts as a comment, one with a comma as a branch."""
    lines = F.split(F.regexp_replace("text", "\n$", ""), "\n")
    lines = F.when(F.coalesce("text", F.lit("")) == "", F.array().cast("array<string>")).otherwise(lines)
    first = lambda x: F.substring(F.ltrim(x), 1, 1).isin("L", "E")
    f = T.files(spark, sf_dir).withColumn("l", lines)
    f = f.withColumns({"lines": F.size("l").cast("long"), "blanks": F.size(F.filter("l", lambda x: F.trim(x) == "")).cast("long"), "comments": F.size(F.filter("l", first)).cast("long"), "complexity": F.size(F.filter("l", lambda x: x.contains(", "))).cast("long")})
    return f.withColumn("code", F.col("lines") - F.col("blanks") - F.col("comments")).drop("l", "text")


_SUMS = "count(*) AS files, sum(lines)::BIGINT AS lines, sum(code)::BIGINT AS code, sum(comments)::BIGINT AS comments, sum(blanks)::BIGINT AS blanks, sum(complexity)::BIGINT AS complexity"


@query(f"WITH {_LINES} SELECT language, {_SUMS} FROM measured GROUP BY language")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = A.code_stats(_measured(spark, sf_dir).select("language", "lines", "code", "comments", "blanks", "complexity"))
    return stats.where("language <> ''").drop("level", "key")


_GROUPED = f"""WITH {_LINES}, g AS (
  SELECT grouping(language) AS gl, grouping(component) AS gc, grouping(subsystem) AS gs, language, component, subsystem, {_SUMS}
  FROM (SELECT *, 'd' || (doc_id % 5) AS subsystem FROM measured) GROUP BY GROUPING SETS ((language), (), (component, language), (component), (subsystem, language), (subsystem))
), s AS (
  SELECT CASE WHEN gc = 0 THEN 'component' WHEN gs = 0 THEN 'subsystem' ELSE 'all' END AS level, CASE WHEN gc = 0 THEN component WHEN gs = 0 THEN subsystem ELSE '' END AS key,
         CASE WHEN gl = 0 THEN language ELSE '' END AS language, files, lines, code, comments, blanks, complexity FROM g
)"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _measured(spark, sf_dir).withColumn("subsystem", F.concat(F.lit("d"), (F.col("doc_id") % 5).cast("string")))
    return A.code_stats(f.select("language", "component", "subsystem", "lines", "code", "comments", "blanks", "complexity"), "component", "subsystem")


@query(f"{_GROUPED} SELECT * FROM s")
def code_stats_three_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir)


_ROUND = "CASE WHEN {b} = 0 THEN 0.0 ELSE floor(({a}::DOUBLE / {b}) * 100 + 0.5) / 100 END"


@query(f"""{_GROUPED} SELECT *, {_ROUND.format(a='comments', b='code')} AS comment_ratio, {_ROUND.format(a='code', b='lines')} AS code_density,
  {_ROUND.format(a='lines', b='files')} AS avg_file_size, CASE WHEN code = 0 THEN 0.0 ELSE floor((complexity::DOUBLE / (code::DOUBLE / 1000.0)) * 100 + 0.5) / 100 END AS complexity_per_kloc, {_ROUND.format(a='complexity', b='files')} AS avg_complexity FROM s""")
def code_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = A.metrics(_stats(spark, sf_dir).withColumn("code", F.col("code").cast("double")))
    return stats.withColumn("code", F.col("code").cast("long"))


@query(f"""WITH {_LINES}, b AS (SELECT language, sum(lines)::BIGINT AS lines FROM measured GROUP BY language),
p AS (SELECT language, lines, floor((lines::DOUBLE / (SELECT sum(lines) FROM b)::DOUBLE) * 100 + 0.5) / 100 AS pct FROM b)
SELECT * FROM p WHERE pct >= 0.05 ORDER BY lines DESC, language LIMIT 5""")
def primary_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _measured(spark, sf_dir).groupBy("language").agg(F.sum("lines").alias("lines"))
    return A.primary_languages(by)


ELIGIBLE = [("o",), ("f",), ("t1",), ("t2",), ("t3",)]
_PRIMARY = f"""WITH c AS (SELECT * REPLACE ({{code}} AS code) FROM ({T.COMPONENTS})), eligible AS {_values(ELIGIBLE, 'tech')}, typed AS (SELECT * FROM c WHERE type <> ''),
sizes AS (SELECT count(*) AS typed, count(*) FILTER (code > 0) AS with_code, coalesce(sum(code) FILTER (code > 0), 0) AS total FROM typed),
per AS (SELECT x.tech, count(*) AS n, coalesce(sum(code) FILTER (code > 0), 0) AS code FROM (SELECT component_id, code, unnest(list_distinct(tech)) AS tech FROM typed) x JOIN eligible USING (tech) GROUP BY 1)
SELECT tech FROM per, sizes WHERE CASE WHEN with_code > 0 AND with_code * 2 >= typed THEN code > 0 AND code >= greatest(1, total // 100)
  ELSE n >= CASE WHEN typed <= 10 THEN 1 ELSE greatest(2, 3 * typed // 100) END END"""


def _eligible(spark: SparkSession) -> DataFrame:
    return _frame(spark, ELIGIBLE, "tech string")


@query(_PRIMARY.format(code="code"))
def primary_techs_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.primary_techs(T.components(spark, sf_dir), _eligible(spark))


@query(_PRIMARY.format(code="0::BIGINT"))
def primary_techs_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.primary_techs(T.components(spark, sf_dir).withColumn("code", F.lit(0).cast("long")), _eligible(spark))


_DOMINANT = [("C++", 0.62), ("COBOL", 0.5), ("C", 0.1), ("Python", 0.7)]


@query(f"""WITH c AS ({T.COMPONENTS}), l AS {_values(_DOMINANT, 'language, pct')}
SELECT m.tech FROM l JOIN {_values([('C++', 'cplusplus'), ('C', 'c'), ('COBOL', 'cobol')], 'language, tech')} m USING (language)
WHERE pct >= 0.5 AND m.tech IN ('cplusplus', 'cobol', 'o') AND m.tech NOT IN (SELECT unnest(tech) FROM c WHERE type <> '')
UNION SELECT 'o'""")
def promote_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    eligible = _frame(spark, [("cplusplus",), ("cobol",), ("o",)], "tech string")
    return A.primary_techs(T.components(spark, sf_dir), eligible, _frame(spark, _DOMINANT, "language string, pct double"))


_ECO = {"type": [("urgent", "node"), ("high", "jvm"), ("medium", "jvm")], "tech": [("t1", "python"), ("t2", "node"), ("t3", "python")], "language": [("en", "english"), ("de", "node"), ("fr", "french")]}


@query(f"""WITH c AS ({T.COMPONENTS}), counted AS (
  SELECT ecosystem, count(*) AS components FROM (
    SELECT component_id, ecosystem FROM c JOIN {_values(_ECO['type'], 'type, ecosystem')} USING (type) WHERE type <> ''
    UNION ALL SELECT DISTINCT component_id, ecosystem FROM (SELECT component_id, unnest(tech) AS tech FROM c WHERE type = '') JOIN {_values(_ECO['tech'], 'tech, ecosystem')} USING (tech)) GROUP BY 1)
SELECT * FROM counted UNION ALL
SELECT DISTINCT ecosystem, 1::BIGINT FROM (SELECT DISTINCT lang AS language FROM documents) JOIN {_values(_ECO['language'], 'language, ecosystem')} USING (language) WHERE ecosystem NOT IN (SELECT ecosystem FROM counted)""")
def ecosystems(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = [_frame(spark, rows, f"{k} string, ecosystem string") for k, rows in _ECO.items()]
    return A.ecosystems(T.components(spark, sf_dir), T.table(spark, sf_dir, "documents").select(F.col("lang").alias("language")), *dims)


@query(f"""WITH p AS ({T.PAGE_PATHS}) SELECT page_id, path,
  CASE WHEN len(string_split(path, '/')) > 2 THEN '/' || array_to_string(string_split(path, '/')[2:3], '/') ELSE '' END AS prefix2,
  CASE WHEN regexp_replace(path, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END AS source_dir,
  CASE WHEN len(list_filter(string_split(regexp_replace(path, '/[^/]*$', ''), '/'), lambda x: x <> '')) = 0 THEN '(root)' ELSE array_to_string(list_filter(string_split(regexp_replace(path, '/[^/]*$', ''), '/'), lambda x: x <> '')[1:2], '/') END AS dir_group,
  CASE WHEN len(list_filter(string_split(regexp_replace(path, '/[^/]*$', ''), '/'), lambda x: x <> '')) = 0 THEN '(root)' ELSE list_filter(string_split(regexp_replace(path, '/[^/]*$', ''), '/'), lambda x: x <> '')[1] END AS top_dir
FROM p""")
def path_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return T.page_paths(spark, sf_dir).select("page_id", "path", C.depth_prefix(p, 2).alias("prefix2"), C.source_dir(p).alias("source_dir"), C.dir_group(p).alias("dir_group"), C.top_dir(p).alias("top_dir"))


@query(f"""WITH p AS ({T.PAGE_PATHS}), owners AS (SELECT DISTINCT regexp_extract(path, '^/[^/]+', 0) AS dir, 'host' AS owner FROM p UNION SELECT DISTINCT regexp_extract(path, '^/[^/]+/fr', 0), 'language' FROM p UNION SELECT '/', 'root'),
hit AS (SELECT page_id, path, arg_max(dir, length(dir)) AS owner_dir, arg_max(owner, length(dir)) AS owner FROM p JOIN owners ON dir <> '' AND (dir = '/' OR starts_with(path, dir || '/')) GROUP BY 1, 2)
SELECT * FROM hit""")
def longest_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.page_paths(spark, sf_dir).select("page_id", "path")
    owners = p.select(F.regexp_extract("path", "^/[^/]+", 0).alias("dir"), F.lit("host").alias("owner"))
    owners = owners.unionByName(p.select(F.regexp_extract("path", "^/[^/]+/fr", 0).alias("dir"), F.lit("language").alias("owner"))).unionByName(_frame(spark, [("/", "root")], "dir string, owner string")).distinct()
    return G.nearest_ancestor(p, owners)


IGNORES = [("*.com/**", False, False), ("m.*", False, False), ("**/fr/**", True, False), ("*.html", False, False), ("**/1*", False, True)]


@query(f"""WITH p AS ({T.PAGE_PATHS}), x AS (SELECT page_id, path, substr(path, 2) AS rel, regexp_replace(path, '^.*/', '') AS base, string_split(substr(path, 2), '/') AS parts FROM p),
c AS (SELECT page_id, path, rel, base, false AS is_dir, 0 AS k FROM x UNION ALL SELECT page_id, path, array_to_string(parts[1:k], '/'), parts[k], true, k FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM x)),
v AS (SELECT page_id, path, CASE
  WHEN is_dir AND (regexp_matches(rel, '^(?:.*/)?1[^/]*$') OR regexp_matches(base, '^(?:.*/)?1[^/]*$')) THEN true
  WHEN regexp_matches(rel, '^[^/]*\\.html$') OR regexp_matches(base, '^[^/]*\\.html$') THEN true
  WHEN regexp_matches(rel, '^(?:.*/)?fr/.*$') OR regexp_matches(base, '^(?:.*/)?fr/.*$') THEN false
  WHEN regexp_matches(rel, '^m\\.[^/]*$') OR regexp_matches(base, '^m\\.[^/]*$') THEN true
  WHEN regexp_matches(rel, '^[^/]*\\.com/.*$') OR regexp_matches(base, '^[^/]*\\.com/.*$') THEN true ELSE false END AS hit FROM c)
SELECT page_id, path, bool_or(hit) AS ignored FROM v GROUP BY 1, 2""")
def ignore_last_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.last_match(T.page_paths(spark, sf_dir).select("page_id", "path", F.lit(False).alias("is_dir")), IGNORES).drop("is_dir")


@query(f"""WITH f AS ({T.FILES}) SELECT path, tech FROM f JOIN {_values([('pick', 'file7.py'), ('pick', 'file10.go')], 'tech, pattern')} ON name = pattern
UNION SELECT path, 'globbed' FROM f WHERE regexp_matches(name, '^file[^/]0\\.py$') UNION SELECT path, 'rusty' FROM f WHERE regexp_matches(name, '^[^/]*\\.rs$')
UNION SELECT path, 'third' FROM f WHERE suffix(regexp_replace(path, '/[^/]*$', ''), 'src3/d3')""")
def file_name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = T.files(spark, sf_dir).select("path", "name", F.regexp_replace("path", "/[^/]*$", "").alias("dir"))
    exact = _frame(spark, [("pick", "file7.py"), ("pick", "file10.go")], "tech string, pattern string")
    return R.match_names(f, exact, [("globbed", "file?0.py"), ("rusty", "*.rs")], [("third", "src3/d3")]).select("path", "tech")


@query(f"WITH f AS ({T.FILES}) SELECT path, tech FROM f JOIN {_values([('python', '.py'), ('golang', '.go')], 'tech, ext')} USING (ext)")
def extension_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.match_extensions(T.files(spark, sf_dir).select("path", "ext"), _frame(spark, [("python", "py"), ("golang", ".go")], "tech string, ext string"))


CONTENT_RULES = [
    {"tech": "licensed", "rule_order": 1, "ext": ".py", "pattern": r"Licensed under"},
    {"tech": "licensed", "rule_order": 2, "ext": ".py", "pattern": r"[Ll]icen[cs]e"},
    {"tech": "secretive", "rule_order": 3, "ext": ".go", "pattern": r"token = "},
    {"tech": "shouting", "rule_order": 4, "ext": ".py", "pattern": r"[A-Z]{4,}!!"},
    {"tech": "first", "rule_order": 5, "file": "file1.py", "pattern": r"."},
]


@query(f"""WITH f AS ({T.FILES}) SELECT path, tech, min(rule_order)::INT AS rule_order FROM (
  SELECT path, 'licensed' AS tech, 1 AS rule_order FROM f WHERE ext = '.py' AND regexp_matches(text, 'Licensed under') UNION ALL
  SELECT path, 'licensed', 2 FROM f WHERE ext = '.py' AND regexp_matches(text, '[Ll]icen[cs]e') UNION ALL SELECT path, 'secretive', 3 FROM f WHERE ext = '.go' AND regexp_matches(text, 'token = ') UNION ALL
  SELECT path, 'shouting', 4 FROM f WHERE ext = '.py' AND regexp_matches(text, '[A-Z]{{4,}}!!') UNION ALL SELECT path, 'first', 5 FROM f WHERE name = 'file1.py' AND text <> '') GROUP BY 1, 2""")
def content_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.match_content(T.files(spark, sf_dir), CONTENT_RULES)


VARIABLE_RULES = [("payments", "purch"), ("web", "CLICK"), ("catchall", "c"), ("failing", "error")]


@query("""SELECT event_id, event_type AS var, CASE WHEN contains(lower(event_type), 'purch') THEN 'payments' WHEN contains(lower(event_type), 'click') THEN 'web' WHEN contains(lower(event_type), 'c') THEN 'catchall' WHEN contains(lower(event_type), 'error') THEN 'failing' END AS tech
FROM events WHERE regexp_matches(lower(event_type), 'purch|click|c|error')""")
def variable_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.match_variables(T.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("var")), VARIABLE_RULES)


@query("""SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS has_k, coalesce(json_extract_string(props, '$.k') = '42', false) AS is_42, coalesce(regexp_matches(json_extract_string(props, '$.k'), '^[13]'), false) AS fits, json_extract_string(props, '$.a.b') IS NOT NULL AS has_ab FROM events""")
def json_path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("props")
    return T.table(spark, sf_dir, "events").select("event_id", R.json_predicate(p, "k", None).alias("has_k"), R.json_predicate(p, "k", "42").alias("is_42"), R.json_predicate(p, "k", "/^[13]/").alias("fits"), R.json_predicate(p, "a.b", None).alias("has_ab"))


@query("""SELECT page_id, regexp_matches(html, '(?s)<html(?:\\s[^>]*)?>.*?<head(?:\\s[^>]*)?>.*?<title(?:\\s[^>]*)?>([^<]*)') AS has_title,
  contains(trim(regexp_extract(html, '(?s)<html(?:\\s[^>]*)?>.*?<head(?:\\s[^>]*)?>.*?<title(?:\\s[^>]*)?>([^<]*)', 1)), 'the') AS title_the FROM pages""")
def xml_path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return T.table(spark, sf_dir, "pages").select("page_id", R.xml_predicate(h, "html.head.title", None).alias("has_title"), R.xml_predicate(h, "html.head.title", "/the/").alias("title_the"))


_LICENSE_LINE = r"(?:Licensed|Released) under (?:the )?(.+?) ?(?:License)?(?:, Version 2\.0)?\.$"


@query(r"""WITH l AS (SELECT doc_id, trim(regexp_extract(x, '(?:Licensed|Released) under (?:the )?(.+?) ?(?:License)?(?:, Version 2\.0)?\.$', 1)) AS declared FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE regexp_matches(x, '(?:Licensed|Released) under (?:the )?(.+?) ?(?:License)?(?:, Version 2\.0)?\.$')),
s AS (SELECT doc_id, CASE lower(declared) WHEN 'apache' THEN 'Apache-2.0' WHEN 'mit' THEN 'MIT' ELSE declared END AS spdx FROM l)
SELECT doc_id, spdx, CASE lower(spdx) WHEN 'apache-2.0' THEN 'notice' WHEN 'mit' THEN 'notice' ELSE 'unknown' END AS category, count(*) AS n FROM s GROUP BY ALL""")
def license_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x")).where(F.col("x").rlike(_LICENSE_LINE))
    spdx = lines.select("doc_id", L.normalize(F.trim(F.regexp_extract("x", _LICENSE_LINE, 1))).alias("spdx"))
    return spdx.groupBy("doc_id", "spdx", L.category(F.col("spdx")).alias("category")).agg(F.count("*").alias("n"))


_LICENSE_PAIRS = ["MIT", "gplv3", "MPL-2.0", "unlicense", "something else"]
_FOLD = "CASE lower({x}) WHEN 'mit' THEN 'notice' WHEN 'gplv3' THEN 'restricted' WHEN 'mpl-2.0' THEN 'reciprocal' WHEN 'unlicense' THEN 'unencumbered' ELSE 'unknown' END"
_SEVERE = "CASE {x} WHEN 'restricted' THEN 5 WHEN 'reciprocal' THEN 4 WHEN 'notice' THEN 2 WHEN 'unencumbered' THEN 1 ELSE 0 END"


@query(f"""WITH p AS (SELECT p_partkey, list_extract(['MIT', 'gplv3', 'MPL-2.0', 'unlicense', 'something else'], (p_partkey % 5 + 1)::INT) AS a, list_extract(['MIT', 'gplv3', 'MPL-2.0', 'unlicense', 'something else'], (p_size % 5 + 1)::INT) AS b FROM part),
c AS (SELECT p_partkey, {_FOLD.format(x='a')} AS a, {_FOLD.format(x='b')} AS b FROM p)
SELECT p_partkey, CASE WHEN {_SEVERE.format(x='a')} >= {_SEVERE.format(x='b')} THEN a ELSE b END AS both_apply, CASE WHEN {_SEVERE.format(x='a')} <= {_SEVERE.format(x='b')} THEN a ELSE b END AS either FROM c""")
def license_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda c: F.element_at(F.array(*map(F.lit, _LICENSE_PAIRS)), (F.col(c) % 5 + 1).cast("int"))
    p = T.table(spark, sf_dir, "part").select("p_partkey", L.category(L.normalize(pick("p_partkey"))).alias("a"), L.category(L.normalize(pick("p_size"))).alias("b"))
    return p.select("p_partkey", L.fold([F.col("a"), F.col("b")], "AND").alias("both_apply"), L.fold([F.col("a"), F.col("b")], "OR").alias("either"))


@query(f"""WITH deps AS ({T.DEPENDENCIES}), v AS (SELECT DISTINCT version FROM deps)
SELECT version, CASE WHEN version IN ('latest', 'git', 'workspace', 'local', 'tarball', 'RELEASE', 'LATEST') OR regexp_matches(version, '[\\^~><=*|$ {{}}\\[\\](),]') OR NOT regexp_matches(version, '^[vV]?[0-9]') THEN '' ELSE trim(version) END AS resolved FROM v""")
def resolved_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.dependencies(spark, sf_dir).select("version").distinct().select("version", V.resolved(F.col("version")).alias("resolved"))


_VERSION_PAIRS = "SELECT p_partkey, (p_size % 4) || '.' || (p_partkey % 12) || '.' || (p_partkey % 7) AS a, (p_size % 3 + 1) || '.' || (p_partkey % 11) || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '.' || (p_partkey % 5) END AS b, p_partkey % 4 AS k FROM part"
_NUM = "list_transform(string_split({x}, '.'), lambda q: q::INT)"
_PAD = "list_resize(" + _NUM + ", 3, 0)"


def _version_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    text = lambda c: c.cast("string")
    b = F.concat(text(z % 3 + 1), F.lit("."), text(k % 11), F.when(k % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("."), text(k % 5))))
    return T.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(".", text(z % 4), text(k % 12), text(k % 7)).alias("a"), b.alias("b"), (k % 4).alias("k"))


@query(f"""WITH p AS ({_VERSION_PAIRS}) SELECT p_partkey, a, b, {_PAD.format(x='a')} < {_PAD.format(x='b')} AS npm_less, {_NUM.format(x='a')} < {_NUM.format(x='b')} AS pypi_less, a < b AS maven_less FROM p""")
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _version_pairs(spark, sf_dir).select("p_partkey", "a", "b", (V.npm_key(a) < V.npm_key(b)).alias("npm_less"), (V.pep440_key(a) < V.pep440_key(b)).alias("pypi_less"), (V.maven_canon(a) < V.maven_canon(b)).alias("maven_less"))


_LEVEL = "CASE WHEN x[1] <> y[1] THEN 'major' WHEN x[2] <> y[2] THEN 'minor' ELSE 'patch' END"
_BUCKETS = f"""WITH p AS ({_VERSION_PAIRS}), n AS (SELECT *, {_PAD.format(x='a')} AS x, {_PAD.format(x='b')} AS y FROM p),
c AS (SELECT p_partkey, CASE WHEN a = b THEN 'up_to_date' WHEN k = 2 THEN CASE WHEN a >= b THEN 'up_to_date' ELSE {_LEVEL} END
  WHEN k = 1 THEN CASE WHEN {_NUM.format(x='a')} >= {_NUM.format(x='b')} THEN 'up_to_date' ELSE {_LEVEL} END WHEN x >= y THEN 'up_to_date' ELSE {_LEVEL} END AS bucket FROM n)"""


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    system = F.element_at(F.array(*map(F.lit, ("npm", "pypi", "maven", "nuget"))), (F.col("k") + 1).cast("int"))
    return _version_pairs(spark, sf_dir).select("p_partkey", V.bucket(system, F.col("a"), F.col("b")).alias("bucket"))


@query(f"{_BUCKETS} SELECT * FROM c")
def currency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buckets(spark, sf_dir)


@query(f"{_BUCKETS} SELECT count(*) AS total, count(*) FILTER (bucket = 'up_to_date') AS up_to_date, count(*) FILTER (bucket = 'patch') AS patch, count(*) FILTER (bucket = 'minor') AS minor, count(*) FILTER (bucket = 'major') AS major, count(*) FILTER (bucket = 'unknown') AS unknown, count(*) FILTER (bucket = 'unpinned') AS unpinned FROM c")
def currency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _buckets(spark, sf_dir)
    return b.agg(F.count("*").alias("total"), *[F.count_if(F.col("bucket") == x).alias(x) for x in ("up_to_date", "patch", "minor", "major", "unknown", "unpinned")])


@query("""WITH e AS (SELECT event_type AS system, 'u' || (user_id % 40) AS name, event_id::VARCHAR AS latest, event_type = 'error' AS not_found, epoch(ts)::BIGINT AS fetched_at, 100000 + event_id % 7 * 50000 AS ttl_seconds FROM events),
l AS (SELECT system, name, max(struct_pack(f := fetched_at, latest := latest, n := not_found, t := ttl_seconds)) AS x FROM e GROUP BY 1, 2), now AS (SELECT max(epoch(ts))::BIGINT AS now FROM events),
k AS (SELECT DISTINCT event_type AS system, 'u' || (user_id % 40) AS name FROM events)
SELECT k.system, k.name, l.x.latest AS latest, l.x.n AS not_found, l.x IS NOT NULL AS hit FROM k LEFT JOIN (SELECT * FROM l, now WHERE x.f + x.t >= now) l USING (system, name)""")
def ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").select(F.col("event_type").alias("system"), F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("name"), F.col("event_id"), F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("at"), "ts")
    cache = e.select("system", "name", F.col("event_id").cast("string").alias("latest"), (F.col("system") == "error").alias("not_found"), _epoch().alias("fetched_at"), (F.lit(100000) + F.col("event_id") % 7 * 50000).alias("ttl_seconds"))
    now = e.agg(F.max(_epoch()).alias("now"))
    keys = e.select("system", "name").distinct().crossJoin(F.broadcast(now))  # one row
    return G.valid_cache(keys, cache, F.col("now")).drop("now")


def _epoch():
    """Seconds of the time-zone-less ts, rounded as a cast from fractions rounds."""
    return F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")


@query(f"""WITH deps AS ({T.DEPENDENCIES}), d AS (SELECT DISTINCT type, name, version FROM deps UNION SELECT 'npm', '@scope/' || lower(replace(p_brand, '#', '-')), '1.' || p_size FROM part UNION SELECT 'maven', 'org.x:' || replace(p_name, ' ', '_'), '2.0' FROM part UNION SELECT 'golang', 'host/' || p_name, 'v1.0.' || p_size FROM part UNION SELECT 'cocoapods', p_name, '1' FROM part),
r AS (SELECT *, CASE WHEN version = 'latest' OR version LIKE '^%' THEN '' ELSE '@' || version END AS v FROM d)
SELECT type, name, version, CASE WHEN type = 'cocoapods' THEN '' WHEN type = 'maven' AND contains(name, ':') THEN 'pkg:maven/' || replace(name, ':', '/') || v WHEN type = 'npm' AND name LIKE '@%' THEN 'pkg:npm/%40' || substr(name, 2) || v
  ELSE 'pkg:' || type || '/' || replace(name, ' ', '%20') || v END AS purl FROM r""")
def package_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = T.dependencies(spark, sf_dir).select("type", "name", "version").distinct()
    p = T.table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    more = [
        p.select(F.lit("npm").alias("type"), F.concat(F.lit("@scope/"), F.lower(F.regexp_replace("p_brand", "#", "-"))).alias("name"), F.concat(F.lit("1."), size).alias("version")),
        p.select(F.lit("maven").alias("type"), F.concat(F.lit("org.x:"), F.regexp_replace("p_name", " ", "_")).alias("name"), F.lit("2.0").alias("version")),
        p.select(F.lit("golang").alias("type"), F.concat(F.lit("host/"), "p_name").alias("name"), F.concat(F.lit("v1.0."), size).alias("version")),
        p.select(F.lit("cocoapods").alias("type"), F.col("p_name").alias("name"), F.lit("1").alias("version")),
    ]
    for m in more:
        deps = deps.unionByName(m)
    return deps.distinct().withColumn("purl", C.purl(F.col("type"), F.col("name"), F.col("version")))


@query("SELECT c_custkey, substr(sha256('root:' || c_name || ':/' || c_mktsegment), 1, 20) AS component_id FROM customer")
def component_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "customer").select("c_custkey", C.component_id(F.lit("root"), F.col("c_name"), F.concat(F.lit("/"), "c_mktsegment")).alias("component_id"))


@query(f"""WITH e AS ({T.TREE_EDGES}), n AS (SELECT "from" AS node FROM e UNION SELECT "to" FROM e) SELECT '.' AS "from", node AS "to" FROM n WHERE node NOT IN (SELECT "to" FROM e)""")
def root_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.tree_edges(spark, sf_dir)
    nodes = e.select(F.explode(F.array("from", "to")).alias("node")).distinct()
    return G.root_edges(nodes, e)


@query(f"""WITH RECURSIVE e AS ({T.TREE_EDGES}), t AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION SELECT t.root, e."to", t.depth + 1 FROM t JOIN e ON e."from" = t.node)
SELECT root, node, min(depth)::INT AS depth FROM t GROUP BY 1, 2""")
def transitive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = T.table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    return G.closure(T.tree_edges(spark, sf_dir), start)


@query(f"""WITH RECURSIVE c AS ({T.CHILD_PACKAGES}), t AS (SELECT 'g1' AS root, 'g1' AS node, 0 AS depth UNION SELECT t.root, c.child, t.depth + 1 FROM t JOIN c ON c.parent = t.node WHERE t.depth < 100)
SELECT root, node, min(depth)::INT AS depth FROM t GROUP BY 1, 2""")
def cyclic_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.child_packages(spark, sf_dir)
    return G.closure(c.select(F.col("parent").alias("from"), F.col("child").alias("to")), spark.createDataFrame([("g1",)], "node string"), 200)


@query(f"SELECT name, version, depth FROM ({resolution.mediation_sql(f'SELECT *, [] AS excluded FROM ({T.CHILD_PACKAGES})', "SELECT 'p' AS project, * FROM (VALUES ('g1', 'v1', 0, []), ('g2', 'v2', 1, [])) t(name, version, ord, excluded)")})")
def nearest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.nearest_wins(T.child_packages(spark, sf_dir), spark.createDataFrame([("g1", "v1", 0), ("g2", "v2", 1)], "name string, version string, ord int"))


@query("""WITH s AS (SELECT o_custkey AS component, 1 AS rank, 'lockfile' AS source FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, 2, 'manifest' FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, 3, 'online' FROM orders)
SELECT component, min(rank)::INT AS rank, arg_min(source, rank) AS source FROM s GROUP BY component""")
def resolver_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("component"), "o_orderstatus")
    answers = [o.where(w).select("component", F.lit(k).alias("rank"), F.lit(s).alias("source")) for k, w, s in ((1, "o_orderstatus = 'F'", "lockfile"), (2, "o_orderstatus = 'O'", "manifest"), (3, "true", "online"))]
    return G.first_source(answers[0].unionByName(answers[1]).unionByName(answers[2]), ["component"], "rank", "source")


_IS_PIN = "NOT (version = 'latest' OR version LIKE '^%')"


@query(f"""WITH deps AS ({T.DEPENDENCIES}), k AS (SELECT name, arg_min(version, walk_order) AS known FROM deps WHERE type = 'maven' AND {_IS_PIN} GROUP BY 1)
SELECT walk_order, type, d.name, CASE WHEN type = 'maven' AND NOT ({_IS_PIN}) AND known IS NOT NULL THEN known ELSE version END AS version FROM deps d LEFT JOIN k ON d.name = k.name""")
def version_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = T.dependencies(spark, sf_dir, places=True).select("walk_order", "type", "name", "version", "file", "row")
    return G.propagate_versions(deps, ties=("file", "row")).drop("file", "row")


@query(f"""WITH deps AS ({T.DEPENDENCIES}), m AS (SELECT lower(replace(p_brand, '#', '-')) AS name, min('9.' || p_size) AS managed FROM part WHERE p_size > 25 GROUP BY 1)
SELECT walk_order, d.name, CASE WHEN NOT ({_IS_PIN}) AND managed IS NOT NULL THEN managed ELSE version END AS version FROM deps d LEFT JOIN m ON d.name = m.name""")
def managed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    managed = T.table(spark, sf_dir, "part").where("p_size > 25").select(F.regexp_replace(F.upper("p_brand"), "#", "-").alias("name"), F.concat(F.lit("9."), F.col("p_size").cast("string")).alias("version"))
    return G.backfill_managed(T.dependencies(spark, sf_dir).select("walk_order", "name", "version"), managed, any_case=True)


@query(f"""WITH deps AS ({T.DEPENDENCIES}), p AS (SELECT 'npm' AS type, 'brand-' || (s_suppkey % 25) AS package, s_suppkey AS component_id FROM supplier), l AS (SELECT type, package, max(component_id) AS target_id FROM p GROUP BY 1, 2)
SELECT DISTINCT component_id, target_id, package FROM deps d JOIN l ON d.type = l.type AND d.name = l.package WHERE component_id <> target_id""")
def component_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = T.table(spark, sf_dir, "supplier").select(F.lit("npm").alias("type"), F.concat(F.lit("brand-"), (F.col("s_suppkey") % 25).cast("string")).alias("package"), F.col("s_suppkey").alias("component_id"), F.col("s_suppkey").alias("walk_order"))
    return G.component_refs(T.dependencies(spark, sf_dir).select("component_id", "type", "name"), packages)


@query(f"""WITH deps AS ({T.DEPENDENCIES}), g AS (SELECT DISTINCT 'brand-' || (o_orderkey % 40) || '@' || (o_orderkey % 3) || '.0' AS node FROM orders), n AS (SELECT regexp_extract(node, '^(.+)@([^@]*)$', 1) AS name, regexp_extract(node, '^(.+)@([^@]*)$', 2) AS version FROM g),
d AS (SELECT DISTINCT 'pkg:' || type || '/' || name || CASE WHEN {_IS_PIN} THEN '@' || version ELSE '' END AS purl FROM deps WHERE type = 'npm')
SELECT DISTINCT 'pkg:npm/' || name || '@' || version AS purl, name, version FROM n WHERE 'pkg:npm/' || name || '@' || version NOT IN (SELECT purl FROM d)""")
def sbom_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.sbom import transitive_components

    deps = T.dependencies(spark, sf_dir).where("type = 'npm'")
    k = F.col("o_orderkey")
    edges = T.table(spark, sf_dir, "orders").select(F.lit("nodejs").alias("component_type"), F.lit(".").alias("from"), F.concat(F.lit("brand-"), (k % 40).cast("string"), F.lit("@"), (k % 3).cast("string"), F.lit(".0")).alias("to"))
    return transitive_components(deps, edges).select("purl", "name", "version")


@query(f"""WITH p AS ({T.PAGE_PATHS}), g AS (SELECT CASE WHEN len(d) = 0 THEN '(root)' ELSE array_to_string(d[1:2], '/') END AS dir FROM (SELECT list_filter(string_split(regexp_replace(path, '/[^/]*$', ''), '/'), lambda x: x <> '') AS d FROM p))
SELECT dir, count(*) AS files FROM g GROUP BY 1 HAVING count(*) >= 5 ORDER BY files DESC, dir LIMIT 5""")
def directory_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.directory_counts(T.page_paths(spark, sf_dir), F.lit(True))


@query("SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, p_name LIMIT 3")
def repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.repeated_names(T.table(spark, sf_dir, "part"), "p_name")


@query("""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT count(*) AS keys, sum(n) AS total FROM c)
SELECT lang, n, floor(n::DOUBLE / total * 100 + 0.5) / 100 AS share FROM (SELECT * FROM c ORDER BY n DESC, lang LIMIT 1), t WHERE keys > 2 AND n::DOUBLE / total > 0.5""")
def dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = T.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return A.dominance(counts, "lang", "n", share=0.5)


@query("""SELECT lang, files, code, complexity FROM (SELECT lang, count(*) AS files, sum(n_chars)::BIGINT AS code, sum(len(string_split(text, ', ')) - 1)::BIGINT AS complexity FROM documents GROUP BY 1) WHERE files > 50 AND 100.0 * complexity / code > 1""")
def high_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("code"), F.sum(F.size(F.split("text", ", ")) - 1).cast("long").alias("complexity"))
    return d.where("files > 50 AND 100.0D * complexity / code > 1")


@query(f"""WITH deps AS ({T.DEPENDENCIES}) SELECT scope, {_PRIORITY}::INT AS priority, CASE scope WHEN 'prod' THEN 'required' WHEN 'optional' THEN 'optional' ELSE '' END AS cyclonedx, count(*) AS n FROM deps GROUP BY ALL""")
def scope_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("scope")
    return T.dependencies(spark, sf_dir).groupBy("scope").agg(F.count("*").alias("n")).select("scope", C.scope_priority(s).alias("priority"), C.cyclonedx_scope(s).alias("cyclonedx"), "n")


@query("SELECT lang, source, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL ORDER BY chars DESC, lang, source LIMIT 10")
def top_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.sum("n_chars").alias("chars")).orderBy(F.desc("chars"), "lang", "source").limit(10)


_CATEGORIES = [("en", True, None, True), ("de", False, True, None), ("fr", None, None, None)]


@query(f"""WITH t AS (SELECT doc_id, lang AS type, CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 END AS rc, CASE WHEN doc_id % 5 = 0 THEN true END AS rp FROM documents)
SELECT doc_id, type, coalesce(rc, c, false) AS is_component, coalesce(rp, p, rc, c, false) AS is_primary_tech, coalesce(e, type NOT IN ('hosting', 'cloud')) AS create_edges FROM t LEFT JOIN {_values(_CATEGORIES, 'type, c, p, e')} USING (type)""")
def rule_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("type"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 2 == 0).alias("is_component"), F.when(F.col("doc_id") % 5 == 0, F.lit(True)).alias("is_primary_tech"))
    return R.flags(rows, _frame(spark, _CATEGORIES, "type string, is_component boolean, is_primary_tech boolean, create_edges boolean"))


@query(f"""WITH c AS ({T.COMPONENTS}), s AS (SELECT 'g' || group_id AS subsystem, tech, code FROM c), t AS (SELECT subsystem, string_agg(DISTINCT x, ',' ORDER BY x) AS techs FROM (SELECT subsystem, unnest(tech) AS x FROM s) GROUP BY 1)
SELECT subsystem, count(*) AS component_count, sum(code)::BIGINT AS code, any_value(techs) AS techs FROM s JOIN t USING (subsystem) GROUP BY subsystem""")
def subsystems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.subsystem_rollup(T.components(spark, sf_dir).select(F.concat(F.lit("g"), F.col("group_id").cast("string")).alias("subsystem"), "component_id", "tech", "code"))


@query("""WITH c AS (SELECT conv_id % 7 AS parent_id, conv_id * 100 + turn AS component_id, role AS name, ['/p' || (turn % 3)] AS paths, CASE WHEN length(text) > 200 THEN ['t' || (turn % 2)] ELSE []::VARCHAR[] END AS tech FROM conversations),
g AS (SELECT parent_id, name, paths[1] AS p, min(component_id) AS keep, bool_or(len(tech) > 0) AS any_tech FROM c GROUP BY 1, 2, 3),
k AS (SELECT c.*, CASE WHEN any_tech THEN keep ELSE component_id END AS k FROM c JOIN g ON c.parent_id = g.parent_id AND c.name = g.name AND c.paths[1] = g.p)
SELECT parent_id, name, k AS component_id, array_to_string(list_sort(list_distinct(flatten(list(paths)))), ',') AS paths, array_to_string(list_sort(list_distinct(flatten(list(tech)))), ',') AS tech, count(*) AS merged FROM k GROUP BY 1, 2, 3""")
def component_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.table(spark, sf_dir, "conversations")
    tech = F.when(F.length("text") > 200, F.array(F.concat(F.lit("t"), (F.col("turn") % 2).cast("string")))).otherwise(F.array().cast("array<string>"))
    rows = c.select((F.col("conv_id") % 7).alias("parent_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("component_id"), F.col("role").alias("name"), F.array(F.concat(F.lit("/p"), (F.col("turn") % 3).cast("string"))).alias("paths"), tech.alias("tech"), (F.col("conv_id") * 100 + F.col("turn")).alias("walk_order"))
    return G.merge_components(rows).select("parent_id", "name", "component_id", F.array_join("paths", ",").alias("paths"), F.array_join("tech", ",").alias("tech"), "merged")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
