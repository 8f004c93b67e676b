"""Matching of facts against technology rules.

Rules are dimension tables.  Exact patterns are equi-joins; regular expressions
become one literal alternative per rule, so each pattern is compiled once per
task and no nested-loop join runs over the facts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import glob_regex
from ..functions.markup import has_element
from .rule_index import match
from .sizing import small_side

# Dependency types that are matched by each other's rules.
TYPE_ALIASES = (("maven", "gradle"), ("gradle", "maven"))


def is_regex(pattern: str) -> bool:
    return len(pattern) > 2 and pattern.startswith("/") and pattern.endswith("/")


def with_aliases(rules: DataFrame) -> DataFrame:
    """Dependency rules (tech, dep_type, pattern, rule_order), repeated under the types that stand for each other."""
    out = rules
    for a, b in TYPE_ALIASES:
        out = out.unionByName(rules.where(F.col("dep_type") == a).withColumn("dep_type", F.lit(b)))
    return out.distinct()


def match_dependencies(deps: DataFrame, rules: DataFrame, regex_rules: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """(columns of deps, tech, reason) of each rule that matches (type, name).

    rules: exact (tech, dep_type, pattern); regex_rules: (tech, dep_type, regular expression), a bounded list.
    """
    exact = small_side(with_aliases(rules.select("tech", "dep_type", "pattern", F.lit(0).alias("rule_order"))).select(F.col("tech").alias("tech"), F.col("dep_type").alias("r_type"), F.col("pattern").alias("r_name")).distinct())
    found = deps.join(exact, (F.col("type") == F.col("r_type")) & (F.col("name") == F.col("r_name"))).drop("r_type", "r_name")
    if regex_rules:
        every = {(t, k, p) for t, k, p in regex_rules} | {(t, b, p) for t, k, p in regex_rules for a, b in TYPE_ALIASES if k == a}
        hits = F.array(*[F.when((F.col("type") == k) & F.col("name").rlike(p), F.lit(t)) for t, k, p in sorted(every)])
        found = found.unionByName(deps.withColumn("tech", F.explode(F.array_distinct(F.filter(hits, lambda t: t.isNotNull())))))
    return found.distinct().withColumn("reason", F.concat_ws(" ", F.lit("matched dependency:"), "name"))


def match_names(files: DataFrame, exact: DataFrame, globs: Sequence[tuple[str, str]] = (), directories: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(path, tech, reason): file names equal to a pattern, names that fit a glob, directories that end with a pattern."""
    small = small_side(exact.select(F.col("tech"), F.col("pattern").alias("r_name")).distinct())
    out = files.join(small, F.col("name") == F.col("r_name")).select("path", "tech", F.concat_ws(" ", F.lit("matched file:"), "name").alias("reason"))
    cases = [F.when(F.col("name").rlike(glob_regex(p)), F.lit(t)) for t, p in globs] + [F.when(F.col("dir").endswith(p), F.lit(t)) for t, p in directories]
    if cases:
        techs = F.array_distinct(F.filter(F.array(*cases), lambda t: t.isNotNull()))
        out = out.unionByName(files.select("path", F.explode(techs).alias("tech"), F.concat_ws(" ", F.lit("matched file:"), "name").alias("reason")))
    return out.distinct()


def match_late_names(files: DataFrame, exact: DataFrame, first: DataFrame) -> DataFrame:
    """The same of equal names only, for technologies that the first pass (path, tech) has not found in the file's directory."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    seen = first.select(folder.alias("s_dir"), F.col("tech").alias("s_tech")).distinct()
    found = match_names(files, exact).withColumn("granary_dir", folder)
    return found.join(seen, (F.col("granary_dir") == F.col("s_dir")) & (F.col("tech") == F.col("s_tech")), "left_anti").drop("granary_dir")


def match_extensions(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, tech) by extension; rules: (tech, ext), with or without the dot.  Off in a scan unless asked for."""
    small = small_side(rules.select("tech", F.concat(F.lit("."), F.regexp_replace(F.lower("ext"), r"^\.", "")).alias("r_ext")).distinct())
    return files.join(small, F.lower("ext") == F.col("r_ext")).select("path", "tech").distinct()


def json_predicate(text: Column, path: str, value: str | None) -> Column:
    """Whether a dotted path exists in a JSON object, equals a value, or fits a /regex/."""
    at = F.get_json_object(text, "$" + "".join(f"['{k}']" for k in path.removeprefix("$.").split(".")))
    top = F.ltrim(text).startswith("{")
    if value is None or value == "":
        return top & at.isNotNull()
    return top & F.coalesce(at.rlike(value[1:-1]) if is_regex(value) else at == value, F.lit(False))


def xml_predicate(text: Column, path: str, value: str | None) -> Column:
    """The same of an element path from the root; a /regex/ is a substring here.

    The value of an element is its text up to the first element that ends.  See functions/markup.py for what counts as an element.
    """
    steps = [p for p in path.removeprefix("$.").replace("/", ".").split(".") if p]
    if value is None or value == "":
        return has_element(text, steps)
    return has_element(text, steps, lambda got: got.contains(value[1:-1]) if is_regex(value) else F.trim(got) == value.strip())


def yaml_predicate(text: Column, path: str, value: str | None) -> Column:
    """The same of a dotted path in a YAML mapping; read in Arrow batches, as the format nests."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        import yaml

        def holds(t: str | None) -> bool:
            try:
                at = yaml.safe_load(t or "")
            except yaml.YAMLError:
                return False
            for key in path.removeprefix("$.").split("."):
                if not isinstance(at, dict) or key not in at:
                    return False
                at = at[key]
            if value is None or value == "":
                return True
            got = str(at).lower() if isinstance(at, bool) else str(at)
            return bool(re.search(value[1:-1], got)) if is_regex(value) else got == value

        return texts.map(holds).astype(bool)

    return run(text)


#: Content kinds by name; a kind that is not here is a regular expression.
CONTENT_KINDS = {"json-path": json_predicate, "xml-path": xml_predicate, "yaml-path": yaml_predicate}


def content_predicate(text: Column, kind: str, pattern: str = "", path: str = "", value: str | None = None) -> Column:
    build = CONTENT_KINDS.get(kind)
    return build(text, path, value) if build else text.rlike(pattern)


def content_hits(rules: Sequence[dict]) -> Column:
    """The rules whose content predicate holds for a file (name, ext, text), as an array of (tech, rule_order).

    rules: dicts of tech, rule_order, kind, pattern, path, value and ext or file; text is read only where a rule asks for it.
    """
    cases = []
    for r in sorted(rules, key=lambda r: r["rule_order"]):
        where = F.col("ext") == r["ext"] if r.get("ext") else F.col("name") == r["file"]
        hit = where & content_predicate(F.col("text"), r.get("kind", "regex"), r.get("pattern", ""), r.get("path", ""), r.get("value"))
        cases.append(F.when(hit, F.struct(F.lit(r["tech"]).alias("tech"), F.lit(r["rule_order"]).alias("rule_order"))))
    return F.filter(F.array(*cases), lambda x: x.isNotNull())


#: Regular expressions up to which content rules are literals of the plan; more go through the index of rule_index.py.
LITERAL_RULES = 200


def match_content(files: DataFrame, rules: Sequence[dict], literal_rules: int = LITERAL_RULES) -> DataFrame:
    """(path, tech, rule_order): the first rule per file and technology whose content predicate holds; rules as in content_hits."""
    plain = [r for r in rules if r.get("kind", "regex") not in CONTENT_KINDS]
    if len(plain) > literal_rules:
        rows = [(r["tech"], r["rule_order"], r.get("pattern", ""), r.get("ext") or None, None if r.get("ext") else r["file"]) for r in plain]
        table = files.sparkSession.createDataFrame(rows, "tech string, rule_order int, pattern string, ext string, file string")
        others = [r for r in rules if r.get("kind", "regex") in CONTENT_KINDS]
        found = match(files, table)
        found = found.unionByName(match_content(files, others)) if others else found
        return found.groupBy("path", "tech").agg(F.min("rule_order").alias("rule_order"))
    gate = F.col("ext").isin(*{r["ext"] for r in rules if r.get("ext")}) | F.col("name").isin(*{r["file"] for r in rules if r.get("file")})
    rows = files.where(gate).select("path", F.explode(content_hits(rules)).alias("x"))
    return rows.groupBy("path", "x.tech").agg(F.min("x.rule_order").alias("rule_order"))


def match_variables(variables: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """variables (…, var) with tech: the first rule (tech, part) in order whose part the name contains, in any case."""
    tech = F.coalesce(*[F.when(F.lower("var").contains(p.lower()), F.lit(t)) for t, p in rules])
    return variables.withColumn("tech", tech).where(F.col("tech").isNotNull())


def flags(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """rows (…, type, is_component, is_primary_tech) with the three flags after rule, category and default."""
    c = small_side(categories.select(F.col("type").alias("c_type"), F.col("is_component").alias("c_component"), F.col("is_primary_tech").alias("c_primary"), F.col("create_edges").alias("c_edges")))
    joined = rows.join(c, F.col("type") == F.col("c_type"), "left")
    component = F.coalesce("is_component", "c_component", F.lit(False))
    return joined.select(
        *[x for x in rows.columns if x not in ("is_component", "is_primary_tech")],
        component.alias("is_component"),
        F.coalesce("is_primary_tech", "c_primary", component).alias("is_primary_tech"),
        F.coalesce("c_edges", ~F.col("type").isin("hosting", "cloud")).alias("create_edges"),
    )


def last_match(paths: DataFrame, patterns: Sequence[tuple], above: bool = True) -> DataFrame:
    """paths (path, is_dir) with `ignored`, by ordered patterns (glob, negated, directories only[, base]): the last match decides.

    A glob is tried on the path from the root and on the last name, of paths below its base (without one, of all).  A path
    below an ignored directory is ignored; above=False leaves that out, where directories are settled before.
    """
    rel, base = F.regexp_replace("path", "^/", ""), F.regexp_replace("path", "^.*/", "")

    def verdict(p: Column, name: Column, is_dir: Column) -> Column:
        out = None
        for glob, negated, only_dirs, *below in reversed(list(patterns)):
            r = glob_regex(glob)
            hit = p.rlike(r) | name.rlike(r)
            hit = hit & is_dir if only_dirs else hit
            hit = p.startswith(below[0] + "/") & hit if below and below[0] else hit
            out = F.when(hit, F.lit(not negated)) if out is None else out.when(hit, F.lit(not negated))
        return F.lit(False) if out is None else out.otherwise(F.lit(False))

    ignored = verdict(rel, base, F.col("is_dir"))
    if above:
        parts = F.split(rel, "/")
        folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
        ignored = F.when(F.size(parts) < 2, F.lit(False)).otherwise(F.exists(folders, lambda d: verdict(d, F.regexp_replace(d, "^.*/", ""), F.lit(True)))) | ignored
    return paths.withColumn("ignored", ignored)
