"""Registered queries over source texts that are made from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexer import line_counts
from . import relations as T
from .registry import query

_BRANCH = r"\b(?:if|for|while|case|catch|elif|except|when|match)\b|&&|\|\|"
_STRINGS = r"""("(?:[^"\\]|\\.)*"?|''(?:[^''\\]|\\.)*''?|\\.)"""
#: Of a language: what stands for one line's strings (the first group), comments, and a comment that the line leaves open.
_LINE_PATTERNS = {"C": (_STRINGS + r"|/\*.*?\*/|//.*$|(/\*.*$)", "/*"), "R": (_STRINGS + "|#.*$|($^)", "#"), "XML": ("($^)|<!--.*?-->|(<!--.*$)", "<!--")}


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as programs: every line gets marks of comments and strings around it, by its number; in three languages."""
    k = lambda i: (F.col("doc_id") + i + 1) % 8

    def dressed(x, i):
        return (
            F.when(k(i) == 0, F.concat(F.lit("// "), x)).when(k(i) == 1, F.concat(F.lit("/* "), x)).when(k(i) == 2, F.concat(x, F.lit(" */"))).when(k(i) == 3, F.concat(F.lit('s = "'), x, F.lit('"; // if')))
            .when(k(i) == 4, F.concat(F.lit("if (a && b) { "), x)).when(k(i) == 5, F.concat(F.lit("# "), x)).when(k(i) == 6, F.lit("")).otherwise(F.concat(F.lit("<!-- "), x, F.lit(" --> x")))
        )

    language = F.when(F.col("doc_id") % 3 == 0, F.lit("C")).when(F.col("doc_id") % 3 == 1, F.lit("R")).otherwise(F.lit("XML"))
    return T.table(spark, sf_dir, "documents").select("doc_id", language.alias("language"), F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), dressed), "\n").alias("text"))


def _by_language(form) -> str:
    return "CASE language " + " ".join(f"WHEN '{k}' THEN {form(*v)}" for k, v in _LINE_PATTERNS.items()) + " END"


#: A line at a time, with what an open comment of the line before puts in front of it.
LEXED_SQL = rf"""WITH RECURSIVE d AS (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'R' ELSE 'XML' END AS language, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: CASE (doc_id + i) % 8 WHEN 0 THEN '// ' || x WHEN 1 THEN '/* ' || x WHEN 2 THEN x || ' */'
    WHEN 3 THEN 's = "' || x || '"; // if' WHEN 4 THEN 'if (a && b) {{ ' || x WHEN 5 THEN '# ' || x WHEN 6 THEN '' ELSE '<!-- ' || x || ' --> x' END) AS l FROM documents
), t AS (
  SELECT doc_id, language, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l, 0::BIGINT AS i, '' AS before, 0::BIGINT AS code, 0::BIGINT AS comments, 0::BIGINT AS blanks, 0::BIGINT AS complexity FROM d
  UNION ALL
  SELECT doc_id, language, l, i + 1, CASE WHEN contains({_by_language(lambda p, o: f"regexp_replace(x, '{p}', ' \\2', 'g')")}, {_by_language(lambda p, o: f"'{o}'")}) AND language <> 'R' THEN {_by_language(lambda p, o: f"'{o}'")} ELSE '' END,
    code + (NOT blank AND has_code)::BIGINT, comments + (NOT blank AND NOT has_code)::BIGINT, blanks + blank::BIGINT, complexity + len(regexp_extract_all({_by_language(lambda p, o: f"regexp_replace(x, '{p}', ' ', 'g')")}, '{_BRANCH}'))
  FROM (SELECT *, regexp_matches(line, '^\s*$') AS blank, NOT regexp_matches({_by_language(lambda p, o: f"regexp_replace(x, '{p}', '\\1', 'g')")}, '^\s*$') AS has_code FROM (SELECT *, l[i + 1] AS line, before || l[i + 1] AS x FROM t WHERE i < len(l)))
)
SELECT doc_id, language, i AS lines, code, comments, blanks, complexity FROM t WHERE i = len(l)"""


@query(LEXED_SQL)
def lexed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_counts(sources(spark, sf_dir)).select("doc_id", "language", "lines", "code", "comments", "blanks", "complexity")


@query(f"WITH x AS ({LEXED_SQL}) SELECT language, count(*) AS files, sum(lines)::BIGINT AS lines, sum(code)::BIGINT AS code, sum(comments)::BIGINT AS comments, sum(blanks)::BIGINT AS blanks, sum(complexity)::BIGINT AS complexity FROM x GROUP BY language")
def lexed_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.aggregates import code_stats

    return code_stats(lexed_lines(spark, sf_dir).drop("doc_id")).where("language <> ''").drop("level", "key")
