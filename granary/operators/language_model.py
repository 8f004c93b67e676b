"""Programming languages by content: token counts per language as a table, log-odds by a join, for names that say too little."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizing import small_side
from .storage import stored

# Extensions that several languages use.
AMBIGUOUS = {".h": ("C", "C++", "Objective-C"), ".m": ("MATLAB", "Objective-C"), ".pl": ("Perl", "Prolog"), ".r": ("R", "Rebol"), ".ts": ("TypeScript", "XML"), ".inc": ("PHP", "SQL", "C++"), ".cls": ("TeX", "Apex", "Visual Basic")}
TOKEN = r"[@#]?[A-Za-z_][A-Za-z0-9_]*|[!-/:-@\[-`{-~]"
#: Languages that a model may have: their totals are literals of the plan.
MOST_LANGUAGES = 1000


def _tokens(text: Column) -> Column:
    return F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)))


def _weight(part: Column, of: Column) -> Column:
    """Thousandths of the natural logarithm, whole: sums are the same in any order."""
    return F.round(F.log(part / of) * 1000).cast("long")


def fit(files: DataFrame, min_count: int = 2) -> DataFrame:
    """(token, language, weight) of labelled files (language, text); the token '' holds how frequent a language's files are.

    A weight is 1000 ln((n + 1) / (tokens of the language + vocabulary)).  Tokens seen fewer than min_count times in all are left
    out; null languages and texts teach nothing.  Every token has a row for every language; more than MOST_LANGUAGES of them are
    an error.  Counts are summed before the shuffle, so a language of most files is as good as any.
    """
    known = files.where("language IS NOT NULL AND text IS NOT NULL").select("language", "text")
    n = known.select("language", _tokens(F.col("text")).alias("token")).groupBy("token", "language").agg(F.count("*").alias("n"))
    seen = n.groupBy("token").agg(F.sum("n").alias("every"), F.map_from_entries(F.collect_list(F.struct("language", "n"))).alias("n")).where(F.col("every") >= min_count)
    seen = stored(seen.select("token", "n"))
    per = {r["language"]: r["files"] for r in known.groupBy("language").agg(F.count("*").alias("files")).limit(MOST_LANGUAGES + 1).collect()}
    if len(per) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    totals = {r["language"]: r["n"] for r in seen.select(F.explode("n").alias("language", "n")).groupBy("language").agg(F.sum("n").alias("n")).collect()}
    size = seen.count()
    rows = json.dumps([{"language": k, "files": per[k], "total": totals.get(k, 0)} for k in sorted(per)])
    languages = F.explode(F.from_json(F.lit(rows), "array<struct<language:string,files:bigint,total:bigint>>")).alias("x")
    words = seen.select("token", F.col("n").alias("counts"), languages).select("token", "x.language", _weight(F.coalesce(F.try_element_at("counts", F.col("x.language")), F.lit(0)) + 1, F.col("x.total") + F.lit(size)).alias("weight"))
    priors = files.sparkSession.range(1).select(languages).select(F.lit("").alias("token"), "x.language", _weight(F.col("x.files"), F.lit(max(1, sum(per.values())))).alias("weight"))
    return words.unionByName(priors)


def classify(files: DataFrame, model: DataFrame, candidates: DataFrame) -> DataFrame:
    """(path, language, score): each file (path, ext, text) whose extension has candidates (ext, language) that the model knows.

    The greatest sum of weights wins, of equals the language that sorts first.  Tokens beyond the model say nothing; a file
    without known tokens (null or empty ones too) is judged by how frequent the languages are.  Rows of one path are one text.
    """
    files = files.select("path", "ext", "text")
    prior = model.where("token = ''").select(F.col("language").alias("p_language"), F.col("weight").alias("prior"))
    ways = small_side(candidates.distinct().join(prior, F.col("language") == F.col("p_language")).select(F.col("ext").alias("c_ext"), "language", "prior"))
    asked = files.join(ways, F.col("ext") == F.col("c_ext"))
    words = files.join(ways.select("c_ext").distinct(), F.col("ext") == F.col("c_ext"), "left_semi").select("path", "ext", _tokens(F.col("text")).alias("w"))
    weights = small_side(model.where("token <> ''").join(ways.select("language").distinct(), "language", "left_semi"))
    sums = words.join(weights, F.col("w") == F.col("token")).groupBy("path", F.col("language").alias("s_language")).agg(F.sum("weight").alias("sum"))
    keyed = asked.select("path", "language", "prior").distinct()
    scored = keyed.join(sums.withColumnRenamed("path", "s_path"), (F.col("path") == F.col("s_path")) & (F.col("language") == F.col("s_language")), "left")
    best = scored.groupBy("path").agg(F.min(F.struct((-(F.col("prior") + F.coalesce("sum", F.lit(0)))).alias("loss"), F.col("language").alias("language"))).alias("x"))
    return best.select("path", "x.language", (-F.col("x.loss")).alias("score"))


def by_content(files: DataFrame) -> DataFrame:
    """(path, language, score) of the files (path, ext, language, text) whose extension is AMBIGUOUS, learned from all others."""
    spark = files.sparkSession
    candidates = spark.createDataFrame([(e, x) for e, every in AMBIGUOUS.items() for x in every], "ext string, language string")
    plain = F.coalesce(F.col("ext"), F.lit("")).isin(*AMBIGUOUS)
    return classify(files.where(plain), fit(files.where(~plain)), candidates)
