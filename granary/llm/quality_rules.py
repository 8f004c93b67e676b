"""Line-first quality rules, in DataFrame functions only.

Each line is held against punctuation, navigation and boilerplate rules; lines
that fail are removed, and a document that loses more than MAX_LOST of its
words this way is rejected.  Statistics of the whole text (symbols, repeated
lines, repeated runs of words) reject a document before that.  Everything is
one projection: no shuffle, whatever the size.

Results for odd input: a null or empty text has no words and no lines, all its
counts are 0 and it fails; texts of any length are read whole; rows are judged
one by one, so ties and repeated rows do not matter; an empty table gives no
rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import WORD, documents, named

MIN_WORDS = 20
RUN = 8
MAX_REPEATED = 30  # percent of the words
MAX_LOST = 0.5
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A line of so many words should close like a sentence.
SENTENCE_WORDS = 8
CLOSED = r"""[.!?:;,…。！？"'”’»)\]*_`-][\x20\x09-\x0D]*$"""
#: Of a line without outer blanks: so no two parts of the pattern can take the same blanks.
NAVIGATION = r"(?i)^(home|login|log in|sign (in|up)|next|previous|back to top|skip to content|read more|share( this)?|menu|search|subscribe)\s*[|>».:]*\z"
BOILERPLATE = r"(?i)(enable javascript|cookie policy|accept (all )?cookies|all rights reserved|terms of (use|service)|privacy policy|lorem ipsum|click here)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once per row, also where lambdas of body read it."""
    return F.transform(F.array(value), body)[0]


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def repeated_words(words: Column, run: int = RUN) -> Column:
    """Words that lie in a run of `run` words found twice or more in `words`, the first find included."""

    def covered(hashes: Column) -> Column:
        in_order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            in_order,
            lambda p: F.array_sort(
                F.transform(
                    F.filter(p, lambda x, k: F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False))),
                    lambda x: x["i"],
                )
            ),
        )
        return let(twice, lambda at: F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(run), F.coalesce(F.get(at, k + 1) - x, F.lit(run)))), F.lit(0), lambda a, b: a + b))

    def of_hashes(one: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(one) - run), lambda i: F.xxhash64(*[F.get(one, i + k) for k in range(run)]))
        return let(runs, lambda r: F.when(F.size(F.array_distinct(r)) == F.size(r), F.lit(0)).otherwise(covered(r)))

    return F.when(F.size(words) <= run, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def line_fails(line: Column, n_words: Column) -> dict[str, Column]:
    """The rules that a line of n_words words (one at least) breaks."""
    symbols = _count(line, SYMBOLS)
    return {
        "punctuation": ((n_words >= SENTENCE_WORDS) & ~line.rlike(CLOSED)) | (2 * symbols >= n_words) & (symbols >= 3) | (2 * F.size(F.regexp_extract_all(line, F.lit("!!+"), F.lit(0))) >= n_words) & (n_words >= 3),
        "navigation": ((_count(line, "|") >= 2) & (4 * _count(line, "|") >= n_words)) | F.btrim(line, F.lit(SPACE)).rlike(NAVIGATION),
        "boilerplate": (n_words <= 40) & line.rlike(BOILERPLATE),
    }


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """Returns id_col, the counts, lost_words, base_failed, kept and clean_text (the lines that pass)."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def judged(line: Column) -> Column:
        n = _n_words(line)
        return let(n, lambda k: F.struct(line.alias("line"), k.alias("n"), F.when(k == 0, F.lit(False)).otherwise(F.coalesce(*[F.when(bad, F.lit(True)) for bad in line_fails(line, k).values()], F.lit(False))).alias("bad")))

    worded = F.filter("lines", lambda line: line.rlike(WORD))
    found = (
        df.select(named(id_col).alias("id"), text.alias("text") if text_col == "text" else F.coalesce(named(text_col), F.lit("")).alias("text"))
        .select("id", "text", F.split("text", "\n").alias("lines"))
        .select(
            "id",
            F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
            _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
            let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            let(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("twice"))).alias("words"),
            F.transform("lines", judged).alias("lines"),
        )
    )
    n, twice = F.col("words.n"), F.col("words.twice")
    lost = F.aggregate("lines", F.lit(0), lambda a, x: a + F.when(x["bad"], x["n"]).otherwise(0)).cast("long")
    failed = (n < MIN_WORDS) | (100 * twice > MAX_REPEATED * n)
    return (
        found.select("id", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", twice.alias("n_repeat_words"), failed.alias("base_failed"), lost.alias("lost_words"), "lines")
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= max_lost * F.col("n_words")))
        .select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words", F.array_join(F.transform(F.filter("lines", lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("clean_text"))
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).drop("clean_text")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, string_split(t, chr(10)) AS lines FROM d
), c AS (
  SELECT doc_id, r, words, len(words)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS worded
  FROM w
), runs AS (
  SELECT r, i, array_to_string(words[i:i + 7], ' ') AS run FROM (SELECT r, words, unnest(range(1, greatest(n_words - 6, 1))) AS i FROM c)
), twice AS (
  SELECT r, run FROM runs GROUP BY r, run HAVING count(*) > 1
), repeated AS (
  SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM runs JOIN twice USING (r, run), (SELECT unnest(range(0, 8)) AS k) GROUP BY r
), by_line AS (
  SELECT r, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS sym,
         length(regexp_replace(x, '[^|]', '', 'g')) AS bars, len(regexp_extract_all(x, '!!+')) AS shouts
  FROM (SELECT r, unnest(worded) AS x FROM c)
), lost AS (
  SELECT r, sum(n)::BIGINT AS n FROM by_line
  WHERE (n >= 8 AND NOT regexp_matches(x, '[.!?:;,…。！？"''”’»)\]*_`-][\x20\x09-\x0D]*$')) OR (2 * sym >= n AND sym >= 3) OR (2 * shouts >= n AND n >= 3)
     OR (bars >= 2 AND 4 * bars >= n)
     OR regexp_matches(x, '(?i)^\s*(home|login|log in|sign (in|up)|next|previous|back to top|skip to content|read more|share( this)?|menu|search|subscribe)\s*[|>».:]*\s*$')
     OR (n <= 40 AND regexp_matches(x, '(?i)(enable javascript|cookie policy|accept (all )?cookies|all rights reserved|terms of (use|service)|privacy policy|lorem ipsum|click here)'))
  GROUP BY r
), j AS (
  SELECT doc_id, n_words, word_chars, n_symbols, (len(worded) - len(list_distinct(worded)))::BIGINT AS n_dup_lines,
         coalesce(repeated.n, 0) AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS lost_words
  FROM c LEFT JOIN repeated USING (r) LEFT JOIN lost USING (r)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM j
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost_words <= 0.5 * n_words AS kept, lost_words FROM f
"""
