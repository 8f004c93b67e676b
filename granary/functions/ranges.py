"""Versions as text that sorts as they do, and version ranges as unions of intervals over it.

A key holds each number with its number of digits before it, and a letter wherever versions may end or go on, in the order
in which they sort; no key begins with another.  So every operator of a range is one interval [lo, hi) of plain text, a
blank after a key being the next place, and `!=` a hole.  Both are made step by step in columns of one row per version or
clause: one expression for all of it would repeat its parts over and over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may stand after a release, in order: a bare development release, pre-releases, the end, a post-release, a further number.
DEV, ALPHA, BETA, CANDIDATE, END, POST, MORE = "ABCDEFG"
#: Above every key.
TOP = "~"
_PEP440 = r"(?i)^v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(alpha|beta|preview|pre|rc|a|b|c)[-_.]?([0-9]*))?(?:-([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]*))?(?:[-_.]?(dev)[-_.]?([0-9]*))?(?:\+[0-9a-z._-]+)?$"
_CLAUSE = r"^(===|==|!=|>=|<=|~=|\^|~|>|<|)\s*(\S+)$"
_SEMVER = r"^[vV=]*([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"
_COMPARATOR = r"^(>=|<=|>|<|=|~|\^|)[vV=]*(\d+|[xX*])(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*]))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"


def number(digits: Column) -> Column:
    """Digits of any number so that they sort by value; none counts as zero."""
    plain = F.regexp_replace(F.concat(F.lit("0"), digits), "^0+(?=.)", "")
    return F.concat(F.lpad(F.length(plain).cast("string"), 2, "0"), plain)


def _one_more(digits: Column) -> Column:
    return (digits.try_cast("decimal(37,0)") + 1).cast("string")


def _groups(df: DataFrame, text: str, pattern: str, n: int) -> DataFrame:
    return df.withColumns({f"g{k}": F.regexp_extract(text, pattern, k) for k in range(1, n + 1)})


def _pep440_parts(df: DataFrame, text: str) -> DataFrame:
    """df with what a version is made of: is_version, epoch, parts, release (without trailing zeros), pre, after, dev, is_pre."""
    df = _groups(df.withColumn("v", F.trim(F.coalesce(F.col(text), F.lit("")))), "v", _PEP440, 9)
    kind = F.lower("g3")
    letter = F.when(kind.isin("a", "alpha"), F.lit(ALPHA)).when(kind.isin("b", "beta"), F.lit(BETA)).otherwise(F.lit(CANDIDATE))
    df = df.withColumns(
        {
            "is_version": F.col("v").rlike(_PEP440),
            "epoch": number(F.col("g1")),
            "parts": F.split("g2", r"\."),
            "pre": F.when(F.col("g3") == "", F.lit("")).otherwise(F.concat(letter, number(F.col("g4")))),
            "after": F.when(F.concat("g5", "g6") == "", F.lit("")).otherwise(F.concat(F.lit(POST), number(F.concat("g5", "g7")))),
            "dev": F.when(F.col("g8") == "", F.lit(END)).otherwise(F.concat(F.lit(DEV), number(F.col("g9")))),
            "is_pre": (F.col("g3") != "") | (F.col("g8") != ""),
        }
    )
    # Places of numbers other than zero; the last of them ends the release.
    df = df.withColumn("places", F.filter(F.sequence(F.lit(1), F.size("parts")), lambda k: F.element_at("parts", k).rlike("[1-9]")))
    kept = F.slice("parts", F.lit(1), F.coalesce(F.array_max("places"), F.lit(1)))
    return df.withColumn("release", F.array_join(F.transform(kept, number), MORE))


def pep440_order(df: DataFrame, version: str = "version") -> DataFrame:
    """df with key, a text that sorts as PEP 440 orders versions (1.0 and 1.0.0 are one; local parts do not count), or null; is_pre; core."""
    key = F.when(F.col("is_version"), F.concat("epoch", "release", "pre", "after", "dev"))
    return _pep440_parts(df, version).select(*df.columns, key.alias("key"), "is_pre", F.lit("").alias("core"))


def _pep440_clauses(rows: DataFrame) -> DataFrame:
    """rows (spec, alt, clause) with ok, lo, hi, hole (what the clause leaves out), allows_pre and own_core."""
    clause, op = F.col("clause"), F.col("op")
    rows = rows.withColumns({"every": clause.isin("", "*"), "op": F.regexp_extract(clause, _CLAUSE, 1), "text": F.regexp_extract(clause, _CLAUSE, 2)})
    rows = _pep440_parts(rows.withColumns({"star": F.col("text").endswith(".*"), "bare": F.regexp_replace("text", r"\.\*$", "")}), "bare")
    n = F.size("parts")
    # Which number goes up by one to end what `~=`, the caret, the tilde and `.*` take in.
    rows = rows.withColumn("m", F.when(op == "~=", F.greatest(F.lit(1), n - 1)).when(op == "^", F.coalesce(F.array_min("places"), n)).when(op == "~", F.least(F.lit(2), n)).otherwise(n))
    raised = F.concat(F.slice("parts", F.lit(1), F.col("m") - 1), F.array(_one_more(F.element_at("parts", F.col("m")))))
    rows = rows.withColumns({"base": F.concat("epoch", "release"), "key": F.concat("epoch", "release", "pre", "after", "dev"), "up": F.concat(F.col("epoch"), F.array_join(F.transform(raised, number), MORE), F.lit(DEV))})
    key, base, up, star = F.col("key"), F.col("base"), F.col("up"), F.col("star")
    behind = F.concat(key, F.lit(" "))
    whole = F.concat(base, F.col("pre"))
    is_post, has_dev = F.col("after") != "", F.col("g8") != ""
    above = F.when(is_post | has_dev, behind).otherwise(F.concat(whole, F.lit(MORE)))
    below = F.when(F.col("is_pre"), key).when(is_post, F.concat(whole, F.col("after"), F.lit(DEV))).otherwise(F.concat(base, F.lit(DEV)))  # nor pre-releases below
    rows = rows.withColumns({"same_lo": F.when(star, F.concat(base, F.lit(DEV))).otherwise(key), "same_hi": F.when(star, up).otherwise(behind)})
    every, grows = F.col("every"), op.isin("~=", "^", "~")
    lo = F.when(every | op.isin("<=", "<", "!="), F.lit("")).when(grows | (op == ">="), key).when(op == ">", above).otherwise(F.col("same_lo"))
    hi = F.when(every | op.isin(">=", ">", "!="), F.lit(TOP)).when(grows, up).when(op == "<=", behind).when(op == "<", below).otherwise(F.col("same_hi"))
    ok = every | (F.col("is_version") & (~star | op.isin("", "==", "!=")) & ~((op == "~=") & (n < 2)) & up.isNotNull())
    # `>` leaves out post-releases of its release, unless it names one.
    hole = F.when(~every & (op == "!="), F.struct(F.col("same_lo").alias("lo"), F.col("same_hi").alias("hi"))).when((op == ">") & ~is_post, F.struct(F.concat(base, F.lit(POST)).alias("lo"), F.concat(base, F.lit(MORE)).alias("hi")))
    return rows.select("spec", "alt", ok.alias("ok"), lo.alias("lo"), hi.alias("hi"), hole.alias("hole"), (~every & F.col("is_pre") & ~op.isin("!=", "<", ">")).alias("allows_pre"), F.lit(None).cast("string").alias("own_core"))


def _semver_tail(pre: Column) -> Column:
    """Identifiers after the release: numeric ones before others, fewer before more; none is the release itself."""
    ids = F.transform(F.split(pre, r"\."), lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("1"), number(x))).otherwise(F.concat(F.lit("2"), x, F.lit(" "))))
    return F.when(pre == "", F.lit(END)).otherwise(F.concat(F.lit(DEV), F.array_join(ids, ""), F.lit("0")))


def _semver_core(*digits: str) -> Column:
    return F.concat_ws(".", *[number(F.col(x)) for x in digits])


def semver_order(df: DataFrame, version: str = "version") -> DataFrame:
    """df with key, a text that sorts as semantic versions do (build parts do not count, missing numbers are zero), or null; is_pre; core, the release."""
    rows = _groups(df.withColumn("v", F.trim(F.coalesce(F.col(version), F.lit("")))), "v", _SEMVER, 4).withColumn("core", _semver_core("g1", "g2", "g3"))
    key = F.when(F.col("v").rlike(_SEMVER), F.concat(F.col("core"), _semver_tail(F.col("g4"))))
    return rows.select(*df.columns, key.alias("key"), (F.col("g4") != "").alias("is_pre"), "core")


def _semver_comparators(rows: DataFrame) -> DataFrame:
    """rows (spec, alt, clause) with ok, lo, hi, hole, allows_pre and own_core (a release whose pre-releases count); x and missing numbers stand for all."""
    text, op, n = F.col("clause"), F.col("g1"), F.col("n")
    rows = _groups(rows, "clause", _COMPARATOR, 5)
    given = [F.col(f"g{k}").rlike("^[0-9]+$") for k in (2, 3, 4)]
    rows = rows.withColumn("n", F.when(~given[0], F.lit(0)).when(~given[1], F.lit(1)).when(~given[2], F.lit(2)).otherwise(F.lit(3)))
    rows = rows.withColumns({f"d{k}": F.when(n > k, F.col(f"g{k + 2}")).otherwise(F.lit("0")) for k in range(3)})
    some = [F.col(f"d{k}").rlike("[1-9]") for k in range(3)]
    # Which number goes up by one to end what the caret, the tilde and missing numbers take in.
    caret = F.when(some[0] | (n == 1), F.lit(0)).when(some[1] | (n == 2), F.lit(1)).otherwise(F.lit(2))
    rows = rows.withColumns({"m": F.when(op == "^", caret).when(n == 1, F.lit(0)).otherwise(F.lit(1)), "pre": F.when(n == 3, F.col("g5")).otherwise(F.lit(""))})
    m = F.col("m")
    rows = rows.withColumns({f"u{k}": F.when(m == k, _one_more(F.col(f"d{k}"))).when(m < k, F.lit("0")).otherwise(F.col(f"d{k}")) for k in range(3)})
    rows = rows.withColumns({"core": _semver_core("d0", "d1", "d2"), "up": _semver_core("u0", "u1", "u2"), "tail": _semver_tail(F.col("pre")), "known": F.col("u0").isNotNull() & F.col("u1").isNotNull() & F.col("u2").isNotNull()})
    rows = rows.withColumns({"key": F.concat("core", "tail"), "full": n == 3})
    key, full, up = F.col("key"), F.col("full"), F.col("up")
    behind, before_up = F.concat(key, F.lit(" ")), F.concat(up, F.lit(DEV))
    every = (text == "") | ((n == 0) & ~op.isin("<", ">"))
    lo = F.when(every | op.isin("<", "<="), F.lit("")).when(n == 0, F.lit(TOP)).when(op == ">", F.when(full, behind).otherwise(F.concat(up, F.lit(END)))).otherwise(key)
    hi = F.when(every | op.isin(">", ">="), F.lit(TOP)).when(n == 0, F.lit("")).when(op == "<", F.when(full, key).otherwise(F.concat(F.col("core"), F.lit(DEV)))).when(op.isin("^", "~"), before_up).otherwise(F.when(full, behind).otherwise(before_up))
    ok = (text == "") | (text.rlike(_COMPARATOR) & F.col("known"))
    return rows.select("spec", "alt", ok.alias("ok"), lo.alias("lo"), hi.alias("hi"), F.lit(None).cast("struct<lo:string,hi:string>").alias("hole"), F.lit(False).alias("allows_pre"), F.when(F.col("pre") != "", F.col("core")).alias("own_core"))


def _pep440_split(alternative: Column) -> Column:
    return F.transform(F.split(alternative, ","), lambda c: F.trim(c))


def _semver_split(alternative: Column) -> Column:
    replace = [(r"^\s*(\S+)\s+-\s+(\S+)\s*$", ">=$1 <=$2"), (r"(>=|<=|>|<|=|~>?|\^)\s+", "$1"), (r"~>", "~"), (r"[\s,]+", " ")]
    return F.split(F.trim(reduce(lambda c, r: F.regexp_replace(c, *r), replace, alternative)), " ")


#: Of a dialect: versions in order, what parts alternatives, a clause's text, and its interval.
DIALECTS = {"pep440": (pep440_order, r"\s*\|\|?\s*", _pep440_split, _pep440_clauses), "semver": (semver_order, r"\s*\|\|\s*", _semver_split, _semver_comparators)}


def range_intervals(specs: DataFrame, dialect: str) -> DataFrame:
    """(spec, part, lo, hi, allows_pre, cores) of distinct specs: the intervals a range takes in; none for what is no range.

    pep440: clauses joined by commas, the caret, the tilde and `*` too, alternatives by `|`; semver: comparators joined by blanks
    or commas, hyphen ranges, alternatives by `||`.
    """
    _, bar, split, clauses = DIALECTS[dialect]
    alternatives = specs.select("spec", F.posexplode(F.split(F.trim("spec"), bar)).alias("alt", "text"))
    rows = clauses(alternatives.select("spec", "alt", F.explode(split(F.col("text"))).alias("clause")))
    both = rows.groupBy("spec", "alt").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok"), F.max("lo").alias("lo"), F.min("hi").alias("hi"), F.array_sort(F.collect_list("hole")).alias("holes"), F.bool_or("allows_pre").alias("allows_pre"), F.array_sort(F.collect_set("own_core")).alias("cores"))
    whole = both.groupBy("spec").agg(F.bool_and("ok").alias("ok"), F.collect_list(F.struct("lo", "hi", "holes", "allows_pre", "cores")).alias("x")).where("ok").select("spec", F.explode("x").alias("x")).select("spec", "x.*")
    piece = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    cut = lambda have, hole: F.flatten(F.transform(have, lambda x: F.array(piece(x["lo"], F.least(x["hi"], hole["lo"])), piece(F.greatest(x["lo"], hole["hi"]), x["hi"]))))
    left = whole.select("spec", "allows_pre", "cores", F.explode(F.filter(F.aggregate("holes", F.array(piece(F.col("lo"), F.col("hi"))), cut), lambda x: x["lo"] < x["hi"])).alias("i"))
    return left.select("spec", F.xxhash64("i.lo", "i.hi", "allows_pre", "cores").alias("part"), "i.lo", "i.hi", "allows_pre", "cores").distinct()
