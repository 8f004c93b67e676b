"""License names, expressions and risk categories."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The category of each SPDX id.
CATEGORIES = {
    "forbidden": (
        "AGPL-1.0", "AGPL-1.0-only", "AGPL-1.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC-BY-NC-1.0", "CC-BY-NC-2.0", "CC-BY-NC-3.0",
        "CC-BY-NC-4.0", "CC-BY-NC-SA-1.0", "CC-BY-NC-SA-2.0", "CC-BY-NC-SA-3.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "WTFPL", "SSPL-1.0", "BUSL-1.1",
    ),
    "restricted": (
        "GPL-1.0", "GPL-1.0-only", "GPL-1.0-or-later", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later",
        "LGPL-2.0", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later",
        "GFDL-1.1", "GFDL-1.2", "GFDL-1.3", "OSL-3.0", "QPL-1.0", "Sleepycat", "CC-BY-SA-4.0",
    ),
    "reciprocal": (
        "MPL-1.0", "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CDDL-1.0", "CDDL-1.1", "CPL-1.0", "Ms-RL", "APSL-2.0", "EUPL-1.1", "EUPL-1.2",
    ),
    "notice": (
        "Apache-1.0", "Apache-1.1", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause-Clear", "BSD-4-Clause", "MIT", "MIT-0", "ISC", "Zlib",
        "libpng", "X11", "Artistic-1.0", "Artistic-2.0", "AFL-2.1", "AFL-3.0", "BSL-1.0", "PostgreSQL", "Python-2.0", "PSF-2.0", "Ruby", "OpenSSL", "Ms-PL",
        "ICU", "NCSA", "Zend-2.0", "CC-BY-3.0", "CC-BY-4.0",
    ),
    "permissive": (
        "WTFPL-2.0", "Beerware",
    ),
    "unencumbered": (
        "Unlicense", "CC0-1.0", "0BSD", "Public-Domain", "blessing",
    ),
}
# How much each category asks for.
SEVERITY = {"forbidden": 6, "restricted": 5, "reciprocal": 4, "notice": 2, "permissive": 2, "unencumbered": 1, "unknown": 0}
CATEGORY_OF = {x.lower(): category for category, ids in CATEGORIES.items() for x in ids}
# Declared names (lower case) and the SPDX id they stand for.
ALIASES = {
    "expat": "MIT", "expat license": "MIT", "mit license": "MIT",
    "apache": "Apache-2.0", "apache 2.0": "Apache-2.0", "apache2": "Apache-2.0", "apache-2": "Apache-2.0", "apache license 2.0": "Apache-2.0",
    "gpl": "GPL-3.0", "gplv3": "GPL-3.0", "gpl v3": "GPL-3.0", "gplv2": "GPL-2.0", "gpl v2": "GPL-2.0",
    "lgpl": "LGPL-3.0", "lgplv3": "LGPL-3.0", "lgpl v3": "LGPL-3.0", "lgplv2.1": "LGPL-2.1", "lgpl v2.1": "LGPL-2.1",
    "bsd": "BSD-3-Clause", "bsd 3 clause": "BSD-3-Clause", "bsd 2 clause": "BSD-2-Clause", "bsd 4 clause": "BSD-4-Clause",
    "agpl": "AGPL-3.0-only", "agpl-3.0": "AGPL-3.0-only", "agplv3": "AGPL-3.0-only", "agpl v3": "AGPL-3.0-only", "gnu affero general public license v3.0": "AGPL-3.0-only",
    "cc0": "CC0-1.0", "mpl": "MPL-2.0", "mozilla public license": "MPL-2.0",
    "epl": "EPL-2.0", "eclipse public license": "EPL-2.0", "eclipse public license 1.0": "EPL-1.0", "eclipse public license 2.0": "EPL-2.0",
    "cddl": "CDDL-1.0", "artistic": "Artistic-2.0", "zlib/libpng": "Zlib", "bsl": "BSL-1.0", "boost": "BSL-1.0", "boost software license": "BSL-1.0",
    "afl": "AFL-3.0", "eupl": "EUPL-1.2", "proprietary": "Proprietary", "commercial": "Proprietary", "closed source": "Proprietary",
}
# Ids that are themselves when only the case of letters differs.
SPELLED_IDS = (
    "MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "AGPL-3.0-only",
    "AGPL-3.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "ISC", "Unlicense", "CC0-1.0", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CDDL-1.0", "CDDL-1.1", "Artistic-2.0", "Zlib", "0BSD", "WTFPL",
    "BSL-1.0", "AFL-3.0", "EUPL-1.2", "PostgreSQL",
)
SPELLED = {x.lower(): x for x in SPELLED_IDS}
KNOWN = SPELLED | ALIASES


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def normalize(name: Column) -> Column:
    """The SPDX id of a declared license name, or the name without outer blanks and quotes."""
    plain = F.regexp_replace(F.trim(name), "^[\"']+|[\"']+$", "")
    return F.coalesce(_map(KNOWN)[F.lower(plain)], plain)


def toml_license(value: Column) -> Column:
    """The SPDX id of a license as TOML writes it: a quoted text, or a table with a text; other values as they are."""
    plain = F.trim(value)
    table = F.regexp_extract(plain, r"\{.*?\btext\s*=\s*(?:\"([^\"]*)\"|'([^']*)').*\}", 1)
    single = F.regexp_extract(plain, r"\{.*?\btext\s*=\s*'([^']*)'.*\}", 1)
    return normalize(F.coalesce(F.nullif(table, F.lit("")), F.nullif(single, F.lit("")), plain))


def category(spdx: Column) -> Column:
    return F.coalesce(_map(CATEGORY_OF)[F.lower(F.trim(spdx))], F.lit("unknown"))


def severity(of: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])[of]


_OPERATORS = ("OR", "AND", "WITH")
_JUDGED = "struct<category:string,severity:int,text:string,names:array<string>>"


def _plain(expression: Column) -> Column:
    """Without outer white space; null as empty."""
    return F.regexp_replace(F.coalesce(expression, F.lit("")), r"(?U)^\s+|\s+$", "")


def _spelled(expression: Column) -> Column:
    """With the operators as words."""
    return F.replace(F.replace(expression, F.lit("||"), F.lit(" OR ")), F.lit("&&"), F.lit(" AND "))


def _judged(name: Column) -> Column:
    of = category(normalize(name))
    return F.struct(of.alias("category"), severity(of).cast("int").alias("severity"), name.alias("text"), F.array(name).alias("names"))


def _let(x: Column, then: Callable[[Column], Column]) -> Column:
    """An expression over a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def _both(op: str, a: Column, b: Column) -> Column:
    """Two sides under an operator, a missing one left out; the left one of equals decides."""
    return _let(F.struct(a.alias("a"), b.alias("b")), lambda x: _both_of(op, x["a"], x["b"]))


def _both_of(op: str, a: Column, b: Column) -> Column:
    left = a["severity"] >= b["severity"] if op == "AND" else a["severity"] <= b["severity"]
    pick = lambda field: F.when(left, a[field]).otherwise(b[field])
    joined = F.struct(pick("category").alias("category"), pick("severity").alias("severity"), F.concat(F.lit("("), a["text"], F.lit(f" {op} "), b["text"], F.lit(")")).alias("text"), F.concat(a["names"], b["names"]).alias("names"))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(joined)


def _frame(ors: Column, ands: Column, last: Column) -> Column:
    return F.struct(ors.alias("ors"), ands.alias("ands"), last.alias("last"))


def _with_operand(frame: Column, x: Column) -> Column:
    """The frame after an operand: its last one, or the exception of the last one."""
    return _let(F.struct(frame.alias("frame"), x.alias("x")), lambda y: _with_operand_of(y["frame"], y["x"]))


def _with_operand_of(frame: Column, x: Column) -> Column:
    last = frame["last"]
    excepted = F.struct(last["category"].alias("category"), last["severity"].alias("severity"), F.concat(last["text"], F.lit(" WITH "), x["text"]).alias("text"), last["names"].alias("names"))
    return _frame(frame["ors"], frame["ands"], F.when(last.isNull(), x).when(x.isNull(), last).otherwise(excepted))


def _closed(frame: Column) -> Column:
    return _both("OR", frame["ors"], _both("AND", frame["ands"], frame["last"]))


def _token_step(s: Column, token: Column) -> Column:
    """One token on a stack of frames, one frame an open bracket: what OR, then AND, has gathered, and the last operand."""
    return _let(F.element_at(s["frames"], -1), lambda top: _moved(s, token, top))


def _moved(s: Column, token: Column, top: Column) -> Column:
    frames, wanted, x = s["frames"], s["wanted"], token["upper"]
    nothing = F.lit(None).cast(_JUDGED)
    up, n = F.try_element_at(frames, F.lit(-2)), F.size(frames)
    below = F.slice(frames, F.lit(1), n - 1)
    opens, operator, closes = wanted & (x == "("), ~wanted & x.isin(*_OPERATORS), ~wanted & (x == ")") & (n > 1)
    ands = _both("AND", top["ands"], top["last"])
    after = F.when(x == "OR", _frame(_closed(top), nothing, nothing)).when(x == "AND", _frame(top["ors"], ands, nothing)).otherwise(top)
    moved = (
        F.when(opens, F.concat(frames, F.array(_frame(nothing, nothing, nothing))))
        .when(wanted, F.concat(below, F.array(_with_operand(top, token["judged"]))))
        .when(operator, F.concat(below, F.array(after)))
        .when(closes, F.concat(F.slice(frames, F.lit(1), F.greatest(n - 2, F.lit(0))), F.array(_with_operand(up, _closed(top)))))
        .otherwise(frames)
    )
    return F.struct(moved.alias("frames"), (opens | operator).alias("wanted"), (s["failed"] | ~(wanted | operator | closes)).alias("failed"))


def analyze(expression: Column) -> Column:
    """struct(licenses, category, canonical) of a license expression, as a fold over its tokens in column functions.

    OR binds loosest, WITH tightest.  AND takes the more severe side, OR the less severe one, WITH its license.  An operator
    without a right side and a bracket that stays open end where the text does; what does not parse to its end is one name.
    Licenses are normalised, each once, in order, without exceptions.  Null and empty texts name none: category unknown, canonical null.
    The work is by row, so one text of half the rows needs no shuffle.
    """
    plain = _plain(expression)
    none = F.lit(None).cast(_JUDGED)
    words = F.regexp_extract_all(_spelled(plain), F.lit(r"(?U)\(|\)|[^\s()]+"), F.lit(0))
    tokens = F.transform(words, lambda x: F.struct(F.upper(x).alias("upper"), _judged(x).alias("judged")))
    start = F.struct(F.array(_frame(none, none, none)).alias("frames"), F.lit(True).alias("wanted"), F.lit(False).alias("failed"))
    unwind = lambda s: F.when(~s["failed"], F.aggregate(F.reverse(s["frames"]), none, lambda x, frame: _closed(_with_operand(frame, x))))
    found = F.coalesce(F.aggregate(tokens, start, _token_step, unwind), F.when(plain != "", _judged(plain)))

    def result(x: Column) -> Column:
        names = F.filter(F.coalesce(x["names"], F.array().cast("array<string>")), lambda y: ~F.upper(y).isin(*_OPERATORS))
        return F.struct(F.array_distinct(F.transform(names, normalize)).alias("licenses"), F.coalesce(x["category"], F.lit("unknown")).alias("category"), x["text"].alias("canonical"))

    return _let(found, result)


def is_spdx_like(name: Column) -> Column:
    """Whether a name looks like an SPDX id: a dash with a version or a usual suffix, and no placeholder word."""
    return name.rlike(r"^[A-Za-z0-9.+]+(-[A-Za-z0-9.+]+)*$") & (name.rlike(r"-[0-9]+(\.[0-9]+)*(-only|-or-later)?$|-Clause(-[A-Za-z]+)?$") | F.lower(name).isin(*[k for k in CATEGORY_OF])) & ~F.lower(name).isin("unknown", "custom")


def detection_type(declared: Column) -> Column:
    """How a declared license comes to its ids: direct, normalized or expression_parsed."""
    plain = F.trim(declared)
    return F.when(plain.rlike(r"(?i)\s(OR|AND|WITH)\s|\|\||&&"), F.lit("expression_parsed")).when(normalize(plain) == plain, F.lit("direct")).otherwise(F.lit("normalized"))


def fold(categories: list[Column], op: str) -> Column:
    """The category of several licenses under one operator, in native expressions."""

    def two(a: Column, b: Column) -> Column:
        keep = severity(a) >= severity(b) if op == "AND" else severity(a) <= severity(b)
        return F.when(keep, a).otherwise(b)

    return reduce(two, categories)
