"""Lines of code, comments and blanks, and branches, told apart by what tokens the text is made of.

Marks inside strings are no comments, quotes inside comments no strings, and words inside either do not branch.  What the
marks mean is a row of a table, so all languages take the one pass: the matcher of a language finds its strings, comments and
here-documents whole, each is masked line by line, and the lines of what is left are counted.  Comments that hold comments
are beyond a matcher: texts that may have them are folded token by token, with the depth as state.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words and marks that branch.
BRANCHES = ("if", "for", "while", "case", "catch", "elif", "except", "when", "match", "&&", "||")
#: Strings that go on over line ends.
LONG_STRINGS = ('"""', "'''", "`")
_C = {"line": ["//"], "blocks": [("/*", "*/")], "strings": ['"', "'"]}
_SHARP = {"line": ["#"], "strings": ['"', "'"]}
_TAGS = {"blocks": [("<!--", "-->")]}
# How comments and strings begin and end, by language; nested: comments hold comments; here: `<<WORD` begins a
# here-document; apart: the line mark counts after white space only.  Other languages are read as C is.
LANGUAGES: dict[str, dict] = {
    "": _C, "JavaScript": _C | {"strings": ['"', "'", "`"]}, "TypeScript": _C | {"strings": ['"', "'", "`"]}, "TSX": _C | {"strings": ['"', "'", "`"]}, "Go": _C | {"strings": ['"', "'", "`"]},
    "Rust": _C | {"strings": ['"'], "nested": True}, "Swift": _C | {"strings": ['"""', '"'], "nested": True}, "Kotlin": _C | {"strings": ['"""', '"', "'"], "nested": True}, "Scala": _C | {"strings": ['"""', '"'], "nested": True},
    "Dart": _C | {"strings": ['"""', "'''", '"', "'"], "nested": True}, "Java": _C | {"strings": ['"""', '"', "'"]}, "PHP": _C | {"line": ["//", "#"], "here": True}, "CSS": _C | {"line": []},
    "Delphi": {"line": ["//"], "blocks": [("{", "}"), ("(*", "*)")], "strings": ["'"]}, "SQL": {"line": ["--"], "blocks": [("/*", "*/")], "strings": ["'", '"']},
    "Python": _SHARP | {"strings": ['"""', "'''", '"', "'"]}, "Elixir": _SHARP | {"strings": ['"""', "'''", '"', "'"]}, "Ruby": _SHARP | {"here": True}, "Shell": _SHARP | {"here": True, "apart": True}, "Perl": _SHARP | {"here": True, "apart": True},
    "R": _SHARP, "YAML": _SHARP | {"apart": True}, "TOML": _SHARP | {"strings": ['"""', "'''", '"', "'"]}, "Makefile": {"line": ["#"]}, "Dockerfile": {"line": ["#"], "apart": True}, "HCL": _C | {"line": ["#", "//"], "strings": ['"'], "here": True},
    "HTML": _TAGS, "XML": _TAGS, "Vue": _TAGS, "Markdown": _TAGS, "JSON": {}, "CSV": {}, "Text": {}, "reStructuredText": {},
}

#: Stands for a comment, and for a string, in a masked text.
COMMENT_MARK, STRING_MARK = "\x01", '"'


def _branches() -> str:
    return r"\b(?:" + "|".join(b for b in BRANCHES if b.isalpha()) + r")\b|" + "|".join(re.escape(b) for b in BRANCHES if not b.isalpha())


#: What is no quote, and no escape of one.
_ESCAPE = r"""\\["'`\\]"""


def _string(quote: str) -> str:
    """A string from its quote to the next, or to the end of the line (of the text, if it may hold line ends)."""
    q = re.escape(quote)
    if quote in LONG_STRINGS:
        return rf"{q}(?:(?!{q})[^\\]|\\[\s\S])*+(?:{q}|\z)"
    return rf"{q}(?:[^{q}\\\n]++|\\[^\n])*+{q}?"


def matcher(language: str) -> str:
    """A pattern that finds the escapes, strings, comments and here-documents of a language, each whole."""
    one = LANGUAGES[language]
    parts = [_ESCAPE] if one.get("strings") else []
    if one.get("here"):
        parts.append(r"""<<[-~]?(["']?)([A-Za-z_]\w*)\1[^\n]*(?:\n(?![ \t]*\2[ \t]*(?:\n|\z))[^\n]*)*+(?:\n[ \t]*\2[ \t]*(?=\n|\z))?""")
    parts += [rf"{re.escape(a)}[\s\S]*?(?:{re.escape(b)}|\z)" for a, b in one.get("blocks", [])]
    parts += [("(?<!\\S)" if one.get("apart") else "") + re.escape(m) + r"[^\n]*" for m in one.get("line", [])]
    parts += [_string(q) for q in one.get("strings", [])]
    return "|".join(parts) or r"\z(?!\z)"


_SPEC = "struct<matcher:string,nested:boolean,remarks:array<string>,line:array<string>,opens:array<string>,closes:array<string>,strings:array<string>>"


def _spec(language: Column) -> Column:
    """The row of a language, of one literal: as thousands of expressions the table would take longer to plan than to use."""
    rows = {}
    for name, one in LANGUAGES.items():
        line, blocks = one.get("line", []), one.get("blocks", [])
        opens = [a for a, _ in blocks]
        rows[name] = {"matcher": matcher(name), "nested": bool(one.get("nested")), "remarks": line + opens, "line": line, "opens": opens, "closes": [b for _, b in blocks], "strings": one.get("strings", [])}
    table = F.from_json(F.lit(json.dumps(rows)), f"map<string,{_SPEC}>")
    return F.coalesce(F.try_element_at(table, F.coalesce(language, F.lit(""))), F.try_element_at(table, F.lit("")))


def _masked(text: Column, spec: Column) -> Column:
    """The text with every comment, string, escape and here-document as one mark on each of its lines that is not blank."""
    found = F.regexp_extract_all(text, spec["matcher"], F.lit(0))
    between = F.split(text, spec["matcher"], -1)

    def mask(x: Column) -> Column:
        mark = F.when(F.exists(spec["remarks"], lambda m: x.startswith(m)), F.lit(COMMENT_MARK)).otherwise(F.lit(STRING_MARK))
        return F.regexp_replace(x, F.lit(r"[^\n]*\S[^\n]*"), mark)

    return F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.when(b.isNull(), F.lit("")).otherwise(mask(b)))), "")


def _counted(masked: Column) -> Column:
    lines = F.split(F.regexp_replace(masked, r"\n\z", ""), "\n")
    n = lambda pattern: F.when(masked == "", F.lit(0)).otherwise(F.size(F.filter(lines, lambda x: x.rlike(pattern)))).cast("long")
    comments, blanks = n(rf"^\s*{COMMENT_MARK}[\s{COMMENT_MARK}]*\z"), n(r"^\s*\z")
    every = F.when(masked == "", F.lit(0)).otherwise(F.size(lines)).cast("long")
    return F.struct((every - comments - blanks).alias("code"), comments.alias("comments"), blanks.alias("blanks"), F.regexp_count(masked, F.lit(_branches())).cast("long").alias("complexity"))


_MARKS = ['"""', "'''", "//", "/*", "*/", '"', "'", "&&", "||"]
_WORDS = r"(?:" + "|".join(b for b in BRANCHES if b.isalpha()) + r")\b"
#: What begins no mark of a language with nested comments; runs end before words that branch.
_PLAIN = rf"""[^\n\w\\"'/*&|]++|(?!{_WORDS})\w++|/(?![/*])|&(?!&)|\|(?!\|)|\*(?!/)"""
_TOKEN = "|".join([r"\n", _ESCAPE, *map(re.escape, _MARKS), rf"\b{_WORDS}", rf"(?:{_PLAIN})++", "."])
CODE, COMMENT, STRING, LINE = range(4)


def _step(s: Column, token: Column, spec: Column) -> Column:
    """The state after one token (text, and whether it is blank).  A closing mark in code is code; `*/*` there opens no comment."""
    kind, close, depth, x, blank = s["kind"], s["close"], s["depth"], token["text"], token["blank"]
    end = x == "\n"
    opens, begins_line = F.array_contains(spec["opens"], x), F.array_contains(spec["line"], x)
    in_code = kind == CODE
    # Three quotes in a row are one token: where a language has no such strings they are a string's end and the next one's begin.
    quote = F.when(x.isin('"""', "'''") & ~F.array_contains(spec["strings"], x), F.substring(x, 1, 1)).otherwise(x)
    thrice = F.concat(close, close, close)
    after_end = F.when((kind == COMMENT) | ((kind == STRING) & close.isin(*LONG_STRINGS)), kind).otherwise(F.lit(CODE))
    from_code = F.when(opens, F.lit(COMMENT)).when(begins_line, F.lit(LINE)).when(F.array_contains(spec["strings"], quote), F.lit(STRING)).otherwise(F.lit(CODE))
    closed = ((kind == STRING) & ((x == close) | (x == thrice))) | ((kind == COMMENT) & (x == close) & (depth <= 1))
    remark = (kind == COMMENT) | (kind == LINE) | (in_code & (opens | begins_line))
    one = lambda yes: F.when(yes, F.lit(1)).otherwise(F.lit(0)).cast("long")
    return F.struct(
        F.when(end, after_end).when(in_code, from_code).when(closed, F.lit(CODE)).otherwise(kind).alias("kind"),
        F.coalesce(F.when(end | ~in_code, close).when(opens, F.get(spec["closes"], (F.array_position(spec["opens"], x) - 1).cast("int"))).otherwise(quote), F.lit("")).alias("close"),
        F.when(in_code, F.lit(1)).when(kind != COMMENT, depth).when(x == close, depth - 1).when(spec["nested"] & opens, depth + 1).otherwise(depth).alias("depth"),
        (~end & (s["has_code"] | (~blank & ~remark))).alias("has_code"),
        (~end & (s["has_comment"] | (~blank & remark))).alias("has_comment"),
        (s["code"] + one(end & s["has_code"])).alias("code"),
        (s["comments"] + one(end & ~s["has_code"] & s["has_comment"])).alias("comments"),
        (s["blanks"] + one(end & ~s["has_code"] & ~s["has_comment"])).alias("blanks"),
        (s["complexity"] + one(in_code & x.isin(*BRANCHES))).alias("complexity"),
    )


def _folded(text: Column, spec: Column) -> Column:
    tokens = F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), lambda x: F.struct(x.alias("text"), x.rlike(r"^\s*\z").alias("blank")))
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(CODE).alias("kind"), F.lit("").alias("close"), F.lit(1).alias("depth"), F.lit(False).alias("has_code"), F.lit(False).alias("has_comment"), *[zero.alias(c) for c in ("code", "comments", "blanks", "complexity")])
    names = ("code", "comments", "blanks", "complexity")
    return F.aggregate(tokens, start, lambda s, x: _step(s, x, spec), lambda s: F.struct(*[s[c].alias(c) for c in names]))


def line_counts(files: DataFrame, text_col: str = "text", language_col: str = "language", fold_all: bool = False) -> DataFrame:
    """files with lines, code, comments, blanks and complexity (longs).

    A line with code is code, one with a comment only a comment, one with white space only a blank, wherever it stands.  A null
    or empty text has no lines; the last line end begins none.  fold_all folds every text, for tests.
    """
    text = F.regexp_replace(F.coalesce(text_col, F.lit("")), "\r\n?", "\n")
    text = F.when((text == "") | text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))
    out = files.withColumns({"lexer_spec": _spec(F.col(language_col)), "lexer_text": text})
    spec = F.col("lexer_spec")
    nested = F.lit(fold_all) | (spec["nested"] & F.col("lexer_text").contains("/*"))
    out = out.withColumn("lexer_masked", F.when(~nested, _masked(F.col("lexer_text"), spec)))
    out = out.withColumn("lexer_end", F.when(nested, _folded(F.col("lexer_text"), spec)).otherwise(_counted(F.col("lexer_masked"))))
    counts = {c: F.col(f"lexer_end.{c}") for c in ("code", "comments", "blanks", "complexity")}
    return out.withColumns(counts | {"lines": counts["code"] + counts["comments"] + counts["blanks"]}).drop("lexer_spec", "lexer_text", "lexer_masked", "lexer_end")
