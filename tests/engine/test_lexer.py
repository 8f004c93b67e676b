"""Lines told apart by hand, and by matchers as by the fold."""

import random

from granary.functions import lexer

CASES = [
    ("C", 'int a; // x\n/* b\n\n c */ int d;\nchar *s = "// no /* no";\n\nif (a && b) { /* if */ }\n', (7, 4, 1, 2, 2)),
    ("JavaScript", "let a = `\n// no ${b || c}\n`; // c\n/* x */ /* y */\n'it\\'s /*'; for (;;) {}\n", (5, 4, 1, 0, 1)),
    ("Rust", '/* a /* b */ still */\nfn x() {} // if\n/* /* */\nif */ if\n*/\nlet s = "/*"; match x {}\n', (6, 4, 2, 0, 2)),
    ("Kotlin", '/* /* */ */ val s = """\n/* no\n\n"""\n/* if\n\n*/ val t = "a"""" /* b */\n', (7, 4, 1, 2, 0)),
    ("Swift", "/* one */\nlet a = 1 // if\n/* /* /* deep */ */ */\nif a { /* */ }\n", (4, 2, 2, 0, 1)),
    ("Python", 'x = """a\n# no\n\nif"""  # c\n# yes\n\'#\' if y else 1\n', (6, 4, 1, 1, 1)),
    ("Shell", "cat <<EOF\n# text\nif\n\nEOF\n# c\necho $# # d\nif [ \"#\" ]; then\n", (8, 6, 1, 1, 1)),
    ("Ruby", "x = <<~'A'\n  # no\n  A\n# yes\ny = \"#{a}\" # c\n", (5, 4, 1, 0, 0)),
    ("SQL", "select 'it''s -- no' -- c\n-- d\n/* x */\n", (3, 1, 2, 0, 0)),
    ("Delphi", "{ a }\nx := '{'; (* b\n*) y // z\n", (3, 2, 1, 0, 0)),
    ("HTML", "<p>don't</p>\n<!-- a\nb -->\n", (3, 1, 2, 0, 0)),
    ("YAML", "a: b#c # d\n# e\n", (2, 1, 1, 0, 0)),
    ("Text", "a\n\n# if", (3, 2, 0, 1, 1)),
    ("no such language", "// a\nb", (2, 1, 1, 0, 0)),
    (None, "/* open\n\nto the end", (3, 0, 2, 1, 0)),
    ("C", "", (0, 0, 0, 0, 0)),
    ("C", None, (0, 0, 0, 0, 0)),
    ("C", "\n", (1, 0, 0, 1, 0)),
    ("C", "\r\n\r\n", (2, 0, 0, 2, 0)),
    ("C", "a\n\n\n", (3, 1, 0, 2, 0)),
    ("C", "  \n\ta", (2, 1, 0, 1, 0)),
]


def counted(spark, rows, **how):
    df = spark.createDataFrame([(k, language, text) for k, (language, text, *_) in enumerate(rows)], "k int, language string, text string")
    return [(r["lines"], r.code, r.comments, r.blanks, r.complexity) for r in lexer.line_counts(df, **how).orderBy("k").collect()]


def test_cases(spark):
    got = counted(spark, CASES)
    assert [(c[:2], g) for c, g in zip(CASES, got, strict=True)] == [(c[:2], c[2]) for c in CASES]


def test_matchers_and_fold_agree_where_comments_do_not_nest(spark):
    rng = random.Random(9)
    # Not `*/*` and `/*/`, nor three quotes in a row: the fold reads them as languages with nested comments do.
    parts = ["/ ", "* ", " /* ", " */ ", " //", '"', "'", "\\", "\n", " ", "a", "if", "iffy", "&&", "&", "||", "x.for(", "{", "\t"]
    rows = [(rng.choice(["C", "other"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for _ in range(1500)]
    assert counted(spark, rows) == counted(spark, rows, fold_all=True)


def test_long_texts(spark):
    """Very long lines, strings, comments and runs, and many of them: the matchers hold no place for each of their parts."""
    n = 200_000
    rows = [("C", "a " * n), ("C", '"' + "\\n" * n + '"; if'), ("C", "/*" + "x\n" * n + "*/"), ("C", "// if\n" * n), ("Rust", "/* " * 500 + "if " + "*/ " * 500 + "\nfor\n" + "ab(c) " * n), ("Shell", "cat <<X\n" + "if\n" * n + "X\nif\n")]
    assert counted(spark, rows) == [(1, 1, 0, 0, 0), (1, 1, 0, 0, 1), (n + 1, 0, n + 1, 0, 0), (n, 0, n, 0, 0), (3, 2, 1, 0, 1), (n + 3, n + 3, 0, 0, 1)]
