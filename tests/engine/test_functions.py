import json
import random

import brute_licenses as B
import pytest
from pyspark.sql import functions as F

from granary.functions import columns as C
from granary.functions import licenses as L
from granary.functions import versions as V


def ask(spark, rows, *columns):
    names = [f"c{k}" for k in range(len(rows[0]))]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    return [tuple(r) for r in df.select(*[c.alias(f"o{k}") for k, c in enumerate(columns)]).collect()]


def test_resolved(spark):
    cases = {"1.2.3": "1.2.3", " v1.0 ": "v1.0", "^1.2": "", ">=1": "", "latest": "", "RELEASE": "", "git": "", "http://x/y": "", "file:../a": "", "${v}": "", "V2": "V2", "": "", "abc": "", "1.0.0-rc.1": "1.0.0-rc.1"}
    assert ask(spark, [(k,) for k in cases], V.resolved(F.col("c0"))) == [(v,) for v in cases.values()]


def test_npm_order(spark):
    ordered = ["0.9.0", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.10.0", "2"]
    assert all(x[0] for x in ask(spark, list(zip(ordered, ordered[1:], strict=False)), V.npm_key(F.col("c0")) < V.npm_key(F.col("c1"))))
    assert ask(spark, [("v1.2.3", "=1.2.3"), ("1.2.3+a", "1.2.3+b")], V.npm_key(F.col("c0")) == V.npm_key(F.col("c1"))) == [(True,), (True,)]
    assert ask(spark, [("not a version",)], V.npm_key(F.col("c0")).isNull()) == [(True,)]


def test_pep440_order(spark):
    ordered = ["1.0.dev1", "1.0a1", "1.0b2", "1.0rc1", "1.0", "1.0.post1", "1.0.0", "1.1", "1!0.1"]
    got = ask(spark, list(zip(ordered, ordered[1:], strict=False)), V.pep440_key(F.col("c0")) < V.pep440_key(F.col("c1")))
    assert [x[0] for x in got[1:]] == [True] * (len(got) - 1)
    assert ask(spark, [("1.0+local", "1.0")], V.pep440_key(F.col("c0")) == V.pep440_key(F.col("c1"))) == [(True,)]


def test_buckets(spark):
    cases = [
        ("npm", "1.0.0", "2.0.0", "major"), ("npm", "1.0.0", "1.1.0", "minor"), ("npm", "1.0.0", "1.0.9", "patch"), ("npm", "2.0.0", "1.0.0", "up_to_date"),
        ("npm", "^1.0", "2.0.0", "unpinned"), ("npm", "", "1", "unknown"), ("nuget", "1.2", "1.2.0", "up_to_date"), ("go", "1.2.3", "1.10.0", "minor"),
        ("maven", "9.0", "10.0", "up_to_date"), ("nuget", "1.x", "2.0", "major"), ("pypi", "1.0", "1.0.0", "patch"), ("cargo", "0.1.0", "0.1.0", "up_to_date"),
    ]
    assert ask(spark, [c[:3] for c in cases], V.bucket(F.col("c0"), F.col("c1"), F.col("c2"))) == [(c[3],) for c in cases]
    assert ask(spark, [("maven", "9.0", "10.0")], V.bucket(F.col("c0"), F.col("c1"), F.col("c2"), numeric_maven=True)) == [("major",)]


def test_npm_normal(spark):
    cases = {"workspace:*": "workspace", "file:../x": "local", "link:./y": "link", "npm:1.2.3": "1.2.3", "": "latest", "*": "latest", "^1.0.0": "^1.0.0"}
    assert ask(spark, [(k,) for k in cases], V.npm_normal(F.col("c0"))) == [(v,) for v in cases.values()]


def test_maven_canon(spark):
    cases = {"1.0.RELEASE": "1.0", "2.1-SNAPSHOT": "2.1", "[1.5]": "1.5", "[1.0,2.0)": ">=1.0", "3.0.Final": "3.0"}
    assert ask(spark, [(k,) for k in cases], V.maven_canon(F.col("c0"))) == [(v,) for v in cases.values()]


def test_purl(spark):
    cases = [
        ("npm", "@scope/name", "1.0.0", "pkg:npm/%40scope/name@1.0.0"), ("npm", "left-pad", "^1", "pkg:npm/left-pad"), ("maven", "org.a:b", "2", "pkg:maven/org.a/b@2"), ("gradle", "g:a", "1", "pkg:maven/g/a@1"),
        ("golang", "github.com/a/b", "v1.2.3", "pkg:golang/github.com/a/b@v1.2.3"), ("hex", "x", "1", ""), ("pypi", "a b", "1+c", "pkg:pypi/a%20b@1+c"), ("composer", "v/p", "1", "pkg:composer/v/p@1"),
    ]
    assert ask(spark, [c[:3] for c in cases], C.purl(F.col("c0"), F.col("c1"), F.col("c2"))) == [(c[3],) for c in cases]


def test_paths(spark):
    p = F.col("c0")
    assert ask(spark, [("/a/b/c.py",), ("/go.mod",)], C.depth_prefix(p, 1), C.depth_prefix(p, 2), C.source_dir(p), C.dir_group(p), C.top_dir(p)) == [("/a", "/a/b", "/a/b", "a/b", "a"), ("/go.mod", "", "/", "(root)", "(root)")]
    assert ask(spark, [("/r/x/y", "/r"), ("/other/z", "/r")], C.relative(p, F.col("c1"))) == [("/x/y",), ("/other/z",)]


def test_remote_urls(spark):
    same = ["https://user:pw@Host.com/Org/repo.git", "git@host.com:org/repo.git", "ssh://git@host.com/org/repo/", "http://host.com/org/repo"]
    assert {x[0] for x in ask(spark, [(s,) for s in same], C.remote_url(F.col("c0")))} == {"host.com/org/repo"}
    assert ask(spark, [("https://u:p@h/x",)], C.without_credentials(F.col("c0"))) == [("https://h/x",)]


def test_round2_is_of_the_binary_product(spark):
    df = spark.createDataFrame([(2.675,), (1.005,), (0.125,), (1.0,)], "x double")
    assert [r[0] for r in df.select(C.round2(F.col("x"))).collect()] == [2.68 if 2.675 * 100 >= 267.5 else 2.67, 1.0 if 1.005 * 100 < 100.5 else 1.01, 0.13, 1.0]


def test_ids_do_not_depend_on_order(spark):
    df = spark.createDataFrame([(["b", "a"],), (["a", "b"],)], "p array<string>")
    assert len({r[0] for r in df.select(C.multi_path_id(F.lit("x"), F.col("p"))).collect()}) == 1
    assert len(ask(spark, [("a",)], C.component_id(F.lit("r"), F.col("c0"), F.lit("/")))[0][0]) == 20


@pytest.mark.parametrize("glob,yes,no", [("**/*.py", ["a.py", "x/y/a.py"], ["a.pyc"]), ("*.py", ["a.py"], ["x/a.py"]), ("a?c", ["abc"], ["a/c", "ac"]), ("x/**", ["x/y", "x/y/z"], ["y/x"]), ("a.b+c", ["a.b+c"], ["aXb+c", "a.bbc"])])
def test_globs(glob, yes, no):
    import re

    r = re.compile(C.glob_regex(glob))
    assert all(r.match(x) for x in yes) and not any(r.match(x) for x in no)


def test_utf8(spark):
    texts = [(b"\xef\xbb\xbfa\xc3\xa9", "aé"), ("aé".encode("utf-16"), "aé"), (b"\xfe\xff" + "aé".encode("utf-16-be"), "aé"), ("aé".encode(), "aé"), (b"", "")]
    df = spark.createDataFrame([(bytearray(b),) for b, _ in texts], "content binary")
    assert [r[0] for r in df.select(C.utf8(F.col("content"))).collect()] == [t for _, t in texts]


def test_license_expressions_by_brute_force():
    assert B.parse("MIT OR Apache-2.0 AND BSD") == ("OR", "MIT", ("AND", "Apache-2.0", "BSD"))
    assert B.parse("(MIT OR GPL-2.0) AND ISC") == ("AND", ("OR", "MIT", "GPL-2.0"), "ISC")
    assert B.parse("GPL-2.0 WITH Classpath") == ("WITH", "GPL-2.0", "Classpath")
    assert B.parse("MIT and more words here") == "MIT and more words here"


def test_license_expressions(spark):
    cases = {"MIT": "notice", "MIT OR GPL-3.0": "notice", "MIT AND GPL-3.0": "restricted", "MIT OR weird": "unknown", "MIT AND weird": "notice", "GPL-2.0 WITH X": "restricted", "(MPL-2.0 OR MIT) AND Unlicense": "notice", "WTFPL": "forbidden", "WTFPL-2.0": "permissive"}
    assert ask(spark, [(k,) for k in cases], L.analyze(F.col("c0"))["category"]) == [(v,) for v in cases.values()]
    assert ask(spark, [("mit || (gplv3 && ISC)",)], L.analyze(F.col("c0"))["licenses"]) == [(["MIT", "GPL-3.0", "ISC"],)]
    canonical = {"a or b and c with d": "(a OR (b AND c WITH d))", "a AND (b OR c": "(a AND (b OR c))", "a OR": "a", "a b": "a b", "": None, "((": "((", "()": ")"}
    assert ask(spark, [(k,) for k in canonical], L.analyze(F.col("c0"))["canonical"]) == [(v,) for v in canonical.values()]
    assert ask(spark, [(None,), ("MIT",)], F.to_json(L.analyze(F.col("c0")))) == [('{"licenses":[],"category":"unknown"}',), ('{"licenses":["MIT"],"category":"notice","canonical":"MIT"}',)]


def canonical(tree) -> str:
    if isinstance(tree, str):
        return tree
    op, a, b = tree[0], canonical(tree[1]), canonical(tree[2])
    return f"{a} WITH {b}" if op == "WITH" else f"({a} {op} {b})"


def test_license_expressions_against_descent(spark):
    rng = random.Random(5)
    words = ["(", ")", "AND", "or", "With", "MIT", "gplv3", "MPL-2.0", "unlicense", "odd", "||", "WTFPL-2.0", '"ISC"']
    texts = list({" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(3000)}) + ["(" * 60 + "MIT" + ")" * 60, " OR ".join(["MIT"] * 500)]
    got = ask(spark, [(t,) for t in texts], F.to_json(L.analyze(F.col("c0"))))
    for t, (x,) in zip(texts, got, strict=True):
        tree, x = B.parse(t), json.loads(x)
        assert (x["licenses"], x["category"], x["canonical"]) == (B.names(t), B.expression_category(tree), canonical(tree)), t


def test_license_columns(spark):
    cases = {"mit": "MIT", '"Apache 2.0"': "Apache-2.0", "gplv2": "GPL-2.0", "Custom": "Custom", " ISC ": "ISC"}
    assert ask(spark, [(k,) for k in cases], L.normalize(F.col("c0"))) == [(v,) for v in cases.values()]
    assert ask(spark, [("MIT OR GPL-3.0",), ("",)], L.analyze(F.col("c0"))["category"]) == [("notice",), ("unknown",)]
    assert ask(spark, [("MIT",), ("mit",), ("MIT OR ISC",)], L.detection_type(F.col("c0"))) == [("direct",), ("normalized",), ("expression_parsed",)]
    assert ask(spark, [("Apache-2.0",), ("BSD-3-Clause",), ("custom",), ("see file",)], L.is_spdx_like(F.col("c0"))) == [(True,), (True,), (False,), (False,)]
