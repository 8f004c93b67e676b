"""Element paths against marks that are no elements."""

import random
import time
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from granary.operators.rules import xml_predicate

CASES = [
    ("<a><b>x</b></a>", "$.a.b", "x", True),
    ("<a><b> x </b></a>", "a/b", "x", True),
    ("<a><!-- <b>x</b> --></a>", "a.b", None, False),
    ("<a><c/></a><b>x</b>", "a.b", None, False),
    ("<a><c></c><b>x</b></a>", "a.b", "x", True),
    ("<a><c><b>x</b></c></a>", "a.b", None, False),
    ("<a><c><b>x</b></c><b>y</b></a>", "a.b", "x", False),
    ("<a><b>y</b><b>x</b></a>", "a.b", "x", True),
    ("<a><b/></a>", "a.b", None, True),
    ("<a><b>", "a.b", None, False),
    ("<a t='<b>x</b>'/>", "a.b", None, False),
    ('<?xml version="1.0"?><!DOCTYPE a><p:a xmlns:p="u"><p:b>x</p:b></p:a>', "a.b", "x", True),
    ("<a><![CDATA[<b>x</b>]]></a>", "a.b", None, False),
    ("<a><b><![CDATA[x]]></b></a>", "a.b", "x", True),
    ("<a><b>1 &lt; 2</b></a>", "a.b", "1 < 2", True),
    ("<a><b>x<c>y</c>z</b></a>", "a.b", "xy", True),
    ("<a><b>one two</b></a>", "a.b", "/e t/", True),
    ("<a><b>one two</b></a>", "a.b", "/e.t/", False),
    ("<html><head><meta><title>x</title></head></html>", "html.head.title", "x", True),
    ("<!DOCTYPE html><HTML><head><script>'<title>x</title>'</script></head></HTML>", "html.head.title", None, False),
    ("<a><script><b>x</b></script></a>", "a.script.b", "x", True),
    (None, "a", None, False),
    ("", "a", None, False),
    ("<a>x</a>", "", None, False),
    ("< a < b << <a>", "a", None, False),
    ("<" * 50000 + "a", "a", None, False),
    ("<a>" + "<c>x</c>" * 20000 + "<b>x</b></a>", "a.b", "x", True),
    ("<a><b t='" + "y" * 500000 + "'>x</b></a>", "a.b", "x", True),
]


@pytest.mark.parametrize("path, value", sorted({(p, v) for _, p, v, _ in CASES}, key=str))
def test_paths(spark, path, value):
    cases = [(t, want) for t, p, v, want in CASES if (p, v) == (path, value)]
    got = spark.createDataFrame([(t,) for t, _ in cases], "t string").select(xml_predicate(F.col("t"), path, value)).collect()
    assert [r[0] for r in got] == [want for _, want in cases]


def test_against_a_parser(spark):
    rng = random.Random(3)

    def grow(depth: int) -> str:
        name, inner = rng.choice("abc"), ""
        for _ in range(rng.randint(0, 3) if depth else 0):
            inner += rng.choice(["", "<!-- <a><b>x</b></a> -->", "t", "<![CDATA[<b>]]>"]) + grow(depth - 1)
        return f"<{name}>{inner}</{name}>" if inner or rng.random() < 0.5 else f"<{name} k='<' />".replace("'<'", "'&lt;'")

    texts = [grow(4) for _ in range(400)]
    for path in ("a.b", "a.b.c", "b.a.a", "c"):
        first, *rest = path.split(".")
        want = [r.tag == first and (not rest or r.find("/".join(rest)) is not None) for r in map(ET.fromstring, texts)]
        got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(xml_predicate(F.col("t"), path, None)).collect()]
        assert got == want and len(set(want)) == 2


def test_a_page_costs_its_length(spark):
    page = "<!DOCTYPE html><html><head></head><body>" + "<p>x" * 100_000 + "<title>a</title></body></html>"
    pages = spark.createDataFrame([(page,)], "h string")
    began = time.monotonic()
    got = pages.select(*[xml_predicate(F.col("h"), path, value) for path, value in (("html.head.title", None), ("html.head.title", "/a/"), ("html.body.p", None))]).collect()
    assert tuple(got[0]) == (False, False, True) and time.monotonic() - began < 30
