"""Workspace members against every glob tried on every directory."""

import random
import re

from pyspark.sql import functions as F

from granary.functions.columns import glob_regex
from granary.operators import workspaces as W

FILES = "dir string, name string, text string"


def test_globs_of_manifests(spark):
    cargo = """[package]
name = "x"
members = ["not/this"]
[workspace]
# members = ["nor/this"]
members = [
  "crates/*",  # "nor this"
  'tools/one',
]
exclude = ["crates/old/"]
[workspace.dependencies]
serde = { features = ["derive"] }
"""
    rows = [
        ("/a", "package.json", '{"workspaces":["p/*","!p/x",""]}'), ("/b", "package.json", '{"workspaces":{"packages":["q/**"]}}'), ("/c", "package.json", '{"name":"c"}'), ("/d", "package.json", "{broken"),
        ("/e", "package.json", None), ("/f", "Cargo.toml", cargo), ("/g", "Cargo.toml", '[workspace]\r\nmembers = ["k"]\r\n'), ("/h", "nx.json", "{}"), ("/i", "other.json", '{"workspaces":["p/*"]}'), ("/j", "package.json", '{"workspaces":"p/*"}'),
    ]
    got = {tuple(r) for r in W.globs(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {("npm", "/a", "p/*"), ("npm", "/a", "!p/x"), ("npm", "/b", "q/**"), ("cargo", "/f", "crates/*"), ("cargo", "/f", "tools/one"), ("cargo", "/f", "!crates/old/**"), ("cargo", "/g", "k"), ("nx", "/h", "**")}


def test_patterns(spark):
    plain = ["a/*", "a/**", "**/b", "a/**/b", "a?c", "a.b+c(d)", "**", "a**b", "x,y", "{a"]
    df = spark.createDataFrame([(g,) for g in plain], "g string").select(W.glob_pattern(F.col("g"))).collect()
    paths = ["a", "a/b", "a/x/b", "b", "abc", "a.b+c(d)", "axb", "a/xb", "x,y", "x", "{a", "a.bbc(d)"]
    for g, (p,) in zip(plain, df, strict=True):
        assert [bool(re.search(p, x)) for x in paths] == [bool(re.search(glob_regex(g), x)) for x in paths], g
    more = {"{a,b*}/c": ["a/c", "bb/c"], "[!ab]c": ["xc"], "[ab]c": ["ac", "bc"], "x[[&]y": ["x[y", "x&y"]}
    every = ["a/c", "bb/c", "c/c", "xc", "ac", "bc", "x[y", "x&y", "xzy"]
    df = spark.createDataFrame([(g, x) for g in more for x in every], "g string, x string").where(F.rlike(F.col("x"), W.glob_pattern(F.col("g")))).collect()
    got = {g: [x for h, x in df if h == g] for g in more}
    assert got == more


def test_members_against_every_glob(spark):
    rng = random.Random(2)
    names = ["a", "b", "packages", "node_modules"]
    folder = lambda n: "".join("/" + rng.choice(names) for _ in range(n))
    packages = sorted({(rng.choice(["npm", "cargo"]), folder(rng.randint(1, 5))) for _ in range(400)})
    forms = ["*", "**", "a/*", "a/**", "!a/b", "!**/b", "./packages/*/", "**/a", "packages/a", "b/**/a", "!b/**", "?/*", "../a/*"]
    globs = sorted({(rng.choice(["npm", "cargo"]), rng.choice(["/", folder(1), folder(2)]), rng.choice(forms)) for _ in range(60)})
    want = {}
    for kind, path in packages:
        near = None
        for root in {r for k, r, _ in globs if k == kind}:
            top = root.rstrip("/") + "/"
            if not path.startswith(top) or "node_modules" in path[len(top):].split("/"):
                continue
            hits = [g.startswith("!") for k, r, g in globs if (k, r) == (kind, root) and re.search(glob_regex(re.sub(r"^(\./)+", "", g.removeprefix("!")).rstrip("/")), path[len(top):])]
            if hits and not any(hits) and (near is None or len(root) > len(near)):
                near = root
        if near is not None:
            want[kind, path] = near
    rows = packages + packages[:5] + [("npm", None)]
    got = W.members(spark.createDataFrame(rows, "kind string, dir string"), spark.createDataFrame([*globs, *globs[:3], ("npm", "/a", None)], "kind string, root string, glob string")).collect()
    assert {(r["kind"], r["dir"]): r["root"] for r in got} == want and len(got) == len(want) > 40
    assert W.members(spark.createDataFrame([], "kind string, dir string"), spark.createDataFrame(globs, "kind string, root string, glob string")).collect() == []
