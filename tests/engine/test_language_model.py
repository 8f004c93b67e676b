"""Languages by content against the same sums by hand."""

import math
import random
import re
from collections import Counter

import pytest

from granary.operators import language_model as LM

LABELLED = "path string, ext string, language string, text string"


def by_hand(files, asked, candidates, min_count):
    counts, per = {}, Counter()
    for _, _, language, text in files:
        if language is not None and text is not None:
            per[language] += 1
            counts.setdefault(language, Counter()).update(re.findall(LM.TOKEN, text))
    every = sum(counts.values(), Counter())
    vocabulary = {t for t, n in every.items() if n >= min_count}
    total = {x: len(vocabulary) + sum(n for t, n in c.items() if t in vocabulary) for x, c in counts.items()}
    weight = lambda a, b: int(math.floor(abs(math.log(a / b) * 1000) + 0.5)) * (-1 if a < b else 1)
    out = {}
    for path, ext, text in asked:
        best = []
        for e, language in candidates:
            if e == ext and language in per:
                s = weight(per[language], sum(per.values())) + sum(weight(counts[language][t] + 1, total[language]) for t in re.findall(LM.TOKEN, text or "") if t in vocabulary)
                best.append((-s, language))
        if best:
            out[path] = (min(best)[1], -min(best)[0])
    return out


@pytest.mark.parametrize("min_count", [1, 3])
def test_sums(spark, min_count):
    rng = random.Random(4)
    words = ["#include", "@end", "class", "x1", "->", "{", "}", "é", "end", "::", "_a", "9", "\n"]
    text = lambda k: " ".join(rng.choice(words[k:]) for _ in range(rng.randint(0, 30)))
    files = [(f"/{k}", ".q", rng.choice(["C", "C++", "Lua"]), text(k % 3)) for k in range(60)] + [("/n", ".q", None, "class"), ("/m", ".q", "C", None)]
    asked = [(f"/a{k}", rng.choice([".h", ".m", ".z", None]), text(k % 4)) for k in range(60)] + [("/none", ".h", None), ("/empty", ".h", ""), ("/odd", ".h", "zzz")]
    candidates = [(".h", "C"), (".h", "C++"), (".h", "Absent"), (".m", "Lua"), (".m", "C"), (".z", "Absent")]
    model = LM.fit(spark.createDataFrame(files, LABELLED), min_count)
    got = LM.classify(spark.createDataFrame(asked, "path string, ext string, text string"), model, spark.createDataFrame(candidates, "ext string, language string"))
    assert {r["path"]: (r["language"], r["score"]) for r in got.collect()} == by_hand(files, asked, candidates, min_count)


def test_ties_and_empty_tables(spark):
    files = spark.createDataFrame([("/a", ".c", "C", "x y"), ("/b", ".cc", "C++", "x y"), ("/h", ".h", "C++", "x")], LABELLED)
    assert [tuple(r)[:2] for r in LM.by_content(files).collect()] == [("/h", "C")]
    assert LM.by_content(files.where("ext = '.h'")).collect() == []
    assert LM.by_content(files.where("ext <> '.h'")).collect() == []


def test_more_languages_than_a_plan_holds(spark, monkeypatch):
    monkeypatch.setattr(LM, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError, match="more than 1 languages"):
        LM.fit(spark.createDataFrame([("/a", ".c", "C", "x"), ("/b", ".d", "D", "x")], LABELLED))
