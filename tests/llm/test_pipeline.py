"""run() against the stages applied one after another in plain Python."""

import collections
import re

import corpus_pipeline
from test_exact import brute_classes

from granary.llm import secret_scan, source_mixing


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source").collect()]
    items = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    docs = [r for r in docs if any(c.isalpha() for c in r[1])]
    classes = brute_classes([r[:2] for r in docs], 0.8)
    docs = [r for r in docs if classes[r[0]] == r[0]]
    plain = lambda t: " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())) + " "
    docs = [r for r in docs if not any(plain(x) in plain(r[1]) for x in items)]
    docs = [(i, secret_scan.redacted(t, secret_scan.spans_of(t)), s) for i, t, s in docs]
    out = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, d).collect():
        out[r.doc_id, r.text, r.source].append(r.copy)
        assert r.n_chars == len(r.text)
    left = spark.createDataFrame(docs, "doc_id long, text string, source string")
    want = {tuple(r)[:3]: r.copies for r in source_mixing.mix(left).select("row.doc_id", "row.text", "row.source", "copies").collect() if r.copies}
    assert {k: sorted(v) for k, v in out.items()} == {k: list(range(1, n + 1)) for k, n in want.items()}
