"""Every operator and stage on nulls, empty and repeated rows, empty tables and clashing column names."""

import corpus_pipeline
import pytest

from granary.llm import decontaminate, fill_in_middle, language_id, license_scan, minhash_dedup, period_runs, piece_encoding, quality_rules, queries, secret_scan, source_mixing, substring_dedup, suffix_dedup, toxicity


@pytest.fixture(scope="module")
def model(spark):
    return language_id.learn(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "some words here some words here"), (None, None)], "item_id long, text string")


@pytest.fixture(scope="module")
def operators(model, bench):
    nothing = ([], [])
    return {
        "quality": quality_rules.quality_rules,
        "license": license_scan.license_scan,
        "minhash": minhash_dedup.near_duplicates,
        "tiling": lambda df: decontaminate.contaminated(df, bench),
        "toxicity": lambda df: toxicity.classify(df, toxicity.chain(*[nothing[0], __import__("numpy").zeros((0, 2), int)]), ["low", "toxic"]),
        "windows": substring_dedup.remove_repeated_windows,
        "strings": suffix_dedup.remove_repeated_strings,
        "secrets": secret_scan.secret_scan,
        "language": lambda df: language_id.identify(df, model),
        "mix": source_mixing.mix,
        "runs": period_runs.period_runs,
        "pieces": piece_encoding.encode,
        "middle": fill_in_middle.transform,
    }


NAMES = ["quality", "license", "minhash", "tiling", "toxicity", "windows", "strings", "secrets", "language", "mix", "runs", "pieces", "middle"]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("more", [False, True])
def test_odd_rows(operators, frame, odd, name, more):
    rows = operators[name](frame(odd, more)).collect()
    assert len(rows) == (4 if name == "tiling" else len(odd))


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(operators, frame, name):
    assert operators[name](frame([])).collect() == []


def test_rows_that_share_an_id(frame):
    text = " ".join(f"w{k}" for k in range(60))
    got = sorted(tuple(r)[:3] for r in substring_dedup.remove_repeated_windows(frame([(1, text), (1, text), (2, text), (None, text)])).select("doc_id", "n_words", "n_removed").fillna(-1).collect())
    assert got == [(-1, 60, 60), (1, 60, 0), (1, 60, 0), (2, 60, 60)]
    got = sorted((r.doc_id or -1, r.n_removed) for r in suffix_dedup.remove_repeated_strings(frame([(1, text), (1, text), (2, text), (None, text)])).collect())
    assert got == [(-1, len(text)), (1, 0), (1, 0), (2, len(text))]


@pytest.mark.parametrize("more", [False, True])
@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, frame, odd, k, more):
    docs = frame(odd, more)
    out = corpus_pipeline.STAGES[k][1](spark, docs, "/root/testdata/sf0.001")
    if k < 4:
        assert out.columns == docs.columns
    else:
        assert out.columns == [*docs.columns, "copy"]
    n = len(out.collect())
    # language: without letters in training every text is und; near-duplicates: the copies and repeated ids go
    assert n <= (3 * len(odd) if k == 4 else len(odd))
    assert corpus_pipeline.STAGES[k][1](spark, frame([], more), "/root/testdata/sf0.001").collect() == []


def test_near_duplicate_stage_keeps_one(spark, frame):
    text = " ".join(f"w{k}" for k in range(60))
    docs = frame([(1, text), (2, text), (2, text), (3, "other words of a clean text"), (3, "other words of a clean text"), (4, None), (None, text), (None, "unlike the others in all its words")])
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or -1) for r in out) == [-1, 1, 3, 4]


def test_clean_texts_stay_whatever_their_ids(spark, frame, bench):
    """Rows without an id, rows of one id and rows of their own: none is dropped for another's sake."""
    rows = [(i, f"clean text {k} " + " ".join(f"{k}w{j}" for j in range(40))) for k, i in enumerate([None] * 10 + [7] * 10 + list(range(100, 110)))]
    assert sorted(r.text for r in corpus_pipeline.drop_near_duplicates(spark, frame(rows), "").collect()) == sorted(t for _, t in rows)
    dirty = [(None, "some words here some words here"), (7, "and some words here some words here too")]
    assert sorted(r.text for r in decontaminate.keep_clean(frame(rows + dirty), bench).collect()) == sorted(t for _, t in rows)
    copies = [(7, rows[0][1]), (None, rows[0][1]), (None, rows[25][1] + " end"), (99, rows[3][1] + " end")]
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, frame(rows + copies), "").collect()]
    want = [r for k, r in enumerate(rows) if k not in (0, 3)] + [copies[0], copies[3]]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_rows_without_an_id_are_cut_each_for_itself(spark, frame):
    """Of two rows without an id, whose texts agree in Spark's 32-bit hash, one repeats a document and the other nothing."""
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(1, words), (None, words + " a35098"), (None, " ".join(f"v{k}" for k in range(60)) + " b167498")]
    assert frame(rows).where("doc_id IS NULL").selectExpr("hash(text) AS h").distinct().count() == 1
    got = substring_dedup.remove_repeated_windows(frame(rows)).collect()
    assert sorted((r.kept_text, r.n_removed) for r in got) == sorted([(rows[0][1], 0), ("a35098", 60), (rows[2][1], 0)])
    got = suffix_dedup.remove_repeated_strings(frame(rows)).collect()
    assert sorted((bytes(r.kept_bytes).decode(), r.n_removed) for r in got) == sorted([(rows[0][1], 0), (" a35098", len(words)), (rows[2][1], 0)])


def test_ids_tie_no_texts_together(spark, frame):
    """Documents that copy different texts of a null or shared id are not each other's duplicates."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    for hub in (None, 7):
        rows = [(hub, a), (hub, b), (hub, c), (5, a + " end"), (9, b + " end"), (11, c)]
        got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(frame(rows)).collect() if r.doc_id != hub}
        assert got == {5: 5, 9: hub or 9, 11: hub or 11}
        kept = sorted(r.text for r in corpus_pipeline.drop_near_duplicates(spark, frame(rows), "").collect())
        assert kept == sorted([a + " end", b if hub else b + " end", c])


def test_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 14)]
    assert queries.oracle_sql().keys() <= queries.queries().keys()
