"""Runs against every period tried, pieces against the library, the middle against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from granary.llm import fill_in_middle, period_runs, piece_encoding

FOLDER = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def brute_runs(words, repeats=4, shortest=6):
    """(start, length, period) of each run, every period tried."""
    number = {}
    s = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    out = []
    for q in range(1, len(s) // repeats + 1):
        edges = np.flatnonzero(np.diff(np.r_[False, s[:-q] == s[q:], False].view(np.int8)))
        for x, y in edges.reshape(-1, 2).tolist():
            part = s[x : y + q]
            if len(part) >= max(shortest, repeats * q) and not any((part[:-p] == part[p:]).all() for p in range(1, q)):
                out.append((x, len(part), q))
    return sorted(out)


def test_runs_of_short_sequences():
    rng = random.Random(5)
    for _ in range(600):
        s = [rng.randrange(rng.choice([1, 2, 2, 3])) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5 and len(s) > 4:
            a, p = rng.randrange(len(s)), rng.randint(1, 7)
            s = s[:a] + [s[a + k % min(p, len(s) - a)] for k in range(len(s) - a)]
        for repeats, shortest in ((4, 6), (2, 2), (2, 6), (3, 4)):
            assert period_runs.runs_of(s, repeats, shortest) == brute_runs(s, repeats, shortest)


def test_runs_inside_other_words(frame):
    rng = random.Random(6)
    rows = []
    for k in range(120):
        words = [f"w{rng.randrange(6)}" for _ in range(rng.randint(0, 90))]
        period = [f"p{rng.randrange(3)}" for _ in range(rng.randint(1, 9))]
        at = rng.randint(0, len(words))
        words[at:at] = period * rng.randint(3, 6) + period[:2]
        rows.append((k, rng.choice([" ", "\n", " \t"]).join(words)))
    for repeats, shortest in ((4, 6), (2, 3)):
        got = period_runs.period_runs(frame(rows), repeats=repeats, shortest=shortest).collect()
        for r in got:
            words = rows[r.doc_id][1].split()
            want = brute_runs(words, repeats, shortest)
            assert [tuple(x) for x in r.runs] == want
            gone = {k for s, n, q in want for k in range(s + q, s + n)}
            assert (r.words, r.collapsed) == (len(words), " ".join(w for k, w in enumerate(words) if k not in gone))


def test_op11_on_the_small_corpus(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in period_runs.op11_period_runs(spark, FOLDER).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(words)
        top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        want = (len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))
        assert got[i] == want, i


def test_long_periodic_texts(frame):
    rows = [(1, "a " * 100_000), (2, " ".join(f"w{k % 777}" for k in range(60_000))), (None, "x y " * 30)]
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in period_runs.period_runs(frame(rows)).collect()}
    assert got == {1: [(0, 100_000, 1)], 2: [(0, 60_000, 777)], None: [(0, 60, 2)]}


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def mixtures(library):
    rng = random.Random(3)
    some = ["▁", " ", "  ", "th", "e", "in", "tion", "\n", "é", "日", "本", "1", "12", "<", "/", "0x", "s", ".", "com", "ﬁ", "😀", "\t", "--", "=="]
    pieces = [library.id_to_piece(k) for k in range(259, 32000)]
    wide = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x500), rng.randrange(0x3000, 0xD7FF), rng.randrange(0x10000, 0x1F900)]))
    texts = ["", " ", "  a   b ", "▁▁ ▁a▁", "a\0b", "日本語のテキスト " * 50, "\n\n\t x", " " * 1001 + "x" + " " * 17, "<s>x</s><0x0A><unk>", "long" * 9000, "�é"]
    texts += ["".join(rng.choice(some) for _ in range(rng.randint(1, 60))) for _ in range(700)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(700)]
    return texts + ["".join(wide() for _ in range(rng.randint(1, 40))) for _ in range(400)]


def test_encoding_and_decoding_as_the_library_does(frame, library):
    texts = mixtures(library)
    rows = [*enumerate(texts), (None, "no id"), (10**6, None)]
    ids = piece_encoding.encode(frame(rows))
    want = {i: library.encode(t or "", add_bos=True, add_eos=True) for i, t in rows}
    assert {r.doc_id: r.ids for r in ids.collect()} == want
    assert {r.doc_id: r.text for r in piece_encoding.decode(ids).collect()} == {i: library.decode(x) for i, x in want.items()}


def test_decoding_of_any_ids(spark, library):
    rng = random.Random(4)
    rows = [(k, [rng.choice([rng.randrange(32000), rng.randrange(300)]) for _ in range(rng.randint(0, 12))]) for k in range(300)] + [(300, None), (301, [])]
    for part in (rows, [(k, [i for i in x or [] if i > 258]) for k, x in rows]):
        got = piece_encoding.decode(spark.createDataFrame(part, "doc_id long, ids array<int>")).collect()
        assert {r.doc_id: r.text for r in got} == {k: library.decode(x or []) for k, x in part}


def test_worker_starts_anew_beyond_what_it_keeps(library, monkeypatch):
    monkeypatch.setattr(piece_encoding, "KEPT_STRETCHES", 20)
    monkeypatch.setattr(piece_encoding, "KEPT_PAIRS", 20)
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        known = piece_encoding.MergeTable(f.read())
    texts = mixtures(library)[:300]
    raw = [t.encode() for t in texts]
    ids, at = known.encode(np.frombuffer(b"".join(raw), dtype=np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == library.encode(texts, add_bos=True, add_eos=True)
    assert len(known.pairs) <= 20 and len(known.stretches) <= 20


def test_what_is_no_model_is_refused():
    with pytest.raises(RuntimeError):
        piece_encoding.MergeTable(b"no model")


def test_op12_on_the_small_corpus(spark, library):
    want = {}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want[r.doc_id] = (len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(library.decode(ids)))
    assert {r.doc_id: tuple(r)[1:] for r in piece_encoding.op12_piece_encoding(spark, FOLDER).collect()} == want


def brute_middle(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(tokens), "plain", None, None, text
    first = h4 % 100 < 20
    return len(tokens), "spm" if first else "psm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}" if first else f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_middle_and_back(frame, corpus):
    rows = [*corpus, (None, "text without an id, and more"), (-5, "a\0b\r\n c"), (1001, "has <P> in it"), (1002, "<M>"), (1003, "<P <S >M> <p>"), (1004, "S>x<"), (1005, "\U0001f600" * 40)]
    out = fill_in_middle.transform(frame(rows))
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    assert got == {i: brute_middle(i, t) for i, t in rows}
    assert {"plain", "spm", "psm"} == {x[1] for x in got.values()}
    assert {r.doc_id: r.restored for r in fill_in_middle.restore(out).collect()} == {i: t or "" for i, t in rows}


def test_op13_on_the_small_corpus(spark):
    want = {}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect():
        n, form, p, m, output = brute_middle(r.doc_id, r.text)
        want[r.doc_id] = (n, form, p, m, sha(output), sha(r.text or ""))
    assert {r.doc_id: tuple(r)[1:] for r in fill_in_middle.op13_fill_in_middle(spark, FOLDER).collect()} == want
