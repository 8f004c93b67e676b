import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    syllables = ["the", "an", "ti", "on", "er", "re", "shi", "lo", "mu", "ka"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w + (rng.choice(".\n") if rng.random() < 0.1 else "") for w in words)


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): prose, exact and near copies, shared passages, short, empty and null texts, symbols and wide characters."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(5, 160)) for _ in range(40)]
    shared = prose(rng, 80)
    texts += [texts[0], texts[1], texts[0] + " tail", texts[2].replace("\n", " ", 1)]
    texts += [prose(rng, 30) + " " + shared + " " + prose(rng, k) for k in (0, 10, 60)]
    near = texts[3] + " " + prose(rng, 200)
    texts += [near, near.rsplit(" ", 4)[0] + " changed at the end", near + " more"]
    texts += ["word " * 300, "a b c d e f g h " * 40, "", " \n\t ", "é" * 250 + " ü ß " + "é" * 250, "日本語 の テキスト " * 30, "one", "two words"]
    texts += ["!!! ### %%%", "123 456", "long" * 9000, prose(rng, 5000)]
    rows = list(enumerate(texts)) + [(900, None), (901, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def frame(spark):
    """Documents of (doc_id, text) rows; more=True adds columns whose names operators use themselves."""

    def make(rows, more=False):
        df = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, f"s{(i or 0) % 3}" if (i or 0) % 5 else None, len(t or "")) for i, t in rows], SCHEMA)
        if more:
            for name in ("id", "n", "a", "at", "size", "copies", "kept", "class_id", "row", "target", "granary_id", "words", "lines", "Text_2"):
                df = df.selectExpr("*", f"cast(null as string) as `{name}`")
        return df

    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls in any column, empty texts, ties and repeated rows."""
    return [(1, "some words here " * 30), (1, "some words here " * 30), (2, None), (None, "some words here " * 30), (None, None), (3, ""), (4, "x"), (5, "some words here " * 30)]
