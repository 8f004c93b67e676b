"""Toxicity by a chain of linear classifiers.

The categories are predicted one after another: each model reads the words of a
text (present or not) and the probabilities of the categories before it.  In
training those probabilities are out of fold, so a later model learns from
predictions as good as it will get, not from fitted ones.  All models are
logistic regressions with an L2 penalty.

Training reads at most SAMPLE labelled documents (least hashes of the id and
the labels), whole texts; their distinct words come to the driver.  The words a
model reads (and the first bytes of longer words) are the WORDS that differ
most between the classes.

Results for odd input: a label row with a null label or id is not learnt from; a
null or empty text has no words and gets the models' base probability; with no
labels, or labels all alike, the probability is the share seen (0 without any);
an empty table gives no rows; rows that share an id are scored each for itself
(the least of their texts is learnt from).  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from ._shared import documents, id_out, keyed, named

SAMPLE = 12_000
WORDS = 2048
#: Words whose shares in the classes differ by fewer standard errors are not read.
MIN_GAIN = 3.0
#: Longer words are also read by so many first bytes, which inflected forms share.
PREFIX = 6
FOLDS = 4
STEPS = 200
PENALTY = 0.3
THRESHOLD = 0.5


def _distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each word and of each longer word's first PREFIX bytes, once per document, in order."""
    data = B.LOWER[data] if len(data) else data
    start, end, doc = B.words(data, offsets, B.ALNUM)
    if not len(start):
        return doc, np.empty(0, np.uint64)
    long = np.flatnonzero(end - start > PREFIX)
    hashes = np.r_[B.word_hashes(data, start, end), B.word_hashes(data, start[long], start[long] + PREFIX, 1)]
    doc = np.r_[doc, doc[long]]
    by = np.lexsort((hashes, doc))
    doc, hashes = doc[by], hashes[by]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])] if len(doc) else np.empty(0, dtype=bool)
    return doc[new], hashes[new]


def _training_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in B.slices(batch, text=2):
            doc, hashes = _distinct_words(data, offsets)
            edge = np.searchsorted(doc, np.arange(b - a + 1))
            words = pa.array([hashes[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], words], ["draw", "y", "words"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit(n: int, row: np.ndarray, column: np.ndarray, width: int, dense: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of present words, of dense features, and the bias, by full-batch Adam on the penalised log loss."""
    share = min(max(y.mean(), 1e-4), 1 - 1e-4) if n else 1e-4
    w, v, b = np.zeros(width), np.zeros(dense.shape[1]), float(np.log(share / (1 - share)))
    if not n or y.min() == y.max():
        return w, v, b if n and y.max() else -30.0
    theta = np.r_[w, v, b]
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, v, b = theta[:width], theta[width:-1], theta[-1]
        off = _sigmoid(np.bincount(row, w[column], minlength=n) + dense @ v + b) - y
        grad = np.r_[np.bincount(column, off[row], minlength=width) + PENALTY * w, dense.T @ off + PENALTY * v, off.sum()] / n
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        theta = theta - 0.1 * (1 - step / (STEPS + 1)) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return theta[:width], theta[width:-1], float(theta[-1])


def _predict(n: int, row: np.ndarray, column: np.ndarray, dense: np.ndarray, model) -> np.ndarray:
    w, v, b = model
    return _sigmoid(np.bincount(row, w[column], minlength=n) + dense @ v + b)


def chain(words: list[np.ndarray], labels: np.ndarray, most_words: int = WORDS) -> tuple[np.ndarray, list]:
    """The vocabulary (hashes in order) and a model per category; labels: (documents, categories) of 0 and 1."""
    n, c = labels.shape
    size = np.array([len(x) for x in words], dtype=np.int64)
    every, code = np.unique(np.concatenate(words) if words else np.empty(0, np.uint64), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    gain = np.zeros(len(every))
    have = np.bincount(code, minlength=len(every))
    for k in range(c):
        ones = max(1, labels[:, k].sum())
        p = (np.bincount(code, labels[row, k], minlength=len(every)) + 0.5) / (ones + 1)
        q = (have - np.bincount(code, labels[row, k], minlength=len(every)) + 0.5) / (max(1, n - ones) + 1)
        spread = np.sqrt(p * (1 - np.minimum(p, 1 - 1e-9)) / ones + q * (1 - np.minimum(q, 1 - 1e-9)) / max(1, n - ones))
        gain = np.maximum(gain, np.abs(p - q) / np.maximum(spread, 1e-9))
    gain[(have < 3) | (gain < MIN_GAIN)] = 0
    chosen = np.sort(np.argsort(-gain, kind="stable")[: min(most_words, int((gain > 0).sum()))])
    to = np.full(len(every), -1)
    to[chosen] = np.arange(len(chosen))
    use = to[code] >= 0
    row, column = row[use], to[code[use]]
    fold = np.arange(n) % FOLDS
    dense = np.zeros((n, 0))
    models = []
    for k in range(c):
        y = labels[:, k].astype(np.float64)
        models.append(fit(n, row, column, len(chosen), dense, y))
        if k + 1 < c:
            out = np.zeros(n)
            for f in range(FOLDS):
                held = fold == f
                index = np.cumsum(~held) - 1
                a, b = ~held[row], held[row]
                model = fit(int((~held).sum()), index[row[a]], column[a], len(chosen), dense[~held], y[~held])
                there = np.cumsum(held) - 1
                out[held] = _predict(int(held.sum()), there[row[b]], column[b], dense[held], model)
            dense = np.hstack([dense, out[:, None]])
    return every[chosen], models


def train(df: DataFrame, labels: DataFrame, categories: Sequence, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE):
    """labels: id_col and what `categories` (columns of 0 and 1, in the order of the chain) are made from."""
    y = F.array(*[c.cast("int") for c in categories])
    known = labels.select(named(id_col).cast("long").alias("of"), y.alias("y")).where("of IS NOT NULL").where(~F.exists("y", lambda v: v.isNull())).distinct()
    known = known.join(keyed(df, id_col, text_col).select("id"), F.col("of") == F.col("id"), "left_semi")  # labels of other ids teach nothing
    drawn = known.withColumn("draw", F.xxhash64("of", "y")).orderBy("draw", "of").limit(sample)
    # At most `sample` rows: small enough to broadcast whatever the tables hold.
    rows = keyed(df, id_col, text_col).join(F.broadcast(drawn), F.col("id") == F.col("of"))
    # One text per label row, however many rows share its id.
    rows = rows.groupBy("draw", "of", "y").agg(F.min("text").alias("text")).select("draw", "y", "text").mapInArrow(_training_words, "draw long, y array<int>, words binary")
    rows = sorted(rows.collect(), key=lambda r: (r["draw"], r["words"]))
    return chain([np.frombuffer(r["words"], dtype=np.uint64) for r in rows], np.array([r["y"] for r in rows], dtype=np.int64).reshape(len(rows), len(categories)))


def _score(model, names: Sequence[str]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, models = model.value
        for batch in batches:
            n = batch.num_rows
            rows, columns = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for a, _, data, offsets in B.slices(batch):
                doc, hashes = _distinct_words(data, offsets)
                if len(vocabulary):
                    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                    use = vocabulary[at] == hashes
                    rows.append(doc[use] + a)
                    columns.append(at[use])
            row, column = np.concatenate(rows), np.concatenate(columns)
            dense = np.zeros((n, 0))
            for one in models:
                dense = np.hstack([dense, _predict(n, row, column, dense, one)[:, None]])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(dense[:, k]) for k in range(len(names)))], ["id", *(f"p{k}" for k in range(len(names)))])

    return task


def classify(df: DataFrame, model, names: Sequence[str], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Returns id_col, a probability p_<name> per category, and the last category's verdict under its name."""
    task = _score(df.sparkSession.sparkContext.broadcast(model), names)
    out = keyed(df, id_col, text_col).mapInArrow(task, "id long, " + ", ".join(f"p{k} double" for k in range(len(names))))
    last = len(names) - 1
    return out.select(id_out(id_col), *[F.col(f"p{k}").alias(f"p_{name}") for k, name in enumerate(names)], (F.col(f"p{last}") >= threshold).alias(names[last]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, documents(spark, sf_dir, "labels"), [1 - F.col("quality"), F.col("toxic")])
    return classify(docs, model, ["low_quality", "toxic"])
