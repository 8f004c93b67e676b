"""Substring dedup over word windows, behind a count-min prefilter.

Pass one counts in a merged sketch.  Counting all windows would need a sketch
that grows with every word, so each window is counted through its anchor: the
least-hashed run of ANCHOR words inside it.  Equal windows hold equal anchors,
so the count of an anchor never falls below that of its windows: the estimate
errs upward only and no repeated window is lost.

Pass two groups only windows whose estimate is two or more, by 96 bits of two
independent hashes that no structure of the words makes collide.  Windows that follow each other over one anchor make a
segment, and equal segments are the same windows, so most of the grouping is of
segments.  Where an anchor stands in segments that differ (the edges of a
passage), a second set of bits marks it and its windows are grouped one by one.

Results for odd input: a null text has no words; a null id counts as greater
than any other id and is returned as null; rows that share an id are one
document as far as "smaller id" goes and each has its own result (128 bits of the text tell
them apart); texts under
the window's length lose nothing; an empty table gives no rows.  Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from . import _sketch as S
from ._shared import documents, durable, id_out, keyed

WINDOW = 50
ANCHOR = 16


def _anchored(data: np.ndarray, offsets: np.ndarray, window: int, anchor: int):
    """Word hashes, word documents, starts of windows, and the anchor hash of each."""
    start, end, doc = B.words(data, offsets)
    none = np.empty(0, dtype=np.int64)
    if len(start) < window:
        return none, doc, none, np.empty(0, dtype=np.uint64), none
    hashes = B.word_hashes(data, start, end)
    at = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :])
    grams = B.grams_hash(hashes, anchor)
    place = B.sliding_anchor(grams, window - anchor + 1)[at]
    return hashes, doc, at, grams[place], place


def _windows_hash(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each window: 96 bits of them are kept."""
    return B.grams_hash(hashes, window), B.grams_hash(hashes, window, 1)


def _half(hashes: np.ndarray) -> pa.Array:
    return pa.array((hashes >> np.uint64(32)).astype(np.uint32).view(np.int32))


def _anchor_keys(window: int, anchor: int):
    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in B.slices(batch):
            *_, grams, place = _anchored(data, offsets, window, anchor)
            if len(place):
                yield grams[np.r_[True, place[1:] != place[:-1]]]

    return keys_of


def _starts(doc: np.ndarray, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the segments, the windows over one anchor that follow each other: first window, document, and number in the document."""
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (np.diff(at) != 1)])
    of = doc[at[first]]
    return first, of, np.arange(len(of)) - np.searchsorted(of, of)


def _places(sketch, window: int, anchor: int):
    """(a, id, t, u, k): anchors whose count is estimated at two or more, and the segments they stand in."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = B.ids(batch), S.tags(batch)
            for a, _, data, offsets in B.slices(batch):
                _, doc, at, grams, place = _anchored(data, offsets, window, anchor)
                if not len(at):
                    continue
                first, of, k = _starts(doc, at, place)
                keep = sketch.value(grams[first])
                of = of[keep]
                yield pa.RecordBatch.from_arrays([B.longs(grams[first[keep]]), pa.array(ids[a + of]), *S.tag_columns(tags[a + of]), pa.array(k[keep].astype(np.int32))], ["a", "id", "t", "u", "k"])

    return task


def _segments(sketch, window: int, anchor: int):
    """(a, s1, s2, id, t, u, at, n) of each segment of n windows over one anchor that passes the sketch, or that the rows name."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = B.ids(batch), S.tags(batch)
            for a, b, data, offsets in B.slices(batch):
                hashes, doc, at, grams, place = _anchored(data, offsets, window, anchor)
                if not len(at):
                    continue
                first, of, k = _starts(doc, at, place)
                last = np.r_[first[1:], len(at)] - 1
                keep = sketch.value(grams[first]) if sketch else S.usable(batch, a, b, of, k)
                first, last, of = first[keep], last[keep], of[keep]
                if not len(first):
                    continue
                # A segment has fewer than two windows' words: its first and last window hold them all.
                start = at[first]
                n = (last - first + 1).astype(np.uint64)
                s1, s2 = (B.joined(w[at[first]], w[at[last]] + n, seed) for seed, w in enumerate(_windows_hash(hashes, window)))
                yield pa.RecordBatch.from_arrays(
                    [B.longs(grams[first]), B.longs(s1), _half(s2), pa.array(ids[a + of]), *S.tag_columns(tags[a + of]), pa.array((start - np.searchsorted(doc, of)).astype(np.int32)), pa.array((last - first + 1).astype(np.int32))],
                    ["a", "s1", "s2", "id", "t", "u", "at", "n"],
                )

    return task


def _windows(marked, window: int, anchor: int):
    """(h1, h2, id, t, u, at) of every window over a marked anchor, or in a segment that the rows name."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = B.ids(batch), S.tags(batch)
            for a, b, data, offsets in B.slices(batch):
                hashes, doc, at, grams, place = _anchored(data, offsets, window, anchor)
                if not len(at):
                    continue
                if marked:
                    keep = marked.value(grams)
                else:
                    first, of, k = _starts(doc, at, place)
                    keep = np.repeat(S.usable(batch, a, b, of, k), np.diff(np.r_[first, len(at)]))
                at = at[keep]
                if not len(at):
                    continue
                of = doc[at]
                h1, h2 = (w[at] for w in _windows_hash(hashes, window))
                yield pa.RecordBatch.from_arrays(
                    [B.longs(h1), _half(h2), pa.array(ids[a + of]), *S.tag_columns(tags[a + of]), pa.array((at - np.searchsorted(doc, of)).astype(np.int32))],
                    ["h1", "h2", "id", "t", "u", "at"],
                )

    return task


def _later(rows: DataFrame, one: str, two: list[str]) -> DataFrame:
    """The rows whose key (one, *two) also occurs with a smaller id.

    The least ids are summed by the whole key before the shuffle: a passage in a third of all documents is one row per
    task there.  They are joined back by a part of the key, so that both sides are dealt by the join itself and AQE may
    split a frequent key's rows among tasks.
    """
    first = rows.groupBy(one, *two).agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    first = first.select(F.col(one).alias("f_one"), *[F.col(c).alias(f"f_{c}") for c in two], "least")
    same = (F.col(one) == F.col("f_one")) & (F.col("id") > F.col("least"))
    for c in two:  # as a condition, not as a key that deals the rows
        same &= ~(F.col(c) < F.col(f"f_{c}")) & ~(F.col(c) > F.col(f"f_{c}"))
    return rows.join(first, same)


def _cut(window: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, sha, kept, spans = [], [], [], [], []
            for text, at in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2), strict=True):
                words = (text or b"").split()
                n_words.append(len(words))
                runs: list[dict] = []
                if at.is_valid:
                    edge = np.zeros(len(words) + 1, dtype=np.int32)
                    start, n = at.values.field(0).to_numpy(), at.values.field(1).to_numpy()
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n + (window - 1), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    step = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                    runs = [{"start": int(x), "end": int(y)} for x, y in step.reshape(-1, 2)]
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                n_removed.append(n_words[-1] - len(words))
                joined = b" ".join(words)
                sha.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode())
                spans.append(runs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["id", "n_words", "n_removed", "kept_sha256", "kept_text", "removed"],
            )

    return task


def remove_repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Drop each word covered by a window of `window` words that also starts in a document with a smaller id.

    Returns id_col, n_words, n_removed, kept_sha256, kept_text, removed (spans of word positions).
    """
    spark = df.sparkSession
    docs = keyed(df, id_col, text_col)
    expected = S.text_bytes(docs, "text") / 6 / ((window - anchor + 2) / 2)
    share = spark.sparkContext.broadcast
    seen = share(S.repeated(docs, _anchor_keys(window, anchor), expected))
    tagged = S.tagged(docs)
    named = worth = tagged
    if S.crowded(expected):
        places = durable(tagged.mapInArrow(B.lean(_places(seen, window, anchor)), "a long, id long, t long, u long, k int"))
        named, seen = S.with_places(tagged, places, places.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")), None
    segments = named.mapInArrow(B.lean(_segments(seen, window, anchor)), "a long, s1 long, s2 int, id long, t long, u long, at int, n int")
    differ = segments.groupBy("a").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi"), F.min("s2").alias("lo2"), F.max("s2").alias("hi2")).where("lo < hi or lo2 < hi2")
    if seen:
        marked = share(S.members(differ, "a", expected / 4))
    else:
        worth, marked = S.with_places(tagged, places, differ.select("a")), None
    rows = worth.mapInArrow(B.lean(_windows(marked, window, anchor)), "h1 long, h2 int, id long, t long, u long, at int")
    later = _later(segments, "s1", ["s2"]).select("id", "t", "u", "at", "n").unionByName(_later(rows, "h1", ["h2"]).select("id", "t", "u", "at", F.lit(1).alias("n")))
    again = later.groupBy("id", "t", "u").agg(F.collect_set(F.struct("at", "n")).alias("at"))
    joined = tagged.alias("d").join(again.alias("a"), F.expr("d.id = a.id and d.t = a.t and d.u = a.u"), "left").select("d.id", "d.text", "a.at")
    out = joined.mapInArrow(B.lean(_cut(window)), "id long, n_words long, n_removed long, kept_sha256 string, kept_text string, removed array<struct<start:int,end:int>>")
    return out.select(id_out(id_col), "n_words", "n_removed", "kept_sha256", "kept_text", "removed")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(documents(spark, sf_dir)).drop("kept_text", "removed")


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT r, doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, greatest(len(words) - 48, 1))) AS i FROM w)
), first AS (
  SELECT h, min(doc_id) AS least FROM win GROUP BY h
), gone AS (
  SELECT DISTINCT r, i + k AS p FROM win JOIN first USING (h), (SELECT unnest(range(0, 50)) AS k) WHERE least < doc_id
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS s, count(*) AS n FROM (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w) ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)
"""
