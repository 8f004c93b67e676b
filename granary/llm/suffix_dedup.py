"""Byte-string dedup by per-shard suffix arrays.

Two equal strings of LENGTH bytes have the same least-hashed run of ANCHOR
bytes at the same place, so strings are dealt to shards by that anchor:
consecutive strings over one anchor travel as one segment of bytes, and only
anchors that a merged count-min sketch estimates to occur twice travel at all (beyond what
a sketch tells apart, anchors that a count of keys and places finds twice).

Segments are ordered by (anchor, content, document) over range partitions and
cut into shards of SHARD_BYTES, so a frequent anchor spreads over many shards.
In a shard, equal segments collapse to the first; the rest form one text, whose
suffix array (Larsson-Sadakane refinement in numpy) and common prefixes (Kasai)
bring equal strings together; all but the earliest are marked.  An anchor that
touches a shard's edge may go on in another shard: its earliest strings are
merged across shards, ordered by digest, equal runs found by binary search.  A
string comes there once per shard at most, however often it occurs.

Results for odd input: a null or empty text has no bytes and no spans; texts
under LENGTH bytes lose nothing; a null id counts as greater than any other and
is returned as null; rows that share id and text are one document, those that
share only the id are ordered by a hash of the text; an empty table gives no
rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from . import _sketch as S
from ._shared import documents, durable, id_out, keyed

LENGTH = 100
ANCHOR = 32
SHARD_BYTES = 1 << 20
SHARD_ROWS = 4096
SLICE = 1 << 18
GAP = 0xFF  # in no UTF-8 text


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a byte array in order, and the rank of each, by doubling the depth of groups not yet sorted."""
    n = len(text)
    padded = np.r_[text.astype(np.int64) + 1, np.zeros(7, dtype=np.int64)]  # 0 is the end
    key = np.zeros(n, dtype=np.int64)
    for k in range(7):
        key = key * 257 + padded[k : k + n]
    order = np.argsort(key, kind="stable")
    key = key[order]
    places = np.arange(n)
    group = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], places, 0))  # where the group of each place starts
    rank = np.empty(n, dtype=np.int64)
    rank[order] = group
    depth = 7
    while True:
        first = np.r_[group[1:] != places[1:], False]  # the next place is in the same group
        tied = np.flatnonzero(first | (group != places))
        if not len(tied):
            return order, rank
        at = order[tied]
        after = at + depth
        key = group[tied] * (n + 2) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[tied], key = at[by], key[by]
        group[tied] = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], tied, 0))
        rank[order[tied]] = group[tied]
        depth *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray, start: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """For the `count` suffixes from each `start`: bytes in common with the suffix before, up to `most`; 0 for others.

    Kasai's rule, with all segments stepping side by side: one byte on, at most one byte less is in common.
    """
    out = np.zeros(len(order), dtype=np.int64)
    padded = np.r_[text, np.zeros(most + 1, dtype=np.uint8)]
    lanes = np.argsort(-count, kind="stable")
    start, count = start[lanes], count[lanes]
    have = np.zeros(len(start), dtype=np.int64)
    for j in range(int(count.max(initial=0))):
        m = int(np.searchsorted(-count, -j, side="left"))
        i = start[:m] + j
        r = rank[i]
        before = order[np.maximum(r - 1, 0)]
        have = np.maximum(have[:m] - 1, 0)
        have[r == 0] = 0
        going = np.flatnonzero((r > 0) & (have < most))
        while len(going):
            same = padded[i[going] + have[going]] == padded[before[going] + have[going]]
            going = going[same]
            have[going] += 1
            going = going[have[going] < most]
        out[r] = have
    return out


def _anchored(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
    """Starts of strings, the place of each one's anchor, and the hashes of anchors and of strings by place."""
    none = np.empty(0, dtype=np.int64)
    if len(data) < length:
        return none, none, np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    at = np.flatnonzero(np.arange(length, len(data) + length) <= ends)
    grams, whole = B.grams_hashes(B.byte_values(data), (anchor, length))
    return at, B.sliding_anchor(grams, length - anchor + 1)[at], grams, whole


def _anchor_keys(length: int, anchor: int):
    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in B.slices(batch, most=SLICE):
            at, place, grams, _ = _anchored(data, offsets, length, anchor)
            if len(at):
                yield grams[place[np.r_[True, place[1:] != place[:-1]]]]

    return keys_of


def _starts(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the segments, the strings over one anchor that follow each other: first string, document, and number in the document."""
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (np.diff(at) != 1)])
    of = np.searchsorted(offsets, at[first], side="right") - 1
    return first, of, np.arange(len(of)) - np.searchsorted(of, of)


def _places(sketch, length: int, anchor: int):
    """(a, id, t, u, k): anchors whose count is estimated at two or more, and the segments they stand in."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = B.ids(batch), S.tags(batch)
            for a, _, data, offsets in B.slices(batch, most=SLICE):
                at, place, grams, _ = _anchored(data, offsets, length, anchor)
                if not len(at):
                    continue
                first, of, k = _starts(data, offsets, at, place)
                key = grams[place[first]]
                keep = sketch.value(key)
                of = of[keep]
                yield pa.RecordBatch.from_arrays([B.longs(key[keep]), pa.array(ids[a + of]), *S.tag_columns(tags[a + of]), pa.array(k[keep].astype(np.int32))], ["a", "id", "t", "u", "k"])

    return task


_SEGMENT = "a long, s long, id long, t long, u long, at long, n int, seg binary"


def _segments(sketch, length: int, anchor: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = B.ids(batch), S.tags(batch)
            for a, b, data, offsets in B.slices(batch, most=SLICE):
                at, place, grams, whole = _anchored(data, offsets, length, anchor)
                if not len(at):
                    continue
                first, of, k = _starts(data, offsets, at, place)
                last = np.r_[first[1:], len(at)] - 1
                key = grams[place[first]]
                keep = sketch.value(key) if sketch else S.usable(batch, a, b, of, k)
                first, last, key, of = first[keep], last[keep], key[keep], of[keep]
                if not len(first):
                    continue
                start, end = at[first], at[last] + length
                # A segment is shorter than two strings: its first and last string hold all its bytes.
                n = (last - first + 1).astype(np.uint64)
                s = B.joined(whole[at[first]], whole[at[last]] + n)
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [B.longs(key), B.longs(s), pa.array(ids[a + of]), *S.tag_columns(tags[a + of]), pa.array(start - offsets[of]), pa.array((last - first + 1).astype(np.int32)), pa.array([raw[x:y] for x, y in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())],
                    ["a", "s", "id", "t", "u", "at", "n", "seg"],
                )

    return task


_MARKS = "open boolean, h1 long, h2 long, id long, t long, u long, at long, n int"


def _marks(h: tuple[np.ndarray, np.ndarray] | None, id: np.ndarray, t: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Strings to remove, n from `at` on; or, with digests, earliest strings that other shards may hold too."""
    none = pa.nulls(len(id), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(id), h is not None)), *([B.longs(h[0]), B.longs(h[1])] if h else [none, none]), pa.array(id), *S.tag_columns(t), pa.array(at), pa.array(n.astype(np.int32))],
        ["open", "h1", "h2", "id", "t", "u", "at", "n"],
    )


def shard_marks(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """The marks of one shard, whose segments are in order of (a, s, id, t, u, at).

    Equal anchors and equal hashes of the whole segments, 128 bits, are equal segments.
    """
    a, s, id, t, u, at, n = (table.column(k).to_numpy() for k in range(7))
    t = S.packed_tags(t, u)
    raw, offsets = B.text_buffers(table.column(7).combine_chunks())
    new = np.r_[True, (a[1:] != a[:-1]) | (s[1:] != s[:-1])]
    first = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    later = (id != id[first]) | (t != t[first]) | (at != at[first])  # not the first itself, as repeated rows are
    if later.any():
        yield _marks(None, id[later], t[later], at[later], n[later])
    one = np.flatnonzero(new)
    a, id, t, at, n, begin = a[one], id[one], t[one], at[one], n[one].astype(np.int64), offsets[:-1][one]
    edge = (a == a[0]) | (a == a[-1])
    run = np.cumsum(np.r_[True, a[1:] != a[:-1]]) - 1
    need = edge | (np.bincount(run)[run] > 1)
    a, id, t, at, n, begin, edge = (x[need] for x in (a, id, t, at, n, begin, edge))
    size = n + length  # the segment and the gap after it
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(len(size)), size)
    inner = np.arange(int(size.sum())) - start[of]
    text = raw[np.minimum(begin[of] + inner, len(raw) - 1)]
    text[start + size - 1] = GAP
    whole = inner < n[of]  # a string of `length` bytes starts here
    order, rank = suffix_array(text)
    shared = common_prefixes(text, order, rank, start, n, length)
    group = np.cumsum(shared < length)
    place = np.flatnonzero(whole[order])
    group, here = group[place], order[place]
    _, doc = np.unique(np.stack([id, t["t"], t["u"]]), axis=1, return_inverse=True)
    by = np.lexsort((at[of[here]] + inner[here], doc.reshape(-1)[of[here]], group))
    group, here = group[by], here[by]
    later = np.r_[False, group[1:] == group[:-1]]
    gone = np.zeros(len(text), dtype=bool)
    gone[here[later]] = True
    step = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).reshape(-1, 2)
    if len(step):
        k = of[step[:, 0]]
        yield _marks(None, id[k], t[k], at[k] + inner[step[:, 0]], step[:, 1] - step[:, 0])
    first = np.flatnonzero(whole & ~gone & edge[of])
    if len(first):
        k = of[first]
        digests = [[], []]
        for x in range(0, len(first), SHARD_ROWS):
            rows = B.byte_values(text[first[x : x + SHARD_ROWS, None] + np.arange(length)])
            for seed in (0, 1):
                digests[seed].append(B.rows_hash(rows, seed))
        yield _marks((np.concatenate(digests[0]), np.concatenate(digests[1])), id[k], t[k], at[k] + inner[first], np.ones(len(first)))


def _shards(length: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            a = 0
            while a < batch.num_rows:
                part = batch.slice(a, SHARD_ROWS)
                a += part.num_rows
                held.append(part)
                size += int(pc.sum(pc.binary_length(part.column(7))).as_py())
                if size >= SHARD_BYTES:
                    yield from shard_marks(pa.Table.from_batches(held), length)
                    held, size = [], 0
        if held:
            yield from shard_marks(pa.Table.from_batches(held), length)

    return task


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by (h1, h2, id, t, u, at): of each equal run, found by binary search, all but the first string go."""
    last = None  # of the run that may go on: its digest and its first string
    for batch in batches:
        h1, h2, id, t, u, at = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
        t = S.packed_tags(t, u)
        if not len(h1):
            continue
        digest = h1.astype(object) * 2**64 + h2 if (h1[1:] == h1[:-1]).any() and (h2[1:][h1[1:] == h1[:-1]] != h2[:-1][h1[1:] == h1[:-1]]).any() else h1
        first = np.searchsorted(digest, digest, side="left")
        id1, t1, at1 = id[first], t[first], at[first]
        if last and last[0] == (h1[0], h2[0]):
            id1[first == 0], t1[first == 0], at1[first == 0] = last[1]
        later = (id != id1) | (t != t1) | (at != at1)
        last = (h1[-1], h2[-1]), (id1[-1], t1[-1], at1[-1])
        yield pa.RecordBatch.from_arrays([pa.array(id[later]), *S.tag_columns(t[later]), pa.array(at[later]), pa.array(np.ones(int(later.sum()), dtype=np.int32))], ["id", "t", "u", "at", "n"])


def _cut(length: int):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, sha, kept, spans = [], [], [], []
            for text, marks in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2), strict=True):
                text = text or b""
                size.append(len(text))
                runs: list[tuple[int, int]] = []
                if marks.is_valid:
                    edge = np.zeros(len(text) + 1, dtype=np.int32)
                    at, n = marks.values.field(0).to_numpy(), marks.values.field(1).to_numpy()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + n + (length - 1), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    runs = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).reshape(-1, 2).tolist()
                    text = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
                sha.append(hashlib.sha256(text).hexdigest())
                kept.append(text)
                spans.append([{"start": x, "end": y} for x, y in runs])
            n_removed = [n - len(k) for n, k in zip(size, kept, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()), pa.array(spans, span)],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes", "removed"],
            )

    return task


def remove_repeated_strings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Drop each byte covered by a string of `length` bytes that also starts earlier (smaller id, or same id and start).

    Returns id_col, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes and removed (spans of bytes).
    """
    spark = df.sparkSession
    docs = keyed(df, id_col, text_col)
    expected = S.text_bytes(docs, "text") / ((length - anchor + 2) / 2)
    seen = spark.sparkContext.broadcast(S.repeated(docs, _anchor_keys(length, anchor), expected))
    tagged = S.tagged(docs)
    named = tagged
    if S.crowded(expected):
        places = durable(tagged.mapInArrow(B.lean(_places(seen, length, anchor)), "a long, id long, t long, u long, k int"))
        named, seen = S.with_places(tagged, places, places.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")), None
    segments = named.mapInArrow(B.lean(_segments(seen, length, anchor)), _SEGMENT)
    in_order = segments.repartitionByRange("a", "s", "id", "t", "u", "at").sortWithinPartitions("a", "s", "id", "t", "u", "at")
    marks = durable(in_order.mapInArrow(B.lean(_shards(length)), _MARKS))
    edges = marks.where("open").select("h1", "h2", "id", "t", "u", "at")
    merged = edges.repartitionByRange("h1").sortWithinPartitions("h1", "h2", "id", "t", "u", "at").mapInArrow(_merge, "id long, t long, u long, at long, n int")
    later = marks.where("not open").select("id", "t", "u", "at", "n").unionByName(merged)
    again = later.groupBy("id", "t", "u").agg(F.collect_set(F.struct("at", "n")).alias("marks"))  # repeated rows mark the same
    joined = tagged.alias("d").join(again.alias("a"), F.expr("d.id = a.id and d.t = a.t and d.u = a.u"), "left").select("d.id", "d.text", "a.marks")
    out = joined.mapInArrow(B.lean(_cut(length)), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary, removed array<struct<start:long,end:long>>")
    return out.select(id_out(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes", "removed")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_strings(documents(spark, sf_dir)).drop("kept_bytes", "removed")
