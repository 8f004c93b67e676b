"""Near-duplicates by DartMinHash.

A document is a bag of 5-word shingles, weighted by how often they occur.
Darts are thrown at the plane (weight, rank) of each shingle: weight is cut at
1, 3, 7, ... and rank into rows as high as the strip of weight is wide the other
way, so every region has area one and a Poisson(1) number of darts, fixed by a
hash of shingle and region.  A document keeps the darts below its weights and
below the rank that leaves about K ln K + 2K of them, sends each to one of K
coordinates and keeps the earliest of each.  Two documents agree in a coordinate
with the probability of their weighted Jaccard similarity.

Documents of the same words become one before anything is joined.  Bands of
ROWS coordinates make buckets.  In a bucket of up to SMALL members all are held
against each other; in a larger one every member is held against one that a
hash of the band picks (the pivot), so a bucket of any size gives a few pairs
per member and each band picks another pivot.  Members that are not surely
similar to their pivot go on to the next round, in smaller buckets: their band's
key grows by some coordinates, more each round (two choices of them in the
second), which parts documents that only resemble each other and keeps most that
are similar together in one of the bands they share.  Rounds end when no large
bucket is left; once the members to go on with are few (LOCAL_ROWS, counted) one
task runs the rounds that remain in numpy, on signatures alone.  The rounds find
most links; a last pass compares by exact bags all pairs of each large bucket
whose members are not of one class by then, so no pair that shares a bucket is
left out.  A pair is sure when the signatures agree far from the threshold; the
others are decided by the exact bags.  Classes are the connected components of
the links.

Results for odd input: texts without words (null and empty ones too) are a
class of their own; texts of one to four words are one shingle; rows that share
an id (or have none) get the class of their own text each, so they tie no other
texts together; a null id counts as the greatest and its class is null;
an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import _bytes as B
from . import _sketch as S
from ._graph import components
from ._shared import documents, durable, fresh, id_out, keyed, named

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 26, 5
K = BANDS * ROWS
#: Members up to which a bucket gives all its pairs.
SMALL = 16
#: Bucket rows (24 bytes each) and signatures (2 K bytes each) up to which one task finishes the rounds.
LOCAL_ROWS, LOCAL_SIGNATURES = 500_000, 100_000
#: Signatures up to which they are broadcast (14 MB) instead of joined by a shuffle.
BROADCAST_SIGNATURES = 50_000
#: Members of a large bucket held against each other in one cell of the finish.
BLOCK = 512
#: Coordinates by which keys grow from round to round; the last goes on.
MORE_ROWS = (3, 4, 6, 9, 14)
#: Standard errors of the estimate beyond which a pair is decided without the bags.
SURE = 4.0
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and count of each distinct shingle, by document and hash; and 128 bits of each document's words."""
    start, end, doc = B.words(data, offsets)
    m = len(offsets) - 1
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros((m, 2), dtype=np.uint64)
    hashes = B.word_hashes(data, start, end)
    size = np.bincount(doc, minlength=m)
    last = np.cumsum(size)
    first = last - size
    digest = np.stack([B.spans_hash(hashes, first, last, seed) for seed in (0, 1)], axis=1)
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.empty(0, np.int64)
    short = np.flatnonzero((size > 0) & (size < n))
    h = np.r_[B.grams_hash(hashes, n)[at], digest[short, 0]]
    of = np.r_[doc[at], short]
    by = np.lexsort((h, of))
    h, of = h[by], of[by]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
    return of[new], h[new], np.diff(np.r_[new, len(h)]), digest


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _darts(of: np.ndarray, x: np.ndarray, w: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, rank and hash of each dart under the weights w of elements x and under rank below[document]."""
    docs, ranks, darts = [], [], []
    strip = 0
    while True:
        low, width = 2.0**strip - 1, 2.0**strip
        use = np.flatnonzero(w > low)
        if not len(use):
            break
        rows = np.ceil(below[of[use]] * width).astype(np.int64)
        element = np.repeat(use, rows)
        row = np.arange(len(element)) - np.repeat(np.cumsum(rows) - rows, rows)
        cell = B.mix(x[element] ^ B.mix((np.uint64(strip) << np.uint64(48)) | row.astype(np.uint64)))
        thrown = np.searchsorted(_POISSON, _unit(cell), side="right")
        which = np.repeat(np.arange(len(cell)), thrown)
        turn = np.arange(len(which)) - np.repeat(np.cumsum(thrown) - thrown, thrown)
        dart = B.mix(cell[which] + (turn + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        element = element[which]
        rank = (row[which] + _unit(B.mix(dart + np.uint64(1)))) / width
        hit = (low + _unit(B.mix(dart + np.uint64(2))) * width < w[element]) & (rank < below[of[element]])
        docs.append(of[element[hit]])
        ranks.append(rank[hit])
        darts.append(dart[hit])
        strip += 1
    return np.concatenate(docs), np.concatenate(ranks), np.concatenate(darts)


def signatures(of: np.ndarray, x: np.ndarray, w: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """(n, k): the earliest dart of each coordinate, for documents of the weighted elements (of, x, w); 0 for documents without any."""
    out = np.zeros((n, k), dtype=np.uint64)
    weight = np.bincount(of, w, minlength=n)
    below = (k * math.log(k) + 2 * k) / np.maximum(weight, 1e-9)
    todo = weight > 0
    while todo.any():
        use = todo[of]
        doc, rank, dart = _darts(of[use], x[use], w[use], below)
        by = np.argsort(-rank, kind="stable")
        doc, dart = doc[by], dart[by]
        out[todo] = 0
        out.reshape(-1)[doc * k + (B.mix(dart + np.uint64(3)) % np.uint64(k)).astype(np.int64)] = dart  # the last write, of the least rank, stays
        todo &= (out == 0).any(axis=1)
        below = below * 2
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = B.ids(batch)
        for a, b, data, offsets in B.slices(batch):
            of, x, w, digest = shingles(data, offsets)
            some = np.flatnonzero(np.bincount(of, minlength=b - a) > 0)
            sig = signatures(of, x, w.astype(np.float64), b - a)[some]
            short = (B.mix(sig) & np.uint64(0xFFFF)).astype(">u2")
            raw = short.tobytes()
            none = np.ones(b - a, dtype=bool)  # without words
            none[some] = False
            signed: list[bytes | None] = [None] * (b - a)
            for k, at in enumerate(some.tolist()):
                signed[at] = raw[k * 2 * K : (k + 1) * 2 * K]
            more = batch.columns[2:]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[a:b]), *(pa.array(digest[:, k].copy().view(np.int64), mask=none) for k in (0, 1)), pa.array(signed, pa.binary()), *(c.slice(a, b - a) for c in more)],
                ["id", "d1", "d2", "sig", *batch.schema.names[2:]],
            )


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint16).reshape(-1, K) for k in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x == y).mean(axis=1))], ["a", "b", "estimate"])


def _bags(needed):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = B.ids(batch)
            batch = batch.filter(pa.array(needed.value(ids.view(np.uint64))))
            ids = B.ids(batch)
            for a, b, data, offsets in B.slices(batch):
                of, x, w, digest = shingles(data, offsets)
                edge = np.searchsorted(of, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [B.longs(digest[:, 0].copy()), B.longs(digest[:, 1].copy()), pa.array([x[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary()), pa.array([w[i:j].astype(np.uint32).tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary())],
                    ["d1", "d2", "x", "w"],
                )

    return task


def weighted_jaccard(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> float:
    """Of two bags, elements in order."""
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = y[at] == x
    common = np.minimum(wx[both], wy[at[both]]).sum()
    return float(common / (wx.sum() + wy.sum() - common))


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for p, q, r, s in zip(*(batch.column(k) for k in range(2, 6)), strict=True):  # views of the Arrow buffers, one pair at a time
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (p, r))
            wx, wy = (np.frombuffer(v.as_buffer(), np.uint32).astype(np.int64) for v in (q, s))
            found.append(weighted_jaccard(x, wx, y, wy))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["a", "b", "similarity"])


def _error(similarity: float) -> float:
    return SURE * math.sqrt(similarity * (1 - similarity) / K)


def _estimated(active: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, estimate) for pairs of representatives."""
    both = pairs.join(active.select(F.col("rid").alias("a"), F.col("sig").alias("sa")), "a").join(active.select(F.col("rid").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")
    return durable(both.mapInArrow(B.lean(_agreement), "a long, b long, estimate double"))


def _decided(bags: DataFrame, estimated: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similar, goes_on) for pairs with an estimate; after a pivot that is surely similar a member does not go on."""
    error = _error(similarity)
    off = F.col("estimate") - similarity
    sure = estimated.where(F.abs(off) > error).select("a", "b", (off > 0).alias("similar"), (off < 0).alias("goes_on"))
    left, right = (bags.select(F.col("id").alias(k), F.col("x").alias(f"x{k}"), F.col("w").alias(f"w{k}")) for k in "ab")
    exact = estimated.where(F.abs(off) <= error).join(left, "a").join(right, "b").select("a", "b", "xa", "wa", "xb", "wb").mapInArrow(B.lean(_exact), "a long, b long, similarity double")
    return durable(sure.unionByName(exact.select("a", "b", (F.col("similarity") >= similarity).alias("similar"), F.lit(True).alias("goes_on"))))


def _rows_of(sig: Column, first: Column, n: int) -> Column:
    """n coordinates of a signature from `first` on, around its end."""
    return F.concat(*[F.substring(sig, (first + k) % K * 2 + 1, 2) for k in range(n)])


def _shared(buckets: DataFrame) -> DataFrame:
    """(key, band, rid, pivot, n) of the members of buckets of two and more."""
    pivot = buckets.groupBy("key", "band").agg(F.min(F.struct(F.xxhash64("band", "rid").alias("h"), "rid"))["rid"].alias("pivot"), F.count("*").alias("n")).where("n > 1")
    pivot = pivot.select(F.col("key").alias("k"), F.col("band").alias("of"), "pivot", "n")
    # Joined by a part of the key: both sides are dealt by the join, so AQE may split a large bucket.
    return durable(buckets.join(pivot, (F.col("key") == F.col("k")) & ~(F.col("band") < F.col("of")) & ~(F.col("band") > F.col("of"))).select("key", "band", "rid", "pivot", "n"))


def _pairs(shared: DataFrame) -> DataFrame:
    """(a, b): the pairs of small buckets, and the pivots of large ones with their members; each pair once."""
    members = F.array_sort(F.collect_list("rid"))  # SMALL at most
    small = shared.where(F.col("n") <= SMALL).groupBy("key", "band").agg(members.alias("m")).select(F.explode(F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    large = shared.where((F.col("n") > SMALL) & (F.col("rid") != F.col("pivot"))).select(F.least("rid", "pivot").alias("a"), F.greatest("rid", "pivot").alias("b"))
    return small.select("p.a", "p.b").unionByName(large).distinct()


def _agree(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal coordinates of rows a and b, in parts that fit the cache."""
    out = np.empty(len(a))
    for k in range(0, len(a), 4096):
        out[k : k + 4096] = (sig[a[k : k + 4096]] == sig[b[k : k + 4096]]).mean(axis=1)
    return out


def remaining_rounds(sig: np.ndarray, member: np.ndarray, group: np.ndarray, band: np.ndarray, similarity: float, turn: int, used: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, estimate) of the pairs that may be similar, of the rounds from `turn` on.

    member: rows of sig, in buckets `group` of bands `band`; the keys grow first.  All of it is small.
    """
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    error = _error(similarity)
    while len(member):
        more = MORE_ROWS[min(turn, len(MORE_ROWS) - 1)]
        choices = 2 if turn == 0 else 1
        first = (band % BANDS + 1) * ROWS + used
        member, group, first = (np.concatenate([x] * choices) for x in (member, group, first))
        choice = np.repeat(np.arange(choices), len(member) // choices)
        at = (first + choice * more)[:, None] + np.arange(more)
        key = B.mix(group.astype(np.uint64) ^ B.mix(choice.astype(np.uint64)))
        for column in (sig[member[:, None], at % K]).T:
            key = B.mix(key ^ column.astype(np.uint64))
        band = np.concatenate([band] * choices) + choice * BANDS
        used, turn = used + more * choices, turn + 1
        by = np.lexsort((B.mix(member.astype(np.uint64) + band.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), key))
        member, key, band = member[by], key[by], band[by]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        a, b = [], []
        for n in range(2, SMALL + 1):
            of = start[size == n]
            i, j = np.triu_indices(n, 1)
            a.append((of[:, None] + i).reshape(-1))
            b.append((of[:, None] + j).reshape(-1))
        large = np.repeat(size > SMALL, size)
        pivot = np.repeat(start, size)
        rest = np.flatnonzero(large & (pivot != np.arange(len(key))))
        x, y = np.r_[np.concatenate(a), pivot[rest]].astype(np.int64), np.r_[np.concatenate(b), rest].astype(np.int64)
        estimate = _agree(sig, member[x], member[y])
        maybe = estimate >= similarity - error
        found.append((member[x][maybe], member[y][maybe], estimate[maybe]))
        going = rest[estimate[len(x) - len(rest) :] <= similarity + error]
        member, band = member[going], band[going]
        group = np.unique(key[going], return_inverse=True)[1]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _finish(similarity: float, turn: int, used: int):
    """Rows (rid, sig) of signatures and (rid, key, band) of buckets, all in one task, to (a, b, estimate)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), pa.schema([("rid", pa.int64()), ("sig", pa.binary()), ("key", pa.int64()), ("band", pa.int32())]))
        signed = rows.filter(pc.is_valid(rows.column("sig")))
        rids = signed.column("rid").to_numpy()
        by = np.argsort(rids)
        rids = rids[by]
        raw, offsets = B.text_buffers(signed.column("sig").combine_chunks())
        sig = raw[offsets[0] : offsets[-1]].view(np.uint16).reshape(-1, K)[by]
        held = rows.filter(pc.is_null(rows.column("sig")))
        key, band = held.column("key").to_numpy(), held.column("band").to_numpy().astype(np.int64)
        _, group = np.unique(np.stack([key, band]), axis=1, return_inverse=True)
        a, b, estimate = remaining_rounds(sig, np.searchsorted(rids, held.column("rid").to_numpy()), group.reshape(-1), band, similarity, turn, used)
        pair, first = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1, return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(rids[pair[0]]), pa.array(rids[pair[1]]), pa.array(estimate[first])], ["a", "b", "estimate"])

    return task


def _links(similarity: float):
    """Rows (outside, rid, class, x, w) of a cell to (u, v): the outside members' links to other classes, one for each class."""

    def task(table: pa.Table) -> pa.Table:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        table = table.combine_chunks()
        outside, rid, label = (table.column(k).to_numpy() for k in ("outside", "rid", "class"))
        (x, xs), (w, ws) = (B.text_buffers(table.column(k).combine_chunks()) for k in "xw")
        x, w = x[xs[0] : xs[-1]].view(np.uint64), w[ws[0] : ws[-1]].view(np.uint32).astype(np.int64)
        edge = (xs - xs[0]) // 8
        element = np.unique(x, return_inverse=True)[1]
        weight = np.add.reduceat(w, edge[:-1])
        mine = np.zeros(int(element.max()) + 1, dtype=np.int64)
        held = np.flatnonzero(~outside)
        if len(held):
            # The members first: their elements are one run.
            of = np.concatenate([np.arange(edge[k], edge[k + 1]) for k in held])
            e, n, start = element[of], w[of], np.cumsum(edge[held + 1] - edge[held]) - (edge[held + 1] - edge[held])
            for k in np.flatnonzero(outside):
                mine[element[edge[k] : edge[k + 1]]] = w[edge[k] : edge[k + 1]]
                common = np.add.reduceat(np.minimum(mine[e], n), start)
                mine[element[edge[k] : edge[k + 1]]] = 0
                hit = held[(common / (weight[k] + weight[held] - common) >= similarity) & (label[held] != label[k])]
                hit = hit[np.unique(label[hit], return_index=True)[1]]
                found.append((np.full(len(hit), rid[k]), rid[hit]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["u", "v"])

    return task


def _missed(first: DataFrame, found: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """(u, v): the links between the classes found that a large bucket of the first round still holds, by exact comparison.

    Two members of a bucket are of one class, or one of them at least is outside the bucket's largest class: so all those
    outside against all members are all pairs left.  Both are dealt into blocks by hash; a pair of blocks is a cell.
    """
    members = durable(first.where(F.col("n") > SMALL).select("key", "rid").join(found, F.col("rid") == F.col("node"), "left").select("key", "rid", F.coalesce("least", "rid").alias("class")))
    sizes = members.groupBy("key", "class").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "class")).alias("body")).where("n > body.c")
    sizes = sizes.select(F.col("key").alias("k"), F.ceil(F.col("n") / BLOCK).cast("int").alias("n_all"), F.ceil((F.col("n") - F.col("body.c")) / BLOCK).cast("int").alias("n_out"), F.col("body.class").alias("body"))
    members = durable(members.join(sizes, F.col("key") == F.col("k")).drop("k"))
    block = lambda n: F.pmod(F.xxhash64("rid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = members.select("key", "rid", "class", F.lit(False).alias("outside"), block("n_all").alias("i"), every("n_out").alias("j"))
    out = members.where("class != body").select("key", "rid", "class", F.lit(True).alias("outside"), every("n_all").alias("i"), block("n_out").alias("j"))
    cells = held.unionByName(out).join(bags, F.col("rid") == F.col("id")).drop("id")
    return cells.groupBy("key", "i", "j").applyInArrow(_links(similarity), "u long, v long").distinct()


def _classes(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and (d1, d2, class, first, rows, component) of the texts that occur in several rows or have links.

    docs: (id, text, and what signed rows keep beside).  class: the least id of the text's class; first: that of the text;
    component: what texts of one class have in common, null without links.
    """
    signed = durable(docs.mapInArrow(B.lean(_sign), "id long, d1 long, d2 long, sig binary" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.schema[2:])))
    # A text is known by a key of its own from here on: ids may be null or shared.
    reps = signed.where("d1 IS NOT NULL").groupBy("d1", "d2").agg(F.min("id").alias("id"), F.count("*").alias("rows"), F.first("sig").alias("sig"))
    reps = durable(reps.withColumn("rid", F.monotonically_increasing_id()))
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(b, _rows_of(F.col("sig"), b * ROWS, ROWS)).alias("key"))))
    shared = _shared(reps.select("rid", band.alias("x")).select("x.key", "x.band", "rid"))
    # What later rounds need of the texts that share a bucket with another.
    texts = durable(reps.join(shared.select("rid").distinct(), "rid", "left_semi").select("rid", "id", "d1", "d2", "sig"))
    active = texts.select("rid", "sig")
    bags = docs.mapInArrow(B.lean(_bags(docs.sparkSession.sparkContext.broadcast(S.members(texts, "id", 1 << 20)))), "d1 long, d2 long, x binary, w binary")
    bags = durable(bags.join(texts.select("rid", "d1", "d2"), ["d1", "d2"]).groupBy(F.col("rid").alias("id")).agg(F.min(F.struct("x", "w")).alias("b")).select("id", "b.x", "b.w"))
    n_active = active.count()
    signed_by = F.broadcast(active) if n_active <= BROADCAST_SIGNATURES else active
    known = None
    first_round = shared
    turn = used = 0
    while not shared.isEmpty():
        pairs = _pairs(shared)
        now = _decided(bags, _estimated(signed_by, pairs.join(known, ["a", "b"], "left_anti") if known is not None else pairs), similarity)
        known = now if known is None else known.unionByName(now)
        large = shared.where((F.col("n") > SMALL) & (F.col("rid") != F.col("pivot"))).withColumns({"a": F.least("rid", "pivot"), "b": F.greatest("rid", "pivot")})
        rest = durable(large.join(known.where("goes_on"), ["a", "b"]).select("key", "band", "rid"))
        n_rest = rest.count()
        if n_rest <= LOCAL_ROWS and n_active <= LOCAL_SIGNATURES:
            if n_rest:
                rows = active.join(rest.select("rid").distinct(), "rid", "left_semi").select("rid", "sig", F.lit(None).cast("long").alias("key"), F.lit(None).cast("int").alias("band"))
                rows = rows.unionByName(rest.select("rid", F.lit(None).cast("binary").alias("sig"), "key", F.col("band").cast("int").alias("band")))
                left = durable(rows.coalesce(1).mapInArrow(B.lean(_finish(similarity, turn, used)), "a long, b long, estimate double"))
                known = known.unionByName(_decided(bags, left, similarity))
            break
        # The coordinates after the band's own and those of earlier rounds.
        more = MORE_ROWS[min(turn, len(MORE_ROWS) - 1)]
        first = (F.col("band") % BANDS + 1) * ROWS + used
        choices = 2 if turn == 0 else 1
        grown = rest.join(signed_by, "rid").select("rid", "key", "band", "sig", F.explode(F.sequence(F.lit(0), F.lit(choices - 1))).alias("choice"))
        grown = durable(grown.select(F.xxhash64("key", "choice", _rows_of(F.col("sig"), first + F.col("choice") * more, more)).alias("key"), (F.col("band") + F.col("choice") * BANDS).alias("band"), "rid"))
        used += more * choices
        shared = _shared(grown)
        turn += 1
    edges = known.where("similar").select(F.col("a").alias("u"), F.col("b").alias("v")) if known is not None else shared.select(F.col("rid").alias("u"), F.col("pivot").alias("v"))
    if not first_round.where(F.col("n") > SMALL).isEmpty():
        edges = edges.unionByName(durable(_missed(first_round, components(edges), bags, similarity)))
    found = components(edges)
    least = durable(found.join(reps.select("rid", "id"), F.col("node") == F.col("rid")).groupBy(F.col("least").alias("of")).agg(F.min("id").alias("class")))
    # Texts that occur once and have no link are their own class: they need no join.
    classes = reps.select("rid", "d1", "d2", F.col("id").alias("first"), "rows").join(found, F.col("rid") == F.col("node"), "left").where("rows > 1 OR node IS NOT NULL")
    return signed, durable(classes.join(least, F.col("least") == F.col("of"), "left").select("d1", "d2", F.coalesce("class", "first").alias("class"), "first", "rows", F.col("least").alias("component")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of df: id_col and class_id, the least id of its text's class."""
    signed, classes = _classes(keyed(df, id_col, text_col), similarity)
    classes = classes.select("d1", "d2", "class")
    out = signed.select("id", "d1", "d2").join(classes, ["d1", "d2"], "left").select("id", F.coalesce("class", "id").alias("class"))
    return out.select(id_out(id_col), id_out("class_id", "class"))


#: Texts up to which what becomes of them is broadcast (50 bytes each); more are joined by a shuffle.
BROADCAST_TEXTS = 200_000


def _with_digest(schema: StructType, at: int):
    """Whole rows, and the 128 bits of their words after them (null without words)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, digests = [], []
            for a, b, data, offsets in B.slices(batch, at):
                start, end, doc = B.words(data, offsets)
                size = np.bincount(doc, minlength=b - a)
                hashes, last = B.word_hashes(data, start, end), np.cumsum(size)
                some.append(size > 0)
                digests.append(np.stack([B.spans_hash(hashes, last - size, last, seed) for seed in (0, 1)], axis=1) if len(hashes) else np.zeros((b - a, 2), np.uint64))
            none, digest = ~np.concatenate(some), np.concatenate(digests)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(digest[:, k].copy().view(np.int64), mask=none) for k in (0, 1))], schema.names)

    return task


def one_of_each_class(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of df, all columns, without near-duplicates: of each class of texts one row stays, that of the least id.

    Classes are of texts, so rows without an id, or of one id, stay when their texts are like no other.  Of equal texts under
    the least id the row with the least hash of all its columns stays; rows without words are like no other.
    """
    x, d1, d2, t1, t2, stay, one = (fresh(df, c) for c in ("row_hash", "d1", "d2", "t1", "t2", "stays", "one"))
    hashed = df.withColumn(x, F.xxhash64(*[named(f.name) for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]))
    signed, classes = _classes(keyed(hashed, id_col, text_col, x), similarity)
    keep = classes.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("first", "d1", "d2")).alias("k"))
    stays = F.coalesce((F.col("d1") == F.col("k.d1")) & (F.col("d2") == F.col("k.d2")), F.lit(True))
    decided = classes.join(keep, "component", "left").select("d1", "d2", "rows", stays.alias("stays"))
    # Which of the rows of an equal text: the least (id, hash), and whether rows agree in both.
    several = decided.where("stays AND rows > 1").select(F.col("d1").alias("s1"), F.col("d2").alias("s2"))
    same = (F.col("d1") == F.col("s1")) & (F.col("d2") == F.col("s2"))
    rows = signed.join(several, same, "left_semi").groupBy("d1", "d2", "id", "x").agg(F.count("*").alias("n")).groupBy("d1", "d2").agg(F.min(F.struct("id", "x", "n")).alias("one"))
    decided = durable(decided.join(rows, ["d1", "d2"], "left").select(F.col("d1").alias(t1), F.col("d2").alias(t2), F.col("stays").alias(stay), F.col("one").alias(one)))
    known = F.broadcast(decided) if decided.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS else decided
    schema = StructType([*hashed.schema.fields, StructField(d1, LongType()), StructField(d2, LongType())])
    digested = hashed.mapInArrow(B.lean(_with_digest(schema, hashed.columns.index(text_col))), schema)
    joined = digested.join(known, (F.col(d1) == F.col(t1)) & (F.col(d2) == F.col(t2)), "left")
    own = (F.coalesce(named(id_col).cast("long"), F.lit(B.LAST_ID)) == F.col(f"{one}.id")) & (F.col(x) == F.col(f"{one}.x"))
    kept = joined.where(F.col(stay).isNull() | (F.col(stay) & F.coalesce(own, F.lit(True))))
    columns = [named(c) for c in df.columns]
    if decided.where(f"{one}.n > 1").isEmpty():
        return kept.select(*columns)
    twice = F.coalesce(F.col(f"{one}.n"), F.lit(1)) > 1
    rest = kept.where(twice).groupBy(d1, d2).agg(F.first(F.struct(*columns)).alias("row")).select("row.*")
    return kept.where(~twice).select(*columns).unionByName(rest)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
