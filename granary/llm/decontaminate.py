"""Benchmark decontamination by greedy string tiling.

Words are ASCII-lower-cased runs of letters and digits.  Karp-Rabin hashes of
every MIN_MATCH words of the items are joined with those of the documents (the
seeds).  For a document and an item that share enough seeds, the longest match
that overlaps no marked word is marked again and again, ties by place, until no
match of MIN_MATCH words is left; the tiles' share of the item's words is its
coverage.  Tiles may come in any order, so reordered passages count.

The items travel to the tasks in blocks of at most BLOCK_BYTES (a longer item is
a block of its own), one pass over the documents per block; documents are never
shuffled or paired.

Items of fewer than MIN_MATCH words have no seed.  With short_items a document that
holds all their words in a row matches; without (a word or three would condemn
clean documents) they give no row.

Results for odd input: null texts are empty; a null document id comes back as null, a null
item id too; rows that share an id are matched each for itself; empty tables
give no rows.  Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from ._shared import documents, id_out, keyed, over_rows

MIN_MATCH = 4
COVERAGE = 0.5
#: Pairs of places with one seed that are held at once.
PAIRS = 1 << 21
BLOCK_BYTES = 8 << 20
_OUT = "id long, item long, n_item_words int, n_tiles int, n_matched int, coverage double, tiles array<struct<item_start:int,doc_start:int,length:int>>"


def _words(data: np.ndarray, offsets: np.ndarray):
    data = B.LOWER[data] if len(data) else data
    start, end, doc = B.words(data, offsets, B.ALNUM)
    return (B.word_hashes(data, start, end) if len(start) else np.empty(0, np.uint64)), doc


def _seeds(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(hashes) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    return at, B.grams_hash(hashes, n)[at]


def tiles(pattern: np.ndarray, text: np.ndarray, i: np.ndarray, j: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The tiles by the places i, j of all seeds of `least` words."""
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    new = np.flatnonzero(np.r_[True, (j[1:] - i[1:] != j[:-1] - i[:-1]) | (i[1:] != i[:-1] + 1)])
    return tiled(pattern, text, i[new], j[new], np.diff(np.r_[new, len(i)]) + least - 1, least)


def tiled(pattern: np.ndarray, text: np.ndarray, i: np.ndarray, j: np.ndarray, length: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in pattern, start in text, length) of the tiles; i, j, length: the runs of words in common that no word before or after extends."""
    heap = [(-n, x, y) for n, x, y in zip(length.tolist(), i.tolist(), j.tolist(), strict=True) if np.array_equal(pattern[x : x + n], text[y : y + n])]
    heapq.heapify(heap)
    in_pattern, in_text = np.zeros(len(pattern), dtype=bool), np.zeros(len(text), dtype=bool)
    out = []
    while heap:
        n, x, y = heapq.heappop(heap)
        n = -n
        marked = in_pattern[x : x + n] | in_text[y : y + n]
        if not marked.any():
            out.append((x, y, n))
            in_pattern[x : x + n] = in_text[y : y + n] = True
            continue
        for a, b in np.flatnonzero(np.diff(np.r_[True, marked, True].astype(np.int8))).reshape(-1, 2).tolist():
            if b - a >= least:
                heapq.heappush(heap, (a - b, x + a, y + a))
    return sorted(out)


class _Items:
    """A block of items: their words end to end, the seed at each word (0 where none fits) and the seeds in order of hash."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, item: np.ndarray, least: int, short: bool = False):
        self.ids, self.hashes, self.item = ids, hashes, item
        self.size = np.bincount(item, minlength=len(ids))
        self.first = np.cumsum(self.size) - self.size
        at, seed = _seeds(hashes, item, least)
        self.at = np.zeros(len(hashes) + 1, dtype=np.uint64)
        self.at[at] = seed
        by = np.argsort(seed, kind="stable")
        self.seed, self.place = seed[by], at[by]
        self.short = {}  # items of fewer words, by their hash
        for n in range(1, least) if short else ():
            of = np.flatnonzero(self.size == n)
            if len(of):
                found = B.grams_hash(hashes, n)[self.first[of]]
                by = np.argsort(found, kind="stable")
                self.short[n] = found[by], of[by]

    def __bool__(self) -> bool:
        return bool(len(self.seed) or self.short)

    def runs(self, at: np.ndarray, seed: np.ndarray, n_words: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in text, place in the items, length) of the runs of seeds in common.

        Pairs of places with one seed are made PAIRS at a time, and of each run only its first and its last pair is kept:
        texts of few different words make very many pairs, but few runs.
        """
        text = np.zeros(n_words + 1, dtype=np.uint64)
        text[at] = seed
        low = np.searchsorted(self.seed, seed, side="left")
        use = np.flatnonzero(self.seed[np.minimum(low, len(self.seed) - 1)] == seed) if len(self.seed) else np.empty(0, np.int64)
        at, low = at[use], low[use]
        many = np.searchsorted(self.seed, seed[use], side="right") - low
        edge = np.cumsum(many)
        ends: tuple[list, list] = ([], [])
        done = 0
        while done < len(at):
            last = max(done + 1, int(np.searchsorted(edge, (edge[done - 1] if done else 0) + PAIRS, side="right")))
            n = many[done:last]
            k = np.repeat(low[done:last], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            x, y = np.repeat(at[done:last], n), self.place[k]
            for out, step in zip(ends, (-1, 1), strict=True):  # place -1 is the last one, which has no seed
                end = (text[x + step] == 0) | (text[x + step] != self.at[y + step])
                out.append(np.stack([x[end], y[end]]))
            done = last
        (x, y), (to, _) = (p[:, np.lexsort((p[0], p[1] - p[0]))] for p in (np.hstack([np.empty((2, 0), np.int64), *e]) for e in ends))
        return x, y, to - x + least


def _short_matches(items: _Items, hashes: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(document, item, first place) where all words of an item of few words stand."""
    for n, (known, of) in items.short.items():
        at, seed = _seeds(hashes, doc, n)
        low, high = (np.searchsorted(known, seed, side=s) for s in ("left", "right"))
        use = np.flatnonzero(high > low)
        seen = set()
        for k in use.tolist():
            for m in of[low[k] : high[k]].tolist():
                if (doc[at[k]], m) not in seen and np.array_equal(items.hashes[items.first[m] : items.first[m] + n], hashes[at[k] : at[k] + n]):
                    seen.add((doc[at[k]], m))
                    yield int(doc[at[k]]), m, int(at[k])


def _match(block, least: int, coverage: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: _Items = block.value
        for batch in batches:
            ids, found = B.ids(batch), []

            def add(doc: int, m: int, got: list[tuple[int, int, int]]) -> None:
                size, n = int(items.size[m]), sum(t[2] for t in got)
                found.append((int(ids[doc]), int(items.ids[m]), size, len(got), n, n / size, [dict(zip(("item_start", "doc_start", "length"), t, strict=True)) for t in got]))

            for a, _, data, offsets in B.slices(batch):
                hashes, doc = _words(data, offsets)
                for d, m, x in _short_matches(items, hashes, doc):
                    add(a + d, m, [(0, x - int(np.searchsorted(doc, d)), int(items.size[m]))])
                at, place, length = items.runs(*_seeds(hashes, doc, least), len(hashes), least)
                if not len(at):
                    continue
                of, item = doc[at], items.item[place]
                by = np.lexsort((place, item, of))
                at, place, length, of, item = at[by], place[by], length[by], of[by], item[by]
                edge = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (item[1:] != item[:-1])])
                need = np.ceil(coverage * items.size[item[edge]] - 1e-9)
                last = np.r_[edge[1:], len(at)]
                for k in np.flatnonzero(np.add.reduceat(length, edge) >= need).tolist():  # fewer words than that cannot cover enough
                    x, y, d, m = edge[k], last[k], int(of[edge[k]]), int(item[edge[k]])
                    first, size = int(items.first[m]), int(items.size[m])
                    lo, hi = np.searchsorted(doc, [d, d + 1])
                    got = tiled(items.hashes[first : first + size], hashes[lo:hi], place[x:y] - first, at[x:y] - lo, length[x:y], least)
                    if sum(t[2] for t in got) >= need[k]:
                        add(a + d, m, got)
            if found:
                cols = list(zip(*found, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "item", "n_item_words", "n_tiles", "n_matched", "coverage", "tiles"])

    return task


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, least: int, short_items: bool) -> Iterator[_Items]:
    """The items in blocks of BLOCK_BYTES, one at a time on the driver."""
    items = keyed(benchmark, item_id, item_text).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / BLOCK_BYTES))
    for k in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == k).collect() if n_blocks > 1 else items.collect()
        raw = [r["text"].encode() for r in rows]
        hashes, item = _words(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
        yield _Items(np.array([r["id"] for r in rows], dtype=np.int64), hashes, item, least, short_items)


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = MIN_MATCH, coverage: float = COVERAGE, short_items: bool = False) -> DataFrame:
    """One row per document and benchmark item whose coverage reaches the threshold, with the tiles (in words)."""
    spark, docs = df.sparkSession, keyed(df, id_col, text_col)
    found = [docs.mapInArrow(B.lean(_match(spark.sparkContext.broadcast(block), least, coverage)), _OUT) for block in _blocks(benchmark, item_id, item_text, least, short_items) if block]
    out = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _OUT)
    return out.select(id_out(id_col), id_out(item_id, "item"), "n_item_words", "n_tiles", "n_matched", "coverage", "tiles")


def keep_clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = MIN_MATCH, coverage: float = COVERAGE, short_items: bool = False) -> DataFrame:
    """The rows of df, all columns, that cover too little of every item: each row is decided by its own text, whatever its id."""

    def finish(batch: pa.RecordBatch, result: pa.RecordBatch) -> pa.RecordBatch:
        clean = np.ones(batch.num_rows, dtype=bool)
        clean[result.column(0).to_numpy()] = False
        return batch.filter(pa.array(clean))

    def rows_of(match):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([i for found in match(iter([batch])) for i in found.column(0).to_pylist()], pa.int64())], ["row"])

        return task

    for block in _blocks(benchmark, item_id, item_text, least, short_items):
        if block:
            df = over_rows(df, text_col, rows_of(_match(df.sparkSession.sparkContext.broadcast(block), least, coverage)), finish)
    return df


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")).drop("tiles")
