"""Runs: stretches of words that repeat with a period, as long as they go.

Inside a document, runs are found by a suffix automaton over its words.  Every state's end positions are an ordered set;
going from long states to short ones, the smaller set of a state and its link is merged into the larger, and each
position that is put in meets its two new neighbours.  Neighbours no further apart than the state is long bound a square
whose period is their distance (no smaller one: it would give an end position between them); the square is extended to
the run.  Each run is extended once, later squares inside it are passed over.  All pairs that become neighbours anywhere
are O(n log n).

Only stretches that can hold a long enough run get an automaton: in a run of period q, groups of a few words recur within
q words, (repeats - 1) * q - group + 1 times in a row at least.  Distances to the next equal group are held against the
bounds for periods 1, 2, 3-4, 5-8 and so on; what passes holds every run whole.  The rest of a text costs one sort.

Results for odd input: null and empty texts have no words, no runs and collapse to the empty text; a null id is returned
as null (and op11 leaves its text as it is); rows that share an id are taken each for itself; an empty table gives no
rows.  A text is one row of one task: its automaton takes about 700 bytes for each word of a stretch that may be periodic.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _bytes as B
from ._shared import documents, named

#: A run repeats its period so often, and has so many words, at least.
REPEATS, SHORTEST = 4, 6
#: Words of a group at most.
GROUP = 4
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Automaton:
    """The suffix automaton of a sequence: per state its length, link, steps, and an end position if it is a prefix (else -1)."""

    def __init__(self, sequence: list[int]):
        self.length, self.link, self.steps, self.end = [0], [-1], [{}], [-1]
        last = 0
        for at, symbol in enumerate(sequence):
            now = self._state(self.length[last] + 1, {}, at)
            while last >= 0 and symbol not in self.steps[last]:
                self.steps[last][symbol] = now
                last = self.link[last]
            self.link[now] = 0 if last < 0 else self._whole(last, symbol)
            last = now

    def _state(self, length: int, steps: dict[int, int], end: int) -> int:
        self.length.append(length)
        self.link.append(0)
        self.steps.append(steps)
        self.end.append(end)
        return len(self.length) - 1

    def _whole(self, before: int, symbol: int) -> int:
        """The state whose longest sequence is that of `before` and then the symbol, parted from a longer one if need be."""
        there = self.steps[before][symbol]
        if self.length[there] == self.length[before] + 1:
            return there
        part = self._state(self.length[before] + 1, dict(self.steps[there]), -1)
        self.link[part], self.link[there] = self.link[there], part
        while before >= 0 and self.steps[before].get(symbol) == there:
            self.steps[before][symbol] = part
            before = self.link[before]
        return part


def squares(sequence: list[int]) -> Iterator[tuple[int, int]]:
    """(i, j) of positions that become neighbours in a state at least as long as their distance, so that the j - i symbols up to each are the same."""
    known = Automaton(sequence)
    length, link = known.length, known.link
    known.steps = []
    # Positions are held negated: merging a prefix into a longer one's set then mostly adds at the end.
    ends: list[list[int] | None] = [[-at] if at >= 0 else [] for at in known.end]
    for state in np.argsort(np.array(length), kind="stable")[::-1].tolist():
        into = link[state]
        if into <= 0:
            ends[state] = None
            continue
        small, large = ends[into], ends[state]
        if len(small) > len(large):
            small, large = large, small
        bound = length[into]
        for x in small:
            if large and x < large[-1]:
                insort(large, x)
            else:
                large.append(x)
        for x in small:  # neighbours by the whole set only
            k = bisect_left(large, x)
            if k and x - large[k - 1] <= bound:
                yield -x, -large[k - 1]
            if k + 1 < len(large) and large[k + 1] - x <= bound:
                yield -large[k + 1], -x
        ends[into], ends[state] = large, None


def runs_of(sequence: list[int], repeats: int = REPEATS, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least `shortest` symbols and `repeats` periods (two or more), by start and period."""
    seen: dict[int, tuple[list[int], list[int]]] = {}  # starts and ends of the runs of a period, ascending
    for i, j in squares(sequence):
        period = j - i
        starts, ends = seen.setdefault(period, ([], []))
        k = bisect_right(starts, i - period + 1)
        if k and ends[k - 1] > j:
            continue
        start, end = i - period + 1, j + 1
        while start and sequence[start - 1] == sequence[start - 1 + period]:
            start -= 1
        while end < len(sequence) and sequence[end] == sequence[end - period]:
            end += 1
        k = bisect_left(starts, start)
        starts.insert(k, start)
        ends.insert(k, end)
    return sorted((x, y - x, q) for q, have in seen.items() for x, y in zip(*have, strict=True) if y - x >= max(shortest, repeats * q))


def stretches(hashes: np.ndarray, doc: np.ndarray, repeats: int = REPEATS, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of words, each within a document, that hold every run whole; hashes, doc: of each word."""
    n = len(hashes)
    least = lambda low, high: min(max(shortest - q, (repeats - 1) * q) for q in range(low, max(low, min(high, shortest)) + 1))
    group = min(GROUP, least(1, shortest))
    if n <= group:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys = B.grams_hash(hashes, group)
    whole = doc[: len(keys)] == doc[group - 1 :]
    keys = keys ^ B.mix(doc[: len(keys)].astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    gap = np.full(len(keys), n, dtype=np.int64)  # to the next equal group
    gap[order[:-1][same]] = np.diff(order)[same]
    gap[~whole] = n
    edge = np.zeros(n + 1, dtype=np.int64)
    last = np.searchsorted(doc, doc, side="right")
    most = int(np.bincount(doc).max()) // repeats
    high, low = 1, 1
    while low <= most:
        near = np.flatnonzero(np.diff(np.r_[False, gap <= high, False].view(np.int8)))
        x, y = near[::2], near[1::2]
        keep = y - x >= least(low, high) - group + 1
        x, y = x[keep], y[keep]
        np.add.at(edge, x, 1)
        np.add.at(edge, np.minimum(y + high + group - 1, last[x]), -1)
        low, high = high + 1, high * 2
    held = np.cumsum(edge[:-1]) > 0
    first, final = held.copy(), held.copy()
    first[1:] &= ~held[:-1] | (doc[1:] != doc[:-1])
    final[:-1] &= ~held[1:] | (doc[1:] != doc[:-1])
    return np.flatnonzero(first), np.flatnonzero(final) + 1


def _runs(repeats: int, shortest: int) -> Callable:
    """(id, text) to (id, words, runs, collapsed): words counts them, collapsed is the text without a run's words after its first period."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in B.slices(batch):
                start, end, doc = B.words(data, offsets)
                found: list[list[tuple[int, int, int]]] = [[] for _ in range(b - a)]
                before = np.searchsorted(doc, np.arange(b - a + 1))
                for x, y in zip(*(z.tolist() for z in stretches(B.word_hashes(data, start, end), doc, repeats, shortest)), strict=True):
                    number: dict[bytes, int] = {}
                    sequence = [number.setdefault(data[s:e].tobytes(), len(number)) for s, e in zip(start[x:y].tolist(), end[x:y].tolist(), strict=True)]
                    own = int(doc[x])
                    found[own] += [(x - int(before[own]) + s, size, q) for s, size, q in runs_of(sequence, repeats, shortest)]
                collapsed = []
                for k, runs in enumerate(found):
                    words = data[offsets[k] : offsets[k + 1]].tobytes().split()
                    if runs:
                        gone = np.zeros(len(words) + 1, dtype=np.int64)
                        for s, size, q in runs:
                            gone[s + q] += 1
                            gone[s + size] -= 1
                        words = [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]
                    collapsed.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(before)), pa.array([[{"start": s, "length": n, "period": q} for s, n, q in sorted(runs)] for runs in found], RUNS), pa.array(collapsed, pa.string())],
                    ["id", "words", "runs", "collapsed"],
                )

    return task


def period_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: int = REPEATS, shortest: int = SHORTEST) -> DataFrame:
    """Returns id_col, words (their number), runs (start, length and period in words, by start and period) and collapsed."""
    rows = df.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(B.lean(_runs(max(2, repeats), shortest)), "id long, words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def planted(doc_id: int, words: list[bytes]) -> list[bytes]:
    """The words of a document as op11 takes them: one id in ten has a periodic rest."""
    draw, n = zlib.crc32(str(doc_id).encode()), len(words)
    if draw % 10 or not n:
        return words
    begin = draw // 10 % n
    period = 1 + (n - begin) // (3 + draw // 10 % 8)
    return words[:begin] + [words[begin + k % period] for k in range(n - begin)]


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        if not any(i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i in ids):
            yield batch
            continue
        texts = [x if i is None or zlib.crc32(str(i).encode()) % 10 else (b" ".join(planted(i, (x.as_py() or "").encode().split()))).decode() for i, x in zip(ids, batch.column(1), strict=True)]
        texts = [x if isinstance(x, str) else x.as_py() for x in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count, top, sha, text = [], [], [], []
        for runs, collapsed in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
            best = None
            for r in runs:  # by start and period: the first of equal exponents stays
                if best is None or r["length"] * best["period"] > best["length"] * r["period"]:
                    best = r
            count.append(len(runs))
            top.append((best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]) if best else (None,) * 4)
            sha.append(hashlib.sha256("".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs).encode()).hexdigest())
            text.append(hashlib.sha256(collapsed.as_buffer()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(count, pa.int64()), *(pa.array([t[k] for t in top], pa.int64()) for k in range(4)), pa.array(sha, pa.string()), pa.array(text, pa.string())],
            ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
        )


def op11_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted, searched and digested in one task, so that only digests leave it."""
    rows = documents(spark, sf_dir).select(named("doc_id").cast("long").alias("id"), named("text").cast("string").alias("text"))
    task = lambda batches: _digest(_runs(REPEATS, SHORTEST)(_planted(batches)))
    return rows.mapInArrow(B.lean(task), "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
