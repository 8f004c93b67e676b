"""A distributed count-min sketch whose counters stop at two.

Each task counts its keys into cells and ships the cells it touched, delta-coded
and compressed; the cells of a block meet in one task, which folds them one
after another.  What returns is one bit per cell: "two or more".  A key whose
true count is two or more always reads as repeated; a key that occurs once may
read so by collision.  The merged bits have a size bounded by MOST_BITS whatever
the input, so they may be broadcast.  Where a corpus has more keys than such a
sketch tells apart (`crowded`), the keys that pass it are counted exactly by a
shuffle of keys and places, and texts learn which of their places count.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import lean, mix

DEPTH = 2
#: A row of the sketch has 2**LEAST_BITS to 2**MOST_BITS cells: 2 * 64 MB of bits at most.
LEAST_BITS, MOST_BITS = 20, 29
#: Keys that a task gathers before it ships a part of its sketch.
PART_KEYS = 1 << 20
BLOCK_BITS = 18
_PART = "block int, part binary, n int"


def bits_for(keys: float) -> int:
    """log2 of the cells in a row, for about so many keys: eight cells a key, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1.0, keys) * 8))))


#: Cells a key below which a sketch lets too much pass.
LEAST_CELLS = 4


def crowded(keys: float) -> bool:
    """Whether about so many keys fill the largest sketch."""
    return keys * LEAST_CELLS > 1 << MOST_BITS


def tagged(docs: DataFrame) -> DataFrame:
    """docs (id, text) with 128 bits of the text (t, u), which tell rows apart that share an id; rows of one id and text are one."""
    return docs.withColumns({"t": F.xxhash64("text"), "u": F.xxhash64(F.lit("u"), "text")})


_TAG = np.dtype([("t", np.int64), ("u", np.int64)])


def packed_tags(t: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Both halves of each row's tag as one value, to be compared as a whole."""
    out = np.empty(len(t), dtype=_TAG)
    out["t"], out["u"] = t, u
    return out


def tags(batch: pa.RecordBatch) -> np.ndarray:
    """The tags of a batch of `tagged` rows."""
    return packed_tags(batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False))


def tag_columns(tags: np.ndarray) -> tuple[pa.Array, pa.Array]:
    return pa.array(np.ascontiguousarray(tags["t"])), pa.array(np.ascontiguousarray(tags["u"]))


def with_places(docs: DataFrame, places: DataFrame, keys: DataFrame) -> DataFrame:
    """docs (id, text, t, u) with `use`: the numbers k of their places whose key is in the single column of keys.

    places: (a, id, t, u, k).  A key in very many places is one row of keys, and both sides are dealt by the join itself.
    """
    hits = places.join(keys.toDF("key"), F.col("a") == F.col("key")).groupBy("id", "t", "u").agg(F.collect_set("k").alias("use"))
    return docs.alias("d").join(hits.alias("h"), F.expr("d.id = h.id and d.t = h.t and d.u = h.u"), "left").select("d.id", "d.text", "d.t", "d.u", "h.use")


def usable(batch: pa.RecordBatch, a: int, b: int, of: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Which places (k of document a + of) are among those that rows [a, b) of a batch from with_places name."""
    lists = batch.column(4).slice(a, b - a)
    named = np.repeat(np.arange(b - a), lists.value_lengths().fill_null(0).to_numpy()) << 32 | lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.isin(of << 32 | k, named)


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(keys ^ np.uint64((row + 1) * 0x632BE59BD9B4E019 & (2**64 - 1))) >> np.uint64(64 - bits)).astype(np.int64)


class Repeated:
    """The merged bits: which keys are estimated to occur twice or more."""

    def __init__(self, bits: int, rows: list[np.ndarray]):
        self.bits, self.rows = bits, rows

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for row, have in enumerate(self.rows):
            at = cells(keys, row, self.bits)
            out &= (have[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def _ship(keys: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    per_row = max(1, 1 << (bits - BLOCK_BITS))
    for row in range(DEPTH):
        at, count = np.unique(cells(keys, row, bits), return_counts=True)
        blocks, first = np.unique(at >> BLOCK_BITS, return_index=True)
        low = ((at & ((1 << BLOCK_BITS) - 1)) * 2 + (count > 1)).astype(np.int32)
        parts = np.split(low, first[1:])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(blocks.astype(np.int32) + row * per_row, pa.int32()),
                pa.array([pa.compress(np.diff(x, prepend=np.int32(0)).astype(np.int32).tobytes(), "zstd", asbytes=True) for x in parts], pa.binary()),
                pa.array([len(x) for x in parts], pa.int32()),
            ],
            ["block", "part", "n"],
        )


def _count(keys_of: Callable, bits: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for keys in keys_of(batch):
                held.append(keys)
                n += len(keys)
                if n >= PART_KEYS:
                    yield from _ship(np.concatenate(held), bits)
                    held, n = [], 0
        if n:
            yield from _ship(np.concatenate(held), bits)

    return task


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by block: two bit sets are held at a time."""
    size = 1 << BLOCK_BITS
    now, once, twice = None, None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    for batch in batches:
        for block, part, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            if block != now:
                if now is not None:
                    yield done()
                now, once, twice = block, np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
            low = np.cumsum(np.frombuffer(pa.decompress(part.as_buffer(), decompressed_size=4 * n, codec="zstd"), dtype=np.int32))
            at = low >> 1
            twice[at] |= once[at] | (low & 1 == 1)
            once[at] = True
    if now is not None:
        yield done()


def repeated(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], expected: float) -> Repeated:
    """Sketch the keys that keys_of yields for the rows of df; expected: about how many there are."""
    bits = bits_for(expected)
    parts = df.mapInArrow(lean(_count(keys_of, bits)), _PART)
    n_blocks = DEPTH << max(0, bits - BLOCK_BITS)
    tasks = max(1, min(n_blocks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    folded = parts.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(_fold, "block int, bits binary")
    rows = [np.zeros(max(1 << bits, 1 << BLOCK_BITS) >> 3, dtype=np.uint8) for _ in range(DEPTH)]
    per_row = max(1, 1 << (bits - BLOCK_BITS))
    for batch in folded.toLocalIterator():
        row, at = divmod(batch["block"], per_row)
        size = 1 << (BLOCK_BITS - 3)
        rows[row][at * size : (at + 1) * size] = np.frombuffer(batch["bits"], dtype=np.uint8)
    return Repeated(bits, rows)


def members(df: DataFrame, column: str, expected: float) -> Repeated:
    """Bits that hold every (non-null) long of the column, and other keys seldom."""

    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield np.repeat(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), 2)

    return repeated(df.select(column), keys_of, expected)


def text_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes of all texts: what sketches are sized by."""
    return df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
