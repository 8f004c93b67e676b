"""Encoding into the pieces of a merge-type sentencepiece model, and decoding, without running merges over the text.

Merges go by score, so whatever is not merged across a place stands on its own: the encoding of a prefix that ends with
a token is the tokens before it, and each prefix has exactly one last token.  A table holds that token for every prefix
of a stretch.  It is filled from the left: an automaton finds the pieces that end at a place, and of these the one is
taken that is compatible with the last token before it (the merges of the two tokens' characters give the two tokens
back; answers are kept for the next time).  The ids are then read backwards from the end.

Texts are parted where no piece can stand across (two bytes that no piece has side by side), which changes nothing in
the result; stretches that repeat are looked up.  Characters that are no piece become bytes, spaces become the word
mark, and a text gets one mark in front.  Only models of that kind are taken (identity normalisation, one dummy prefix,
byte fallback, no user-defined or unused pieces); others raise ValueError.

Results for odd input: null and empty texts are the begin and end ids alone and decode to the empty text; a null id is
returned as null; rows that share an id are encoded each for itself; texts of any length are encoded whole, in linear
time (a table of one entry a character for the longest stretch without a parting place); an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _bytes as B
from ._shared import documents, named

#: The word mark as a character and as it stands in texts.
MARK, SPACE = "▁", 32
#: Stretches whose ids, and pairs of tokens whose compatibility, a worker keeps; beyond, it starts anew.
KEPT_STRETCHES, KEPT_PAIRS = 500_000, 500_000
#: Bytes up to which a stretch is kept.
KEPT_BYTES = 64
SLICE = 1 << 20


class MergeTable:
    """A model's pieces, the automaton over them, and what is known of stretches and pairs of tokens."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        probe = "  a　 ﬁ\té "
        if model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("the model normalises texts, or adds no word mark in front")
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.ids, self.score, surface = {}, {}, [b""] * model.get_piece_size()
        self.byte_ids = {}
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_ids[int(piece[3:5], 16)] = k
                surface[k] = bytes([int(piece[3:5], 16)])
            elif model.is_unused(k):
                raise ValueError(f"unused piece {piece!r}")
            elif not (model.is_control(k) or model.is_unknown(k)):
                self.ids[piece], self.score[piece] = k, model.get_score(k)
                surface[k] = piece.replace(MARK, " ").encode()
        if len(self.byte_ids) < 256:
            raise ValueError("the model has no bytes to fall back on")
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.side_by_side = np.zeros((256, 256), dtype=bool)
        self.side_by_side[:, 0x80:0xC0] = True  # inside a character
        for k in self.ids.values():
            raw = np.frombuffer(surface[k], dtype=np.uint8)
            self.side_by_side[raw[:-1], raw[1:]] = True
        self.size = np.array([len(s) for s in surface], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.surface = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.control = np.array([model.is_control(k) for k in range(len(surface))])
        self.stretches: dict[bytes, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def compatible(self, left: str, right: str) -> bool:
        """Whether the merges of both tokens' characters, best score first and then from the left, end with these two."""
        parts, place = list(left + right), len(left)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts[0]) > place:
                break
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[left, right] = found = parts == [left, right]
        return found

    def last_tokens(self, text: str) -> list[int]:
        """For each prefix of the text, from the one of one character on, the length of the last token of its encoding."""
        last = [0] * (len(text) + 1)
        filled, pairs, compatible = 0, self.pairs, self.compatible
        for end, size in self.automaton.iter(text):
            end += 1
            while filled < end - 1:  # no piece ends here: the character is its own token
                filled += 1
                last[filled] = last[filled] or 1
            if last[end]:
                continue
            start = end - size
            if start == 0 or pairs.get(pair := (text[start - last[start] : start], text[start:end])) or (pair not in pairs and compatible(*pair)):
                last[end] = size
        while filled < len(text):
            filled += 1
            last[filled] = last[filled] or 1
        return last

    def encode_stretch(self, raw: bytes) -> bytes:
        """The ids of a stretch (spaces for marks) as little-endian 32-bit integers."""
        have = self.stretches.get(raw)
        if have is not None:
            return have
        text = raw.decode().replace(" ", MARK)
        last, at, ids, known = self.last_tokens(text), len(text), [], self.ids
        while at:
            token = text[at - last[at] : at]
            at -= last[at]
            if token in known:
                ids.append(known[token])
            else:
                ids.extend(self.byte_ids[b] for b in reversed(token.encode()))
        ids.reverse()
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(raw) <= KEPT_BYTES:
            if len(self.stretches) >= KEPT_STRETCHES:
                self.stretches.clear()
            self.stretches[raw] = found
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts data[offsets[k]:offsets[k + 1]], begin and end ids included."""
        data, offsets = marked(data, offsets)
        n = len(offsets) - 1
        cut = np.ones(len(data), dtype=bool)
        cut[1:] = ~self.side_by_side[data[:-1], data[1:]]
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(cut)
        end = np.r_[start[1:], len(data)][: len(start)]
        _, first, of = np.unique(B.word_hashes(data, start, end), return_index=True, return_inverse=True)
        raw = data.tobytes()
        found = [self.encode_stretch(raw[x:y]) for x, y in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        pool = np.frombuffer(b"".join(found), dtype="<u4")
        size = np.array([len(x) // 4 for x in found], dtype=np.int64)
        ids = ragged(pool, (np.cumsum(size) - size)[of], size[of]) if len(found) else pool
        before = np.r_[0, np.cumsum(size[of])] if len(found) else np.zeros(1, dtype=np.int64)
        inner = before[np.searchsorted(start, offsets)]
        out_offsets = inner + 2 * np.arange(n + 1)
        out = np.empty(len(ids) + 2 * n, dtype="<u4")
        held = np.ones(len(out), dtype=bool)
        held[out_offsets[:-1]] = held[out_offsets[1:] - 1] = False
        out[held] = ids
        out[out_offsets[:-1]], out[out_offsets[1:] - 1] = self.begin, self.end
        return out, out_offsets

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts of ids[offsets[k]:offsets[k + 1]]: pieces joined, the mark in front of the first left out."""
        size, at = self.size[ids], self.at[ids]
        piece = np.flatnonzero(~self.control[ids])
        first = piece[np.minimum(np.searchsorted(piece, offsets[:-1]), max(0, len(piece) - 1))] if len(piece) else np.empty(0, np.int64)
        if len(first):
            first = first[(first >= offsets[:-1]) & (first < offsets[1:])]
            first = first[(size[first] > 0) & (self.surface[np.minimum(at[first], len(self.surface) - 1)] == SPACE)]
            size[first] -= 1
            at[first] += 1
        return ragged(self.surface, at, size), np.r_[0, np.cumsum(size)][offsets]


def ragged(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start:start + size] of every row, one after another."""
    if not len(start):
        return values[:0]
    before = np.cumsum(size) - size
    return values[np.repeat(start - before, size) + np.arange(before[-1] + size[-1])]


def marked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space in front of each that is not empty, and every word mark that they hold as a space."""
    data = data.copy()
    held = np.ones(len(data), dtype=bool)
    mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
    data[mark] = SPACE
    held[mark + 1] = held[mark + 2] = False
    size = np.diff(np.r_[0, np.cumsum(held)][offsets])
    size += size > 0
    out_offsets = np.r_[0, np.cumsum(size)]
    out = np.full(out_offsets[-1], SPACE, dtype=np.uint8)
    rest = np.ones(len(out), dtype=bool)
    rest[out_offsets[:-1][size > 0]] = False
    out[rest] = data[held]
    return out, out_offsets


_tables: dict[bytes, MergeTable] = {}


def table(proto: bytes) -> MergeTable:
    """The table of a model, made once per worker."""
    key = hashlib.sha256(proto).digest()
    if key not in _tables:
        _tables.clear()
        _tables[key] = MergeTable(proto)
    return _tables[key]


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int32))).cast(pa.list_(pa.int32()))


def _texts(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    return found.cast(pa.large_string()).cast(pa.string())


def _encode(model) -> Callable:
    """(id, text) to (id, ids)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table(model.value)
        for batch in batches:
            for a, b, data, offsets in B.slices(batch, most=SLICE):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _lists(*known.encode(data, offsets))], ["id", "ids"])

    return task


def _decode(model) -> Callable:
    """(id, ids) to (id, ids, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table(model.value)
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy()[offsets[0] : offsets[-1]]
            ids, offsets = np.asarray(ids), offsets - offsets[0]
            try:
                if len(ids) and (ids.min() < 0 or ids.max() >= len(known.size) or known.model.unk_id() in ids):
                    raise ValueError
                text = _texts(*known.decode(ids, offsets))
            except (pa.ArrowInvalid, ValueError):  # unknown ids, or bytes that are no text: the model's own rules
                text = pa.array([known.model.decode(ids[x:y].tolist()) for x, y in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], ["id", "ids", "text"])

    return task


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets = batch.column(1).offsets.to_numpy()
        raw = memoryview(batch.column(1).values.to_numpy().astype("<i4", copy=False)).cast("B")
        ids = [hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        data, at = B.text_buffers(batch.column(2))
        texts = [hashlib.sha256(data[x:y]).hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def share_model(spark: SparkSession, path: str | None = None):
    """The bytes of a model file, read on the driver and sent to every executor (about half a megabyte)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Returns id_col and ids (array<int>): the ids the sentencepiece library gives, with begin and end ids."""
    rows = df.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"))
    return rows.mapInArrow(B.lean(_encode(share_model(df.sparkSession, path))), "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Returns id_col and text: what the library's decode gives for the ids (null ids: the empty text)."""
    rows = df.select(named(id_col).cast("long").alias("id"), named(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(B.lean(_decode(share_model(df.sparkSession, path))), "id long, ids array<int>, text string").select("id", "text").withColumnRenamed("id", id_col)


def op12_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded in one task, so that only digests leave it."""
    model = share_model(spark)
    rows = documents(spark, sf_dir).select(named("doc_id").cast("long").alias("id"), named("text").cast("string").alias("text"))
    both = lambda batches: _digest(_decode(model)(_encode(model)(batches)))
    return rows.mapInArrow(B.lean(both), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
