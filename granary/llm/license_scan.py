"""License scans: a set-similarity join of text blocks with license templates.

Tokens are ordered by how often they occur in the whole corpus, rarest first.
A block holds share c of a template's tokens only if it has one of the
template's rarest |T| - ceil(c|T|) + 1 tokens (prefix filter), at least
ceil(c|T|) words (length filter) and, from its first shared token on, that many
tokens of the order left (positional filter).  Pairs that pass all three are
verified exactly, so the join finds every block over the threshold and no other.

The templates are parameters of a bounded size and travel with the tasks; only
the counts of their tokens (one row per token) come back from the corpus pass.
Blocks are the lines and, once more, the whole document whatever its line ends.
Both are cut into windows of twice the longest template, each starting one
longest template after the last, so that a passage of a template's length always
lies whole in one window, wrapped or not.

Results for odd input: a null text is empty; texts without words give 0, null
positions and empty labels; an empty table gives no rows; rows that share an id
are scanned each for itself.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from ._shared import documents, id_out, keyed

#: Templates of different licenses differ by one word in seven (cc by nc 4 0, cc by sa 4 0): a lower threshold would take one for the other.
THRESHOLD = 0.9
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under the apache license 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under the gnu general public license", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
_BLOCKS = "array<struct<label:string,start:long,end:long,containment:double>>"


def tokens(text: str) -> list[bytes]:
    data = B.LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]
    start, end, _ = B.words(data, np.array([0, len(data)]), B.ALNUM)
    return [data[a:b].tobytes() for a, b in zip(start, end, strict=True)]


def _hash(word: bytes) -> int:
    data = np.frombuffer(word, dtype=np.uint8)
    return int(B.word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def _scan(batch: pa.RecordBatch):
    for a, b, data, offsets in B.slices(batch):
        data = B.LOWER[data] if len(data) else data
        start, end, doc = B.words(data, offsets, B.ALNUM)
        yield a, b, data, offsets, start, doc, B.word_hashes(data, start, end) if len(start) else np.empty(0, np.uint64)


def _token_counts(vocabulary: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            for *_, hashes in _scan(batch):
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                total += np.bincount(at[vocabulary[at] == hashes], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["token", "n"])

    return task


class _Templates:
    """The templates with their tokens ordered rarest first, and the prefixes that select candidates."""

    def __init__(self, templates, vocabulary: np.ndarray, counts: np.ndarray, threshold: float):
        order = np.empty(len(vocabulary), dtype=np.int64)
        order[np.lexsort((vocabulary, counts))] = np.arange(len(vocabulary))  # rank of each token, ties by hash
        self.vocabulary, self.order = vocabulary, order
        self.labels = [label for _, label in templates]
        sets = [np.unique(np.searchsorted(vocabulary, np.array([_hash(w) for w in tokens(t)], dtype=np.uint64))) for t, _ in templates]
        self.size = np.array([len(x) for x in sets])
        self.need = np.array([max(1, math.ceil(threshold * n - 1e-9)) for n in self.size])
        self.member = np.zeros((len(sets), len(vocabulary)), dtype=np.int32)  # by rank
        self.prefix = np.zeros((len(vocabulary), len(sets)), dtype=bool)
        for k, x in enumerate(sets):
            ranks = np.sort(order[x])
            self.member[k, ranks] = 1
            self.prefix[ranks[: len(ranks) - self.need[k] + 1], k] = True
        self.stride = max(len(tokens(t)) for t, _ in templates)

    def blocks(self, data, offsets, start, doc, across):
        """The line of each word (or, across lines, its document) and the window in it."""
        newline = np.flatnonzero(data == 10) if not across else np.empty(0)
        edge = np.unique(np.r_[newline, offsets[1:-1] - 0.5])  # a document's end also ends a line
        line = np.searchsorted(edge, start)
        first = np.searchsorted(line, line)
        window = (np.arange(len(start)) - first) // self.stride
        return line, window

    def found(self, data, offsets, start, doc, hashes, across):
        """(document, template, first word, end word, containment) of each block over the threshold; words count from the slice."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        word = np.flatnonzero(self.vocabulary[at] == hashes)
        if not len(word):
            return []
        rank = self.order[at[word]]
        line, window = self.blocks(data, offsets, start, doc, across)
        wide = int(window.max()) + 2
        home = line[word] * wide + window[word] + 1
        # Each word lies in the window that starts at its stride and in the one before (the 0th only has the line's first stride).
        block, rank, word = np.r_[home, home - 1], np.r_[rank, rank], np.r_[word, word]
        blocks, of = np.unique(block, return_inverse=True)
        have = np.zeros((len(blocks), len(self.vocabulary)), dtype=bool)
        have[of, rank] = True
        maybe = np.flatnonzero(have[:, self.prefix.any(axis=1)].any(axis=1))
        if not len(maybe):
            return []
        have = have[maybe].astype(np.int32)
        pairs = (have @ self.prefix.astype(np.int32)) > 0  # prefix filter
        n_line = np.bincount(line, minlength=int(line.max()) + 1)
        here, w = np.divmod(blocks[maybe], wide)
        n_words = np.minimum(n_line[here], 2 * self.stride)
        pairs &= n_words[:, None] >= self.need[None, :]  # length filter
        left = np.cumsum(have[:, ::-1], axis=1)[:, ::-1]  # positional filter: tokens of the order from the first shared one on
        for b, t in zip(*np.nonzero(pairs), strict=True):
            if left[b, np.argmax(have[b] * self.member[t])] < self.need[t]:
                pairs[b, t] = False
        share = have @ self.member.T
        out = []
        for b, t in zip(*np.nonzero(pairs & (share >= self.need)), strict=True):
            key = blocks[maybe[b]]
            mine = word[(block == key) & (self.member[t, rank] == 1)]
            out.append((int(doc[mine[0]]), int(t), int(mine.min()), int(mine.max()) + 1, float(share[b, t] / self.size[t])))
        return out


def _match(templates: _Templates, phrases):
    wanted = [(np.array([_hash(w) for w in tokens(p)], dtype=np.uint64), label) for p, label in phrases]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_words, n_base = np.zeros(n, np.int64), np.zeros(n, np.int64)
            first, last = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
            base: dict[int, set[str]] = {}
            blocks: dict[int, list[dict]] = {}
            for a, b, data, offsets, start, doc, hashes in _scan(batch):
                n_words[a:b] = np.bincount(doc, minlength=b - a)
                head = np.cumsum(n_words[a:b]) - n_words[a:b]
                for phrase, label in wanted:
                    at = np.flatnonzero(hashes[: len(hashes) - len(phrase) + 1] == phrase[0]) if len(hashes) >= len(phrase) else np.empty(0, np.int64)
                    for k in range(1, len(phrase)):
                        at = at[hashes[at + k] == phrase[k]]
                    at = at[doc[at] == doc[at + len(phrase) - 1]]
                    for d, x in zip((doc[at] + a).tolist(), (at - head[doc[at]]).tolist(), strict=True):
                        n_base[d] += 1
                        first[d] = x if first[d] < 0 else min(first[d], x)
                        last[d] = max(last[d], x)
                        base.setdefault(d, set()).add(label)
                for d, t, x, y, c in (x for across in (False, True) for x in templates.found(data, offsets, start, doc, hashes, across)) if len(hashes) else ():
                    blocks.setdefault(a + d, []).append({"label": templates.labels[t], "start": x - int(head[d]), "end": y - int(head[d]), "containment": c})
            base_labels = [",".join(sorted(base.get(d, ()))) for d in range(n)]
            labels = [",".join(sorted(base.get(d, set()) | {x["label"] for x in blocks.get(d, ())})) for d in range(n)]
            score = [1.0 if d in base else max((x["containment"] for x in blocks.get(d, ())), default=0.0) for d in range(n)]
            found = [sorted({tuple(x.values()): x for x in blocks.get(d, ())}.values(), key=lambda x: (x["start"], x["end"], x["label"])) for d in range(n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_base), pa.array(first, mask=first < 0), pa.array(last, mask=last < 0), pa.array(base_labels, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64()),
                 pa.array(found, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())])))],
                ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"],
            )

    return task


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """Returns id_col, n_words, n_base, first_word, last_word, base_labels, labels, score and blocks (the matches)."""
    docs = keyed(df, id_col, text_col)
    vocabulary = np.unique(np.array([_hash(w) for t, _ in templates for w in tokens(t)], dtype=np.uint64))
    counts = np.zeros(len(vocabulary), dtype=np.int64)
    for row in docs.mapInArrow(_token_counts(vocabulary), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        counts[row["token"]] = row["n"]
    ordered = _Templates(templates, vocabulary, counts, threshold)
    out = docs.mapInArrow(_match(ordered, phrases), f"id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks {_BLOCKS}")
    return out.withColumn("id", id_out(id_col)).withColumnRenamed("id", id_col)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).drop("blocks")
