"""Language identification by unigrams over pieces, all segmentations summed.

A language is a distribution over the pieces of a fixed public vocabulary.  The
probability of a word is the sum over every way to cut it into pieces, by the
forward algorithm; a text's is the product over its words (runs of letters,
ASCII lower-cased, each after a space).  The distributions are fitted by
expectation maximisation over the same sums, on a bounded sample of labelled
documents: about PER_LANGUAGE different texts a language, drawn by a hash of the
text, all of them where there are no more; whole texts; of more than MOST_LANGUAGES values those with the most documents are
learnt.  Every document is then scored whole; words are scored once per slice of
texts and looked up from there.

Single bytes are pieces of every vocabulary, so any word has a segmentation.
Words over MAX_WORD bytes (text without blanks, say) are parted where no piece
can stand across; the sum over all segmentations is exactly the product of the
parts' sums.  A part that is still longer is summed place by place, rescaled on
the way.

Results for odd input: a null text, an empty one and one without letters are
`und` with score 0; null languages teach nothing; with nothing to learn from
every text is `und`; ties go to the language that comes first by name; an empty
table gives no rows; rows that share an id are scored each for itself.  Other
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from ._shared import documents, id_out, keyed, named, over_rows

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
PER_LANGUAGE = 400
ROUNDS = 3
MOST_LANGUAGES = 1000
#: Bytes up to which words are summed side by side.
MAX_WORD = 40
SMOOTH = 0.01
#: Probabilities are held times GROW per byte, so that a product over a longest word stays a normal number.
GROW = 32.0
SLICE = 1 << 20
#: Word scores (words times languages) that a task keeps between slices.
KEPT_SCORES = 1 << 20
#: Words of one length, times languages, that are scored at once.
CHUNK = 1 << 14
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a sentencepiece model that can match in lower-case words, and all single bytes; the word mark is a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {bytes([b]) for b in range(256)}
    for k in range(model.get_piece_size()):
        if not (model.is_control(k) or model.is_byte(k) or model.is_unknown(k)):
            piece = model.id_to_piece(k).replace("▁", " ").encode()
            if all(LETTERS[b] and not 65 <= b <= 90 for b in piece.removeprefix(b" ")):
                pieces.add(piece)
    return sorted(pieces)


class Pieces:
    """A vocabulary as a sorted table of hashes, which grow byte by byte."""

    def __init__(self, pieces: list[bytes]):
        self.lengths = np.array([len(p) for p in pieces], dtype=np.float64)
        hashes = np.zeros(len(pieces), dtype=np.uint64)
        for n in np.unique(self.lengths).astype(np.int64):
            of = np.flatnonzero(self.lengths == n)
            rows = np.frombuffer(b"".join(pieces[k] for k in of.tolist()), dtype=np.uint8).reshape(-1, n)
            for c in range(n):
                hashes[of] = self.grown(hashes[of], rows[:, c])
        self.by = np.argsort(hashes)
        self.hashes = hashes[self.by]
        self.sizes = set(self.lengths.astype(np.int64).tolist())
        self.longest = max(self.sizes)

    @staticmethod
    def grown(hashes: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return B.joined(hashes, B.byte_values(byte))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.by[at], len(self.by))

    def lattice(self, words: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """words: (words, bytes), all of one length; the piece of each span (start, end), or the number of pieces where there is none."""
        n, size = words.shape
        out = {}
        for i in range(size):
            now = np.zeros(n, dtype=np.uint64)
            for j in range(i + 1, min(size, i + self.longest) + 1):
                now = self.grown(now, words[:, j - 1])
                if j - i in self.sizes:
                    out[i, j] = self.find(now)
        return out

    def along(self, data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(length, piece at each place) over a run of bytes, for each length of pieces."""
        now = np.zeros(len(data), dtype=np.uint64)
        for n in range(1, min(self.longest, len(data)) + 1):
            now = self.grown(now[: len(data) - n + 1], data[n - 1 :])
            if n in self.sizes:
                yield n, self.find(now)

    def parts(self, data: np.ndarray) -> list[np.ndarray]:
        """data cut at every place that no piece can stand across."""
        across = np.zeros(len(data) + 1, dtype=np.int64)
        for n, piece in self.along(data):
            at = np.flatnonzero(piece < len(self.by)) if n > 1 else np.empty(0, np.int64)
            np.add.at(across, at + 1, 1)
            np.add.at(across, at + n, -1)
        return np.split(data, np.flatnonzero(np.cumsum(across)[1:-1] == 0) + 1)


def _forward(lattice, size: int, p: np.ndarray) -> np.ndarray:
    """(positions, words, languages); p: (pieces + 1, languages), the last row 0."""
    n = len(lattice[0, 1])
    alpha = np.zeros((size + 1, n, p.shape[1]))
    alpha[0] = 1.0
    for (i, j), piece in sorted(lattice.items(), key=lambda x: x[0][1]):
        use = np.flatnonzero(piece < len(p) - 1)
        if len(use):
            alpha[j, use] += alpha[i, use] * p[piece[use]]
    return alpha


def _sums(found: list[tuple[int, np.ndarray]], p: np.ndarray, size: int, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Forward (or backward) sums of one long run: (positions, languages), each position times exp of its scale.

    found: what Pieces.along gives.  Sums are divided by their greatest every few places, which the scale remembers.
    """
    lengths = np.array([n for n, _ in found])
    at = np.full((len(found), size + 1), len(p) - 1)  # piece that ends (begins) at a place, by length
    for k, (n, piece) in enumerate(found):
        at[k, : size - n + 1 if back else size + 1][-len(piece) :] = piece
    out, scale = np.zeros((size + 1, p.shape[1])), np.zeros((size + 1, p.shape[1]))
    first, step = (size, -1) if back else (0, 1)
    out[first] = 1.0
    held = np.zeros(p.shape[1])
    for k in range(1, size + 1):
        j = first + step * k
        use = np.flatnonzero((at[:, j] < len(p) - 1) & (lengths <= k))
        i = j - step * lengths[use]
        out[j] = (out[i] * np.exp(scale[i] - held) * p[at[use, j]]).sum(axis=0)
        if k % 16 == 0:
            more = np.log(np.maximum(out[j], 1e-300))
            out[j] = np.where(out[j] > 0, 1.0, 0.0)
            held = held + more
        scale[j] = held
    return out, scale


def _grown(p: np.ndarray, pieces: Pieces) -> np.ndarray:
    return np.vstack([p * (GROW ** pieces.lengths)[:, None], np.zeros((1, p.shape[1]))])


def _rows(words: list[np.ndarray], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indexes, matrix) of the words of each length, `most` at once."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    for k in np.unique(size):
        for of in np.array_split(np.flatnonzero(size == k), max(1, -(-int((size == k).sum()) // most))):
            yield of, np.stack([words[i] for i in of.tolist()])


def score_words(pieces: Pieces, p: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """log P(word) per language, summed over all segmentations."""
    out = np.zeros((len(start), p.shape[1]))
    grown = _grown(p, pieces)
    most = max(16, CHUNK // max(1, p.shape[1]))
    size = end - start

    def add(of: np.ndarray, rows: np.ndarray) -> None:
        n = rows.shape[1]
        np.add.at(out, of, np.log(np.maximum(_forward(pieces.lattice(rows), n, grown)[n], 1e-300)) - n * np.log(GROW))

    for k in np.unique(size[size <= MAX_WORD]):
        for of in np.array_split(np.flatnonzero(size == k), max(1, -(-int((size == k).sum()) // most))):
            rows = np.full((len(of), k + 1), 32, dtype=np.uint8)
            rows[:, 1:] = data[start[of][:, None] + np.arange(k)]
            add(of, rows)
    home, parts = [], []
    for k in np.flatnonzero(size > MAX_WORD).tolist():
        for part in pieces.parts(np.r_[np.uint8(32), data[start[k] : end[k]]]):
            if len(part) <= MAX_WORD + 1:
                home.append(k)
                parts.append(part)
            else:
                last, scale = (x[-1] for x in _sums(list(pieces.along(part)), grown, len(part)))
                out[k] += np.log(np.maximum(last, 1e-300)) + scale - len(part) * np.log(GROW)
    for of, rows in _rows(parts, most):
        add(np.array(home)[of], rows)
    return out


def fit(pieces: Pieces, words: list[bytes], counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language by expectation maximisation over all segmentations of its words."""
    m = len(pieces.lengths)
    p = np.full((m, 1), 1.0 / m)
    weights, parts, long = [], [], []
    for word, n in zip(words, counts.tolist(), strict=True):
        whole = np.frombuffer(b" " + word, dtype=np.uint8)
        for part in pieces.parts(whole) if len(word) > MAX_WORD else (whole,):
            if len(part) <= MAX_WORD + 1:
                weights.append(n)
                parts.append(part)
            else:
                long.append((n, len(part), list(pieces.along(part))))
    weights = np.array(weights)
    groups = list(_rows(parts, CHUNK // 4))
    for _ in range(rounds):
        expected = np.full(m + 1, SMOOTH)
        grown = _grown(p, pieces)
        for of, rows in groups:
            n = rows.shape[1]
            lattice = pieces.lattice(rows)
            alpha = _forward(lattice, n, grown)[:, :, 0]
            beta = np.zeros_like(alpha)
            beta[n] = 1.0
            for (i, j), piece in sorted(lattice.items(), key=lambda x: -x[0][0]):
                beta[i] += beta[j] * grown[piece, 0]
            weight = weights[of] / np.maximum(alpha[n], 1e-300)
            for (i, j), piece in lattice.items():
                expected += np.bincount(piece, alpha[i] * grown[piece, 0] * beta[j] * weight, minlength=m + 1)
        for n_words, size, found in long:
            (a, sa), (b, sb) = ((x[:, 0] for x in _sums(found, grown, size, back)) for back in (False, True))
            for n, piece in found:
                i = np.flatnonzero(piece < m)
                share = a[i] * grown[piece[i], 0] * b[i + n] / max(a[size], 1e-300) * np.exp(sa[i] + sb[i + n] - sa[size])
                expected += np.bincount(piece[i], share * n_words, minlength=m + 1)
        p = (expected[:m] / expected[:m].sum())[:, None]
    return p


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        of = batch.column(0).to_pylist()
        for a, _, data, offsets in B.slices(batch):
            data = B.LOWER[data] if len(data) else data
            start, end, doc = B.words(data, offsets, LETTERS)
            raw = data.tobytes()
            found = Counter((of[a + d], raw[x:y]) for d, x, y in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.binary()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])


def is_drawn(have: Column, per_language: int, *key: Column) -> Column:
    """Whether a text of a language with `have` different ones is in the sample of about per_language of them, by a hash of its key."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), *key), 1).cast("double") / float(1 << 63)
    return draw < F.lit(float(per_language)) / have


def train(df: DataFrame, lang_col: str, text_col: str, path: str = VOCABULARY, per_language: int = PER_LANGUAGE) -> tuple[list[str], Pieces, np.ndarray]:
    """The languages, the vocabulary and a column of piece probabilities per language.

    The sample whose word counts come to the driver has about per_language different texts a language, whatever the size of df
    and however often a text is repeated.
    """
    labelled = df.select(named(lang_col).cast("string").alias("lang"), named(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL").withColumns({"t": F.xxhash64("text"), "u": F.xxhash64(F.lit("u"), "text")})
    sizes = labelled.groupBy("lang", "t", "u").agg(F.count("*").alias("n")).groupBy("lang").agg(F.sum("n").alias("have"), F.count("*").alias("texts")).orderBy(F.desc("have"), "lang").limit(MOST_LANGUAGES).collect()
    sizes = F.broadcast(df.sparkSession.createDataFrame([(r["lang"], r["texts"]) for r in sizes], "of string, texts long"))
    drawn = labelled.join(sizes, F.col("lang") == F.col("of")).where(is_drawn(F.col("texts"), per_language, F.col("t"), F.col("u")))
    drawn = drawn.groupBy("lang", "t", "u").agg(F.first("text").alias("text")).select("lang", "text")  # copies of a drawn text count once
    counts = drawn.mapInArrow(B.lean(_word_counts), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    pieces = Pieces(vocabulary(path))
    languages = sorted(counts["lang"].unique().tolist(), key=lambda x: x.encode())
    p = [fit(pieces, [bytes(w) for w in own["word"]], own["n"].to_numpy(dtype=np.float64)) for own in (counts[counts["lang"] == x].sort_values("word", ignore_index=True) for x in languages)]
    return languages, pieces, np.hstack(p) if p else np.zeros((len(pieces.lengths), 0))


def _predict(model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, pieces, p = model.value
        known, known_scores = np.empty(0, np.uint64), np.empty((0, len(languages)))
        for batch in batches:
            n = batch.num_rows
            total, any_word = np.zeros((n, len(languages))), np.zeros(n, dtype=bool)
            for a, b, data, offsets in B.slices(batch, most=SLICE):
                data = B.LOWER[data] if len(data) else data
                start, end, doc = B.words(data, offsets, LETTERS)
                if not len(start):
                    continue
                letter = (data >= 97) & (data <= 122)
                seen = np.r_[0, np.cumsum(letter)]
                sure = seen[offsets[1:]] > seen[offsets[:-1]]
                for d in np.flatnonzero(~sure & (np.bincount(doc, minlength=b - a) > 0)).tolist():
                    sure[d] = any(c.isalpha() for c in data[offsets[d] : offsets[d + 1]].tobytes().decode())
                any_word[a:b] = sure
                words, first, of = np.unique(B.word_hashes(data, start, end), return_index=True, return_inverse=True)
                at = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
                have = known[at] == words if len(known) else np.zeros(len(words), dtype=bool)
                scores = np.empty((len(words), len(languages)))
                scores[have] = known_scores[at[have]]
                new = np.flatnonzero(~have)
                if len(new):
                    scores[new] = score_words(pieces, p, data, start[first[new]], end[first[new]])
                    if (len(known) + len(new)) * len(languages) <= KEPT_SCORES:
                        known = np.r_[known, words[new]]
                        by = np.argsort(known)
                        known, known_scores = known[by], np.vstack([known_scores, scores[new]])[by]
                for k in range(len(languages)):
                    total[a:b, k] = np.bincount(doc, scores[of, k], minlength=b - a)
            best = np.argmax(total, axis=1) if languages else np.zeros(n, dtype=np.int64)
            share = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1) if languages else np.zeros(n)
            any_word &= bool(languages)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([languages[k] if ok else "und" for k, ok in zip(best.tolist(), any_word.tolist(), strict=True)], pa.string()), pa.array(np.where(any_word, share, 0.0))],
                ["id", "lang_pred", "score"],
            )

    return B.lean(task)


def identify(df: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, lang_pred and score, the posterior of that language under equal priors."""
    out = keyed(df, id_col, text_col).mapInArrow(_predict(df.sparkSession.sparkContext.broadcast(model)), "id long, lang_pred string, score double")
    return out.select(id_out(id_col), "lang_pred", "score")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(named(id_col).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, path: str = VOCABULARY):
    return train(docs.where(~held_out()), "lang", "text", path)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(df: DataFrame, model, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, whose text is in some language (not `und`)."""

    def finish(batch: pa.RecordBatch, result: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pc.not_equal(result.column(1), "und"))

    return over_rows(df, text_col, _predict(df.sparkSession.sparkContext.broadcast(model)), finish)
