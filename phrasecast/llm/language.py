"""Language identification by segmentation-marginalised unigrams.

Each language has its own probabilities for the pieces of a fixed public vocabulary. A word's probability under a
language is the sum over all its segmentations into pieces, from the forward algorithm; a text is scored by the product
over its words. Probabilities are learned by expectation-maximisation from a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from phrasecast.llm.common import crc_remainder, ship, small_batches
from phrasecast.session import materialize

#: Runs of letters; everything else is no evidence of a language.
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: A character that is no piece of the vocabulary still has this probability, as one more piece.
RARE = 1e-7
#: Borders of the training sample are broadcast up to this many languages (rows of two values), joined by shuffle beyond.
BROADCAST_LANGUAGES = 10_000


class Pieces:
    """The vocabulary as a hash table over (hash of a substring), so that many words are segmented at once."""

    def __init__(self, pieces: list[str]):
        self.longest = max((len(p) for p in pieces), default=1)
        keys = np.array([_hash_one(p) for p in pieces], dtype=np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ids, self.n = keys[order], order.astype(np.int64), len(pieces)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of substrings by hash; the vocabulary's size where there is none."""
        at = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == hashes, self.ids[at], self.n)


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _hash_one(piece: str) -> int:
    h = 0
    for ch in piece:
        h = ((h * int(_MULTIPLIER)) + ord(ch) + 1) % (1 << 64)
    return h


def load_pieces(path: str | None = None) -> list[str]:
    """Plain pieces of a sentencepiece model; by default that of the installed public vocabularies."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_unknown(i) or model.is_control(i) or model.is_byte(i)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not special(i)}
    return sorted(p for p in found if LETTERS.fullmatch(p.replace("▁", "a")))


def _padded(words: list[str]) -> np.ndarray:
    """Code points of the words, each behind the mark of a word start; all words have one length."""
    flat = np.frombuffer("".join("▁" + w for w in words).encode("utf-32-le"), dtype=np.uint32)
    return flat.reshape(len(words), -1).astype(np.uint64)


def _lattice(pieces: Pieces, chars: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(end, length, ids) of all substrings up to the longest piece, by end."""
    n, width = chars.shape
    with np.errstate(over="ignore"):
        for end in range(1, width + 1):
            h, power = np.zeros(n, dtype=np.uint64), np.uint64(1)
            for length in range(1, min(pieces.longest, end) + 1):
                h = h + (chars[:, end - length] + np.uint64(1)) * power
                power = power * _MULTIPLIER
                yield end, length, pieces.find(h)


def _ending(pieces: Pieces, chars: np.ndarray, end: int) -> np.ndarray:
    """Ids of the substrings that end before ``end``, by length from 1 on; a single unknown character is the last row."""
    found = np.empty((min(pieces.longest, end), len(chars)), dtype=np.int64)
    h, power = np.zeros(len(chars), dtype=np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for length in range(1, len(found) + 1):
            h = h + (chars[:, end - length] + np.uint64(1)) * power
            power = power * _MULTIPLIER
            found[length - 1] = pieces.find(h)
    found[0][found[0] == pieces.n] = pieces.n + 1
    return found


@dataclass(frozen=True)
class Model:
    """``probability``: (pieces + 2) x languages. The last two rows: no piece (0), and a character that is no piece."""

    languages: tuple[str, ...]
    prior: np.ndarray
    probability: np.ndarray
    pieces: Pieces

    def forward(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word (all of one length) under each language."""
        chars = _padded(words)
        n, width = chars.shape
        alpha = np.zeros((width + 1, n, len(self.languages)))
        alpha[0] = 1.0
        scale = np.zeros((n, len(self.languages)))
        scaled = 0
        for end, length, ids in _lattice(self.pieces, chars):
            p = self.probability[ids]
            if length == 1:
                p = np.where((ids == self.pieces.n)[:, None], self.probability[-1], p)
            alpha[end] += alpha[end - length] * p
            if end - scaled >= 16 and length == min(self.pieces.longest, end):
                top = np.maximum(alpha[end], 1e-300)
                scale += np.log(top)
                alpha[max(0, end - self.pieces.longest) : end + 1] /= top
                scaled = end
        return np.log(np.maximum(alpha[width], 1e-300)) + scale

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in the words (one length), weighted by their counts per language.

        Forward and backward sums are logarithms, so words of any length have weight. The lattice is looked up again on
        the way back instead of being kept: memory is two numbers per character and language.
        """
        chars = _padded(words)
        n, width = chars.shape
        with np.errstate(divide="ignore"):
            log_p = np.log(self.probability)
        out = np.zeros(self.probability.shape)
        forward, backward = np.zeros((width + 1, n, len(self.languages))), np.full((width + 1, n, len(self.languages)), -np.inf)
        backward[width] = 0.0
        for end in range(1, width + 1):
            ids = _ending(self.pieces, chars, end)
            forward[end] = np.logaddexp.reduce(forward[end - len(ids) : end][::-1] + log_p[ids], axis=0)
        for end in range(width, 0, -1):
            ids = _ending(self.pieces, chars, end)
            before = slice(end - len(ids), end)
            onward = log_p[ids] + backward[end]
            backward[before] = np.logaddexp(backward[before], onward[::-1])
            mass = np.exp(forward[before][::-1] + onward - forward[width]) * counts
            for j in range(out.shape[1]):
                out[:, j] += np.bincount(ids.ravel(), weights=mass[..., j].ravel(), minlength=out.shape[0])
        return out


def _by_length(words: list[str], most: int = 20_000) -> Iterator[list[int]]:
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    start = 0
    for i in range(1, len(order) + 1):
        wide = len(words[order[start]]) if order else 0
        if i == len(order) or len(words[order[i]]) != wide or (i - start) * (wide + 1) >= most * 8:
            yield order[start:i]
            start = i


def _sample(rows: DataFrame, rows_per_language: int) -> DataFrame:
    """The ``rows_per_language`` rows (``h, l, t``) of smallest hash of each language, ties of the last one included.

    Only hashes are shuffled: texts are compared with the last hash of their language where they are read. The borders, a
    row per language, are broadcast up to ``BROADCAST_LANGUAGES`` of them.
    """
    place = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    top = rows.select("h", "l").withColumn("n", place).filter(F.col("n") <= rows_per_language)
    borders = materialize(top.groupBy("l").agg(F.max("h").alias("last")), "language-borders")
    few = borders.count() <= BROADCAST_LANGUAGES
    return rows.join(F.broadcast(borders) if few else borders, "l").filter("h <= last")


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    vocabulary: str | None = None, rows_per_language: int = 800, rounds: int = 3,
) -> Model:
    """Fit on at most ``rows_per_language`` rows of each language, those of smallest id hash (the documented bound).

    Word counts of these rows are summed by Spark; the driver gets the counts of the sample's words only. Rows with
    null text or language teach nothing; without any, the model knows no language and everything is ``und``. Rows equal in
    id and text to the last one within the bound teach as well.
    """
    pieces = Pieces(load_pieces(vocabulary))
    rows = docs.select(
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(lang_col).alias("l"), F.col(text_col).alias("t")
    ).filter("t IS NOT NULL AND l IS NOT NULL")
    sample = _sample(rows, rows_per_language)
    found = sample.select("l", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
    table = found.groupBy("w", "l").agg(F.count(F.lit(1)).alias("n")).toArrow()
    seen = [x for x in zip(*(table[c].to_pylist() for c in ("w", "l", "n")), strict=True) if LETTERS.fullmatch(x[0])]
    languages = tuple(sorted({x[1] for x in seen}))
    words = {w: i for i, w in enumerate(sorted({x[0] for x in seen}))}
    place_of = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((len(words), len(languages)))
    for w, lang, n in seen:
        counts[words[w], place_of[lang]] = n
    known = list(words)
    shape = (pieces.n + 2, len(languages))
    flat = np.full(shape, 1.0 / max(pieces.n, 1))
    flat[-2], flat[-1] = 0.0, RARE
    model = Model(languages, np.full(len(languages), 1.0 / max(len(languages), 1)), flat, pieces)
    for _ in range(rounds if languages else 0):
        uses = np.zeros(shape)
        for group in _by_length(known, most=1_000):
            uses += model.expected([known[i] for i in group], counts[group])
        uses[-2:] = 0.0
        smooth = uses + 0.01
        probability = smooth / smooth[: pieces.n].sum(axis=0)
        probability[-2], probability[-1] = 0.0, RARE
        model = Model(languages, model.prior, probability, pieces)
    return model


def score_words(model: Model, words: list[str]) -> np.ndarray:
    out = np.zeros((len(words), len(model.languages)))
    for group in _by_length(words):
        out[group] = model.forward([words[i] for i in group])
    return out


class _Memo(dict):
    """Numbers words in order of first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _score_batches(batches: Iterator[pa.RecordBatch], model: Model, text_at: int, kept: int, most_words: int = 400_000) -> Iterator[pa.RecordBatch]:
    """The first ``kept`` columns and the two new ones; column ``text_at`` has the texts."""
    memo, scores = _Memo(), np.zeros((0, len(model.languages)))
    for batch in batches:
        best, value = [], []
        for at in range(0, batch.num_rows, 64):
            texts = batch.column(text_at).slice(at, 64).to_pylist()
            found = [LETTERS.findall((t or "").lower()) for t in texts]
            ids = [np.fromiter(map(memo.__getitem__, w), dtype=np.int64, count=len(w)) for w in found]
            if len(memo) > len(scores):
                fresh = list(memo)[len(scores) :]
                scores = np.concatenate([scores, score_words(model, fresh)])
            for i in ids:
                if not len(i) or not model.languages:
                    best.append(UNKNOWN)
                    value.append(0.0)
                    continue
                total = scores[i].sum(axis=0) + np.log(model.prior)
                odds = np.exp(total - total.max())
                best.append(model.languages[int(np.argmax(total))])
                value.append(float(odds.max() / odds.sum()))
            if len(memo) > most_words:
                memo, scores = _Memo(), scores[:0]
        columns = [pa.array(best, pa.string()), pa.array(value, pa.float64())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *columns], [*batch.schema.names[:kept], "lang_pred", "score"])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (probability of that language among the learned ones) to every row.

    Null texts and texts without letters get ``und`` and 0. The whole text is read; words are scored once per task and
    looked up afterwards, from a memory of bounded size. All columns come back; ``lang_pred`` and ``score`` replace
    columns of that name.
    """
    spark = docs.sparkSession
    ship(spark)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = spark.sparkContext.broadcast(model)  # vocabulary x languages: bounded by the public vocabulary
    # The text goes to Python once, also where it comes back.
    rows = docs.select(*kept) if text_col in kept else docs.select(*kept, F.col(text_col).alias("__text"))
    at = kept.index(text_col) if text_col in kept else len(kept)
    small_batches(spark)
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(lambda batches: _score_batches(batches, shared.value, at, len(kept)), schema)


def report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Train on the rows that are not held out, and predict all: ``doc_id, held_out, lang_pred, score``."""
    rows = docs.withColumn("held_out", crc_remainder("doc_id", 4) == 2)
    model = train(rows.filter(~F.col("held_out")), vocabulary=vocabulary)
    return identify(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
