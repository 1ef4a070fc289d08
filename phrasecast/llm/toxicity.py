"""Toxicity by non-negative positive-unlabelled learning.

A logistic classifier over hashed words is fitted to confirmed toxic texts and to texts of unknown kind. Its risk is
that of the positives, weighted by the class prior, plus that of the unlabelled texts as negatives less the part of it
that the positives among them explain; where this second part falls below zero, the step goes back (Kiryo et al. 2017).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from phrasecast.llm.common import crc_remainder, ship

BITS = 18
_WORDS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Classifier:
    weights: np.ndarray
    bias: float


class _Slots(dict):
    """Hash slots of a word and of its beginnings (so that inflected forms share evidence)."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        names = {word, *(f"{word[:k]}-" for k in (4, 5, 6) if len(word) >= k)}
        self[word] = found = tuple(xxhash.xxh3_64_intdigest(n) & ((1 << BITS) - 1) for n in names)
        return found


def features(text: str | None, slots: _Slots) -> np.ndarray:
    """Hash slots of the distinct words of a text and of their beginnings."""
    if len(slots) > 300_000:
        slots.clear()
    words = set(_WORDS.findall((text or "").lower()))
    return np.unique(np.fromiter(chain.from_iterable(map(slots.__getitem__, words)), dtype=np.int32))


def fit(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 400, rate: float = 0.05,
    decay: float = 4e-4, beta: float = 0.0, gamma: float = 1.0, screen: float = 5.0, lift: float = 3.0, least: int = 3,
) -> Classifier:
    """Full-batch Adam on the non-negative risk; word features count 1.

    Only words take part whose gradient at the constant classifier is more than ``screen`` standard errors below zero
    (the others cannot be told from chance in a sample of this size) and that are ``lift`` times as frequent among the
    positives as in unlabelled text. ``least`` is the number of different positive texts that must hold a word, whatever
    the size of the sample; texts with the same words are copies and count once.
    """
    size = 1 << BITS
    rows = positive + unlabelled
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.concatenate([np.zeros(0, np.int32), *rows])
    row = np.repeat(np.arange(len(rows)), lengths)
    is_pos = np.arange(len(rows)) < len(positive)
    n_pos, n_unl = max(len(positive), 1), max(len(unlabelled), 1)
    in_pos = np.bincount(flat[is_pos[row]], minlength=size) / n_pos
    in_unl = np.bincount(flat[~is_pos[row]], minlength=size) / n_unl
    different = {r.tobytes(): r for r in positive}.values()
    texts = np.bincount(np.concatenate([np.zeros(0, np.int32), *different]), minlength=size)
    pooled = (in_pos * n_pos + in_unl * n_unl + 0.5) / (n_pos + n_unl + 1)
    error = np.sqrt(pooled * (1 - pooled) * (1 / n_pos + 1 / n_unl))
    used = ((in_pos - in_unl > screen * error) & (in_pos > lift * in_unl) & (texts >= least))[flat]
    slot, flat = np.unique(flat[used], return_inverse=True)
    row, k = row[used], len(slot)
    w, b = np.zeros(k), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for t in range(1, epochs + 1):
        z = np.bincount(row, weights=w[flat], minlength=len(rows)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        as_negative = np.logaddexp(0, z)
        negative_part = as_negative[~is_pos].sum() / n_unl - prior * as_negative[is_pos].sum() / n_pos
        gain = np.where(is_pos, -prior * p / n_pos, p / n_unl)  # of the part of the negatives
        if negative_part >= -beta:
            grad = gain + np.where(is_pos, prior * (p - 1) / n_pos, 0.0)
        else:
            grad = -gamma * gain
        gw = np.bincount(flat, weights=grad[row], minlength=k) + decay * w
        gb = grad.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= rate * fix * m / (np.sqrt(v) + 1e-8)
        b -= rate * fix * mb / (np.sqrt(vb) + 1e-8)
    weights = np.zeros(size)
    weights[slot] = w
    return Classifier(weights, float(b))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_positive: int = 1500, max_unlabelled: int = 6000, prior: float | None = None,
) -> Classifier:
    """Fit on bounded samples: the rows of smallest id hash among confirmed toxic ones, and among all others.

    ``prior`` is the share of toxic texts; by default the share among the labelled rows given, kept within 0.001 and
    0.5. Null labels and ids teach nothing; repeated labels of an id count once, toxic if any is. Without positives
    every text scores the prior.
    """
    ship(docs.sparkSession)
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__toxic"))
    share = known.agg(F.avg(F.col("__toxic").cast("double"))).first()[0]
    prior = min(max(prior if prior is not None else share or 0.001, 0.001), 0.5)
    order = F.xxhash64("__id")
    pos = known.filter("__toxic = 1").orderBy(order, "__id").limit(max_positive).select("__id")
    ids = docs.select(F.col(id_col).alias("__id")).filter("__id IS NOT NULL").distinct()
    unl = ids.join(known.filter("__toxic = 1"), "__id", "left_anti").orderBy(order, "__id").limit(max_unlabelled)
    chosen = pos.withColumn("__p", F.lit(True)).union(unl.withColumn("__p", F.lit(False)))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots()
        for batch in batches:
            found = [features(t, slots).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], ["__id", "__p", "f"])

    kind = dict(rows.dtypes)["__id"]
    sample = rows.mapInArrow(hashed, f"__id {kind}, __p boolean, f array<int>").toArrow().to_pandas()
    sample = sample.drop_duplicates("__id").sort_values("__id")
    rows_of = lambda x: [np.asarray(f, np.int32) for f in x]
    return fit(rows_of(sample.f[sample["__p"]]), rows_of(sample.f[~sample["__p"]]), prior)


def score(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on); null and empty texts score by the bias alone.

    The whole text is read; all columns come back, and columns named ``score`` or ``predicted`` are replaced.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, m = _Slots(), shared.value
        for batch in batches:
            z = np.array([m.weights[features(t, slots)].sum() + m.bias for t in batch.column(0).to_pylist()], dtype=float)
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            columns = [pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*batch.schema.names[1:], "score", "predicted"])

    rows = docs.select(F.col(text_col).alias("__text"), *kept)
    return rows.mapInArrow(run, docs.select(*kept).schema.add("score", "double").add("predicted", "integer"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels that are not held out, and score all: ``doc_id, held_out, score, predicted``."""
    rows = docs.select("doc_id", "text").withColumn("held_out", crc_remainder("doc_id", 5) == 0)
    model = train(rows.filter(~F.col("held_out")), labels.filter(crc_remainder("doc_id", 5) != 0))
    return score(rows, model).select("doc_id", "held_out", "score", "predicted")
