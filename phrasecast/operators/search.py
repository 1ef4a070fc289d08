"""Search for many phrases at once: words and word pairs of the texts meet an inverted table of the phrases.

``label_segments`` tries every pattern on every text. Here the cost follows the text: each word and each pair of
neighbouring words is looked up in a table of what the spellings of all phrases begin with, and only the phrases found
there are tried, so a phrase that occurs nowhere costs nothing.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from phrasecast.functions.phrases import TOKEN_CLASSES, Phrase, literal, vocabulary
from phrasecast.functions.scan import skew_join
from phrasecast.functions.text import WORD
from phrasecast.session import materialize

#: An inverted table of at most so many rows is broadcast.
BROADCAST_ROWS = 500_000
_RUN = re.compile(r"\w+")


def _beginnings(phrase: Phrase) -> set[tuple[str, bool]] | None:
    """(first word or first two words, whether that is all) of every spelling; None if one has no word."""
    split = [words for words in map(str.split, phrase.term.split("/")) if words] or [phrase.term.split()]
    out = set()
    for words in split:
        spelt = [next(spell(w) for shape, spell in TOKEN_CLASSES if shape.fullmatch(w)) for w in words[:2]]
        for forms in itertools.product(*spelt):
            runs = _RUN.findall(" ".join(forms))
            if not runs:
                return None
            whole = len(words) == 1 and len(runs) == 1 and runs[0] == forms[0]
            out.add((" ".join(runs[:2]), whole))
    return out


def phrase_index(spark: SparkSession, terms: Iterable[str]) -> tuple[DataFrame, DataFrame, list[Phrase]]:
    """The inverted table ``(key, fold, whole, phrase)``, the table ``(phrase, target, pattern, opening)``, and the phrases that have no
    word to be found by.

    ``opening`` matches the first words of the phrase's alternatives. ``whole`` marks keys that are a spelling of the phrase by themselves. Both tables are written, so that they are built once.
    """
    keys, phrases, loose = [], [], []
    for number, phrase in enumerate(vocabulary(terms)):
        found = _beginnings(phrase) if phrase.pattern else None
        if found is None:
            loose.append(phrase)
            continue
        phrases.append((number, phrase.column, phrase.pattern, "|".join(map(literal, phrase.first_words))))
        # Of two equal beginnings the one that is whole says more.
        keys += [(key, whole, number) for key, whole in dict(sorted(found)).items()]
    table = spark.createDataFrame(keys, "key string, whole boolean, phrase int").withColumn("fold", _folded(F.col("key")))
    names = spark.createDataFrame(phrases, "phrase int, target string, pattern string, opening string")
    return materialize(table, "phrase-keys"), materialize(names, "phrases"), loose


def _folded(word: Column) -> Column:
    """Letters that a pattern without case takes for equal are equal here, and perhaps some more."""
    return F.lower(F.upper(word))


def _keys(text: Column) -> Column:
    """Distinct words and pairs of neighbouring words of a text."""
    runs = F.regexp_extract_all(text, F.lit(f"{WORD}+"), F.lit(0))
    pairs = F.zip_with(runs, F.slice(runs, F.lit(2), F.size(runs)), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(runs, F.slice(pairs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0)))))


def candidates(texts: DataFrame, keys: DataFrame, row_id: str) -> DataFrame:
    """``(row_id, text, phrase, sure)``: the phrases to try on each text; ``sure`` ones need no trial.

    ``texts`` has ``row_id`` and ``text``. A phrase may come up several times for one text.
    """
    spread = texts.select(row_id, "text", F.explode(_keys(F.col("text"))).alias("seen")).withColumn("fold", _folded(F.col("seen")))
    if keys.count() <= BROADCAST_ROWS:
        met = spread.join(F.broadcast(keys), "fold")  # the text stays where it is
    else:
        # Texts are left behind and fetched again for the phrases that met them; frequent words are spread.
        listed = keys.groupBy("fold").agg(F.collect_list(F.struct("key", "whole", "phrase")).alias("phrases"))
        met = skew_join(spread.drop("text"), listed, "fold").select(row_id, "seen", F.inline("phrases")).join(texts, row_id)
    return met.select(row_id, "text", "phrase", (F.col("whole") & (F.lower("seen") == F.col("key"))).alias("sure"))


def find_phrases(
    texts: DataFrame, terms: Iterable[str], row_id: str = "segment_id", text: str = "text", prefilter: bool = True, counts: bool = False
) -> DataFrame:
    """``(row_id, target)`` for each phrase a text holds, as ``label_segments`` says it; with ``counts`` also ``n``, the number of matches.

    With ``counts`` the prefilter does not apply, as in ``Phrase.count``. NULL texts hold nothing. ``row_id`` must be unique.
    """
    keys, phrases, loose = phrase_index(texts.sparkSession, terms)
    rows = texts.select(F.col(row_id), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    # The phrases come from a list on the driver, so their table is as small as that list.
    met = candidates(rows, keys, row_id).join(F.broadcast(phrases), "phrase")
    if counts:
        matches = F.regexp_count("text", F.col("pattern")).cast("bigint")
        found = met.select(row_id, "target", matches.alias("n")).filter("n > 0").distinct()
    else:
        seen = F.regexp_like(F.lower("text"), F.col("opening")) if prefilter else F.lit(True)
        found = met.filter((F.col("sure") | F.regexp_like("text", F.col("pattern"))) & seen).select(row_id, "target").distinct()
    for phrase in loose:
        if counts:
            more = rows.select(row_id, F.lit(phrase.column).alias("target"), phrase.count(F.col("text")).cast("bigint").alias("n")).filter("n > 0")
        else:
            more = rows.filter(phrase.hit(F.col("text"), prefilter)).select(row_id, F.lit(phrase.column).alias("target"))
        found = found.unionByName(more)
    return found
