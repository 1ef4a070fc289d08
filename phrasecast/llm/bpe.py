"""Byte-level BPE in Spark's higher-order functions: a fold of ranked merges, and its way back.

Bytes are handled as strings of one character per byte (ISO-8859-1), so that slices and look-ups stay cheap. The ranks are
a literal of the plan: an array of small maps, found by a hash of the key, because a look-up in one large map reads all
of it. A word starts as its bytes with the ranks of all neighbouring pairs; each step of the fold merges the first pair
of least rank and looks up the two ranks that change, until no pair has one.

Distinct words that are frequent are folded once: the counts of the whole corpus pick at most ``CACHE`` of them, of at
most ``CACHED_CHARS`` characters, and their ids travel as a second literal, which these two numbers bound. All other words
are folded where they stand, so nothing but the sketches of the counts is shuffled and the choice never changes a result.

Defined cases: a null text counts as empty and has no ids; a null id stays null; repeated rows each give a row; other
columns are not carried, so their names cannot clash; no rows give no rows.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Mapping

import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from phrasecast.session import materialize

#: Distinct words folded once, and the longest of them; together they bound the literal.
CACHE, CACHED_CHARS = 49_152, 20
#: Counting: groups of words by hash (each keeps its own most frequent ones), and words watched in each.
_GROUPS, _WATCHED = 64, 4096
#: Words of more bytes are folded by rounds, all places of a pair at once, which takes fewer steps.
LONG = 256
_NO_RANK = 2**23 - 1
_OPEN, _CLOSE = "Ā", "ā"  # no byte


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank per line; by default the public 50k vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary must hold every single byte")
    return ranks


def java_pattern(pattern: str | None = None) -> str:
    """A splitting pattern (by default the public one) with white space as Unicode defines it."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return pattern.replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, without the copy that an array of results makes of each element."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


class Table:
    """A constant hash table from strings to values of the type ``kind``."""

    def __init__(self, entries: Mapping[str, object], kind: str):
        self.mask = (1 << max(len(entries) // 2, 1).bit_length()) - 1
        buckets: list[dict] = [{} for _ in range(self.mask + 1)]
        for key, value in entries.items():
            buckets[xxhash.xxh64_intdigest(key.encode(), seed=42) & self.mask][key] = value
        self.json, self.kind = json.dumps(buckets), f"array<map<string,{kind}>>"

    @property
    def literal(self) -> Column:
        """Folded to one literal when the plan is optimised. Every use would be a literal of its own, so ``bind`` names it once."""
        return F.from_json(F.lit(self.json), self.kind)

    def get(self, bound: Column, key: Column) -> Column:
        """The value of a key, or null; ``bound`` is the constant."""
        return F.get(bound, F.xxhash64(key).bitwiseAND(F.lit(self.mask)).cast("int"))[key]


class Folds:
    """The folds of words whose ranks stand in the bound literal of ``table``."""

    def __init__(self, table: Table, bound: Column):
        self._table, self._bound = table, bound

    def _rank(self, token: Column) -> Column:
        return F.coalesce(self._table.get(self._bound, token), F.lit(_NO_RANK))

    def _by_places(self, word: Column) -> Column:
        """Merge one place per step.

        A piece is one number: the rank of it and its right neighbour, where it starts and where it ends (20 bits each), so
        the least number is the first pair of least rank. A piece of no bytes on either side has no rank with anything.
        """
        piece = lambda rank, start, end: F.shiftleft(rank.cast("bigint"), 40) + start * (1 << 20) + end
        start_of = lambda q: F.shiftright(q, 20).bitwiseAND(F.lit((1 << 20) - 1)).cast("int")
        end_of = lambda q: q.bitwiseAND(F.lit((1 << 20) - 1)).cast("int")
        n = F.length(word)

        def pair(start: Column, end: Column, inside: Column) -> Column:
            return F.when(inside, self._rank(F.substr(word, start, end - start))).otherwise(F.lit(_NO_RANK))

        def merge(q: Column, least: Column, i: Column) -> Column:
            left, right, after = F.element_at(q, i - 1), F.element_at(q, i + 1), F.element_at(q, i + 2)
            start, end = start_of(least), end_of(right)
            before = piece(pair(start_of(left), end, i > 2), start_of(left), start)
            merged = piece(pair(start, end_of(after), end <= n), start, end)
            return F.concat(F.slice(q, F.lit(1), i - 2), F.array(before, merged), F.slice(q, i + 2, F.size(q)))

        def step(q: Column, _: Column) -> Column:
            return bind(F.array_min(q), lambda least: F.when(least >= _NO_RANK << 40, q).otherwise(
                bind(F.array_position(q, least).cast("int"), lambda i: merge(q, least, i))))

        # Positions count from 1; the pieces before and after the word are empty.
        at = F.transform(F.sequence(F.lit(1), n), lambda i: piece(pair(i, i + 2, i < n), i, i + 1))
        edge = lambda at: F.array(piece(F.lit(_NO_RANK), at, at))
        start = F.concat(edge(F.lit(1)), at, edge(n + 1))
        return F.aggregate(
            F.sequence(F.lit(2), n), start, step,
            lambda q: F.transform(F.slice(q, F.lit(2), F.size(q) - 2), lambda x: self._rank(F.substr(word, start_of(x), end_of(x) - start_of(x)))),
        )

    def _by_rounds(self, word: Column) -> Column:
        """Merge all places of the least pair per step: pieces stand between brackets in one string."""
        split = lambda s: F.split(F.substr(s, F.lit(2), F.length(s) - 2), _CLOSE + _OPEN)
        bytes_of = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substr(word, i, F.lit(1)))
        start = F.struct(F.concat(F.lit(_OPEN), F.array_join(bytes_of, _CLOSE + _OPEN), F.lit(_CLOSE)).alias("s"), F.lit(False).alias("done"))

        def pair(p: Column, i: Column) -> Column:
            a, b = F.element_at(p, i), F.element_at(p, i + 1)
            return F.struct(self._rank(F.concat(a, b)).alias("r"), a.alias("a"), b.alias("b"))

        def merged(s: Column, best: Column) -> Column:
            apart = F.concat(F.lit(_OPEN), best["a"], F.lit(_CLOSE + _OPEN), best["b"], F.lit(_CLOSE))
            whole = F.concat(F.lit(_OPEN), best["a"], best["b"], F.lit(_CLOSE))
            none = F.coalesce(best["r"], F.lit(_NO_RANK)) == _NO_RANK
            return F.struct(F.when(none, s).otherwise(F.replace(s, apart, whole)).alias("s"), none.alias("done"))

        def step(acc: Column, _: Column) -> Column:
            pairs = lambda p: F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda i: pair(p, i)))
            best = bind(split(acc["s"]), lambda p: F.array_min(pairs(p)))
            return F.when(acc["done"], acc).otherwise(bind(best, lambda b: merged(acc["s"], b)))

        return F.aggregate(F.sequence(F.lit(2), F.length(word)), start, step, lambda acc: F.transform(split(acc["s"]), self._rank))

    def ids(self, word: Column) -> Column:
        """The token ids of one word, as ``array<int>``."""

        def fold(w: Column) -> Column:
            folded = F.when(F.length(w) <= LONG, self._by_places(w)).otherwise(self._by_rounds(w))
            return bind(self._table.get(self._bound, w), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(folded))

        return bind(F.decode(word.cast("binary"), "ISO-8859-1"), fold)


def rank_table(ranks: Mapping[bytes, int]) -> Table:
    return Table({token.decode("latin-1"): rank for token, rank in ranks.items()}, "int")


def word_ids(word: Column, ranks: Mapping[bytes, int]) -> Column:
    """The token ids of one word, as ``array<int>``."""
    table = rank_table(ranks)
    return bind(table.literal, lambda bound: Folds(table, bound).ids(word))


def decode(ids: Column, ranks: Mapping[bytes, int]) -> Column:
    """The bytes of an array of ids: the tokens' bytes in a row. An id that no token has is an error."""
    by_rank = {rank: token.decode("latin-1") for token, rank in ranks.items()}
    tokens = F.from_json(F.lit(json.dumps([by_rank.get(i) for i in range(max(by_rank) + 1)])), "array<string>")
    token = lambda t, i: F.coalesce(F.get(t, i), F.raise_error(F.concat(F.lit("no token "), i.cast("string"))))
    return bind(tokens, lambda t: F.encode(F.array_join(F.transform(ids, lambda i: token(t, i)), ""), "ISO-8859-1"))


def split_words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def frequent_words(text: DataFrame, pattern: str) -> DataFrame:
    """At most ``CACHE`` distinct words ``word`` of ``CACHED_CHARS`` characters or less that are frequent in the whole corpus.

    Sketches of frequent items, one for each of ``_GROUPS`` groups of words by hash, count every word in each task; the
    sketches, whose size is fixed, are all that is shuffled.
    """
    found = text.select(F.explode(split_words(F.col(text.columns[0]), pattern)).alias("word"))
    short = found.filter(F.char_length("word") <= CACHED_CHARS).withColumn("group", F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(_GROUPS)))
    top = short.groupBy("group").agg(F.expr(f"approx_top_k(word, {CACHE // _GROUPS}, {_WATCHED})").alias("top"))
    return top.select(F.explode("top.item").alias("word"))


def encode(docs: DataFrame, ranks: Mapping[bytes, int] | None = None, pattern: str | None = None, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Per row: the id and ``ids``, the tokens of the whole text; every match of the pattern is encoded by itself."""
    ranks, pattern = ranks or load_ranks(), java_pattern(pattern)
    text = F.col(text_col).cast("string")
    frequent = frequent_words(docs.select(text.alias("text")), pattern)
    known = materialize(frequent.select("word", word_ids(F.col("word"), ranks).alias("ids")), "frequent-words")
    # At most CACHE rows of at most CACHED_CHARS characters.
    cache = Table({row["word"]: row["ids"] for row in known.collect()}, "array<int>")
    table = rank_table(ranks)

    def each(bound: Column, w: Column) -> Column:
        folded = Folds(table, bound["ranks"]).ids(w)
        return bind(cache.get(bound["cache"], w), lambda ids: F.when(ids.isNotNull(), ids).otherwise(folded))

    literals = F.struct(table.literal.alias("ranks"), cache.literal.alias("cache"))
    ids = bind(literals, lambda bound: F.flatten(F.transform(split_words(text, pattern), lambda w: each(bound, w))))
    return docs.select(F.col(id_col), ids.alias("ids"))


def report(docs: DataFrame, ranks: Mapping[bytes, int] | None = None) -> DataFrame:
    """Number of tokens, digest of the ids and digest of the bytes they decode to, per document."""
    ranks = ranks or load_ranks()
    ids = F.col("ids")
    return encode(docs, ranks).select(
        "doc_id",
        F.size(ids).cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decode(ids, ranks), 256).alias("decoded_sha256"),
    )
