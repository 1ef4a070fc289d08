"""Secret scans: fixed patterns plus a sliding-window Shannon entropy per character class, in column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from phrasecast.llm.common import let

#: The patterns of the three base kinds.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
MIN_ASSIGNED = 8
#: Spans of equal start are listed in this order.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")


@dataclass(frozen=True)
class CharClass:
    """A candidate is a run of the class; a window of ``width`` characters counts from ``bits`` of entropy on."""

    kind: str
    alphabet: str
    pattern: str
    width: int
    bits: float


CLASSES = (
    CharClass("entropy_hex", "0123456789abcdef", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{24,}(?![0-9A-Za-z])", 24, 3.0),
    CharClass(
        "entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
        r"[A-Za-z0-9+/_-]{24,}", 24, 3.9,
    ),
)
#: Candidates that hold one of these are known not to be secrets: one class of letters only, placeholders, UUIDs, counters.
ALLOWED = (
    r"^[^0-9]*$", r"^[0-9_+/-]*$", r"(?i)example|placeholder|your[_-]", r"(.)\1{7}", r"(?i)0123456789|abcdefghij",
    r"(?i)^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$", r"^[A-Za-z0-9_+-]*(/[A-Za-z0-9_+-]{0,15}){3,}$",
)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, found): positions are sums over the pieces between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(f: Column) -> Column:
        def both(gaps: Column) -> Column:
            zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,found:string>>").alias("out"))

            def step(a: Column, i: Column) -> Column:
                start = a.getField("at") + F.char_length(F.get(gaps, i))
                end = start + F.char_length(F.get(f, i))
                span = F.struct(start.alias("start"), end.alias("end"), F.get(f, i).alias("found"))
                return F.struct(end.alias("at"), F.concat(a.getField("out"), F.array(span)).alias("out"))

            return F.aggregate(F.sequence(F.lit(0), F.size(f) - 1), zero, step, lambda a: a.getField("out"))

        return F.when(F.size(f) > 0, let(F.split(text, pattern, -1), both)).otherwise(
            F.array().cast("array<struct<start:int,end:int,found:string>>")
        )

    return let(found, place)


def hot_spans(candidate: Column, c: CharClass) -> Column:
    """Parts of a candidate covered by windows of high entropy, as (start, end) inside it.

    The counts of the window's characters and the sum of n log2 n change by one character that leaves and one that
    enters; the window's entropy is log2(width) - sum / width.
    """
    gain = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(c.width + 2)])
    fold = c.alphabet if c.alphabet != c.alphabet.lower() else None

    def scan(chars: Column) -> Column:
        def code(i: Column) -> Column:
            ch = F.get(chars, i)
            return F.instr(F.lit(c.alphabet), ch if fold else F.lower(ch)) - 1

        zero = F.struct(
            F.array_repeat(F.lit(0), len(c.alphabet)).alias("n"), F.lit(0.0).alias("s"),
            F.lit(-1).alias("start"), F.lit(-1).alias("end"),
            F.array().cast("array<struct<start:int,end:int>>").alias("out"),
        )

        def step(a: Column, i: Column) -> Column:
            full = i >= c.width
            gone = F.when(full, code(F.greatest(i - c.width, F.lit(0)))).otherwise(F.lit(-1))
            left = F.transform(a.getField("n"), lambda v, k: v - (k == gone).cast("int"))
            was = F.get(a.getField("n"), F.greatest(gone, F.lit(0)))
            s1 = a.getField("s") - F.when(full, F.get(gain, was) - F.get(gain, was - 1)).otherwise(F.lit(0.0))

            def enter(n: Column) -> Column:
                new = code(i)
                s2 = s1 + F.get(gain, F.get(n, new) + 1) - F.get(gain, F.get(n, new))
                counts = F.transform(n, lambda v, k: v + (k == new).cast("int"))
                hot = (i >= c.width - 1) & (F.round(math.log2(c.width) - s2 / c.width, 9) >= c.bits)
                first, open_ = i - (c.width - 1), a.getField("start") >= 0
                joins = open_ & (first <= a.getField("end"))
                closed = F.concat(a.getField("out"), F.array(F.struct(a.getField("start"), a.getField("end"))))
                return F.struct(
                    counts.alias("n"), s2.alias("s"),
                    F.when(hot & ~joins, first).otherwise(a.getField("start")).alias("start"),
                    F.when(hot, i + 1).otherwise(a.getField("end")).alias("end"),
                    F.when(hot & open_ & ~joins, closed).otherwise(a.getField("out")).alias("out"),
                )

            return let(left, enter)

        def finish(a: Column) -> Column:
            last = F.array(F.struct(a.getField("start").alias("start"), a.getField("end").alias("end")))
            return F.when(a.getField("start") >= 0, F.concat(a.getField("out"), last)).otherwise(a.getField("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), zero, step, finish)

    return let(F.split(candidate, ""), scan)


def _entropy_spans(text: Column, c: CharClass) -> Column:
    allowed = lambda m: F.array_contains(F.array(*[m["found"].rlike(a) for a in ALLOWED]), True)
    wanted = F.filter(matches(text, c.pattern), lambda m: ~allowed(m))

    def inside(m: Column) -> Column:
        moved = lambda s: F.struct(
            (m["start"] + s["start"]).alias("start"), F.lit(KINDS.index(c.kind)).alias("rank"), (m["start"] + s["end"]).alias("end")
        )
        return F.transform(hot_spans(m["found"], c), moved)

    return F.flatten(F.transform(wanted, inside))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``secret_spans``: array of (start, rank, end) sorted, ``rank`` an index of ``KINDS``.

    Offsets count code points, ends are exclusive. The base kinds are always reported; entropy spans are dropped when
    their candidate is on the allow-list. Spans of different kinds may overlap. Null text counts as empty and gives an
    empty array; every row comes back with all its columns.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def spans(found: Column, rank: int) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))

    value = lambda m: F.regexp_extract(m["found"], ASSIGN, 2)
    parts = [
        spans(F.filter(matches(text, ASSIGN), lambda m: F.char_length(value(m)) >= MIN_ASSIGNED), 0),
        spans(matches(text, ACCESS), 1),
        spans(matches(text, HEX), 2),
    ]
    parts += [_entropy_spans(text, c) for c in CLASSES]
    return docs.withColumn("secret_spans", F.sort_array(F.concat(*parts)))


def listed(spans: Column) -> Column:
    """Spans written as kind:start:end, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    write = lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(spans, write))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, number of spans of each base kind, digest of the base spans, and all spans as text."""
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).drop("text")
    base = F.filter("secret_spans", lambda s: s["rank"] < 3)
    count = lambda r: F.size(F.filter("secret_spans", lambda s: s["rank"] == r)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """Replace every reported span of the text by ``mask`` (overlapping spans by one); null text stays null."""
    found = scan(docs, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        apart = (s["start"] >= a["at"]) & (s["end"] > s["start"])
        gap = F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        return F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(apart, F.concat(a["out"], gap, F.lit(mask))).otherwise(a["out"]).alias("out"),
        )

    end = lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text)))
    clean = F.aggregate("secret_spans", zero, step, end)
    return found.withColumn(text_col, F.when(F.size("secret_spans") > 0, clean).otherwise(F.col(text_col))).drop("secret_spans")
