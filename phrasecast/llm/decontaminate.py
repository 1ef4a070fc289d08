"""Benchmark decontamination by template windows.

Numbers, units and names become typed placeholders, so a question with other numbers or names has the same template.
Windows of template tokens are hash-joined with the benchmark's; windows whose values do not follow the alignment's
most frequent renaming do not count. Windows with few plain words are compared by their values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from phrasecast.llm.common import let, split_unnamed

WIDTH = 8
MIN_LITERALS = 5
#: Unit words that follow a number, and number words.
UNITS = (
    "mm cm m km in ft yd mi g kg mg t lb oz ml l s sec min h hr hours minutes seconds days weeks months years meters metres "
    "miles feet inches grams kilograms pounds liters litres dollars euros cents percent degrees mph kmh"
).split()
NUMBERS = "two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand".split()
#: A placeholder is its type, this sign, and the value.
_SIGN = "\u0003"
#: Scripts written without blanks: each of their characters is a token.
_UNSPACED = r"([\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3005-\u3007\u3040-\u30FA\u30FC-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\x{20000}-\x{3FFFF}])"
_FOREIGN_MARKS = r"[\u3000-\u3004\u3008-\u301F\u30FB\uFF01-\uFF0F\uFF1A-\uFF20\uFF3B-\uFF40\uFF5B-\uFF65]"
_BLANK = r"[\x20\x09-\x0D]"
_END = rf"(?=[.!?:,]|{_BLANK}|$)"
#: Punctuation that is dropped wherever it stands; the signs that end sentences or divide numbers are not among it.
_MARKS = r"""["#$%&'()*+/;<=>@\[\\\]^_`{|}~«»·¿¡-]+"""
#: Words of the fixed-size filter; its 64 * 2**14 bits are 128 KB whatever the size of the benchmark.
_FILTER = 1 << 14
#: Tokens whose windows are made at once; a longer text is cut into blocks, which overlap by a window.
BLOCK = 512


def template_tokens(text: Column) -> Column:
    """Tokens without punctuation; numbers, units and names as ``type SIGN value``.

    A name is a capitalised word after a word that ends in a small letter, digit or comma. Elsewhere, as at the start
    of a sentence, it may be a name or not and has a type of its own. Case is kept; it is folded where tokens are
    compared. Null text has no tokens.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), _MARKS, "")
    apart = lambda x: F.regexp_replace(F.regexp_replace(x, _FOREIGN_MARKS, " "), _UNSPACED, " $1 ")
    t = let(t, lambda x: F.when(x.rlike(_UNSPACED), apart(x)).otherwise(x))
    t = F.regexp_replace(t, rf"(\p{{Lu}})(?<=[\p{{Ll}}\p{{Nd}},]{_BLANK}\p{{Lu}})(\p{{Ll}}+){_END}", f"&n{_SIGN}$1$2")
    t = F.regexp_replace(t, rf"(?<={_BLANK}|^)(\p{{Lu}}\p{{Ll}}+){_END}", f"&s{_SIGN}$1")
    t = F.regexp_replace(t, rf"(?<={_BLANK}|^)(\d+(?:[.,:]\d+)*|" + "|".join(NUMBERS) + rf"){_END}", f"&d{_SIGN}$1")
    t = F.regexp_replace(t, rf"(&d{_SIGN}[^\x20\x09-\x0D]+{_BLANK})(" + "|".join(UNITS) + rf"){_END}", f"$1&u{_SIGN}$2")
    ends = r"[.!?:,\x20\x09-\x0D]*"
    return F.filter(F.split(F.btrim(t, F.lit(".!?:, \t\n\x0b\x0c\r")), ends + _BLANK + ends), lambda x: x != "")


def _value(x: Column) -> Column:
    return F.lower(F.substring_index(x, _SIGN, -1))


#: How the tokens of a window are compared: words that may be names as words, as names, and everything by its value.
WORDS, NAMES, VALUES = 0, 1, 2


def _keys(tokens: Column, values: Column, how: int) -> Column:
    """Hash of each token as it is compared; ``values`` has those of all values."""
    if how == VALUES:
        return values
    kinds = ("&n", "&d", "&u", "&s") if how == NAMES else ("&n", "&d", "&u")
    constant = {k: F.xxhash64(F.lit("&n" if k == "&s" else k)) for k in kinds}

    def key(x: Column, i: Column) -> Column:
        own = F.get(values, i)
        kind = F.substring(x, 1, 2)
        typed = own
        for k, h in constant.items():
            typed = F.when(kind == k, h).otherwise(typed)
        return F.when(F.startswith(x, F.lit("&")), typed).otherwise(own)

    return F.transform(tokens, key)


def _starts(tokens: Column, how: int, width: int, min_literals: int) -> Column:
    """The windows that can be compared in this way: all, those with a word that may be a name, or with few plain words."""
    last = F.size(tokens) - width
    if how == WORDS:
        return F.sequence(F.lit(0), last)
    first = lambda x: F.startswith(x, F.lit("&s"))
    marked = first if how == NAMES else lambda x: F.startswith(x, F.lit("&")) & ~first(x)
    need = 1 if how == NAMES else width - min(min_literals, width) + 1
    places = F.filter(F.transform(tokens, lambda x, i: F.when(marked(x), i)), lambda i: i.isNotNull())

    def ranges(p: Column) -> Column:
        def windows(j: Column) -> Column:  # those whose first marked token is the j-th
            after = F.when(j > 0, F.get(p, F.greatest(j - 1, F.lit(0))) + 1).otherwise(F.lit(0))
            low = F.greatest(after, F.get(p, j + need - 1) - width + 1)
            high = F.least(F.get(p, j), last)
            return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))

        some = F.size(p) >= need
        return F.when(some, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - need, F.lit(0))), windows))).otherwise(F.array().cast("array<int>"))

    return let(places, ranges)


_FOUND = "array<struct<at:int,width:int,h:bigint>>"


def _hashes(wanted: list[tuple[int, int]], min_literals: int) -> Column:
    """Place, width and hash of the windows of ``tokens`` in the wanted ways and widths; a shorter text has no window."""

    def of(values: Column, how: int, width: int) -> Column:
        def windows(k: Column) -> Column:
            hashed = lambda i: F.xxhash64(F.lit(8 * how + width), *[F.get(k, i + j) for j in range(width)])
            return F.transform(
                _starts(F.col("tokens"), how, width, min_literals),
                lambda i: F.struct(i.alias("at"), F.lit(width).alias("width"), hashed(i).alias("h")),
            )

        return F.when(F.size("tokens") >= width, let(_keys(F.col("tokens"), values, how), windows)).otherwise(F.array().cast(_FOUND))

    values = F.transform("tokens", lambda x: F.xxhash64(_value(x)))
    return let(values, lambda v: F.concat(F.array().cast(_FOUND), *[of(v, *x) for x in wanted]))


def _parts(width: str) -> Column:
    return F.slice("tokens", F.col("at") + 1, F.col(width))


def _bit_of(column: str) -> Column:
    return F.pmod(F.shiftright(column, 20), F.lit(64)).cast("int")


def _filter_bits(windows: DataFrame) -> DataFrame:
    """One row: the benchmark's hashes as a bit table of fixed size (a probable-member test without false negatives)."""
    word = F.pmod("h", F.lit(_FILTER)).alias("i")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _bit_of("h"))
    some = windows.select(word, bit.alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    every = windows.sparkSession.range(_FILTER).withColumnRenamed("id", "i").join(some, "i", "left")
    rows = every.agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("b", F.lit(0).cast("long")).alias("b")))).alias("t"))
    return rows.select(F.col("t.b").alias("bits"))


def _blocks(texts: DataFrame, width: int) -> DataFrame:
    """``doc_id, start, tokens``: the tokens in blocks, each with the tokens that windows of its first ``BLOCK`` places reach.

    A row of a long text would hold an object for each of its windows, and each window would carry all tokens.
    """
    n = F.size("tokens")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.struct(i.alias("start"), F.slice("tokens", i + 1, F.lit(BLOCK + width - 1)).alias("tokens")))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("tokens").alias("tokens")))
    return texts.select("doc_id", F.inline(F.when(n > BLOCK, cut).otherwise(whole)))


def _item_windows(items: DataFrame, width: int, min_literals: int) -> DataFrame:
    """``item_id, n_tokens, width, at, how, h, part``: every window of the items in each way in which it is compared.

    A window with few plain words says too little without its values: it is compared by them. Otherwise words that may
    be names count as plain ones here, but as names they must leave three plain words.
    """
    n = F.least(F.size("tokens"), F.lit(width))
    rows = items.filter(F.size("tokens") > 0).withColumn("width", n)
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("tokens") - F.col("width"))))
    rows = rows.select("item_id", F.size("tokens").alias("n_tokens"), "width", "at", _parts("width").alias("tokens"))
    plain = F.size(F.filter("tokens", lambda x: ~F.contains(x, F.lit(_SIGN))))
    first = F.size(F.filter("tokens", lambda x: F.startswith(x, F.lit("&s"))))
    enough = plain + first >= F.least(F.lit(min_literals), F.col("width"))
    named = enough & (first > 0) & (plain >= F.least(F.lit(3), F.col("width")))
    hows = F.array_compact(F.array(F.when(enough, WORDS), F.when(named, NAMES), F.when(~enough, VALUES)))
    return rows.withColumn("how", F.explode(hows))


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", width: int = WIDTH, min_share: float = 0.5, min_literals: int = MIN_LITERALS,
    min_words: int = 13,
) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds: ``doc_id, item_id, share, n_slots, n_renamed``.

    Items of fewer than ``width`` tokens are one window of their length. Windows with fewer than ``min_literals`` plain
    words (all of them, in a shorter item) are compared by their values, the others by their template. Along one
    alignment, each benchmark value is bound to the document value that it meets most often (itself, if as often);
    windows that hold another binding do not count, and two benchmark values may meet one document value.

    A pair is reported when ``min_words`` tokens of the item (all, if it has fewer) lie in such windows of one
    alignment, or at least ``min_share`` of its windows are found. ``share`` is this part, among the windows compared
    by template if the item has any. ``n_renamed`` counts values that differ in the alignment with most words, so 0 is
    a verbatim copy. Null or empty texts match nothing; rows with the same id are judged as one document (null ids,
    too); other columns are not read.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), template_tokens(F.col(item_text_col)).alias("tokens"))
    items = _item_windows(items, width, min_literals)
    wanted = sorted(tuple(r) for r in items.select("how", "width").distinct().collect())  # three ways, ``width`` widths
    h = F.lit(0).cast("long")
    for how, w in wanted:
        h = F.when((F.col("how") == how) & (F.col("width") == w), F.get(_hashes([(how, w)], min_literals), F.lit(0))["h"]).otherwise(h)
    items = items.select("item_id", "n_tokens", "width", F.col("at").alias("item_at"), "how", h.alias("h"), F.col("tokens").alias("item_part"))
    bits = _filter_bits(items).scalar()

    texts = docs.select(F.col(id_col).alias("doc_id"), template_tokens(F.col(text_col)).alias("tokens"))
    found = _blocks(texts, width).withColumn("hashes", _hashes(wanted, min_literals))
    found = found.select("doc_id", "start", "tokens", F.explode_outer("hashes").alias("x")).select("doc_id", "start", "tokens", "x.*")
    found = found.filter(F.col("at") < BLOCK)  # those behind belong to the next block
    word = F.get(bits, F.pmod("h", F.lit(_FILTER)).cast("int"))
    found = found.filter(F.call_function("shiftrightunsigned", word, _bit_of("h")).bitwiseAND(F.lit(1).cast("long")) == 1)
    found = found.select("doc_id", (F.col("start") + F.col("at")).alias("doc_at"), "h", F.transform(_parts("width"), _value).alias("doc_part"))

    pair = ["doc_id", "item_id", "shift"]
    met = found.join(items, "h").withColumn("shift", F.col("doc_at") - F.col("item_at"))
    slots = F.transform("item_part", lambda x, i: F.struct(
        (F.col("item_at") + i).alias("i"), F.contains(x, F.lit(_SIGN)).alias("slot"), F.startswith(x, F.lit("&s")).alias("first"),
        _value(x).alias("b"), F.get("doc_part", i).alias("d"),
    ))
    met = met.withColumn("slots", F.filter(slots, lambda x: x["slot"]))
    runs = met.groupBy(*pair).agg(
        F.sort_array(F.collect_set("item_at")).alias("ats"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
        F.first("width").alias("width"), F.first("n_tokens").alias("n_tokens"), F.collect_set(F.when(F.col("how") != VALUES, F.col("item_at"))).alias("loose"),
    )
    weigh = lambda x: F.struct(
        F.size(F.filter("slots", lambda y: (y["b"] == x["b"]) & (y["d"] == x["d"]))).alias("n"), (x["b"] == x["d"]).alias("same"), x["d"].alias("d")
    )
    runs = runs.withColumn("slots", F.transform("slots", lambda x: x.withField("w", weigh(x))))
    wrong = F.filter("slots", lambda x: F.exists("slots", lambda y: (y["b"] == x["b"]) & (y["w"] > x["w"])))
    runs = runs.withColumn("wrong", F.transform(wrong, lambda x: x["i"]))
    sound = lambda c: F.filter(c, lambda a: ~F.exists("wrong", lambda p: (p >= a) & (p < a + F.col("width"))))
    runs = runs.withColumn("ats", sound("ats")).withColumn("loose", sound("loose"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("ats", zero, lambda a, x: F.struct(
        (a["n"] + x + F.col("width") - F.greatest(a["end"], x)).alias("n"), (x + F.col("width")).alias("end")
    ), lambda a: a["n"])
    right = F.array_distinct(F.transform(
        F.filter("slots", lambda x: ~F.array_contains("wrong", x["i"]) & (~x["first"] | (x["b"] != x["d"]))), lambda x: F.struct(x["b"].alias("b"), x["d"].alias("d"))
    ))
    runs = runs.filter(F.size("ats") > 0).select(
        "doc_id", "item_id", "ats", "loose", "n_tokens", covered.alias("covered"), F.size(right).cast("long").alias("n_slots"),
        F.size(F.filter(right, lambda x: x["b"] != x["d"])).cast("long").alias("n_renamed"),
    )
    many = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(c))))
    best = runs.groupBy("doc_id", "item_id").agg(
        many("ats").alias("n_all"), many("loose").alias("n_loose"), F.max("covered").alias("covered"), F.first("n_tokens").alias("n_tokens"),
        F.max_by(F.struct("n_slots", "n_renamed"), F.struct("covered", -F.col("n_renamed"), "n_slots")).alias("values"),
    )
    sizes = items.groupBy("item_id").agg(
        F.count_distinct("item_at").alias("n_item"), F.count_distinct(F.when(F.col("how") != VALUES, F.col("item_at"))).alias("n_item_loose"),
    )
    best = best.alias("p").join(sizes.alias("z"), F.col("p.item_id").eqNullSafe(F.col("z.item_id")))
    share = F.when(F.col("n_item_loose") > 0, F.col("n_loose") / F.col("n_item_loose")).otherwise(F.col("n_all") / F.col("n_item"))
    best = best.withColumn("share", share).filter((F.col("share") >= min_share) | (F.col("covered") >= F.least(F.lit(min_words), "n_tokens")))
    return best.select("doc_id", F.col("p.item_id").alias("item_id"), "share", "values.n_slots", "values.n_renamed")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; each row without an id is judged by itself."""
    named, unnamed = split_unnamed(docs, id_col, 0)
    rows = named.withColumn("__row", F.lit(None).cast("long")).unionByName(unnamed)
    keyed = rows.withColumn("__doc", F.struct(F.col(id_col).alias("id"), F.col("__row").alias("row")))
    bad = leaks(keyed, benchmark, id_col="__doc", **options).select(F.col("doc_id.id").alias("__id"), F.col("doc_id.row").alias("__bad"))
    same = rows[id_col].eqNullSafe(F.col("__id")) & rows["__row"].eqNullSafe(F.col("__bad"))
    return rows.join(bad.distinct(), same, "left_anti").drop("__row")
