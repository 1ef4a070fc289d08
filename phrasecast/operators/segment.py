"""Clean pages and cut them into speaker turns or token windows.

The text of an event is its non-blank pages joined by a blank line. It is never built in one row: pages
stay rows, positions come from running totals over (event, page) and each page sees only a few dozen
characters of its neighbours. A turn or a window is put together from the pages it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from phrasecast.functions.scan import prefix_sums
from phrasecast.functions.text import SPACE, clean_page, is_blank, leading_space, strip
from phrasecast.session import materialize

PAGE_BREAK = "\n\n"
PAGE_BLOCK = 1024  # pages per block of the running totals

# Fixed value: a speaker label at a line start, at most 41 characters before the colon.
LABEL = rf"(?dm)^([A-Z][A-Z\-'{SPACE[1:]}{{1,40}}):"
OPENING = rf"\A[A-Z\-'{SPACE[1:]}{{0,41}}:"  # a page that begins with what may end a label
_REACH = 48  # characters of context: a label, its colon and the page breaks around it
_NEAR = 16  # pages that hold at least that many characters (one character and a break each)


def clean_pages(pages: DataFrame) -> DataFrame:
    """``(event_id, page_no, text)`` with cleaned text; row-wise, no shuffle."""
    return pages.select("event_id", "page_no", clean_page(F.coalesce("text", F.lit(""))).alias("text"))


def _occupied(pages: DataFrame) -> DataFrame:
    return pages.select("event_id", "page_no", "text").filter(~is_blank(F.col("text")))


def _page_block() -> dict[str, Column]:
    return {"block": F.floor(F.col("page_no") / PAGE_BLOCK)}


def page_offsets(pages: DataFrame) -> DataFrame:
    """Per non-blank page: its place in the event, and where it starts in the joined text.

    The few numbers and characters this needs of a page are written once; the scans read that table.
    """
    sized = _occupied(pages).select(
        "event_id",
        "page_no",
        F.char_length("text").cast("bigint").alias("n_chars"),
        F.left("text", F.lit(_REACH)).alias("head"),
        F.right("text", F.lit(_REACH)).alias("tail"),
        F.regexp_count("text", F.lit(LABEL)).cast("bigint").alias("own_labels"),
        F.regexp_extract("text", OPENING, 0).alias("opening"),
    )
    return prefix_sums(
        materialize(sized, "page-sizes"),
        ["event_id"],
        _page_block(),
        ["page_no"],
        {"page_idx": F.lit(1).cast("bigint"), "offset": F.col("n_chars") + len(PAGE_BREAK)},
        totals=True,
    )


def _page_context(pages: DataFrame) -> DataFrame:
    """Add the characters before and after each page, without carrying the page text.

    Page numbers are dense here, so blocks of pages see their neighbours through a copy of the few
    pages at each block edge.
    """
    placed = page_offsets(pages)
    place = F.col("page_idx") % PAGE_BLOCK
    block = F.floor(F.col("page_idx") / PAGE_BLOCK)
    homes = F.filter(
        F.array(
            block,
            F.when((place < _NEAR) & (block > 0), block - 1),
            F.when(place >= PAGE_BLOCK - _NEAR, block + 1),
        ),
        lambda b: b.isNotNull(),
    )
    copies = placed.withColumn("home", block).withColumn("seen_by", F.explode(homes))
    near = Window.partitionBy("event_id", "seen_by").orderBy("page_idx")
    before = F.collect_list("tail").over(near.rowsBetween(-_NEAR, -1))
    after = F.collect_list("head").over(near.rowsBetween(1, _NEAR))
    joined_before = F.concat(F.array_join(before, PAGE_BREAK), F.lit(PAGE_BREAK))
    joined_after = F.concat(F.lit(PAGE_BREAK), F.array_join(after, PAGE_BREAK))
    framed = copies.withColumns(
        {
            "before": F.when(F.col("page_idx") == 0, F.lit("")).otherwise(F.right(joined_before, F.lit(_REACH))),
            "after": F.when(F.col("page_idx") == F.col("page_idx_total") - 1, F.lit("")).otherwise(
                F.left(joined_after, F.lit(_REACH))
            ),
        }
    ).filter(F.col("home") == F.col("seen_by"))
    # Colons of the context are masked, so that only colons of the page itself make labels.
    lead = F.translate(_whole_lines(F.col("before"), F.col("offset") <= _REACH), ":", "#")
    framed = framed.withColumn("lead", lead)
    # The first colon of a page may need the lines before the page to make a label.
    joined = F.regexp_count(F.concat("lead", "opening"), F.lit(LABEL)) - F.regexp_count("opening", F.lit(LABEL))
    return framed.select(
        "event_id", "page_no", "page_idx", "offset", "n_chars", "lead", "after",
        (F.col("own_labels") + joined).alias("k"),
    )


def _whole_lines(context: Column, reaches_start: Column) -> Column:
    """Cut the first line of a context unless the context reaches the start of the text."""
    cut = F.when(
        F.contains(context, F.lit("\n")), F.regexp_replace(context, r"\A[^\n]*\n", "")
    ).otherwise(F.lit(""))
    return F.when(reaches_start, context).otherwise(cut)


def _turn_pieces(pages: DataFrame) -> DataFrame:
    """One row per turn and page it touches; turn 0 is the text before the first label.

    A label belongs to the page of its colon, though it may begin on earlier pages (lines of capitals
    above the colon line are part of it). ``whole`` is the page behind its context ``lead``. ``taken``
    counts the characters at the end of the page that belong to a label whose colon comes on a later page.
    The text is joined once, by page, to what the scans over the small columns found.
    """
    context = materialize(_page_context(pages), "page-context")
    counted = prefix_sums(
        context, ["event_id"], _page_block(), ["page_no"], {"turns_before": F.col("k")}, totals=True
    )
    page = _occupied(pages).join(counted, ["event_id", "page_no"])
    short = F.col("n_chars") <= _REACH
    end = F.when(short, F.concat("lead", F.translate("text", ":", "#"))).otherwise(
        F.translate(_whole_lines(F.right("text", F.lit(_REACH)), F.lit(False)), ":", "#")
    )
    page = page.withColumn("end", end).withColumn("whole", F.concat("lead", "text"))
    to_label = F.split(F.concat("end", "after"), LABEL, 2)[0]
    taken = F.greatest(F.char_length("end") - F.char_length(to_label), F.lit(0))
    page = page.select(
        "event_id", "page_no", "page_idx", "offset", "n_chars", "k", "turns_before", "turns_before_total",
        F.char_length("lead").alias("lead_chars"),
        F.least(taken, F.col("n_chars")).cast("int").alias("taken"),
        F.regexp_extract_all("whole", F.lit(LABEL), F.lit(0)).alias("labels"),
        F.split("whole", LABEL).alias("bodies"),
    )
    parts = F.transform(
        F.sequence(F.lit(0), F.size("labels")),
        lambda i: F.struct(
            i.alias("j"),
            F.when(i > 0, F.get("labels", i - 1)).otherwise("").alias("label"),
            F.get("bodies", i).alias("body"),
        ),
    )
    rows = page.select(
        "event_id", "page_no", "page_idx", "offset", "n_chars", "lead_chars", "taken", "k", "turns_before",
        "turns_before_total", F.explode(parts).alias("p"),
    )
    # Positions inside one page: the group is one page and is already in one place.
    inside = Window.partitionBy("event_id", "page_no").orderBy("p.j")
    stop = F.sum(F.char_length("p.label") + F.char_length("p.body")).over(inside)
    rows = rows.withColumn("stop", F.col("offset") - F.col("lead_chars") + stop)
    body = F.when(F.col("p.j") == 0, F.substr("p.body", F.col("lead_chars") + 1)).otherwise(F.col("p.body"))
    rows = rows.withColumn("full", body)
    cut = F.left("full", F.greatest(F.char_length("full") - F.col("taken"), F.lit(0)))
    return rows.select(
        "event_id",
        "page_no",
        "page_idx",
        "offset",
        "n_chars",
        (F.col("turns_before") + F.col("p.j")).alias("turn_no"),
        F.col("turns_before_total").alias("turns"),
        F.when(F.col("p.j") > 0, strip(F.regexp_replace("p.label", r":\z", ""))).alias("speaker"),
        F.when(
            F.col("p.j") > 0, F.col("stop") - F.char_length("p.body") - F.char_length("p.label")
        ).alias("label_at"),
        F.greatest(F.col("stop") - F.char_length("p.body"), F.col("offset")).alias("at"),
        F.when(F.col("p.j") == F.col("k"), cut).otherwise(F.col("full")).alias("text"),
    ).withColumn("spoken", ~is_blank(F.col("text")))


def _join_pieces(order: str, text: str = "text") -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text).alias("piece"))))
    return F.array_join(F.transform(ordered, lambda x: x["piece"]), PAGE_BREAK)


def _numbered(turns: DataFrame) -> DataFrame:
    """Turns with text, numbered from 1 in turn order."""
    spoken = turns.filter("spoken").select("event_id", "turn_no")
    ranked = prefix_sums(
        spoken,
        ["event_id"],
        {"block": F.floor(F.col("turn_no") / 4096)},
        ["turn_no"],
        {"earlier": F.lit(1).cast("bigint")},
    )
    return ranked.withColumn("segment_no", F.col("earlier") + 1).drop("earlier")


def _tail_segments(pages: DataFrame, pieces: DataFrame, turns: DataFrame) -> DataFrame:
    """Text after the last turn that has any: trailing empty turns form one segment without speaker."""
    state = (
        turns.groupBy("event_id")
        .agg(
            F.max("turn_no").alias("last_turn"),
            F.coalesce(F.max(F.when(F.col("spoken"), F.col("turn_no"))), F.lit(0)).alias("last_spoken"),
            F.count_if("spoken").alias("n_spoken"),
        )
        .filter("last_turn > last_spoken")
        .withColumn("turn_no", F.col("last_spoken") + 1)
    )
    starts = state.join(turns.select("event_id", "turn_no", "label_at"), ["event_id", "turn_no"]).select(
        "event_id",
        "n_spoken",
        F.when(F.col("last_spoken") == 0, F.lit(0)).otherwise(F.col("label_at")).alias("tail_at"),
    )
    reach = pieces.select("event_id", "page_no", "page_idx", "offset", "n_chars").distinct()
    touched = reach.join(starts, "event_id").filter(F.col("offset") + F.col("n_chars") > F.col("tail_at"))
    skipped = F.greatest(F.col("tail_at") - F.col("offset"), F.lit(0)).cast("int")
    raw = (
        _occupied(pages)
        .join(touched, ["event_id", "page_no"])
        .withColumn("text", F.substr("text", skipped + 1))
        .groupBy("event_id")
        .agg(
            F.first("n_spoken").alias("n_spoken"),
            F.first("tail_at").alias("tail_at"),
            _join_pieces("page_idx").alias("raw"),
        )
    )
    return _trimmed(raw, "raw", "tail_at").select(
        "event_id",
        (F.col("n_spoken") + 1).alias("segment_no"),
        "text",
        F.lit(None).cast("string").alias("speaker"),
        "start_char",
        "end_char",
    )


def _trimmed(df: DataFrame, raw: str, at: str) -> DataFrame:
    out = df.withColumn("text", strip(F.col(raw))).withColumn("start_char", F.col(at) + leading_space(F.col(raw)))
    return out.withColumn("end_char", F.col("start_char") + F.char_length("text"))


def segment_by_speaker(pages: DataFrame, window: int = 200, stride: int | None = None) -> DataFrame:
    """Speaker turns of each event; events without any label fall back to token windows.

    Text before the first label is dropped, turns without text are skipped, ids count what is left.
    Offsets are positions in the joined text of the event. The pieces are written once to the shared
    folder: numbering and tails read only their small columns.
    """
    pieces = materialize(_turn_pieces(pages), "turn-pieces")
    labelled = pieces.filter("turns > 0 AND turn_no > 0")
    turns = labelled.groupBy("event_id", "turn_no").agg(
        F.bool_or("spoken").alias("spoken"), F.max("label_at").alias("label_at")
    )
    whole = labelled.groupBy("event_id", "turn_no").agg(
        F.max("speaker").alias("speaker"), F.min("at").alias("at"), _join_pieces("page_idx").alias("raw")
    )
    spoken = _trimmed(whole.join(_numbered(turns), ["event_id", "turn_no"]), "raw", "at").select(
        "event_id", "segment_no", "text", "speaker", "start_char", "end_char"
    )
    by_turn = spoken.unionByName(_tail_segments(pages, pieces, turns)).select(
        "event_id",
        F.format_string("%s_S%04d", "event_id", "segment_no").alias("segment_id"),
        "text",
        "speaker",
        F.col("start_char").cast("bigint").alias("start_char"),
        F.col("end_char").cast("bigint").alias("end_char"),
    )
    # Without labels the only piece of a page is the page.
    plain = pieces.filter("turns = 0").select("event_id", "page_no", "text")
    return by_turn.unionByName(segment_by_window(plain, window, stride))


def segment_by_window(pages: DataFrame, window: int = 200, stride: int | None = None) -> DataFrame:
    """Windows of ``window`` tokens, one every ``stride`` tokens, short ones at the end included.

    ``start_char`` is the length of the joined earlier tokens, one separator short of the real place.
    """
    stride = window if stride is None else stride
    if window <= 0 or stride <= 0:
        raise ValueError("window and stride must be positive")
    tokens = F.split(strip(F.col("text")), f"{SPACE}+")
    words = _occupied(pages).select("event_id", "page_no", tokens.alias("tokens"))
    n_letters = F.char_length(F.array_join("tokens", "")).cast("bigint")
    sized = words.select(
        "event_id", "page_no", F.size("tokens").cast("bigint").alias("n_tokens"), n_letters.alias("n_letters")
    )
    placed = prefix_sums(
        materialize(sized, "page-tokens"),
        ["event_id"],
        _page_block(),
        ["page_no"],
        {"tokens_before": F.col("n_tokens"), "letters_before": F.col("n_letters")},
    )
    # From the first window that reaches into the page, and the stride cell its first token lies in.
    first = F.least(
        F.greatest(F.ceil((F.col("tokens_before") - window + 1) / stride), F.lit(0)),
        F.floor(F.col("tokens_before") / stride),
    )
    last = F.floor((F.col("tokens_before") + F.col("n_tokens") - 1) / stride)

    def part(start: Column, length: int) -> Column:
        low = F.greatest(start - F.col("tokens_before"), F.lit(0)).cast("int")
        high = F.least(start + length - F.col("tokens_before"), F.col("n_tokens")).cast("int")
        return F.slice("tokens", low + 1, F.greatest(high - low, F.lit(0)))

    parts = F.transform(
        F.sequence(first, last),
        lambda w: F.struct(
            w.alias("w"),
            F.array_join(part(w * stride, window), " ").alias("text"),
            F.char_length(F.array_join(part(w * stride, stride), "")).alias("letters"),
        ),
    )
    rows = words.join(placed, ["event_id", "page_no"]).select(
        "event_id", "page_no", "tokens_before", "letters_before", F.explode(parts).alias("p")
    )
    inside = Window.partitionBy("event_id", "page_no").orderBy("p.w").rowsBetween(Window.unboundedPreceding, -1)
    letters = F.col("letters_before") + F.coalesce(F.sum("p.letters").over(inside), F.lit(0))
    at = F.col("p.w") * stride
    rows = rows.withColumn(
        "start_char",
        F.when(at >= F.col("tokens_before"), letters + F.greatest(at - 1, F.lit(0))),
    ).filter(F.col("p.text") != "")
    ordered = F.array_sort(F.collect_list(F.struct("page_no", F.col("p.text").alias("piece"))))
    joined = F.array_join(F.transform(ordered, lambda x: x["piece"]), " ")
    return (
        rows.groupBy("event_id", F.col("p.w").alias("w"))
        .agg(joined.alias("text"), F.max("start_char").alias("start_char"))
        .select(
            "event_id",
            F.format_string("%s_W%04d", "event_id", F.col("w") + 1).alias("segment_id"),
            "text",
            F.lit(None).cast("string").alias("speaker"),
            F.col("start_char").cast("bigint").alias("start_char"),
            (F.col("start_char") + F.char_length("text")).cast("bigint").alias("end_char"),
        )
    )


def segment(pages: DataFrame, mode: str = "speaker_turn", window: int = 200, stride: int | None = None) -> DataFrame:
    """Segments of cleaned pages in one of the two modes."""
    if mode == "speaker_turn":
        return segment_by_speaker(pages, window, stride)
    if mode == "fixed_window":
        return segment_by_window(pages, window, stride)
    raise ValueError(f"unsupported segmentation mode: {mode}")


def merge_pages(pages: DataFrame) -> DataFrame:
    """``(event_id, text)``: non-blank pages in order, joined by a blank line.

    The result is one value per event by definition, so it is for events that fit a row; the segment
    operators work on the pages themselves and do not use it.
    """
    return _occupied(pages).groupBy("event_id").agg(_join_pieces("page_no").alias("text"))
