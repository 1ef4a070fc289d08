"""Text cleaning as column expressions over the text of one page."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What counts as whitespace, as a line break and as a word character. The far ranges stand
# behind one range check, so that a letter is dismissed after two tests.
SPACE = (
    r"[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
)
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = r"\r\n|[\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"
WORD = r"[\p{L}\p{N}_]"

# Whitespace that may stand inside a line, once all line breaks are written as \n.
BLANK = r"[\t\x1f \xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u202f\u205f\u3000]]]"

# Lines dropped at the top and at the bottom of a page.
HEADER_LINE = rf"{BLANK}*(?:page{BLANK}+\p{{Nd}}|federal reserve|press{BLANK}+conference)[^\n]*"
FOOTER_LINE = rf"{BLANK}*(?:\p{{Nd}}+{BLANK}*/{BLANK}*\p{{Nd}}+|\*+){BLANK}*"

# Words allowed inside a speaker label.
CONNECTORS = ["of", "the", "and", "for", "to", "in", "on", "at", "with"]
TITLES = [
    "mr", "mrs", "ms", "dr", "prof", "professor", "chair", "chairman", "chairwoman",
    "vice", "gov", "governor", "president",
]
LABEL_HEAD = r"^([A-Za-z][A-Za-z. \-']{1,60}) *[:.]"

_CONNECTOR = f"(?i:{'|'.join(CONNECTORS)})"
_LABEL_WORD = f"(?:[A-Z]+|[A-Z][a-z]+|{_CONNECTOR}|(?i:{'|'.join(TITLES)}))"
_LABEL_SHAPE = f"^{_LABEL_WORD}(?: {_LABEL_WORD}){{0,7}}$"
_ONLY_CONNECTORS = f"^{_CONNECTOR}(?: {_CONNECTOR})*$"


def strip(text: Column) -> Column:
    """Remove whitespace, in the Unicode sense, from both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def leading_space(text: Column) -> Column:
    """Number of whitespace characters at the start."""
    return F.char_length(text) - F.char_length(F.ltrim(text, F.lit(SPACE_CHARS)))


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(rf"\A{SPACE}*+\z")


def harmonise_punctuation(text: Column) -> Column:
    """En/em dashes become ``-``, curly quotes become straight ones."""
    return F.translate(text, "–—’‘“”", "--''\"\"")


def unify_line_breaks(text: Column) -> Column:
    return F.regexp_replace(text, LINE_BREAK, "\n")


def drop_header_lines(text: Column) -> Column:
    """Drop leading lines while they look like a page header; a blank line ends the header."""
    return F.regexp_replace(text, rf"(?iu)\A(?:{HEADER_LINE}(?:\n|\z))+", "")


def drop_footer_lines(text: Column) -> Column:
    """Drop trailing lines while they look like a page footer; a final line break is no line."""
    return F.regexp_replace(text, rf"(?:(?:\n|\A){FOOTER_LINE})+\n?\z", "")


def normalise_lines(text: Column) -> Column:
    """Collapse whitespace inside lines, trim lines, drop blank lines."""
    flat = F.regexp_replace(F.regexp_replace(text, f"{BLANK}+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(flat, r"\A[ \n]+|[ \n]+\z", "")


def is_speaker_label(label: Column) -> Column:
    """Up to eight words, each a connector, a title, ALL CAPS or Capitalised; not connectors only."""
    words = F.regexp_replace(F.trim(label), r"['.\-]", "")
    return words.rlike(_LABEL_SHAPE) & ~words.rlike(_ONLY_CONNECTORS)


def _relabel(line: Column) -> Column:
    whole = F.regexp_extract(line["text"], LABEL_HEAD, 0)
    rest = F.ltrim(F.substr(line["text"], F.char_length(whole) + 1))
    name = F.replace(F.upper(F.trim(line["label"])), F.lit("."), F.lit(""))
    return F.when(
        (line["label"] != "") & is_speaker_label(line["label"]),
        F.when(rest == "", F.concat(name, F.lit(":"))).otherwise(F.concat(name, F.lit(": "), rest)),
    ).otherwise(line["text"])


def normalise_labels(text: Column) -> Column:
    """Write speaker labels at line starts as ``NAME: rest``; lines must be normalised."""
    seen = F.transform(
        F.split(text, "\n"),
        lambda line: F.struct(line.alias("text"), F.regexp_extract(line, LABEL_HEAD, 1).alias("label")),
    )
    return F.array_join(F.transform(seen, _relabel), "\n")


def clean_page(text: Column) -> Column:
    """All cleaning steps for the text of one page; each step reads its input once."""
    lines = unify_line_breaks(harmonise_punctuation(text))
    return normalise_labels(normalise_lines(drop_footer_lines(drop_header_lines(lines))))


def speaker_list(text: Column) -> Column:
    """Comma-separated names to an array of trimmed, non-blank names."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), strip), lambda s: s != "")
