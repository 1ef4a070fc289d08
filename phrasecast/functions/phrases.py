"""Phrase and speaker patterns, built once on the driver and used as literal regexes."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from phrasecast.functions.text import SPACE, WORD, strip

# Apostrophes of possessives, and what may stand between the words of a phrase.
APOSTROPHES = "'’"
DASHES = "-‐‑–—"
BETWEEN_WORDS = rf"(?:{SPACE}+|{SPACE}*[{DASHES}]{SPACE}*)"
BETWEEN_SPEAKER_WORDS = rf"(?:{SPACE}+|[{DASHES}]{SPACE}*)"

# Plural rules as (ending, characters dropped, ending added).
PLURAL_RULES = [
    (r"", 0, "s"),
    (r"(?:s|x|z|ch|sh)", 0, "es"),
    (r"[^aeiou]y", 1, "ies"),
    (r"f", 1, "ves"),
    (r"fe", 2, "ves"),
    (r"us", 2, "i"),
    (r"is", 2, "es"),
    (r"o", 0, "es"),
]

_EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def literal(text: str) -> str:
    """Quote ``text`` for a Java regex."""
    return "".join("\\" + c if c.isascii() and not (c.isalnum() or c in "_ ") else c for c in text)


def target_slug(term: str) -> str:
    """Column name of a phrase: ``target__`` and the lower-case words joined by underscores."""
    words = re.findall(r"[a-z0-9]+", term.lower())
    return "target__" + ("_".join(words) or "term")


def slug_column(term: Column) -> Column:
    """``target_slug`` for a column of phrases."""
    body = F.regexp_replace(F.regexp_replace(F.lower(term), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit("target__"), F.when(body == "", F.lit("term")).otherwise(body))


def word_forms(word: str) -> set[str]:
    """A word with its plural and possessive spellings, lower case."""
    base = word.lower()
    plurals = {
        base[: len(base) - cut] + added
        for ending, cut, added in PLURAL_RULES
        if re.search(f"{ending}$", base)
    }
    owners = {base + mark + "s" for mark in APOSTROPHES}
    bare = {form + mark for form in plurals | {base} if form.endswith("s") for mark in APOSTROPHES}
    return {base} | plurals | owners | bare


#: Classes of phrase tokens: what a token looks like, and the spellings that count for it. The first that fits holds.
TOKEN_CLASSES = [
    (re.compile(r"\d+"), lambda token: [token + ending for ending in ("st", "nd", "rd", "th", "")]),
    (re.compile(r"[A-Za-z]+"), word_forms),
    (re.compile(r".+", re.S), lambda token: [token]),
]


def _spellings(token: str) -> str:
    """Regex of all spellings of a token, longest first."""
    forms = next(spell(token) for shape, spell in TOKEN_CLASSES if shape.fullmatch(token))
    return "(?:" + "|".join(literal(f) for f in sorted(forms, key=lambda f: (-len(f), f))) + ")"


def _bounded(tokens: Iterable[str], gap: str, before: str, after: str) -> str:
    """Token patterns with ``gap`` between them and a boundary on either side."""
    return before + gap.join(tokens) + after


@dataclass(frozen=True)
class Phrase:
    """One tracked phrase: its column, its Java regex (None for a blank term) and its first words."""

    term: str
    column: str
    pattern: str | None
    first_words: tuple[str, ...]

    @classmethod
    def of(cls, term: str) -> "Phrase":
        # a slash separates alternatives; a term of nothing but slashes stands for itself
        split = [words for words in map(str.split, term.split("/")) if words] or [words for words in [term.split()] if words]
        bodies = [_bounded(map(_spellings, words), BETWEEN_WORDS, f"(?<!{WORD})", f"(?!{WORD})") for words in split]
        pattern = "(?iu)" + "|".join(bodies) if bodies else None
        return cls(term, target_slug(term), pattern, tuple(sorted({w[0].lower() for w in split})))

    def hit(self, text: Column, prefilter: bool = True) -> Column:
        """Whether ``text`` holds the phrase.

        The prefilter also asks for the first word of some alternative as a plain substring. It is
        part of the published labels: an irregular plural alone ("policies" for "policy") is no hit.
        """
        if self.pattern is None:
            return F.contains(F.lower(text), F.lit(self.term.lower()))
        found = text.rlike(self.pattern)
        if not prefilter:
            return found
        low = F.lower(text)
        seen = F.lit(False)
        for word in self.first_words:
            seen = seen | F.contains(low, F.lit(word))
        return seen & found

    def count(self, text: Column) -> Column:
        """Number of non-overlapping matches, without the prefilter."""
        if self.pattern is None:
            if not self.term:
                return F.char_length(text) + 1
            return F.regexp_count(F.lower(text), F.lit(literal(self.term.lower())))
        return F.regexp_count(text, F.lit(self.pattern))


def vocabulary(terms: Iterable[str]) -> list[Phrase]:
    """Phrases of a term list; two terms with the same column are an error."""
    phrases = [Phrase.of(term) for term in terms]
    seen: set[str] = set()
    for phrase in phrases:
        if phrase.column in seen:
            raise ValueError(f"two target terms map to the column {phrase.column!r}")
        seen.add(phrase.column)
    return phrases


def speaker_pattern(term: str) -> str:
    """Regex of one speaker term: a word-bounded phrase, or the text after ``regex:`` as it is."""
    term = term.strip()
    if term.lower().startswith("regex:"):
        body = term[len("regex:"):].strip()
        if not body:
            raise ValueError("a regex: speaker term needs a pattern")
        return f"(?:{body})"
    return _bounded(map(literal, term.split()), BETWEEN_SPEAKER_WORDS, _EDGE, _EDGE)


def _any_of(terms: Iterable[str] | None) -> str | None:
    bodies = [speaker_pattern(t) for t in terms or [] if t and t.strip()]
    return "(?iu)" + "|".join(bodies) if bodies else None


def speaker_allowed(
    speaker: Column, include: Iterable[str] | None = None, exclude: Iterable[str] | None = None
) -> Column:
    """Exclude beats include; a blank speaker passes only without an include list."""
    wanted, unwanted = _any_of(include), _any_of(exclude)
    name = strip(F.coalesce(speaker, F.lit("")))
    keep = F.lit(True) if wanted is None else name.rlike(wanted)
    if unwanted is not None:
        keep = keep & ~name.rlike(unwanted)
    return F.when(name == "", F.lit(wanted is None)).otherwise(keep)


def humanise_slug(column: Column, label: Column) -> Column:
    """The label when there is one, else the slug as words, else a fixed placeholder."""
    words = F.translate(F.regexp_replace(column, "^target__", ""), "_", " ")
    return F.coalesce(
        F.when(label != "", label), F.when(column != "", words), F.lit("Tracked phrase")
    )
