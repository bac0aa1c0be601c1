"""Text cleaning as column expressions.

Word characters, white space and word boundaries are spelled out as Unicode
classes: the short forms ``\\w``, ``\\s`` and ``\\b`` are ASCII in Java and would
treat letters such as ``ı`` or ``ş`` as separators.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from affectframe.constants import KEPT_SHORT_WORDS, MISSING_TOKENS, PICTOGRAPH_RANGES
from affectframe.functions.once import bind

# Bodies of character classes.
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
# ASCII letters as a case-insensitive match sees them: the dotted capital I, the
# dotless i, the long s and the Kelvin sign fold onto ASCII letters.
FOLDED_ASCII = r"A-Za-z\x{130}\x{131}\x{17F}\x{212A}"

# A whole word "RT". Starting on the letter keeps the scan cheap: the look-behind
# runs only where an R was found.
_REPOST = rf"[Rr](?<![{WORD}][Rr])[Tt](?![{WORD}])"
_REPOST_MENTION = rf"{_REPOST}[{SPACE}]*+@[{FOLDED_ASCII}0-9_]+"
_REPOST_ADDRESSED = rf"{_REPOST_MENTION}:?[{SPACE}]*+"

# Range "$-_" holds digits, capitals and the punctuation of URLs. One possessive
# class scans in constant stack; an alternation of classes recurses per character.
_URL_BODY = r"[a-z!$-_]++"
_URL = rf"https?://{_URL_BODY}"
_WWW = rf"www\.{_URL_BODY}"
_SHORT_LINK = r"t\.co/[a-zA-Z0-9]++"

_MENTION = r"@[A-Za-z0-9_]++"
_HASHTAG = r"#([A-Za-z0-9_]++)"


def _char_class(ranges: Iterable[tuple[int, int]]) -> str:
    """Body of a class for inclusive ranges, touching and overlapping ones merged."""
    merged: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if merged and low <= merged[-1][1] + 1:
            low, previous = merged.pop()
            high = max(high, previous)
        merged.append((low, high))
    return "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for low, high in merged)


PICTOGRAPHS = _char_class(PICTOGRAPH_RANGES)
# The last range of the fixed list spans CJK, Hangul and the variation selectors
# as well. The strict form keeps only its enclosed signs.
STRICT_PICTOGRAPHS = _char_class(
    PICTOGRAPH_RANGES[:-1] + ((0x24C2, 0x24C2), (0x1F170, 0x1F251))
)
_KEPT = rf"{WORD}{SPACE}.,!?\-"


def _remove(text: Column, mark: str, *patterns: str) -> Column:
    """Remove patterns one after the other from texts that contain ``mark``.

    Looking for a plain mark costs a fraction of a pass of a pattern, and most texts
    have none.
    """
    return bind(text, lambda t: F.when(t.contains(mark), _remove_all(t, *patterns)).otherwise(t))


def _remove_all(text: Column, *patterns: str) -> Column:
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, "")
    return text


def strip_repost_marks(text: Column) -> Column:
    """Remove ``RT @name:`` openings, then any bare word ``RT``."""
    passes = (_REPOST_ADDRESSED, _REPOST_MENTION, _REPOST)
    return bind(text, lambda t: F.when(t.rlike(_REPOST), _remove_all(t, *passes)).otherwise(t))


def strip_urls(text: Column) -> Column:
    """Remove http(s) URLs, ``www.`` addresses and bare ``t.co/…`` links, in this order."""
    return _remove(_remove(_remove(text, "http", _URL), "www.", _WWW), "t.co/", _SHORT_LINK)


def strip_mentions(text: Column) -> Column:
    """Remove ``@name:`` and ``@name``; the second pass sees names the first one uncovered."""
    return _remove(text, "@", _MENTION + ":?", _MENTION)


def unwrap_hashtags(text: Column) -> Column:
    return F.regexp_replace(text, _HASHTAG, "$1")


def strip_emoji(text: Column, strict: bool = False) -> Column:
    return F.regexp_replace(text, f"[{STRICT_PICTOGRAPHS if strict else PICTOGRAPHS}]+", "")


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def strip_special(text: Column) -> Column:
    """Keep letters, digits, underscore, white space and ``. , ! ? -``."""
    return F.regexp_replace(text, f"[^{_KEPT}]+", "")


def drop_short_words(text: Column, kept: Iterable[str] = KEPT_SHORT_WORDS) -> Column:
    """Keep words longer than two characters and the listed short ones, one space apart."""
    kept = list(kept)
    words = F.split(text, f"[{SPACE}]+")
    return F.array_join(
        F.filter(words, lambda w: (F.length(w) > 2) | F.lower(w).isin(kept)), " "
    )


def clean_text(text: Column, strict_emoji: bool = False) -> Column:
    """All cleaning steps; a missing text becomes the empty string.

    The character-wise steps (hashtag signs, pictographs, special characters) only
    delete single characters, so one class removes them in one pass; the word
    splitting at the end takes care of white space and trimming.
    """
    pictographs = STRICT_PICTOGRAPHS if strict_emoji else PICTOGRAPHS
    # Most characters are plain ones: sorting them out first makes the scan much faster.
    dropped = f"(?![a-zA-Z0-9 .,])[[^{_KEPT}][{pictographs}]]+"
    text = strip_mentions(strip_urls(strip_repost_marks(text)))
    return F.coalesce(drop_short_words(F.regexp_replace(text, dropped, "")), F.lit(""))


def is_blank(text: Column) -> Column:
    """Missing, empty or white space only."""
    return F.coalesce(~text.rlike(f"[^{SPACE}]"), F.lit(True))


def lower_text(text: Column, locale: str | None = None) -> Column:
    """Lower case; ``locale="tr"`` maps the two capital I of Turkish to their own letters."""
    if locale == "tr":
        text = F.translate(text, "İI", "iı")
    return F.lower(text)


def tokens(text: Column) -> Column:
    """Array of lower-case words; empty strings may stand at either end."""
    return F.split(F.lower(text), f"[^{WORD}]+")


def spaced_words(text: Column) -> Column:
    """The same words with a space between them; a space may stand at either end."""
    return F.regexp_replace(F.lower(text), f"[^{WORD}]+", " ")


def capitalize(text: Column) -> Column:
    """First character in title case, all others lower, whatever the number of words."""
    lowered = F.lower(text)
    head = F.substring(text, 1, 1)
    # Lower-casing the head may change its length, so cut by its lowered form.
    tail = F.substring(lowered, F.length(F.lower(head)) + 1, F.length(lowered))
    return F.concat(F.initcap(head), tail)


def slug(name: Column) -> Column:
    """Lower case with underscores for blanks, for output names."""
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def preview(text: Column, length: int = 200) -> Column:
    """Start of a text, followed by dots where it goes on."""
    dots = F.when(F.length(text) > length, F.lit("...")).otherwise(F.lit(""))
    return F.concat(F.substring(text, 1, length), dots)


def missing_to_null(value: Column, spellings: Iterable[str] = MISSING_TOKENS) -> Column:
    """Null for every spelling of "missing"; meant for key and label columns."""
    return F.when(~value.isin(list(spellings)), value)
