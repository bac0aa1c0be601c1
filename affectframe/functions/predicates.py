"""Row predicates on posts, as boolean columns that are never null."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from affectframe.constants import CELEBRATION_PATTERNS, EVENT_KEYWORDS, MEMORIAL_PATTERNS
from affectframe.functions.once import bind
from affectframe.functions.text import WORD, lower_text


def is_repost(text: Column) -> Column:
    return F.coalesce(text.startswith("RT @"), F.lit(False))


def is_ceremonial(
    text: Column,
    patterns: Iterable[str] = MEMORIAL_PATTERNS + CELEBRATION_PATTERNS,
    locale: str | None = None,
) -> Column:
    """Any pattern occurs in the lower-cased text as whole words."""
    whole_words = rf"(?<![{WORD}])(?:{'|'.join(patterns)})(?![{WORD}])"
    return F.coalesce(lower_text(text, locale).rlike(whole_words), F.lit(False))


def essential_substrings(keywords: Iterable[str]) -> list[str]:
    """Keywords without those that contain another keyword, which already decides them."""
    keywords = list(dict.fromkeys(keywords))
    return [k for k in keywords if not any(o != k and o in k for o in keywords)]


def mentions_any(
    text: Column, keywords: Iterable[str] = EVENT_KEYWORDS, locale: str | None = None
) -> Column:
    """Any keyword is a substring of the lower-cased text."""
    essential = essential_substrings(keywords)
    if not essential:
        return F.lit(False)

    def found(lowered: Column) -> Column:
        return reduce(or_, (lowered.contains(keyword) for keyword in essential))

    return F.coalesce(bind(lower_text(text, locale), found), F.lit(False))


def has_words(text: Column, at_least: int = 3) -> Column:
    """At least so many runs of word characters.

    Anchored and possessive: the match stops at the last word it needs and cannot
    backtrack, so a 20,000-word text costs no more than a short one.
    """
    run = f"[^{WORD}]*+[{WORD}]++"
    return F.coalesce(text.rlike(f"^(?:{run}){{{at_least}}}"), F.lit(False))
