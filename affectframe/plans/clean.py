"""From raw posts to cleaned posts with the authors' groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from affectframe.functions.once import with_column_once
from affectframe.functions.predicates import has_words, mentions_any
from affectframe.functions.text import clean_text
from affectframe.operators.counts import stage_counts
from affectframe.operators.filters import drop_events, drop_short
from affectframe.operators.joins import join_authors
from affectframe.schemas import CLEANED_POSTS


def cleaned(posts: DataFrame, strict_emoji: bool = False) -> DataFrame:
    return with_column_once(posts, "Text", clean_text(F.col("Text"), strict_emoji))


def clean_posts(
    posts: DataFrame,
    authors: DataFrame,
    strict_emoji: bool = False,
    *,
    seen: Observation | None = None,
) -> DataFrame:
    """Cleaned posts without event announcements and short texts, with party and side.

    The authors come first: whatever way their join takes, each text is cleaned once
    after it. With a dimension small enough to be broadcast all is one narrow stage. The
    job that writes the rows fills ``seen``, for :func:`removed_rows`.
    """
    ready = cleaned(join_authors(posts, authors), strict_emoji)
    if seen is not None:
        text = F.col("Text")
        ready = ready.observe(
            seen, F.count("*").alias("rows"), F.count_if(mentions_any(text)).alias("events"),
            F.count_if(~mentions_any(text) & ~has_words(text)).alias("short"),
        )
    return drop_short(drop_events(ready)).select(*CLEANED_POSTS.fieldNames())


def removed_rows(seen: Observation) -> list[tuple[str, int, int]]:
    """Name, rows removed and rows kept of each cleaning filter, as counted while writing."""
    counts = seen.get
    left = counts["rows"] - counts["events"]
    return [
        ("event announcements", counts["events"], left),
        ("short texts", counts["short"], left - counts["short"]),
    ]


def clean_report(posts: DataFrame, strict_emoji: bool = False) -> DataFrame:
    """How many posts each cleaning filter removes and keeps."""
    text = F.col("Text")
    return stage_counts(cleaned(posts, strict_emoji), {
        "event announcements": ~mentions_any(text), "short texts": has_words(text),
    })
