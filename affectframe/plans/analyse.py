"""The analysis of labelled posts: the data behind every chart and printed summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affectframe.constants import (
    EVENT_DATE,
    EVENT_PARTIES,
    EXCLUDED_TOPICS,
    FOCUS_TOPICS,
    SERIES_EMOTIONS,
)
from affectframe.operators.counts import (
    LABEL,
    explode_labels,
    focus_topics,
    fold_small_shares,
    roll_up,
    with_percentage,
)
from affectframe.operators.filters import drop_values
from affectframe.operators.ranking import top_counts, top_line
from affectframe.operators.series import adaptive_series, event_series, pivot_series
from affectframe.schemas import require_columns
from affectframe.session import new_dir


def topic_tops(counts: DataFrame, topics: DataFrame) -> DataFrame:
    """The most frequent label of each party within each of the listed topics."""
    chosen = counts.join(F.broadcast(topics.select("topic", "position")), "topic")
    return top_counts(chosen, ["topic", "party"], n=1)


def topic_shares(
    counts: DataFrame, topics: DataFrame | None = None, max_topics: int = 4, **options
) -> DataFrame:
    """Label shares within topics, small shares folded: within the listed topics, or
    within the ``max_topics`` with most labels."""
    counts = roll_up(counts, ["topic", LABEL])
    if topics is None:
        totals = roll_up(counts, ["topic"])
        topics = totals.orderBy(F.desc("count"), F.asc("topic")).limit(max_topics)
    chosen = counts.join(F.broadcast(topics.select("topic")), "topic")
    return fold_small_shares(chosen, "topic", **options)


def analyse(
    posts: DataFrame,
    *,
    excluded_topics: Sequence[str] = EXCLUDED_TOPICS,
    focus: Sequence[str] = FOCUS_TOPICS,
    series_emotions: Sequence[str] = SERIES_EMOTIONS,
    event_date: str = EVENT_DATE,
    event_months: int = 2,
    event_parties: Sequence[str] = EVENT_PARTIES,
    event_emotions: Sequence[str] = SERIES_EMOTIONS,
    missing_label: str | None = None,
    path: str | None = None,
) -> dict[str, DataFrame]:
    """Result tables by name. Tables whose columns the posts lack are left out.

    The posts are counted once, by party, side, topic and list of labels together; that
    small table is written to ``path`` (or to a new folder in the shared one). Lists are
    taken apart in there, not in the posts, and all counts and shares are rolled up from
    it. Only the two time series read the posts again.
    """
    require_columns(posts, ["Author", "party", LABEL])
    spark = posts.sparkSession
    path = path or new_dir(spark, "counts")
    # Null keys stay in here: which rows a null excludes depends on the table asked for.
    keys = [c for c in ("party", "political_side", "topic", LABEL) if c in posts.columns]
    posts.groupBy(*keys).count().write.mode("overwrite").parquet(path)

    def explode(counted: DataFrame) -> DataFrame:
        return explode_labels(counted, missing_label=missing_label)

    cells = explode(spark.read.parquet(path))
    counts = roll_up(cells, ["party", LABEL])
    top = top_counts(counts, "party")
    tables = {
        "party_counts": counts,
        "party_top3": top,
        "party_top3_lines": top_line(top, "party"),
        "party_shares": with_percentage(counts, "party"),
    }
    if "topic" in keys:
        rest = roll_up(drop_values(cells, "topic", excluded_topics), ["party", LABEL])
        by_topic = roll_up(cells, ["topic", "party", LABEL])
        topics = focus_topics(by_topic, focus)
        tables |= {
            "party_shares_without_excluded": with_percentage(rest, "party"),
            "party_top3_without_excluded": top_counts(rest, "party"),
            "focus_topics": topics,
            "topic_party_tops": topic_tops(by_topic, topics),
            "topic_party_shares": with_percentage(
                by_topic.join(F.broadcast(topics.select("topic")), "topic"), ["topic", "party"]
            ),
            "topic_shares": topic_shares(cells, topics),
        }
    if "political_side" in keys:
        sides = roll_up(cells, ["political_side", LABEL])
        tables |= {
            "side_top3": top_counts(sides, "political_side"),
            "side_shares": with_percentage(sides, "political_side"),
        }
    series = adaptive_series(posts, series_emotions, explode=explode)
    if series is not None:
        tables["series"] = pivot_series(series, series_emotions)
        event = event_series(
            posts, event_date, event_months, emotions=event_emotions,
            parties=event_parties, selected=series_emotions, explode=explode,
        )
        tables["event_series"] = pivot_series(
            event, event_emotions or series_emotions, by=["party", "ts_period"]
        )
    return tables
