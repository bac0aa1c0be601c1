"""The registered queries: every operator at work on the test tables, with the SQL that
has to give the same rows.

The tables stand in for posts: an order is a labelled post (customer = author, market
segment = party, region = political side, status = topic, priority = emotion), a
document is a post's text, an event a post of a stream.
"""

from affectframe.queries import analysis, ingest, jobs, models, regression, running, series, sketches, texts, topics  # noqa: F401
from affectframe.queries.registry import REGISTRY

__all__ = ["REGISTRY"]
