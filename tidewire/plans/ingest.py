"""A whole run: feeds, pages, dedup, stories, counts and the generation request."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators import runs as R
from tidewire.operators.stories import stories_after
from tidewire.plans.dedup import Outcome, clear, process
from tidewire.plans.state import State
from tidewire.session import cut
from tidewire.sources.feeds import feed_articles, feed_errors, in_feed_order, parse_feeds
from tidewire.sources.pages import page_extract


@dataclass
class Run:
    outcome: Outcome
    counts: DataFrame
    requests: DataFrame
    urls: DataFrame
    stories: DataFrame
    feed_errors: DataFrame


def ingest(
    feed_documents: DataFrame,
    pages: DataFrame,
    state: State,
    stories: DataFrame,
    now: datetime,
    embedder,
    run_id: str,
    reset: bool = False,
    count: int = 10,
    prefix: str = "",
    run: int = 0,
) -> Run:
    """Run every step over landed feed documents (``feed, xml``) and pages (``url, html``).

    ``run`` numbers the runs, so that a later one's segments follow in the stories.
    ``reset`` forgets the past first.  A broken feed is reported and skipped.
    """
    parsed = parse_feeds(feed_documents)
    listed = in_feed_order(feed_articles(parsed, now, count))
    # Read by the dedup, the store and the stories: extracted once.
    articles = cut(page_extract(listed, pages), "articles")
    outcome = process(articles, clear(state) if reset else state, now, embedder, prefix)
    judged = (
        outcome.results.join(articles.select("seq", "url"), "seq").withColumn("run_id", F.lit(run_id))
    )
    segments, _ = stories_after(stories, articles, outcome.results, run=run)
    return Run(
        outcome,
        R.status_counts(judged, ["run_id"]),
        R.generation_requests(judged, ["run_id"]),
        R.new_urls(judged, ["run_id"]),
        segments,
        feed_errors(parsed),
    )
