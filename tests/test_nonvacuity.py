"""SURVEY 5.6: every filter both keeps and drops rows on the sf0.01 fixture."""

import pytest

from tests.conftest import SF_CHECK
from tidepool.plans.catalog import QUERIES
from tidepool.sources.tables import Tables

FILTERS = {
    "post_gate": "posts", "post_blocklist": "posts", "posts_search": "posts",
    "anti_seen_hash": "posts", "semi_exists": "posts", "news_blocklist": "news",
    "news_age_filter": "news", "anti_seen_news": "news", "near_dup_vs_latest": "news",
    "anti_seen_mention": "mentions", "longest_hashtag": "responses",
}
FLAGS = {
    "hashtag_ratio_gate": "passed", "lexicon_flag": "flagged", "response_flags": "flagged",
    "response_length_gate": "length_ok", "mention_replied": "replied",
}


@pytest.mark.parametrize("key", sorted(FILTERS))
def test_filter_keeps_and_drops(spark, key):
    n_in = getattr(Tables(spark, SF_CHECK), FILTERS[key]).count()
    n_out = QUERIES[key](spark, SF_CHECK).count()
    assert 0 < n_out < n_in


@pytest.mark.parametrize("key", sorted(FLAGS))
def test_flag_takes_both_values(spark, key):
    vals = {r[0] for r in QUERIES[key](spark, SF_CHECK).select(FLAGS[key]).distinct().collect()}
    assert vals == {True, False}
