"""tidepool: social-text curation as Spark DataFrame jobs.

Layout
------
functions/  pure Column expressions (text cleaning, tokens, dates)
sources/    table loading, fixture views, history tables (read/append/evolve/sync)
operators/  DataFrame -> DataFrame jobs (gates, dedup, replies, similarity, news,
            responses)
plans/      the registered queries (one callable per key) and their SQL oracles
streaming/  Structured Streaming jobs over arriving files
"""

from tidepool.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
