"""Every registered query against its independent DuckDB statement, plus the
entry smoke check.  Runs on sf0.001 (fast); the driver repeats it on sf0.01.
"""

import os
import sys

import pytest

from tests.conftest import SF_SMALL
from tests.oracle_check import compare
from tidepool.plans.catalog import QUERIES

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as E  # noqa: E402


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["post_id", "author_id", "full_text_hash", "hashtag"]
    assert df.count() >= 0


def test_every_key_has_sql_or_is_declared_rows_only():
    assert set(QUERIES) - set(E.oracle_sql()) == {"normalize_unicode"}


@pytest.fixture(scope="module")
def results(spark):
    return compare(spark, SF_SMALL, keys=sorted(QUERIES), verbose=False)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_oracle(results, key):
    status = results[key]
    assert status[0] in ("OK", "rows-only"), status
    if status[0] == "OK":
        assert not status[3], f"column types differ: {status[3]}"
