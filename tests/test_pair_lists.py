"""Pairs of representatives are taken apart from lists of ids, so rows aren't joined after they're multiplied."""

import duckdb
import pytest

from kinweave.plans import catalogue, views as V
from tests.test_copies import copied  # noqa: F401
from tests.test_plans import needs_data, rows


@needs_data
@pytest.mark.parametrize("listed", [1, 3, 1024])
def test_masks_of_every_pair(spark, copied, listed, monkeypatch):  # noqa: F811
    """However long the lists are; one id in two different rows is its own representative."""
    def joined(*_):
        raise AssertionError("multiplied rows are joined")

    monkeypatch.setattr(V, "each_s1", joined)
    monkeypatch.setattr(V, "LISTED", listed)
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW part AS SELECT * FROM '{copied}/part.parquet'")
    want = connection.sql(catalogue.ORACLE_SQL["fake_pattern_masks"]).df()
    assert rows(catalogue.QUERIES["fake_pattern_masks"](spark, copied).toPandas()) == rows(want)


@needs_data
def test_lists_are_bounded(spark, copied, monkeypatch):  # noqa: F811
    monkeypatch.setattr(V, "LISTED", 3)
    lists = [r["ids"] for r in V._listed(spark, copied, False, V.SCORED).collect()]
    assert max(map(len, lists)) == 3
    assert sorted(i for own in lists for i in own) == sorted(r["entity_id"] for r in V.twins(spark, copied, False).collect())
