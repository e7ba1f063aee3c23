"""Tables full of equal records: work by sets of equal records, results as SQL gives them for every record."""

import duckdb
import pytest

from kinweave.plans import catalogue, views as V
from tests.test_plans import SF, needs_data, rows

BY_SETS = [
    "best_owner", "competition_features", "context_features", "contract_violations", "difficult_nonmatches", "edge_metrics_by_source", "fake_pattern_masks",
    "gate_audit_cutoffs", "hard_negatives", "macro_f05_by_country", "match_count_distribution", "prune_budget", "ranked_lists", "route_metrics", "slice_k",
    "slices_grouping_sets", "submission_violations", "threshold_search", "assemble_matches",
]


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    """Parts four times with shifted keys, one key in two different rows."""
    folder = tmp_path_factory.mktemp("copies")
    copies = f"SELECT p_partkey + i * 300 AS p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM '{SF}/part.parquet', range(4) t(i) WHERE p_partkey < 80"
    duckdb.sql(f"COPY ({copies} UNION ALL SELECT 7, p_name, p_brand, p_type, p_size, p_retailprice FROM '{SF}/part.parquet' WHERE p_partkey = 30) TO '{folder}/part.parquet' (FORMAT parquet)")
    return str(folder)


@needs_data
@pytest.mark.parametrize("name", BY_SETS)
def test_equal_records_are_met_once(spark, copied, name, monkeypatch):
    def every_pair(*_):
        raise AssertionError("all pairs of all copies are made")

    monkeypatch.setattr(V, "candidates", every_pair)
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW part AS SELECT * FROM '{copied}/part.parquet'")
    want = connection.sql(catalogue.ORACLE_SQL[name]).df()
    assert rows(catalogue.QUERIES[name](spark, copied).toPandas()) == rows(want)


@needs_data
def test_pairs_are_scored_once_for_equal_records(spark, copied):
    assert V.scored(spark, copied).count() * 4 < V.candidates(spark, copied).count()


@needs_data
def test_pairs_are_scored_in_all_tasks(spark, copied):
    """The tables are small and the pairs many, so a join over the file's one split isn't enough."""
    assert V.scored(spark, copied).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
