"""train_pairs_inject on tables full of equal records."""

import duckdb
import pytest

from kinweave.plans import catalogue, views as V
from tests.test_plans import SF, needs_data, rows


@pytest.fixture(scope="module")
def dealt(tmp_path_factory):
    """Parts eleven times, copies in every source, so that more are true than are retrieved, one key in two different rows."""
    folder = tmp_path_factory.mktemp("dealt")
    copies = f"SELECT p_partkey + i * 400 AS p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM '{SF}/part.parquet', range(11) t(i)"
    duckdb.sql(f"COPY ({copies} UNION ALL SELECT 7, p_name, p_brand, p_type, p_size, p_retailprice FROM '{SF}/part.parquet' WHERE p_partkey = 30) TO '{folder}/part.parquet' (FORMAT parquet)")
    return str(folder)


@needs_data
def test_training_pairs_of_equal_records(spark, dealt, monkeypatch):
    """Neither all pairs nor all true pairs are made before they are chosen."""
    def every_pair(*_):
        raise AssertionError("all pairs of all copies are made")

    for name in ("candidates", "candidates_of_representatives", "truth"):
        monkeypatch.setattr(V, name, every_pair)
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW part AS SELECT * FROM '{dealt}/part.parquet'")
    want = connection.sql(catalogue.ORACLE_SQL["train_pairs_inject"]).df()
    got = rows(catalogue.QUERIES["train_pairs_inject"](spark, dealt).toPandas())
    assert got == rows(want)
    assert want["injected"].sum() > 0 and (want["label"] == 0).any()


@needs_data
def test_first_candidates_are_those_of_all_ranks(spark, dealt):
    want = V.candidates_of_representatives(spark, dealt).where("address_rank <= 3").select("source1_entity_id", "candidate_entity_id", "address_tfidf_score")
    got = V.first_of_representatives(spark, dealt, "address_tfidf_score", 3).select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
