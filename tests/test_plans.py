import os
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from kinweave.plans import catalogue, linkage
from kinweave.operators import models
from kinweave.streaming import pairs as streams

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(str(tuple(round(float(v), 5) if isinstance(v, float) else v for v in r)) for r in plain.values.tolist())


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got, want = __spark_entry__.queries()[name](spark, SF).toPandas(), connection.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_training_operators():
    for path in ROOT.joinpath("kinweave").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"kinweave\.llm|from \.+llm|import llm", path.read_text(encoding="utf-8")), path


def test_entry_works_without_the_training_operators(tmp_path):
    for name in ("kinweave", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "kinweave/llm")], check=True)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0 and int(done.stdout.split()[0]) == len(catalogue.QUERIES), done.stderr


def write(path, lines):
    path.write_text("\n".join("\t".join(line) for line in lines) + "\n", encoding="utf-8")
    return str(path)


def test_linkage_end_to_end(spark, tmp_path):
    head = ("entity_id", "business_name", "business_address", "country")
    names = ["Acme Tools", "Beta Foods", "Gamma Steel", "Delta Glass", "Omega Paper", "Sigma Cloth"]
    train = {
        "s1": write(tmp_path / "s1.tsv", [head, *((f"S1-{i}", n, f"{i} High Road", "US") for i, n in enumerate(names))]),
        "s2": write(tmp_path / "s2.tsv", [head, *((f"S2-{i}", n + " Ltd", f"{i} High Road", "US") for i, n in enumerate(names))]),
        "s3": write(tmp_path / "s3.tsv", [head, ("S3-0", "Acme Toolshed", "77 Low Lane", "IN")]),
        "truth": write(tmp_path / "truth.tsv", [("source1_entity_id", "matched_entity_ids"), *((f"S1-{i}", f"S2-{i}" if i < 5 else "") for i in range(6))]),
    }
    test = {
        "s1": write(tmp_path / "t1.tsv", [head, ("S1-9", "Acme Tools", "1 High Road", "US"), ("S1-8", "Nothing Alike", "", ""), ("S1-7", "Beta Foods", "2 High Road", "US")]),
        "s2": write(tmp_path / "t2.tsv", [head, ("S2-1", "Acme Tools Ltd", "1 High Road", "US"), ("S2-2", "Beta Foods", "2 High Road", "US")]),
    }
    config = linkage.LinkageConfig(top_k_name=3, top_k_address=3, model=models.PairModelConfig(iterations=3))
    report = linkage.run(spark, train, test, str(tmp_path / "out"), config)
    assert 0 <= report["threshold"] <= 1 and "name_sequence_ratio" in report["features"] and "country_exact" not in report["features"]
    lines = (tmp_path / "out/matches.tsv").read_text().splitlines()
    assert [x.split("\t")[0] for x in lines] == ["source1_entity_id", "S1-9", "S1-8", "S1-7"]


def test_streams(spark, tmp_path):
    spark.createDataFrame([("S2-1", "ACME!"), ("S2-2", "none")], "entity_id string, business_name string").write.parquet(str(tmp_path / "in"))
    s1 = spark.createDataFrame([("S1-1", "acme")], "entity_id string, business_name string")
    stream = spark.readStream.schema("entity_id string, business_name string").parquet(str(tmp_path / "in"))
    query = streams.write_parts(streams.exact_lookup(stream, s1), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["entity_id"], r["source1_entity_id"]) for r in got] == [("S2-1", "S1-1")]
