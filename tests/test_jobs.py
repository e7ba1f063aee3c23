import pytest
from pyspark.sql import functions as F

from kinweave.operators import metrics, splits
from kinweave.operators.contracts import ContractError
from kinweave.operators.score_join import union_sources
from kinweave.plans import linkage, pair_data, selection

PAIR = "source1_entity_id string, candidate_source string, candidate_entity_id string"
FEATURES = {"neural_fusion": ["tree_logit", "neural_logit_feature"], "tree_only": ["tree_logit"]}


@pytest.fixture(scope="module")
def scored(spark):
    rows, labels, parts, truth = [], [], [], []
    for i in range(90):
        parts.append((f"S1-{i}", ("fusion_fit", "calibration", "selection")[i % 3]))
        for j, (s, route) in enumerate((("S2", "neural_fusion"), ("S3", "tree_only"), ("S3", "discard"))):
            key = (f"S1-{i}", s, f"{s}-{i}{'x' * (j // 2)}")
            true = int(i % 4 < 2 and j < 2) ^ int(i % 17 == 0)
            score = 0.0 if j == 2 else min(0.95, max(0.05, 0.7 * true + 0.15 + (i % 7 - 3) / 30))
            rows.append((*key, score, int(j == 0), int(j == 0), route, score if j == 0 else None, True))
            labels.append((*key, true))
            if true:
                truth.append((key[0], key[2]))
    scores = spark.createDataFrame(rows, PAIR + ", tree_score double, neural_requested int, has_neural_score int, decision_route string, neural_probability double, source_group_complete boolean")
    return scores, spark.createDataFrame(labels, PAIR + ", label int"), spark.createDataFrame(parts, "source1_entity_id string, member_partition string"), spark.createDataFrame(truth, "source1_entity_id string, candidate_entity_id string")


def test_selection(scored):
    scores, labels, parts, truth = scored
    chosen = selection.select_threshold(scores, labels, parts, truth, FEATURES)
    assert chosen.best["macro_f05"] > 0.9 and {d["decoder"] for d in chosen.decoders} == {"threshold", "threshold_best_owner"}
    edges = selection.apply_selection(scores, chosen)
    queries = parts.select("source1_entity_id")
    assert metrics.macro(metrics.score_entities(queries, truth, edges)).first()["macro_f05"] > 0.85
    broken = scores.withColumn("has_neural_score", F.lit(0))
    with pytest.raises(ContractError):
        selection.select_threshold(broken, labels, parts, truth, FEATURES)


def test_fallback(spark, scored):
    scores, labels, parts, truth = scored
    order = spark.createDataFrame([(i, f"S1-{i}") for i in range(90)], "position long, source1_entity_id string")
    s2 = spark.createDataFrame([(f"S2-{i}",) for i in range(90)], "entity_id string")
    s3 = spark.createDataFrame([(f"S3-{i}{x}",) for i in range(90) for x in ("", "x")], "entity_id string")
    candidates, matches = selection.tree_only_fallback(scores, labels, parts, order, truth, s2, s3)
    assert matches.count() == 90 and candidates.where("candidate_entity_ids LIKE '%x%'").count() == 0


def test_pair_data(spark, tmp_path):
    s1 = spark.createDataFrame([(f"S1-{i}", f"Name {i}", "", "US") for i in range(60)], "entity_id string, business_name string, business_address string, country string")
    s2 = spark.createDataFrame([(f"S2-{i}", f"Name {i}", "", "US") for i in range(60)], s1.schema)
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(40)], "source1_entity_id string, candidate_entity_id string")
    folds = splits.create_folds(s1, truth, s2)
    cand = spark.createDataFrame([(f"S1-{i}", "S2", f"S2-{(i + j) % 60}", 1 - j / 10) for i in range(60) for j in range(1, 9)], PAIR + ", retrieval_score double")
    config = pair_data.PairDataConfig(train_queries=20, held_out_queries=12, threshold_queries=6, hard_negatives=3, other_negatives=1, target_rows=20)
    queries = pair_data.choose_queries(s1, truth, folds, config)
    subsets = {r["subset"]: r["count"] for r in queries.groupBy("subset").count().collect()}
    assert subsets["train"] >= 20 and subsets.get("threshold", 0) + subsets.get("final", 0) >= 12
    sizes = pair_data.prepare(cand, queries, truth, folds, s1, union_sources(s2=s2), str(tmp_path / "pairs"), config)
    rows = spark.read.parquet(str(tmp_path / "pairs/train"))
    assert sizes["train"] == rows.count() and rows.where("candidate_fold = 0").count() == 0
    positives = truth.join(queries.where("subset = 'train'"), "source1_entity_id", "left_semi").count()
    assert rows.where("label = 1").count() == positives and "label" not in spark.read.parquet(str(tmp_path / "pairs/final")).columns


def test_sweep(spark):
    cand = spark.createDataFrame([("S1-1", "S2", f"S2-{i}", 1 - i / 10, 0, i + 1, 0) for i in range(5)], PAIR + ", retrieval_score double, retrieved_by_exact int, name_rank int, address_rank int")
    queries = spark.createDataFrame([("S1-1",), ("S1-2",)], "source1_entity_id string")
    truth = spark.createDataFrame([("S1-1", "S2-3")], "source1_entity_id string, candidate_entity_id string")
    got = {(r["cut"], r["value"]): r for r in linkage.sweep(cand, queries, truth, 5, 0, (2, 4), (1,)).collect()}
    assert got[("k", 2)]["recall"] == 0 and got[("k", 4)]["recall"] == 1 and got[("budget", 1)]["total_candidate_pairs"] == 1
