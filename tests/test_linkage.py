import json
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kinweave.operators import assembly, components, context, contracts, decode, metrics, models, neural, retrieval, sampling, score_join, splits
from kinweave.operators.components import connected_components
from kinweave.sources import manifests, tables

import numpy as np

PAIR = "source1_entity_id string, candidate_source string, candidate_entity_id string"
SOURCE = "entity_id string, business_name string, business_address string, country string"


@pytest.fixture(scope="module")
def sources(spark):
    s1 = spark.createDataFrame([("S1-1", "Acme Ltd", "1 Road", "US"), ("S1-2", "Beta Shop", "", "IN"), ("S1-3", "", "9 Lane", "US")], SOURCE)
    s2 = spark.createDataFrame([("S2-1", "ACME, ltd.", "1 Road", "US"), ("S2-2", "Beta Shops", "2 Road", ""), ("S2-3", "", "", "US"), ("S2-4", "Acme Ltd", "7 Hill", "IN")], SOURCE)
    s3 = spark.createDataFrame([("S3-1", "Gamma", "9 Lane", "US")], SOURCE)
    return s1, s2, s3


def pairs_of(df):
    return sorted((r["source1_entity_id"], r["candidate_entity_id"]) for r in df.collect())



def brute_channel(s1, source, at, k):
    """Top k of each S1 by the cosine of character 2-4 grams found in two rows: (s1, candidate): (score, rank)."""
    def grams(t):
        return [t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)]

    df = Counter(g for r in source for g in set(grams(r[at] or "")))
    idf = {g: math.log((1 + len(source)) / (1 + n)) + 1 for g, n in df.items() if n >= 2}

    def vector(t):
        v = {g: n * idf[g] for g, n in Counter(grams(t or "")).items() if g in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / size for g, x in v.items()}

    known, out = [(r[0], vector(r[at])) for r in source], {}
    for r in s1:
        own = vector(r[at])
        found = sorted((-round(sum(x * v.get(g, 0.0) for g, x in own.items()), 9), c) for c, v in known)
        out |= {(r[0], c): (-score, place) for place, (score, c) in enumerate(found[:k], 1) if score < 0}
    return out


def test_all_channels_against_brute_force(spark):
    rng = random.Random(4)
    names, streets = ["acme", "acne", "beta", "better", "gamma", "gamut", "shop", "shops"], ["hill", "hall", "road", "broad", "lane", "lake"]

    def records(source, n):
        out = [(f"{source}-{i:02}", " ".join(rng.choices(names, k=rng.randint(1, 3))), f"{rng.randint(10, 40)} {rng.choice(streets)}", "US") for i in range(n)]
        return [*out, (f"{source}-97", None, None, None), (f"{source}-98", "", "", ""), (f"{source}-99", out[0][1], out[0][2], "US")]

    s1, s2, s3 = records("S1", 12), records("S2", 25), records("S3", 20)
    want = defaultdict(lambda: {"name": (0.0, 0), "address": (0.0, 0), "exact": 0})
    for source in (s2, s3):
        for at, kind in ((1, "name"), (2, "address")):
            for pair, found in brute_channel(s1, source, at, 6).items():
                want[pair][kind] = found
            for a in s1:
                for b in source:
                    if a[at] and a[at] == b[at]:
                        want[a[0], b[0]]["exact"] = 1
    frames = [spark.createDataFrame(r, SOURCE) for r in (s1, s2, s3)]
    got = retrieval.generate_candidates(frames[0], {"S2": frames[1], "S3": frames[2]}, 6, 6).collect()
    assert len(got) == len(want) > 150
    for r in got:
        w = want[r["source1_entity_id"], r["candidate_entity_id"]]
        # the scores of the two engines may differ in the 9th digit
        assert (r["name_rank"], r["address_rank"], r["retrieved_by_exact"]) == (w["name"][1], w["address"][1], w["exact"]), r
        assert r["name_tfidf_score"] == pytest.approx(w["name"][0], abs=2e-9) and r["address_tfidf_score"] == pytest.approx(w["address"][0], abs=2e-9)


def test_exact_and_tfidf(sources):
    s1, s2, s3 = sources
    assert pairs_of(retrieval.exact_matches(s1, s2, "business_name", "S2")) == [("S1-1", "S2-1"), ("S1-1", "S2-4")]
    ranked = retrieval.exact_matches(s1, s2, "business_name", "S2", ranked=True).orderBy("rank").collect()
    assert [(r["rank"], r["frequent_key_expansion"], r["retrieval_provenance"]) for r in ranked] == [(1, 0, "exact"), (2, 0, "exact")]
    assert pairs_of(retrieval.tfidf_channel(s1, s2, "business_name", 1, "S2")) == [("S1-1", "S2-1")], "grams of one row only don't count"
    found = retrieval.tfidf_channel(s1, s2, "business_name", 1, "S2", min_df=1).collect()
    assert {r["source1_entity_id"]: r["candidate_entity_id"] for r in found} == {"S1-1": "S2-1", "S1-2": "S2-2"}
    assert all(r["score"] > 0 for r in found)
    small = retrieval.tfidf_channel(s1, s3, "business_address", 5, "S3").collect()
    assert ("S1-3", "S3-1") in [(r["source1_entity_id"], r["candidate_entity_id"]) for r in small], "one row falls back to grams of any row"


def test_union_and_pruning(spark, sources):
    s1, s2, s3 = sources
    out = {(r["source1_entity_id"], r["candidate_entity_id"]): r for r in retrieval.generate_candidates(s1, {"S2": s2, "S3": s3}, 5, 5).collect()}
    assert out[("S1-1", "S2-1")]["retrieved_by_exact"] == 1 and out[("S1-1", "S2-1")]["retrieval_score"] >= 1.0 and out[("S1-1", "S2-1")]["retrieved_by_address"] == 1
    assert ("S1-2", "S2-2") not in out and out[("S1-3", "S3-1")]["address_rank"] == 1 and out[("S1-3", "S3-1")]["name_rank"] == 0
    rows = [("S1-1", "S2", f"S2-{i}", 0.1 * i, int(i < 2)) for i in range(6)]
    df = spark.createDataFrame(rows, PAIR + ", retrieval_score double, retrieved_by_exact int")
    assert pairs_of(retrieval.prune(df, 3)) == [("S1-1", "S2-0"), ("S1-1", "S2-1"), ("S1-1", "S2-5")]
    assert pairs_of(retrieval.prune(df, 1)) == [("S1-1", "S2-0"), ("S1-1", "S2-1")]
    with pytest.raises(ValueError):
        retrieval.prune(df, 1, "error")
    assert retrieval.prune(df, None) is df


def test_countries(spark, sources):
    s1, s2, s3 = sources
    pairs = spark.createDataFrame([("S1-1", "S2", "S2-1"), ("S1-1", "S2", "S2-2"), ("S1-1", "S2", "S2-4")], PAIR)
    records = score_join.union_sources(s2=s2, s3=s3)
    assert pairs_of(retrieval.same_country(pairs, s1, records)) == [("S1-1", "S2-1"), ("S1-1", "S2-2")]
    assert pairs_of(retrieval.same_country(pairs, s1, records, keep_blank=False)) == [("S1-1", "S2-1")]


def test_dense(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(300)], "id long, vector array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = retrieval.dense_top_k(df.where("id < 20"), df, 5, block=64).collect()
    for q in range(20):
        want = np.argsort(-np.round(u @ u[q], 9), kind="stable")[:5].tolist()
        assert [r["candidate_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


CONTEXT = [("S1-1", "S2", "S2-1", 0.9, None), ("S1-1", "S2", "S2-2", 0.9, None), ("S1-1", "S3", "S3-1", 0.86, None), ("S1-2", "S2", "S2-1", 0.95, None), ("S1-3", "S2", "S2-1", None, "training_injected_positive")]


def test_windows(spark):
    df = spark.createDataFrame(CONTEXT, PAIR + ", retrieval_score double, retrieval_provenance string")
    c = {(r["source1_entity_id"], r["candidate_entity_id"]): r for r in context.add_context(df).collect()}
    assert [c[("S1-1", x)]["retrieval_score_rank"] for x in ("S2-1", "S2-2", "S3-1")] == [1, 2, 3]
    assert c[("S1-1", "S2-1")]["near_tie_count"] == 3 and c[("S1-1", "S2-1")]["is_strongest_s2_candidate"] == 1 and c[("S1-1", "S2-2")]["is_strongest_s2_candidate"] == 0 and c[("S1-1", "S3-1")]["is_strongest_s3_candidate"] == 1
    assert c[("S1-2", "S2-1")]["best_second_retrieval_score_gap"] == 0 and c[("S1-3", "S2-1")]["retrieval_score"] == -1
    k = {(r["source1_entity_id"], r["candidate_entity_id"]): r for r in context.add_competition(df).collect()}
    assert k[("S1-2", "S2-1")]["competing_s1_rank"] == 1 and k[("S1-1", "S2-1")]["competing_s1_count"] == 2 and round(k[("S1-1", "S2-1")]["competing_s1_score_gap"], 9) == 0.05
    assert k[("S1-3", "S2-1")]["competing_s1_count"] == 0 and k[("S1-3", "S2-1")]["best_competing_s1_score"] is None and k[("S1-3", "S2-1")]["is_injected_positive"] == 1
    bad = df.withColumn("retrieval_provenance", F.lit(None).cast("string"))
    with pytest.raises(ValueError):
        context.add_context(bad)
    with pytest.raises(ValueError):
        context.add_competition(df, margin=-1)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def _brute_components(edges):
    low = {x: x for e in edges for x in e}
    while True:
        new = dict(low)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == low:
            return low
        low = new


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, kind):
    rng = random.Random(4)
    ends = [(rng.randrange(900), rng.randrange(900)) for _ in range(420)] + [(5000, k) for k in range(1000, 1100)]
    edges = [(a, b) if kind == "long" else (f"é{a}", f"é{b}") for a, b in ends]
    table = spark.createDataFrame(edges * 2, f"src {kind}, dst {kind}")
    jobs = []
    for limit in (len(edges) * 2, 0):
        monkeypatch.setattr(components, "ONE_TASK", limit)
        spark.sparkContext.setJobGroup(f"components-{kind}-{limit}", "")
        got = [tuple(r) for r in connected_components(table).collect()]
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{kind}-{limit}")))
        want = _brute_components([e for e in edges if e[0] != e[1]])
        assert len(got) == len(dict(got)) and dict(got) == want
    assert jobs[0] <= 4 < jobs[1]


def test_folds_keep_components_together(spark):
    s1 = spark.createDataFrame([(f"S1-{i}", "US" if i % 2 else None) for i in range(120)], "entity_id string, country string")
    edges = [(f"S1-{i}", f"S2-{i // 2}") for i in range(60)]
    truth = spark.createDataFrame(edges, "source1_entity_id string, candidate_entity_id string")
    others = spark.createDataFrame([(f"S3-{i}",) for i in range(90)], "entity_id string")
    folds = splits.create_folds(s1, truth, others)
    assert splits.cross_fold_edges(folds, truth).count() == 0
    sizes = {r["fold"]: r["count"] for r in folds.groupBy("fold").count().collect()}
    assert sum(sizes.values()) == 120 + 30 + 90 and max(sizes.values()) - min(sizes.values()) <= 12
    again = splits.create_folds(s1, truth, others)
    assert folds.exceptAll(again).count() == 0
    leak = folds.withColumn("fold", F.when(F.col("entity_id") == "S1-0", 99).otherwise(F.col("fold")))
    assert splits.cross_fold_edges(leak, truth).count() == 1
    parts = splits.partition_queries(s1, truth)
    assert {r[0] for r in parts.select("member_partition").distinct().collect()} == set(splits.PROPORTIONS)
    both = truth.join(parts, "source1_entity_id").groupBy("candidate_entity_id").agg(F.count_distinct("member_partition").alias("n"))
    assert both.where("n > 1").count() == 0
    chosen = splits.select_queries(s1, truth, folds, [0, 1], 30)
    assert 30 <= chosen.count() <= 34
    with pytest.raises(ValueError):
        splits.select_queries(s1, truth, folds.where("entity_id <> 'S1-5'"), [0], 5)


def test_large_components_are_placed(spark):
    s1 = spark.createDataFrame([(f"S1-{i}", "US") for i in range(400)], "entity_id string, country string")
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i // 100}") for i in range(300)], "source1_entity_id string, candidate_entity_id string")
    folds = splits.create_folds(s1, truth)
    assert splits.cross_fold_edges(folds, truth).count() == 0
    assert {r[0] for r in folds.where("entity_id LIKE 'S2-%'").select("fold").collect()} == {0, 1, 2}


def test_f05(spark):
    truth = {"a": {"x"}, "b": {"x"}, "c": {"x", "y"}, "d": set(), "e": set(), "f": {"x"}}
    guess = {"a": {"x"}, "b": {"x", "y"}, "c": {"x"}, "d": {"x"}, "e": set(), "f": set()}
    table = lambda d: spark.createDataFrame([(k, v) for k, own in d.items() for v in own], "source1_entity_id string, candidate_entity_id string")
    queries = spark.createDataFrame([(k,) for k in truth], "source1_entity_id string")
    scored = metrics.score_entities(queries, table(truth), table(guess))
    got = {r["source1_entity_id"]: round(r["f05"], 6) for r in scored.collect()}
    assert got == {"a": 1.0, "b": round(5 / 9, 6), "c": round(5 / 6, 6), "d": 0.0, "e": 1.0, "f": 0.0}
    row = metrics.macro(scored).first()
    assert row["singleton_accuracy"] == 0.5 and row["entities"] == 6
    edge = metrics.edge_metrics(table(truth), table(guess)).first()
    assert (edge["tp"], edge["fp"], edge["fn"]) == (3, 2, 2)


def test_expected_f05():
    rng = np.random.default_rng(1)
    for _ in range(30):
        p = np.sort(rng.random(rng.integers(1, 7)))[::-1]

        def brute(k):
            if not k:
                return float(np.prod(1 - p))
            total = 0.0
            for bits in np.ndindex(*(2,) * len(p)):
                weight = np.prod([x if b else 1 - x for x, b in zip(p, bits)])
                total += weight * 5 * sum(bits[:k]) / (4 * k + sum(bits))
            return total

        values = [brute(k) for k in range(len(p) + 1)]
        assert all(abs(decode.expected_f05(p[:k], p[k:]) - v) < 1e-12 for k, v in enumerate(values))
        assert abs(values[decode.best_prefix(p)] - max(values)) < 1e-9


def scored_pairs(spark):
    rows = [("S1-A", "S2", "S2-1", 0.8, 0.9), ("S1-B", "S2", "S2-1", 0.8, 0.9), ("S1-B", "S2", "S2-2", 0.7, 0.6), ("S1-C", "S3", "S3-1", 0.2, 0.1)]
    return spark.createDataFrame(rows, PAIR + ", tree_score double, match_probability double").withColumn("source_group_complete", F.lit(True))


def test_decoders(spark):
    pairs = scored_pairs(spark)
    owned = {r["candidate_entity_id"]: r for r in decode.best_owner(pairs, 0.5).collect()}
    assert owned["S2-1"]["chosen_owner"] == "S1-A" and owned["S2-2"]["chosen_owner"] == "S1-B" and owned["S3-1"]["chosen_owner"] == "" and not owned["S3-1"]["ownership_selected"]
    with pytest.raises(ValueError):
        decode.best_owner(pairs.drop("source_group_complete"))
    queries = spark.createDataFrame([("S1-A",), ("S1-B",), ("S1-C",)], "source1_entity_id string")
    lists = {r[0]: r[1] for r in decode.as_lists(queries, decode.by_threshold(pairs, 0.6)).collect()}
    assert lists == {"S1-A": "S2-1", "S1-B": "S2-1,S2-2", "S1-C": ""}
    truth = spark.createDataFrame([("S1-A", "S2-1"), ("S1-B", "S2-2")], "source1_entity_id string, candidate_entity_id string")
    audit = metrics.ownership_audit(truth)
    results = decode.select_decoder(queries, truth, pairs, audit=audit, expected=True)
    assert results[0]["decoder"] == "threshold_best_owner" and results[0]["macro_f05"] == 1.0 and results[0]["threshold"] == 0.15
    low, _ = decode.tune_threshold(queries, truth, pairs, "match_probability")
    high, _ = decode.search_threshold(queries, truth, pairs, "match_probability", tie="high")
    assert low == 0.15 and abs(high - 0.6) < 1e-9
    shared = truth.union(spark.createDataFrame([("S1-C", "S2-1")], truth.schema))
    with pytest.raises(ValueError):
        decode.best_owner(pairs, audit=metrics.ownership_audit(shared))


def test_sampling(spark):
    rows = [("S1-1", "S2", f"S2-{i}", 1 - i / 100) for i in range(20)]
    cand = spark.createDataFrame(rows, PAIR + ", retrieval_score double")
    truth = spark.createDataFrame([("S1-1", "S2-3"), ("S1-1", "S3-9")], "source1_entity_id string, candidate_entity_id string")
    queries = spark.createDataFrame([("S1-1",)], "source1_entity_id string")
    held = spark.createDataFrame([("S2-0",)], "entity_id string")
    got = sampling.training_pairs(cand, queries, truth, 4, 2, held_out=held).collect()
    assert sum(r["label"] for r in got) == 2 and len(got) == 8
    assert {r["candidate_entity_id"] for r in got if r["positive_injected_for_training"]} == {"S3-9"}
    assert "S2-0" not in {r["candidate_entity_id"] for r in got}
    labelled = sampling.add_labels(cand, truth)
    folds = spark.createDataFrame([("S1-1", 0), ("S2-3", 1)], "entity_id string, fold int")
    with pytest.raises(ValueError):
        sampling.add_folds(labelled, folds)
    assert sampling.hard_rows(labelled, 3).count() == 4


def test_score_join_contracts(spark):
    key = [("S1-1", "S2", "S2-1"), ("S1-1", "S3", "S3-1")]
    cand = spark.createDataFrame(key, PAIR)
    tree = spark.createDataFrame([(*key[0], 0.9), (*key[1], 0.2)], PAIR + ", score double")
    routes = spark.createDataFrame([(*key[0], "neural"), (*key[1], "tree")], PAIR + ", route string")
    scores = spark.createDataFrame([(*key[0], 0.7)], PAIR + ", score double")
    out = {r["candidate_entity_id"]: r for r in score_join.join_scores(cand, tree, routes, scores).collect()}
    assert out["S2-1"]["has_neural_score"] == 1 and out["S2-1"]["decision_route"] == "neural_fusion" and out["S3-1"]["neural_probability"] is None
    assert contracts.joined_violations(score_join.join_scores(cand, tree, routes, scores)).count() == 0
    for broken in ((tree.limit(1), routes, scores), (tree, routes.limit(1), scores), (tree, routes, None), (tree, routes, scores.withColumn("candidate_entity_id", F.lit("S2-9")))):
        with pytest.raises(contracts.ContractError):
            score_join.join_scores(cand, *broken)
    bad = spark.createDataFrame([("S1-1", "S2", "S3-1"), ("", "S2", "S2-1"), ("S1-2", "S9", "S2-2")], PAIR)
    assert {r["rule"] for r in contracts.key_violations(bad).collect()} == {"prefix against source", "empty S1 id", "unknown source"}
    with pytest.raises(contracts.ContractError):
        contracts.check_features(["name_exact", "truth_x"])


def test_logistic_equals_plain_newton(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    y = (x @ [1.0, -2.0] + rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, label int")
    fitted = models.fit_logistic(df, ["a", "b"], balanced=True)
    design = np.c_[x, np.ones(300)]
    weight = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
    w = np.zeros(3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-design @ w))
        w -= np.linalg.solve((design.T * (weight * p * (1 - p))) @ design + np.diag([1, 1, 0]), design.T @ (weight * (p - y)) + [w[0], w[1], 0])
    assert np.allclose([*fitted.weights, fitted.intercept], w, atol=1e-6)
    with pytest.raises(contracts.ContractError):
        models.fit_logistic(df.withColumn("label", F.lit(1)), ["a"])


def test_fusion_and_calibration(spark):
    rows, labels, parts = [], [], []
    for i in range(60):
        part = "fusion_fit" if i < 30 else "calibration"
        parts.append((f"S1-{i}", part))
        for s in ("S2", "S3"):
            key = (f"S1-{i}", s, f"{s}-{i}")
            score = (i * 7 % 30) / 30
            rows.append((*key, score, "neural_fusion" if s == "S2" else "tree_only", score, i % 4))
            labels.append((*key, int(score > 0.4) ^ int(i % 9 == 0)))
    scores = spark.createDataFrame(rows, PAIR + ", tree_score double, decision_route string, neural_probability double, competing_s1_count int")
    marks, split = spark.createDataFrame(labels, PAIR + ", label int"), spark.createDataFrame(parts, "source1_entity_id string, member_partition string")
    features = {"neural_fusion": ["tree_logit", "neural_logit_feature"], "tree_only": ["tree_logit", "competing_s1_count"]}
    fused = models.apply_fusion(scores, models.fit_fusion(scores, marks, split, features))
    platt = models.apply_calibration(fused, models.fit_calibration(fused, marks, split))
    steps = models.apply_calibration(fused, models.fit_calibration(fused, marks, split, "isotonic", least=2))
    for out in (platt, steps):
        got = out.where("decision_route = 'tree_only'").orderBy("fusion_score").collect()
        values = [r["match_probability"] for r in got]
        assert all(0 <= v <= 1 for v in values) and values == sorted(values)
    with pytest.raises(contracts.ContractError):
        models.fit_fusion(scores, marks.limit(3), split, features)
    assert models.tree_only(scores).select("decision_route").distinct().collect()[0][0] == "tree_only"


def test_out_of_fold_sees_no_end_of_the_fold(spark):
    rows = [(f"S1-{i}", "S2", f"S2-{i}-{j}", i % 3, (i + j) % 3, int(j == 0), float(j == 0)) for i in range(12) for j in range(3)]
    df = spark.createDataFrame(rows, PAIR + ", source1_fold int, candidate_fold int, label int, name_x double").withColumn("retrieval_score", F.col("name_x"))
    seen = []

    def fit(part, features, config):
        seen.append({(r["source1_fold"], r["candidate_fold"]) for r in part.collect()})
        return models.ConstantModel(0.5)

    out = models.out_of_fold(df, ["name_x"], fit=fit)
    assert out.count() == len(rows) and all(f not in pair for f, own in enumerate(seen) for pair in own)
    model = models.fit_pair_model(df, ["name_x"], models.PairModelConfig(iterations=3))
    got = {r["candidate_entity_id"]: r["score"] for r in models.predict_pairs(model, df).collect()}
    assert got["S2-0-0"] > 0.5 > got["S2-0-1"]


def test_assembly(spark, sources):
    s1, s2, s3 = sources
    order = spark.createDataFrame([(0, "S1-2"), (1, "S1-1"), (2, "S1-3")], "position long, source1_entity_id string")
    decisions = spark.createDataFrame([("S1-1", "S2", "S2-1", "tree_only"), ("S1-1", "S2", "S2-4", "discard"), ("S1-3", "S3", "S3-1", "neural_fusion")], PAIR + ", decision_route string")
    chosen = decisions.where("candidate_entity_id = 'S2-1'")
    candidates, matches = assembly.assemble(decisions, chosen, order, s2, s3)
    assert [(r[1], r[2]) for r in matches.orderBy("position").collect()] == [("S1-2", ""), ("S1-1", "S2-1"), ("S1-3", "")]
    assert {r[1]: r[2] for r in candidates.collect()} == {"S1-1": "S2-1", "S1-2": "", "S1-3": "S3-1"}
    with pytest.raises(contracts.ContractError):
        assembly.assemble(decisions, decisions.where("candidate_entity_id = 'S2-4'"), order, s2, s3)
    both = decisions.union(spark.createDataFrame([("S1-2", "S2", "S2-1", "tree_only")], decisions.schema))
    with pytest.raises(contracts.ContractError):
        assembly.assemble(both, both.where("candidate_entity_id = 'S2-1'"), order, s2, s3)
    lists = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-9", "S2-77")], "source1_entity_id string, matched_entity_ids string")
    assert {r["rule"] for r in assembly.submission_violations(order, lists, s2, s3).collect()} == {"missing S1", "unknown S1", "repeated candidate", "unknown candidate"}


def test_files(spark, tmp_path):
    path = tmp_path / "s1.tsv"
    path.write_text('entity_id\tbusiness_name\tcountry\n S1-1\tNA\tUS\nS1-2\tÉlite "x"\t\n00123\t\tnull\n', encoding="utf-8")
    got = {r["entity_id"]: r for r in tables.load_source(spark, str(path)).collect()}
    assert got["S1-1"]["business_name"] == "NA" and got["S1-2"]["country"] == "" and got["00123"]["country"] == "null" and got["S1-2"]["business_address"] == ""
    assert [r["source1_entity_id"] for r in tables.load_query_order(spark, str(path)).orderBy("position").collect()] == ["S1-1", "S1-2", "00123"]
    path.write_text("entity_id\tbusiness_name\nS1-1\ta\nS1-1\tb\n")
    with pytest.raises(contracts.ContractError):
        tables.load_source(spark, str(path))
    truth = tmp_path / "truth.tsv"
    truth.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S2-2,S2-1\nS1-2\t\n")
    queries, edges = tables.load_truth(spark, str(truth))
    assert queries.count() == 2 and pairs_of(edges) == [("S1-1", "S2-1"), ("S1-1", "S2-2")]
    grouped = spark.createDataFrame([("S1-1", "S2-2, S2-1,"), ("S1-2", None)], "source1_entity_id string, candidate_entity_ids string")
    assert [(r["position"], r["candidate_entity_id"]) for r in tables.explode_candidates(grouped).orderBy("position").collect()] == [(0, "S2-2"), (1, "S2-1")]
    out = tmp_path / "out.tsv"
    lists = spark.createDataFrame([(1, "S1-2", ""), (0, "S1-1", "S2-1,S2-2")], "position long, source1_entity_id string, matched_entity_ids string")
    tables.write_single(lists, str(out), "position")
    assert out.read_text() == "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-2\nS1-2\t\n"
    with pytest.raises(FileExistsError):
        tables.write_single(lists, str(out), "position")
    rows = spark.createDataFrame([(f"S1-{i // 7}", i) for i in range(200)], "source1_entity_id string, n int")
    tables.write_grouped(rows, str(tmp_path / "parts"), ["source1_entity_id"], 40)
    assert tables.split_groups(spark.read.parquet(str(tmp_path / "parts")), ["source1_entity_id"]).count() == 0


def test_query_order_follows_names_and_lines(spark, tmp_path):
    """Spark packs splits by size; positions go by file name and line all the same."""
    (tmp_path / "a.tsv").write_text("entity_id\n" + "".join(f"S1-a{i}\n" for i in range(3)))
    (tmp_path / "b.tsv").write_text("entity_id\n" + "".join(f"S1-b{i}\n" for i in range(5000)))
    (tmp_path / "c.tsv").write_text("entity_id\n" + "".join(f"S1-c{i}\n" for i in range(40)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = tables.load_query_order(spark, str(tmp_path)).orderBy("position").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["position"] for r in got] == list(range(5043))
    assert [r["source1_entity_id"] for r in got] == [*(f"S1-a{i}" for i in range(3)), *(f"S1-b{i}" for i in range(5000)), *(f"S1-c{i}" for i in range(40))]


def test_saved_index_is_built_once(spark, tmp_path):
    source = spark.createDataFrame([(f"S2-{i}", f"common name {i % 7}", "x") for i in range(40)], "entity_id string, business_name string, norm_business_name string").drop("norm_business_name")
    config = retrieval.IndexConfig()
    first = retrieval.saved_index(source, config, str(tmp_path), "s2-name", {"s2": "one"})
    assert sorted((r["key"], r["gram"], round(r["weight"], 9)) for r in first.collect()) == sorted((r["key"], r["gram"], round(r["weight"], 9)) for r in retrieval.build_index(source, config).collect())
    made = json.loads((tmp_path / "s2-name.manifest.json").read_text())["metadata"]["made"]
    retrieval.saved_index(source, config, str(tmp_path), "s2-name", {"s2": "one"})
    assert json.loads((tmp_path / "s2-name.manifest.json").read_text())["metadata"]["made"] == made
    retrieval.saved_index(source, config, str(tmp_path), "s2-name", {"s2": "two"})
    assert json.loads((tmp_path / "s2-name.manifest.json").read_text())["metadata"]["made"] != made


def test_stages_resume(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(5)

    assert manifests.stage(spark, str(tmp_path), "a", {"k": 1}, make).count() == 5
    assert manifests.stage(spark, str(tmp_path), "a", {"k": 1}, make).count() == 5 and len(made) == 1
    with pytest.raises(contracts.ContractError):
        manifests.stage(spark, str(tmp_path), "a", {"k": 2}, make)
    body = json.loads((tmp_path / "a.manifest.json").read_text())
    body["completion_state"] = "incomplete"
    (tmp_path / "a.manifest.json").write_text(json.dumps(body))
    assert manifests.stage(spark, str(tmp_path), "a", {"k": 1}, make).count() == 5 and len(made) == 2
    assert manifests.recover(str(tmp_path)) == [{"name": "a", "state": "complete"}]
    (tmp_path / "old.json").write_text('{"completion": "complete"}')
    source = tmp_path / "source.tsv"
    source.write_text("entity_id\nS1-1\n")

    def run():
        seen = manifests.table_identity(spark, str(source))
        manifests.stage(spark, str(tmp_path), "up", {}, make, seen)
        manifests.stage(spark, str(tmp_path), "down", {}, make, {}, ("up",))
        return len(made)

    assert run() == 4 and run() == 4
    source.write_text("entity_id\nS1-1\nS1-2\n")
    assert run() == 6 and run() == 6, "a changed input makes its stage and those after it again"
    assert manifests.read_manifest(str(tmp_path / "old.json"))["completion_state"] == "complete"
    assert manifests.features_hash(["a", "b"]) != manifests.legacy_features_hash(["a", "b"])


def test_pattern_slices(spark):
    rows = [("a", 0.9, 1, 0, 0, 0), ("b", 0.9, 1, 0, 0, 1), ("c", 0.9, 1, 0, 1, 1), ("d", 0.3, 1, 0, 0, 1), ("e", 0.9, 0, 1, 1, 0)]
    df = spark.createDataFrame(rows, "source1_entity_id string, name_raw_similarity double, name_tokens_extra_in_b int, postcode_match_house_mismatch int, label int, predicted_match int")
    df = df.withColumns({"decision_route": F.lit("tree_only"), "candidate_source": F.lit("S2"), "country": F.lit("US")})
    got = {(r["pattern"], r["dimension"]): r for r in metrics.pattern_slices(df).collect()}
    row = got[("branch_word_added", "all")]
    assert (row["negative_count"], row["false_accept_count"], row["positive_count"], row["negative_catch_rate"]) == (2, 1, 1, 0.5)
    assert got[("postcode_masks_house", "country")]["negative_catch_rate"] is None and ("legal_form_swapped", "all") not in got


def test_neural_stand_in(spark):
    row = {"name_a": "Acme", "address_a": None, "country_a": "US", "name_b": "Acme", "address_b": "", "country_b": "US"}
    assert neural.serialise(row) == "Acme ||  || US || Acme ||  || US" and neural.segments(row) == ("Acme | | US", "Acme | | US")
    df = spark.createDataFrame([("S1-1", "S2", "S2-1", *row.values()), ("S1-1", "S2", "S2-2", "Acme", "", "US", "Zeta", "", "IN")], PAIR + ", name_a string, address_a string, country_a string, name_b string, address_b string, country_b string")
    got = {r["candidate_entity_id"]: r["neural_probability"] for r in neural.predict_pairs(df).collect()}
    assert got["S2-1"] > 0.5 > got["S2-2"]
    with pytest.raises(KeyError):
        neural.adapter(neural.AdapterConfig(name="none"))
    with pytest.raises(ValueError):
        neural.positive_probability(np.array([[1.0, float("nan")]]))
