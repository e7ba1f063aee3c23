"""The linkage flow from sources to checked lists, stage by stage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.functions.similarity import pair_features
from kinweave.operators import assembly, decode, metrics, models, retrieval, sampling, score_join, splits
from kinweave.operators.contracts import feature_columns, require_none
from kinweave.sources import manifests, tables


@dataclass(frozen=True)
class LinkageConfig:
    folds: int = 3
    seed: int = 42
    top_k_name: int = 50
    top_k_address: int = 50
    model: models.PairModelConfig = models.PairModelConfig()


def candidate_stage(s1: DataFrame, s2: DataFrame, s3: DataFrame, config: LinkageConfig) -> DataFrame:
    return retrieval.generate_candidates(s1, {"S2": s2, "S3": s3}, config.top_k_name, config.top_k_address)


def feature_stage(pairs: DataFrame, s1: DataFrame, s2: DataFrame, s3: DataFrame) -> DataFrame:
    """Pair features and the numeric columns of the candidates."""
    return pair_features(score_join.pair_texts(pairs, s1, score_join.union_sources(s2=s2, s3=s3)))


def run(spark: SparkSession, train: dict[str, str], test: dict[str, str], out: str, config: LinkageConfig = LinkageConfig()) -> dict:
    """Train on one set of files, predict another, write and check both list files.

    ``train`` and ``test`` name the files of s1, s2, s3 (may be absent) and, for
    training, truth. Every stage is a table with a manifest in ``out``; a run
    that was cut off goes on from the last complete one, and stages whose files
    or earlier stages have changed are made again.
    """
    settings = {"folds": config.folds, "seed": config.seed, "k": [config.top_k_name, config.top_k_address], "model": config.model.__dict__}

    own, other = (manifests.table_identity(spark, *filter(None, x.values())) for x in (train, test))

    def stage(name: str, make, inputs: dict, *after: str):
        return manifests.stage(spark, out, name, settings, make, inputs, after)

    s1, s2, s3 = tables.load_sources(spark, train["s1"], train["s2"], train.get("s3"))
    queries, truth = tables.load_truth(spark, train["truth"])
    folds = stage("folds", lambda: splits.create_folds(s1, truth, s2.select("entity_id").union(s3.select("entity_id")), config.folds, config.seed), own)
    require_none(splits.cross_fold_edges(folds, truth), "truth edges across folds")
    pairs = stage("train_candidates", lambda: candidate_stage(s1, s2, s3, config), own)
    features = stage("train_features", lambda: sampling.add_folds(sampling.add_labels(feature_stage(pairs, s1, s2, s3), truth), folds), own, "folds", "train_candidates")
    names = feature_columns(features)
    scores = stage("oof_scores", lambda: models.out_of_fold(features, names, config.model).select("source1_entity_id", "candidate_source", "candidate_entity_id", "label", "score"), own, "train_features")
    threshold, macro = decode.search_threshold(queries, truth, scores)
    final = models.fit_pair_model(sampling.hard_rows(features, config.model.negatives_per_s1), names, config.model)
    t1, t2, t3 = tables.load_sources(spark, test["s1"], test["s2"], test.get("s3"))
    test_pairs = stage("test_candidates", lambda: candidate_stage(t1, t2, t3, config), other)
    predicted = stage("test_scores", lambda: models.predict_pairs(final, feature_stage(test_pairs, t1, t2, t3), names), other | {"threshold": str(threshold)}, "train_features", "test_candidates")
    order = tables.load_query_order(spark, test["s1"])
    chosen = predicted.where(F.col("score") >= threshold)
    lists, candidates = assembly.ordered_lists(order, chosen), assembly.ordered_lists(order, test_pairs)
    require_none(assembly.submission_violations(order, lists, t2, t3), "match lists")
    tables.write_single(lists, f"{out}/matches.tsv", "position", overwrite=True)
    tables.write_single(candidates.withColumnRenamed("matched_entity_ids", "candidate_entity_ids"), f"{out}/candidates.tsv", "position", overwrite=True)
    report = {"threshold": threshold, "oof_macro_f05": macro, "features": names, "features_sha256": manifests.features_hash(names)}
    tables.write_json(report, f"{out}/report.json")
    return report


def evaluate(queries: DataFrame, truth: DataFrame, candidates: DataFrame, predicted: DataFrame) -> dict:
    """The measures of a run as one dictionary; unknown ones are None."""
    own = metrics.macro(metrics.score_entities(queries, truth, predicted)).first().asDict()
    return own | metrics.edge_metrics(truth, predicted).first().asDict() | metrics.miss_report(queries, truth, candidates).first().asDict()


def sweep(pool: DataFrame, queries: DataFrame, truth: DataFrame, n_s2: int, n_s3: int, ks: tuple[int, ...] = (20, 40, 80), budgets: tuple[int, ...] = (20, 40, 80)) -> DataFrame:
    """Candidate counts and recall for smaller k and for total budgets, from one pool of the largest k."""
    out = None
    cuts = [("k", k, retrieval.slice_k(pool, k)) for k in ks] + [("budget", b, retrieval.prune(pool, b)) for b in budgets]
    for kind, value, part in cuts:
        row = metrics.candidate_diagnostics(queries, part, n_s2, n_s3).crossJoin(metrics.recall(truth, part).select("total", "retrieved", "recall"))
        row = row.withColumns({"cut": F.lit(kind), "value": F.lit(value)})
        out = row if out is None else out.unionByName(row)
    return out
