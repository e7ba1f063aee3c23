"""Training and evaluation pairs with texts, written once for pair models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from kinweave.operators import sampling, score_join, splits
from kinweave.operators.contracts import pair_text_violations, require_none
from kinweave.sources import manifests, tables
from kinweave.sources.scratch import scratch_table


@dataclass(frozen=True)
class PairDataConfig:
    """How many queries of each kind, from which folds, and how many negatives."""

    train_queries: int = 50_000
    held_out_queries: int = 5_000
    threshold_queries: int = 2_500
    train_folds: tuple[int, ...] = (1, 2)
    held_out_fold: int = 0
    hard_negatives: int = 8
    other_negatives: int = 2
    seed: int = 42
    target_rows: int = 75_000


def choose_queries(s1: DataFrame, truth: DataFrame, folds: DataFrame, config: PairDataConfig = PairDataConfig()) -> DataFrame:
    """``source1_entity_id, subset``: training queries, and held-out ones cut into threshold and final.

    Whole components stay together; the held-out ones are ordered by a hash of
    their component, so the cut depends on nothing else.
    """
    train = splits.select_queries(s1, truth, folds, list(config.train_folds), config.train_queries, config.seed)
    held = splits.select_queries(s1, truth, folds, [config.held_out_fold], config.held_out_queries, config.seed)
    ids = held.select(F.col("source1_entity_id").alias("entity_id"), "country")
    share = config.threshold_queries / max(1, config.held_out_queries)
    components = splits.entity_components(ids, truth.join(held, "source1_entity_id", "left_semi"))
    cut = F.pmod(F.xxhash64("component", F.lit(config.seed)), F.lit(10_000)) < int(share * 10_000)
    marked = ids.join(components, "entity_id").select(F.col("entity_id").alias("source1_entity_id"), F.when(cut, "threshold").otherwise("final").alias("subset"))
    return scratch_table(train.select("source1_entity_id", F.lit("train").alias("subset")).union(marked), "subsets")


def training_rows(candidates: DataFrame, queries: DataFrame, truth: DataFrame, folds: DataFrame, s1: DataFrame, records: DataFrame, config: PairDataConfig = PairDataConfig()) -> DataFrame:
    """Labelled pair texts of the training queries; no held-out entity serves as a negative."""
    held = folds.where(F.col("fold") == config.held_out_fold).select("entity_id")
    own = queries.where("subset = 'train'").select("source1_entity_id")
    pairs = sampling.training_pairs(candidates, own, truth, config.hard_negatives, config.other_negatives, config.seed, held)
    return sampling.add_folds(score_join.pair_texts(scratch_table(pairs, "pairs"), s1, records), folds)


def prepare(candidates: DataFrame, queries: DataFrame, truth: DataFrame, folds: DataFrame, s1: DataFrame, records: DataFrame, out: str, config: PairDataConfig = PairDataConfig()) -> dict[str, int]:
    """Write the pair texts of each subset in parts that split no query; rows by subset."""
    sizes = {}
    for subset in ("train", "threshold", "final"):
        if subset == "train":
            rows = training_rows(candidates, queries, truth, folds, s1, records, config)
        else:
            own = candidates.join(queries.where(F.col("subset") == subset).select("source1_entity_id"), "source1_entity_id", "left_semi")
            texts = score_join.pair_texts(own, s1, records)
            texts = sampling.add_labels(texts, truth) if subset == "threshold" else texts.withColumn("label", F.lit(0))
            rows = sampling.add_folds(texts, folds, check=subset == "threshold")
            rows = rows if subset == "threshold" else rows.drop("label")
        path = f"{out}/{subset}"
        tables.write_grouped(rows, path, ["source1_entity_id"], config.target_rows)
        written = rows.sparkSession.read.parquet(path)
        require_none(pair_text_violations(written), subset)
        sizes[subset] = written.count()
        manifests.Manifest(subset, config=config.__dict__ | {"train_folds": list(config.train_folds)}, rows=sizes[subset], completion_state="complete").write(f"{out}/{subset}.manifest.json")
    return sizes
