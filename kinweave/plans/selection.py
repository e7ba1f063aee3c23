"""Fusion, calibration and decoder choice on their own partitions, and the fallback without a neural model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from kinweave.operators import assembly, decode, metrics, models
from kinweave.operators.contracts import ContractError, joined_violations, require_none
from kinweave.sources.scratch import scratch_table


@dataclass(frozen=True)
class Selection:
    """Fitted models and the decoders tried, the best first."""

    fusion: dict[str, models.Linear]
    calibration: dict[str, models.Linear | models.Isotonic]
    decoders: list[dict]

    @property
    def best(self) -> dict:
        return self.decoders[0]


def _part(df: DataFrame, partitions: DataFrame, name: str) -> DataFrame:
    own = partitions.where(partitions.member_partition == name).select("source1_entity_id")
    return df.join(own, "source1_entity_id", "left_semi")


def select_threshold(scores: DataFrame, labels: DataFrame, partitions: DataFrame, truth: DataFrame, features: dict[str, list[str]] | None = None, method: str = "platt", full_truth: DataFrame | None = None, expected: bool = False) -> Selection:
    """Fusion fitted on fusion_fit, calibration on calibration, the decoder chosen on selection.

    ``scores`` are joined scores of all partitions, ``truth`` their edges.
    Single ownership is tried only if no record has two owners in ``full_truth``
    (by default ``truth``) and every source group is complete.
    """
    require_none(joined_violations(scores), "joined scores")
    fusion = models.fit_fusion(scores, labels, partitions, features)
    fused = scratch_table(models.apply_fusion(scores, fusion), "fused")
    calibration = models.fit_calibration(fused, labels, partitions, method)
    calibrated = scratch_table(models.apply_calibration(fused, calibration), "calibrated")
    active = _part(calibrated, partitions, "selection").where("decision_route <> 'discard'")
    queries = partitions.where("member_partition = 'selection'").select("source1_entity_id")
    if queries.isEmpty():
        raise ContractError("no query to select on")
    own = truth.join(queries, "source1_entity_id", "left_semi")
    complete = "source_group_complete" in scores.columns and scores.where("NOT source_group_complete").isEmpty()
    audit = metrics.ownership_audit(full_truth if full_truth is not None else truth) if complete else None
    return Selection(fusion, calibration, decode.select_decoder(queries, own, active, audit=audit, expected=expected))


def apply_selection(scores: DataFrame, chosen: Selection) -> DataFrame:
    """The selected edges of new scores by the chosen models and decoder."""
    calibrated = models.apply_calibration(models.apply_fusion(scores, chosen.fusion), chosen.calibration).where("decision_route <> 'discard'")
    best = chosen.best
    if best["decoder"] == "threshold_best_owner":
        return decode.selected_edges(decode.best_owner(calibrated, best["threshold"]))
    if best["decoder"] == "expected_f05":
        return calibrated.join(decode.by_expected_f05(calibrated), ["source1_entity_id", "candidate_entity_id"], "left_semi")
    return decode.by_threshold(calibrated, best["threshold"])


def tree_only_fallback(scores: DataFrame, labels: DataFrame, partitions: DataFrame, queries: DataFrame, truth: DataFrame, s2: DataFrame, s3: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Checked lists from the tree score alone: calibrated, thresholded, assembled.

    ``queries`` has ``position, source1_entity_id``.
    """
    rows = models.tree_only(scores)
    calibration = models.fit_calibration(rows, labels, partitions)
    calibrated = scratch_table(models.apply_calibration(rows, calibration), "fallback")
    held = partitions.where("member_partition = 'selection'").select("source1_entity_id")
    threshold, _ = decode.tune_threshold(held, truth.join(held, "source1_entity_id", "left_semi"), _part(calibrated, partitions, "selection").where("decision_route <> 'discard'"), "match_probability")
    owned = decode.best_owner(calibrated.where("decision_route <> 'discard'"), threshold)
    return assembly.assemble(calibrated, decode.selected_edges(owned), queries, s2, s3)
