"""Final tables: checked coverage, one line for each query in the order given."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinweave.functions.ids import PAIR_KEY, id_list
from kinweave.operators.contracts import candidate_id_violations, require_none
from kinweave.operators.decode import as_lists


def ordered_lists(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """``source1_entity_id, matched_entity_ids`` in query order; ``queries`` has ``position, source1_entity_id``."""
    return as_lists(queries, edges).join(queries.select("source1_entity_id", "position"), "source1_entity_id").select("position", "source1_entity_id", "matched_entity_ids")


def check_assembly(decisions: DataFrame, selected: DataFrame, s1: DataFrame, s2: DataFrame, s3: DataFrame) -> None:
    """Chosen pairs are active decisions, ids are known, and a record has one owner."""
    require_none(candidate_id_violations(decisions, s1, s2, s3), "decisions")
    require_none(decisions.groupBy(*PAIR_KEY).count().where("count > 1"), "repeated decisions")
    active = decisions.where("decision_route <> 'discard'")
    require_none(selected.select(*PAIR_KEY).join(active.select(*PAIR_KEY), PAIR_KEY, "left_anti"), "chosen pairs that aren't active decisions")
    require_none(selected.groupBy("candidate_source", "candidate_entity_id").agg(F.count_distinct("source1_entity_id").alias("owners")).where("owners > 1"), "records with several owners")


def assemble(decisions: DataFrame, selected: DataFrame, queries: DataFrame, s2: DataFrame, s3: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate lists and match lists of every query, in order."""
    s1 = queries.select(F.col("source1_entity_id").alias("entity_id"))
    check_assembly(decisions, selected, s1, s2, s3)
    active = decisions.where("decision_route <> 'discard'")
    candidates = ordered_lists(queries, active).withColumnRenamed("matched_entity_ids", "candidate_entity_ids")
    return candidates, ordered_lists(queries, selected)


def submission_violations(queries: DataFrame, lists: DataFrame, s2: DataFrame, s3: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """Missing, repeated or unknown S1s, unknown or repeated candidates of a list table."""
    wanted, got = queries.select("source1_entity_id"), lists.select("source1_entity_id")
    known = s2.select("entity_id").union(s3.select("entity_id"))
    ids = lists.select("source1_entity_id", F.explode(F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")).alias("entity_id"))
    return (
        wanted.join(got, "source1_entity_id", "left_anti").withColumn("rule", F.lit("missing S1"))
        .union(got.join(wanted, "source1_entity_id", "left_anti").withColumn("rule", F.lit("unknown S1")))
        .union(got.groupBy("source1_entity_id").count().where("count > 1").select("source1_entity_id", F.lit("repeated S1")))
        .union(ids.join(known, "entity_id", "left_anti").select("source1_entity_id", F.lit("unknown candidate")))
        .union(ids.groupBy("source1_entity_id", "entity_id").count().where("count > 1").select("source1_entity_id", F.lit("repeated candidate")))
    )


def matches_outside_candidates(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches of list tables that their candidate lists don't hold."""
    c = candidates.select("source1_entity_id", F.explode(id_list(F.col("candidate_entity_ids"))).alias("candidate_entity_id"))
    m = matches.select("source1_entity_id", F.explode(id_list(F.col("matched_entity_ids"))).alias("candidate_entity_id"))
    return m.join(c, ["source1_entity_id", "candidate_entity_id"], "left_anti")
