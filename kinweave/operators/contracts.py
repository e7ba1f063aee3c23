"""Contracts of tables: each check gives the rows that break it, or raises."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from kinweave.functions.ids import PAIR_KEY, candidate_source

FOLD_COLUMNS = ("fold", "source1_fold", "candidate_fold")
FORBIDDEN = {"label", "positive_injected_for_training", "is_injected_positive", "member_partition", *FOLD_COLUMNS}
FORBIDDEN_PREFIX = re.compile("^(truth|gold|target|ground_truth)_")
ROUTES = ("neural_fusion", "tree_only", "discard")
PAIR_TEXT = [*PAIR_KEY, "source1_fold", "candidate_fold", "name_a", "address_a", "country_a", "name_b", "address_b", "country_b"]


class ContractError(ValueError):
    """A table breaks its contract."""


def require_columns(df: DataFrame, columns: list[str]) -> None:
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ContractError(f"columns are missing: {lost}")


def violations(df: DataFrame, rules: dict[str, Column], key: list[str]) -> DataFrame:
    """``key, rule`` of every row that breaks a rule; a null condition breaks it."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return df.select(*key, F.explode(broken).alias("rule"))


def repeated(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.lit("repeated key").alias("rule"))


def require_none(found: DataFrame, what: str) -> None:
    rows = found.take(5)
    if rows:
        raise ContractError(f"{what}: {[r.asDict() for r in rows]}")


def require_all(found: dict[str, DataFrame]) -> None:
    """As :func:`require_none` for several checks in one job."""
    every = None
    for what, df in found.items():
        part = df.select(F.lit(what).alias("what"), F.to_json(F.struct(*df.columns)).alias("row")).limit(5)
        every = part if every is None else every.union(part)
    rows = every.collect() if every is not None else []
    if rows:
        raise ContractError("; ".join(f"{r['what']}: {r['row']}" for r in rows[:5]))


def _filled(name: str) -> Column:
    return F.col(name).isNotNull() & (F.trim(F.col(name)) != "")


def _probability(name: str) -> Column:
    x = F.col(name).cast("double")
    return x.isNotNull() & ~F.isnan(x) & x.between(0.0, 1.0)


def key_violations(df: DataFrame, any_id: bool = False) -> DataFrame:
    """Empty ends, sources other than S2 and S3, prefixes that contradict the source, repeated keys."""
    require_columns(df, PAIR_KEY)
    rules = {"empty S1 id": _filled("source1_entity_id"), "empty candidate id": _filled("candidate_entity_id"), "unknown source": F.col("candidate_source").isin("S2", "S3")}
    if not any_id:
        rules["prefix against source"] = candidate_source(F.col("candidate_entity_id")) == F.col("candidate_source")
    return violations(df, rules, PAIR_KEY).unionByName(repeated(df, PAIR_KEY))


def candidate_violations(df: DataFrame) -> DataFrame:
    found = key_violations(df)
    if "retrieval_score" in df.columns:
        score = F.col("retrieval_score").cast("double")
        found = found.unionByName(violations(df, {"score isn't finite": score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))}, PAIR_KEY))
    return found


def pair_text_violations(df: DataFrame, extra: bool = True) -> DataFrame:
    require_columns(df, PAIR_TEXT)
    if not extra and set(df.columns) - {*PAIR_TEXT, "label"}:
        raise ContractError(f"unknown columns: {sorted(set(df.columns) - {*PAIR_TEXT, 'label'})}")
    rules = {f"null {c}": F.col(c).isNotNull() for c in PAIR_TEXT[5:]}
    if "label" in df.columns:
        rules["label isn't 0 or 1"] = F.col("label").isin(0, 1)
    return key_violations(df).unionByName(violations(df, rules, PAIR_KEY))


def score_violations(df: DataFrame, column: str, keys: DataFrame | None = None) -> DataFrame:
    """Scores outside [0, 1] and, with ``keys``, keys that are missing or too many."""
    require_columns(df, [*PAIR_KEY, column])
    found = key_violations(df).unionByName(violations(df, {f"{column} isn't a probability": _probability(column)}, PAIR_KEY))
    return found.unionByName(coverage(df, keys)) if keys is not None else found


def coverage(df: DataFrame, wanted: DataFrame, key: list[str] = PAIR_KEY) -> DataFrame:
    """Keys that only one of two tables has."""
    extra = df.select(*key).join(wanted.select(*key), key, "left_anti").withColumn("rule", F.lit("unknown key"))
    lost = wanted.select(*key).join(df.select(*key), key, "left_anti").withColumn("rule", F.lit("missing key"))
    return extra.unionByName(lost)


def joined_violations(df: DataFrame, calibrated: bool = False) -> DataFrame:
    """Rules of routed scores: a fused pair was requested and has a score, others weren't requested."""
    require_columns(df, [*PAIR_KEY, "tree_score", "neural_requested", "has_neural_score", "decision_route"])
    fused = F.col("decision_route") == "neural_fusion"
    rules = {
        "tree_score isn't a probability": _probability("tree_score"),
        "unknown route": F.col("decision_route").isin(*ROUTES),
        "flag isn't 0 or 1": F.col("neural_requested").isin(0, 1) & F.col("has_neural_score").isin(0, 1),
        "fused without request or score": ~fused | ((F.col("neural_requested") == 1) & (F.col("has_neural_score") == 1)),
        "requested but not fused": fused | (F.col("neural_requested") == 0),
    }
    if "neural_probability" in df.columns:
        rules["neural_probability isn't a probability"] = F.col("neural_probability").isNull() | _probability("neural_probability")
    if calibrated:
        rules["active pair without probability"] = (F.col("decision_route") == "discard") | _probability("match_probability")
    return key_violations(df).unionByName(violations(df, rules, PAIR_KEY))


def source_violations(df: DataFrame) -> DataFrame:
    """Empty or repeated ids of a source table."""
    require_columns(df, ["entity_id"])
    return violations(df, {"empty id": _filled("entity_id")}, ["entity_id"]).unionByName(repeated(df, ["entity_id"]))


def candidate_id_violations(pairs: DataFrame, s1: DataFrame, s2: DataFrame, s3: DataFrame) -> DataFrame:
    """Unknown S1s, candidates that are S1s or unknown, ids of both sources without a source."""
    ids = {"S1": s1, "S2": s2, "S3": s3}
    marks = None
    for label, df in ids.items():
        part = df.select("entity_id", F.lit(label).alias("of"))
        marks = part if marks is None else marks.unionByName(part)
    homes = marks.groupBy("entity_id").agg(F.collect_set("of").alias("homes"))
    a = homes.select(F.col("entity_id").alias("source1_entity_id"), F.col("homes").alias("_a"))
    b = homes.select(F.col("entity_id").alias("candidate_entity_id"), F.col("homes").alias("_b"))
    rows = pairs.join(a, "source1_entity_id", "left").join(b, "candidate_entity_id", "left")
    none = F.array().cast("array<string>")
    own, home = F.coalesce("_a", none), F.coalesce("_b", none)
    stated = F.col("candidate_source") if "candidate_source" in pairs.columns else F.lit(None).cast("string")
    rules = {
        "unknown S1": F.array_contains(own, "S1"),
        "candidate is an S1": ~F.array_contains(home, "S1"),
        "unknown candidate": F.arrays_overlap(home, F.array(F.lit("S2"), F.lit("S3"))),
        "source isn't clear": stated.isNotNull() | ~(F.array_contains(home, "S2") & F.array_contains(home, "S3")),
        "not in the stated source": stated.isNull() | F.array_contains(home, stated),
    }
    return violations(rows, rules, ["source1_entity_id", "candidate_entity_id"])


def check_features(names: list[str]) -> None:
    """No label, fold, injected or truth-derived column may be a feature."""
    bad = [n for n in names if n in FORBIDDEN or FORBIDDEN_PREFIX.match(n)]
    if bad:
        raise ContractError(f"not allowed as features: {bad}")


# The prefixes of feature columns.
FEATURE_PREFIXES = (
    "name_", "address_", "retrieval_", "retrieved_by_", "frequent_key_",
    "candidate_count", "near_tie_", "best_", "second_", "is_strongest_",
    "strongest_", "competing_", "house_", "unit_", "legal_form_", "jaro_",
    "jaccard_", "length_", "exact_", "postcode_", "rare_token_", "address_a_missing", "address_b_missing", "address_carries_despite_name_conflict",
    "strong_name_", "weak_name_", "is_top_competing_",
)


def feature_columns(df: DataFrame, prefixes: tuple[str, ...] = FEATURE_PREFIXES) -> list[str]:
    """Numeric columns with an allowed prefix that aren't forbidden, in table order."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [n for n, t in df.dtypes if n.startswith(prefixes) and (t in numeric or t == "boolean" or t.startswith("decimal")) and n not in FORBIDDEN and n not in PAIR_TEXT and not FORBIDDEN_PREFIX.match(n)]


def differing(a: DataFrame, b: DataFrame, column: str = "tree_score", tolerance: float = 1e-12) -> DataFrame:
    """Pairs whose score or route isn't the same in two tables; both must have the same keys."""
    rows = a.select(*PAIR_KEY, F.col(column).alias("_a"), F.col("decision_route").alias("_ra")).join(b.select(*PAIR_KEY, F.col(column).alias("_b"), F.col("decision_route").alias("_rb")), PAIR_KEY)
    rules = {f"{column} differs": F.abs(F.col("_a") - F.col("_b")) <= tolerance, "route differs": F.col("_ra") == F.col("_rb")}
    return coverage(a, b).unionByName(violations(rows, rules, PAIR_KEY))
