"""Quality measures of predictions, candidates, gates and slices.

Truth and predictions are edge tables (``source1_entity_id,
candidate_entity_id``); a list of queries keeps those without any edge. Shares
without a denominator are null, never 0, except where a definition gives 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinweave.functions.ids import PAIR_KEY, candidate_source, match_bin

PAIR = ["source1_entity_id", "candidate_entity_id"]


def share(top: Column, bottom: Column, empty: float | None = None) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(empty).cast("double"))


def tally(condition: Column, weighted: bool) -> Column:
    """How many rows meet a condition; if weighted, the sum of their ``copies``."""
    return F.coalesce(F.sum(F.when(condition, F.col("copies"))), F.lit(0)) if weighted else F.count_if(condition)


def with_copies(rows: DataFrame, copies: DataFrame | None) -> DataFrame:
    return rows if copies is None else rows.join(copies.select("source1_entity_id", "copies"), "source1_entity_id")


def f05(tp: Column, fp: Column, fn: Column) -> Column:
    """F0.5 of a set: 1 if nothing is true and nothing predicted, 0 if only one side has edges."""
    return F.when(tp + fn == 0, (fp == 0).cast("double")).when(tp + fp == 0, 0.0).otherwise(5 * tp / (5 * tp + 4 * fp + fn))


def confusion(queries: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """``source1_entity_id, tp, fp, fn`` of every query; sets, so repeated edges count once."""
    t = truth.select(*PAIR).distinct().withColumn("_t", F.lit(1))
    p = predicted.select(*PAIR).distinct().withColumn("_p", F.lit(1))
    both = t.join(p, PAIR, "full_outer")
    counts = both.groupBy("source1_entity_id").agg(F.count_if(F.col("_t").isNotNull() & F.col("_p").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
    return queries.select("source1_entity_id").distinct().join(counts, "source1_entity_id", "left").na.fill(0, ["tp", "fp", "fn"])


def score_entities(queries: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    return confusion(queries, truth, predicted).withColumn("f05", f05(F.col("tp"), F.col("fp"), F.col("fn")))


def macro(scored: DataFrame, *by: str) -> DataFrame:
    """Macro F0.5, accuracy on S1s without truth, macro F0.5 of the others; 1 for an empty stratum."""
    single = F.col("tp") + F.col("fn") == 0
    return scored.groupBy(*by).agg(
        F.avg("f05").alias("macro_f05"),
        F.coalesce(F.avg(F.when(single, F.col("f05"))), F.lit(1.0)).alias("singleton_accuracy"),
        F.coalesce(F.avg(F.when(~single, F.col("f05"))), F.lit(1.0)).alias("non_singleton_macro_f05"),
        F.count("*").alias("entities"), F.count_if(single).alias("singletons"),
    )


def recall(truth: DataFrame, candidates: DataFrame, by: dict[str, Column] | None = None) -> DataFrame:
    """Truth pairs, those among the candidates, and their share (1 if there are none), for each group."""
    got = candidates.select(*PAIR).distinct().withColumn("_got", F.lit(1))
    joined = truth.join(got, PAIR, "left")
    keys = [c.alias(n) for n, c in (by or {}).items()]
    out = joined.groupBy(*keys).agg(F.count("*").alias("total"), F.count("_got").alias("retrieved"))
    return out.withColumn("recall", share(F.col("retrieved"), F.col("total"), 1.0))


def match_counts(queries: DataFrame, truth: DataFrame) -> DataFrame:
    """``source1_entity_id, matches, bin`` of every query."""
    n = truth.select(*PAIR).distinct().groupBy("source1_entity_id").agg(F.count("*").alias("matches"))
    out = queries.select("source1_entity_id").distinct().join(n, "source1_entity_id", "left").na.fill(0, ["matches"])
    return out.withColumn("bin", match_bin(F.col("matches")))


def candidate_counts(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    n = candidates.groupBy("source1_entity_id").agg(F.count("*").alias("candidates"))
    return queries.select("source1_entity_id").distinct().join(n, "source1_entity_id", "left").na.fill(0, ["candidates"])


def candidate_diagnostics(queries: DataFrame, candidates: DataFrame, n_s2: int, n_s3: int) -> DataFrame:
    """Counts of candidates over all queries, those without any included."""
    out = candidate_counts(queries, candidates).agg(
        F.count("*").alias("num_s1"), F.sum("candidates").alias("total_candidate_pairs"), F.avg("candidates").alias("average_candidates_per_s1"),
        F.percentile("candidates", 0.5).alias("median_candidates_per_s1"), F.percentile("candidates", 0.95).alias("p95_candidates_per_s1"),
        F.max("candidates").alias("max_candidates_per_s1"), F.count_if(F.col("candidates") == 0).alias("zero_candidate_queries"),
    )
    return out.withColumn("reduction_ratio", 1 - F.col("total_candidate_pairs") / F.greatest(F.lit(1), F.col("num_s1") * (n_s2 + n_s3)))


def recall_by_match_bin(queries: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """Queries, recall and the macro F0.5 of a perfect chooser, by number of matches."""
    reached = truth.join(candidates.select(*PAIR).distinct(), PAIR, "left_semi")
    scored = score_entities(queries, truth, reached).join(match_counts(queries, truth), "source1_entity_id")
    out = scored.groupBy("bin").agg(F.count("*").alias("queries"), F.sum("tp").alias("retrieved"), F.sum("matches").alias("total"), F.avg("f05").alias("oracle_macro_f05"))
    return out.withColumn("recall", share(F.col("retrieved"), F.col("total"), 1.0))


def retrieval_report(queries: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """Channel overlap and the macro F0.5 of predicting every candidate."""
    exact = (F.col("retrieved_by_exact") == 1) | (F.col("retrieval_provenance") == "exact")
    tfidf = (F.col("name_tfidf_score") > 0) | (F.col("address_tfidf_score") > 0) | F.col("retrieval_provenance").contains("tfidf")
    kinds = candidates.agg(F.count_if(exact & tfidf).alias("overlap"), F.count_if(exact & ~tfidf).alias("exact_only"), F.count_if(tfidf & ~exact).alias("tfidf_only"), F.count_if(F.col("frequent_key_expansion") > 0).alias("frequent_key_expansions"))
    return kinds.crossJoin(macro(score_entities(queries, truth, candidates)).select(F.col("macro_f05").alias("all_candidates_f05")))


def miss_report(queries: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """Partial and complete misses, and the nearest-rank 95th percentile of candidates."""
    n = candidates.select(*PAIR).distinct().groupBy("source1_entity_id").agg(F.count("*").alias("candidates"))
    reached = truth.select(*PAIR).distinct().join(candidates.select(*PAIR).distinct(), PAIR, "left_semi")
    rows = confusion(queries, truth, reached).join(n, "source1_entity_id", "left").na.fill(0, ["candidates"])
    gold = F.col("tp") + F.col("fn")
    out = rows.agg(
        F.count("*").alias("query_count"), F.count_if(F.col("candidates") == 0).alias("zero_candidate_query_count"), F.sum(gold).alias("gold_edge_count"),
        F.sum("tp").alias("retrieved_gold_edge_count"), F.sum("fn").alias("missed_gold_edge_count"), F.count_if((F.col("tp") > 0) & (F.col("fn") > 0)).alias("partial_miss_query_count"),
        F.count_if((F.col("tp") == 0) & (F.col("fn") > 0)).alias("complete_miss_non_singleton_count"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY candidates)").cast("long").alias("p95_candidates_per_s1"),
        F.avg(f05(F.col("tp"), F.lit(0), F.col("fn"))).alias("oracle_macro_f05"),
    )
    return out.withColumn("candidate_pair_recall", share(F.col("retrieved_gold_edge_count"), F.col("gold_edge_count")))


def edge_metrics(truth: DataFrame, predicted: DataFrame, by_source: bool = False, copies: DataFrame | None = None) -> DataFrame:
    """Micro counts, precision and recall, over all edges or by source of the record.

    ``copies`` (``source1_entity_id, copies``) says for how many S1s of equal
    edges each S1 stands; the same holds below.
    """
    weighted = copies is not None
    t = truth.select(*PAIR).distinct().withColumn("_t", F.lit(1))
    p = predicted.select(*PAIR).distinct().withColumn("_p", F.lit(1))
    both = t.join(p, PAIR, "full_outer").withColumn("candidate_source", candidate_source(F.col("candidate_entity_id")))
    both = with_copies(both, copies)
    out = both.groupBy(*(["candidate_source"] if by_source else [])).agg(tally(F.col("_t").isNotNull() & F.col("_p").isNotNull(), weighted).alias("tp"), tally(F.col("_t").isNull(), weighted).alias("fp"), tally(F.col("_p").isNull(), weighted).alias("fn"))
    return out.withColumns({"pair_precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "pair_recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})


def route_metrics(scored: DataFrame, truth: DataFrame, predicted: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """Pairs, chosen edges, precision and recall against all truth, by route."""
    weighted = copies is not None
    t = truth.select(*PAIR).distinct().withColumn("_t", F.lit(1))
    p = predicted.select(*PAIR).distinct().withColumn("_p", F.lit(1))
    gold = with_copies(t, copies).agg(tally(F.lit(True), weighted).alias("_gold"))
    rows = with_copies(scored.join(t, PAIR, "left").join(p, PAIR, "left"), copies)
    out = rows.groupBy("decision_route").agg(tally(F.lit(True), weighted).alias("pair_count"), tally(F.col("_p").isNotNull(), weighted).alias("selected_edge_count"), tally(F.col("_t").isNotNull() & F.col("_p").isNotNull(), weighted).alias("tp"))
    out = out.crossJoin(F.broadcast(gold)).withColumn("fp", F.col("selected_edge_count") - F.col("tp"))
    return out.withColumns({"pair_precision": share(F.col("tp"), F.col("selected_edge_count")), "pair_recall_against_all_gold": share(F.col("tp"), F.col("_gold"))}).drop("_gold")


def gate_audit(gate: DataFrame, truth: DataFrame, cutoffs: tuple[float, ...] = (0.0001, 0.001, 0.01, 0.05), copies: DataFrame | None = None, candidate_copies: DataFrame | None = None) -> DataFrame:
    """What each reject cutoff on neural pairs loses: a row for each, in one pass over the gate.

    ``gate`` has the pair key, ``tree_score`` and ``decision_route``. Cutoff null
    is the gate as it is. Macro recall is the mean over S1s with truth.
    ``candidate_copies`` (``candidate_entity_id, copies``) says for how many
    candidates of equal pairs and truth each one stands.
    """
    spark = gate.sparkSession

    def counted(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_n", F.lit(1)) if candidate_copies is None else rows.join(candidate_copies.select("candidate_entity_id", F.col("copies").alias("_n")), "candidate_entity_id")

    grid = spark.createDataFrame([(None,), *((float(c),) for c in cutoffs)], "cutoff double")
    edges = truth.select(*PAIR).distinct().withColumn("candidate_source", candidate_source(F.col("candidate_entity_id")))
    neural = F.col("decision_route") == "neural_fusion"
    marked = counted(edges).join(gate.select(*PAIR_KEY, "tree_score", "decision_route"), PAIR_KEY, "left")
    keep = F.col("decision_route").isNotNull() & (F.col("decision_route") != "discard") & (F.col("cutoff").isNull() | ~neural | (F.col("tree_score") >= F.col("cutoff")))
    lost = marked.crossJoin(F.broadcast(grid)).withColumn("_keep", keep)
    by_s1 = lost.groupBy("cutoff", "source1_entity_id").agg(F.sum("_n").alias("gold"), F.sum(F.when(F.col("_keep"), F.col("_n")).otherwise(0)).alias("kept"))
    weighted = copies is not None
    each = F.col("copies") if weighted else F.lit(1)
    gold = with_copies(by_s1, copies).groupBy("cutoff").agg(
        F.sum(F.col("gold") * each).alias("gold_edge_count"), F.sum(F.col("kept") * each).alias("survived_gold_edge_count"), (F.sum(F.col("kept") / F.col("gold") * each) / F.sum(each)).alias("macro_oracle_recall"),
        tally(F.col("kept") == F.col("gold"), weighted).alias("full_recall_s1"), tally((F.col("kept") > 0) & (F.col("kept") < F.col("gold")), weighted).alias("partial_miss_s1"), tally(F.col("kept") == 0, weighted).alias("zero_recall_s1"),
    )
    # summed by score first: few rows are met with the cutoffs
    scores = with_copies(counted(gate.where(neural)), copies).groupBy("tree_score").agg(F.sum(F.col("_n") * each).alias("copies")).crossJoin(F.broadcast(grid))
    rows = scores.groupBy("cutoff").agg(tally(F.lit(True), True).alias("neural_rows_total"), tally(F.col("cutoff").isNull() | (F.col("tree_score") >= F.col("cutoff")), True).alias("neural_rows_kept"))
    gold, rows = gold.withColumnRenamed("cutoff", "_cg"), rows.withColumnRenamed("cutoff", "_cr")
    out = grid.join(gold, F.col("cutoff").eqNullSafe(F.col("_cg")), "left").join(rows, F.col("cutoff").eqNullSafe(F.col("_cr")), "left").drop("_cg", "_cr")
    out = out.na.fill(0, ["gold_edge_count", "survived_gold_edge_count", "full_recall_s1", "partial_miss_s1", "zero_recall_s1", "neural_rows_total", "neural_rows_kept"])
    return out.withColumns({"micro_oracle_recall": share(F.col("survived_gold_edge_count"), F.col("gold_edge_count")), "neural_retained_fraction": share(F.col("neural_rows_kept"), F.col("neural_rows_total"), 0.0)})


def project_cost(audit: DataFrame, pairs_per_second: float, production_pairs: int) -> DataFrame:
    """Pairs and hours of a full run at the audited shares."""
    pairs = F.round(F.col("neural_retained_fraction") * production_pairs).cast("long")
    return audit.withColumns({"projected_pairs": pairs, "projected_hours": pairs / pairs_per_second / 3600})


def ownership_audit(truth: DataFrame) -> DataFrame:
    """Source records by number of S1 owners, and whether single ownership holds."""
    owners = truth.select(*PAIR).distinct().groupBy("candidate_entity_id").agg(F.count("*").alias("owners"))
    out = owners.agg(F.count("*").alias("source_record_count"), F.count_if(F.col("owners") == 1).alias("records_with_one_owner"), F.count_if(F.col("owners") > 1).alias("records_with_multiple_owners"))
    return out.withColumn("ownership_enabled", F.col("records_with_multiple_owners") == 0)


def pattern_masks(pairs: DataFrame) -> DataFrame:
    """Look-alike patterns of pairs whose names agree to 0.6 at least; null counts as the neutral value."""

    def value(name: str, neutral: float) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(neutral)) if name in pairs.columns else F.lit(neutral)

    near = value("name_raw_similarity", 0.0) >= 0.6
    house = (value("house_number_match", -1.0) == 0) & (value("house_number_a_present", 0.0) == 1) & (value("house_number_b_present", 0.0) == 1)
    out = pairs.withColumns({
        "branch_word_added": near & ((value("name_tokens_extra_in_b", 0.0) > 0) | (value("name_tokens_missing_from_b", 0.0) > 0)),
        "legal_form_swapped": near & (value("legal_form_agreement", -1.0) == 0),
        "house_number_shifted": near & house,
        "postcode_masks_house": near & (value("postcode_match_house_mismatch", 0.0) == 1),
    })
    union = F.col("branch_word_added") | F.col("legal_form_swapped") | F.col("house_number_shifted") | F.col("postcode_masks_house")
    return out.withColumns({"fake_pattern_union": union, "legit_variation_guardrail": union})


PATTERNS = ("branch_word_added", "legal_form_swapped", "house_number_shifted", "postcode_masks_house", "fake_pattern_union", "legit_variation_guardrail")


def pattern_slices(pairs: DataFrame, dimensions: tuple[str, ...] = ("decision_route", "candidate_source", "country"), score: str | None = None) -> DataFrame:
    """Catch and keep rates of each pattern, over all pairs and by each dimension.

    ``pairs`` has ``label``, ``predicted_match``, the features of the patterns
    and the dimensions. Rates without a denominator are null. A column
    ``copies`` says for how many equal pairs each stands.
    """
    weighted = "copies" in pairs.columns
    masked = pattern_masks(pairs)
    listed = masked.withColumn("pattern", F.explode(F.array_compact(F.array(*(F.when(F.col(p), F.lit(p)) for p in PATTERNS)))))
    view = listed.select("pattern", *dimensions, "label", "predicted_match", (F.col(score) if score else F.lit(None).cast("double")).alias("_score"), *(["copies"] if weighted else []))
    mean = F.sum(F.col("_score") * F.col("copies")) / F.sum(F.when(F.col("_score").isNotNull(), F.col("copies"))) if weighted else F.avg("_score")
    sets = [["pattern"], *(["pattern", d] for d in dimensions)]
    negative, positive, taken = F.col("label") == 0, F.col("label") == 1, F.col("predicted_match") == 1
    out = view.groupingSets([[F.col(c) for c in s] for s in sets], "pattern", *dimensions).agg(
        F.grouping_id().alias("_level"), tally(negative, weighted).alias("negative_count"), tally(negative & taken, weighted).alias("false_accept_count"),
        tally(positive, weighted).alias("positive_count"), tally(positive & ~taken, weighted).alias("false_reject_count"), mean.alias("mean_match_probability"),
    )
    top = (1 << len(dimensions)) - 1
    name, value = F.lit("all"), F.lit("all")
    for k, d in enumerate(dimensions):
        here = F.col("_level") == top - (1 << (len(dimensions) - 1 - k))
        name, value = F.when(here, d).otherwise(name), F.when(here, F.col(d)).otherwise(value)
    out = out.withColumns({"dimension": name, "slice": value})
    return out.select("pattern", "dimension", "slice", "negative_count", "false_accept_count", share(F.col("negative_count") - F.col("false_accept_count"), F.col("negative_count")).alias("negative_catch_rate"), "positive_count", "false_reject_count", share(F.col("positive_count") - F.col("false_reject_count"), F.col("positive_count")).alias("positive_keep_rate"), "mean_match_probability")
