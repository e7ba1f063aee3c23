"""From match probabilities to sets: thresholds, single owners, expected F0.5, selection."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from kinweave.operators.metrics import PAIR, f05, with_copies

THRESHOLDS = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.87, 0.9, 0.95)
#: Prefixes that are valued at once, at most.
PREFIXES = 64


def by_threshold(pairs: DataFrame, threshold: float, probability: str = "match_probability") -> DataFrame:
    """Pairs that reach the threshold."""
    return pairs.where(F.col(probability) >= threshold)


def best_owner(pairs: DataFrame, threshold: float = 0.5, probability: str = "match_probability", audit: DataFrame | None = None) -> DataFrame:
    """One row for each source record: its owner among the pairs that reach the threshold.

    Owners rank by probability, tree score, then S1 id. A record that nobody
    reaches keeps one row (its smallest S1 id) with an empty owner. ``audit``,
    a row of the ownership audit, must allow single owners; a column
    ``source_group_complete`` must be there and true.
    """
    if audit is not None and not audit.first()["ownership_enabled"]:
        raise ValueError("records have several owners in the truth")
    if "source_group_complete" not in pairs.columns or not pairs.where(~F.coalesce("source_group_complete", F.lit(False))).isEmpty():
        raise ValueError("source groups aren't complete")
    in_it = F.coalesce(F.col(probability) >= threshold, F.lit(False))
    order = Window.partitionBy("candidate_source", "candidate_entity_id").orderBy(F.desc(in_it.cast("int")), F.desc(F.when(in_it, F.col(probability))), F.desc(F.when(in_it, F.col("tree_score"))), "source1_entity_id")
    first = pairs.withColumns({"_place": F.row_number().over(order), "ownership_selected": in_it}).where("_place = 1").drop("_place")
    return first.withColumn("chosen_owner", F.when(F.col("ownership_selected"), F.col("source1_entity_id")).otherwise(""))


def selected_edges(owned: DataFrame) -> DataFrame:
    """Chosen pairs in key order, with ``selected`` 1."""
    keep = [c for c in ("match_probability", "decision_route") if c in owned.columns]
    return owned.where("ownership_selected").select("source1_entity_id", "candidate_source", "candidate_entity_id", *keep, F.lit(1).alias("selected")).orderBy("source1_entity_id", "candidate_source", "candidate_entity_id")


def as_lists(queries: DataFrame, chosen: DataFrame) -> DataFrame:
    """``source1_entity_id, matched_entity_ids``: sorted ids of every query, joined by commas."""
    lists = chosen.groupBy("source1_entity_id").agg(F.array_join(F.array_sort(F.collect_set("candidate_entity_id")), ",").alias("matched_entity_ids"))
    return queries.select("source1_entity_id").join(lists, "source1_entity_id", "left").na.fill("", ["matched_entity_ids"])


def ranked_lists(pairs: DataFrame, threshold: float, score: str) -> DataFrame:
    """Ids at or over a threshold, best score first, then by id."""
    own = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col("candidate_entity_id").alias("i"))))
    return pairs.where(F.col(score) >= threshold).groupBy("source1_entity_id").agg(F.array_join(F.array_distinct(F.transform(own, lambda x: x["i"])), ",").alias("matched_entity_ids"))


def match_count_distribution(probabilities: Column) -> Column:
    """Distribution of the number of matches under independence, as an array from 0 up.

    Halves are convolved, so that n candidates take few steps over arrays
    instead of n. Null gives null, as does an array with one.
    """
    return _match_counts(probabilities)


def _halves(p: np.ndarray) -> np.ndarray:
    """Distributions of blocks are convolved two by two; all values are positive sums, so nothing cancels."""
    parts = [np.array((1 - x, x)) for x in p]
    while len(parts) > 1:
        parts = [np.convolve(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else np.ones(1)


@F.pandas_udf(ArrayType(DoubleType()))
def _match_counts(probabilities: pd.Series) -> pd.Series:
    return probabilities.map(lambda p: None if p is None or any(x is None or x != x for x in p) else _halves(np.asarray(p, float)), na_action="ignore")


def expected_f05(chosen: np.ndarray, rest: np.ndarray) -> float:
    """E[5 TP / (4 k + M)] for k chosen of independent candidates; for none, P(M = 0)."""
    if not len(chosen):
        return float(np.prod(1 - rest))

    def counts(p: np.ndarray) -> np.ndarray:
        out = np.ones(1)
        for x in p:
            out = np.convolve(out, (1 - x, x))
        return out

    a, b = counts(chosen), counts(rest)
    tp = np.arange(len(a))[:, None]
    return float((a[:, None] * b[None, :] * 5 * tp / (4 * len(chosen) + tp + np.arange(len(b))[None, :])).sum())


@lru_cache(16)
def _nodes(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fejer's n nodes x in (0, 1) as x, 1 - x and log x, and their positive weights; exact for degrees under n."""
    half = (np.arange(n) + 0.5) * np.pi / (2 * n)
    odd = np.arange(1, n, 2)
    turns = np.arange(n - len(odd))
    v = np.concatenate((2 * np.exp(1j * np.pi * turns / n) / (1 - 4 * turns**2), np.zeros(len(odd) + 1)))
    weights = np.fft.ifft(v[:-1] + np.conj(v[:0:-1])).real / 2
    return np.cos(half) ** 2, np.sin(half) ** 2, 2 * np.log(np.cos(half)), weights


@lru_cache(64)
def _powers(n: int, block: int) -> np.ndarray:
    """x^(4k - 1) at n nodes for a block of prefixes k."""
    return np.exp((4 * (np.arange(PREFIXES)[:, None] + block * PREFIXES) + 3) * _nodes(n)[2])


def best_prefix(p: np.ndarray, copies: np.ndarray | None = None) -> int:
    """How many of the candidates, in falling probability, maximise the expected F0.5.

    ``copies`` says how many candidates have each probability. With G(x) the
    product of 1 - p + p x over all candidates, a prefix of k is worth the
    integral over 0 to 1 of 5 x^(4k-1) G(x) times the sum of p x / (1 - p + p x)
    over its own. That is a polynomial of a degree under m = 5n with positive
    coefficients, and as x^m differs from its Chebyshev series up to degree d by
    2 exp(-d^2 / m) at most, about sqrt(50 m) nodes integrate it to the last
    digit of a double. Groups of any size are valued so. A prefix is worth no
    more than 5 a / (4 + a), a being its mean probability; once that's no gain,
    longer ones aren't valued. An unknown probability gives 0.
    """
    p = np.asarray(p, float)
    copies = np.ones(len(p), np.int64) if copies is None else np.asarray(copies, np.int64)
    ends = np.cumsum(copies)
    n = int(ends[-1]) if len(ends) else 0
    if not n or np.isnan(p).any():
        return 0
    x, gap, log_x, weights = _nodes(nodes := 256 * -(-min(5 * n, int(np.sqrt(250 * n)) + 1) // 256))
    powers = _powers if nodes <= 2048 else _powers.__wrapped__
    log_all = sum(copies[i : i + PREFIXES] @ np.log1p(-p[i : i + PREFIXES, None] * gap) for i in range(0, len(p), PREFIXES))
    sums = np.cumsum(p * copies)
    best, gain = 0, float(np.prod((1 - p) ** copies))
    scale = 5 * weights * np.exp(log_all)
    own, held = np.zeros(len(x)), -1
    for q, size, end, total in zip(p, copies, ends, sums):
        each = q * x / (1 - q * gap)
        # linear within a run of equal probabilities
        both = np.stack((scale * own, scale * each), axis=1)
        k = int(end - size)
        while k < end:
            mean = (total - q * (end - k - 1)) / (k + 1)
            if 5 * mean / (4 + mean) <= gain - 1e-9:
                return best
            block, row = divmod(k, PREFIXES)
            if block != held:
                held, rows = block, powers(nodes, block)
            a, b = (rows[row : row + int(end) - k] @ both).T
            values = a + (np.arange(len(a)) + k + 1 - (end - size)) * b
            for i in np.flatnonzero(values > gain + 1e-12):
                if values[i] > gain + 1e-12:
                    best, gain = k + int(i) + 1, float(values[i])
            k += len(a)
        own += size * each
    return best


@F.pandas_udf(StructType([StructField("cutoff", DoubleType()), StructField("ties", LongType())]))
def _last_taken(probabilities: pd.Series, copies: pd.Series) -> pd.DataFrame:
    out = []
    for p, n in zip(probabilities, copies):
        p = np.asarray(p, float)
        k = best_prefix(p, n)
        at = int(np.searchsorted(np.cumsum(n), k)) if k else 0
        out.append((p[at], k - int(np.sum(n[:at]))) if k else (None, 0))
    return pd.DataFrame(out, columns=["cutoff", "ties"]).astype({"cutoff": "float64", "ties": "int64"})


def expected_cutoffs(counts: DataFrame) -> DataFrame:
    """``source1_entity_id, cutoff, ties``: the best prefix holds all over the cutoff and so many at it.

    ``counts`` has ``source1_entity_id, p, n``: n candidates of probability p, in
    any number of rows. S1s whose best prefix is empty are left out. Candidates
    are counted by probability before those of an S1 meet.
    """
    by_p = counts.groupBy("source1_entity_id", "p").agg(F.sum("n").alias("n"))
    lists = by_p.groupBy("source1_entity_id").agg(F.sort_array(F.collect_list(F.struct("p", "n")), asc=False).alias("x"))
    return lists.select("source1_entity_id", _last_taken("x.p", "x.n").alias("y")).select("source1_entity_id", "y.*").where("ties > 0")


def first_tied(tied: DataFrame) -> DataFrame:
    """The first ``ties`` of each S1's candidates of one probability, by id."""
    nth = F.row_number().over(Window.partitionBy("source1_entity_id").orderBy("candidate_entity_id"))
    return tied.withColumn("_nth", nth).where(F.col("_nth") <= F.col("ties")).select(*PAIR)


def by_expected_f05(pairs: DataFrame, probability: str = "match_probability") -> DataFrame:
    """``source1_entity_id, candidate_entity_id`` of the best prefix of each S1's candidates.

    Equal probabilities rank by candidate id. Groups of all sizes are decoded
    alike; one with an unknown probability gives none.
    """
    slim = pairs.select(*PAIR, F.col(probability).cast("double").alias("p"))
    rows = slim.join(expected_cutoffs(slim.select("source1_entity_id", "p", F.lit(1).alias("n"))), "source1_entity_id")
    return rows.where("p > cutoff").select(*PAIR).union(first_tied(rows.where("p = cutoff")))


def threshold_scores(queries: DataFrame, truth: DataFrame, pairs: DataFrame, thresholds: list[float], probability: str, copies: DataFrame | None = None) -> DataFrame:
    """``threshold, macro_f05`` in one job: the pairs are summed by S1 and threshold.

    ``copies`` (``source1_entity_id, copies``) says for how many S1s of equal
    pairs and truth each query stands.

    A pair counts at every threshold that it reaches: pairs are first summed by
    the highest of them, and running sums over the thresholds do the rest, so no
    pair is repeated.
    """
    grid = sorted(set(thresholds))
    edges = truth.select(*PAIR).distinct().withColumn("_true", F.lit(1))
    best = pairs.groupBy(*PAIR).agg(F.max(probability).alias("_p")).join(edges, PAIR, "left")
    level = sum(((F.col("_p") >= t).cast("int") for t in grid), F.lit(0))
    by_level = best.select("source1_entity_id", level.alias("level"), F.col("_true").isNotNull().alias("hit")).where("level > 0")
    sums = by_level.groupBy("source1_entity_id").agg(*(F.count_if((F.col("level") > k) & F.col("hit")).alias(f"tp{k}") for k in range(len(grid))), *(F.count_if((F.col("level") > k) & ~F.col("hit")).alias(f"fp{k}") for k in range(len(grid))))
    gold = truth.select(*PAIR).distinct().groupBy("source1_entity_id").agg(F.count("*").alias("gold"))
    rows = queries.select("source1_entity_id").distinct().join(gold, "source1_entity_id", "left").join(sums, "source1_entity_id", "left").na.fill(0)
    each = F.lit(1) if copies is None else F.col("copies")
    scores = with_copies(rows, copies).agg(*((F.sum(f05(F.col(f"tp{k}"), F.col(f"fp{k}"), F.col("gold") - F.col(f"tp{k}")) * each) / F.sum(each)).alias(f"m{k}") for k in range(len(grid))))
    return scores.select(F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"m{k}").alias("macro_f05")) for k, t in enumerate(grid)))).alias("x")).select("x.threshold", "x.macro_f05")


def search_threshold(queries: DataFrame, truth: DataFrame, pairs: DataFrame, probability: str = "score", tie: str = "high") -> tuple[float, float]:
    """The best threshold of a coarse grid of 101 and a fine one of 101 around it, and its macro F0.5.

    ``tie`` says which of equally good thresholds is taken, the high or the low.
    """
    sign = 1 if tie == "high" else -1

    def best(grid: list[float]) -> tuple[float, float]:
        rows = threshold_scores(queries, truth, pairs, grid, probability).collect()
        top = max(rows, key=lambda r: (r["macro_f05"], sign * r["threshold"]))
        return top["threshold"], top["macro_f05"]

    coarse, _ = best([k / 100 for k in range(101)])
    low, high = max(0.0, coarse - 0.05), min(1.0, coarse + 0.05)
    return best([low + (high - low) * k / 100 for k in range(101)])


def tune_threshold(queries: DataFrame, truth: DataFrame, pairs: DataFrame, probability: str = "score") -> tuple[float, float]:
    """The best of .05, .10, ... .95, the lowest in a tie."""
    rows = threshold_scores(queries, truth, pairs, [k / 20 for k in range(1, 20)], probability).collect()
    top = max(rows, key=lambda r: (r["macro_f05"], -r["threshold"]))
    return top["threshold"], top["macro_f05"]


def select_decoder(queries: DataFrame, truth: DataFrame, pairs: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, audit: DataFrame | None = None, expected: bool = False) -> list[dict]:
    """All decoders and thresholds with their macro F0.5, the best first.

    In a tie the simpler decoder stands first, then the earlier threshold.
    Single ownership is tried only if the audit allows it. With owners chosen by
    probability, the owner of a record doesn't depend on the threshold.
    """
    found = [{"decoder": "threshold", "threshold": r["threshold"], "macro_f05": r["macro_f05"]} for r in threshold_scores(queries, truth, pairs, list(thresholds), "match_probability").collect()]
    if audit is not None and audit.first()["ownership_enabled"]:
        owned = best_owner(pairs, min(thresholds), audit=audit).where("ownership_selected")
        found += [{"decoder": "threshold_best_owner", "threshold": r["threshold"], "macro_f05": r["macro_f05"]} for r in threshold_scores(queries, truth, owned, list(thresholds), "match_probability").collect()]
    if expected:
        sure = by_expected_f05(pairs).withColumn("match_probability", F.lit(1.0))
        value = threshold_scores(queries, truth, sure, [0.5], "match_probability").first()["macro_f05"]
        found.append({"decoder": "expected_f05", "threshold": None, "macro_f05": value})
    order = {"threshold": 0, "threshold_best_owner": 1, "expected_f05": 2}
    return sorted(found, key=lambda r: (-r["macro_f05"], order[r["decoder"]], r["threshold"] or 0))
