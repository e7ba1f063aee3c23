"""Expected F0.5 decodes groups of all sizes alike, by counts of equal probabilities."""

import numpy as np

from kinweave.operators import decode
from kinweave.plans import catalogue, views as V
from tests.test_copies import copied  # noqa: F401
from tests.test_plans import needs_data


def every_prefix(p):
    """The best prefix by the distributions of chosen and left counts."""
    gains = [decode.expected_f05(p[:k], p[k:]) for k in range(len(p) + 1)]
    return int(np.flatnonzero(np.array(gains) > max(gains) - 1e-12)[0])


def test_prefix_of_counted_probabilities():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 40, 150):
        for p in (rng.random(n), rng.random(n) ** 5, rng.choice([0.0, 0.2, 0.6, 1.0], n), 1 - rng.random(n) ** 4):
            p = np.sort(p)[::-1]
            values, copies = np.unique(p, return_counts=True)
            assert decode.best_prefix(p) == decode.best_prefix(values[::-1], copies[::-1]) == every_prefix(p)
    assert decode.best_prefix(np.array([])) == decode.best_prefix(np.array([0.9, np.nan])) == 0


def test_group_of_more_than_a_hundred(spark):
    """150 candidates just under 0.5 are worth taking, though the threshold takes none."""
    rows = [("S1-1", f"S2-{i:03}", 0.45 if i % 2 else 0.3) for i in range(150)] + [("S1-2", "S2-000", None), ("S1-2", "S2-001", 0.9)]
    pairs = spark.createDataFrame(rows, "source1_entity_id string, candidate_entity_id string, match_probability double")
    p = np.sort([r[2] for r in rows[:150]])[::-1]
    order = sorted(rows[:150], key=lambda r: (-r[2], r[1]))
    want = [r[:2] for r in order[: every_prefix(p)]]
    assert want and sorted(map(tuple, decode.by_expected_f05(pairs).collect())) == sorted(want)


@needs_data
def test_query_over_copies(spark, copied):  # noqa: F811
    """By sets of equal records as by single pairs, ties and repeated ids included."""
    pairs = V.routed(spark, copied).select("source1_entity_id", "candidate_entity_id", "match_probability").collect()
    want = []
    for s1 in {r[0] for r in pairs}:
        own = sorted((r for r in pairs if r[0] == s1), key=lambda r: (-r[2], r[1]))
        want += [tuple(r[:2]) for r in own[: every_prefix(np.array([r[2] for r in own]))]]
    assert sorted(map(tuple, catalogue.QUERIES["decode_expected_f05"](spark, copied).collect())) == sorted(want)
