import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import zstandard

from kinweave.llm import lm, rules, zquality

from .conftest import prose, rows_of


def held(i, m, r):
    return zlib.crc32(str(i).encode()) % m == r


def brute_counts(text):
    words = re.findall("[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 5)}
    seen, repeated, lines = set(), 0, 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            lines += 1
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), lines, len(re.findall("[A-Z]", text))


def test_counts(all_texts):
    rng = random.Random(8)
    extra = ["".join(rng.choice(["a", "B", " ", "\n", "#", "é", "\t"]) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    for text in [t or "" for t in all_texts] + extra:
        assert rules.counts(text.encode()) == brute_counts(text)


def exact_upper(bad, n, level):
    low, high = 0.0, 1.0
    for _ in range(80):
        p = (low + high) / 2
        tail = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(bad + 1))
        low, high = (p, high) if tail > level else (low, p)
    return low


@pytest.mark.parametrize("bad,n", [(0, 10), (0, 500), (3, 50), (10, 12), (12, 12)])
def test_upper_bound(bad, n):
    for level in (0.05, 0.001):
        want = 1.0 if bad == n else exact_upper(bad, n, level)
        assert abs(rules.upper_bound(bad, n, level) - want) < 1e-9


def test_certified_cutoffs_hold_their_risk():
    rng = np.random.default_rng(1)
    wrong = 0
    for _ in range(60):
        good = np.minimum(rules.GRID, rng.geometric(0.05, 2000) - 1)
        bad = rng.integers(0, rules.GRID, 500)
        k = rules.certify(np.bincount(good, minlength=rules.GRID + 1).tolist(), np.bincount(bad, minlength=rules.GRID + 1).tolist(), 0.05, 0.05)
        wrong += k is not None and 0.95**k > 0.05
    assert wrong <= 6


def test_few_labels_certify_nothing():
    good = [50] + [0] * rules.GRID
    bad = [0] * 150 + [50] + [0] * (rules.GRID - 150)
    assert rules.certify(good, bad, 0.005, 0.001) is None
    assert rules.certify([5000] + [0] * rules.GRID, bad, 0.005, 0.001) == 150


def labelled(spark):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(2600):
        text = prose(rng, rng.randint(20, 60))
        quality = int(i % 13 > 0)
        if not quality:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, None if i % 50 == 0 else "de" if i % 5 == 1 else "en", "s", len(text)))
        marks.append((i, quality, 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_quality_rules(spark, docs, clashing, empty):
    own, labels = labelled(spark)
    got = rules.quality_rules(own, labels).collect()
    wrong = Counter((r["kept"], r["doc_id"] % 13 > 0) for r in got if r["lang"])
    assert wrong[(True, False)] == 0 and wrong[(False, True)] == 0
    assert all(r["kept"] for r in got if r["lang"] is None), "too few of a stratum certify nothing"
    assert {(r["stratum"], r["any"] is None, r["symbols"] is None) for r in rules.learn_cutoffs(rules.measure(own, ["doc_id", "lang"]), labels).collect()} == {("=en", True, False), ("=de", False, True)}
    kept = rules.keep_good(own, labels)
    assert rows_of(kept.select("doc_id")) == sorted(((r["doc_id"],) for r in got if r["kept"]), key=repr)
    none = labels.limit(0)
    plain = rules.quality_rules(docs, none)
    assert rows_of(plain) == rows_of(rules.quality_rules(clashing, none))
    assert all(r["kept"] != r["base_failed"] for r in plain.collect())
    assert rules.quality_rules(empty, none).count() == 0
    assert rows_of(rules.keep_good(docs, none).select("doc_id")) == rows_of(plain.where("kept").select("doc_id"))


def brute_kept(rows, marks):
    """The verdicts from texts and labels alone; rows: (doc_id, text, lang)."""
    n = {t: brute_counts(t or "") for _, t, _ in rows}
    failed = {t: c[0] < 10 or 100 * c[4] > 20 * c[0] for t, c in n.items()}
    ratios = {t: [Fraction(a, b) if b else None for a, b in ((c[2], c[1]), (c[4], c[0]), (c[3], c[5]), (c[6], c[1]))] for t, c in n.items()}
    for x in ratios.values():
        x.append(max((r for r in x if r is not None), default=None))
    quality = {}
    for i, q in marks:
        if i is not None and q is not None:
            quality[i] = min(q, quality.get(i, 1))
    held = {}
    for i, t, lang in rows:
        if i in quality and not failed[t]:
            held.setdefault(t, []).append((lang is not None, lang or "", quality[i]))
    strata = {}
    for t, own in held.items():
        strata.setdefault(min(own)[:2], []).append((t, min(q for *_, q in own) > 0))
    kinds = {}
    for s, own in strata.items():
        good = sum(g for _, g in own)
        kinds[s] = [0, 1, 2, 3] if 0.995**good <= 0.0125 else [4] if 0.98**good <= 0.05 else []
    level = 0.05 / max(1, sum(map(len, kinds.values())))
    cut = {}
    for s, own in strata.items():
        for k in kinds[s]:
            risk, total, gain = (0.02 if k == 4 else 0.005), sum(g for _, g in own), 0
            for step in range(rules.GRID - 1, 0, -1):
                over = [g for t, g in own if ratios[t][k] is not None and ratios[t][k] > Fraction(step, rules.GRID)]
                if sum(over) / total > risk or exact_upper(sum(over), total, level) > risk:
                    break
                if len(over) - sum(over) - rules.GOOD_COST * sum(over) > gain:
                    gain, cut[s, k] = len(over) - sum(over) - rules.GOOD_COST * sum(over), step
    at = [(lang is not None, lang or "") for *_, lang in rows]
    return [not failed[t] and not any(ratios[t][k] is not None and (s, k) in cut and ratios[t][k] > Fraction(cut[s, k], rules.GRID) for k in range(5)) for (_, t, _), s in zip(rows, at)]


def test_verdicts_against_brute_force(spark):
    """Copies of texts, repeated ids, several and missing labels, ties, three kinds of strata."""
    own, labels = labelled(spark)
    rng = random.Random(9)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in own.collect()]
    rows = [(i, t.replace("###", "##", rng.randint(0, 20)) if i % 13 == 0 else t + (" ##" if i % 97 == 0 else ""), x) for i, t, x in rows]
    rows += [(5000 + i, rows[i % 40][1], rows[i % 3][2]) for i in range(400)] + [(7, rows[9][1], "en"), (None, rows[0][1], "en"), (9000, None, None), (9001, " ", "")]
    marks = [(r["doc_id"], r["quality"]) for r in labels.collect()] + [(5000 + i, 1) for i in range(400)] + [(3, 0), (None, 1), (4, None), (9000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = rules.quality_rules(docs, spark.createDataFrame(marks, "doc_id long, quality int"))
    want = brute_kept(rows, marks)
    assert 100 < sum(not k for k in want) < 1000
    assert Counter((r["doc_id"], r["lang"], r["n_words"], r["kept"]) for r in got.collect()) == Counter((i, x, len((t or "").split()), k) for (i, t, x), k in zip(rows, want))


def test_classifier_against_a_direct_computation():
    """Scores from sizes and the formula, texts that are empty, long and alike included."""
    rng = random.Random(12)
    good, bad = [prose(rng, 60) for _ in range(60)], [prose(rng, 20) + " ###" * 20 for _ in range(60)]
    model = zquality.fit_model([g.encode() for g in good], [b.encode() for b in bad], 0.7)
    texts = [b"", b"x", good[0].encode(), bad[0].encode(), bad[0].encode(), ("".join(good) * 300).encode(), "日本語".encode() * 5]
    want = []
    for t in texts:
        size = [len(zstandard.ZstdCompressor(level=zquality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(t)) for d in (model.good, model.bad)]
        x = [(size[1] - size[0]) / (size[0] + size[1]), math.log((size[0] + 1) / (len(t) + 1)), math.log1p(len(t))]
        z = [min(4, max(-4, (v - c) / s)) for v, c, s in zip(x, model.centre, model.scale)]
        design = [*z, *(v * v for v in z), z[0] * z[1], z[0] * z[2], z[1] * z[2], *(max(v - 1, 0) for v in z), *(max(-1 - v, 0) for v in z), 1]
        want.append(1 / (1 + math.exp(-sum(d * w for d, w in zip(design, model.weights)))))
    assert model.score(texts).tolist() == pytest.approx(want, abs=1e-9)


def test_classifier_on_held_out_rows(spark, docs, clashing, empty):
    own, labels = labelled(spark)
    model = zquality.learn(own, labels)
    got = zquality.score_documents(own, model).collect()
    assert all(r["held_out"] == held(r["doc_id"], 3, 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    test = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 13 > 0) for r in test) / len(test) > 0.97
    flipped = labels.selectExpr("doc_id", "CASE WHEN pmod(crc32(cast(doc_id AS string)), 3) = 1 THEN 1 - quality ELSE quality END AS quality", "toxic")
    again = zquality.learn(own, flipped)
    assert again.good == model.good and again.bad == model.bad and (again.weights == model.weights).all()
    assert rows_of(zquality.score_documents(docs, model)) == rows_of(zquality.score_documents(clashing, model))
    assert zquality.score_documents(empty, model).count() == 0
    assert zquality.learn(own, labels.limit(0)).score([b"", b"x"]).tolist() == [0.5, 0.5]


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall("[^\x20\x09-\x0D]+", low), "\0end"]


def test_language_model(docs, clashing, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    count = Counter()
    for i, t in rows:
        if i is None or not held(i, 10, 0):
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in rows:
        own = tokens(t)
        want.append((i, i is not None and held(i, 10, 0), len(own), sum(count[w] > 0 for w in own), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), 6)))
    got = lm.score_documents(docs).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["score"] <= 0 for r in got)
    again = lm.score_documents(clashing).collect()
    assert sorted((repr(r["doc_id"]), round(r["score"], 6)) for r in got) == sorted((repr(r["doc_id"]), round(r["score"], 6)) for r in again)
    assert lm.score_documents(empty).count() == 0


def test_coarse_slices_give_the_same_scores(docs, monkeypatch):
    """Rows that pass through coarse slices first end in the same counts and levels."""
    monkeypatch.setattr(lm, "SLICE_BYTES", 4000)
    monkeypatch.setattr(lm, "BATCH", 500)
    first = sorted((repr(r["doc_id"]), r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm.score_documents(docs).collect())
    monkeypatch.setattr(lm, "FAN", 5)
    assert sorted((repr(r["doc_id"]), r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm.score_documents(docs).collect()) == first


def test_filter_counts():
    rng = np.random.default_rng(2)
    h = rng.integers(1, 2**48, 20_000, dtype=np.uint64)
    n = np.minimum(rng.zipf(1.5, len(h)), 1 << 20)
    table = np.frombuffer(lm.build_slice(h, n), "<u8")
    found = lm._middle(lm.probed(table, h))
    assert (found >= n / 2).all(), "a stored count is never below its level"
    assert (found <= 1.5 * n).mean() > 0.9
    strange = lm.probed(table, rng.integers(1, 2**48, 20_000, dtype=np.uint64))
    assert (strange > 0).mean() < 0.2


@pytest.mark.parametrize("bits", [8, 48, 64])
def test_packed_hashes(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 2, 300):
        h = np.unique(rng.integers(0, 2**bits, n, dtype=np.uint64))
        assert (lm._unpack_sorted(lm._pack_sorted(h)) == h).all()
    assert lm._unpack(lm._pack(np.array([0, 7, 1 << 40]))).tolist() == [0, 7, 1 << 40]
