from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kinweave.llm import lm, words

from .test_quality import held, tokens


def test_filter_holds_every_level(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**9, 3000)) for _ in range(120)]
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    rows = lm.learn(train, 8).collect()
    assert sum(len(r["words"]) for r in rows) >= 2 * 120 * 3000 * 8 // lm.LOAD
    h, size = lm._tokens(pa.array(texts))
    grams = np.concatenate([h >> np.uint64(16), lm._bigrams(h, size)[0]])
    where = lm._slice_of(grams >> np.uint64(16), 8)
    assert all((lm.probed(np.frombuffer(r["words"], "<u8"), grams[where == r["slice"]]) > 0).all() for r in rows)


def test_words_are_known_by_their_bytes():
    texts = [None, "", " a\tB\x0bb", "x" * 700, "é ü " + "Q" * 8, "q" * 9, "a\0 a", "\x1c\x85"]
    h, size = words.hashed(pa.array(["cut off", *texts]).slice(1))
    own = [(t or "").encode().lower().split() for t in texts]
    assert size.tolist() == [len(w) for w in own]
    flat = [w for x in own for w in x]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))
    assert [p.to_pylist() for _, p in words.chunks(pa.array(texts), 8)] != [texts] and [x for _, p in words.chunks(pa.array(texts), 8) for x in p.to_pylist()] == texts


def test_scores_against_exact_counts(spark, docs, monkeypatch):
    """With hardly any false hits the score is the model's over the middles of exact counts."""
    monkeypatch.setattr(lm, "LOAD", 0.125)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    one, two = Counter(), Counter()
    for i, t in rows:
        if i is None or not held(i, 10, 0):
            own = tokens(t)
            one.update(own)
            two.update(zip([None, *own], own))
    mid = lambda n: 0.0 if not n else 1.0 if n == 1 else 1.5 * 2 ** (n.bit_length() - 1)
    under = sum(one.values()) + 0.1 * (len(one) + 1)

    def score(t):
        own, out = tokens(t), 0.0
        for v, w in zip([None, *own], own):
            c = mid(two[v, w])
            out += np.log10(min(1, (c + 4 * (mid(one[w]) + 0.1) / under) / (max(mid(one[own[-1] if v is None else v]), c) + 4)))
        return out

    got = sorted((repr(r["doc_id"]), r["score"]) for r in lm.score_documents(docs).collect())
    want = sorted((repr(i), score(t)) for i, t in rows)
    assert np.mean([a[1] == pytest.approx(b[1], abs=1e-4) for a, b in zip(got, want)]) > 0.9
