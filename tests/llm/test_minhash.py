import random

import corpus_pipeline
from kinweave.llm import minhash

from .conftest import prose


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    """Smallest reachable index over all pairs at a Jaccard similarity of 0.8."""
    sets, label = [grams(t) for t in texts], list(range(len(texts)))
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    return label


def edited():
    """Copies with words changed here and there, at similarities on both sides of 0.8, and chains of them."""
    rng = random.Random(8)
    out = [prose(rng, rng.randint(10, 300)) for _ in range(30)]
    for k in range(30):
        now = out[k].split()
        for _ in range(6):
            now = list(now)
            for _ in range(rng.randint(1, max(1, len(now) // 40))):
                now[rng.randrange(len(now))] = "new" + str(rng.randrange(10**6))
            out.append(" ".join(now))
    return [*out, None, "", " ", "three words here", "Three  words here"]


def test_components_against_brute_force(spark):
    texts = edited()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    want = brute(texts)
    assert 40 < len(set(want)) < len(texts) - 40
    assert [got[i] for i in range(len(texts))] == want


def test_stage_drops_texts_at_the_similarity(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(minhash, "BEST", ())
    monkeypatch.setattr(minhash, "BLOCK", 2)
    texts = edited()
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, texts[0], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {*brute(texts), None}


def test_empty_table(empty):
    assert minhash.near_duplicates(empty).count() == 0 and minhash.drop_near_duplicates(empty).count() == 0
