import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kinweave.llm import cuckoo, simhash

from .conftest import rows_of


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """Smallest reachable index by links at 4 bits or fewer, all pairs compared."""
    fp = np.array(fps, np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    label = np.arange(len(fp))
    while True:
        new = np.where(near, label[None, :], len(fp)).min(axis=1)
        if (new == label).all():
            return label.tolist()
        label = new


def test_fingerprints_and_components(docs, all_texts):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect() if r["doc_id"] is not None}
    fps = [fingerprint(t) for t in all_texts]
    assert [got[i]["fp"] & (1 << 64) - 1 for i in range(len(fps))] == fps
    assert [got[i]["component_id"] for i in range(len(fps))] == components(fps)


def test_rows_without_id(docs):
    rows = simhash.near_duplicates(docs).where("doc_id IS NULL").collect()
    empties = {r["component_id"] for r in rows}
    assert len(rows) == 2 and None in empties


@pytest.mark.parametrize("limit", [4, 20_000])
def test_dense_groups_keep_every_link(spark, limit):
    rng = random.Random(1)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    fps = set(seeds)
    for s in seeds[:6]:
        for _ in range(40):
            fps.add(s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    reps = spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp long, rep long")
    matched = simhash._match_keys(simhash._table_rows(reps), 4, limit)
    edges = matched.where("fp IS NULL").select("src", "dst").union(simhash._ball_links(matched.where("fp IS NOT NULL").select("fp", "src")))
    found = {r["node"]: r["component"] for r in simhash.connected_components(edges).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == components(fps)


def test_near_duplicates_edges(empty, clashing, docs):
    assert simhash.near_duplicates(empty).count() == 0
    assert rows_of(simhash.near_duplicates(clashing)) == rows_of(simhash.near_duplicates(docs))
    kept = simhash.drop_near_duplicates(clashing)
    assert kept.columns == clashing.columns
    want = {r["component_id"] for r in simhash.near_duplicates(docs).collect() if r["doc_id"] is not None}
    assert {r["doc_id"] for r in kept.collect()} - {None} == want


def test_cuckoo_index_against_a_dictionary():
    rng = random.Random(3)
    index, model = cuckoo.CuckooIndex(buckets=2, fingerprint_bits=6), {}
    for _ in range(6000):
        key = hashlib.sha256(str(rng.randint(0, 900)).encode()).digest()
        act = rng.random()
        if act < 0.5:
            assert index.insert(key, len(model)) == (key not in model)
            model[key] = index.find(key)
        elif act < 0.75:
            assert index.delete(key) == (model.pop(key, None) is not None)
        else:
            assert index.find(key) == model.get(key)
    assert dict(index.items()) == model and index.live == len(model)
    assert index.resizes > 0 and index.false_hits > 0


def test_exact_duplicates(docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0D]", "", t)].append((-len(t), i is None, i or 0, i))
    want = []
    for i, t in rows:
        key = re.sub("[\x20\x09-\x0D]", "", t)
        best = min(groups[key])
        want.append((i, hashlib.sha256(key.encode()).hexdigest(), best[3], len(groups[key]), (i, len(t)) == (best[3], -best[0])))
    got = cuckoo.exact_duplicates(docs).select("doc_id", F.lower(F.hex("digest")), "keep_id", "group_size", "kept")
    assert rows_of(got) == sorted(want, key=repr)


def test_exact_edges(empty, clashing, docs):
    assert cuckoo.exact_duplicates(empty).count() == 0
    assert rows_of(cuckoo.exact_duplicates(clashing)) == rows_of(cuckoo.exact_duplicates(docs))
    kept = cuckoo.drop_duplicates(clashing)
    assert kept.columns == clashing.columns
    assert kept.count() == cuckoo.exact_duplicates(docs).select("digest").distinct().count()


def test_changes(spark, docs):
    live = cuckoo.exact_groups(cuckoo.digests(docs))
    one = cuckoo.digests(docs.where("doc_id = 3")).first()
    new = hashlib.sha256(b"new").digest()
    rows = [(1, "delete", bytearray(one["digest"]), None, None), (2, "insert", bytearray(new), 3, 900), (3, "insert", bytearray(new), 3, 800), (4, "delete", bytearray(b"?" * 32), None, None), (5, "insert", bytearray(one["digest"]), 10, 901), (6, None, bytearray(new), 3, 1)]
    after = cuckoo.apply_changes(live, spark.createDataFrame(rows, "seq long, op string, digest binary, n_points long, keep_id long"))
    found = {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in after.collect()}
    assert found[new] == (800, 2) and found[bytes(one["digest"])] == (901, 1)
    assert len(found) == live.count() + 1
