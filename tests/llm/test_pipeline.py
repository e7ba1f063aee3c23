import random

import corpus_pipeline
from kinweave.llm import cuckoo, rules, simhash
from kinweave.operators import components

from .conftest import prose, rows_of
from .test_minhash import brute


def tables(spark, folder):
    rng = random.Random(11)
    rows = []
    for i in range(60):
        rows.append((i, prose(rng, 80), "en", "s"))
    rows += [(100, rows[0][1], "en", "s"), (101, rows[1][1].replace(" ", "  "), "en", "s"), (102, rows[2][1] + " tail", "en", "s"), (103, "too short", "en", "s"), (104, None, None, None), (105, rows[3][1] + " mail me@example.com", "de", "s")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return df


def test_stages_keep_what_they_should(spark, tmp_path):
    docs = tables(spark, str(tmp_path))
    seen = {}
    step = docs
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, str(tmp_path))
        step.write.parquet(f"{tmp_path}/{name}")
        step = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = step
        if name != "packing":
            assert step.columns == docs.columns
    ids = {name: sorted(r["doc_id"] for r in df.select("doc_id").collect()) for name, df in seen.items() if name != "packing"}
    assert set(ids["quality_rules"]) == {*range(60), 100, 101, 102, 105}
    assert 100 not in ids["exact_dedup"] and 101 in ids["exact_dedup"] and 1 not in ids["exact_dedup"], "the longer original stays"
    near = {r["doc_id"]: r["text"] for r in seen["exact_dedup"].select("doc_id", "text").collect()}
    order = sorted(near)
    assert ids["near_dedup"] == sorted({order[k] for k in brute([near[i] for i in order])}) and not {102, 105} & set(ids["near_dedup"])
    assert ids["personal_data"] == ids["near_dedup"]
    texts = {r["doc_id"]: r["text"] for r in seen["personal_data"].collect()}
    assert not any("@" in t for t in texts.values())
    packed = seen["packing"]
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(ids["personal_data"])


def test_run_equals_stages(spark, tmp_path):
    tables(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "personal_data", "packing"]
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, step, str(tmp_path)).write.parquet(f"{tmp_path}/again-{name}")
        step = spark.read.parquet(f"{tmp_path}/again-{name}")
    placed = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset", "window"]
    assert out.count() > 0 and rows_of(out.select(placed)) == rows_of(step.select(placed))


def test_stages_on_an_empty_table(spark, tmp_path, empty):
    tables(spark, str(tmp_path))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert cuckoo.digests(empty).count() == 0 and rules.measure(empty, ["doc_id"]).count() == 0


def test_near_dedup_goes_through_simhash(spark, monkeypatch):
    """Fingerprints at 4 or fewer bits give candidates, and only those that are similar are linked."""
    rng = random.Random(5)
    long = prose(rng, 400)
    texts = [long, long + " tail", prose(rng, 60), "", "  ", None, "ab", "AB"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bits = [simhash.simhash64((t or "").encode(), 5) for t in texts]
    near = {(i, j) for j in range(len(texts)) for i in range(j) if (bits[i] ^ bits[j]).bit_count() <= simhash.RADIUS}
    found = {tuple(sorted(r)) for r in simhash.links(docs, 5).select("src", "dst").collect()}
    assert {(0, 1), (6, 7)} <= found <= near

    seen, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda docs, width: seen.append(width) or links(docs, width))
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 6] and seen == [5]


def test_near_dedup_of_few_links_runs_no_rounds(spark, docs, monkeypatch):
    def rounds(edges):
        raise AssertionError("a small graph went through the rounds")

    monkeypatch.setattr(components, "_large_star", rounds)
    assert corpus_pipeline.near_dedup(spark, docs, "").count() < docs.count()
