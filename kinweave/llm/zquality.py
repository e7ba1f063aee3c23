"""A quality score from compression with dictionaries of good and bad text.

Two zstandard dictionaries are trained on labelled text. A document is
compressed whole with each; the difference of the sizes over their sum says
which dictionary knows its phrases better. A logistic curve, fitted on labelled
documents that no dictionary has seen and weighted to the shares of the labels,
turns that difference into a probability. It also sees the size over the length
of the text and that length, since the same difference means less in a text that
repeats itself or is very short.

The fit reads a bounded sample: at most ``SAMPLE`` labelled documents of each
class, those whose ids have the smallest hashes, and of these only documents of
at most ``SAMPLE_BYTES``. Every document is scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from kinweave.llm.common import documents, id_text, lean, record, text_bytes

SAMPLE, SAMPLE_BYTES = 2000, 64 << 10
DICTIONARY, LEVEL = 64 << 10, 3
#: Fewer labelled documents of a class than this give no dictionary; all scores are then the prior.
LEAST = 8


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train on."""
    room = min(DICTIONARY, max(1024, sum(map(len, texts)) // 8))
    try:
        return zstandard.train_dictionary(room, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICTIONARY:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)


@dataclass
class Model:
    """Dictionaries and the calibration; without dictionaries every score is ``prior``."""

    prior: float
    good: bytes = b""
    bad: bytes = b""
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def features(self, texts: list[bytes]) -> np.ndarray:
        good, bad = _compressor(self.good), _compressor(self.bad)
        size = np.array([(len(good.compress(t)), len(bad.compress(t)), len(t)) for t in texts], np.float64).reshape(-1, 3)
        difference = (size[:, 1] - size[:, 0]) / (size[:, 0] + size[:, 1])
        return np.stack([difference, np.log((size[:, 0] + 1) / (size[:, 2] + 1)), np.log1p(size[:, 2])], 1)

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -4, 4)
        return np.concatenate([z, z**2, z[:, :1] * z[:, 1:], z[:, 1:2] * z[:, 2:], np.maximum(z - 1, 0), np.maximum(-1 - z, 0), np.ones((len(z), 1))], 1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.design(self.features(texts)) @ self.weights, -30, 30)))


def fit_model(good: list[bytes], bad: list[bytes], prior: float) -> Model:
    """Half of each class for its dictionary, the other half for the calibration."""
    if min(len(good), len(bad)) < LEAST:
        return Model(prior)
    model = Model(prior, _dictionary(good[::2]), _dictionary(bad[::2]))
    own = [good[1::2], bad[1::2]]
    x = model.features([*own[0], *own[1]])
    y = np.repeat([1.0, 0.0], [len(own[0]), len(own[1])])
    model.centre, model.scale = np.median(x, axis=0), x.std(axis=0) + 1e-9
    weight = np.where(y == 1, prior / len(own[0]), (1 - prior) / len(own[1])) * len(y)
    d = model.design(x)
    w = np.zeros(d.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d.T * (weight * p * (1 - p))) @ d + 0.1 * np.eye(len(w)), d.T @ (weight * (y - p)) - 0.1 * w)
        w += step / max(1, np.abs(step).max() / 2)
    model.weights = w
    return model


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the rows that aren't held out.

    Labels without an id or value are left out; of several labels of an id the
    smallest counts. With too few of a class the model only knows the prior.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = {bool(r["good"]): r["n"] for r in marks.groupBy((F.col("quality") > 0).alias("good")).agg(F.count("*").alias("n")).collect()}
    prior = (total.get(True, 0) + 0.5) / (sum(total.values()) + 1)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marks.where("quality > 0").orderBy(*order).limit(sample).union(marks.where("quality <= 0").orderBy(*order).limit(sample))
    texts = id_text(docs).join(F.broadcast(chosen), "doc_id").where(F.octet_length("text") <= SAMPLE_BYTES).dropDuplicates(["doc_id"])
    rows = sorted(texts.select("quality", F.col("text").cast("binary").alias("text"), F.xxhash64("doc_id").alias("h"), "doc_id").collect(), key=lambda r: (r["h"], r["doc_id"]))
    return fit_model([bytes(r["text"]) for r in rows if r["quality"] > 0], [bytes(r["text"]) for r in rows if r["quality"] <= 0], prior)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    Null text is scored as empty. Rows without an id aren't held out, and no
    label is learnt from them. An empty table gives no rows; other columns are
    not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record(schema, batch.column("doc_id"), model.score(text_bytes(batch)))

    found = id_text(docs).mapInArrow(lean(run), "doc_id long, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_documents(docs, learn(docs, documents(spark, sf_dir, "labels")))
