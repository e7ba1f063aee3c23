"""SentencePiece encoding with byte spans, decoding, and token counts."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinweave.llm.common import documents, id_text, lean, record, text_bytes
from kinweave.llm.piece import WS, PieceBpe, default_path, piece_bpe

#: Documents whose parts are merged together.
GROUP = 512


def _normal(model: PieceBpe, texts: list[bytes]) -> tuple[list[str], list[list[int] | None]]:
    """Normalised texts with their alignment; none where only spaces were changed."""
    out, align = [], []
    for t in texts:
        if not t:
            out.append("")
            align.append([0])
        elif model.normaliser.plain and WS not in (s := t.decode("utf-8", "replace")):
            out.append(WS + s.replace(" ", WS))
            align.append(None)
        else:
            s, a = model.normaliser(t)
            out.append(s.decode())
            align.append(a)
    return out, align


def encode_texts(model: PieceBpe, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """For each text its ids, the source spans of the pieces (begin, end) and the ids in decimal.

    Spans lie end to end in bytes of the source. A piece of white space that the
    normaliser put in front has an empty span, or starts where its word does. A
    byte piece covers its own byte.
    """
    normal, aligned = _normal(model, texts)
    for got, align in zip(model.look_up(normal, model.packed), aligned):
        ids = np.frombuffer(b"".join(got), model.dtype)
        if align is None:
            end = np.cumsum(model.source_size[ids]) - 1
        else:
            end = np.array(align, np.int64)[np.cumsum(model.size[ids])]
        begin = np.concatenate([np.zeros(min(1, len(end)), np.int64), end[:-1]])
        yield ids, np.stack([begin, end], 1), b",".join(map(model.decimal.__getitem__, ids.tolist()))


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids, begins, ends, decoded`` for every row.

    begins and ends are the byte spans of the pieces in the original text. Null
    text counts as empty; an empty text has no ids and decodes to the empty
    text. Rows are neither merged nor dropped; other columns are not read.
    """
    return _encoded(docs, model_path, False)


def _encoded(docs: DataFrame, model_path: str, digest: bool) -> DataFrame:
    longs = pa.list_(pa.int64())
    if digest:
        fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_crc32", pa.int64())]
        ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"
    else:
        fields = [("ids", longs), ("begins", longs), ("ends", longs), ("decoded", pa.string())]
        ddl = "doc_id long, ids array<long>, begins array<long>, ends array<long>, decoded string"
    schema = pa.schema([("doc_id", pa.int64()), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_bpe(model_path, "ids")
        for big in batches:
            for at in range(0, big.num_rows, GROUP):
                batch = big.slice(at, GROUP)
                rows = []
                for ids, spans, decimal in encode_texts(model, text_bytes(batch)):
                    decoded = model.library.decode(ids.tolist()) if len(ids) else ""
                    if digest:
                        rows.append((len(ids), hashlib.sha256(decimal).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), zlib.crc32(spans.astype("<u4").tobytes())))
                    else:
                        rows.append((ids.tolist(), spans[:, 0].tolist(), spans[:, 1].tolist(), decoded))
                yield record(schema, batch.column("doc_id"), *([r[k] for r in rows] for k in range(4)))

    return id_text(docs).mapInArrow(lean(run), ddl)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row; null text counts as empty (0 and 0)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_bpe(model_path, "counts")
        for big in batches:
            for at in range(0, big.num_rows, GROUP):
                batch = big.slice(at, GROUP)
                texts = text_bytes(batch)
                n = [sum(x) for x in model.look_up(_normal(model, texts)[0], model.counts)]
                yield record(schema, batch.column("doc_id"), [len(t) for t in texts], n, [x > limit for x in n])

    return id_text(docs).mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return _encoded(documents(spark, sf_dir), default_path(), True)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), default_path())
