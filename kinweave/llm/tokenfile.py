"""Token ids in patched frame-of-reference blocks, written and read by Spark.

A file image holds whole documents in order. All ids of its documents, end ids
included, form one stream cut into blocks of ``BLOCK``. A block stores its
minimum, a bit width chosen so that at least ``PERCENTILE`` percent of the
offsets from the minimum fit, the low bits of every offset as bit planes, and an
exception list (place, high bits) for the offsets that don't fit. The header's
index gives the byte at which each block starts, so a reader can decode any
document alone.

Images are rows of a Parquet table in the order of the documents. Spark's own
commit protocol writes them, which survives lost executors and works in every
store that Spark can write; ``payload`` is the file as such.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.llm.bytebpe import byte_bpe, default_path
from kinweave.llm.common import documents, id_text, lean, record, text_bytes
from kinweave.sources.scratch import scratch_path

MAGIC = b"KWTF0001"
BLOCK = 1024
PERCENTILE = 90
#: An image is closed when it holds this many ids; a longer document makes a longer one.
IMAGE_IDS = 1 << 20
#: Bytes of text that a range is meant for.
RANGE_BYTES = 64 << 20
_HEAD = struct.Struct("<8sQQQ")


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Byte starts of the blocks, and the blocks one after another."""
    n = len(ids)
    if not n:
        return np.zeros(0, "<u8"), b""
    rows = -(-n // BLOCK)
    x = np.full(rows * BLOCK, ids[-1], np.uint32)
    x[:n] = ids
    x = x.reshape(rows, BLOCK)
    low = x.min(axis=1)
    d = x - low[:, None]
    at = -(-BLOCK * PERCENTILE // 100) - 1
    width = np.ceil(np.log2(np.partition(d, at, axis=1)[:, at].astype(np.float64) + 1)).astype(np.int64)
    packed: list[bytes] = [b""] * rows
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        part = d[own]
        planes = [np.packbits((part >> np.uint32(b)).astype(np.uint8) & 1, axis=1) for b in range(w)]
        body = np.concatenate(planes, axis=1) if planes else np.zeros((len(own), 0), np.uint8)
        high = part >> np.uint32(w)
        for k, r in enumerate(own.tolist()):
            place = np.flatnonzero(high[k])
            packed[r] = b"".join((struct.pack("<IHH", int(low[r]), w, len(place)), body[k].tobytes(), place.astype("<u2").tobytes(), high[k][place].astype("<u4").tobytes()))
    starts = np.zeros(rows, "<u8")
    starts[1:] = np.cumsum([len(p) for p in packed[:-1]])
    return starts, b"".join(packed)


def unpack_block(blob: memoryview, at: int) -> np.ndarray:
    """The ``BLOCK`` ids of the block that starts at a byte."""
    low, w, n = struct.unpack_from("<IHH", blob, at)
    at += 8
    plane = BLOCK // 8
    d = np.zeros(BLOCK, np.uint32)
    if w:
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, w * plane, at).reshape(w, plane), axis=1)
        for b in range(w):
            d |= bits[b].astype(np.uint32) << np.uint32(b)
    at += w * plane
    if n:
        place = np.frombuffer(blob, "<u2", n, at)
        d[place] |= np.frombuffer(blob, "<u4", n, at + 2 * n) << np.uint32(w)
    return d + np.uint32(low)


def write_image(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """A file image; a null doc_id is marked in a bit field of its own."""
    starts, blocks = pack_blocks(ids)
    docs = np.array([0 if i is None else i for i in doc_ids], "<i8")
    null = np.packbits(np.array([i is None for i in doc_ids], np.uint8))
    body = b"".join((docs.tobytes(), np.array(lengths, "<u8").tobytes(), null.tobytes(), starts.tobytes(), blocks))
    return _HEAD.pack(MAGIC, len(doc_ids), len(ids), zlib.crc32(body)) + body


class ImageReader:
    """Random access to the documents of a file image."""

    def __init__(self, payload: bytes):
        magic, n_docs, self.n_ids, crc = _HEAD.unpack_from(payload)
        view = memoryview(payload)
        if magic != MAGIC or zlib.crc32(view[_HEAD.size :]) != crc:
            raise ValueError("not a token file, or damaged")
        at = _HEAD.size
        docs = np.frombuffer(view, "<i8", n_docs, at).tolist()
        self.lengths = np.frombuffer(view, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
        at += 16 * n_docs
        null = np.unpackbits(np.frombuffer(view, np.uint8, -(-n_docs // 8), at), count=n_docs)
        self.doc_ids = [None if x else i for i, x in zip(docs, null.tolist())]
        at += -(-n_docs // 8)
        rows = -(-self.n_ids // BLOCK)
        self.starts = np.frombuffer(view, "<u8", rows, at).astype(np.int64)
        self.view, self.blocks_at = view, at + 8 * rows
        self.ends = np.cumsum(self.lengths)

    def slice(self, begin: int, end: int) -> np.ndarray:
        """Ids ``begin`` to ``end`` of the image; only their blocks are read."""
        if end <= begin:
            return np.zeros(0, np.uint32)
        first = begin // BLOCK
        rows = [unpack_block(self.view, self.blocks_at + int(s)) for s in self.starts[first : -(-end // BLOCK)]]
        return np.concatenate(rows)[begin - first * BLOCK : end - first * BLOCK]

    def all_ids(self) -> np.ndarray:
        return self.slice(0, self.n_ids)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode texts and write images to ``path`` in ascending doc_id order.

    Rows: ``part, image, first_id, last_id, local_start, n_ids, payload``;
    ``part`` numbers the ranges of rows, ``image`` the images of a range,
    ``local_start`` counts the ids of the range before the image, and first_id
    and last_id are the smallest and largest doc_id in it. Null doc_ids come
    first; rows that share a doc_id are ordered by a hash of their text. Null
    text counts as empty. Ranges are cut by doc_id, that hash and a row number,
    so rows that share their id, or have none, and their text don't meet in one
    task; the number of ranges follows from the volume of text.
    """
    schema = pa.schema([("part", pa.int64()), ("image", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("local_start", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        part, image, local = TaskContext.get().partitionId(), 0, 0
        who: list = []
        lengths: list[int] = []
        held: list[bytes] = []
        total = 0

        def flush() -> pa.RecordBatch:
            payload = write_image(who, lengths, np.frombuffer(b"".join(held), encoder.dtype).astype(np.uint32))
            known = [w for w in who if w is not None]
            return record(schema, [part], [image], [min(known, default=None)], [max(known, default=None)], [local], [total], [payload])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch)):
                ids = encoder.ids(text.decode("utf-8", "replace")) + end
                who.append(doc)
                lengths.append(len(ids) // encoder.dtype.itemsize)
                held.append(ids)
                total += lengths[-1]
                if total >= IMAGE_IDS:
                    yield flush()
                    image, local, total = image + 1, local + total, 0
                    who, lengths, held = [], [], []
        if who:
            yield flush()

    source = id_text(docs)
    volume = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-volume // RANGE_BYTES))
    keyed = source.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(ranges, "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")
    ordered.mapInArrow(lean(run), "part long, image long, first_id long, last_id long, local_start long, n_ids long, payload binary").write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the images at ``path``.

    ``start`` counts the ids of all documents before; only one sum for each
    range goes through the driver, and their number is that of the partitions.
    """
    schema = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, local, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "local_start", "payload"))):
                reader = ImageReader(payload)
                raw = memoryview(reader.all_ids().astype("<u4").tobytes())
                begin = reader.ends - reader.lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), reader.ends.tolist())]
                yield record(schema, [part] * len(crc), reader.doc_ids, begin + local, reader.lengths, crc)

    images = spark.read.parquet(path)
    sums = images.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    base, before = [], 0
    for row in sums:
        base.append((row["part"], before))
        before += row["n"]
    bases = spark.createDataFrame(base, "part long, base long")
    found = images.select("part", "local_start", "payload").mapInArrow(lean(run), "part long, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    """``doc_id, ids`` of the documents with these ids in the images at ``path``.

    Only images whose range holds a wanted id are read, and of these only the
    blocks of those documents are decoded. A doc_id that several rows share
    gives a row for each; unknown ids and nulls give none.
    """
    own = sorted({int(w) for w in wanted if w is not None})
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                reader = ImageReader(payload)
                at = [k for k, d in enumerate(reader.doc_ids) if d is not None and (i := bisect_left(own, d)) < len(own) and own[i] == d]
                yield record(schema, [reader.doc_ids[k] for k in at], [reader.slice(int(reader.ends[k] - reader.lengths[k]), int(reader.ends[k])).tolist() for k in at])

    images = spark.read.parquet(path)
    if not own:
        return images.limit(0).mapInArrow(lean(run), "doc_id long, ids array<long>")
    spans = F.lit(False)
    for a in range(0, len(own), max(1, len(own) // 64)):
        part = own[a : a + max(1, len(own) // 64)]
        spans = spans | ((F.col("first_id") <= part[-1]) & (F.col("last_id") >= part[0]))
    return images.where(spans).select("payload").mapInArrow(lean(run), "doc_id long, ids array<long>")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the images to the shared folder and give what reading them back finds.

    One row per row of ``docs``, empty texts (only the end id) and null texts
    too; an empty table gives no rows; other columns are not read.
    """
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir), default_path())
