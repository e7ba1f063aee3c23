"""Hierarchical packing of documents into windows of several lengths.

Documents are dealt to shards by a hash of their id, each shard small enough for
one task. Within a shard

1. a document's full windows of the longest tier become sequences of their own,
   and what is left is routed to the shortest tier that holds it;
2. tiers are packed from the longest down: a window opens with the longest
   document left in its tier, its gap is filled with the longest documents that
   fit, from this tier and then from shorter ones, and when nothing fits the
   shortest document left is cut so that the window is full;
3. what remains at the end is less than one window: it's laid out in sequences
   whose lengths are powers of two, which need no padding;
4. sequences are dealt to step groups, longest first, always to the group with
   the fewest tokens, so that the groups of a shard are level.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from kinweave.llm.bytebpe import byte_bpe, default_path
from kinweave.llm.common import documents, id_text, lean, record, text_bytes, trim

TIERS = (256, 512, 1024, 2048)
#: Bytes of text that a shard is meant to hold, and sequences of a step group.
SHARD_BYTES = 8 << 20
STEP = 32
#: Equal rows of a task that may go to one shard.
COPIES = 64


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document, start, length), for the lengths of documents.

    Every token lies in exactly one piece; a sequence's length is a power of two
    that is at most the longest tier. Documents of length 0 have no piece.
    """
    top = tiers[-1]
    out: list[list[tuple[int, int, int]]] = []
    pools: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # (length, document, start), ascending

    def route(doc: int, start: int, length: int) -> None:
        insort(pools[next(k for k, t in enumerate(tiers) if length <= t)], (length, doc, start))

    rest = []
    for doc, n in enumerate(lengths):
        full = n - n % top
        out += [[(doc, at, top)] for at in range(0, full, top)]
        if n % top:
            rest.append((n % top, doc, full))
    for length, doc, start in sorted(rest):
        pools[next(k for k, t in enumerate(tiers) if length <= t)].append((length, doc, start))
    left = [sum(x[0] for x in p) for p in pools]
    for k in range(len(tiers) - 1, -1, -1):
        while pools[k]:
            # the windows of a tier that can't be filled from it and shorter ones end in powers of two
            have = sum(left[: k + 1])
            window = tiers[k] if have >= tiers[k] else 1 << (have.bit_length() - 1)
            pieces, gap = [], window
            while gap:
                found = None
                for j in range(k, -1, -1):
                    at = bisect_right(pools[j], (gap, float("inf"), 0))
                    if at:
                        found = j, at - 1
                        break
                if found:
                    j, at = found
                    length, doc, start = pools[j].pop(at)
                    left[j] -= length
                    pieces.append((doc, start, length))
                    gap -= length
                else:
                    j = next(j for j in range(k + 1) if pools[j])
                    length, doc, start = pools[j].pop(0)
                    left[j] -= length
                    pieces.append((doc, start, gap))
                    route(doc, start + gap, length - gap)
                    left[next(i for i, t in enumerate(tiers) if length - gap <= t)] += length - gap
                    gap = 0
            out.append(pieces)
    return out


def step_groups(sizes: list[int], step: int = STEP) -> list[int]:
    """A step group for each sequence: longest first to the group with the fewest tokens."""
    groups = [(0, g) for g in range(max(1, -(-len(sizes) // step)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        total, g = heapq.heappop(groups)
        out[i] = g
        heapq.heappush(groups, (total + sizes[i], g))
    return out


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``doc_id, ids`` with the end id; ids as little-endian bytes, and their bytes a token.

    ``salt`` tells rows of a task apart that have the same id, or none, and the
    same text: it goes up with every ``COPIES`` of them. It depends on how often
    such a row comes and not on the order, so a task that's run again agrees.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("item", pa.int32()), ("salt", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        task = TaskContext.get().partitionId() << 32
        seen: dict[int, int] = {}
        for batch in batches:
            ids, salt = [], []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), text_bytes(batch)):
                ids.append(encoder.ids(raw.decode("utf-8", "replace")) + end)
                key = hash((doc, xxhash.xxh64_intdigest(raw)))
                n = seen[key] = seen.get(key, -1) + 1
                salt.append(task + n // COPIES if n >= COPIES else 0)
            yield record(schema, batch.column("doc_id"), ids, [encoder.dtype.itemsize] * len(ids), salt)

    return id_text(docs).mapInArrow(lean(run), "doc_id long, ids binary, item int, salt long")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_group long"


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row for each piece, in the columns of ``PIECES``.

    Every document, the end id included, is covered by its pieces without gap or
    overlap; ``offset`` is gapless from 0 in a sequence; ``window`` is the padded
    length of the sequence. Null text counts as empty (one token, the end id).
    Rows repeated or with a null doc_id are packed like any other. An empty
    table gives no rows; other columns are not read.
    """
    volume = docs.select(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    shards = max(1, -(-volume // shard_bytes))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        (shard,) = key
        rows = rows.sort_values(["doc_id", "ids"], kind="stable", na_position="first")
        who = [None if pd.isna(d) else int(d) for d in rows["doc_id"]]
        ids = [np.frombuffer(b, f"<u{i}").astype("<u4") for b, i in zip(rows["ids"], rows["item"])]
        sequences = pack([len(x) for x in ids], tiers)
        groups = step_groups([sum(p[2] for p in s) for s in sequences])
        out = []
        for s, (pieces, group) in enumerate(zip(sequences, groups)):
            offset, window = 0, sum(p[2] for p in pieces)
            for doc, start, length in pieces:
                out.append((who[doc], start, length, zlib.crc32(ids[doc][start : start + length].tobytes()), len(ids[doc]), (int(shard) << 32) + s, offset, window, (int(shard) << 32) + group))
                offset += length
        names = [c.split()[0] for c in PIECES.split(", ")]
        trim()
        return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    shard = F.pmod(F.xxhash64("doc_id", F.crc32("ids"), "salt"), F.lit(shards))
    return encoded(docs, tokenizer, end_id).groupBy(shard.alias("shard")).applyInPandas(run, PIECES)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), default_path())
