"""SimHash near-duplicate groups by multi-index hashing.

Two fingerprints of 64 bits that differ in at most 4 bits differ, in one of
their two halves, in at most 2 bits (first half) or in at most 1 bit (second
half), since 3 + 2 > 4. So

* in the first half both sides enumerate the ball of radius 1 (33 values):
  halves at distance 2 meet in a value between them;
* in the second half a side of even parity enumerates the ball of radius 1 and
  one of odd parity only itself: halves at distance 1 have unlike parity.

That is at most 66 table rows for each *distinct* fingerprint, linear in the
input, on keys of 32 bits, and only the matches of a key are verified in full.

Within one key no pairs are listed. A frontier search in numpy gives a spanning
forest of the true links, in O(members) memory. A key with more members than
``bucket_limit`` is not cut: its fingerprints go to a second exact index, keyed
by all values within 2 bits of the whole fingerprint. Two fingerprints are
linked exactly when they share such a value, and one value can be shared by at
most 2081 of them, so no group there is larger than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from kinweave.llm.common import documents, fresh, id_text, lean, record, text_bytes
from kinweave.operators.components import connected_components
from kinweave.sources.scratch import scratch_table

RADIUS = 4
BUCKET_LIMIT = 20_000
_FLIP32 = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(32, dtype=np.uint64)])
_BITS64 = np.uint64(1) << np.arange(64, dtype=np.uint64)
_HALF = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)


def simhash64(text: bytes, width: int = 4, seed: int = 42) -> int:
    """Unsigned fingerprint: a bit is set if more than half the shingle hashes set it.

    Words are runs without ASCII white space, A-Z lower-cased; fewer than
    ``width`` words give one shingle of all; no word gives 0.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    begin = (end - size)[: n - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(begin, end[width - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long); null text counts as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([simhash64(t, width) for t in text_bytes(batch)], np.uint64).view(np.int64)
            yield record(schema, batch.column("doc_id"), pa.array(fp))

    return id_text(docs).mapInArrow(lean(run), "doc_id long, fp long")


def _table_rows(reps: DataFrame) -> DataFrame:
    """The index: a row for each enumerated half; bit 32 of the key says which half."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("rep", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 4096):
                batch = big.slice(at, 4096)
                fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                rep = batch.column("rep").to_numpy(zero_copy_only=False)
                one, two = fp >> _HALF, fp & _LOW
                even = np.bitwise_count(two) % 2 == 0
                keys = [(one[:, None] ^ _FLIP32).ravel(), (two[even][:, None] ^ _FLIP32).ravel() | (_LOW + np.uint64(1)), two[~even] | (_LOW + np.uint64(1))]
                who = [np.repeat(np.arange(len(fp)), 33), np.repeat(np.flatnonzero(even), 33), np.flatnonzero(~even)]
                index = np.concatenate(who)
                yield record(schema, np.concatenate(keys).view(np.int64), fp[index].view(np.int64), rep[index])

    return reps.mapInArrow(lean(run), "key long, fp long, rep long")


def _forest(fp: np.ndarray, rep: np.ndarray, radius: int, src: list, dst: list) -> None:
    """Append a spanning forest of the links among distinct fingerprints."""
    left = np.arange(len(fp))
    front: list[int] = []
    while left.size:
        if front:
            i = front.pop()
        else:
            i, left = int(left[0]), left[1:]
        near = np.bitwise_count(fp[left] ^ fp[i]) <= radius
        if near.any():
            hit = left[near]
            left = left[~near]
            src.append(np.full(len(hit), rep[i]))
            dst.append(rep[hit])
            front.extend(hit.tolist())


def _match_keys(rows: DataFrame, radius: int, limit: int) -> DataFrame:
    """Links among the rows of each key, read in key order.

    Returned rows: ``src, dst`` (two representatives that are linked), or ``fp``
    and ``src`` for a member of a key with more than ``limit`` members.
    """
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("fp", pa.int64())])

    def links(fp: np.ndarray, rep: np.ndarray, cut: np.ndarray) -> pa.RecordBatch:
        size = np.diff(cut)
        two = cut[:-1][size == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        src, dst = [rep[near]], [rep[near + 1]]
        for a, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist()):
            _forest(fp[a : a + n], rep[a : a + n], radius, src, dst)
        pair = np.unique(np.stack([np.concatenate(src), np.concatenate(dst)], 1), axis=0)
        return record(schema, pair[:, 0], pair[:, 1], pa.nulls(len(pair), pa.int64()))

    def over(fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        return record(schema, rep, pa.nulls(len(rep), pa.int64()), fp.view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, rep = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
        flooded = None
        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            rep = np.concatenate([rep, batch.column("rep").to_numpy(zero_copy_only=False)])
            if flooded is not None:
                n = int(np.searchsorted(key, flooded, "right"))
                if n:
                    yield over(fp[:n], rep[:n])
                key, fp, rep = key[n:], fp[n:], rep[n:]
                if not len(key):
                    continue
                flooded = None
            edge = np.flatnonzero(key[1:] != key[:-1]) + 1
            last = int(edge[-1]) if len(edge) else 0
            if last:
                yield links(fp[:last], rep[:last], np.concatenate([[0], edge]))
            key, fp, rep = key[last:], fp[last:], rep[last:]
            if len(key) > limit:
                flooded = int(key[0])
                yield over(fp, rep)
                key, fp, rep = key[:0], fp[:0], rep[:0]
        if len(key):
            yield links(fp, rep, np.array([0, len(key)]))

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(lean(run), "src long, dst long, fp long")


def _ball_links(crowded: DataFrame) -> DataFrame:
    """Exact links of the members of crowded keys, by all values within 2 bits of a fingerprint."""
    schema = pa.schema([("near", pa.int64()), ("rep", pa.int64())])
    pairs = [_BITS64[i] | _BITS64[j] for i in range(64) for j in range(i)]
    ball = np.concatenate([np.zeros(1, np.uint64), _BITS64, np.array(pairs, np.uint64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 64):
                batch = big.slice(at, 64)
                fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                rep = batch.column("src").to_numpy(zero_copy_only=False)
                yield record(schema, (fp[:, None] ^ ball).ravel().view(np.int64), np.repeat(rep, len(ball)))

    low = F.min("rep").over(Window.partitionBy("near"))
    return crowded.select("fp", "src").distinct().mapInArrow(lean(run), "near long, rep long").select(F.col("rep").alias("src"), low.alias("dst")).where("src <> dst")


def _links(reps: DataFrame, bucket_limit: int) -> DataFrame:
    """``src, dst``: a spanning forest of the links among the representatives of all fingerprints."""
    matched = scratch_table(_match_keys(_table_rows(reps), RADIUS, bucket_limit), "simhash-links")
    edges = matched.where("fp IS NULL").select("src", "dst")
    crowded = matched.where("fp IS NOT NULL").select("fp", "src")
    return edges if crowded.isEmpty() else edges.union(_ball_links(crowded))


def links(docs: DataFrame, width: int, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``src, dst``: doc_ids whose fingerprints differ in 4 or fewer bits, a spanning forest of all such pairs.

    Of equal fingerprints every id is linked to the smallest.
    """
    found = scratch_table(fingerprints(docs, width), "simhash")
    reps = scratch_table(found.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL"), "simhash-reps")
    same = found.join(reps, "fp").where("doc_id <> rep").select(F.col("rep").alias("src"), F.col("doc_id").alias("dst"))
    return _links(reps, bucket_limit).union(same)


def near_duplicates(docs: DataFrame, width: int = 4, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    component_id is the smallest doc_id reachable over links between
    fingerprints at 4 or fewer differing bits, the row itself included.

    Null text counts as empty; the empty text has fingerprint 0, linked like any
    other. A row with null doc_id takes the component of its own fingerprint if
    another row has that fingerprint, else null, and links nothing. Repeated
    rows are returned as often as they come. An empty table gives no rows; other
    columns are not read. Copies are reduced to one representative for each
    fingerprint by a partial aggregate before anything is shuffled.
    """
    found = scratch_table(fingerprints(docs, width), "simhash")
    reps = scratch_table(found.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL"), "simhash-reps")
    roots = connected_components(_links(reps, bucket_limit))
    label = reps.join(roots, reps.rep == roots.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return found.join(label, "fp", "left").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The row of each near-duplicate group with the smallest doc_id, with all its columns.

    Rows that share a doc_id stay or go together: they go if any of them is in a
    group with a smaller id. Rows without an id stay.
    """
    groups = near_duplicates(docs)
    gone = fresh(docs, "_gone")
    drop = groups.where("doc_id IS NOT NULL AND doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(drop, F.col("doc_id").cast("long") == F.col(gone), "left_anti").select(*docs.columns)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
