"""Exact deduplication through a cuckoo-filter index of live digests.

An index shard is a cuckoo filter (four slots a bucket, short fingerprints)
beside the stored keys of the same buckets. A filter miss proves a digest new,
so it's inserted without a look at the keys; a hit is verified against the
bucketed content, since a filter may err that way. Deletion removes a digest
from filter and bucket. A chain of evictions that doesn't end makes the filter
double, rebuilt from the stored keys.

In the batch query every task indexes what it reads first, so one row for each
distinct text of a task is shuffled and a text held by a third of all rows
arrives as one row a task; the second level indexes those rows by shard, with
as many shards as the number of rows asks for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinweave.llm.common import SPACE, documents, fresh, id_text, lean, record, text_bytes
from kinweave.sources.scratch import scratch_table

SLOTS = 4
MAX_KICKS = 200
#: Distinct texts that a first-level index holds before it's written out.
FLUSH = 200_000
#: Rows that a shard of the second level is meant for; the number of shards follows from the number of rows.
SHARD_ROWS = 200_000


class CuckooIndex:
    """Live digests with a value each: ``find``, ``insert``, ``delete``.

    Keys are bytes of a strong digest of at least 16 bytes. The filter's
    fingerprint and bucket number come from different bytes of it.
    """

    def __init__(self, buckets: int = 1 << 10, fingerprint_bits: int = 16):
        if buckets < 2 or buckets & (buckets - 1):
            raise ValueError("buckets must be a power of two, 2 at least")
        self.mask, self.fp_mask = buckets - 1, (1 << fingerprint_bits) - 1
        self.filter: list[list[int]] = [[] for _ in range(buckets)]
        self.content: dict[int, dict[bytes, object]] = {}
        self.live = self.resizes = self.probes = self.false_hits = 0

    def _spots(self, key: bytes) -> tuple[int, int, int]:
        fp = (int.from_bytes(key[:4], "little") & self.fp_mask) or 1
        home = int.from_bytes(key[4:12], "little")
        return fp, home, home & self.mask

    def _other(self, bucket: int, fp: int) -> int:
        return (bucket ^ (fp * 0x5BD1E995)) & self.mask

    def find(self, key: bytes):
        """The value stored with a live digest, else None."""
        fp, home, a = self._spots(key)
        if fp not in self.filter[a] and fp not in self.filter[self._other(a, fp)]:
            return None
        self.probes += 1
        value = self.content.get(home, {}).get(key)
        self.false_hits += value is None
        return value

    def insert(self, key: bytes, value) -> bool:
        """Store a digest; False if it was live, whose value is replaced."""
        known = self.find(key) is not None
        fp, home, a = self._spots(key)
        self.content.setdefault(home, {})[key] = value
        if not known:
            self.live += 1
            if not self._place(a, fp):
                self._grow()
        return not known

    def _place(self, bucket: int, fp: int) -> bool:
        for spot in (bucket, self._other(bucket, fp)):
            if len(self.filter[spot]) < SLOTS:
                self.filter[spot].append(fp)
                return True
        for kick in range(MAX_KICKS):
            row = self.filter[bucket]
            row[kick % SLOTS], fp = fp, row[kick % SLOTS]
            bucket = self._other(bucket, fp)
            if len(self.filter[bucket]) < SLOTS:
                self.filter[bucket].append(fp)
                return True
        return False

    def _grow(self) -> None:
        """Double the filter until every stored key has a place."""
        placed = False
        while not placed:
            self.resizes += 1
            self.mask = 2 * self.mask + 1
            self.filter = [[] for _ in range(self.mask + 1)]
            placed = all(self._place(home & self.mask, self._spots(key)[0]) for home, keys in self.content.items() for key in keys)

    def delete(self, key: bytes) -> bool:
        """Remove a live digest; False if it isn't live, and nothing changes."""
        if self.find(key) is None:
            return False
        fp, home, a = self._spots(key)
        spot = a if fp in self.filter[a] else self._other(a, fp)
        self.filter[spot].remove(fp)
        self.content[home].pop(key)
        if not self.content[home]:
            self.content.pop(home)
        self.live -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        for keys in self.content.values():
            yield from keys.items()


def normalised(text: bytes) -> bytes:
    """The text without ASCII white space."""
    return text.translate(None, SPACE)


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, n_points``: SHA-256 of the normalised text, code points of the original."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_points", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch)
            points = [len(t) if t.isascii() else len(t.decode("utf-8", "replace")) for t in texts]
            yield record(schema, batch.column("doc_id"), [hashlib.sha256(normalised(t)).digest() for t in texts], points)

    return id_text(docs).mapInArrow(lean(run), "doc_id long, digest binary, n_points long")


def _better(a: tuple, b: tuple) -> tuple:
    """The entry whose row stays: most code points, then smallest doc_id, null last."""
    return min(a, b, key=lambda x: (-x[0], x[1] is None, x[1] or 0))


_ENTRY = pa.schema([("digest", pa.binary()), ("n_points", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _entries(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    """What an index holds, in small batches."""
    items = index.items()
    while part := list(islice(items, 10_000)):
        yield record(_ENTRY, [k for k, _ in part], *([v[i] for _, v in part] for i in range(3)))


def _sharded(rows: DataFrame, number: int) -> DataFrame:
    """Rows dealt by digest to as many shards as hold about ``SHARD_ROWS`` of ``number`` rows, at least the session's partitions.

    The number is given, so that adaptive execution doesn't put shards together.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-number // SHARD_ROWS)), "digest")


def _index(rows: DataFrame, flush: int | None) -> DataFrame:
    """One row for each live digest of a task (or of each ``flush`` of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for key, points, doc, n in zip(*(batch.column(c).to_pylist() for c in ("digest", "n_points", "keep_id", "group_size"))):
                seen = index.find(key)
                if seen is not None:
                    points, doc = _better(seen[:2], (points, doc))
                    n += seen[2]
                index.insert(key, (points, doc, n))
            if flush and index.live >= flush:
                yield from _entries(index)
                index = CuckooIndex()
        yield from _entries(index)

    return rows.mapInArrow(lean(run), "digest binary, n_points long, keep_id long, group_size long")


def exact_groups(found: DataFrame) -> DataFrame:
    """``digest, n_points, keep_id, group_size`` from :func:`digests`."""
    first = _index(found.select("digest", "n_points", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")), FLUSH)
    return _index(_sharded(first, found.count()), None)


def apply_changes(live: DataFrame, changes: DataFrame) -> DataFrame:
    """An index after inserts and deletes, as ``digest, n_points, keep_id, group_size``.

    ``live`` is what :func:`exact_groups` gave; ``changes`` has ``seq long, op
    string ('insert' or 'delete'), digest, n_points, keep_id``. In order of seq
    an insert of a live digest adds a row to its group, and a delete takes the
    digest out of the index. Deletes of unknown digests change nothing; rows
    with a null digest or op are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for op, key, points, doc, n in zip(*(batch.column(c).to_pylist() for c in ("op", "digest", "n_points", "keep_id", "group_size"))):
                if op == "delete":
                    index.delete(key)
                elif op == "insert":
                    seen = index.find(key)
                    if seen is not None:
                        points, doc = _better(seen[:2], (points, doc))
                        n += seen[2]
                    index.insert(key, (points, doc, n))
        yield from _entries(index)

    old = live.select(F.lit(None).cast("long").alias("seq"), F.lit("insert").alias("op"), "digest", "n_points", "keep_id", "group_size")
    new = changes.select("seq", "op", "digest", "n_points", "keep_id", F.lit(1).cast("long").alias("group_size"))
    rows = old.unionByName(new).where("digest IS NOT NULL AND op IS NOT NULL")
    return _sharded(rows, rows.count()).sortWithinPartitions(F.col("seq").asc_nulls_first()).mapInArrow(lean(run), "digest binary, n_points long, keep_id long, group_size long")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, n_points, keep_id, group_size, kept`` for every row.

    Texts are equal when identical without ASCII white space; of equal texts the
    row with the most code points, then the smallest doc_id, stays. Null text
    counts as empty. Null doc_ids come after all others; a group of only such
    rows has a null keep_id and keeps them. Rows repeated with the same doc_id
    and length all count as kept. An empty table gives no rows.
    """
    found = scratch_table(digests(docs), "digests")
    groups = exact_groups(found).withColumnRenamed("n_points", "keep_points")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
    return found.join(groups, "digest").select("doc_id", "digest", "n_points", "keep_id", "group_size", kept.alias("kept"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, one for each text, with all their columns.

    Rows repeated with the same id and length of text leave one. The rows that
    go, the smaller side as a rule, are known by id, digest and length; the
    digest is made again beside the text. Only if such a key stands for several
    rows that stay are those reduced to one by a further step.
    """
    names = docs.columns
    digest, points = fresh(docs, "_digest"), fresh(docs, "_points")
    other_id, other_digest, other_points = fresh(docs, "_id"), fresh(docs, "_other"), fresh(docs, "_n")
    rated = scratch_table(exact_duplicates(docs), "rated")
    drop = rated.where("NOT kept").select(F.col("doc_id").alias(other_id), F.col("digest").alias(other_digest), F.col("n_points").alias(other_points)).distinct()
    several = rated.where("kept AND group_size > 1").groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.translate(text, SPACE.decode(), "")
    keyed = docs.select(*names, F.unhex(F.sha2(bare.cast("binary"), 256)).alias(digest), F.char_length(text).cast("long").alias(points))
    gone = F.col("doc_id").cast("long").eqNullSafe(F.col(other_id)) & (F.col(digest) == F.col(other_digest)) & (F.col(points) == F.col(other_points))
    stay = keyed.join(drop, gone, "left_anti")
    if not several.isEmpty():
        stay = stay.dropDuplicates([digest])
    return stay.select(*names)


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = exact_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
