"""Near-duplicate groups by the Jaccard similarity of shingle sets.

Two texts are linked when their sets of ``WIDTH``-word shingles have a Jaccard
similarity of ``SIMILARITY`` or more. Candidates come from MinHash: ``BANDS``
keys of ``ROWS`` minima each, so a pair at similarity s shares a key with a
chance of 1 - (1 - s ** ROWS) ** BANDS, which is 0.9999998 at 0.8. Every link is
verified on the whole sets.

Within a key no pairs are listed at first: each member is verified against the
key's smallest set, and components of these links are formed. Only members of a
key that are still in unlike components are then compared, first by their
sketches (a byte of each minimum), of which pairs over 5 standard deviations
below the threshold are passed over, then on the sets. That goes in rounds: a
member's ``BEST`` most alike partners are verified and components formed again,
which joins most of a large group. The last round verifies every pair that's
still apart, each in the first of the keys that it shares. There a key's members
are cut into blocks of bounded size, and the sets go to pairs of blocks and not
to pairs of members, so a set is moved once for many comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from kinweave.llm import words
from kinweave.llm.common import fresh, id_text, lean, record
from kinweave.operators.components import connected_components
from kinweave.sources.scratch import scratch_table

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 5
#: Partners of a member that the rounds before the last verify.
BEST = (2, 8)
#: Members of a block, and their shingles.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_A, _B = (words.mix(np.arange(k, BANDS * ROWS + k, dtype=np.uint64) * _STEP) | np.uint64(1) for k in (1, 1 << 20))


def shingles(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, in order.

    Words are runs without ASCII white space, A-Z lower-cased; fewer than
    ``width`` words give one shingle of all; no word gives none.
    """
    out = []
    for _, part in words.chunks(texts):
        h, size = words.hashed(part)
        end = np.cumsum(size)
        key = np.zeros(len(h), np.uint64)
        left = np.repeat(end, size) - np.arange(len(h))
        with np.errstate(over="ignore"):
            for k in range(width):
                inside = np.flatnonzero(left > k)
                key[inside] = words.mix(key[inside] * _STEP + h[inside + k])
        for a, b in zip((end - size).tolist(), end.tolist()):
            out.append(np.unique(key[a : max(a + 1, b - width + 1)]) if b > a else key[:0])
    return out


def minima(own: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for at in range(0, len(own), 512):
            out = np.minimum(out, (own[at : at + 512] * _A[:, None] + _B[:, None]).min(axis=1))
    return out


def _keys(low: np.ndarray) -> np.ndarray:
    low = low.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = words.mix(key * _STEP + low[:, k])
    return key


def _signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (a hash of the whole set) ``, sketch, keys``."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("sketch", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, sketch, keys = [], [], []
            for own in shingles(batch.column("text")):
                low = minima(own)
                fp.append(_fp(own))
                sketch.append(words.mix(low).astype(np.uint8).tobytes())
                keys.append(_keys(low).view(np.int64) if len(own) else [])
            yield record(schema, batch.column("doc_id"), fp, sketch, keys)

    return docs.mapInArrow(lean(run), "doc_id long, fp long, sketch binary, keys array<long>")


def _fp(own: np.ndarray) -> int:
    x = xxhash.xxh64_intdigest(own.astype("<u8").tobytes())
    return x - (1 << 64) if x >> 63 else x


def _sets(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("fp", pa.int64()), ("own", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = shingles(batch.column("text"))
            yield record(schema, [_fp(x) for x in own], [x.astype("<u8").tobytes() for x in own])

    return docs.select("text").mapInArrow(lean(run), "fp long, own binary")


def _similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sets of distinct hashes have this Jaccard similarity or more."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]))
    n = int((both[1:] == both[:-1]).sum())
    return n >= similarity * (len(x) + len(y) - n)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``src, dst`` whose whole sets are similar enough."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b")):
                keep.append(_similar(np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8"), similarity))
            yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_())).cast(schema)

    left, right = (sets.select(F.col("fp").alias(end), F.col("own").alias(name)) for end, name in (("src", "a"), ("dst", "b")))
    return pairs.join(right, "dst").join(left, "src").select("src", "dst", "a", "b").mapInArrow(lean(run), "src long, dst long")


class _Members:
    """The members of a key: those of the largest component last, since they're only compared with the others."""

    def __init__(self, fp: np.ndarray, component: np.ndarray, size: np.ndarray, sketch: np.ndarray, keys: np.ndarray, similarity: float):
        _, own, many = np.unique(component, return_inverse=True, return_counts=True)
        order = np.argsort(many[own], kind="stable")
        self.fp, self.own, self.size, self.sketch, self.keys = (x[order] for x in (fp, own, size, sketch, keys))
        self.lone, self.similarity = len(fp) - int(many.max(initial=0)), similarity
        chance = similarity + (1 - similarity) / 256
        self.least = BANDS * ROWS * chance - 5 * (BANDS * ROWS * chance * (1 - chance)) ** 0.5

    def partners(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Members after i that may be linked to it and aren't in its component, and how many minima agree."""
        other = np.flatnonzero(self.own[i + 1 :] != self.own[i]) + i + 1
        low, high = np.minimum(self.size[other], self.size[i]), np.maximum(self.size[other], self.size[i])
        other = other[low >= self.similarity * high]
        found, alike = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(other), 1 << 14):
            part = other[at : at + (1 << 14)]
            n = (self.sketch[part] == self.sketch[i]).sum(axis=1)
            found.append(part[n >= self.least])
            alike.append(n[n >= self.least])
        return np.concatenate(found), np.concatenate(alike)


def _by_key(rows: DataFrame, each, ddl: str) -> DataFrame:
    """``each(key, members)`` for all members of each key, read in key order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain_end(batches):
            if batch is not None:
                now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "component", "size")]
                now.append(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS))
                now.append(batch.column("keys").flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS))
                held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if held is None:
                continue
            edge = (np.flatnonzero(held[0][1:] != held[0][:-1]) + 1).tolist()
            cut = [0, *edge] if batch is not None else [0, *edge, len(held[0])]
            for a, b in zip(cut, cut[1:]):
                yield from each(int(held[0][a]), [x[a:b] for x in held[1:]])
            held = [x[cut[-1] :] for x in held]

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(lean(run), ddl)


def _best(rows: DataFrame, similarity: float, best: int) -> DataFrame:
    """Pairs of a key's members in unlike components: for each member its ``best`` most alike partners."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def each(key: int, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        own = _Members(*columns, similarity)
        for i in range(own.lone):
            part, alike = own.partners(i)
            part = part[np.argsort(-alike, kind="stable")[:best]]
            if len(part):
                yield record(schema, np.minimum(own.fp[part], own.fp[i]), np.maximum(own.fp[part], own.fp[i]))

    return _by_key(rows, each, "src long, dst long").distinct()


def _all_apart(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Verified links among all of a key's members in unlike components."""
    schema = pa.schema([("block", pa.int64()), ("fp", pa.int64()), ("place", pa.int32()), ("asked", pa.binary())])

    def each(key: int, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        own = _Members(*columns, similarity)
        if not own.lone:
            return
        block = np.arange(len(own.fp)) // BLOCK + np.cumsum(own.size) // BLOCK_SHINGLES
        asked: dict[tuple[int, int], list[np.ndarray]] = {}
        for i in range(own.lone):
            part, _ = own.partners(i)
            shared = own.keys[part] == own.keys[i]
            part = part[own.keys[i][shared.argmax(axis=1)] == key] if len(part) else part
            for other in np.unique(block[part]).tolist():
                to = part[block[part] == other]
                asked.setdefault((int(block[i]), other), []).append(np.stack([np.full(len(to), i), to], 1))
        for (x, y), pairs in asked.items():
            used, place = np.unique(np.concatenate(pairs), return_inverse=True)
            number = xxhash.xxh64_intdigest(np.array([key, x, y], "<i8").tobytes()) >> 1
            said = [place.reshape(-1, 2).astype("<u2").tobytes(), *[None] * (len(used) - 1)]
            yield record(schema, [number] * len(used), own.fp[used], list(range(len(used))), said)

    def verify(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        fp, own = rows["fp"].to_numpy(), [np.frombuffer(b, "<u8") for b in rows["own"]]
        pairs = np.frombuffer(rows["asked"].iloc[0], "<u2").reshape(-1, 2)
        pairs = pairs[[_similar(own[a], own[b], similarity) for a, b in pairs.tolist()]]
        return pd.DataFrame({"src": np.minimum(fp[pairs[:, 0]], fp[pairs[:, 1]]), "dst": np.maximum(fp[pairs[:, 0]], fp[pairs[:, 1]])})

    blocks = scratch_table(_by_key(rows, each, "block long, fp long, place int, asked binary"), "minhash-blocks")
    return blocks.join(sets, "fp").groupBy("block").applyInPandas(verify, "src long, dst long").distinct()


def chain_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches that have rows, then None."""
    yield from (b for b in batches if b.num_rows)
    yield None


def _asked(more: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs of unlike sets behind pairs of doc_ids; empty texts have no set to compare."""
    known = found.where(F.size("keys") > 0)
    a, b = (known.select(F.col("doc_id").alias(end), F.col("fp").alias(f"_{end}")) for end in ("src", "dst"))
    pairs = more.select("src", "dst").join(a, "src").join(b, "dst").where("_src <> _dst")
    return pairs.select(F.least("_src", "_dst").alias("src"), F.greatest("_src", "_dst").alias("dst")).distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, more: DataFrame | None = None) -> DataFrame:
    """``doc_id, component_id`` for every row of ``docs`` that has a doc_id.

    ``more`` has further candidates, ``src, dst`` as doc_ids (from another index);
    they are verified in the same way and linked before MinHash compares the rest.

    component_id is the smallest doc_id reachable over links between texts whose
    sets have a Jaccard similarity of ``similarity`` or more. Texts with equal
    sets are one node, known by a hash of 64 bits; null text counts as empty,
    and empty texts are one group. Rows without an id link nothing. Repeated
    rows are returned as often as they come; other columns are not read.
    """
    source = id_text(docs).where("doc_id IS NOT NULL")
    found = scratch_table(_signatures(source), "minhash")
    nodes = found.groupBy("fp").agg(F.min_by("keys", "doc_id").alias("keys"), F.min("doc_id").alias("low"))
    rows = scratch_table(nodes.select("fp", F.explode("keys").alias("key")), "minhash-keys")
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("first")).where("n > 1").drop("n")
    members = scratch_table(rows.join(shared, "key"), "minhash-members")
    asked = found.sparkSession.createDataFrame([], "src long, dst long") if more is None else scratch_table(_asked(more, found), "minhash-asked")
    active = members.select("fp").union(asked.select("src")).union(asked.select("dst")).distinct()
    wanted = found.join(active, "fp", "left_semi").select("doc_id").distinct()
    sets = _sets(source.join(wanted, "doc_id", "left_semi")).groupBy("fp").agg(F.first("own").alias("own"))
    sets = scratch_table(sets, "minhash-sets")
    star = members.where("fp <> first").select(F.col("first").alias("src"), F.col("fp").alias("dst")).union(asked).distinct()
    links = scratch_table(_verified(star, sets, similarity), "minhash-links")
    about = found.join(active, "fp", "left_semi").groupBy("fp").agg(F.first(F.struct("sketch", "keys")).alias("x")).select("fp", "x.*")
    about = scratch_table(about.join(sets.select("fp", (F.octet_length("own") / 8).cast("long").alias("size")), "fp"), "minhash-about")
    tested, roots = star, scratch_table(connected_components(links), "minhash-roots")

    def apart() -> DataFrame:
        """Members of the keys that hold more than one component."""
        placed = scratch_table(members.join(roots, members.fp == roots.node, "left").select("key", "fp", F.coalesce("component", "fp").alias("component")), "minhash-placed")
        mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
        return placed.join(mixed, "key", "left_semi").join(about, "fp").select("key", "fp", "component", "size", "sketch", "keys")

    for best in BEST:
        pairs = scratch_table(_best(apart(), similarity, best).join(tested, ["src", "dst"], "left_anti"), "minhash-pairs")
        links, tested = links.union(scratch_table(_verified(pairs, sets, similarity), "minhash-links")), tested.union(pairs)
        roots = scratch_table(connected_components(links), "minhash-roots")
    links = links.union(scratch_table(_all_apart(apart(), sets, similarity), "minhash-links"))
    roots = connected_components(links)
    nodes = found.select("doc_id", "fp").join(roots, F.col("fp") == F.col("node"), "left").select("doc_id", F.coalesce("component", "fp").alias("component"))
    nodes = scratch_table(nodes, "minhash-nodes")
    return nodes.join(nodes.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """The row of each near-duplicate group with the smallest doc_id, with all its columns.

    Rows that share a doc_id stay or go together: they go if any of them is in a
    group with a smaller id. Rows without an id stay.
    """
    gone = fresh(docs, "_gone")
    drop = near_duplicates(docs, more=more).where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(drop, F.col("doc_id").cast("long") == F.col(gone), "left_anti").select(*docs.columns)
