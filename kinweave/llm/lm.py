"""Language-model scores from a log-frequency Bloom filter.

Counting. Each task sums the n-grams of what it reads in numpy and sends one
packed row for each slice of the hash space, so the engine moves a few byte
strings and no row for each n-gram. A slice is a range of hashes; its task
merges its share exactly.

Filter. A count c has the level 1 + floor(log2 c); an n-gram is stored once for
each of its levels, so a reader probes level after level until the first miss
and has the quantised count (Talbot and Osborne, 2007). All bits of an n-gram
and level lie in one 64-bit word. Each slice of the filter has a word for every
``LOAD`` entries, so no level is left out however large the corpus is.

Probing. A filter that holds every level grows with the corpus, so it can't be
broadcast under a proven bound. It stays where it was built: the distinct
n-grams of a batch of documents go to the slices that hold them, as packed and
sorted differences of a few bytes, and their levels come back to the batch. All
sizes take this one path. Beyond ``FAN`` slices a packed row for each slice would
be hardly more than an n-gram, so rows then pass through coarse slices, where
those of many tasks are put together before they're cut finely.

Model. P(w | v) = (c(v w) + MU * P0(w)) / (c(v) + MU) over the filter's counts,
with P0 the add-0.1 unigram estimate from the filter. Each c is the middle of
its level, so the P of all words after v don't sum to 1 exactly: the score is
that of an unnormalised model, as with any quantised counts.

Base. Unigram counts in the base score are exact; they come back with the
levels. Words are known by a hash of 64 bits and pairs by one of 48, whose
collisions are far rarer than the filter's false hits.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from kinweave.llm import words
from kinweave.llm.common import documents, id_text, lean, record, trim
from kinweave.sources.scratch import scratch_table

LOAD, BITS = 8, 4
MU = 4.0
ALPHA = 0.1
#: Bytes of text that a slice is meant for, distinct n-grams that a counting task holds, tokens of documents scored together.
SLICE_BYTES, HELD, BATCH = 16 << 20, 3 << 20, 3 << 19
#: Slices that packed rows are cut into at once.
FAN = 4096
_BEGIN, _END = np.array([0x243F6A8885A308D3, 0x13198A2E03707344], np.uint64)
_ONE = np.uint64(1)
_16, _32 = np.uint64(16), np.uint64(32)


def held_out(doc_id: str = "doc_id"):
    """Rows that nothing is learnt from: crc32 of the id as text, modulo 10, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(10)) == 0, F.lit(False))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text's end included, and the tokens of each."""
    flat, size = words.hashed(texts)
    out = np.full(len(flat) + len(size), _END)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(size + 1) - 1] = False
    out[inner] = flat
    return out, size + 1


def _bigrams(tokens: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (48 bits) of the word pairs that end at each token, and the token before each."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(size) - size] = _BEGIN
    return words.pair(before, tokens) >> _16, before


def _summed(h: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order and their counts."""
    if not len(h):
        return h, np.zeros(0, np.int64)
    if n is None:
        h = np.sort(h)
    else:
        order = np.argsort(h)
        h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.diff(np.append(first, len(h))) if n is None else np.add.reduceat(n, first)


def _slice_of(top: np.ndarray, slices: int) -> np.ndarray:
    """The slice of each hash, from its highest 32 bits; in the order of the hashes."""
    return (top * np.uint64(slices) >> _32).astype(np.int64)


def _edges(where: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of the runs of equal values."""
    cut = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else np.zeros(0, np.int64)
    return list(zip(cut.tolist(), np.append(cut[1:], len(where)).tolist()))


def _spans(where: np.ndarray) -> dict[int, tuple[int, int]]:
    return {int(where[a]): (a, b) for a, b in _edges(where)}


def _pack(n: np.ndarray) -> bytes:
    """Numbers in the fewest bytes that hold the largest, the bytes of a place together and compressed."""
    width = max(1, -(-int(n.max(initial=0)).bit_length() // 8))
    planes = n.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : blob[0]] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


def _pack_sorted(h: np.ndarray) -> bytes:
    """Hashes in ascending order by their differences."""
    return struct.pack("<Q", int(h[0])) + _pack(np.diff(h)) if len(h) else b""


def _unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    steps = np.concatenate([np.frombuffer(blob, "<u8", 1), _unpack(blob[8:]).view(np.uint64)])
    return np.cumsum(steps, dtype=np.uint64)


_COUNTS = pa.schema([("slice", pa.int64()), ("kind", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
_COUNTS_DDL = "slice long, kind int, hashes binary, counts binary"


def _top(h: np.ndarray, kind: int) -> np.ndarray:
    return h >> (_32 if kind == 1 else _16)


def _by_slice(kind: int, h: np.ndarray, n: np.ndarray, slices: int) -> Iterator[pa.RecordBatch]:
    """Packed rows of words (kind 1) or pairs (kind 2), one for each slice that has a part."""
    where = _slice_of(_top(h, kind), slices)
    spans = _edges(where)
    for at in range(0, len(spans), 64):
        part = spans[at : at + 64]
        yield record(_COUNTS, [int(where[a]) for a, _ in part], [kind] * len(part), [_pack_sorted(h[a:b]) for a, b in part], [_pack(n[a:b]) for a, b in part])


class _Sums:
    """Counts of one kind that a task holds."""

    def __init__(self, kind: int, slices: int):
        self.kind, self.slices, self.parts, self.held = kind, slices, [], 0

    def add(self, h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((h, n))
        self.held += len(h)
        if self.held >= HELD:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            parts, self.parts, self.held = self.parts, [], 0
            yield from _by_slice(self.kind, *_summed(*(np.concatenate(x) for x in zip(*parts))), self.slices)


def _refined(rows: DataFrame, slices: int) -> DataFrame:
    """Rows by coarse slice cut into fine ones, those of many tasks put together first."""
    coarse = rows.withColumn("salt", F.pmod(F.xxhash64("hashes"), F.lit(64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: _Sums(k, slices) for k in (1, 2)}
        for batch in batches:
            for kind, hb, nb in zip(*(batch.column(c).to_pylist() for c in ("kind", "hashes", "counts"))):
                yield from sums[kind].add(_unpack_sorted(hb), _unpack(nb))
        for s in sums.values():
            yield from s.end()

    return coarse.repartition("slice", "salt").sortWithinPartitions("slice").drop("salt").mapInArrow(lean(run), _COUNTS_DDL)


def _count(train: DataFrame, slices: int) -> DataFrame:
    """Partial counts of words and pairs, packed by slice."""
    coarse = min(slices, FAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _Sums(1, coarse), _Sums(2, coarse)
        for batch in batches:
            for _, part in words.chunks(batch.column("text")):
                h, size = _tokens(part)
                yield from one.add(*_summed(h))
                yield from two.add(*_summed(_bigrams(h, size)[0]))
        yield from one.end()
        yield from two.end()

    rows = train.select("text").mapInArrow(lean(run), _COUNTS_DDL)
    return rows if coarse == slices else _refined(rows, slices)


def _spot(h: np.ndarray, level: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The word in its slice and the bits of each n-gram and level."""
    with np.errstate(over="ignore"):
        x = words.mix(h + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    mask = np.zeros(len(x), np.uint64)
    for k in range(BITS):
        mask |= _ONE << ((x >> np.uint64(6 * k)) & np.uint64(63))
    return ((x >> _32) * np.uint64(width) >> _32).astype(np.int64), mask


def _levels(n: np.ndarray) -> np.ndarray:
    return np.frexp(n.astype(np.float64))[1].astype(np.int64)


def build_slice(h: np.ndarray, n: np.ndarray, load: float = LOAD) -> bytes:
    """The words of a filter that stores every level of each n-gram."""
    level = _levels(n)
    out = np.zeros(max(64, int(-(-int(level.sum()) // load))), np.uint64)
    for j in range(1, int(level.max(initial=0)) + 1):
        own = h[level >= j]
        at, mask = _spot(own, np.full(len(own), j), len(out))
        np.bitwise_or.at(out, at, mask)
    return out.astype("<u8").tobytes()


def probed(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The level of each n-gram: the last hit before the first miss, 0 if the first is a miss."""
    found, level = np.zeros(len(h), np.int64), np.ones(len(h), np.int64)
    live = np.arange(len(h))
    while len(live):
        at, mask = _spot(h[live], level[live], len(table))
        live = live[(table[at] & mask) == mask]
        found[live] = level[live]
        level[live] += 1
        live = live[level[live] < 63]
    return found


def _middle(level: np.ndarray) -> np.ndarray:
    """The middle of the counts at a level, 0 at level 0."""
    return np.where(level > 0, np.where(level == 1, 1.0, 1.5 * 2.0 ** (level - 1.0)), 0.0)


def learn(train: DataFrame, slices: int) -> DataFrame:
    """``slice, hashes, counts, n_types, n_tokens, words``: exact word counts and the filter, a row for each slice."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        both = []
        for kind in (1, 2):
            own = rows[rows["kind"] == kind]
            both.append(_summed(np.concatenate([np.zeros(0, np.uint64), *map(_unpack_sorted, own["hashes"])]), np.concatenate([np.zeros(0, np.int64), *map(_unpack, own["counts"])])))
        (h, n), two = both
        table = build_slice(np.concatenate([h >> _16, two[0]]), np.concatenate([n, two[1]]), LOAD)
        trim()
        return pd.DataFrame({"slice": [key[0]], "hashes": [_pack_sorted(h)], "counts": [_pack(n)], "n_types": [len(h)], "n_tokens": [int(n.sum())], "words": [table]})

    grouped = _count(train, slices).groupBy("slice").applyInPandas(run, "slice long, hashes binary, counts binary, n_types long, n_tokens long, words binary")
    return scratch_table(grouped, "lm-model")


_SCAN = pa.schema([("batch", pa.int64()), ("slice", pa.int64()), ("head", pa.binary()), ("ones", pa.binary()), ("twos", pa.binary())])
_SCAN_DDL = "batch long, slice long, head binary, ones binary, twos binary"


def _head(ids: pa.Array, size: np.ndarray, one: np.ndarray, at: np.ndarray) -> bytes:
    """What a batch needs besides its counts: ids, tokens of each document, its words and where they stand.

    Words stand under numbers by their frequency, which are small for most tokens.
    """
    null = np.packbits(ids.is_null().to_numpy(zero_copy_only=False))
    often = np.argsort(-np.bincount(at, minlength=len(one)), kind="stable")
    rank = np.empty(len(one), np.int64)
    rank[often] = np.arange(len(one))
    parts = [ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), null.tobytes(), _pack(size), _pack_sorted(one), _pack(often), _pack(rank[at])]
    return struct.pack("<7I", len(ids), *map(len, parts)) + b"".join(parts)


def _read_head(blob: bytes) -> tuple[pd.array, np.ndarray, np.ndarray, np.ndarray]:
    n, *sizes = struct.unpack_from("<7I", blob)
    ends = 28 + np.cumsum([0, *sizes])
    ids, null, size, one, often, rank = (blob[a:b] for a, b in zip(ends, ends[1:]))
    mask = np.unpackbits(np.frombuffer(null, np.uint8), count=n).astype(bool)
    return pd.arrays.IntegerArray(np.frombuffer(ids, "<i8").astype(np.int64), mask), _unpack(size), _unpack_sorted(one), _unpack(often)[_unpack(rank)]


def _scan(docs: DataFrame, slices: int) -> DataFrame:
    """A row for each batch with its head (slice -1), and its distinct words and pairs by slice."""

    def out(batch_id: int, ids: list, sizes: list, tokens: list) -> Iterator[pa.RecordBatch]:
        h, size = np.concatenate(tokens), np.concatenate(sizes)
        one, at = np.unique(h, return_inverse=True)
        yield record(_SCAN, [batch_id], [-1], [_head(pa.concat_arrays(ids), size, one, at)], [None], [None])
        two = np.unique(_bigrams(h, size)[0])
        first, second = _spans(_slice_of(one >> _32, slices)), _spans(_slice_of(two >> _16, slices))
        own = sorted(first.keys() | second.keys())
        for k in range(0, len(own), 64):
            part = own[k : k + 64]
            yield record(_SCAN, [batch_id] * len(part), part, [None] * len(part), *([_pack_sorted(v[slice(*e.get(s, (0, 0)))]) for s in part] for e, v in ((first, one), (second, two))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_id = TaskContext.get().partitionId() << 32
        ids, sizes, tokens, held = [], [], [], 0
        for batch in batches:
            for at, part in words.chunks(batch.column("text")):
                h, size = _tokens(part)
                ids.append(batch.column("doc_id").slice(at, len(part)))
                sizes.append(size)
                tokens.append(h)
                held += len(h)
                if held >= BATCH:
                    yield from out(batch_id, ids, sizes, tokens)
                    batch_id += 1
                    ids, sizes, tokens, held = [], [], [], 0
        if held:
            yield from out(batch_id, ids, sizes, tokens)

    return docs.mapInArrow(lean(run), _SCAN_DDL)


_REPLY_DDL = "batch long, slice long, counts binary, levels binary, pair_levels binary"


def _answered(asked: DataFrame, model: DataFrame) -> DataFrame:
    """For each packed request the exact counts of its words and the levels of words and pairs."""

    def run(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if len(known):
            h, n = _unpack_sorted(known["hashes"][0]), _unpack(known["counts"][0])
            table = np.frombuffer(known["words"][0], "<u8")
        else:
            h, n, table = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.uint64)
        out = []
        for batch, ones, twos in zip(rows["batch"], rows["ones"], rows["twos"]):
            one, two = _unpack_sorted(ones), _unpack_sorted(twos)
            c = np.zeros(len(one), np.int64)
            if len(h):
                at = np.minimum(np.searchsorted(h, one), len(h) - 1)
                c = np.where(h[at] == one, n[at], 0)
            out.append((batch, key[0], _pack(c), _pack(probed(table, one >> _16)), _pack(probed(table, two))))
        trim()
        return pd.DataFrame(out, columns=["batch", "slice", "counts", "levels", "pair_levels"])

    return asked.groupBy("slice").cogroup(model.select("slice", "hashes", "counts", "words").groupBy("slice")).applyInPandas(run, _REPLY_DDL)


def _coarse_answers(asked: DataFrame, model: DataFrame, slices: int) -> DataFrame:
    """Answers to requests by coarse slice, through bundles of many requests that are asked by fine slice."""
    span = -(-slices // FAN)
    bundled = asked.groupBy("slice", F.pmod(F.xxhash64("batch"), F.lit(span)).alias("bundle"))

    def bundle(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        one, two = (np.unique(np.concatenate(list(map(_unpack_sorted, rows[c])))) for c in ("ones", "twos"))
        spans = [_spans(_slice_of(one >> _32, slices)), _spans(_slice_of(two >> _16, slices))]
        own = sorted(spans[0].keys() | spans[1].keys())
        cut = [[_pack_sorted(v[slice(*e.get(s, (0, 0)))]) for s in own] for v, e in zip((one, two), spans)]
        number = (int(key[0]) << 32) + int(key[1])
        return pd.DataFrame({"batch": [number] * len(own), "slice": own, "ones": cut[0], "twos": cut[1]})

    inner = scratch_table(bundled.applyInPandas(bundle, "batch long, slice long, ones binary, twos binary"), "lm-bundles")
    answers = _answered(inner, model).join(inner, ["batch", "slice"])
    member = asked.withColumn("bundle", (F.col("slice") * F.lit(1 << 32)) + F.pmod(F.xxhash64("batch"), F.lit(span)))

    def spread(key: tuple, rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("slice")
        one, two = (np.concatenate(list(map(_unpack_sorted, found[c]))) for c in ("ones", "twos"))
        c, level, pairs = (np.concatenate(list(map(_unpack, found[c]))) for c in ("counts", "levels", "pair_levels"))
        out = []
        for batch, part, ones, twos in zip(rows["batch"], rows["slice"], rows["ones"], rows["twos"]):
            a, b = np.searchsorted(one, _unpack_sorted(ones)), np.searchsorted(two, _unpack_sorted(twos))
            out.append((batch, part, _pack(c[a]), _pack(level[a]), _pack(pairs[b])))
        trim()
        return pd.DataFrame(out, columns=["batch", "slice", "counts", "levels", "pair_levels"])

    return member.groupBy("bundle").cogroup(answers.withColumnRenamed("batch", "bundle").groupBy("bundle")).applyInPandas(spread, _REPLY_DDL)


def score_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    The model learns from the rows that aren't held out; rows without an id are
    learnt from. Null text counts as empty: one token, the end. An empty table
    gives no rows, and a table without training rows scores by the smoothing
    alone. Repeated rows count and are returned as often as they come.
    """
    source = id_text(docs)
    train = source.where(~held_out())
    volume = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(8, -(-volume // SLICE_BYTES))
    model = learn(train, slices)
    n_types, n_tokens = (x or 0 for x in model.agg(F.sum("n_types"), F.sum("n_tokens")).first())
    denominator = n_tokens + ALPHA * (n_types + 1)
    scanned = scratch_table(_scan(source, min(slices, FAN)), "lm-scan")
    asked = scanned.where("slice >= 0").select("batch", "slice", "ones", "twos")
    replies = _answered(asked, model) if slices <= FAN else _coarse_answers(asked, model, slices)

    def finish(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids, size, one, at = _read_head(rows["head"][rows["head"].notna()].iloc[0])
        parts = rows[rows["head"].isna()].sort_values("slice")
        c, level, pairs = (np.concatenate(list(map(_unpack, parts[k]))) for k in ("counts", "levels", "pair_levels"))
        h, doc = one[at], np.repeat(np.arange(len(size)), size)
        two, before = _bigrams(h, size)
        found, place = np.unique(two, return_inverse=True)
        if len(found) != len(pairs) or len(one) != len(c):
            raise ValueError("a batch didn't get all its counts back")
        word = _middle(level)
        c_two, c_word = _middle(pairs)[place], word[at]
        # a text's first token follows as many texts as there are ends
        c_before = np.empty_like(c_word)
        c_before[1:] = c_word[:-1]
        begin = np.cumsum(size) - size
        c_before[begin] = word[np.searchsorted(one, _END)]
        p = np.minimum(1.0, (c_two + MU * (c_word + ALPHA) / denominator) / (np.maximum(c_before, c_two) + MU))
        base = np.log10((c + ALPHA) / denominator)[at]
        trim()
        return pd.DataFrame({"doc_id": ids, "n_tokens": size, "n_known": np.bincount(doc, (c > 0)[at], len(size)).astype(np.int64), "train_tokens": n_tokens, "base_score": np.bincount(doc, base, len(size)), "score": np.bincount(doc, np.log10(p), len(size))})

    heads = scanned.where("slice = -1").select("batch", "head")
    scored = heads.unionByName(replies, allowMissingColumns=True).groupBy("batch").applyInPandas(finish, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
