"""Personal data: fixed patterns, and identifiers found by bootstrapped context.

The base finds e-mail addresses, IP addresses, cards and phone numbers by their
form. They're seeds, and so are strings of a credential's form (``FORMS``).
What stands before a seed is a lexical pattern: the last one, two or three
segments, a segment being a word or one of the cue characters that introduce a
value. Patterns and instances, that is identifiers, make a bipartite graph, which
Spark scores in rounds:

* a pattern's confidence is the part of *all* its occurrences in the corpus that
  are followed by a known instance, weighted by the instances' scores, and
  counts only if at least ``SUPPORT`` distinct known instances follow it;
* an instance that isn't a seed scores 1 - product(1 - confidence) over the
  patterns that it follows.

Patterns whose confidence reaches ``CONFIDENCE`` then mark the tokens with a
digit after them, at ``SURE`` also tokens without one, and an instance that
scores ``SURE`` is marked wherever it stands. An access key id is known by its
form alone; a hexadecimal string isn't, and needs a pattern. All these are
reported under a kind of their own, ``id``, after the base spans, which all stay.

Segments, patterns and instances are known by hashes of 64 bits. The occurrences
of patterns are counted, and trusted ones found again, over all segments of all
documents in numpy, through a bit field of fixed size that says which contexts
matter; its false hits go in the join on the pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from kinweave.llm import words
from kinweave.llm.common import documents, fresh, id_text, lean, record, text_bytes
from kinweave.sources.scratch import scratch_table

KINDS = ("email", "ip", "card", "phone")
SUPPORT, CONFIDENCE, SURE, ROUNDS = 5, 0.5, 0.9, 3
#: Bits of the field of contexts to look for (1 MB).
FIELD = 1 << 23
#: Segments of the longest context, characters of the shortest identifier.
REACH, LEAST = 3, 5
#: Characters that are segments by themselves.
CUES = b"=:\"'([{<"

# Forms of credentials, of which the first is reported wherever it stands.
FORMS = (re.compile(r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"), re.compile(r"(?<![0-9A-Za-z])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{16,64}(?![0-9A-Za-z])"))

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_EDGE = "\"'`.,;:!?()[]{}<>#*$%&|=" + "‘’“”«»"
_SEGMENT = re.compile(rb"[^\x20\x09-\x0D" + re.escape(CUES) + rb"]+|[" + re.escape(CUES) + rb"]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base entities as (kind, start, end) in code points, by kind and then start.

    Every search is linear in the text: an address is sought backwards from its
    @, and no digit run is tried from its middle.
    """
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        floor = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > floor and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                floor = m.end()
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def _points(raw: bytes) -> np.ndarray | None:
    """The bytes at which the characters of a text begin, and its end; None where a character is a byte."""
    if raw.isascii():
        return None
    return np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80), len(raw))


def _stripped(text: str, a: int, b: int) -> tuple[int, int]:
    """A token without the punctuation at its edges."""
    while a < b and text[a] in _EDGE:
        a += 1
    while a < b and text[b - 1] in _EDGE:
        b -= 1
    return a, b


def candidates(raw: bytes, text: str, known: list[tuple[str, int, int]]) -> list[tuple[int, int, bool, bool, list[bytes]]]:
    """Seeds and tokens with a digit outside them: (start, end, seed, known by form, segments before).

    Segments are read once, and seeds and tokens are merged in order, so the
    time is linear in the text.
    """
    if not known and not _DIGIT.search(text):
        return []
    seeds = [(a, b, True, False) for _, a, b in known]
    for k, form in enumerate(FORMS):
        seeds += [(m.start(), m.end(), True, not k) for m in form.finditer(text)]
    taken, last = [], 0
    for s in sorted(seeds, key=lambda s: (s[0], -s[1])):
        if s[0] >= last:
            taken.append(s)
            last = s[1]
    points = _points(raw)
    spans = [m.span() for m in _SEGMENT.finditer(raw)]
    begins = [a for a, _ in spans]
    at = begins if points is None else np.searchsorted(points, begins).tolist()
    ends = [b for _, b in spans] if points is None else np.searchsorted(points, [b for _, b in spans]).tolist()
    out, k = [], 0
    for i, (a, b) in enumerate(zip(at, ends)):
        while k < len(taken) and taken[k][0] < b:
            s = taken[k]
            before = [raw[x:y] for x, y in spans[max(0, i - REACH) : i]] if s[0] == a else []
            out.append((*s, before))
            k += 1
        if b - a >= LEAST and not (k and taken[k - 1][1] > a):
            a, b = _stripped(text, a, b)
            if b - a >= LEAST and _DIGIT.search(text, a, b):
                out.append((a, b, False, False, [raw[x:y] for x, y in spans[max(0, i - REACH) : i]]))
    return out


def _contexts(h: np.ndarray, room: np.ndarray) -> list[np.ndarray]:
    """For k = 1, 2, 3 a hash of the k segments that end at each one, 0 where ``room`` before it is too small."""
    out, now = [], words.mix(h)
    for k in range(REACH):
        if k:
            now = words.pair(np.concatenate([np.zeros(min(k, len(h)), np.uint64), h[:-k] if k < len(h) else h[:0]]), now)
        out.append(np.where(room > k, now, np.uint64(0)))
    return out


def _of_lists(before: list[list[bytes]]) -> list[list[int]]:
    """The contexts that end each list of segments."""
    size = np.array([len(x) for x in before], np.int64)
    h, _ = words.hashed(pa.array([s for x in before for s in x], pa.binary()))
    if not len(h):
        return [[] for _ in before]
    end = np.cumsum(size)
    contexts = _contexts(h, np.arange(1, len(h) + 1) - np.repeat(end - size, size))
    rows = np.stack([c[np.maximum(end - 1, 0)] for c in contexts], 1).view(np.int64).tolist()
    return [[x for x in row if x] if n else [] for row, n in zip(rows, size.tolist())]


_FOUND = "doc_id long, key long, n_email long, n_ip long, n_card long, n_phone long, spans array<struct<kind:string,start:long,end:long>>, near array<struct<start:long,end:long,seed:boolean,sure:boolean,instance:long,contexts:array<long>>>"


def _key(raw: bytes) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(raw, 42)).view(np.int64))


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and candidates of every text; ``key`` is XXH64 of the text (seed 42)."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    near = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("seed", pa.bool_()), ("sure", pa.bool_()), ("instance", pa.int64()), ("contexts", pa.list_(pa.int64()))]))
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("spans", span), ("near", near)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found, close, before = [], [], [], []
            for raw in text_bytes(batch):
                text = raw.decode("utf-8", "replace")
                own = base_spans(text)
                keys.append(_key(raw))
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
                rows = candidates(raw, text, own)
                close.append([{"start": a, "end": b, "seed": seed, "sure": sure, "instance": _key(text[a:b].encode())} for a, b, seed, sure, _ in rows])
                before += [c[-1] for c in rows]
            for c, contexts in zip((c for one in close for c in one), _of_lists(before)):
                c["contexts"] = contexts
            n = [[sum(s["kind"] == k for s in spans) for spans in found] for k in KINDS]
            yield record(schema, batch.column("doc_id"), keys, *n, found, close)

    return id_text(docs).mapInArrow(lean(run), _FOUND)


class _Field:
    """A bit for each hash, shared by many."""

    def __init__(self, bits: bytes):
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").view(bool)

    def hits(self, context: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.bits[context % np.uint64(FIELD)] & (context != 0))


def _field(patterns: DataFrame):
    """A broadcast of the bits of all patterns, 1 MB however many they are."""
    at = F.col("pattern").bitwiseAND(F.lit(FIELD - 1).cast("long"))
    bit = F.expr("shiftleft(1, cast(pattern & 7 as int))")
    bits = np.zeros(FIELD // 8, np.uint8)
    for row in patterns.groupBy(F.shiftright(at, 3).alias("byte")).agg(F.bit_or(bit).alias("bits")).toLocalIterator():
        bits[row["byte"]] = row["bits"]
    return patterns.sparkSession.sparkContext.broadcast(bits.tobytes())


def _segments(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Parts of a text column: its first row, text and end of each segment, begin and bytes of each, and the contexts."""
    for at, part in words.chunks(column):
        h, many, begin, size = words.located(part, CUES)
        room = np.arange(1, len(h) + 1) - np.repeat(np.cumsum(many) - many, many)
        yield at, np.repeat(np.arange(len(many)), many), room < np.repeat(many, many), begin, size, _contexts(h, room)


def _occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pattern, total``: how often each context is followed by anything in all texts."""
    shared = _field(patterns)
    schema = pa.schema([("pattern", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = _Field(shared.value)
        for batch in batches:
            for _, _, goes_on, _, _, contexts in _segments(batch.column("text")):
                seen = np.concatenate([c[i[goes_on[i]]] for c in contexts for i in [field.hits(c)]])
                which, n = np.unique(seen, return_counts=True)
                yield record(schema, which.view(np.int64), n)

    return id_text(docs).select("text").mapInArrow(lean(count), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("total"))


def learn_patterns(docs: DataFrame, found: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame] | None:
    """``pattern, confidence`` of the patterns that may discover identifiers, and ``instance, score`` of all instances.

    None where no pattern has enough distinct instances.
    """
    near = found.select(F.explode("near").alias("e")).select("e.instance", "e.seed", F.explode("e.contexts").alias("pattern"))
    edges = scratch_table(near.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n")), "pii-edges")
    wide = scratch_table(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances")).where(F.col("instances") >= support).select("pattern"), "pii-patterns")
    if wide.isEmpty():
        return None
    graph = scratch_table(edges.join(_occurrences(docs, wide).join(wide, "pattern"), "pattern"), "pii-graph")
    score = graph.where("seed").select("instance", F.lit(1.0).alias("score")).distinct()
    for _ in range(rounds):
        known = graph.join(score, "instance", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        rated = known.groupBy("pattern").agg((F.sum(F.col("n") * F.col("score")) / F.first("total")).alias("confidence"), F.count_if(F.col("score") >= confidence).alias("support"))
        rated = scratch_table(rated.where(F.col("support") >= support).select("pattern", F.least(F.lit(1.0), "confidence").alias("confidence")), "pii-rated")
        lifted = graph.join(rated, "pattern", "left").groupBy("instance").agg(F.max("seed").alias("seed"), (1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.coalesce("confidence", F.lit(0.0))))))).alias("score"))
        score = scratch_table(lifted.select("instance", F.when(F.col("seed"), 1.0).otherwise(F.col("score")).alias("score"), "seed"), "pii-scores")
    return rated.where(F.col("confidence") >= confidence), score


def _marked(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``doc_id, key, start, end, pattern, digit``: tokens after a context that may be trusted, outside base spans."""
    shared = _field(patterns)
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.int64()), ("digit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = _Field(shared.value)
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), []
            for first, doc, goes_on, begin, size, contexts in _segments(batch.column("text")):
                hits: dict[int, list[tuple[int, int]]] = {}
                for c in contexts:
                    for i in field.hits(c).tolist():
                        if goes_on[i]:
                            hits.setdefault(int(doc[i]), []).append((i + 1, int(c[i : i + 1].view(np.int64)[0])))
                for d, own in hits.items():
                    raw = batch.column("text")[first + d].as_py().encode()
                    text, points, key = raw.decode(), _points(raw), _key(raw)
                    taken, at = sorted((a, b) for _, a, b in base_spans(text)), 0
                    for i, pattern in sorted(own):
                        a, b = int(begin[i]), int(begin[i] + size[i])
                        if points is not None:
                            a, b = np.searchsorted(points, [a, b]).tolist()
                        a, b = _stripped(text, a, b)
                        while at < len(taken) and taken[at][1] <= a:
                            at += 1
                        if b - a >= LEAST and not any(x < b for x, _ in taken[at : at + 1]):
                            out.append((ids[first + d], key, a, b, pattern, _DIGIT.search(text, a, b) is not None))
            yield record(schema, *([x[k] for x in out] for k in range(6)))

    return id_text(docs).mapInArrow(lean(run), "doc_id long, key long, start long, end long, pattern long, digit boolean")


def discoveries(docs: DataFrame, found: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, sure: float = SURE) -> DataFrame:
    """``doc_id, key, start, end`` of the identifiers that the base doesn't find; rows may come more than once."""
    near = found.select("doc_id", "key", F.explode("near").alias("e")).select("doc_id", "key", "e.*").drop("contexts")
    out = near.where("sure").select("doc_id", "key", "start", "end")
    learnt = learn_patterns(docs, found, support, confidence)
    if learnt is None:
        return out
    patterns, score = learnt
    trusted = scratch_table(_marked(docs, patterns).join(patterns, "pattern").where(F.col("digit") | (F.col("confidence") >= sure)).select("doc_id", "key", "start", "end"), "pii-marked")
    again = near.where("NOT seed").join(score.where((F.col("score") >= sure) & ~F.col("seed")).select("instance"), "instance", "left_semi").select("doc_id", "key", "start", "end")
    return out.union(trusted).union(again)


def find_pii(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``doc_id, key, n_email, n_ip, n_card, n_phone, spans, extra`` for every row.

    ``spans`` holds the base spans, ``extra`` the discovered ones (kind ``id``);
    the counts are those of the base. ``key`` is XXH64 of the text: rows that
    share id and text share their spans. Null text counts as empty and has none;
    rows without an id are searched like any other. An empty table gives no
    rows; extra columns are not read.
    """
    found = scratch_table(scan(docs), "pii")
    new = discoveries(docs, found, support, confidence)
    extra = new.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.array_sort(F.collect_set(F.struct(F.lit("id").alias("kind"), "start", "end"))).alias("extra"))
    none = F.array().cast("array<struct<kind:string,start:long,end:long>>")
    return found.drop("near").join(extra, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left").drop("d", "k").withColumn("extra", F.coalesce("extra", none))


def redact(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``docs`` with every found span replaced by its kind in angle brackets; other columns as they are.

    Overlapping spans are replaced together, under the kind of the first. A null
    text stays null. Base spans are found again from the text, so only the
    discovered ones are joined to it, if there are any.
    """
    names = docs.columns
    who, key, spans = fresh(docs, "_pii_id"), fresh(docs, "_pii_key"), fresh(docs, "_pii_spans")
    new = discoveries(docs, scratch_table(scan(docs), "pii"), support, confidence)
    extra = new.groupBy(F.col("doc_id").alias(who), F.col("key").alias(key)).agg(F.collect_set(F.struct(F.lit("id").alias("kind"), "start", "end")).alias(spans))
    extra = scratch_table(extra, "pii-extra")
    if extra.isEmpty():
        source = docs.withColumn(spans, F.lit(None).cast("array<struct<kind:string,start:long,end:long>>"))
    else:
        text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
        source = docs.join(extra, F.col("doc_id").cast("long").eqNullSafe(F.col(who)) & (text == F.col(key)), "left").select(*names, spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, more in enumerate(batch.column(spans).to_pylist()):
                if texts[i] and (own := [*({"kind": k, "start": a, "end": b} for k, a, b in base_spans(texts[i])), *(more or ())]):
                    texts[i] = _replaced(texts[i], own)
            columns = [pa.array(texts, batch.schema.field("text").type) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(lean(run), docs.schema)


def _replaced(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out.append(text[at : s["start"]])
            out.append(f"<{s['kind'].upper()}>")
            at = s["end"]
        else:
            at = max(at, s["end"])
    return "".join(out) + text[at:]


def op9_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir))

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base, extra = joined("spans"), joined("extra")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(base, 256).alias("base_sha256"), F.concat_ws(",", F.when(base != "", base), F.when(extra != "", extra)).alias("spans"))
