"""Quality rules whose cutoffs carry a guarantee on rejected good documents.

Each rule rejects a document whose ratio lies over a cutoff. For each stratum
(language) and rule, cutoffs are tested from the loosest to the tightest on a
labelled holdout: a cutoff is certified while the Clopper-Pearson upper bound on
the share of good documents that it rejects is at most the rule's part of the
risk. Testing stops at the first failure, so one error level serves the whole
sequence of a rule (fixed-sequence testing), and Bonferroni's correction divides
the level among all sequences. All certified cutoffs hold at once; of these the
one is taken that rejects most bad documents at ``GOOD_COST`` for a good one, the
loosest in a tie.

A stratum whose good documents are too few to certify anything for each rule's
part of the risk has one rule, ``any``, with the whole risk: the largest of the
rules' ratios. Which of the two a stratum gets depends on the number of its
labels alone. Where they're too few for that as well, nothing is rejected.

The bound holds for independent documents, so the holdout has one row for each
text (by a digest of the whole text) and for each id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from kinweave.llm.common import documents, fresh, lean, text_bytes
from kinweave.sources.scratch import scratch_table

#: Share of the good documents of a stratum that all rules together may reject, and the error level.
RISK, DELTA = 0.02, 0.05
GOOD_COST = 10
#: Cutoffs tested: GRID, GRID - 1, ... , 1 over GRID.
GRID = 200
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "repeats": ("n_repeat_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "capitals": ("n_capitals", "word_chars"),
}
ANY = "any"
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_INNER = bytes(range(0x80, 0xC0))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            key = key * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.sort(key)
    if not (order[1:] == order[:-1]).any():
        return 0
    seen = Counter(windows := list(zip(*(words[k:] for k in range(width)))))
    edge = np.zeros(len(words) + 1, np.int64)
    for i, w in enumerate(windows):
        if seen[w] > 1:
            edge[i] += 1
            edge[i + width] -= 1
    return int((np.cumsum(edge) > 0).sum())


def counts(text: bytes) -> tuple[int, ...]:
    """The counts of ``COUNTS`` for one text."""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.translate(None, _INNER))
    symbols = len(joined) - len(joined.translate(None, _SYMBOLS))
    capitals = len(joined) - len(joined.translate(None, _CAPITALS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words), len(lines), capitals


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of ``keep``, the counts of each text and its ``digest`` (XXH128); null text has none and counts as empty."""
    source = docs.select(*keep, F.col("text").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch, "_text")
            rows = [counts(t) for t in texts]
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(COUNTS))]
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *columns, pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary())], names=[*keep, *COUNTS, "digest"])

    ddl = ", ".join([*(f"`{c}` {t}" for c, t in source.drop("_text").dtypes), *(f"{c} long" for c in COUNTS), "digest binary"])
    return source.mapInArrow(lean(run), ddl)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def upper_bound(bad: int, n: int, level: float) -> float:
    """Clopper-Pearson: the largest rate at which ``bad`` or fewer of ``n`` has a chance of ``level``."""
    if bad >= n:
        return 1.0
    low, high = bad / n, 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(bad + 1)]
    for _ in range(60):
        p = (low + high) / 2
        if p <= 0 or p >= 1:
            break
        terms = [x + k * math.log(p) + (n - k) * math.log1p(-p) for k, x in enumerate(logs)]
        top = max(terms)
        tail = top + math.log(sum(math.exp(t - top) for t in terms))
        low, high = (p, high) if tail > math.log(level) else (low, p)
    return high


def certify(good: list[int], bad: list[int], risk: float, level: float) -> int | None:
    """The chosen cutoff in steps of 1 / GRID, from histograms of good and bad documents.

    Bin k holds documents whose ratio exceeds k / GRID but not (k + 1) / GRID;
    cutoff k rejects bins k and up.
    """
    n, over_good, over_bad = sum(good), 0, 0
    best, gain = None, 0
    for k in range(GRID - 1, 0, -1):
        over_good += good[k]
        over_bad += bad[k]
        if over_good / max(n, 1) > risk or upper_bound(over_good, n, level) > risk:
            break
        if over_bad - GOOD_COST * over_good > gain:
            best, gain = k, over_bad - GOOD_COST * over_good
    return best


def least_labels(risk: float, level: float) -> int:
    """Good documents below which not even a cutoff that rejects none of them is certified."""
    return math.ceil(math.log(level) / math.log1p(-risk))


def _bin(rule: str) -> Column:
    """The bin of a rule's ratio, -1 where it has none; for ``any`` that of the largest ratio."""
    if rule == ANY:
        return F.greatest(*(_bin(r) for r in RULES))
    top, under = RULES[rule]
    ratio = F.when(F.col(under) > 0, F.least(F.lit(GRID - 1), F.ceil(F.col(top) * GRID / F.col(under)) - 1)).otherwise(-1)
    return ratio.cast("int")


def _stratum(lang: str = "lang") -> Column:
    """The stratum's name: the language behind a mark, so that null is one of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit(""))


def holdout(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """``stratum, good`` and a bin for each rule: one row for each labelled text and id that passes the base rules.

    ``labels``: doc_id, quality (1 good, 0 bad). Labels without an id or a value
    are left out; an id, or a text that several rows hold, counts as good if all
    its labels say so.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    rows = measured.where(~base_failed()).join(marks, "doc_id").select("doc_id", "digest", _stratum().alias("stratum"), "quality", *(_bin(r).alias(r) for r in (*RULES, ANY)))
    for key in ("doc_id", "digest"):
        rows = rows.groupBy(key).agg(F.min("quality").alias("quality"), F.min(F.struct("stratum", *RULES, ANY, *({"doc_id", "digest"} - {key}))).alias("x")).select(key, "quality", "x.*")
    return rows.select("stratum", (F.col("quality") > 0).alias("good"), *RULES, ANY)


def learn_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Certified cutoffs in steps of 1 / GRID: ``stratum`` and a column for each rule and ``any``, null where none is certified.

    A task certifies a stratum from its histograms; the driver only learns how
    many sequences are tested.
    """
    held = scratch_table(holdout(measured, labels), "rules-holdout")
    sizes = held.where("good").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    part = risk / len(RULES)
    # the numbers of labels that are enough are taken at the level of a single stratum, so that they don't depend on the others
    enough, few = least_labels(part, delta / len(RULES)), least_labels(risk, delta)
    sequences = sizes.agg(F.sum(F.when(F.col("n") >= enough, len(RULES)).when(F.col("n") >= few, 1))).first()[0] or 1
    level = delta / sequences
    names = [*RULES, ANY]
    bins = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.greatest(F.lit(0), F.col(r)).alias("bin")) for r in names)))
    hist = held.select("stratum", "good", bins.alias("x")).groupBy("stratum", "good", "x.rule", "x.bin").agg(F.count(F.lit(1)).alias("n"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = {r: {g: np.bincount(x["bin"], x["n"], GRID + 1).astype(int).tolist() for g, x in ((g, rows[(rows["rule"] == r) & (rows["good"] == g)]) for g in (True, False))} for r in names}
        n = sum(own[ANY][True])
        found = {r: None for r in names}
        if n >= enough:
            found |= {r: certify(own[r][True], own[r][False], part, level) for r in RULES}
        elif n >= few:
            found[ANY] = certify(own[ANY][True], own[ANY][False], risk, level)
        return pd.DataFrame({"stratum": [key[0]], **{r: pd.array([k], "Int32") for r, k in found.items()}})

    large = hist.join(sizes.where(F.col("n") >= few).select("stratum"), "stratum")
    return scratch_table(large.groupBy("stratum").applyInPandas(run, ", ".join(["stratum string", *(f"`{r}` int" for r in names)])), "rules-cutoffs")


def verdict(cutoffs: str = "cut") -> Column:
    """True where no rule of the document's stratum rejects it; ``cutoffs`` is the struct of its certified ones, or null."""
    out = F.lit(True)
    for r in (*RULES, ANY):
        out = out & ~F.coalesce(_bin(r) >= F.col(f"{cutoffs}.{r}"), F.lit(False))
    return out


def _with_cutoffs(rows: DataFrame, cutoffs: DataFrame, lang: Column, name: str = "cut") -> DataFrame:
    """Rows beside their stratum's cutoffs in a struct ``name``."""
    there = fresh(rows, "_stratum")
    known = cutoffs.select(F.col("stratum").alias(there), F.struct(*RULES, ANY).alias(name))
    return rows.join(known, lang == F.col(there), "left").drop(there)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, lang``, the counts, ``base_failed`` and ``kept`` for every row.

    Null text has no words and fails the base rules; a null language is a
    stratum of its own. Repeated rows are returned as often as they come. With
    no labels, or too few, only the base rules reject. Extra columns are not
    read.
    """
    measured = scratch_table(measure(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text"), ["doc_id", "lang"]), "quality")
    judged = _with_cutoffs(measured, learn_cutoffs(measured, labels), _stratum())
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict()).drop("cut", "digest")


def rejects(n: dict[str, int], cut: dict[str, int | None] | None) -> bool:
    """What ``base_failed`` and ``verdict`` say, for the counts of one text and its stratum's cutoffs."""
    if n["n_words"] < 10 or 100 * n["n_repeat_words"] > 20 * n["n_words"]:
        return True
    if not cut:
        return False
    own = {r: min(GRID - 1, -(-n[top] * GRID // n[under]) - 1) if n[under] > 0 else -1 for r, (top, under) in RULES.items()}
    own[ANY] = max(own.values())
    return any(cut[r] is not None and b >= cut[r] for r, b in own.items())


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns.

    The counts are made again beside each text once the cutoffs are known, so
    that no measure is joined to a text. The cutoffs, a row for each stratum
    with enough labels, are joined by language, by broadcast if Spark finds them
    small.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    cutoffs = learn_cutoffs(scratch_table(measure(slim, ["doc_id", "lang"]), "quality"), labels)
    names, cut = docs.columns, fresh(docs, "_cut")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limits = batch.column(cut).to_pylist()
            keep = [not rejects(dict(zip(COUNTS, counts(t))), x) for t, x in zip(text_bytes(batch), limits)]
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    return _with_cutoffs(docs, cutoffs, _stratum(), cut).select(*names, cut).mapInArrow(lean(run), docs.schema)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = quality_rules(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_capitals")
