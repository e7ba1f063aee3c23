"""Pair features from names and addresses."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from kinweave.functions import text as T


def token_jaccard(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """Overlap over union of two distinct lists; ``empty`` if a side (for 1.0: both sides) has none."""
    share = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    if empty == 1.0:
        return F.when(F.size(F.array_union(a, b)) == 0, 1.0).otherwise(share)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), empty).otherwise(share)


def token_containment(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def length_ratio(a: Column, b: Column) -> Column:
    la, lb = F.char_length(a), F.char_length(b)
    return F.when((la == 0) | (lb == 0), 0.0).otherwise(F.least(la, lb) / F.greatest(la, lb))


def number_conflict(a: Column, b: Column) -> Column:
    return ((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)).cast("double")


def matching_blocks_ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity; 0 if a side is empty."""
    return SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else 0.0


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """2 LCS over the summed lengths; 1 for two empty texts."""
    total = len(a) + len(b)
    return 2 * lcs_length(a, b) / total if total else 1.0


def sorted_words_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def best_window_ratio(a: str, b: str) -> float:
    """The best indel ratio of the shorter text with a window of the longer one.

    Windows have the shorter text's length; at both ends they may be cut off.
    """
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n, m = len(short), len(long)
    own = set(short)
    best = 0.0
    for i in range(-n + 1, m):
        window = long[max(0, i) : min(m, i + n)]
        edge = window[-1] if i + n <= m else window[0]
        if edge in own:
            best = max(best, indel_ratio(short, window))
            if best == 1.0:
                break
    if n == m:
        best = max(best, indel_ratio(short, long))
    return best


def _over_pairs(function):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([function(x or "", y or "") for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(run, DoubleType())


sequence_ratio = _over_pairs(matching_blocks_ratio)
token_sort_indel = _over_pairs(sorted_words_ratio)
partial_indel = _over_pairs(best_window_ratio)


def text_features(prefix: str, a: Column, b: Column) -> dict[str, Column]:
    """The eleven features of two normalised texts; two of them are computed in Python."""
    ta, tb = T.words(a), T.words(b)
    sa, sb = F.array_distinct(ta), F.array_distinct(tb)
    both, none = (a != "") & (b != ""), (a == "") & (b == "")
    return {
        f"{prefix}_exact": (both & (a == b)).cast("double"),
        f"{prefix}_both_missing": none.cast("double"),
        f"{prefix}_one_missing": ((a == "") != (b == "")).cast("double"),
        f"{prefix}_length_ratio": length_ratio(a, b),
        f"{prefix}_token_jaccard": token_jaccard(sa, sb),
        f"{prefix}_token_containment": token_containment(sa, sb),
        f"{prefix}_char_3gram_jaccard": token_jaccard(T.compact_trigrams(a), T.compact_trigrams(b)),
        f"{prefix}_sequence_ratio": sequence_ratio(a, b),
        f"{prefix}_token_sort_ratio": sequence_ratio(F.array_join(F.array_sort(ta), " "), F.array_join(F.array_sort(tb), " ")),
        f"{prefix}_s1_token_count": F.size(ta),
        f"{prefix}_candidate_token_count": F.size(tb),
    }


def number_features(na: Column, nb: Column, aa: Column, ab: Column) -> dict[str, Column]:
    n1, n2, a1, a2 = map(T.digit_runs, (na, nb, aa, ab))
    same = (F.size(a1) > 0) & (F.array_sort(a1) == F.array_sort(a2))
    return {
        "name_number_overlap": token_jaccard(n1, n2),
        "name_number_conflict": number_conflict(n1, n2),
        "address_number_overlap": token_jaccard(a1, a2),
        "address_number_conflict": number_conflict(a1, a2),
        "address_numbers_exact": same.cast("double"),
    }


def pair_features(pairs: DataFrame) -> DataFrame:
    """All features of pairs that carry ``name_a, address_a, country_a`` and the same of b.

    Texts are normalised first. ``combined_name_address_similarity`` is the mean
    of the sequence ratios over the fields that both sides have.
    """
    texts = pairs
    for side in "ab":
        for field in ("name", "address", "country"):
            texts = texts.withColumn(f"_{field}_{side}", T.normalise(f"{field}_{side}"))
    name, address = (F.col("_name_a"), F.col("_name_b")), (F.col("_address_a"), F.col("_address_b"))
    made = {**text_features("name", *name), **text_features("address", *address), **number_features(*name, *address)}
    out = texts.withColumns(made)
    has_name, has_address = ((a != "") & (b != "") for a, b in (name, address))
    scores = F.when(has_name, F.col("name_sequence_ratio")).otherwise(0.0) + F.when(has_address, F.col("address_sequence_ratio")).otherwise(0.0)
    fields = has_name.cast("int") + has_address.cast("int")
    country = (F.col("_country_a") != "") & (F.col("_country_a") == F.col("_country_b"))
    out = out.withColumns({
        "country_exact": country.cast("double"),
        "candidate_source_s2": (F.col("candidate_source") == "S2").cast("double"),
        "candidate_source_s3": (F.col("candidate_source") == "S3").cast("double"),
        "combined_name_address_similarity": F.when(fields == 0, 0.0).otherwise(scores / F.greatest(fields, F.lit(1))),
    })
    return out.drop(*(f"_{f}_{s}" for f in ("name", "address", "country") for s in "ab"))


def _agreement(a: Column, b: Column) -> Column:
    """1 equal, 0 unequal, -1 if a side is unknown."""
    return F.when(a.isNull() | b.isNull(), -1).otherwise((a == b).cast("int"))


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def string_features(pairs: DataFrame) -> DataFrame:
    """Directional, legal-form, number and contradiction features of raw names and addresses.

    Token frequencies for the rare tokens are those of the whole table, so they
    don't depend on partitions. Null counts as empty; similarities of a missing
    address are null, which says that there's no evidence.
    """
    raw = pairs.withColumns({f"_{f}_{s}": F.coalesce(f"{f}_{s}", F.lit("")) for f in ("name", "address") for s in "ab"})
    raw = raw.withColumns({"_core_a": T.core_name(F.col("_name_a")), "_core_b": T.core_name(F.col("_name_b"))})
    raw = raw.withColumns({"_tok_a": T.word_set(F.col("_core_a")), "_tok_b": T.word_set(F.col("_core_b"))})
    ta, tb, ca, cb, aa, ab = (F.col(c) for c in ("_tok_a", "_tok_b", "_core_a", "_core_b", "_address_a", "_address_b"))
    la, lb = T.has_legal_form(F.col("_name_a")), T.has_legal_form(F.col("_name_b"))
    ma, mb = F.trim(aa) == "", F.trim(ab) == ""
    length_a, length_b = F.greatest(F.char_length(ca), F.lit(1)), F.greatest(F.char_length(cb), F.lit(1))
    out = raw.withColumns({"_house_a": T.house_number(aa), "_house_b": T.house_number(ab), "_unit_a": T.unit_number(aa), "_unit_b": T.unit_number(ab)})
    ha, hb = F.col("_house_a"), F.col("_house_b")
    out = out.withColumns({"_post_a": T.postcode(aa, ha), "_post_b": T.postcode(ab, hb)})
    words_a, words_b = T.word_set(aa), T.word_set(ab)
    out = out.withColumns({
        "name_raw_similarity": token_sort_indel(F.col("_name_a"), F.col("_name_b")),
        "name_core_similarity": token_sort_indel(ca, cb),
        "name_partial_similarity": partial_indel(ca, cb),
        "legal_form_present_a": la.cast("int"),
        "legal_form_present_b": lb.cast("int"),
        "legal_form_agreement": (la == lb).cast("int"),
        "name_tokens_missing_from_b": F.size(F.array_except(ta, tb)),
        "name_tokens_extra_in_b": F.size(F.array_except(tb, ta)),
        "name_token_jaccard": token_jaccard(ta, tb, 1.0),
        "name_initials_match": (T.initials(ta) == T.initials(tb)).cast("int"),
        "name_length_ratio": F.least(length_a, length_b) / F.greatest(length_a, length_b),
        "address_a_missing": ma.cast("int"),
        "address_b_missing": mb.cast("int"),
        "address_raw_similarity": F.when((aa != "") & (ab != ""), token_sort_indel(aa, ab)),
        "house_number_a_present": ha.isNotNull().cast("int"),
        "house_number_b_present": hb.isNotNull().cast("int"),
        "house_number_match": _agreement(T.plain_number(ha), T.plain_number(hb)),
        "house_number_missing_flag": (ha.isNull() | hb.isNull()).cast("int"),
        "unit_number_match": _agreement(F.col("_unit_a"), F.col("_unit_b")),
        "unit_missing_flag": (F.col("_unit_a").isNull() | F.col("_unit_b").isNull()).cast("int"),
        "postcode_match": _agreement(F.col("_post_a"), F.col("_post_b")),
        "postcode_missing_flag": (F.col("_post_a").isNull() | F.col("_post_b").isNull()).cast("int"),
        "address_token_jaccard": F.when(~(ma | mb), token_jaccard(words_a, words_b, 1.0)),
    })
    name, address, present = F.col("name_core_similarity"), F.col("address_raw_similarity"), ~(ma | mb)
    out = out.withColumns({
        "postcode_match_house_mismatch": ((F.col("postcode_match") == 1) & (F.col("house_number_match") == 0)).cast("int"),
        "strong_name_contradictory_address": _flag((name >= 0.85) & (address < 0.5) & present),
        "weak_name_strong_address": _flag((name < 0.5) & (address >= 0.85) & present),
        "address_carries_despite_name_conflict": F.when(present, F.least(address, F.greatest(1 - name, F.lit(0.0)))),
    })
    out = out.withColumn("rare_token_disagreement", _rare_count(out))
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def _rare_count(pairs: DataFrame) -> Column:
    """Tokens of one side only that are rare in the whole table: at most max(2, 1 %) of its pairs.

    Frequent tokens number at most twice the words of a name times 100, whatever
    the size of the table, so they're the side that is collected.
    """
    both = pairs.select(F.explode(F.concat("_tok_a", "_tok_b")).alias("token")).groupBy("token").count()
    limit = max(2, int(0.01 * pairs.count()))
    frequent = [r["token"] for r in both.where(F.col("count") > limit).select("token").collect()]
    odd = F.concat(F.array_except("_tok_a", "_tok_b"), F.array_except("_tok_b", "_tok_a"))
    common = F.array(*map(F.lit, frequent)) if frequent else F.array().cast("array<string>")
    return F.size(F.array_except(odd, common))
