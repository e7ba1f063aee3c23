"""Identifiers: sources, stable hashes, folds, bins, packed forms and parsed lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PAIR_KEY = ["source1_entity_id", "candidate_source", "candidate_entity_id"]
SOURCE_KEY = ["candidate_source", "candidate_entity_id"]


def candidate_source(candidate: Column) -> Column:
    """S2 or S3 by the prefix of an id, else null."""
    return F.when(candidate.startswith("S2-"), "S2").when(candidate.startswith("S3-"), "S3")


def stable_rank(value: Column, seed: int | Column) -> Column:
    """The first 64 bits of SHA-256 of ``seed:value`` as a decimal."""
    seed = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.conv(F.substring(F.sha2(F.concat_ws(":", seed, value), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_fold(value: Column, seed: int = 42, folds: int = 3) -> Column:
    return (stable_rank(value, seed) % folds).cast("int")


def stable_bucket(value: Column, buckets: int, seed: int = 42) -> Column:
    """All 256 bits of SHA-256 of ``seed:value``, modulo ``buckets``."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), value), 256)
    digits = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.conv(F.substring(digest, i, F.lit(1)), 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: (a * 16 + d) % buckets).cast("int")


def match_bin(count: Column) -> Column:
    return F.when(count == 0, "0").when(count == 1, "1").when(count <= 3, "2-3").otherwise("4+")


def id_list(cell: Column) -> Column:
    """Distinct trimmed ids of a comma list, in order; null gives none."""
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), ","), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def packed(candidate: Column) -> Column:
    """Source and number of an id such as S3-17 in one integer of 40 bits."""
    number = F.split_part(candidate, F.lit("-"), F.lit(2)).try_cast("long")
    return F.shiftleft(F.when(candidate.startswith("S2-"), 0).when(candidate.startswith("S3-"), 1).cast("long"), 39) + number


def unpacked(code: Column) -> Column:
    return F.concat(F.when(F.shiftright(code, 39) == 0, "S2-").otherwise("S3-"), code.bitwiseAND(F.lit((1 << 39) - 1)).cast("string"))


ROUTES = {"neural": "neural_fusion", "neural_fusion": "neural_fusion", "tree": "tree_only", "tree_only": "tree_only", "discard": "discard"}


def route_name(route: Column, fold_case: bool = False) -> Column:
    """The canonical name of a route, null if it isn't known."""
    text = F.lower(F.trim(route)) if fold_case else route
    out = F.lit(None).cast("string")
    for alias, name in ROUTES.items():
        out = F.coalesce(out, F.when(text == alias, name))
    return out
