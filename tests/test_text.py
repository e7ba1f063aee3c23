import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions import ids, similarity as S, text as T


def column(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").orderBy("i")
    return [r[0] for r in rows.select(expression(F.col("x"))).collect()]


@pytest.mark.parametrize("raw,want", [
    ("  Café & Co., 12-A  ", "café and co 12 a"), ("東京　商店 ４２", "東京 商店 42"), ("a$b+c<d=e>f^g`h|i~j", "a b c d e f g h i j"),
    ("Straße", "strasse"), (None, ""), ("", ""), ("x\x1cy\tz", "x y z"), ("ﬁne Ⅳ", "fine iv"),
])
def test_normalise(spark, raw, want):
    assert column(spark, [raw], T.normalise) == [want]
    assert T.normalise_value(raw) == want


def test_ascii_path_equals_unicode_path(spark):
    rng = random.Random(1)
    values = ["".join(chr(rng.randint(0, 127)) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    assert column(spark, values, T.normalise) == [T.normalise_value(v) for v in values]


def test_ngrams(spark):
    assert column(spark, ["abc", "a", "", "ab"], lambda c: T.char_ngrams(c, 2, 3)) == [["ab", "bc", "abc"], [], [], ["ab"]]
    assert column(spark, ["a b c", "a"], T.word_ngrams) == [["a", "b", "c", "a b", "b c"], ["a"]]
    assert column(spark, ["a bcd", "ab"], T.compact_trigrams) == [["abc", "bcd"], []]


def test_address_parts(spark):
    addresses = ["12 Main St 560001", "#469 3/1367 Road 560-0011", "Unit 5 Some Lane", "0280b High St, apt 7", "", "12345 only 12345"]
    assert column(spark, addresses, T.house_number) == ["12", "3/1367", None, "0280b", None, "12345"]
    assert column(spark, addresses, T.unit_number) == [None, None, "5", "7", None, None]
    assert column(spark, addresses, lambda c: T.postcode(c, T.house_number(c))) == ["560001", "0011", None, None, None, None]
    assert column(spark, ["0280B", "3/1367", "000", "7a"], T.plain_number) == ["280b", "3/1367", "0", "7a"]


def test_names(spark):
    names = ["Acme Ltd.", "Acme GmbH", "Acme", None]
    assert column(spark, names, T.core_name) == ["Acme", "Acme", "Acme", ""]
    assert column(spark, names, T.has_legal_form) == [True, True, False, False]
    assert column(spark, ["b a c"], lambda c: T.initials(T.word_set(c))) == ["abc"]


def test_identifiers(spark):
    import hashlib

    values = [f"S2-{i}" for i in range(50)] + ["x", "é"]
    rank = [int(hashlib.sha256(f"42:{v}".encode()).hexdigest()[:16], 16) for v in values]
    full = [int(hashlib.sha256(f"42:{v}".encode()).hexdigest(), 16) for v in values]
    assert [int(x) for x in column(spark, values, lambda c: ids.stable_rank(c, 42))] == rank
    assert column(spark, values, ids.hash_fold) == [r % 3 for r in rank]
    assert column(spark, values, lambda c: ids.stable_bucket(c, 17)) == [r % 17 for r in full]
    assert column(spark, ["S2-7", "S3-007", "S1-1", "q"], ids.candidate_source) == ["S2", "S3", None, None]
    assert column(spark, ["S2-7", "S3-9"], lambda c: ids.unpacked(ids.packed(c))) == ["S2-7", "S3-9"]
    assert column(spark, [" a, b,,a ", "", None], ids.id_list) == [["a", "b"], [], []]
    assert column(spark, ["neural", "tree", "TREE", "x"], ids.route_name) == ["neural_fusion", "tree_only", None, None]
    assert column(spark, [" Tree "], lambda c: ids.route_name(c, True)) == ["tree_only"]


def test_ratios():
    rng = random.Random(5)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for _ in range(400):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 30))) for _ in range(2))
        assert S.lcs_length(a, b) == lcs(a, b)
    assert S.indel_ratio("", "") == 1.0 and S.indel_ratio("abc", "") == 0.0
    assert S.sorted_words_ratio("b a", "a b") == 1.0
    assert S.best_window_ratio("acme", "the acme shop") == 1.0 and S.best_window_ratio("", "x") == 0.0
    assert S.matching_blocks_ratio("abcd", "bcde") == 0.75


def test_pair_features(spark):
    rows = [
        ("S1-1", "S2", "S2-1", "Tokyo Shop 42", "1 Road", "JP", "Shop Tokyo 42", "1 Road", "jp"),
        ("S1-1", "S3", "S3-1", "Acme 1", "", "", "Acme 2", None, "US"),
        ("S1-2", "S2", "S2-2", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "source1_entity_id string, candidate_source string, candidate_entity_id string, name_a string, address_a string, country_a string, name_b string, address_b string, country_b string")
    got = {r["candidate_entity_id"]: r for r in S.pair_features(df).collect()}
    a, b, c = got["S2-1"], got["S3-1"], got["S2-2"]
    assert a["name_exact"] == 0 and a["name_token_sort_ratio"] == 1 and a["name_token_jaccard"] == 1 and a["address_exact"] == 1 and a["country_exact"] == 1 and a["candidate_source_s2"] == 1
    assert b["name_number_conflict"] == 1 and b["address_both_missing"] == 1 and b["country_exact"] == 0 and b["combined_name_address_similarity"] == b["name_sequence_ratio"]
    assert c["name_both_missing"] == 1 and c["combined_name_address_similarity"] == 0 and c["country_exact"] == 0


def test_string_features(spark):
    rows = [
        ("p1", "Acme Ltd", "Acme Branch Ltd", "12 High St 560001", "12 High St 560001"),
        ("p2", "Acme Ltd", "Acme Inc", "12 High St 560001", "14 High St 560001"),
        ("p3", "Acme", "Zeta", "", "5 Low Rd"), ("p4", None, None, None, None),
    ]
    got = {r["id"]: r for r in S.string_features(spark.createDataFrame(rows, "id string, name_a string, name_b string, address_a string, address_b string")).collect()}
    assert got["p1"]["name_tokens_extra_in_b"] == 1 and got["p1"]["house_number_match"] == 1 and got["p1"]["postcode_match"] == 1 and got["p1"]["legal_form_agreement"] == 1
    assert got["p2"]["house_number_match"] == 0 and got["p2"]["postcode_match_house_mismatch"] == 1 and got["p2"]["name_core_similarity"] == 1
    assert got["p3"]["address_raw_similarity"] is None and got["p3"]["house_number_match"] == -1 and got["p3"]["strong_name_contradictory_address"] == 0 and got["p3"]["address_a_missing"] == 1
    assert got["p4"]["name_token_jaccard"] == 1.0 and got["p4"]["name_initials_match"] == 1 and got["p4"]["address_carries_despite_name_conflict"] is None
    assert got["p1"]["rare_token_disagreement"] == 1
