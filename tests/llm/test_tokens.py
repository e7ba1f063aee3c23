import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from sentencepiece import SentencePieceNormalizer
from sentencepiece import sentencepiece_model_pb2 as pb
from tokenizers import Tokenizer

from kinweave.llm import bytebpe, packing, piece, pieces, tokenfile

from .conftest import rows_of

BYTE, PIECE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["", " ", "a  b", "a \n b\n\n c", "x<|endoftext|>y", "日本語　 テスト", "don't  we'll\t\tx", "a\x1cb \x1d c\x1f ", "1½ 2² ª", " a b", "▁a ▁▁b", "😀\x00é", "x" * 700, " " * 500 + "q", "ab" * 300 + "の" * 200, "<s>x</s><0x41>"]


def odd_texts():
    rng = random.Random(2)
    return ODD + ["".join(rng.choice("abeth in▁ \nérô😀'’2 ") for _ in range(rng.randint(0, 300))) for _ in range(200)]


def test_byte_bpe_is_the_library():
    own, library = bytebpe.ByteBpe(BYTE), Tokenizer.from_file(BYTE)
    for text in odd_texts():
        assert np.frombuffer(own.ids(text), own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("size", [3, 1 << 18])
def test_latin_texts_go_whole_to_tiktoken(monkeypatch, size):
    """Latin texts in slices give the library's ids and leave nothing in the caches."""
    monkeypatch.setattr(bytebpe, "SLICE", size)
    own, library = bytebpe.ByteBpe(BYTE), Tokenizer.from_file(BYTE)
    rng = random.Random(8)
    signs = [chr(c) for c in range(0x250)] + list("  \n\t \x85\xa0'stm") * 12
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 200))) for _ in range(600)] + ["a" * 900 + " b", " " * 700, "x  y \n z"]
    for text in texts:
        assert "".join(bytebpe._slices(text)) == text
        assert np.frombuffer(own.ids(text), own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)
    assert not own.plain and not own.spaced
    assert size > 3 or len(list(bytebpe._slices("aa bb cc  dd"))) == 3


def test_image_round_trip():
    rng = np.random.default_rng(4)
    for n in (0, 1, 1023, 1024, 1025, 9000):
        for high in (1, 2, 50_000, 2**32 - 1):
            ids = rng.integers(0, high, n, dtype=np.uint32)
            ids[::97] = high
            image = tokenfile.ImageReader(tokenfile.write_image([5, None, 7], [n // 2, 0, n - n // 2], ids))
            assert (image.all_ids() == ids).all() and image.doc_ids == [5, None, 7]
            assert (image.slice(n // 3, n // 2) == ids[n // 3 : n // 2]).all()
    broken = bytearray(tokenfile.write_image([1], [3], np.arange(3, dtype=np.uint32)))
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        tokenfile.ImageReader(bytes(broken))


def test_token_files(docs, clashing, empty, monkeypatch):
    monkeypatch.setattr(tokenfile, "IMAGE_IDS", 500)
    library = Tokenizer.from_file(BYTE)
    rows = sorted(((r["doc_id"], r["h"], r["text"] or "") for r in docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, at = [], 0
    for i, _, text in rows:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = tokenfile.token_files(docs, BYTE)
    assert rows_of(got) == sorted(want, key=repr)
    assert rows_of(tokenfile.token_files(clashing, BYTE)) == sorted(want, key=repr)
    assert tokenfile.token_files(empty, BYTE).count() == 0


def test_read_documents(spark, docs, tmp_path, monkeypatch):
    """Single documents through the block index; other images aren't read."""
    monkeypatch.setattr(tokenfile, "IMAGE_IDS", 500)
    library, path = Tokenizer.from_file(BYTE), f"{tmp_path}/images"
    tokenfile.write_tokens(docs, path, BYTE, 0)
    wanted = [7, 3, 50, None, 10**6]
    want = sorted((r["doc_id"], [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in docs.collect() if r["doc_id"] in (3, 7, 50))
    assert sorted((r["doc_id"], r["ids"]) for r in tokenfile.read_documents(spark, path, wanted).collect()) == want
    assert tokenfile.read_documents(spark, path, [None]).count() == 0
    images = spark.read.parquet(path)
    assert images.where("first_id <= 3 AND last_id >= 3").count() < images.count()


def test_a_hundred_thousand_equal_rows(spark, tmp_path):
    """Equal rows without an id don't meet in one range or shard."""
    same = spark.range(100_000).selectExpr("CAST(NULL AS long) AS doc_id", "'the same few words' AS text").repartition(4)
    n = len(Tokenizer.from_file(BYTE).encode("the same few words", add_special_tokens=False).ids) + 1
    tokenfile.write_tokens(same, f"{tmp_path}/images", BYTE, 0)
    parts = {r["part"]: r["n"] for r in spark.read.parquet(f"{tmp_path}/images").groupBy("part").agg({"n_ids": "sum"}).withColumnRenamed("sum(n_ids)", "n").collect()}
    assert len(parts) == 4 and max(parts.values()) < 50_000 * n
    starts = sorted(r["start"] for r in tokenfile.read_tokens(spark, f"{tmp_path}/images").select("start").collect())
    assert starts == list(range(0, 100_000 * n, n))
    packed = packing.pack_documents(same, BYTE, shard_bytes=64_000).selectExpr("shiftright(sequence_id, 32) AS shard", "length").groupBy("shard").agg({"length": "sum"}).collect()
    assert sum(r[1] for r in packed) == 100_000 * n and len(packed) > 20 and max(r[1] for r in packed) < 15_000 * n


def test_pack_covers_everything():
    rng = random.Random(6)
    for _ in range(200):
        lengths = [rng.choice([0, 1, 2, rng.randint(1, 300), rng.randint(1, 9000)]) for _ in range(rng.randint(0, 50))]
        pieces_of = defaultdict(list)
        for sequence in packing.pack(lengths):
            total = sum(n for _, _, n in sequence)
            assert 0 < total <= 2048 and total & (total - 1) == 0
            for doc, start, n in sequence:
                assert n > 0
                pieces_of[doc].append((start, n))
        for doc, length in enumerate(lengths):
            at = 0
            for start, n in sorted(pieces_of[doc]):
                assert start == at
                at += n
            assert at == length


def test_step_groups_are_level():
    rng = random.Random(7)
    sizes = [rng.choice([256, 512, 1024, 2048]) for _ in range(400)]
    groups = packing.step_groups(sizes)
    totals = defaultdict(int)
    for s, g in zip(sizes, groups):
        totals[g] += s
    assert max(totals.values()) - min(totals.values()) <= 2048


def test_pack_documents(docs, clashing, empty):
    library = Tokenizer.from_file(BYTE)
    got = packing.pack_documents(docs, BYTE, shard_bytes=20_000).collect()
    tokens = defaultdict(list)
    for r in docs.collect():
        tokens[r["doc_id"]].append(np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4"))
    sequences = defaultdict(list)
    for r in got:
        crcs = [zlib.crc32(t[r["start"] : r["start"] + r["length"]].tobytes()) for t in tokens[r["doc_id"]]]
        assert r["ids_crc32"] in crcs and r["doc_tokens"] in [len(t) for t in tokens[r["doc_id"]]]
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["window"]))
    assert sum(r["length"] for r in got) == sum(len(t) for own in tokens.values() for t in own)
    for own in sequences.values():
        at = 0
        for offset, length, window in sorted(own):
            assert offset == at
            at += length
        assert at == window and window & (window - 1) == 0 and window <= 2048
    assert sum(r["length"] for r in packing.pack_documents(clashing, BYTE).collect()) == sum(r["length"] for r in got)
    assert packing.pack_documents(empty, BYTE).count() == 0


def test_piece_encoding_is_the_library():
    model, library = piece.PieceBpe(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = odd_texts()
    for text, (ids, spans, decimal) in zip(texts, pieces.encode_texts(model, [t.encode() for t in texts])):
        raw = text.encode()
        assert ids.tolist() == library.encode(text), text
        assert decimal.decode() == ",".join(map(str, ids.tolist()))
        at = 0
        for (a, b), i in zip(spans.tolist(), ids.tolist()):
            assert a == at <= b
            at = b
            said = library.id_to_piece(i)
            if said.startswith("<0x"):
                assert raw[a:b] == bytes([int(said[3:5], 16)])
            else:
                assert raw[a:b].decode().replace(" ", "▁").lstrip("▁") == said.lstrip("▁")
        assert at == len(raw)


def test_long_and_short_merges_agree(monkeypatch):
    model = piece.PieceBpe(PIECE)
    texts = ["▁" + "".join(random.Random(k).choice("thein anodr") for _ in range(150)).replace(" ", "") for k in range(30)]
    short = [x.tolist() for x in model.merge(texts)]
    monkeypatch.setattr(piece, "LONG", 1)
    assert [x.tolist() for x in model.merge(texts)] == short


@pytest.mark.parametrize("change", [{}, {"remove_extra_whitespaces": False}, {"add_dummy_prefix": False}, {"escape_whitespaces": False}])
def test_normaliser_with_a_compiled_map(change):
    library = SentencePieceNormalizer(rule_name="nmt_nfkc", **({"add_dummy_prefix": True, "escape_whitespaces": True, "remove_extra_whitespaces": True} | change))
    proto = pb.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    own = piece.Normaliser(proto.normalizer_spec)
    for text in [*odd_texts(), "ＡＢ  ½ é ﬁ\t x ", "ｶﾞ ㌔ 　x　"]:
        out, align = own(text.encode())
        assert out.decode() == library.normalize(text)
        assert len(align) == len(out) + 1 and align == sorted(align) and align[-1] <= len(text.encode())


def test_encoding_with_a_compiled_map(spark, docs, tmp_path):
    """The query's path over a model whose map changes texts: ids, decoded texts and spans of the source."""
    proto, other = pb.ModelProto(), pb.ModelProto()
    proto.ParseFromString(open(PIECE, "rb").read())
    other.ParseFromString(SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True).serialized_model_proto())
    proto.normalizer_spec.CopyFrom(other.normalizer_spec)
    path = tmp_path / "mapped.model"
    path.write_bytes(proto.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = [*odd_texts(), "ＡＢ  ½ é ﬁ\t x ", "ｶﾞ ㌔ 　x　"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pieces.encode_pieces(rows, str(path)).collect():
        text = texts[r["doc_id"]]
        assert r["ids"] == library.encode(text) and r["decoded"] == library.decode(r["ids"]), text
        assert r["begins"][1:] == r["ends"][:-1] and all(a <= b for a, b in zip(r["begins"], r["ends"])) and (not r["ends"] or r["ends"][-1] <= len(text.encode()))
    assert {r["doc_id"]: r["n_tokens"] for r in pieces.token_counts(rows, str(path)).collect()} == {i: len(library.encode(t)) for i, t in enumerate(texts)}


def test_values_of_many_parts_at_once(monkeypatch):
    """Ids and counts of all new parts come from one call, unknown characters as bytes."""
    model, library = piece.PieceBpe(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    words = ["the", "\U00013000", "a\U00013000\u0600b", "\x00", "house", "\u07ff\uffff", "日本語"]
    symbols = model.merge(["▁" + w for w in words])
    assert [np.frombuffer(x, model.dtype).tolist() for x in model.packed(symbols)] == [library.encode(w) for w in words]
    assert model.counts(symbols) == [len(library.encode(w)) for w in words]
    assert model.packed([]) == [] and model.counts([]) == []
    calls = []
    monkeypatch.setattr(model, "packed", lambda s, packed=model.packed: calls.append(len(s)) or packed(s))
    list(pieces.encode_texts(model, [" ".join(words).encode(), b"the other house"]))
    assert calls == [len(words) + 1]


def test_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(piece, "CACHE", 40)
    model, library = piece.PieceBpe(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for text in odd_texts():
        (ids, _, _), = pieces.encode_texts(model, [text.encode()])
        assert ids.tolist() == library.encode(text)


def test_encode_pieces(docs, clashing, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for r in pieces.encode_pieces(docs, PIECE).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r["ids"] == library.encode(r["text"] or "") and r["decoded"] == library.decode(r["ids"])
    assert rows_of(pieces._encoded(docs, PIECE, True)) == rows_of(pieces._encoded(clashing, PIECE, True))
    row = pieces._encoded(docs.where("doc_id = 3"), PIECE, True).first()
    ids = library.encode(docs.where("doc_id = 3").first()["text"])
    assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.encode_pieces(empty, PIECE).count() == 0


def test_token_counts(docs, clashing, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = []
    for r in docs.collect():
        n = len(library.encode(r["text"] or ""))
        want.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 4096))
    assert rows_of(pieces.token_counts(docs, PIECE)) == sorted(want, key=repr)
    assert rows_of(pieces.token_counts(clashing, PIECE)) == sorted(want, key=repr)
    assert pieces.token_counts(empty, PIECE).count() == 0
