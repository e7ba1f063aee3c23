import hashlib
import random
import re
import time

from kinweave.llm import pii

from .conftest import prose, rows_of


def luhn(digits):
    total = 0
    for k, c in enumerate(digits[::-1]):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans():
    rng = random.Random(2)
    parts = ["a", "b@", "@", ".", "x.y", "1", "22", "333", "+", "+1", " ", "-", "4111111111111111", "é", "(", ")", "%", "1.2.3.4", "٣", "000000255"]
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        own = pii.base_spans(text)
        assert own == brute(text), text
        seen = pii.candidates(text.encode(), text, own)
        assert all(a < b <= len(text) and b0 <= a for (a, b, *_), b0 in zip(seen, [0, *(c[1] for c in seen)])), text
    assert pii.base_spans("9" * 200_000 + "." * 1000 + "a" * 200_000 + "@") == []


def corpus(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        text = prose(rng, 30)
        if i < 12:
            text += f" kindly write to user{i}@mail.example.com today " + prose(rng, 5)
        elif i < 16:
            text += f" kindly write to handle-{i}77 today " + prose(rng, 5)
        elif i < 20:
            text += f" built in year-{i}77 today " + prose(rng, 5)
        elif i < 22:
            text += f" call +1 (555) 010-99{i} or 10.0.0.{i}"
        rows.append((i, text, "en", "s", len(text)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_contexts_discover_unseen_identifiers(spark):
    own = corpus(spark)
    found = {r["doc_id"]: r for r in pii.find_pii(own).collect()}
    text = {r["doc_id"]: r["text"] for r in own.collect()}
    for i, r in found.items():
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"]] == brute(text[i])
        extra = [text[i][s["start"] : s["end"]] for s in r["extra"]]
        assert extra == ([f"handle-{i}77"] if 12 <= i < 16 else [])
    clean = {r["doc_id"]: r["text"] for r in pii.redact(own).collect()}
    assert "<EMAIL>" in clean[3] and "@" not in clean[3]
    assert "<ID>" in clean[13] and "handle" not in clean[13]
    assert "<PHONE>" in clean[20] and "<IP>" in clean[20]
    assert all(clean[i] == text[i] for i in [*range(16, 20), *range(22, 120)])


def test_long_texts_take_linear_time():
    began = time.perf_counter()
    run = "1" + "語" * 300_000 + " mail a@b.cd " + "x" * 1_000_000
    assert [c[2] for c in pii.candidates(run.encode(), run, pii.base_spans(run))] == [False, True]
    many = " ".join(f"u{i}@mail.example.com id-{i}00" for i in range(20_000))
    assert len(pii.candidates(many.encode(), many, pii.base_spans(many))) == 40_000
    assert time.perf_counter() - began < 5


def secrets(spark):
    """Cues that stand before hexadecimal seeds, before other tokens, far before a value, and before words."""
    rng = random.Random(6)
    rows = []
    for i in range(60):
        value = f"{rng.getrandbits(60) | 1 << 59:015x}a1"
        if i >= 40:
            value = f"Hunter!{i}" if i < 45 else "correcthorse" if i < 47 else ("z9" * 400 if i == 47 else value)
        rows.append((i, prose(rng, 20) + f' Passwörd={value} und token = "{value}" ' + "y" * 500 + " " + prose(rng, 5), "de", "s", 0))
    rows += [(100, "the key AKIA" + "Q7" * 8 + " is out", "en", "s", 0), (101, f"deadbeef{1:09d} alone " + prose(rng, 9), "en", "s", 0), (102, "see Hunter!42 again " + prose(rng, 9), "en", "s", 0)]
    rows += [(200 + i, f"word = {prose(rng, 1)} and token '{prose(rng, 3)}'", "en", "s", 0) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_cues_discover_secrets(spark):
    own = secrets(spark)
    text = {r["doc_id"]: r["text"] for r in own.collect()}
    extra = {r["doc_id"]: [text[r["doc_id"]][s["start"] : s["end"]] for s in r["extra"]] for r in pii.find_pii(own).collect()}
    for i in range(60):
        value = re.search("Passwörd=([^ ]+)", text[i])[1]
        assert extra[i] == [value, value], i
    assert extra[100] == ["AKIA" + "Q7" * 8] and extra[101] == [] and extra[102] == ["Hunter!42"]
    assert not any(extra[200 + i] for i in range(40))


def test_pii_edges(docs, clashing, empty):
    got = pii.find_pii(docs)
    assert got.count() == docs.count()
    assert rows_of(got) == rows_of(pii.find_pii(clashing))
    assert pii.find_pii(empty).count() == 0 and pii.redact(empty).count() == 0
    assert pii.redact(clashing).columns == clashing.columns
    assert rows_of(pii.redact(docs)) == rows_of(docs), "nothing to redact"


def test_query_columns(spark, tmp_path):
    corpus(spark).write.parquet(f"{tmp_path}/documents.parquet")
    row = pii.op9_pii(spark, str(tmp_path)).where("doc_id = 20").first()
    text = corpus(spark).where("doc_id = 20").first()["text"]
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(text))
    assert row["spans"] == joined and row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
