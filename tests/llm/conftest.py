import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ra", "tu") for b in ("ber", "den", "fol", "gis", "hum", "jor", "ket", "lam")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts():
    """Texts that try an operator: copies, near copies, null, empty, long, odd characters."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(30, 200)) for _ in range(40)]
    out = list(base)
    out += [base[0], base[0] + " ", base[1].replace(" ", "\n"), base[2].upper(), None, "", " \t\n", "one two three", "word"]
    out += [base[3] + " extra", "changed " + base[4], base[5][: len(base[5]) // 2]]
    out += [prose(rng, 6000), "x" * 5000, "\n".join(["same line here"] * 20), "日本語 のテスト 😀 é", "a<|endoftext|>b  c", "▁a ▁b", "  two  spaces  ", "tab\tnew\nline\r\n"]
    return out


@pytest.fixture(scope="session")
def all_texts():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, all_texts):
    rows = [(i, t, "en" if i % 3 else "de", f"src{i % 2}", len(t or "")) for i, t in enumerate(all_texts)]
    rows += [(None, "no id here at all", None, None, None), (None, None, None, None, None), (7, all_texts[7], "en", "src1", 3), (7, all_texts[7], "en", "src1", 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, docs):
    """The same rows with further columns, named like those that operators make."""
    out = docs
    for name in ("fp", "digest", "component_id", "keep_id", "group_size", "kept", "ids", "score", "held_out", "n_words", "spans", "key", "batch", "slice", "_digest", "n_points", "window", "start"):
        out = out.selectExpr("*", f"'x' AS `{name}`")
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
