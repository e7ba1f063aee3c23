"""Text columns: normalisation, tokens, n-grams and the parts of names and addresses."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BooleanType, StringType

# The words and patterns that results depend on.
LEGAL_FORM = (
    r"\b(ltd|limited|llc|llp|inc|incorporated|corp|corporation|co|company|"
    r"pvt|private|pllc|plc|gmbh|sa|sas|srl|bv|nv|ag|kg|pty)\b\.?"
)
HOUSE_NUMBER = r"^\s*(?:[#]\s*\S+\s+)?(\d{1,6}(?:/\d{1,6})?[a-zA-Z]?)\b"
UNIT = r"\b(?:apt|apartment|unit|suite|ste|fl|floor|#)\s*[.:#-]?\s*(\w+)"
POSTCODE = r"\b(\d{4,10}(?:-\d{3,4})?)\b"
NAME_ALIASES = ("business_name", "name", "company_name", "商号")
ADDRESS_ALIASES = ("business_address", "address", "street_address", "所在地")
COUNTRY_ALIASES = ("country", "country_code", "国")

_ASCII = r"^[\x00-\x7F]*$"


def normalise_value(text: str | None) -> str:
    """NFKC, case folding, '&' as a word, punctuation and symbols to spaces, runs of space to one."""
    if text is None:
        return ""
    folded = unicodedata.normalize("NFKC", text).casefold().replace("&", " and ")
    return " ".join("".join(" " if unicodedata.category(c)[0] in "PS" else c for c in folded).split())


def _normalise_series(text: pd.Series) -> pd.Series:
    return text.map(normalise_value, na_action="ignore")


normalise_unicode = F.pandas_udf(_normalise_series, StringType())


def normalise_ascii(text: Column) -> Column:
    """The same for texts of ASCII characters alone, in built-in functions."""
    spaced = F.regexp_replace(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")), r"[!-/:-@\[-`{-~]", " ")
    return F.trim(F.regexp_replace(spaced, r"[\x09-\x0D\x1C-\x20]+", " "))


def normalise(text: Column | str) -> Column:
    """Normalised text, never null. Only texts beyond ASCII are sent to Python."""
    text = F.col(text) if isinstance(text, str) else text
    plain = text.rlike(_ASCII)
    other = normalise_unicode(F.when(~plain, text))
    return F.coalesce(F.when(plain, normalise_ascii(text)), other, F.lit(""))


def words(text: Column) -> Column:
    """White-space separated words, in order."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_set(text: Column) -> Column:
    """Distinct lower-cased words."""
    return F.array_distinct(words(F.lower(text)))


def char_ngrams(text: Column, low: int, high: int | None = None) -> Column:
    """All n-grams for n from ``low`` to ``high``, repeats kept; shorter texts have none of a length."""
    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.char_length(text) - (n - 1), F.lit(1)))
        return F.when(F.char_length(text) >= n, F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(of, range(low, (high or low) + 1)))


def word_ngrams(text: Column) -> Column:
    """Words and neighbouring pairs of words."""
    own = words(text)
    pairs = F.when(F.size(own) > 1, F.zip_with(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(1))), F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(own, pairs)


def compact_trigrams(text: Column) -> Column:
    """Distinct 3-grams after spaces are removed."""
    return F.array_distinct(char_ngrams(F.replace(text, F.lit(" "), F.lit("")), 3))


def digit_runs(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)(\d+)"), 1))


def core_name(name: Column) -> Column:
    """A name without its legal forms."""
    return F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), "(?iU)" + LEGAL_FORM, ""))


def has_legal_form(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).rlike("(?iU)" + LEGAL_FORM)


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1), F.lit(""))


def house_number(address: Column) -> Column:
    return _first(address, "(?U)" + HOUSE_NUMBER)


def unit_number(address: Column) -> Column:
    return _first(address, "(?iU)" + UNIT)


def postcode(address: Column, house: Column) -> Column:
    """The last postcode-like number that isn't the house number."""
    found = F.regexp_extract_all(F.coalesce(address, F.lit("")), F.lit("(?U)" + POSTCODE), 1)
    return F.try_element_at(F.filter(found, lambda p: house.isNull() | (p != house)), F.lit(-1))


def plain_number(token: Column) -> Column:
    """A number token with lower-cased letters and no leading zeros."""
    return F.regexp_replace(F.lower(token), r"^0+(?=\d)", "")


def initials(tokens: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(tokens, lambda t: F.substring(t, 1, 1))), "")


def non_ascii(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\x00-\x7F]"), F.lit(False))


def _marks(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t is not None and any(unicodedata.category(c) == "Mn" for c in unicodedata.normalize("NFD", t)))


def _not_nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t is not None and unicodedata.normalize("NFC", t) != t)


has_diacritics = F.pandas_udf(_marks, BooleanType())
changed_by_nfc = F.pandas_udf(_not_nfc, BooleanType())


def first_present(columns: list[str], aliases: tuple[str, ...]) -> Column:
    """The first of the aliases that the table has, else the empty text."""
    own = next((a for a in aliases if a in columns), None)
    return F.coalesce(F.col(f"`{own}`").cast("string"), F.lit("")) if own else F.lit("")


def pair_text(*fields: str, separator: str = " || ") -> Column:
    """Fields of a pair in one text; null counts as empty."""
    return F.concat_ws(separator, *(F.coalesce(F.col(f), F.lit("")) for f in fields))


def cut_field(fields: list[str], budget: int, separator: str = " || ") -> Column:
    """The field in which a budget of UTF-8 bytes ends, or null if all fit."""
    out, used = F.lit(None).cast("string"), F.lit(0)
    for k, f in enumerate(fields):
        used = used + F.octet_length(F.coalesce(F.col(f), F.lit(""))) + (len(separator.encode()) if k else 0)
        out = F.coalesce(out, F.when(used > budget, F.lit(f)))
    return out
