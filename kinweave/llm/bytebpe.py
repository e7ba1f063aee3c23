"""Byte-level BPE of whole texts, as the tokenizers library gives it, by cached words.

No pre-token of the byte-level pattern holds white space after a character that
isn't white space. A text may therefore be cut before every white space that
follows another character, and the parts encoded apart. A worker keeps the ids
of the parts it has seen (at most ``CACHE`` of them; then it starts anew), since
most words of a corpus come again and again.

New parts of Latin script are merged by tiktoken, built from the vocabulary of
the same file, which gives the same ids several times faster. All others, and
whole texts that hold a special token's string, go to the tokenizers library.

Texts that are of Latin script throughout aren't cut into words: tiktoken takes
them in slices of some ``SLICE`` characters, which costs less than to look up
each word, and keeps nothing.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np

CACHE = 600_000
SLICE = 1 << 18
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: A space after white space: where a cut before the space would be wrong.
_UNSAFE = tuple(w + " " for w in _WHITE)
_PART = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_LATIN = re.compile("[\x00-\u024f]*")
_CUT = re.compile(f"(?<=[^{_WHITE}])[{_WHITE}]")
_KNOWN: dict[str, "ByteBpe"] = {}


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _LATIN.fullmatch(text) is not None
    return True


def _slices(text: str) -> Iterator[str]:
    """A text cut before white space that follows another character, where a slice is long enough."""
    at = 0
    while len(text) - at > SLICE and (cut := _CUT.search(text, at + SLICE)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class ByteBpe:
    """Ids of texts as little-endian bytes of ``dtype`` (16 bits if they fit)."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in said["added_tokens"]]
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in token): i for token, i in said["model"]["vocab"].items() if token not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.merges = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.spaced: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}

    def _new(self, parts: list[str]) -> list[bytes]:
        latin = [_LATIN.fullmatch(p) is not None for p in parts]
        others = iter(self.library.encode_batch([p for p, own in zip(parts, latin) if not own], add_special_tokens=False))
        return [np.array(self.merges.encode_ordinary(p) if own else next(others).ids, self.dtype).tobytes() for p, own in zip(parts, latin)]

    def _look_up(self, cache: dict[str, bytes], parts: list[str], lead: str) -> list[bytes]:
        got = list(map(cache.get, parts))
        if None in got:
            new = list({p for p, g in zip(parts, got) if g is None})
            ids = dict(zip(new, self._new([lead + p for p in new])))
            if len(cache) + len(new) > CACHE:
                cache.clear()
            cache.update(ids)
            got = [ids[p] if g is None else g for p, g in zip(parts, got)]
        return got

    def ids(self, text: str) -> bytes:
        """All ids of a text, without added special tokens."""
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        if not text:
            return b""
        if _is_latin(text):
            return b"".join([np.array(self.merges.encode_ordinary(p), self.dtype).tobytes() for p in _slices(text)])
        if any(w in text for w in _UNSAFE):
            return b"".join(self._look_up(self.plain, _PART.findall(text), ""))
        first, *rest = text.split(" ")
        return b"".join([*(self._look_up(self.plain, [first], "") if first else ()), *self._look_up(self.spaced, rest, " ")])


def byte_bpe(path: str) -> ByteBpe:
    """The worker's encoder for a vocabulary file."""
    if path not in _KNOWN:
        _KNOWN[path] = ByteBpe(path)
    return _KNOWN[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
