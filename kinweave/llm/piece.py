"""SentencePiece BPE models read from their file: normaliser, merges, byte fallback.

``CharMap`` walks the compiled character map (a double-array trie followed by
its replacement strings) for the longest prefix at each place and records, for
every byte of the normalised text, the byte of the source it comes from.

``PieceBpe`` merges pre-tokens in numpy: all sequences of a batch lie end to
end in flat arrays, each step finds every sequence's lowest-rank, leftmost pair
and merges all of them at once, and sequences without a pair left drop out.
"""

from __future__ import annotations

import heapq
import re
import struct

import numpy as np

WS = "▁"
_WS = WS.encode()
CACHE = 400_000
#: Sequences of more symbols than this are merged with a heap, in n log n.
LONG = 192
_RUN = re.compile(f"{WS}+[^{WS}]*|[^{WS}]+")
_KNOWN: dict[str, "PieceBpe"] = {}


class CharMap:
    """Longest-prefix replacement through a compiled character map."""

    def __init__(self, blob: bytes):
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.strings = blob[4 + size :]
        else:
            self.units, self.strings = [], b""

    def prefix(self, text: bytes, at: int) -> tuple[bytes, int]:
        """The replacement of the longest known prefix at a place, and its source bytes.

        A character that no rule covers stays; a byte that isn't UTF-8 becomes
        U+FFFD.
        """
        best, taken = -1, 0
        if self.units:
            unit = self.units[0]
            node = (unit >> 10) << ((unit & 512) >> 6)
            for k in range(at, len(text)):
                node ^= text[k]
                unit = self.units[node]
                if unit & 0x800000FF != text[k]:
                    break
                node ^= (unit >> 10) << ((unit & 512) >> 6)
                if unit >> 8 & 1:
                    best, taken = self.units[node] & 0x7FFFFFFF, k + 1 - at
        if taken:
            return self.strings[best : self.strings.index(b"\0", best)], taken
        first = text[at]
        n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        char = text[at : at + n]
        try:
            char.decode()
        except UnicodeDecodeError:
            return b"\xef\xbf\xbd", 1
        return char, n


class Normaliser:
    """A model's normalisation with source alignment."""

    def __init__(self, spec):
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        #: Only spaces change: each becomes one white-space symbol, and one comes first.
        self.plain = not self.map.units and self.dummy and not self.squeeze and self.escape

    def __call__(self, text: bytes) -> tuple[bytes, list[int]]:
        """The normalised text, and the source byte of each of its bytes and of its end."""
        space = _WS if self.escape else b" "
        at, n = 0, len(text)
        if self.squeeze:
            while at < n and (p := self.map.prefix(text, at))[0] == b" ":
                at += p[1]
        if at >= n:
            return b"", [at]
        out = bytearray()
        align: list[int] = []
        if self.dummy:
            out += space
            align += [at] * len(space)
        after_space = self.squeeze
        while at < n:
            said, taken = self.map.prefix(text, at)
            if after_space:
                said = said.lstrip(b" ")
            if said:
                new = said.replace(b" ", space)
                out += new
                align += range(at, at + taken) if new == text[at : at + taken] else [at] * len(new)
                after_space = said.endswith(b" ")
            at += taken
            if not self.squeeze:
                after_space = False
        if self.squeeze:
            while out.endswith(space):
                at = align[len(out) - len(space)]
                del out[-len(space) :], align[-len(space) :]
        return bytes(out), [*align, at]


class PieceBpe:
    """Ids of normalised texts, exactly as the library merges them."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("a BPE model with byte fallback and without user-defined or unused pieces is needed")
        self.normaliser = Normaliser(model.normalizer_spec)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        if any(WS in p.lstrip(WS) for p in pieces):
            raise ValueError("pieces that hold white space after another character can't be cut apart")
        score = {i: model.pieces[i].score for i in pieces.values()}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        #: The symbol of each code point; -1 - c for an unknown character c.
        self.chars = -1 - np.arange(0x110000, dtype=np.int64)
        for p, i in pieces.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        self.bytes = [next(i for i, p in enumerate(model.pieces) if p.type == 6 and int(p.piece[3:5], 16) == b) for b in range(256)]
        pairs = sorted((pieces[p[:k]] << 32 | pieces[p[k:]], order[score[i]], i) for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in pieces and p[k:] in pieces)
        self.keys = np.array([k for k, _, _ in pairs], np.int64)
        self.rank = np.array([r for _, r, _ in pairs], np.int64)
        self.made = np.array([i for _, _, i in pairs], np.int64)
        self.pair = {k: (r, i) for k, r, i in pairs}
        total = len(model.pieces)
        #: UTF-8 bytes of each piece, and bytes of source text when only spaces were changed.
        self.size = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.source_size = self.size - np.array([2 * p.piece.count(WS) for p in model.pieces], np.int64)
        self.decimal = [b"%d" % i for i in range(total)]
        self.dtype = np.dtype("<u2" if total <= 1 << 16 else "<u4")
        #: Values of parts in two generations: a part that's met again moves to the younger one.
        self.cache: dict[str, object] = {}
        self.older: dict[str, object] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the table, or -1."""
        want = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where((self.keys[at] == want) & (left >= 0) & (right >= 0), at, -1)

    def merge(self, texts: list[str]) -> list[np.ndarray]:
        """The symbols that survive in each sequence; -1 - c for an unknown character c."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        sym = self.chars[np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")]
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        begin = np.cumsum(size) - size
        who = np.flatnonzero(size)
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = self._merge_long(sym[begin[i] : begin[i] + size[i]].tolist())
        keep = (size > 0) & (size <= LONG)
        who = np.flatnonzero(keep)
        sym = sym[np.repeat(keep, size)]
        size = size[who]
        none = np.int64(1) << 62
        pair = np.full(len(sym), -1, np.int64)
        if len(sym):
            pair[:-1] = self._ranks(sym[:-1], sym[1:])
            pair[np.cumsum(size) - 1] = -1
        while len(who):
            begin = np.cumsum(size) - size
            cost = np.where(pair >= 0, self.rank[pair] << 32 | np.arange(len(pair)), none)
            best = np.minimum.reduceat(cost, begin)
            done = best == none
            if done.any():
                for i, a, n in zip(who[done].tolist(), begin[done].tolist(), size[done].tolist()):
                    out[i] = sym[a : a + n]
                stay = np.repeat(~done, size)
                best = best[~done] & 0xFFFFFFFF
                best = np.cumsum(stay)[best] - 1
                sym, pair, who, size = sym[stay], pair[stay], who[~done], size[~done]
                if not len(who):
                    break
                begin = np.cumsum(size) - size
            else:
                best = best & 0xFFFFFFFF
            sym[best] = self.made[pair[best]]
            pair[best] = pair[best + 1]
            live = np.ones(len(sym), bool)
            live[best + 1] = False
            sym, pair = sym[live], pair[live]
            best = best - np.arange(len(best))
            size = size - 1
            last = np.cumsum(size) - 1
            right = best[best < last]
            pair[right] = self._ranks(sym[right], sym[right + 1])
            pair[last] = -1
            left = best[best > last + 1 - size]
            pair[left - 1] = self._ranks(sym[left - 1], sym[left])
        return out

    def _merge_long(self, sym: list[int]) -> np.ndarray:
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def push(a: int) -> None:
            b = after[a]
            if b < n and sym[a] >= 0 and sym[b] >= 0 and (found := self.pair.get(sym[a] << 32 | sym[b])):
                heapq.heappush(heap, (found[0], a, sym[a], sym[b]))

        gone = [False] * n
        for a in range(n - 1):
            push(a)
        while heap:
            _, a, x, y = heapq.heappop(heap)
            if gone[a] or sym[a] != x or (b := after[a]) >= n or sym[b] != y:
                continue
            sym[a] = self.pair[x << 32 | y][1]
            gone[b] = True
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            push(a)
            if before[a] >= 0:
                push(before[a])
        return np.array([s for s, g in zip(sym, gone) if not g], np.int64)

    def with_bytes(self, symbols: np.ndarray) -> np.ndarray:
        """Ids: unknown characters become the pieces of their bytes."""
        if (symbols >= 0).all():
            return symbols
        return np.array([i for s in symbols.tolist() for i in ([s] if s >= 0 else [self.bytes[b] for b in chr(-1 - s).encode()])], np.int64)

    def packed(self, symbols: list[np.ndarray]) -> list[bytes]:
        """The ids of each sequence, as bytes of ``dtype``."""
        flat, end = _joined(symbols)
        if len(odd := np.flatnonzero(flat < 0)):
            symbols = list(symbols)
            for i in np.unique(np.searchsorted(end, odd, "right")).tolist():
                symbols[i] = self.with_bytes(symbols[i])
            flat, end = _joined(symbols)
        raw = flat.astype(self.dtype).tobytes()
        cut = [0, *(end * self.dtype.itemsize).tolist()]
        return [raw[a:b] for a, b in zip(cut, cut[1:])]

    def counts(self, symbols: list[np.ndarray]) -> list[int]:
        """The number of ids of each sequence."""
        flat, end = _joined(symbols)
        n = np.diff(end, prepend=0)
        if len(odd := np.flatnonzero(flat < 0)):
            unknown = -1 - flat[odd]
            more = (unknown >= 0x80).astype(np.int64) + (unknown >= 0x800) + (unknown >= 0x10000)
            np.add.at(n, np.searchsorted(end, odd, "right"), more)
        return n.tolist()

    @staticmethod
    def parts(normalised: str) -> list[str]:
        """Runs that no merge crosses: each white-space run with what follows it."""
        if WS + WS in normalised or " " in normalised or not normalised.startswith(WS):
            return _RUN.findall(normalised)
        return normalised.replace(WS, " " + WS)[1:].split(" ")

    def look_up(self, normalised: list[str], values) -> list[list]:
        """For each text the values of its parts; ``values`` makes them from sequences of symbols."""
        cut = [self.parts(t) if t else [] for t in normalised]
        get = self.cache.get
        got = [list(map(get, own)) for own in cut]
        new = {p for own, g in zip(cut, got) if None in g for p, x in zip(own, g) if x is None}
        if new:
            fresh = {p: x for p in new if (x := self.older.get(p)) is not None}
            new = list(new.difference(fresh))
            for at in range(0, len(new), 50_000):
                part = new[at : at + 50_000]
                fresh.update(zip(part, values(self.merge(part))))
            if len(self.cache) + len(fresh) > CACHE // 2:
                self.older, self.cache = self.cache, {}
            self.cache.update(fresh)
            got = [[fresh[p] if x is None else x for p, x in zip(own, g)] if None in g else g for own, g in zip(cut, got)]
        return got


def _joined(symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All sequences end to end, and where each ends."""
    return np.concatenate([np.zeros(0, np.int64), *symbols]), np.cumsum(np.fromiter(map(len, symbols), np.int64, len(symbols)))


def piece_bpe(path: str, use: str) -> PieceBpe:
    """The worker's encoder for a model file; ``use`` keeps caches of unlike values apart."""
    if (key := f"{use}:{path}") not in _KNOWN:
        _KNOWN[key] = PieceBpe(path)
    return _KNOWN[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
