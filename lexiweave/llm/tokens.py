"""Packed tokenisation: the tokenizers library encodes each distinct piece once, documents are put together from packed ids.

A byte-level BPE never merges across the pieces that its pre-tokenizer cuts, so ids of a text are those of its pieces
in order. Texts are cut as arrays of code points, many at a time: a piece is looked up by the hash of its characters in a table of
open addresses, whose entries are the ids that the library's model gave for it. Pieces longer than LONG are looked up as they are,
as a hash of so simple a kind is not good enough for them. Texts with a special token's string or with characters outside the basic
plane are encoded by the library as they are.
"""

from __future__ import annotations

import struct
import unicodedata

import numpy as np

from .common import kept
from .hashes import mixed, prefix

#: Entries of a worker's table; beyond that it starts again. Characters that are cut at a time, and those of a long piece.
CACHE_SIZE, CHARACTERS, LONG = 850_000, 400_000, 48
LETTER, NUMBER, SPACE, OTHER, BREAK = range(5)
_BASE = np.uint64(0xA24BAED4963EE407)


def default_tokenizer() -> str:
    """Path of the public byte-level vocabulary; a parameter everywhere, never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _kinds() -> np.ndarray:
    """The kind of each character of the basic plane; what lies beyond breaks texts apart."""
    out = np.full(0x10001, OTHER, np.uint8)
    for c in range(0x10000):
        major = unicodedata.category(chr(c))[0]
        if major in "LN":
            out[c] = LETTER if major == "L" else NUMBER
    # fixed values: white space of regular expressions over Unicode
    for a, b in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[a : b + 1] = SPACE
    out[0x10000] = BREAK
    return out


class Table:
    """Hashes to entries, an entry to its ids."""

    def __init__(self, size: int):
        bits = (2 * size - 1).bit_length()
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.entries = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash (none is zero), or -1."""
        slot = (h & self.mask).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.entries[slot], np.int32(-1))
        open_ = np.flatnonzero((key != h) & (key != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(self.mask)
            key = self.keys[slot[open_]]
            same = key == h[open_]
            out[open_[same]] = self.entries[slot[open_[same]]]
            open_ = open_[~same & (key != 0)]
        return out

    def add(self, packed: list[bytes]) -> np.ndarray:
        """New entries for ids as little-endian 32-bit integers."""
        new, n = np.frombuffer(b"".join(packed), "<u4"), len(packed)
        sizes = np.asarray([len(p) // 4 for p in packed], np.int32)
        self.ids = _room(self.ids, self.used + len(new))
        self.start, self.length = _room(self.start, self.n + n), _room(self.length, self.n + n)
        self.ids[self.used : self.used + len(new)] = new
        self.start[self.n : self.n + n] = self.used + np.cumsum(sizes) - sizes
        self.length[self.n : self.n + n] = sizes
        self.used, self.n = self.used + len(new), self.n + n
        return np.arange(self.n - n, self.n, dtype=np.int32)

    def put(self, h: np.ndarray, entries: np.ndarray) -> None:
        """Names entries by distinct hashes that are not there yet."""
        slot = (h & self.mask).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            done = free[first]
            self.keys[slot[done]], self.entries[slot[done]] = h[done], entries[done]
            rest = np.ones(len(h), bool)
            rest[done] = False
            h, entries, slot = h[rest], entries[rest], (slot[rest] + 1) & int(self.mask)

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the entries one after another, and where those of each end."""
        sizes = self.length[entries].astype(np.int64)
        ends = np.cumsum(sizes)
        at = np.repeat(self.start[entries] - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.ids[at], ends


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


class PackedTokenizer:
    def __init__(self, path: str):
        import json
        import re

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        kind = json.loads(self.library.to_str())
        pre = kind.get("pre_tokenizer") or {}
        #: only the byte-level pre-tokenizer with its usual pattern is cut here; others are left to the library
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not kind.get("normalizer")
        self.special = [t["content"] for t in kind.get("added_tokens", ())]
        self.beyond = re.compile("[\ud800-\udfff\U00010000-\U0010ffff]").search
        #: the byte-level alphabet: printable Latin-1 stands for itself, other bytes for characters from U+0100 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.bytes = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}
        nul = chr(self.bytes[0])
        self.between = self.library.token_to_id(nul) if sum(nul in t for t in self.library.get_vocab()) == 1 else None
        self.vocabulary = self.library.get_vocab_size()
        self.kinds = _kinds()
        self.table = Table(CACHE_SIZE)

    def _learned(self, words: list[str]) -> list[bytes]:
        """Ids of pieces. Runs of letters or numbers go to the library many at a time, apart by a NUL, which its pre-tokenizer
        cuts off from them and no token but its own holds; others go to its model one by one."""
        out: dict[str, bytes] = {}
        together = [w for w in words if self.between is not None and w[0] != "'" and (w[-1].isalpha() or w[-1].isnumeric())]
        # one group at a time, as the library's results take much more memory than ids
        for i in range(0, len(together), 200):
            group = together[i : i + 200]
            ids = np.asarray(self.library.encode_batch_fast(["\0".join(group)], add_special_tokens=False)[0].ids, dtype="<u4")
            at, raw = np.flatnonzero(ids == self.between), ids.tobytes()
            out.update((w, raw[a:b]) for w, a, b in zip(group, [0, *((at + 1) * 4).tolist()], [*(at * 4).tolist(), len(raw)]))
        tokenize, names, pack = self.library.model.tokenize, self.bytes, struct.pack
        for word in words:
            if word not in out:
                ids = [t.id for t in tokenize(word.encode().decode("latin-1").translate(names))]
                out[word] = pack(f"<{len(ids)}I", *ids)
        return [out[w] for w in words]

    def _pieces(self, codes: np.ndarray) -> np.ndarray:
        """Where pieces begin in texts that each end with a break; a break is a piece of its own.

        A run of one kind is a piece, with the space before it, if there is one. Of white space before a run the last character
        stands apart. An apostrophe alone takes s, t, m, d, re, ve or ll from the letters after it.
        """
        kind = self.kinds[np.minimum(codes, 0x10000)]
        begin = np.ones(len(codes) + 3, bool)
        np.not_equal(kind[1:], kind[:-1], out=begin[1 : len(codes)])
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != BREAK))
        begin[last] = True
        begin[last[codes[last] == 0x20] + 1] = False
        quote = np.flatnonzero((codes[:-1] == 0x27) & begin[: len(codes) - 1] & (kind[1:] == LETTER))
        if len(quote):
            one = codes[quote + 1]
            two = codes[np.minimum(quote + 2, len(codes) - 1)]
            single = np.isin(one, [ord(c) for c in "stmd"])
            double = np.isin(one * np.uint32(256) + np.minimum(two, 255), [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")]) & (one < 256) & (two < 256)
            begin[quote[single | double] + 1] = False
            begin[quote[double] + 2] = False
            begin[quote[single] + 2] = True
            begin[quote[double] + 3] = True
        return np.flatnonzero(begin[: len(codes)])

    def _some(self, texts: list[str]) -> list[bytes]:
        whole = "\U0010ffff".join([*texts, ""])
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        start = self._pieces(codes)
        end = np.append(start[1:], len(codes))
        total, down = prefix(mixed(codes.astype(np.uint64) + np.uint64(1)), _BASE)
        size = (end - start).astype(np.uint64)
        h = mixed((total[end] - total[start]) * down[start] + size) | np.uint64(1)
        if self.table.n > CACHE_SIZE:
            self.table = Table(CACHE_SIZE)
        entry = self.table.find(h)
        breaks = np.flatnonzero(codes[start] > 0xFFFF)
        entry[size > LONG] = -1
        entry[breaks] = -2
        missing = np.flatnonzero(entry == -1)
        if len(missing):
            long_ = size[missing] > LONG
            new, first, again = np.unique(h[missing[~long_]], return_index=True, return_inverse=True)
            at = missing[~long_][first]
            if len(at):
                entries = self.table.add(self._learned([whole[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]))
                self.table.put(new, entries)
                entry[missing[~long_]] = entries[again]
            if long_.any():
                at = missing[long_]
                words = [whole[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
                names = list(dict.fromkeys(words))
                entries = dict(zip(names, self.table.add(self._learned(names)).tolist()))
                entry[at] = [entries[w] for w in words]
        inside = np.ones(len(entry), bool)
        inside[breaks] = False
        ids, ends = self.table.gather(entry[inside])
        # before the k-th break stand its number less k pieces
        n = breaks - np.arange(len(breaks))
        to = np.where(n > 0, ends[np.maximum(n, 1) - 1] if len(ends) else 0, 0) * 4
        raw = ids.astype("<u4", copy=False).tobytes()
        return [raw[a:b] for a, b in zip([0, *to[:-1].tolist()], to.tolist())]

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null is the empty text."""
        out, held, n = [b""] * len(texts), [], 0
        for k, text in enumerate(texts):
            if not text:
                continue
            if not self.cuts or self.beyond(text) or any(s in text for s in self.special):
                out[k] = self._whole(text)
                continue
            held.append(k)
            n += len(text)
            if n >= CHARACTERS:
                for i, ids in zip(held, self._some([texts[i] for i in held])):
                    out[i] = ids
                held, n = [], 0
        if held:
            for i, ids in zip(held, self._some([texts[i] for i in held])):
                out[i] = ids
        return out


def packed(path: str) -> PackedTokenizer:
    """The tokenizer of this worker, made once for tasks that keep its path (see `trimmed`)."""

    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return PackedTokenizer(path)

    return kept(path, make)
