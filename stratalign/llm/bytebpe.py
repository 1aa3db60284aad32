"""Byte-level BPE over Arrow batches.

Ids are those of the ``tokenizers`` library.  Texts are cut into pre-tokens by
array operations over code points, equal pre-tokens are found by hash, and only
pre-tokens not seen before go through the library.  A text that this cannot
cut (one with a special token's string, or a tokenizer with other settings) is
encoded by the library as a whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
import zlib
from collections.abc import Sequence

import numpy as np

from . import textkit

U64 = np.uint64
_CHUNK = 1 << 19
_REMEMBERED = 250_000
_LETTER, _NUMBER, _SPACE = 1, 2, 3


def character_kinds(block: int = 1 << 12) -> bytes:
    """The class of each code point by the library's own engine, compressed; made once, on the driver, a block of
    code points at a time, as the library takes some hundred bytes for each piece it returns."""
    from tokenizers import Regex, pre_tokenizers

    engines = [(kind, pre_tokenizers.Split(Regex(pattern), "removed")) for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+"))]
    kinds = np.zeros(0x110000, np.uint8)
    for first in range(0, 0x110000, block):
        at = np.array([p for p in range(first, min(first + block, 0x110000)) if not 0xD800 <= p < 0xE000], np.int64)
        if not len(at):
            continue
        points = "".join(map(chr, at.tolist()))
        for kind, engine in engines:
            # Runs that are removed are the members of the class.
            member = np.ones(len(at), bool)
            for _, (start, end) in engine.pre_tokenize_str(points):
                member[start:end] = False
            kinds[at[member]] = kind
    return zlib.compress(kinds.tobytes())


def byte_characters() -> dict[int, int]:
    """Which character stands for each byte in a byte-level vocabulary: its own where that is printable and no space, the
    others in turn from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("\u00a1"), ord("\u00ac") + 1), *range(ord("\u00ae"), ord("\u00ff") + 1)]
    others = (b for b in range(256) if b not in set(printable))
    return {b: 256 + k for k, b in enumerate(others)}


class ByteBpe:
    """An encoder from a tokenizer's JSON text and ``character_kinds()``."""

    def __init__(self, definition: str, kinds: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        settings = json.loads(definition)
        before = settings.get("pre_tokenizer") or {}
        self.fast = not settings.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        special = [t["content"] for t in settings.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.characters = byte_characters()
        self.kinds = np.frombuffer(zlib.decompress(kinds), np.uint8)
        self.keys = textkit.mix(np.arange(1, 0x110001, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)
        self._forget()

    @classmethod
    def shared(cls, definition: str, kinds: bytes) -> ByteBpe:
        """One encoder a worker process, which later tasks use again."""
        home = sys.modules.setdefault("_stratalign_process", types.ModuleType("_stratalign_process"))
        key = zlib.crc32(definition.encode())
        if getattr(home, "bpe", (None, None))[0] != key:
            home.bpe = (key, cls(definition, kinds))
        return home.bpe[1]

    def _forget(self) -> None:
        self.place: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.begin, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text as int32, special tokens not added."""
        out: list[np.ndarray | None] = [None] * len(texts)
        parts: list[tuple[int, str]] = []
        whole = []
        for k, text in enumerate(texts):
            if not self.fast or (self.special and self.special.search(text)):
                whole.append(k)
            else:
                parts.extend((k, p) for p in _pieces(text))
        for k, encoded in zip(whole, self.tokenizer.encode_batch([texts[k] for k in whole], add_special_tokens=False), strict=True):
            out[k] = np.array(encoded.ids, np.int32)
        start, size, found = 0, 0, [[] for _ in texts]
        for at, (_, part) in enumerate(parts):
            size += len(part)
            if size >= _CHUNK or at == len(parts) - 1:
                for (k, _), ids in zip(parts[start : at + 1], self._chunk([p for _, p in parts[start : at + 1]]), strict=True):
                    found[k].append(ids)
                start, size = at + 1, 0
        return [ids if ids is not None else np.concatenate(f) if len(f) > 1 else f[0] if f else np.zeros(0, np.int32) for ids, f in zip(out, found, strict=True)]

    def _chunk(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        if not joined:
            return [np.zeros(0, np.int32) for _ in texts]
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        rows = np.r_[0, np.cumsum([len(t) for t in texts])]
        starts = self._starts(points, rows)
        ends = np.r_[starts[1:], len(points)]
        hashes = np.empty(len(starts), U64)
        tables = textkit.tables()
        with np.errstate(over="ignore"):
            first = 0
            while first < len(starts):
                last = max(first + 1, int(np.searchsorted(ends, starts[first] + textkit.SEGMENT, "right")))
                a, b = int(starts[first]), int(ends[last - 1])
                tables.powers(b - a)
                total = np.zeros(b - a + 1, U64)
                np.cumsum(self.keys[points[a:b]] * tables.power[: b - a], out=total[1:])
                at = starts[first:last] - a
                hashes[first:last] = (total[ends[first:last] - a] - total[at]) * tables.inverse[at]
                first = last
        hashes = textkit.mix(hashes)
        distinct, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.place) > _REMEMBERED:
            self._forget()
        places = [self.place.get(h) for h in distinct.tolist()]
        missing = [k for k, p in enumerate(places) if p is None]
        if missing:
            self._learn(distinct, missing, places, [joined[starts[i] : ends[i]] for i in index[missing].tolist()])
        place = np.array(places, np.int64)[inverse]
        lengths = self.length[place]
        ids = self.flat[textkit.ranges(self.begin[place], lengths)]
        upto = np.r_[0, np.cumsum(lengths)][np.searchsorted(starts, rows)]
        return [ids[upto[k] : upto[k + 1]] for k in range(len(texts))]

    def _learn(self, distinct: np.ndarray, missing: list[int], places: list, words: list[str]) -> None:
        # A pre-token is one call of the model, on its bytes as characters; the rest of the library's path costs twice that.
        tokenize, as_characters = self.tokenizer.model.tokenize, self.characters
        encoded = [[t.id for t in tokenize(w.encode().decode("latin-1").translate(as_characters))] for w in words]
        at, counts = len(self.place), np.array([len(e) for e in encoded], np.int64)
        flat = np.fromiter((i for e in encoded for i in e), np.int32, int(counts.sum()))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        while at + len(words) > len(self.begin):
            self.begin, self.length = np.r_[self.begin, np.zeros_like(self.begin)], np.r_[self.length, np.zeros_like(self.length)]
        self.flat[self.used : self.used + len(flat)] = flat
        self.begin[at : at + len(words)] = self.used + np.r_[0, np.cumsum(counts)[:-1]]
        self.length[at : at + len(words)] = counts
        self.used += len(flat)
        for n, k in enumerate(missing):
            places[k] = self.place[int(distinct[k])] = at + n

    def _starts(self, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where pre-tokens start: 's 't 're 've 'm 'll 'd, runs of letters, numbers or others with one space
        before, and white space, of which the last one before something else stands alone."""
        n = len(points)
        kinds = self.kinds[points]
        row = np.zeros(n + 1, bool)
        row[rows] = True
        start = row[:-1].copy()
        start[1:] |= kinds[1:] != kinds[:-1]
        runs = np.flatnonzero(start)
        after = runs[(kinds[runs] != _SPACE) & ~row[runs]]
        after = after[kinds[after - 1] == _SPACE]  # starts that follow white space in their row
        start[after - 1] = True
        start[after[points[after - 1] == 32]] = False
        mark = runs[points[runs] == 39]
        mark = mark[start[mark] & (mark + 1 < n)]
        if len(mark):
            mark = mark[~row[mark + 1]]
            one = points[mark + 1]
            two = np.where((mark + 2 < n) & ~row[np.minimum(mark + 2, n)], points[np.minimum(mark + 2, n - 1)], 0)
            length = np.where(np.isin(one, [115, 116, 109, 100]), 2, 0)
            length[((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)] = 3
            mark, length = mark[length > 0], length[length > 0]
            start[mark + 1] = False
            start[(mark + length)[mark + length < n]] = True
        return np.flatnonzero(start)


def _pieces(text: str, limit: int = 1 << 19) -> list[str]:
    """A long text in parts, cut before single spaces between words, where pre-tokens always start."""
    if len(text) <= limit:
        return [text]
    out, start = [], 0
    cut = re.compile(r"(?<=[0-9A-Za-z.,;:!?]) (?=[0-9A-Za-z])")
    while len(text) - start > limit:
        found = cut.search(text, start + limit)
        if found is None:
            break
        out.append(text[start : found.start()])
        start = found.start()
    out.append(text[start:])
    return out
