"""Token ids of whole texts by a public tokenizer file, with one library call per distinct piece and worker.

A BPE tokenizer first cuts a text into pieces and then encodes each piece alone. Here numpy finds the pieces of a batch,
hashes them (64 bits) and looks the hashes up in a bounded table; the ``tokenizers`` library encodes the pieces that
the table lacks. Rows with characters whose treatment numpy's rules don't cover go to the library whole.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from glyphsphere.llm.common import code_points, text_slices

#: Bytes of a worker's table of pieces, about, before it starts anew.
TABLE_BYTES = 24 << 20
_TOP = 0x180
_SPACE, _BREAK, _LETTER, _NUMBER, _OTHER = 1, 2, 3, 4, 5


def _classes() -> np.ndarray:
    """Of code points below U+0180; 0: the library decides."""
    import unicodedata

    out = np.zeros(_TOP + 1, np.uint8)
    for c in range(_TOP):
        kind = unicodedata.category(chr(c))
        if chr(c) in "\t\n\r":
            out[c] = _BREAK
        elif c == 32:
            out[c] = _SPACE
        elif kind[0] in "CZ" or c in (0x130, 0x149):
            out[c] = 0
        else:
            out[c] = {"L": _LETTER, "N": _NUMBER}.get(kind[0], _OTHER)
    return out


_CLASS = _classes()
_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(_TOP)], np.uint32)
_BASE = np.uint64(0x9E3779B97F4A7C15)


#: The characters that byte-level BPE writes for the 256 bytes.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _SHOWN} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of the base and of its inverse modulo 2**64."""
    if len(cache.get("p", ())) <= n:
        n = max(n + 1, 1 << 18)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        cache["p"], cache["i"] = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (_BASE, inverse))
    return cache["p"], cache["i"]


class Encoder:
    """Encodes batches of texts to ids, with the end id after each text. ``kind``: the tokenizer's cutting rules, ``byte``
    (spaces go with the next piece, case kept) or ``word`` (white space dropped, lower case); None: whole texts."""

    def __init__(self, spec: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_str(spec), end_id
        pre, norm = (json.dumps(json.loads(x.__getstate__())) if x else "{}" for x in (self.tokenizer.pre_tokenizer, self.tokenizer.normalizer))
        self.kind = None
        if '"Split"' not in pre and '"use_regex": true' in pre and norm == "{}":
            self.kind = "byte"
        elif "[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in pre and '"Lowercase"' in norm and '"NFC"' in norm:
            self.kind = "word"
        self.dtype = np.uint16 if max(self.tokenizer.get_vocab_size(), end_id) < 1 << 16 else np.uint32
        self._reset()

    def _reset(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted by hash
        self.offset, self.length, self.many = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), 0
        self.pool, self.used = np.zeros(1 << 18, self.dtype), 0

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> np.ndarray:
        """Adds pieces; their slots. The library's model encodes each piece as it would within a text."""
        tokenize, shown = self.tokenizer.model.tokenize, _BYTES
        ids = [[t.id for t in tokenize(p.encode().decode("latin-1").translate(shown))] for p in pieces]
        size = np.array([len(x) for x in ids], np.int32)
        flat = np.fromiter((i for x in ids for i in x), self.dtype, int(size.sum()))
        while self.many + len(ids) > len(self.offset):
            self.offset, self.length = np.r_[self.offset, self.offset * 0], np.r_[self.length, self.length * 0]
        while self.used + len(flat) > len(self.pool):
            self.pool = np.r_[self.pool, self.pool * 0]
        slots = np.arange(self.many, self.many + len(ids), dtype=np.int32)
        self.offset[slots], self.length[slots] = self.used + np.cumsum(size) - size, size
        self.pool[self.used : self.used + len(flat)] = flat
        self.many, self.used = self.many + len(ids), self.used + len(flat)
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.slots = np.insert(self.hashes, at, hashes[order]), np.insert(self.slots, at, slots[order])
        return slots

    def _pieces(self, cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each piece, the code points as they are hashed, and which rows need the library."""
        cls = _CLASS[np.minimum(cps, _TOP)]
        n, rows = len(cps), len(starts) - 1
        odd = cls == 0
        odd[:-1] |= (cps[:-1] == 60) & (cps[1:] == 124)  # may be a special token
        library = np.zeros(rows, bool)
        if odd.any():
            library[np.searchsorted(starts, np.flatnonzero(odd), "right") - 1] = True
        before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        before[1:], after[:-1] = cls[:-1], cls[1:]
        inner = starts[(starts > 0) & (starts < n)]
        before[inner], after[inner - 1] = 0, 0
        solid = cls >= _LETTER
        if self.kind == "byte":
            first = np.where(solid, (before == _BREAK) | (before == 0) | ((before >= _LETTER) & (before != cls)), (before >= _LETTER) | (before == 0) | (after >= _LETTER))
        else:
            cps = np.where(cps < _TOP, _LOWER[np.minimum(cps, _TOP - 1)], cps)
            first = (before != cls) | (cls == _NUMBER)
            first[inner] = True
        quote = np.flatnonzero((cps == 39) & first)
        if len(quote):  # 's 't 'm 'd, 're 've 'll
            end = starts[np.searchsorted(starts, quote, "right")]
            a = np.where(quote + 1 < end, cps[np.minimum(quote + 1, n - 1)], 0)
            b = np.where(quote + 2 < end, cps[np.minimum(quote + 2, n - 1)], 0)
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            for hit, size in ((quote[one], 2), (quote[two & ~one], 3)):
                first[hit + 1] = False
                nxt = hit + size
                nxt = nxt[nxt < n]
                first[nxt] |= (cls[nxt] >= _LETTER) | (first[nxt])
        at = np.flatnonzero(first)
        to = np.r_[at[1:], n]
        if self.kind == "word":
            keep = cls[at] >= _LETTER
            at, to = at[keep], to[keep]
        return at, to, cps, library

    def _by_library(self, text: str) -> np.ndarray:
        return np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, self.end_id], self.dtype)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(first row, the rows' ids) for each slice of the column."""
        column = column.fill_null("") if column.null_count else column
        for lo, hi in text_slices(column):
            part = column.slice(lo, hi - lo)
            if self.kind is None:
                yield lo, [self._by_library(t) for t in part.to_pylist()]
                continue
            cps, starts = code_points(part)
            if not len(cps):
                yield lo, [np.array([self.end_id], self.dtype)] * (hi - lo)
                continue
            at, to, folded, library = self._pieces(cps, starts)
            power, inverse = _powers(len(cps))
            sums = np.zeros(len(cps) + 1, np.uint64)
            np.cumsum((folded.astype(np.uint64) + np.uint64(7)) * power[: len(cps)], out=sums[1:])
            h = (sums[to] - sums[at]) * inverse[at] ^ (to - at).astype(np.uint64) << np.uint64(48)
            ids = pa.array(h).dictionary_encode()
            index, distinct = ids.indices.to_numpy(), ids.dictionary.to_numpy()
            if self.many * 20 + self.used * self.pool.itemsize > TABLE_BYTES:
                self._reset()
            place = np.minimum(np.searchsorted(self.hashes, distinct), max(0, len(self.hashes) - 1))
            known = self.hashes[place] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
            slot = np.zeros(len(distinct), np.int32)
            slot[known] = self.slots[place[known]] if known.any() else 0
            if (new := np.flatnonzero(~known)).size:
                first = np.zeros(len(distinct), np.int64)
                first[index[::-1]] = np.arange(len(index))[::-1]
                text = folded.astype(np.uint32).tobytes().decode("utf-32-le")
                slot[new] = self._learn(distinct[new], [text[at[k] : to[k]] for k in first[new]])
            slot = slot[index]
            length = self.length[slot]
            ends = np.cumsum(length)
            flat = self.pool[np.repeat(self.offset[slot].astype(np.int64) - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
            bound = np.r_[0, ends][np.searchsorted(at, starts)]
            end = np.array([self.end_id], self.dtype)
            out = [np.concatenate((flat[a:b], end)) for a, b in zip(bound[:-1], bound[1:], strict=True)]
            if library.any():
                for i in np.flatnonzero(library).tolist():
                    out[i] = self._by_library(part[i].as_py())
            yield lo, out


_ENCODERS: dict[tuple[bytes, int], Encoder] = {}


def encoder(spec: str, end_id: int) -> Encoder:
    """One encoder per tokenizer and worker, kept between tasks."""
    key = (hashlib.sha256(spec.encode()).digest(), end_id)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(spec, end_id)
    return _ENCODERS[key]


def public_tokenizer(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)
