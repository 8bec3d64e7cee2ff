"""Texts as sequences of small chunks whose ids are worked out once per task process.

A chunk begins at a white space byte, or at a full stop or comma after a Latin letter; word tokenizers never
join across those places, but for runs of white space, which callers keep off this path. Chunks are told
apart for a whole slice at once by their size and two 64-bit keys: their first and last eight bytes, which
with the size say all of a chunk up to sixteen bytes, and for longer ones two hashes of all their bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

from lodgetier.llm.base import slices, spread

#: Bytes of text whose new chunks are worked out together.
LEARN_BYTES = 4 << 20

#: Chunks whose ids a process keeps; with more it forgets those least used.
KEPT_CHUNKS = 400_000

_rng = np.random.default_rng(20_240_229)
_VALUES = _rng.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) | np.uint64(1)
_BASES = (0x9E3779B97F4A7C15 | 5, 0xD1342543DE82EF95)  # odd: powers have inverses modulo 2**64
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of a hash base or of its inverse, modulo 2**64."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        base = (_INVERSES if inverse else _BASES)[which]
        have = np.ones(1, dtype=np.uint64)
        while len(have) < size:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _powers[which, inverse] = have = have[:size].copy()
    return have[:n]


def prefix_hashes(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Sums S with S[j] - S[i] standing for the bytes i to j, up to a power of the base."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[which][data] * powers(which, len(data)), out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of byte ranges, equal for equal bytes wherever they stand."""
    return (sums[ends] - sums[starts]) * powers(which, len(sums), inverse=True)[starts]


def _begins(data: np.ndarray, every_space: bool) -> np.ndarray:
    """Where a chunk begins. every_space: at any ASCII white space, else at spaces only."""
    space = data == 32
    if every_space:
        space |= (data >= 9) & (data <= 13)
    before = np.concatenate([[np.uint8(32)], data[:-1]])
    lead = np.concatenate([[np.uint8(32)], before[:-1]])
    letter = ((before | 32) >= 97) & ((before | 32) <= 122) & (before < 128)
    letter |= (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
    return space | (((data == 46) | (data == 44)) & letter)


def _keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two keys of each byte range, equal for equal ranges; up to 16 bytes, ranges of one size differ in them."""
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    eight = np.ndarray(len(padded) - 8, dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each byte on
    masks = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
    first = eight[starts] & masks[np.minimum(sizes, 8)]
    rest = np.maximum(sizes - 8, 0)
    second = eight[starts + np.minimum(sizes, 8)] & masks[np.minimum(rest, 8)]
    at = np.flatnonzero(sizes > 16)
    if len(at):
        one, two, done = first[at], second[at], 16
        while True:
            left = sizes[at] - done
            go = left > 0
            if not go.any():
                break
            piece = eight[np.minimum(starts[at] + done, len(eight) - 1)] & masks[np.clip(left, 0, 8)]
            for hashed, factor in ((one, 0x9E3779B97F4A7C15), (two, 0xD1342543DE82EF95)):
                mixed = (hashed ^ (hashed >> np.uint64(31))) * np.uint64(factor) + piece * np.uint64(factor | 2)
                hashed[go] = (mixed ^ (mixed >> np.uint64(29)))[go]
            done += 8
        first[at], second[at] = one, two
    return first, second


class ChunkStore:
    """Ids of texts by way of their chunks.

    learn(chunks) gives the ids of all chunks end to end and the number of ids of each. plain(text) tells
    whether a text may be cut by bytes; whole(text) gives the ids of any other. Texts of any length and
    kind are encoded whole.
    """

    def __init__(
        self,
        learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]],
        plain: Callable[[bytes], bool],
        whole: Callable[[bytes], np.ndarray],
        every_space: bool = False,
        lower: bool = False,
        kept: int = KEPT_CHUNKS,
    ):
        self.learn, self.plain, self.whole = learn, plain, whole
        self.every_space, self.lower, self.kept = every_space, lower, kept
        self.first = self.second = np.zeros(0, dtype=np.uint64)
        self.ids = np.zeros(0, dtype=np.int32)
        self.sizes = np.zeros(0, dtype=np.int64)
        self.starts = self.lengths = self.uses = np.zeros(0, dtype=np.int64)
        self._index()

    def _index(self) -> None:
        self.index = pd.Index(_mixed(self.first, self.second, self.sizes))

    def _forget(self) -> None:
        """Keeps the more used chunks, half as many as may be kept."""
        stay = np.sort(np.argsort(-self.uses, kind="stable")[: self.kept // 2])
        lengths = self.lengths[stay]
        self.ids = self.ids[spread(lengths, self.starts[stay])]
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.first, self.second, self.sizes = self.first[stay], self.second[stay], self.sizes[stay]
        self.uses = self.uses[stay] // 2
        self._index()

    def _cut(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of some plain texts, where chunks start, their sizes, and the chunks of each text."""
        raw = b"".join(texts)
        data = np.frombuffer(raw, dtype=np.uint8)
        if self.lower:
            data = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
            raw = data.tobytes()
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        if not len(data):
            return raw, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        marks = _begins(data, self.every_space)
        marks[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(marks)
        counts = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))
        return raw, starts, np.diff(np.append(starts, len(data))), counts

    def _codes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Codes of all chunks of some texts, learning new ones; None if two chunks can't be told apart."""
        raw, starts, sizes, counts = self._cut(texts)
        first, second = _keys(np.frombuffer(raw, dtype=np.uint8), starts, sizes)
        which, distinct = pd.factorize(_mixed(first, second, sizes))
        sample = np.zeros(len(distinct), dtype=np.int64)
        sample[which[::-1]] = np.arange(len(which))[::-1]
        keys, have = (first, second, sizes), (self.first, self.second, self.sizes)
        if not all((key == key[sample][which]).all() for key in keys):
            return None
        at = self.index.get_indexer(distinct)
        known = at >= 0
        if not all((own[at[known]] == key[sample][known]).all() for own, key in zip(have, keys)):
            return None
        new = np.flatnonzero(~known)
        if len(new):
            at[new] = len(self.first) + np.arange(len(new))
            places = sample[new]
            ids, lengths = self.learn([raw[s : s + n] for s, n in zip(starts[places].tolist(), sizes[places].tolist())])
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), dtype=np.int64)])
            self.first, self.second, self.sizes = (np.concatenate([own, key[places]]) for own, key in zip(have, keys))
            self._index()
        codes = at[which]
        self.uses += np.bincount(codes, minlength=len(self.uses))
        return codes, counts

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        for first, last in slices(texts, LEARN_BYTES):
            if len(self.first) > self.kept:
                self._forget()
            odd = {i for i in range(first, last) if not self.plain(texts[i])}
            found = self._codes([b"" if i in odd else texts[i] for i in range(first, last)])
            if found is None:
                odd, found = set(range(first, last)), (np.zeros(0, dtype=np.int64), np.zeros(last - first, dtype=np.int64))
            codes, counts = found
            ends = np.cumsum(counts)
            for i in range(first, last):
                if i in odd:
                    yield self.whole(texts[i])
                else:
                    some = codes[ends[i - first] - counts[i - first] : ends[i - first]]
                    yield self.ids[spread(self.lengths[some], self.starts[some])]


def _mixed(first: np.ndarray, second: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    first = first + sizes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (first ^ (first >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xD1342543DE82EF95)
    return mixed ^ (mixed >> np.uint64(29))
