"""A growing table from words to numbers, looked up for whole arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shingles import GOLDEN, mix

#: Longer words, in bytes, are not kept.
LONGEST = 64
_RNG = np.random.default_rng(17)
BYTE = _RNG.integers(1, 1 << 64, 256, dtype=np.uint64)
PLACE = _RNG.integers(1, 1 << 64, LONGEST, dtype=np.uint64) | np.uint64(1)


def hashes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and sizes in bytes of strings; words of more than LONGEST bytes are hashed by their size alone."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(words) else np.zeros(0, np.uint8)
    ends -= ends[0]
    size = np.diff(ends)
    place = np.arange(len(raw)) - np.repeat(ends[:-1], size)
    with np.errstate(over="ignore"):
        terms = np.where(place < LONGEST, BYTE[raw] * PLACE[np.minimum(place, LONGEST - 1)], np.uint64(0))
        total = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
        return mix(total[ends[1:]] - total[ends[:-1]] + size.astype(np.uint64) * GOLDEN), size


class WordTable:
    """Open addressing over hashes; a hit counts only if the kept word is the same. A slot holds a word's place only, so
    some 35 bytes go with a word of average length."""

    def __init__(self):
        self.words, self.numbers, self.keys = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(1, np.uint64)
        self.bits, self.at = 16, np.full(1 << 16, -1, np.int32)  # keys has one more, for slots that are free

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.numbers.nbytes + self.keys.nbytes + self.at.nbytes

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, or the free place where it belongs."""
        out = (keys >> np.uint64(64 - self.bits)).astype(np.int32)
        at = self.at[out]
        left = np.flatnonzero((at >= 0) & (self.keys[at] != keys))
        while len(left):
            out[left] = (out[left] + 1) & ((1 << self.bits) - 1)
            at = self.at[out[left]]
            left = left[(at >= 0) & (self.keys[at] != keys[left])]
        return out

    def find(self, words: pa.Array) -> np.ndarray:
        """The words' numbers, -1 for those that aren't here."""
        keys, size = hashes_of(words)
        at = self.at[self.slots(keys)]
        out, hit = np.full(len(words), -1, np.int64), np.flatnonzero((at >= 0) & (size <= LONGEST))
        if len(hit):
            same = pc.equal(self.words.take(pa.array(at[hit])), words.take(pa.array(hit))).to_numpy(zero_copy_only=False)
            out[hit[same]] = self.numbers[at[hit[same]]]
        return out

    def add(self, words: pa.Array, numbers: np.ndarray) -> None:
        """Distinct words that find() doesn't know. Long ones, and one whose hash another word has, are not kept."""
        keys, size = hashes_of(words)
        keep = np.flatnonzero((size <= LONGEST) & (self.at[self.slots(keys)] < 0))
        keep = keep[np.unique(keys[keep], return_index=True)[1]]
        first = len(self.words)
        self.words = pa.concat_arrays([self.words, words.take(pa.array(keep))])
        self.numbers = np.concatenate([self.numbers, numbers[keep].astype(np.int32)])
        self.keys = np.concatenate([self.keys[:-1], keys[keep], np.zeros(1, np.uint64)])
        if len(self.words) > (1 << self.bits) * 3 // 4:
            while len(self.words) > (1 << self.bits) * 3 // 4:
                self.bits += 1
            first, self.at = 0, np.full(1 << self.bits, -1, np.int32)
        for k in range(first, len(self.words), 1 << 18):
            self.place(np.arange(k, min(k + (1 << 18), len(self.words)), dtype=np.int32))

    def place(self, at: np.ndarray) -> None:
        while len(at):  # keys that meet in one place take turns
            slot, first = np.unique(self.slots(self.keys[at]), return_index=True)
            self.at[slot] = at[first]
            rest = np.ones(len(at), bool)
            rest[first] = False
            at = at[rest]
