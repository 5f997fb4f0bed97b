"""Words and word shingles of texts as 64-bit hashes, computed on whole batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def plain_texts(texts: pa.Array) -> pa.Array:
    """Lower case, runs of anything but letters, marks and digits become one space, none at the ends."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(low, r"[^\pL\pM\pN]+", " "))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts, and the number of words of each text.

    The hash of a word is a polynomial over its bytes, mixed; it is summed from prefix sums of the whole buffer."""
    plain = plain_texts(texts)
    filled = pc.not_equal(plain, "").to_numpy(zero_copy_only=False)
    n_words = np.where(filled, pc.count_substring(plain, " ").to_numpy(zero_copy_only=False) + 1, 0).astype(np.int64)
    raw = np.frombuffer("".join([f"{t} " for t, x in zip(plain.to_pylist(), filled, strict=True) if x]).encode(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), n_words
    ends = np.flatnonzero(raw == 0x20)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends + 1 - starts)  # of a byte in its word
    with np.errstate(over="ignore"):
        table = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * GOLDEN)
        weight = mix(np.arange(min(int(place.max()) + 1, 1 << 16), dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
        terms = table[raw] * weight[place % len(weight)]
        terms[ends] = 0
        return mix(np.add.reduceat(terms, starts) + (ends - starts).astype(np.uint64) * GOLDEN), n_words


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words that begin at each place where k words are left."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            out = mix(out + words[j : len(words) - k + 1 + j] + np.uint64(j + 1) * GOLDEN)
    return out


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text; fewer than k words make one shingle, none makes none."""
    words, n_words = word_hashes(texts)
    windows = window_hashes(words, k)
    out, at = [], 0
    for n in n_words.tolist():
        if n >= k:
            out.append(np.unique(windows[at : at + n - k + 1]))
        elif n:
            out.append(window_hashes(words[at : at + n], n))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
