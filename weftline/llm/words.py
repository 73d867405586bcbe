"""Words of many texts at once as 64-bit hashes, computed over byte arrays without a Python object for each word."""

from __future__ import annotations

import hashlib

import numpy as np

_P = 0x9E3779B97F4A7C15
#: Low bytes of a lane of eight that a word of so many bytes left fills.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes from which on a word is hashed by itself, by a cryptographic function.
_LONG = 128

#: Byte classes. SPACES: words are runs of other bytes. LETTERS_DIGITS: words are runs of a-z, 0-9 and bytes beyond ASCII.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LETTERS_DIGITS = np.zeros(256, bool)
LETTERS_DIGITS[:0x80] = True
LETTERS_DIGITS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B)]] = False
#: A-Z to a-z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes: lanes of eight bytes, mixed one after the other, so that no structure of the words carries over."""
    left = ends - starts
    lanes = np.ndarray(len(data), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    out = mix(left.astype(np.uint64) * np.uint64(_P) ^ (lanes[starts] & _MASKS[np.minimum(left, 8)]))
    at = np.flatnonzero((left > 8) & (left < _LONG))
    first = starts[at]
    rest = left[at] - 8
    while len(at):
        first = first + 8
        out[at] = mix(out[at] * np.uint64(_P) ^ (lanes[first] & _MASKS[np.minimum(rest, 8)]))
        more = rest > 8
        at, first, rest = at[more], first[more], rest[more] - 8
    for i in np.flatnonzero(left >= _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte) of every word, and the first word of each text and the end."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64)
    is_word = ~separators[data]
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    at = offsets[:-1]
    at = at[at < n]
    first[at] = is_word[at]
    at = offsets[1:] - 1
    at = at[at >= 0]
    last[at] = is_word[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return _hashes(LOWER[data] if lower else data, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; windows that cross texts are the caller's to leave out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(_P) + h[i : i + n]
    return mix(out)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    n = len(a) - w + 1
    if n <= 0:
        return a[:0]
    size, cur = 1, a
    while size * 2 <= w:
        cur = np.minimum(cur[: len(cur) - size], cur[size:])
        size *= 2
    return np.minimum(cur[:n], cur[w - size : w - size + n])
