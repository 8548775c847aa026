"""Vectorised byte-level tokenising and hashing of text batches.

Texts are handled as one UTF-8 buffer per slice. White space is the six ASCII
bytes 0x20 and 0x09-0x0D; as no byte of a multi-byte UTF-8 character falls in
that range, splitting bytes equals splitting characters. A word hash takes the
word's bytes eight at a time, each time scrambling all that came before, so that
no polynomial identity makes different words alike; a longer word than
LANE_BYTES has a BLAKE2 digest. A window hash joins the hashes of halves in the
same way. Hashes find candidates; where equality decides, `same_bytes` compares,
or words are hashed under a secret that is drawn anew for each run, so that no
text can be made to collide.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text is one slice of its own.
SLICE_BYTES = 1 << 18

# Odd multipliers.
LENGTH_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = 0xD1342543DE82EF95
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)

#: Words of up to so many bytes are hashed in steps of eight bytes, all at once.
LANE_BYTES = 256
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_2
    return x ^ (x >> np.uint64(31))


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes unchanged."""
    return data + (((data >= 65) & (data <= 90)).view(np.uint8) << 5)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets between them; a null text has no bytes."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most `limit` bytes together, or one longer text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the word count before each text (with the total last)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~is_space(data)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True  # a text ends where the next one starts
    before = np.concatenate(([False], ink[:-1]))
    after = np.concatenate((ink[1:], [False]))
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def new_secret() -> int:
    """A secret for the hashes of one run. It goes to tasks with their code, so that one that is run again hashes alike."""
    return secrets.randbits(63) | 1 << 63


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, secret: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span. The secret multiplies what is scrambled at each step, so that differences of bytes lead nowhere that is known."""
    odd, key = np.uint64(secret | 1), secret.to_bytes(8, "little")
    sizes = ends - starts
    if not len(sizes):
        return np.zeros(0, np.uint64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    out = mix((mix(sizes.astype(np.uint64) * LENGTH_BASE ^ np.uint64(secret)) ^ (eight[starts] & _MASKS[np.minimum(sizes, 8)])) * odd)
    some, at = np.flatnonzero(sizes > 8), 8
    while len(some) and at < LANE_BYTES:
        out[some] = mix((out[some] ^ (eight[starts[some] + at] & _MASKS[np.minimum(sizes[some] - at, 8)])) * odd)
        at += 8
        some = some[sizes[some] > at]
    for i in np.flatnonzero(sizes > LANE_BYTES):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=key).digest(), "little")
    return out


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    both = (left ^ (left >> np.uint64(29))) * MIX_1 + right
    return (both ^ (both >> np.uint64(32))) * MIX_2


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, from those of its parts; windows that cross texts are the caller's to drop."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, part, size = None, 0, words, 1
    while True:
        if k & size:
            out = part[:n] if out is None else _joined(out, part[done : done + n])
            done += size
        if done == k:
            return mix(out + np.uint64(k))
        part = _joined(part[:-size], part[size:])
        size *= 2


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether a's and b's spans of the given sizes are equal, byte for byte."""
    total = int(sizes.sum())
    if not total:
        return np.ones(len(sizes), bool)
    before = np.cumsum(sizes) - sizes
    step = np.arange(total) - np.repeat(before, sizes)
    unlike = a[np.repeat(a_starts, sizes) + step] != b[np.repeat(b_starts, sizes) + step]
    counts = np.concatenate(([0], np.cumsum(unlike)))
    return counts[before + sizes] == counts[before]


def text_words(texts: pa.Array, lower: bool, secret: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of texts: its first and last text, all word hashes, and the word count before each text."""
    data, offsets = buffers(texts)
    for first, last in slices(offsets):
        own = data[offsets[first] : offsets[last]]
        own = lower_ascii(own) if lower else own
        starts, ends, counts = word_bounds(own, offsets[first : last + 1] - offsets[first])
        yield first, last, span_hashes(own, starts, ends, secret), counts
