"""Byte-level BPE over batches of texts, with each distinct piece of text encoded once per process.

The tokenizer's pattern never lets a token cross from a letter to an ASCII
non-letter, from ink to white space, or past a single line break into ink, so
texts are cut there, and equal cuts have equal ids. Cuts are found by hash and
then compared byte for byte; a text with a cut whose hash belongs to another cut
is encoded whole. A text with white space
other than the six ASCII bytes, or with the string of an added token, is encoded
whole. Cuts of letters are one piece
of the pattern and are merged by the ranks of the same vocabulary; tests hold
the ids against the tokenizer's own.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa

from wordloom.llm import textblocks as T

#: Distinct cuts remembered by a process before it starts afresh.
REMEMBERED = 600_000

#: A cut of letters, all ASCII or in U+00C0-00FF, with at most one space before them.
PLAIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")

_encoders: dict[tuple[str, str, bool], Encoder] = {}


def encoder(path: str, ranks: str, special_as_text: bool = True) -> Encoder:
    """The process's encoder for a tokenizer file and the ranks of the same vocabulary."""
    key = path, ranks, special_as_text
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


class Encoder:
    """Ids of the tokenizer file. The strings of special tokens in a text are ordinary text, or as in the file as it is those tokens."""

    def __init__(self, path: str, ranks: str, special_as_text: bool = True) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.merge = tiktoken.Encoding("ranks", pat_str=r"\S+|\s+", mergeable_ranks=table, special_tokens={})._core_bpe.encode_single_piece

        self.tokenizer = Tokenizer.from_file(path)
        if special_as_text:
            self.tokenizer.encode_special_tokens = True
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.old, self.new = none, none
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.sizes, self.known = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0
        self.bytes, self.held = np.zeros(1 << 16, np.uint8), 0
        self.byte_starts, self.byte_sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _find(level: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        have, slots = level
        if not len(have):
            return np.full(len(keys), -1, np.int64)
        at = np.searchsorted(have, keys)
        at[at == len(have)] = 0
        return np.where(have[at] == keys, slots[at], -1)

    def _slots(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the ids of each distinct cut are, encoding those that are not known."""
        slots = self._find(self.old, keys)
        slots = np.where(slots < 0, self._find(self.new, keys), slots)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            cuts = [data[starts[i] : ends[i]].tobytes() for i in missing]
            found = [self.merge(cut) if PLAIN.fullmatch(cut) else None for cut in cuts]
            rest = [i for i, ids in enumerate(found) if ids is None]
            for i, ids in zip(rest, self._encode([cuts[i].decode() for i in rest]), strict=True):
                found[i] = ids
            sizes = np.fromiter(map(len, found), np.int32, len(found))
            flat = np.fromiter((x for ids in found for x in ids), np.int32, int(sizes.sum()))
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
            while self.known + len(found) > len(self.starts):
                self.starts, self.sizes, self.byte_starts, self.byte_sizes = (np.concatenate((c, np.zeros_like(c))) for c in (self.starts, self.sizes, self.byte_starts, self.byte_sizes))
            raw = np.frombuffer(b"".join(cuts), np.uint8)
            while self.held + len(raw) > len(self.bytes):
                self.bytes = np.concatenate((self.bytes, np.zeros_like(self.bytes)))
            self.bytes[self.held : self.held + len(raw)] = raw
            self.ids[self.used : self.used + len(flat)] = flat
            own = np.arange(self.known, self.known + len(found))
            self.starts[own], self.sizes[own] = self.used + np.cumsum(sizes) - sizes, sizes
            lengths = (ends - starts)[missing]
            self.byte_starts[own], self.byte_sizes[own] = self.held + np.cumsum(lengths) - lengths, lengths
            self.held += len(raw)
            slots[missing] = own
            self.used += len(flat)
            self.known += len(found)
            self.new = self._merged(self.new, (keys[missing], own))
            if len(self.new[0]) * 4 > len(self.old[0]):
                self.old, self.new = self._merged(self.old, self.new), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return slots

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
        keys, slots = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
        order = np.argsort(keys, kind="stable")
        return keys[order], slots[order]

    def batch(self, texts: pa.Array):
        """For each text in turn, its ids as an int32 array."""
        data, offsets = T.buffers(texts)
        for first, last in T.slices(offsets):
            base = offsets[first]
            yield from self._slice(data[base : offsets[last]], offsets[first : last + 1] - base)

    def _slice(self, data: np.ndarray, offsets: np.ndarray):
        if not len(data):
            yield from (np.zeros(0, np.int32) for _ in offsets[1:])
            return
        if self.known > REMEMBERED:
            self._forget()
        before, before_that = np.concatenate(([32], data[:-1])).astype(np.uint8), np.concatenate(([32, 32], data[:-2])).astype(np.uint8)[: len(data)]
        space, was_space = T.is_space(data), T.is_space(before)
        lower = before | 32
        letter_before = ((lower >= 97) & (lower <= 122)) | ((before_that == 0xC3) & (before != 0x97) & (before != 0xB7) & (before >= 0x80))
        here = data | 32
        not_letter = (data < 128) & ~((here >= 97) & (here <= 122))
        cut = (letter_before & not_letter) | (space & ~was_space) | (~space & was_space & (before != 32) & ~T.is_space(before_that))
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        odd = self._odd_texts(data, offsets) | self._with_added(data, offsets)
        hashes = T.span_hashes(data, starts, ends)
        keys, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        slots = self._slots(keys, data, starts[where], ends[where])[inverse]
        lengths = ends - starts
        unlike = lengths != self.byte_sizes[slots]
        unlike |= ~T.same_bytes(data, starts, self.bytes, self.byte_starts[slots], np.where(unlike, 0, lengths))
        odd[np.searchsorted(offsets, starts[unlike], side="right") - 1] = True
        sizes = self.sizes[slots]
        through = np.cumsum(sizes, dtype=np.int64)
        ids = self.ids[np.arange(through[-1]) + np.repeat(self.starts[slots] - through + sizes, sizes)]
        counts = np.concatenate(([0], through))[np.searchsorted(starts, offsets)]
        for i in range(len(offsets) - 1):
            if odd[i]:
                yield np.array(self._encode([data[offsets[i] : offsets[i + 1]].tobytes().decode()])[0], np.int32)
            else:
                yield ids[counts[i] : counts[i + 1]]

    def _with_added(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts with the string of an added token."""
        found, raw = np.zeros(len(offsets) - 1, bool), data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                i = int(np.searchsorted(offsets, at, "right")) - 1
                end = int(offsets[i + 1])
                found[i] |= at + len(token) <= end
                at = raw.find(token, end if found[i] else at + 1)
        return found

    @staticmethod
    def _odd_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts with white space that is not one of the six bytes: U+0085, U+00A0, U+1680, U+2000-200A, 2028, 2029, 202F, 205F, 3000, and 0x1C-0x1F."""
        one = np.append(data[1:], [0]).astype(np.uint8)
        two = np.append(one[1:], [0]).astype(np.uint8)
        odd = ((data >= 0x1C) & (data <= 0x1F)) | ((data == 0xC2) & ((one == 0x85) | (one == 0xA0)))
        odd |= ((data == 0xE1) & (one == 0x9A) & (two == 0x80)) | ((data == 0xE3) & (one == 0x80) & (two == 0x80)) | ((data == 0xE2) & (one == 0x81) & (two == 0x9F))
        odd |= (data == 0xE2) & (one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF))
        at = np.flatnonzero(odd)
        return np.diff(np.searchsorted(at, offsets)) > 0
