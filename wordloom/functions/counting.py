"""In how many texts each token or word occurs, counted where the texts are read.

Texts stay bytes: what tells most of them apart are searches and tables over all of
a text's bytes. Only a text that may hold noise is read by its characters. The
results are those of the column expressions in `functions.text`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions import text as T

#: Distinct words that a task holds before it hands their counts on.
HELD = 1 << 18

_INK = f"[^{re.escape(T.WHITE)}]"
_NOISE = re.compile(rf"https?://{_INK}+|www\.{_INK}+|(?<!{_INK}){_INK}+@{_INK}+|0[xX][0-9a-fA-F]+")
_HEX_RUN = re.compile(r"(?<![A-Za-z0-9_])[0-9a-fA-F]{8,}(?![A-Za-z0-9_])")
_MARKS = (b"@", b"http", b"www.", b"0x", b"0X")
_HEX = bytes(ord("f") if chr(i) in "0123456789abcdefABCDEF" else 0 for i in range(256))
#: White space beyond ASCII in UTF-8, and how it begins; in ASCII it is what bytes are split at.
_WIDE = re.compile(b"|".join(re.escape(c.encode()) for c in T.WHITE if ord(c) > 127))
_BEGINS = sorted({c.encode()[:2] for c in T.WHITE if ord(c) > 127})
_SMALL = bytes(range(256)).lower()
_CLEANED_OF = bytes(i for i in range(256) if not re.match(rb"[A-Za-z0-9_' \t\n\x0b\f\r]", bytes([i])))


def plain(text: bytes) -> bytes:
    """The text without noise, as `text.strip_noise` leaves it, its white space in ASCII."""
    if any(mark in text for mark in _MARKS) or b"ffffffff" in text.translate(_HEX):
        text = _HEX_RUN.sub(" ", _NOISE.sub(" ", text.decode(errors="replace"))).encode()
    return text if text.isascii() or not any(begin in text for begin in _BEGINS) else _WIDE.sub(b" ", text)


def tokens(text: bytes) -> set[bytes]:
    """The distinct tokens of a text, those of `text.tokens`."""
    return set(plain(text).split())


def words(text: bytes) -> set[bytes]:
    """The distinct non-empty tokens of a text, cleaned as by `text.clean_word` and in small letters."""
    return set(plain(text).translate(_SMALL, _CLEANED_OF).split())


def _counts(own: Callable[[bytes], set[bytes]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        made = lambda: pa.record_batch([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    held.update(own(text.as_py()))
                if len(held) > HELD:
                    yield made()
                    held.clear()
        yield made()

    return count


def counted(texts: DataFrame, own: Callable[[bytes], set[bytes]]) -> DataFrame:
    """(word, n): in how many of texts(text) each of their own words occurs. Only words and their counts are shuffled."""
    each = texts.select(F.col("text").cast("binary")).mapInArrow(_counts(own), "word binary, n long")
    return each.select(F.col("word").cast("string").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
