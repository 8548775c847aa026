"""Lines of a text rewritten by its fixes, on the text's bytes. The rules are those of `operators.rewrite`."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of lines that a task makes before it hands them on.
MADE = 4 << 20

_INK = frozenset(i for i in range(256) if re.match(rb"[A-Za-z0-9_]", bytes([i])))
_CHANGED = "line int, old_line string, new_line string"


def cased(replacement: str, original: bytes) -> bytes:
    """The replacement in the case pattern of the original."""
    text = original.decode(errors="replace")
    if len(text) > 1 and text == text.upper():
        return replacement.upper().encode()
    return (replacement[:1].upper() + replacement[1:] if text[:1] == text[:1].upper() else replacement).encode()


def _edge(line: bytes, at: int) -> bool:
    return (at > 0 and line[at - 1] in _INK) != (at < len(line) and line[at] in _INK)


def replaced(line: bytes, word: bytes, replacement: str) -> bytes:
    """A line with each match of a whole word in small letters replaced, whatever the match's case in ASCII."""
    small = line.lower()  # of ASCII, as it is bytes
    at, done, out = small.find(word), 0, []
    while at >= 0:
        end = at + len(word)
        if _edge(small, at) and _edge(small, end):
            out += [line[done:at], cased(replacement, line[at:end])]
            done = end
        at = small.find(word, max(done, at + 1))
    return b"".join([*out, line[done:]]) if out else line


def changed(text: bytes, fixes: list[tuple[int, int, int, bytes, str]]) -> Iterator[tuple[int, bytes, bytes]]:
    """(line, old, new) of a text that changes by (line, pos, part_pos, word, replacement): a line's words in turn, each as first seen; a later one may match what an earlier one put in."""
    lines = text.split(b"\n")
    words: dict[int, dict[bytes, str]] = {}
    for line, _, _, word, replacement in sorted(fixes):
        words.setdefault(line, {}).setdefault(word, replacement)
    for line, each in words.items():
        if line <= len(lines):
            old = new = lines[line - 1]
            for word, replacement in each.items():
                new = replaced(new, word, replacement)
            if new != old:
                yield line, old, new


def _rewrite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[int] = []
        found: list[tuple[int, bytes, bytes]] = []
        size = 0

        def made(batch: pa.RecordBatch = batch, rows: list[int] = rows, found: list[tuple[int, bytes, bytes]] = found) -> pa.RecordBatch:
            lines, old, new = zip(*found, strict=True) if found else ((), (), ())
            texts = [pa.array(c, pa.binary()).cast(pa.string()) for c in (old, new)]
            out = pa.record_batch([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(lines, pa.int32()), *texts], ["doc_id", "line", "old_line", "new_line"])
            rows.clear()
            found.clear()
            return out

        fixes = batch.column(2)
        for i, text in enumerate(batch.column(1)):
            own = fixes[i].values
            columns = (own.field(k).to_pylist() for k in range(5))
            for line in changed(text.as_py(), list(zip(*columns, strict=True))):
                rows.append(i)
                found.append(line)
                size += len(line[1]) + len(line[2])
            if size >= MADE:
                yield made()
                size = 0
        yield made()


def rewritten(texts: DataFrame) -> DataFrame:
    """(doc_id, line, old_line, new_line): the lines that change of texts(doc_id, text, fixes), whose fixes are (line, pos, part_pos, word, replacement), words in small letters."""
    own = texts.where("text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("text"), "fixes")
    schema = StructType([StructField("doc_id", texts.schema["doc_id"].dataType), *StructType.fromDDL(_CHANGED).fields])
    return own.mapInArrow(_rewrite, schema)
