"""Where misspelt words and wanted tokens are, found where the texts are read.

Texts stay bytes, as in `functions.counting`: what a token holds is decided once for
as many distinct tokens as a task remembers. The rules are those of `operators.check`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from wordloom.functions.counting import _CLEANED_OF, HELD, plain

#: Rows that a task makes before it hands them on.
MADE = 1 << 16

_BETWEEN = re.compile(rb"[_\-/.]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_FOUND = "line int, pos int, part_pos int, word string"

Parts = tuple[tuple[int, bytes], ...]


class Judge(dict):
    """The (part_pos, word) to flag of each token that it is asked for, as `check.invalid_parts` defines them by a set of valid words. It forgets when it holds many."""

    def __init__(self, words: Iterable[bytes], min_length: int = 1) -> None:
        super().__init__()
        self.words, self.least = frozenset(words), min_length

    def __reduce__(self) -> tuple:
        return Judge, (self.words, self.least)

    def __missing__(self, token: bytes) -> Parts:
        if len(self) >= HELD:
            self.clear()
        found = self[token] = self.judged(token)
        return found

    def bad(self, word: bytes) -> bool:
        return len(word) >= self.least and word != b"" and not word[:1].isdigit() and word.lower() not in self.words

    def judged(self, token: bytes) -> Parts:
        whole = token.translate(None, _CLEANED_OF)
        if not whole or (len(whole) >= self.least and whole.lower() in self.words):
            return ()
        parts = (p.translate(None, _CLEANED_OF) for p in filter(None, _BETWEEN.split(token)))
        found = tuple((i, p) for i, p in enumerate(parts) if self.bad(p))
        if found and b"." in token and all(s.translate(None, _CLEANED_OF).lower() in self.words for s in token.split(b".")):
            return ()
        return found


def judge(words: list[str], min_length: int = 1) -> Judge:
    return Judge((w.encode() for w in words if w), min_length)


class Wanted(dict):
    """A row for each of some tokens, none for others."""

    def __missing__(self, token: bytes) -> Parts:
        return ()


def _placed(judge: dict[bytes, Parts]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            columns: tuple[list, ...] = ([], [], [], [])

            def made(batch: pa.RecordBatch = batch, rows: list[int] = rows, columns: tuple[list, ...] = columns) -> pa.RecordBatch:
                types = [pa.int32()] * 3 + [pa.binary()]
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                out = pa.record_batch([batch.column(0).take(pa.array(rows, pa.int32())), *arrays[:3], arrays[3].cast(pa.string())], ["doc_id", "line", "pos", "part_pos", "word"])
                for held in (rows, *columns):
                    held.clear()
                return out

            lines, positions, parts, words = columns
            for i, (first, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                if not text.is_valid:
                    continue
                for line, value in enumerate(plain(text.as_py()).split(b"\n"), first):
                    for pos, token in enumerate(value.split()):
                        for part, word in judge[token]:
                            rows.append(i)
                            lines.append(line)
                            positions.append(pos)
                            parts.append(part)
                            words.append(word)
                if len(rows) >= MADE:
                    yield made()
            yield made()

    return place


def _rows(texts: DataFrame, judge: dict[bytes, Parts]) -> DataFrame:
    own = texts.select("doc_id", "line", F.col("text").cast("binary").alias("text"))
    schema = StructType([StructField("doc_id", texts.schema["doc_id"].dataType), *StructType.fromDDL(_FOUND).fields])
    return own.mapInArrow(_placed(judge), schema)


def occurrences(texts: DataFrame, words: list[str], min_length: int = 1) -> DataFrame:
    """(doc_id, line, pos, part_pos, word): every misspelt word of texts(doc_id, line, text), whose first lines are numbered; `words` are the valid ones."""
    return _rows(texts, judge(words, min_length))


def places(texts: DataFrame, tokens: list[str]) -> DataFrame:
    """(doc_id, line, pos, token): where some tokens are in texts(doc_id, line, text)."""
    wanted = Wanted({t.encode(): ((0, t.encode()),) for t in tokens})
    return _rows(texts, wanted).select("doc_id", "line", "pos", F.col("word").alias("token"))


def _parts(judge: Judge) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, part, word) for i, token in enumerate(batch.column(0).to_pylist()) for part, word in judge.judged(token)]
            rows, pos, words = zip(*found, strict=True) if found else ((), (), ())
            own = batch.column(0).take(pa.array(rows, pa.int32()))
            yield pa.record_batch([own.cast(pa.string()), pa.array(pos, pa.int32()), pa.array(words, pa.binary()).cast(pa.string())], ["token", "part_pos", "word"])

    return parts


def invalid_parts(tokens: DataFrame, words: list[str], min_length: int = 1) -> DataFrame:
    """(token, part_pos, word): what to flag of tokens(token), each of which is asked once."""
    return tokens.select(F.col("token").cast("binary")).where("token IS NOT NULL").mapInArrow(_parts(judge(words, min_length)), "token string, part_pos int, word string")


def compounds(w: bytes, v: bytes) -> tuple[bytes, ...]:
    """Two cleaned words as one token, in camel, snake, kebab, dotted and acronym form."""
    capital = v[:1].upper() + v[1:]
    return w + capital, w + b"_" + v, w + b"-" + v, w + b"." + v, w.upper() + capital


class Pairs:
    """What to flag of the compounds of pairs of cleaned words. A word's own parts are told once, as separators, and most changes of case, cut a compound where its words meet."""

    def __init__(self, judge: Judge) -> None:
        self.judge, self.own = judge, {}

    def parts(self, word: bytes) -> tuple[int, Parts]:
        """How many parts a word has, and which to flag."""
        if (known := self.own.get(word)) is None:
            if len(self.own) >= HELD:
                self.own.clear()
            cut = [p for p in _BETWEEN.split(word) if p]
            known = self.own[word] = len(cut), tuple((i, p) for i, p in enumerate(cut) if self.judge.bad(p))
        return known

    def flagged(self, w: bytes, v: bytes) -> Iterator[tuple[bytes, Parts]]:
        camel, snake, kebab, dotted, acronym = compounds(w, v)
        words, least = self.judge.words, self.judge.least
        whole = len(w) + len(v) >= least and (w + v).lower() in words
        number, first = self.parts(w)
        met = lambda n, a, b: (*a, *((n + i, p) for i, p in b)) if b else a
        both = met(number, first, self.parts(v)[1])
        if not (len(snake) >= least and snake.lower() in words):
            yield snake, both
        if whole:
            return
        yield kebab, both
        if not (w.lower() in words and v.lower() in words):
            yield dotted, both
        capital = camel[len(w) :]
        large = b"A" <= capital[:1] <= b"Z"
        yield camel, met(number, first, self.parts(capital)[1]) if large and b"a" <= w[-1:] <= b"z" else self.judge.judged(camel)
        if acronym != camel:
            upper = acronym[: len(w)]
            apart = large and b"A" <= upper[-1:] <= b"Z" and b"a" <= capital[1:2] <= b"z"
            yield acronym, met(self.parts(upper)[0], self.parts(upper)[1], self.parts(capital)[1]) if apart else self.judge.judged(acronym)


def _of_pairs(judge: Judge) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = Pairs(judge)
        for batch in batches:
            tokens: list[bytes] = []
            positions: list[int] = []
            words: list[bytes] = []
            for group in batch.column(0).to_pylist():
                seen: set[bytes] = set()
                for pair in group:
                    w, _, v = pair.partition(b" ")
                    for token, found in pairs.flagged(w, v):
                        if len(group) > 1:
                            if token in seen:
                                continue
                            seen.add(token)
                        for pos, word in found:
                            tokens.append(token)
                            positions.append(pos)
                            words.append(word)
            yield pa.record_batch([pa.array(tokens, pa.binary()).cast(pa.string()), pa.array(positions, pa.int32()), pa.array(words, pa.binary()).cast(pa.string())], ["token", "part_pos", "word"])

    return parts


def compound_parts(groups: DataFrame, words: list[str], min_length: int = 1) -> DataFrame:
    """(token, part_pos, word): what to flag of the compounds of groups(pairs). Pairs that make the same token are in one group."""
    own = groups.select(F.col("pairs").cast("array<binary>"))
    return own.mapInArrow(_of_pairs(judge(words, min_length)), "token string, part_pos int, word string")


def _rolled(judge: Judge) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    place = pa.struct([("line", pa.int32()), ("pos", pa.int32()), ("part_pos", pa.int32())])

    def rolled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            columns: tuple[list, ...] = ([], [], [], [], [], [])

            def made(batch: pa.RecordBatch = batch, rows: list[int] = rows, columns: tuple[list, ...] = columns) -> pa.RecordBatch:
                words, counts, lines, *firsts = columns
                first = pa.StructArray.from_arrays([pa.array(f, pa.int32()) for f in firsts], fields=list(place))
                arrays = [pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(lines, pa.list_(pa.int32())), first]
                out = pa.record_batch([batch.column(0).take(pa.array(rows, pa.int32())), *arrays], ["doc_id", "word", "n", "lines", "first"])
                for held in (rows, *columns):
                    held.clear()
                return out

            for i, (line, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                if not text.is_valid:
                    continue
                seen: dict[bytes, list] = {}
                for line, value in enumerate(plain(text.as_py()).split(b"\n"), line):
                    for pos, token in enumerate(value.split()):
                        for part, word in judge[token]:
                            if (own := seen.get(word)) is None:
                                seen[word] = [1, [line], line, pos, part]
                            else:
                                own[0] += 1
                                if own[1][-1] != line:
                                    own[1].append(line)
                rows += [i] * len(seen)
                columns[0].extend(seen)
                for column, values in zip(columns[1:], zip(*seen.values(), strict=True), strict=bool(seen)):
                    column.extend(values)
                if len(rows) >= MADE:
                    yield made()
            yield made()

    return rolled


def misspellings(texts: DataFrame, words: list[str], min_length: int = 1) -> DataFrame:
    """(doc_id, word, n, lines, first) of each row of texts(doc_id, line, text), as `check.misspellings` rolls up its occurrences: nothing is shuffled."""
    own = texts.select("doc_id", "line", F.col("text").cast("binary").alias("text"))
    found = "word string, n long, lines array<int>, first struct<line: int, pos: int, part_pos: int>"
    schema = StructType([StructField("doc_id", texts.schema["doc_id"].dataType), *StructType.fromDDL(found).fields])
    return own.mapInArrow(_rolled(judge(words, min_length)), schema)
