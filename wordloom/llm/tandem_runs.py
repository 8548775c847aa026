r"""Periodic runs: stretches of words that repeat a period four times or more, and texts without the repeats.

Method: tandem repeats after Gusfield and Stoye, on a suffix tree held as a
suffix array, whose nodes are intervals of it.

1. A text can have a run only if some five words come twice at most two words
   apart, or three times. Other texts, most of prose, end here. The rest of a
   batch is joined to one string with a separator of its own after each text.
2. The string's blocks of 2**j words get order-preserving names, level by level,
   until all differ: the last names are the suffix array, and common extensions
   of any two places to the right or left come from the names, without hashing.
3. The string is cut into Lempel-Ziv blocks. Around each block's ends, squares
   are found for every period that G. and S. try there, which cover the leftmost
   square of each kind; each is widened to the run it lies in.
4. From the last square of each run the suffix link is followed: the square
   without its first word, with that word after it, is looked up in the tree, and
   where it exists the walk goes on from the runs it lies in. A run holds all
   that a walk meets inside it, so that a walk takes one step a run.
5. Each square of that vocabulary is located wherever it occurs, as the interval
   of its suffixes; occurrences are widened and merge into runs. Of equal runs
   that with the smallest period counts.

Defined results: a null or empty text has no words, no run, and the digest of
the empty string twice. A null doc_id has no checksum, so its text is taken as
it is. Equal rows have equal results. Extra columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm import exchange as X
from wordloom.llm import textblocks as T

LEAST_LENGTH, LEAST_POWER = 6, 4
#: Words that have a repeat in every run: one less than the shortest run.
PROBE = LEAST_LENGTH - 1
#: Words of texts that are searched together; a longer text is searched alone.
TOGETHER = 1 << 17
#: Bytes compared at once when word numbers are verified.
COMPARED = 1 << 20

RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Names:
    """Order-preserving names of all blocks of 2**j words of a string of numbers, and its suffix array."""

    def __init__(self, string: np.ndarray) -> None:
        n = len(string)
        self.n = n
        names = np.unique(string, return_inverse=True)[1].astype(np.int64) + 1  # 0 stands for what is beyond the end
        levels, size = [names], 1
        while True:
            beyond = np.zeros(n, np.int64)
            beyond[: n - size] = names[size:]
            names = np.unique(names * (n + 2) + beyond, return_inverse=True)[1].astype(np.int64) + 1
            if n == 0 or names.max() == n:
                break
            levels.append(names)
            size *= 2
        self.order = np.empty(n, np.int64)
        self.order[names - 1] = np.arange(n)
        self.rank = names - 1
        self.levels = np.zeros((len(levels), n + 1), np.int32)
        for j, level in enumerate(levels):
            self.levels[j, :n] = level

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree from places a and b on; a and b differ and are at most n."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        some = np.flatnonzero(self.levels[0][a] == self.levels[0][b])
        for j in range(len(self.levels) - 1, -1, -1):
            if not len(some):
                break
            same = some[self.levels[j][a[some]] == self.levels[j][b[some]]]
            a[same] += 1 << j
            b[same] += 1 << j
            out[same] += 1 << j
        return out

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree from places a and b back, these included; either may be before the string."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        some = np.flatnonzero(np.minimum(a, b) >= 0)
        some = some[self.levels[0][a[some]] == self.levels[0][b[some]]]
        for j in range(len(self.levels) - 1, -1, -1):
            if not len(some):
                break
            inside = some[np.minimum(a[some], b[some]) >= (1 << j) - 1]
            step = (1 << j) - 1
            same = inside[self.levels[j][a[inside] - step] == self.levels[j][b[inside] - step]]
            a[same] -= 1 << j
            b[same] -= 1 << j
            out[same] += 1 << j
        return out

    def squares(self, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the suffix array of all occurrences of xx, for x the `period` words at each place; empty if there is none."""
        level = np.frexp(period.astype(np.float64))[1] - 1
        rest = period - (np.int64(1) << level.astype(np.int64))
        wanted = (self.levels[level, at], self.levels[level, at + rest])

        def bound(upper: bool) -> np.ndarray:
            low, high = np.zeros(len(at), np.int64), np.full(len(at), self.n)
            while (low < high).any():
                middle = (low + high) // 2
                place = self.order[np.minimum(middle, self.n - 1)]
                sign = np.zeros(len(at), np.int64)
                for shift in (0, period):  # two halves, each by two blocks that overlap
                    for more, name in ((0, wanted[0]), (rest, wanted[1])):
                        found = self.levels[level, np.minimum(place + shift + more, self.n)].astype(np.int64)
                        sign = np.where(sign == 0, np.sign(found - name), sign)
                right = (sign <= 0) if upper else (sign < 0)
                right &= low < high
                low = np.where(right, middle + 1, low)
                high = np.where(right | (low >= high), high, middle)
            return low

        return bound(False), bound(True)


def _lempel_ziv(names: Names) -> np.ndarray:
    """Where each block starts: the longest stretch that also starts earlier, or one new word."""
    before, after = _smaller(names.order, names.n)
    at = np.arange(names.n)
    longest = np.zeros(names.n, np.int64)
    for other in (before, after):
        has = np.flatnonzero(other >= 0)
        longest[has] = np.maximum(longest[has], names.ahead(at[has], other[has]))
    steps, starts, i = np.maximum(longest, 1).tolist(), [], 0
    while i < names.n:
        starts.append(i)
        i += steps[i]
    return np.array(starts, np.int64)


def _smaller(order: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the next earlier place on either side of it in the suffix array, or -1."""
    before, after = [-1] * n, [-1] * n
    stack: list[int] = []
    for place in order.tolist():
        while stack and stack[-1] > place:
            after[stack.pop()] = place
        if stack:
            before[place] = stack[-1]
        stack.append(place)
    return np.array(before, np.int64), np.array(after, np.int64)


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and which number, for the numbers of all ranges."""
    of = np.repeat(np.arange(len(count)), count)
    return of, first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)


def _widened(names: Names, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The distinct stretches (start, end, period) around places where the words `period` on are the same often enough for a square."""
    start = at - names.behind(at - 1, at + period - 1)
    end = at + period + names.ahead(at, at + period)
    found = end - start >= 2 * period
    return _least_period(np.stack((start[found], end[found], period[found]), axis=1))


def _least_period(runs: np.ndarray) -> np.ndarray:
    """Of runs with the same ends that with the smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[new]


def _leftmost_covering(names: Names) -> np.ndarray:
    """The runs of squares around the ends of Lempel-Ziv blocks."""
    starts = _lempel_ziv(names)
    ends = np.append(starts[1:], names.n)
    beyond = np.append(ends[1:], names.n)
    # squares whose second half reaches over the end of a block: periods up to the block's length, back from its end
    of, period = _spread(np.ones(len(starts), np.int64), ends - starts)
    right = ends[of]
    at_end, period_end = right - period, period
    inside = right < names.n
    # squares around the start of a block: periods up to its length and the next one's
    of, period = _spread(np.ones(len(starts), np.int64), beyond - starts)
    at_start = starts[of]
    here = at_start + period < names.n
    at, period = np.concatenate((at_end[inside], at_start[here])), np.concatenate((period_end[inside], period[here]))
    same = names.levels[0][at] == names.levels[0][at + period]  # a square takes a step to the right
    return _widened(names, at[same], period[same])


def all_runs(string: np.ndarray) -> np.ndarray:
    """(start, end, period) of every maximal run of a string of numbers with at least four periods and six places, by start and period."""
    names = Names(string)
    known = new = _leftmost_covering(names)
    seen = np.zeros(0, np.int64)
    while len(new):
        # the vocabulary: each run's first square, and the one that the suffix link of its last square leads to
        start, end, period = new.T
        link = end - 2 * period + 1
        at, twice = np.concatenate((start, link)), np.concatenate((period, period))
        low, high = names.squares(at, twice)
        locus = low * (names.n + 1) + twice
        fresh = np.flatnonzero((high > low) & ~np.isin(locus, seen))
        fresh = fresh[np.unique(locus[fresh], return_index=True)[1]]
        seen = np.concatenate((seen, locus[fresh]))
        of, leaf = _spread(low[fresh], high[fresh] - low[fresh])
        located = _widened(names, names.order[leaf], twice[fresh][of])
        both = _least_period(np.concatenate((known, located)))
        old = set(map(tuple, known.tolist()))
        new = np.array([r for r in map(tuple, both.tolist()) if r not in old], np.int64).reshape(-1, 3)
        known = both
    size = known[:, 1] - known[:, 0]
    known = known[size >= np.maximum(LEAST_LENGTH, LEAST_POWER * known[:, 2])]
    return known[np.lexsort((known[:, 2], known[:, 0]))]


def periodic_index(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a text of n words, if the id's checksum makes the text periodic."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    index = np.arange(n)
    index[a:] = a + (index[a:] - a) % period
    return index


def _suspects(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which texts may have a run, by hashes of their words: some PROBE words come twice at most two places apart, or three times."""
    grams = T.window_hashes(hashes, PROBE)
    text = np.repeat(np.arange(len(counts) - 1), np.diff(counts))[: len(grams)]
    at = np.flatnonzero(np.arange(len(grams)) + PROBE <= counts[text + 1])
    keys = T.mix(grams[at] ^ T.mix(text[at].astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], at[order]
    twice = (keys[1:] == keys[:-1]) & (at[1:] - at[:-1] <= 2)
    thrice = keys[2:] == keys[:-2]
    return np.unique(np.concatenate((text[at[1:][twice]], text[at[2:][thrice]])))


def _numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each distinct word. Words with one hash are compared byte for byte with the first of them."""
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    one = first[number]
    sizes = ends - starts
    check = np.flatnonzero(one != np.arange(len(one)))
    good = (sizes[check] == sizes[one[check]]).all()
    cuts = np.searchsorted(np.cumsum(sizes[check]), np.arange(COMPARED, int(sizes[check].sum()), COMPARED)) if good else []
    for some in np.split(check, cuts) if good else []:
        good &= bool(T.same_bytes(data, starts[some], data, starts[one[some]], sizes[some]).all())
    if good:
        return number
    raw, numbers = data.tobytes(), {}
    return np.array([numbers.setdefault(raw[s:e], len(numbers)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])


class _Found:
    """The columns of RESULT for the texts of a batch."""

    def __init__(self, ids: list, texts: pa.Array) -> None:
        self.ids, self.texts = ids, texts
        self.rows: list[tuple] = [()] * len(ids)

    def settle(self, row: int, index: np.ndarray | None, runs: np.ndarray) -> None:
        words = (self.texts[row].as_py() or "").encode()
        words = words.split()  # at the same six bytes
        place = np.arange(len(words)) if index is None else index
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
        np.add.at(cover, runs[:, 1], -1)
        kept = place[np.cumsum(cover[:-1]) == 0]
        best = (None, None, None, None)
        for start, end, period in runs.tolist():
            if best[0] is None or (end - start) * best[2] > best[1] * period:
                best = (start, end - start, period, 1000 * (end - start) // period)
        listed = "".join(f"{s},{e - s},{p}\n" for s, e, p in runs.tolist())
        digest = lambda b: hashlib.sha256(b).hexdigest()
        self.rows[row] = (self.ids[row], len(runs), *best, digest(listed.encode()), digest(b" ".join([words[i] for i in kept.tolist()])))


def _search(found: _Found, together: list[tuple]) -> None:
    """The runs of texts that may have some, given as (row, bytes, starts, ends, hashes, index)."""
    before = np.cumsum([0] + [len(t[1]) for t in together])
    data = np.concatenate([t[1] for t in together])
    starts, ends = (np.concatenate([t[i] + b for t, b in zip(together, before, strict=False)]) for i in (2, 3))
    numbers = _numbers(data, starts, ends, np.concatenate([t[4] for t in together]))
    n = np.cumsum([0] + [len(t[4]) + 1 for t in together])
    string = np.empty(n[-1], np.int64)
    string[n[1:] - 1] = len(numbers) + np.arange(len(together))  # a separator of its own after each text
    apart = np.ones(len(string), bool)
    apart[n[1:] - 1] = False
    string[apart] = numbers
    runs = all_runs(string)
    cuts = np.searchsorted(runs[:, 0], n)
    for i, t in enumerate(together):
        own = runs[cuts[i] : cuts[i + 1]].copy()
        own[:, :2] -= n[i]
        found.settle(t[0], t[5], own)


def batch_runs(ids: list, texts: pa.Array) -> list[tuple]:
    """A row of RESULT for each text."""
    found = _Found(ids, texts)
    data, offsets = T.buffers(texts)
    none = np.zeros((0, 3), np.int64)
    together: list[tuple] = []
    for first, last in T.slices(offsets):
        own = data[offsets[first] : offsets[last]]
        starts, ends, counts = T.word_bounds(own, offsets[first : last + 1] - offsets[first])
        place = np.arange(len(starts))
        indexes = [periodic_index(ids[first + i], int(counts[i + 1] - counts[i])) for i in range(last - first)]
        for i, index in enumerate(indexes):
            if index is not None:
                place[counts[i] : counts[i + 1]] = counts[i] + index
        hashes = T.span_hashes(own, starts, ends)[place]
        suspects = set(_suspects(hashes, counts).tolist())
        for i, index in enumerate(indexes):
            if i not in suspects:
                found.settle(first + i, index, none)
                continue
            words = place[counts[i] : counts[i + 1]]
            base, high = offsets[first + i] - offsets[first], offsets[first + i + 1] - offsets[first]
            together.append((first + i, own[base:high], starts[words] - base, ends[words] - base, hashes[counts[i] : counts[i + 1]], index))
            if sum(len(t[4]) for t in together) >= TOGETHER:
                _search(found, together)
                together = []
    if together:
        _search(found, together)
    return found.rows


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    for batch in batches:
        rows = batch_runs(batch.column("doc_id").to_pylist(), batch.column("text"))
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in RESULT.split(", ")])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The rows of RESULT for docs(doc_id, text)."""
    X.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_batches, RESULT)


#: Every pair of equal words at every distance that a run may have.
SQL = r"""
WITH given AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: xor(c >> 1, 3988292384 * (c & 1)))) AS crc
  FROM documents
), hashed AS (SELECT doc_id, w, len(w) AS n, xor(crc, 4294967295) AS h FROM given
), shaped AS (SELECT *, (h // 10) % greatest(n, 1) AS a FROM hashed
), docs AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + (CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END)]) ELSE w END AS w FROM shaped
), words AS MATERIALIZED (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(w) AS word FROM docs
), same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), island AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM same
), stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM island GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)
), run AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY doc_id, start, length
), best AS (SELECT DISTINCT ON (doc_id) * FROM run ORDER BY doc_id, CAST(length AS DOUBLE) / period DESC, start, period
), listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(CAST(start AS BIGINT) || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM run GROUP BY doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run
), kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM docs d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
