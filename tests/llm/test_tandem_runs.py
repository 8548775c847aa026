"""Periodic runs against a look at every distance."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import sorted_rows
from tests.llm.corpus import awkward, words
from wordloom.llm import tandem_runs as R


def plain_runs(w):
    """(start, length, period) by trying every period."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def expected(doc_id, text):
    w = words(text)
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, len(runs), *told, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in dropped))


def triples(string):
    return [(s, e - s, p) for s, e, p in R.all_runs(np.array(string, np.int64)).tolist()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=60))
def test_small_alphabets(string):
    assert triples(string) == plain_runs(string)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 7)), min_size=1, max_size=8))
def test_strings_of_powers(blocks):
    string = [x for root, power in blocks for x in root * power]
    assert triples(string) == plain_runs(string)


def test_special_strings():
    fibonacci = [[1], [0]]
    for _ in range(12):
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for string in ([0] * 500, [0, 1] * 200, fibonacci[-1], [0] * 5, [0] * 6, [0, 1] * 4, ([0] * 7 + [1]) * 9, list(range(50)) * 5 + list(range(50, 0, -1)) * 4, ([0, 1, 2] * 5 + [9]) * 6):
        assert triples(string) == plain_runs(string)


def test_vocabulary_of_squares_is_located_everywhere():
    """A short square on the left, and longer runs of its rotations inside one block of the rest."""
    root = [1, 2, 3, 4, 5]
    string = root * 2 + [7] + (root[2:] + root[:2]) * 5 + [8] + [9] + (root[2:] + root[:2]) * 5 + [10] + root * 4 + root[:3]
    assert triples(string) == plain_runs(string)


def rows():
    rng = random.Random(3)
    texts = [t for _, t in awkward()]
    texts += ["spam " * 50, "a b " * 9 + "c", "one two three " * 4, "x " * 5, "x y " * 6, "\x0bq\x0cq\tq\nq\rq q", None, "", " \n "]
    texts += [" ".join(rng.choice("ab") * rng.randrange(1, 3) for _ in range(200)) for _ in range(20)]
    texts += [" ".join([str(i) for i in range(300)] * 7 + ["end"])]
    out = list(enumerate(texts))
    return out + [(i, " ".join(f"w{j * j % 97}" for j in range(30 + i))) for i in range(500, 700)] + [(None, "x " * 9), (3, "repeat " * 8), (3, "repeat " * 8)]


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_documents(spark, make):
    got = sorted_rows(R.periodic_runs(make(rows())).select(*COLUMNS))
    assert got == sorted((expected(*r) for r in rows()), key=repr)
    assert sum(r[1] > 0 for r in got) > 30


def test_empty_table(spark, make):
    assert R.periodic_runs(make([])).collect() == []


def test_groups_of_texts_do_not_meet(monkeypatch):
    """Texts that are searched together have the runs that each has alone."""
    import pyarrow as pa

    texts = [t for _, t in rows()]
    ids = [None] * len(texts)
    together = R.batch_runs(ids, pa.array(texts, pa.string()))
    monkeypatch.setattr(R, "TOGETHER", 1)
    assert together == R.batch_runs(ids, pa.array(texts, pa.string()))


def test_words_with_one_hash_are_told_apart(monkeypatch):
    import pyarrow as pa

    from wordloom.llm import textblocks as T

    monkeypatch.setattr(T, "span_hashes", lambda data, starts, ends, secret=0: (ends - starts).astype(np.uint64))
    texts = ["aa bb " * 6, "aa bb cc dd " * 5, "aa bb cc aa dd bb cc aa bb"]
    got = R.batch_runs([None] * 3, pa.array(texts))
    assert got == [expected(None, t) for t in texts]


@pytest.mark.parametrize("n", [1, 10, 1000])
def test_periodic_index(n):
    for doc_id in range(200):
        index = R.periodic_index(doc_id, n)
        assert (index is not None) == (zlib.crc32(str(doc_id).encode()) % 10 == 0)
