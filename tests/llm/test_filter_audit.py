"""The filter audit against a plain walk of every document through every order."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from tests.llm.corpus import awkward, words
from tests.llm.conftest import DOCUMENTS
from wordloom.llm.filter_audit import filter_audit


def failing(text):
    w = words(text)
    checks = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
    return {f for f, fails in checks.items() if fails}


def plain(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    smallest = {}
    for i, text, _ in rows:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for i, text, lang in rows:
        fails = failing(text or "")
        first = smallest.get(text or "")
        if first is not None and (i is None or first < i):
            fails |= {"E"}
        parts[lang or ""].append((fails, i in good, i in toxic))
    out = set()
    for part, docs in parts.items():
        lost, found = Counter(), []
        for order in permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                lost[f] += len(gone)
                found.append((part, "".join(order), k, f, len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out |= {(*r[:3], *r[4:], lost[r[3]]) for r in found}
    return out


@pytest.fixture(scope="module")
def rows():
    texts = [t for _, t in awkward()]
    long = " ".join(f"w{i}" for i in range(250))
    made = [(i, t, ("en", "de", None, "")[i % 4]) for i, t in enumerate(texts)]
    made += [(1000 + i, t, "en") for i, t in enumerate([long, long + " $", "UPPER " * 300, long, long.upper(), "a b " * 100 + "#", "", None])]
    made += [(None, long, "en"), (None, "only nameless", "fr"), (None, "only nameless", "fr"), (1000, long, "fr"), (1000, long, "fr"), (1003, long, "fr")]
    return made


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_every_order_and_step(spark, rows):
    docs = spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in rows], DOCUMENTS).selectExpr("*", "'clash' as mask", "'clash' as part", "1 as n", "2 as digest")
    labels = [(0, 1, 0), (0, 0, 1), (1, None, 1), (2, 1, None), (3, 0, 0), (1000, 1, 1), (1001, 1, 0), (1003, 0, 1), (None, 1, 1), (99999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'clash' as part")
    got = [tuple(r[c] for c in COLUMNS) for r in filter_audit(docs, table).collect()]
    expected = plain(rows, labels)
    assert set(got) == expected
    assert len(got) == len(expected) == 600 * 4


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCUMENTS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(none, labels).collect() == []
    one = spark.createDataFrame([(1, None, None, None, None)], DOCUMENTS)
    got = filter_audit(one, labels).collect()
    assert len(got) == 600
    assert {(r["removed"], r["good_lost"]) for r in got if r["filter_order"][r["step"] - 1] == "A"} == {(1, 0)}


def test_step_is_a_subset_difference(spark, rows):
    """What an order leaves depends on the set of filters that were applied, not on their order."""
    docs = spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in rows], DOCUMENTS)
    got = filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    kept = defaultdict(set)
    for r in got:
        kept[r["part"], frozenset(r["filter_order"][: r["step"]])].add(r["kept"])
    assert all(len(v) == 1 for v in kept.values())
