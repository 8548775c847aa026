"""What is decided on texts' bytes, against joins, folds and plain definitions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.plain import rewritten
from tests.test_in_place import ODD, VALID
from wordloom import catalogue
from wordloom.functions import judging, rewriting
from wordloom.operators import check as C
from wordloom.operators import lint, preprocess, report
from wordloom.plans.check import Options, check

TEXTS = [(1, " ".join(ODD)), (2, "foo qux\nqux https://a.b/c deadbeef00 foo\tbaz bar\n\n qux"), (3, "spellcheck:off\nhid\nspellcheck:on\nseen qux foo\nqux seen"), (4, None), (5, ""), (6, "qux Qux\nFOO it's its its fooQux\nGithub github-x githubx")]


def _valid(spark):
    return spark.createDataFrame([(w,) for w in VALID], "word string")


def _texts(spark, more=()):
    return spark.createDataFrame([*TEXTS, *more], "doc_id long, text string")


def test_quotes_after_a_separator_are_parts(spark, monkeypatch):
    """`qux.'` has two parts, where it stands as where it is joined."""
    tokens = spark.createDataFrame([(1, 1, 0, "qux.'"), (1, 1, 1, "qux,'")], "doc_id long, line int, pos int, token string")
    got = sorted(map(tuple, C.occurrences(tokens, C.valid_words(_valid(spark))).collect()))
    assert got == [(1, 1, 0, 0, "qux"), (1, 1, 0, 1, "'"), (1, 1, 1, 0, "qux'")]


@pytest.mark.parametrize("least", [1, 4])
def test_occurrences_agree_with_joins(spark, monkeypatch, least):
    valid = C.valid_words(_valid(spark))
    got = sorted(map(tuple, judging.occurrences(preprocess.numbered_texts(_texts(spark)), C.listed(valid), least).collect()))
    monkeypatch.setattr(C, "listed", lambda *_: None)
    assert got == sorted(map(tuple, C.occurrences(preprocess.tokens(_texts(spark)), valid, least).collect()))
    assert {r[0] for r in got} >= {1, 3, 6}


def test_compounds_agree_with_tokens(spark):
    words = [w.encode() for w in ["foo", "Foo", "qux", "QUX", "it's", "a_b", "_x", "x_", "9q", "q9", "bar", "B", "b", "'", "k", "bA", "Bar", "foo9", "el", "vin", "ABc", "cD"]]
    for least in (1, 4):
        judge = judging.judge([*VALID, "foo_bar", "foobar", "kelvin"], least)
        for w, v in itertools.product(words, words):
            expected = {t: judge.judged(t) for t in judging.compounds(w, v)}
            assert {t: p for t, p in judging.Pairs(judge).flagged(w, v) if p} == {t: p for t, p in expected.items() if p}, (w, v)


def test_compounds_are_judged_as_pairs(spark, tmp_path):
    spark.createDataFrame([(1, "foo Qux a bc ab c\nA_b it's"), (2, "a bc qux.\nAb C")], "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(str(tmp_path / "documents.parquet"))
    made = catalogue.q08_dotted_tokens(spark, str(tmp_path))
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    expected = C.invalid_parts(catalogue._compounds(spark, str(tmp_path)), C.valid_words(catalogue._lexicon(spark, str(tmp_path))))
    got = sorted(map(tuple, made.collect()))
    assert got == sorted(map(tuple, expected.collect())) and got


def test_changed_lines():
    chance = random.Random(7)
    pieces = ["teh", "Teh", "TEH", "it's", "its", "é", "_", "-", " ", " ", "x", "'", ".", "cta", "the"]
    for _ in range(3000):
        line = "".join(chance.choices(pieces, k=chance.randrange(1, 12)))
        fixes = [(w, chance.choice(["the", "cat", "it's", "teh"])) for w in chance.sample(["teh", "it's", "cta", "its", "x"], k=chance.randrange(1, 5))]
        expected = rewritten(line, fixes)
        rows = [(2, i, 0, w.encode(), r) for i, (w, r) in enumerate(fixes)]
        chance.shuffle(rows)
        got = list(rewriting.changed(f"a\n{line}\n".encode(), [*rows, (9, 0, 0, b"a", "b")]))
        assert got == ([(2, line.encode(), expected.encode())] if expected != line else [])


def test_fixes_ask_no_terminology(spark, monkeypatch):
    def fail(*_, **__):
        raise AssertionError("terminology was asked")

    monkeypatch.setattr(lint, "findings", fail)
    monkeypatch.setattr(lint, "forms", fail)
    found = check(_texts(spark), Options(_valid(spark)))
    assert found.occurrences.count() > 10


def test_words_are_rolled_up_where_texts_are(spark):
    for more in ((), [(2, "baz qux\nqux")]):
        docs = _texts(spark, more)
        found = check(docs, Options(_valid(spark)), by_document=True)
        expected = check(docs, Options(_valid(spark)))
        assert sorted(map(repr, found.misspelt.collect())) == sorted(map(repr, expected.misspelt.collect()))
        if not more:
            assert "hashpartitioning(doc_id" not in found.misspelt._jdf.queryExecution().executedPlan().toString()
        terms = lint.findings(preprocess.tokens(docs))
        assert sorted(map(repr, found.findings.collect())) == sorted(map(repr, terms.collect())) and not terms.isEmpty()
        assert report.json_report(docs, found.misspelt, found.findings).count() == docs.count()
