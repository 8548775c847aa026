"""Every registered query of the spelling operators against its SQL counterpart, on the smallest tables."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wordloom import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def rows(frame: pd.DataFrame) -> list[str]:
    columns = sorted(frame.columns)
    plain = lambda v: None if not isinstance(v, str) and pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v
    return sorted(repr(tuple(plain(v) for v in row)) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    got, expected = catalogue.queries()[name](spark, SF).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_fixed_lines(spark):
    """q25 has no SQL: its lines are those of a plain rewrite of the same words."""
    import hashlib

    from wordloom.catalogue import _typed, q25_fix_lines
    from tests.plain import rewritten

    docs, found = _typed(spark, SF)
    text = {r["doc_id"]: r["text"].split("\n") for r in docs.collect()}
    top = {r["word"]: r["suggestions"][0] for r in found.suggested.collect() if r["suggestions"]}
    words: dict[tuple, dict[str, str]] = {}
    for r in found.occurrences.orderBy("doc_id", "line", "pos", "part_pos").collect():
        if r["word"] in top:
            words.setdefault((r["doc_id"], r["line"]), {}).setdefault(r["word"].lower(), top[r["word"]])
    expected = set()
    for (doc_id, line), fixes in words.items():
        old = text[doc_id][line - 1]
        if (new := rewritten(old, list(fixes.items()))) != old:
            expected.add((doc_id, line, hashlib.md5(old.encode()).hexdigest(), hashlib.md5(new.encode()).hexdigest()))
    got = {(r["doc_id"], r["line"], r["old_md5"], r["new_md5"]) for r in q25_fix_lines(spark, SF).collect()}
    assert got == expected
    assert len(got) > 100


def test_diff_of_all_documents(spark):
    """q33 has no SQL: its hunks are those of a plain rewrite of the same words, over all documents."""
    from wordloom.catalogue import _typed, q33_diff_documents
    from tests.plain import rewritten

    docs, found = _typed(spark, SF)
    text = {r["doc_id"]: r["text"].split("\n") for r in docs.collect()}
    top = {r["word"]: r["suggestions"][0] for r in found.suggested.collect() if r["suggestions"]}
    words: dict[tuple, dict[str, str]] = {}
    for r in found.occurrences.orderBy("doc_id", "line", "pos", "part_pos").collect():
        if r["word"] in top:
            words.setdefault((r["doc_id"], r["line"]), {}).setdefault(r["word"].lower(), top[r["word"]])
    expected = set()
    for (doc_id, line), fixes in words.items():
        old = text[doc_id][line - 1]
        if (new := rewritten(old, list(fixes.items()))) != old:
            expected.add((doc_id, line, f"@@ line {line}\n-{old}\n+{new}"))
    got = [tuple(r) for r in q33_diff_documents(spark, SF).select("doc_id", "line", "hunk").collect()]
    assert sorted(got) == sorted(expected)
    assert len({doc_id for doc_id, *_ in got}) > 100


def test_markdown_of_all_documents(spark):
    """q34's lines are those of a plain walk, over all documents and the fixtures."""
    import re

    from tests.plain import markdown_kept
    from wordloom.catalogue import _docs, _with_markdown, q34_markdown_documents

    texts = {r["doc_id"]: r["text"] for r in _with_markdown(_docs(spark, SF)).collect()}
    expected = [(i, n, kept) for i, text in texts.items() for n, kept in enumerate((re.sub(" +", " ", line.strip()) for line in markdown_kept(text)), 1)]
    got = [(r["doc_id"], r["line"], r["kept"]) for r in q34_markdown_documents(spark, SF).collect()]
    assert sorted(got) == sorted(expected)
    assert min(texts) == -7
    assert len(texts) == 7 + spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sum(kept == "" for *_, kept in got) > 100


MARKDOWN_KEPT = {
    1: ["", "", "", "prose teh", "", "", "", "after end"],
    2: ["", "", "", "", "", "text"],
    3: ["before", "", "", "", "after two"],
    4: ["", "", ""],
    5: ["", "", "", "prose", "", "", ""],
    6: ["a b", "tail", "b ` c"],
    7: ["", "teh"],
}
DIFF_ROWS = [(1, 1, "@@ line 1\n-teh wrod\n+the word"), (2, 1, "@@ line 1\n-Teh Cat\n+The Cat"), (3, 1, "@@ line 1\n-TEH `teh` x-teh\n+THE `the` x-the"), (5, 1, "@@ line 1\n-recieve\n+receive"), (5, 2, "@@ line 2\n-ok recieve\n+ok receive")]


def test_markdown_of_the_fixtures(spark):
    from wordloom import fixtures
    from wordloom.functions import text as T
    from wordloom.operators import markdown, preprocess

    docs = spark.createDataFrame(fixtures.MARKDOWN, "doc_id long, text string")
    kept = preprocess.lines(markdown.blank_markdown(docs)).withColumn("kept", F.regexp_replace(T.trim(F.col("value")), " +", " "))
    assert {(r["doc_id"], r["line"], r["kept"]) for r in kept.collect()} == {(i, n, v) for i, rows in MARKDOWN_KEPT.items() for n, v in enumerate(rows, 1)}


def test_diff_of_the_fixtures(spark):
    from wordloom import fixtures
    from wordloom.operators import rewrite
    from wordloom.plans.check import Options, check

    docs = spark.createDataFrame(fixtures.FIXABLE, "doc_id long, text string")
    found = check(docs, Options(spark.createDataFrame([(w,) for w in fixtures.LEXICON], "word string")))
    hunks = rewrite.diff(rewrite.fixes(docs, found.occurrences, found.suggested))
    assert {tuple(r) for r in hunks.collect()} == set(DIFF_ROWS)
