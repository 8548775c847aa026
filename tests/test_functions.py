"""Column functions, distance and Markdown against plain definitions."""

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.functions.distance import alignment_distances
from tests.plain import markdown_kept
from tests.plain import rewritten as plain_rewritten
from wordloom.operators import markdown
from wordloom.operators.rewrite import rewritten


def plain_distance(a, b):
    rows = [list(range(len(b) + 1))]
    for i in range(1, len(a) + 1):
        row = [i]
        for j in range(1, len(b) + 1):
            v = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, rows[-2][j - 2] + 1)
            row.append(v)
        rows.append(row)
    return rows[-1][-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=7), st.text("abc", max_size=7)), min_size=1, max_size=20))
def test_alignment_distance(pairs):
    got = alignment_distances(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs]), 2)
    assert got.tolist() == [min(3, plain_distance(a, b)) for a, b in pairs]


def column(spark, expression, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_words(spark):
    assert column(spark, T.clean_word, "don't,", "café", "_x-1.") == ["don't", "caf", "_x1"]
    assert column(spark, T.split_identifiers, "XMLHttpRequest", "my_varible-one/two.js", "getSubcribeName", "__") == [["XML", "Http", "Request"], ["my", "varible", "one", "two", "js"], ["get", "Subcribe", "Name"], []]
    assert column(spark, T.word_form, "--back-end,", "'it's'", "_init", "(x)") == ["back-end", "it's", "_init", "x"]
    assert column(spark, T.group_key, "Back-End", "it's", "_x_86") == ["backend", "its", "x86"]
    assert column(spark, T.extension, "a.TS", ".bashrc", "noext", "a.b.md", "..x") == [".ts", "", "", ".md", ".x"]
    assert column(spark, T.comma_list, " a, ,b ,") == [["a", "b"]]


def test_match_case(spark):
    pairs = spark.createDataFrame([(0, "the", "TEH"), (1, "the", "Teh"), (2, "the", "teh"), (3, "the", "T"), (4, "the", "1x")], "i int, r string, o string")
    assert [r[0] for r in pairs.orderBy("i").select(T.match_case(F.col("r"), F.col("o"))).collect()] == ["THE", "The", "the", "The", "The"]


def test_noise(spark):
    strip = lambda v: F.array_join(T.tokens(T.strip_noise(v)), "|")
    values = ["see https://x.y/z?a=1 now", "mail a@b.c end", "0xDEADbeef deadbeef01 éabcdef12 x", "a b　c", "www.x.org www.", "HTTP://x stays"]
    assert column(spark, strip, *values) == ["see|now", "mail|end", "é|x", "a|b|c", "www.", "HTTP://x|stays"]


def plain_deletions(word, depth):
    out, level = {word}, {word}
    for _ in range(depth):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out |= level
    return out


@pytest.mark.parametrize("depth", [1, 2])
def test_deletions(spark, depth):
    words = ["teh", "aa", "letter", "ab"]
    got = column(spark, lambda v: T.deletions(v, depth), *words)
    assert [set(g) for g in got] == [plain_deletions(w, depth) for w in words]
    assert all(len(set(g)) == len(g) for g in got)


def blanked(spark, *texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r["text"] for r in markdown.blank_markdown(docs).orderBy("doc_id").collect()]


MARKDOWN = {
    "---\na\n---\nb": "\n\n\nb",
    "a\n---\nb": "a\n---\nb",
    "---\nnever closed": "\n",
    "~~~~\nx\n~~~\ny\n~~~~~\nz": "\n\n\n\n\nz",
    "```\nx\n~~~\n```": "\n\n\n",
    "<!-- a\nb --> c\nd": "\n\nd",
    "x <!-- a\nb": "x <!-- a\nb",
    "": "",
}


def test_markdown_blocks(spark):
    assert blanked(spark, *MARKDOWN) == list(MARKDOWN.values())
    assert blanked(spark, None) == [None]


def test_columns_stay(spark):
    assert blanked(spark, "a <!-- b --> `c` d", "`one\ntwo` `x`") == ["a" + " " * 16 + "d", "`one\ntwo   x`"]


PIECES = ["---", "--- ", "```", "````", "~~~", "  ~~~~", "```js", "<!--", " <!-- x", "-->", "y --> z", "<!-- a --> b", "prose", "", "`code` <!-- c --> x", "--> <!--", "\u00a0```", "---x", "`` ` ``", "- -->"]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(PIECES), min_size=1, max_size=25), min_size=20, max_size=40), st.sampled_from([1, 2, 3, 256]))
def test_markdown_against_a_walk(spark, texts, group):
    whole = ["\n".join(t) for t in texts]
    before, markdown.GROUP = markdown.GROUP, group  # groups of any size give the same
    try:
        assert blanked(spark, *whole) == ["\n".join(markdown_kept(t)) for t in whole]
    finally:
        markdown.GROUP = before


def test_markdown_of_many_events(spark):
    text = "\n".join(PIECES[i * i % len(PIECES)] for i in range(20_000))
    assert blanked(spark, text) == ["\n".join(markdown_kept(text))]


def rewrites(spark, *cases):
    rows = [(i, line, [{"word": w, "replacement": r} for w, r in fixes]) for i, (line, fixes) in enumerate(cases)]
    table = spark.createDataFrame(rows, "i int, line string, fixes array<struct<word:string,replacement:string>>")
    return [r["new"] for r in table.select("i", rewritten(F.col("line"), F.col("fixes")).alias("new")).orderBy("i").collect()]


def test_rewritten(spark):
    cases = [("Teh TEH teh x-teh tehs", [("teh", "the")]), ("a$b cat", [("cat", r"\1$0")]), ("teh", [("teh", "wrod"), ("wrod", "word")])]
    expected = ["The THE the x-the tehs", r"a$b \1$0", "word"]
    assert [plain_rewritten(*c) for c in cases] == expected
    assert rewrites(spark, *cases) == expected


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("ab'_ -éſK.A", max_size=14), st.lists(st.tuples(st.text("ab'_", min_size=1, max_size=3), st.text("ab'$\\", min_size=1, max_size=3)), max_size=4)), min_size=20, max_size=40))
def test_rewritten_against_a_walk(spark, cases):
    assert rewrites(spark, *cases) == [plain_rewritten(*c) for c in cases]


def test_trim(spark):
    import re

    values = ["", " ", "a", "\u00a0 a b \ufeff", "\u2003\u200b\u2003", "\n\x0b\x0cx\r", "\u3000é\u1680", "\x1cx\x85", *T.WHITE]
    assert column(spark, T.trim, *values) == [re.sub(r"^[\s\ufeff]+|[\s\ufeff]+\Z", "", v) if not set(v) & set("\x1c\x85") else v for v in values]
