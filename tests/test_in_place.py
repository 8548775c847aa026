"""Few valid words are looked up where a token stands, and fixes that are independent are made in one pass: with the results of joins and folds."""

from pyspark.sql import functions as F

from wordloom import catalogue
from wordloom.functions import text as T
from wordloom.operators import check as C
from wordloom.operators import preprocess, rewrite
from wordloom.operators import suggest as S
from wordloom.plans.check import Options, check, frequent_words

ODD = ["word.", "foo,", "\"Qux", "\".qux", "qux.\"", "(bazé)", "\u212aelvin", "\u212a", "qux..", ".qux", "QUX", "barQux.", "9qux", "_qux_", "qux_.",  "fooBar", "foo.bar", "foo..bar", "foo.baz", "Foo", "FOO-baz", "it's", "'", "9lives", "don't.foo", "aéB", "HTTPServer", "a\\b", "foo_Baz9", ".", "x.", "bazfoo/qux", "Éfoo", "_", "fooé.bar"]
VALID = ["k", "kelvin", "foo", "bar", "it's", "a\\b", "server", "''"]


def _texts(spark):
    return spark.createDataFrame([(1, " ".join(ODD)), (2, "foo qux\nqux https://a.b/c deadbeef00 foo\tbaz bar"), (3, "spellcheck:off\nhid\nspellcheck:on\nseen foo"), (4, None), (5, ""), (6, "qux\nFOO")], "doc_id long, text string")


def test_lookups_agree_with_joins(spark, monkeypatch):
    tokens = preprocess.tokens(_texts(spark))
    valid = C.valid_words(spark.createDataFrame([(w,) for w in VALID], "word string"))
    for least in (1, 4):
        got = sorted(map(tuple, C.occurrences(tokens, valid, least).collect()))
        parts = sorted(map(tuple, C.invalid_parts(tokens.select("token").distinct(), valid, least).collect()))
        with monkeypatch.context() as m:
            m.setattr(C, "listed", lambda *_: None)
            assert got == sorted(map(tuple, C.occurrences(tokens, valid, least).collect())) and got
            assert parts == sorted(map(tuple, C.invalid_parts(tokens.select("token").distinct(), valid, least).collect()))


def test_few_valid_words_join_nothing(spark):
    tokens = spark.createDataFrame([(1, 1, 0, "fooBar")], "doc_id long, line int, pos int, token string")
    valid = C.valid_words(spark.createDataFrame([("foo",)], "word string"))
    plan = C.occurrences(tokens, valid)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_tokens_are_found_once(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    plan = preprocess.tokens(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert "size(" not in plan


def test_deletions_of_queries_are_not_shuffled(spark):
    words = spark.createDataFrame([("fooo",), ("barr",), ("x" * 400,)], "word string")
    pairs = S.candidates(words, S.deletion_index(spark.createDataFrame([("foo",), ("bar",)], "word string")))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan
    assert sorted(map(tuple, pairs.collect())) == [("barr", "bar"), ("fooo", "foo")]


def test_lexicon_of_documents(spark):
    texts = _texts(spark).union(spark.createDataFrame([(6, "qqonly\nqqonly")], "doc_id long, text string"))
    words = preprocess.tokens(texts).select("doc_id", F.lower(T.clean_word(F.col("token"))).alias("word")).distinct()
    expected = {r["word"] for r in words.groupBy("word").count().where("count >= 2").where(T.is_suggestable(F.col("word"))).collect()}
    got = {r["word"] for r in frequent_words(texts).collect()}
    assert "qqonly" not in got and {"foo", "qux"} <= expected <= got


def test_independent_fixes(spark):
    rows = [(0, "Teh teh.TEH_ tehx TEH-cta 9teh", ["teh", "cta"], ["the", "cat"]), (1, "teh the", ["teh", "the"], ["the", "a"]), (2, "it's its", ["it's"], ["its"]), (3, "éteh teh", ["teh"], ["don't"]), (4, "", ["teh"], ["the"])]
    table = spark.createDataFrame(rows, "i long, line string, w array<string>, r array<string>")
    each = table.select("i", rewrite.independent(F.col("w"), F.col("r")).alias("one"), rewrite.rewritten_once(F.col("line"), F.col("w"), F.col("r")).alias("once"), rewrite.rewritten(F.col("line"), F.arrays_zip(F.col("w").alias("word"), F.col("r").alias("replacement"))).alias("fold")).orderBy("i").collect()
    assert [r["one"] for r in each] == [True, False, False, False, True]
    assert all(r["once"] == r["fold"] for r in each if r["one"]) and each[0]["once"].startswith("The the.")


def test_words_of_a_document_are_shuffled_by_document_once(spark):
    found = check(_texts(spark), Options(spark.createDataFrame([(w,) for w in VALID], "word string")))
    per_line = found.misspelt.select("doc_id", "word", F.explode("lines").alias("line")).groupBy("doc_id", "line").agg(F.count("*"))
    plan = per_line._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(doc_id") == 1
    assert {(r["doc_id"], r["word"]) for r in found.misspelt.where("doc_id in (2, 6)").collect()} == {(2, "qux"), (2, "baz"), (6, "qux")}


def test_odd_space(spark):
    texts = {"a b\nc": False, "é b": False, "– b": False, "a\tb": True, "a\u00a0b": True, "a\u2003b": True, "a\u3000b": True, "\ufeffa": True, "": False}
    for text, odd in texts.items():
        row = spark.createDataFrame([(text,)], "v string").select(T.odd_space(F.col("v")), T.tokens(F.col("v"))).first()
        assert row[0] == odd and row[1] == [t for t in text.replace("\ufeff", " ").split() if t]


def test_compounds_are_shuffled_once(spark, tmp_path):
    texts = [(1, "ab c a bc ab c\nA_b it's"), (2, "a bc\nAb C"), (3, None)]
    spark.createDataFrame(texts, "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(str(tmp_path / "documents.parquet"))
    made = catalogue._compounds(spark, str(tmp_path))
    pairs = {("ab", "c"), ("c", "a"), ("a", "bc"), ("bc", "ab"), ("A_b", "it's"), ("Ab", "C")}
    expected = {f for w, v in pairs for f in (w + v[0].upper() + v[1:], f"{w}_{v}", f"{w}-{v}", f"{w}.{v}", w.upper() + v[0].upper() + v[1:])}
    assert sorted(r["token"] for r in made.collect()) == sorted(expected)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [letters") == plan.count("Aggregate [") == 1
