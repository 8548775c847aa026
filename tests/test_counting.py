"""Words counted on bytes are those of the column expressions, and nothing but words and their counts is shuffled."""

from collections import Counter

from pyspark.sql import functions as F

from wordloom.functions import counting
from wordloom.functions import text as T
from wordloom.operators import preprocess
from wordloom.plans.check import frequent_words

TEXTS = [
    "Foo foo, FOO. don't 'tis a_b fo-o foo.bar", "see https://a.b/c?d www.x.y me@example.org, x@ @y 0xDEADbeef 0XZ 0x1g http:// https://", "ab deadbeef deadbeef0 (cafebabe) _cafebabe cafebabe_ xdeadbeef deadbeefx abad1dea!",
    "né\u00a0foo\u2003bar\u3000Qux\ufeffend\u202fx\u205fy\u1680z\u2028l\u2029p", "\u212aelvin É \u00e9 \u0130stanbul ſ ｗｗｗ", "a\tb\x0bc\fd\re\nf\x1cg\x85h \x1f", "éme@x.y \u00a0www.a\u2003b héhttp://q 0x\u00e9 é0xff deadbeef\u00e9 \u00e9deadbeef", "\U0001f600foo foo\U0001f600 \U0001f600", "", " \n ", None,
    "spellcheck:off\nhid https://x\nspellcheck:on\nseen foo\nspellcheck:disable-next-line\nhid\nfoo", "www.\nnext http\n://no 0x\nff a@\nb deadbe\nef",
]


def _docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_tokens_on_bytes(spark):
    each = preprocess.tokens(_docs(spark)).select("doc_id", "token").distinct().groupBy("token").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, preprocess.distinct_tokens(_docs(spark)).select("token", "n").collect())) == sorted(map(tuple, each.collect()))


def test_words_on_bytes(spark, monkeypatch):
    monkeypatch.setattr(counting, "HELD", 3)  # counts are handed on more than once
    word = F.lower(T.clean_word(F.col("token")))
    each = preprocess.tokens(_docs(spark)).select("doc_id", word.alias("word")).distinct().where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    got = counting.counted(preprocess.document_texts(_docs(spark)), counting.words)
    assert sorted(map(tuple, got.select("word", "n").collect())) == sorted(map(tuple, each.collect()))


def test_held_counts_are_handed_on(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(counting, "HELD", 1)
    batches = list(counting._counts(counting.tokens)([pa.record_batch([pa.array([b"a b", b"a", None, b"c a"])], ["text"])]))
    total = Counter()
    for batch in batches:
        assert batch.num_rows <= 2
        for row in batch.to_pylist():
            total[row["word"]] += row["n"]
    assert total == {b"a": 3, b"b": 1, b"c": 1}


def test_lexicon_cuts_no_token(spark):
    """No column expression looks at a token: texts are cut and counted in one step, and rows of one id are one document."""
    docs = spark.createDataFrame([(1, "foo foo bar"), (1, "foo qux"), (2, "Bar, baz"), (3, "qux\u00a0baz"), (4, None)], "doc_id long, text string")
    made = frequent_words(docs)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "array_distinct" not in plan
    got = {r["word"] for r in made.collect()}
    assert {"bar", "qux", "baz"} <= got and "foo" not in got


def test_known_deletions(spark, monkeypatch):
    """Deletions that an index has are those of the column expression; a large index is met in a join, with the same pairs."""
    from wordloom.operators import heavy
    from wordloom.operators import suggest as S

    words = ["foo", "fooo", "barr", "b", "ab", "aabb", "\U0001f600ab", "it's", "banana"]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    known = frozenset(["", "foo", "fo", "oo", "br", "ab", "a", "aan", "anana", "banana", "its"])
    for depth in (0, 1, 2):
        for word, every in table.select("word", T.deletions(F.col("word"), depth)).collect():
            assert sorted(S.known_deletions(word, depth, known)) == sorted(set(every) & known)
    index = S.deletion_index(spark.createDataFrame([(w,) for w in ("foo", "bar", "bananas", "its")], "word string"))
    few = S.candidates(table, index)
    assert "ArrowEvalPython" in few._jdf.queryExecution().optimizedPlan().toString()
    pairs = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(heavy, "SMALL", 1)
    many = S.candidates(table, index)
    assert "ArrowEvalPython" not in many._jdf.queryExecution().optimizedPlan().toString()
    assert pairs == sorted(map(tuple, many.collect())) and ("banana", "bananas") in pairs


def test_learned_fixes(spark):
    """Pairs are those of the last occurrences, without asking for any; and occurrences are reduced before they are joined."""
    from wordloom.operators import rewrite

    found = spark.createDataFrame([(1, 1, 0, 0, "Teh"), (2, 1, 0, 0, "teh"), (1, 2, 3, 0, "wrod"), (1, 2, 4, 0, "zzz")], "doc_id long, line int, pos int, part_pos int, word string")
    suggested = spark.createDataFrame([("Teh", ["the", "ten"]), ("teh", ["the", "ten"]), ("wrod", ["word"]), ("zzz", [])], "word string, suggestions array<string>")
    expected = [("teh", "the"), ("wrod", "word")]
    assert sorted(map(tuple, rewrite.learned_fixes(suggested).collect())) == expected
    assert sorted(map(tuple, rewrite.learned_pairs(found, suggested).collect())) == expected
    apart = suggested.withColumn("suggestions", F.when(F.col("word") == "Teh", F.array(F.lit("ten"))).otherwise(F.col("suggestions")))
    assert sorted(map(tuple, rewrite.learned_pairs(found, apart).collect())) == expected  # the later one has the other suggestion
    assert "Join" not in rewrite.learned_fixes(suggested)._jdf.queryExecution().optimizedPlan().toString()
