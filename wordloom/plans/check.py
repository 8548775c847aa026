"""The whole check as one plan: tokens, misspelt words, suggestions, learned fixes, terminology."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions import judging
from wordloom.lists import COMMON_WORDS, words_table
from wordloom.operators import check as C
from wordloom.operators import heavy, lint, preprocess
from wordloom.operators import suggest as S
from wordloom.operators.compounds import Compounds
from wordloom.storage import settle


@dataclass
class Options:
    """lexicon(word) is the base dictionary; extra(word), ignored(word) and corrections(typo, fix) may be left out.

    With by_case the lexicon is (word, keep_case), as `sources.dictionary` reads it, and accepts words by their case;
    its compounds may be given beside it. Extra and ignored words are accepted in any case.
    """

    lexicon: DataFrame
    extra: DataFrame | None = None
    ignored: DataFrame | None = None
    corrections: DataFrame | None = None
    min_length: int = 1
    markdown: bool = False
    by_case: bool = False
    compounds: Compounds | None = None


@dataclass
class Checked:
    """suggested (word, suggestions, top_distance), and what is made when it is asked for: occurrences, misspelt (per document and word), and findings."""

    suggested: DataFrame
    found: Callable[[], DataFrame]
    rolled: Callable[[], DataFrame]
    terms: Callable[[], DataFrame]

    @cached_property
    def occurrences(self) -> DataFrame:
        return self.found()

    @cached_property
    def misspelt(self) -> DataFrame:
        return self.rolled()

    @cached_property
    def findings(self) -> DataFrame:
        return self.terms()


def _misspellings(docs: DataFrame, options: Options, listed: list[str]) -> DataFrame | None:
    """The misspelt words of each document, rolled up where its text is; None if documents have several rows. Documents with a directive are cut into lines, which are put together."""
    if not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return None
    whole, cut = preprocess.whole_and_cut(docs, options.markdown)
    return judging.misspellings(whole, listed, options.min_length).unionByName(C.misspellings(judging.occurrences(cut, listed, options.min_length)))


def check(docs: DataFrame, options: Options, by_document: bool = False) -> Checked:
    """Check docs(doc_id, text). With by_document, misspelt words are asked for, not their occurrences: they are rolled up where the texts are read.

    Suggestions are looked up once per distinct word. Up to `check.LISTED` valid words are asked where the texts are
    read, without a shuffle; otherwise validity is decided once per distinct token, and tokens are settled.
    What is decided of the texts is settled. Terminology reads them again, if it is asked for.
    """
    spark = docs.sparkSession
    valid = settle(C.valid_words(None if options.by_case else options.lexicon, options.extra, options.ignored))
    cased = (options.lexicon, options.compounds) if options.by_case else ()
    listed = None if cased else C.listed(valid)
    if listed is None:
        own = settle(preprocess.tokens(docs, options.markdown))
        counts = settle(own.groupBy("token").agg(F.count("*").alias("n")))
        bad = settle(C.invalid_parts(counts.select("token"), valid, options.min_length, *cased))
        found = settle(C.placed(own, bad, heavy.frequent(counts, "token")))
    else:
        places = lambda: settle(judging.occurrences(preprocess.numbered_texts(docs, options.markdown), listed, options.min_length))
        per_word = _misspellings(docs, options, listed) if by_document else None
        found = settle(per_word) if per_word is not None else places()
    vocabulary = options.lexicon.select("word") if options.extra is None else options.lexicon.select("word").union(options.extra.select("word"))
    words = settle(found.select("word").distinct())
    best = S.suggestions(words, vocabulary, words_table(spark, COMMON_WORDS), vocabulary)
    corrections = options.corrections if options.corrections is not None else spark.createDataFrame([], "typo string, fix string")
    suggested = settle(S.with_learned(words, best, corrections))

    if listed is not None and per_word is not None:
        return Checked(suggested, places, lambda: _hinted(found, suggested), lambda: lint.document_findings(docs, options.markdown))

    def rolled() -> DataFrame:
        # one shuffle by word and one by document, which serves the roll-up and all that reports do by document
        hinted = heavy.joined_by(found, suggested, "word").repartition("doc_id")
        return C.misspellings(hinted, "suggestions", "top_distance").select("doc_id", "word", "n", "lines", "first", "suggestions", "top_distance")

    return Checked(suggested, lambda: found, rolled, lambda: lint.document_findings(docs, options.markdown))


def _hinted(rolled: DataFrame, suggested: DataFrame) -> DataFrame:
    """Settled rolled(word, ...) with each word's suggestions. Most words have none: if few have any, those are broadcast, and nothing is shuffled."""
    some = settle(suggested.where(F.size("suggestions") > 0))
    if some.count() > heavy.SMALL:
        return heavy.joined_by(rolled, suggested, "word").select(*rolled.columns, "suggestions", "top_distance")
    none = F.array().cast("array<string>")
    return rolled.join(F.broadcast(some), "word", "left").select(*rolled.columns, F.coalesce("suggestions", none).alias("suggestions"), "top_distance")


def extra_words(wordlists: list[DataFrame], files: DataFrame | None = None, **harvest: int | None) -> DataFrame:
    """(word): word lists(word), then the vocabulary of a project's files(path, length, content), if given."""
    from functools import reduce

    from wordloom.operators import vocab

    parts = [w.select("word") for w in wordlists] + ([vocab.harvest(files, **harvest)[0].select("word")] if files is not None else [])
    return reduce(DataFrame.union, parts)


def frequent_words(documents: DataFrame, share: int = 100, least: int = 2) -> DataFrame:
    """(word): a lexicon from the corpus itself: suggestable words in at least one of `share` documents(doc_id, text), and `least`.

    Words are counted where texts are read, so that only words and their counts are shuffled.
    """
    from wordloom.functions import counting
    from wordloom.functions import text as T
    from wordloom.lists import TECH_WORDS

    spark = documents.sparkSession
    texts = preprocess.document_texts(documents)
    if not documents.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        texts = texts.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))  # rows of one id are one document
    words = counting.counted(texts, counting.words)
    limit = max(least, documents.count() // share)
    # words are judged when they are counted, not at each of their places
    common = words.where((F.col("n") >= limit) & T.is_suggestable(F.col("word"))).select("word")
    return common.union(words_table(spark, TECH_WORDS)).union(words_table(spark, COMMON_WORDS)).distinct()
