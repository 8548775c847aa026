"""Terminology lint: brand casing and separator variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.functions import judging
from wordloom.functions import text as T
from wordloom.lists import brands_table
from wordloom.operators import heavy, preprocess
from wordloom.storage import settle


def forms(tokens: DataFrame) -> DataFrame:
    """(token, form): distinct tokens with inner separators kept, of at least two characters."""
    return tokens.select("token").distinct().withColumn("form", T.word_form(F.col("token"))).where(F.length("form") >= 2)


def miscased(known: DataFrame, brands: DataFrame | None = None) -> DataFrame:
    """(token, recommendation, alpha, form) of known(token, form): brands in another case than theirs, unless in capitals."""
    brands = brands_table(known.sparkSession) if brands is None else brands
    found = known.withColumn("raw", T.alphanumeric(F.col("form"))).withColumn("key", F.lower("raw"))
    stem = F.when(F.col("key").endswith("s"), F.expr("substring(key, 1, length(key) - 1)"))
    found = found.withColumn("stem", stem)
    exact = brands.select("key", F.col("display").alias("display_1"), F.col("alpha").alias("alpha_1"))
    stems = brands.select(F.col("key").alias("stem"), F.col("display").alias("display_2"), F.col("alpha").alias("alpha_2"))
    # the brand table is a constant of this package, so it is small
    joined = found.join(F.broadcast(exact), "key", "left").join(F.broadcast(stems), "stem", "left")
    whole = F.col("display_1").isNotNull()
    named = joined.where(whole | F.col("display_2").isNotNull()).select(
        "token", F.coalesce("display_1", "display_2").alias("recommendation"), F.coalesce("alpha_1", "alpha_2").alias("alpha"),
        F.when(whole, F.col("raw")).otherwise(F.expr("substring(raw, 1, length(raw) - 1)")).alias("form"),
    )
    capitals = (F.col("form") == F.upper("form")) & F.col("form").rlike("[A-Z]")
    return named.where((F.col("form") != F.col("alpha")) & ~capitals)


def casing_findings(tokens: DataFrame, brands: DataFrame | None = None, known: DataFrame | None = None, wrong: DataFrame | None = None) -> DataFrame:
    """(doc_id, form, recommendation, lines, n, first): brands in another case than theirs, unless in capitals.

    A plural or possessive s is left off if the whole is no brand. n counts lines.
    Distinct tokens are judged first, and only the wrong ones are looked up in the text. Their forms may be known already, or which are wrong.
    """
    wrong = heavy.met(tokens, miscased(forms(tokens) if known is None else known, brands) if wrong is None else wrong, "token")
    return wrong.groupBy("doc_id", "form", "recommendation").agg(F.array_sort(F.collect_set("line")).alias("lines"), F.count_distinct("line").alias("n"), F.min(F.struct("line", "pos")).alias("first"))


def _two(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.min("variant").alias("a"), F.max("variant").alias("b")).where("a <> b").select(*by)


def varied(known: DataFrame) -> DataFrame:
    """(key, token, form, variant) of known(token, form): those that have another spelling in all the tokens."""
    judged = known.withColumn("key", T.group_key(F.col("form"))).where((F.length("key") >= 3) & F.col("form").rlike("[A-Za-z]"))
    judged = judged.withColumn("variant", F.lower("form"))
    return judged.join(_two(judged, "key"), "key")


def variants(tokens: DataFrame, known: DataFrame | None = None, several: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, form, n, lines, place, first): spellings that differ in separators only, best first.

    Forms are counted by occurrence; the first one seen stands for those that differ in case.
    A spelling that has no other in all the tokens has none in a document, so only the
    tokens of the others are looked up in the text; and only what a document spells in two ways is counted.
    """
    found = settle(heavy.met(tokens, varied(forms(tokens) if known is None else known) if several is None else several, "token"))
    found = found.join(_two(found, "doc_id", "key"), ["doc_id", "key"], "left_semi")
    found = found.groupBy("doc_id", "key", "variant").agg(F.count("*").alias("n"), F.min_by("form", F.struct("line", "pos")).alias("form"), F.array_sort(F.collect_set("line")).alias("lines"), F.min(F.struct("line", "pos")).alias("first"))
    order = Window.partitionBy("doc_id", "key").orderBy(F.desc("n"), F.length("form"), F.collate("form", "UNICODE"))
    return found.withColumn("place", F.row_number().over(order)).select("doc_id", "key", "form", "n", "lines", "place", "first")


def variant_findings(tokens: DataFrame, known: DataFrame | None = None, several: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, recommendation, forms, lines, first): one row for each group of variants."""
    each = variants(tokens, known, several)
    entry = F.struct("place", "form", "lines", "n")
    groups = each.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(entry)).alias("forms"), F.min("first").alias("first"))
    return groups.select("doc_id", "key", F.element_at("forms", 1)["form"].alias("recommendation"), F.transform("forms", lambda f: F.struct(f["form"].alias("form"), f["lines"].alias("lines"), f["n"].alias("count"))).alias("forms"), F.array_sort(F.array_distinct(F.flatten(F.transform("forms", lambda f: f["lines"])))).alias("lines"), "first")


def findings(tokens: DataFrame) -> DataFrame:
    """(doc_id, place, kind, recommendation, forms, lines): all findings, by first line, casing first, then as first seen."""
    known = settle(forms(tokens))
    return _findings(tokens, miscased(known), varied(known))


def document_findings(docs: DataFrame, markdown: bool = False) -> DataFrame:
    """The findings of docs(doc_id, text): distinct tokens are judged, and the texts are read again for the places of those that are wrong or have another spelling."""
    known = settle(forms(preprocess.distinct_tokens(docs, markdown)))
    wrong, several = settle(miscased(known)), settle(varied(known))
    asked = [r[0] for r in wrong.select("token").union(several.select("token")).distinct().limit(heavy.SMALL + 1).collect()]
    few = len(asked) <= heavy.SMALL
    return _findings(settle(judging.places(preprocess.numbered_texts(docs, markdown), asked) if few else preprocess.tokens(docs, markdown)), wrong, several)


def _findings(tokens: DataFrame, wrong: DataFrame, several: DataFrame) -> DataFrame:
    casing = casing_findings(tokens, wrong=wrong).select("doc_id", F.lit("casing").alias("kind"), "recommendation", F.array(F.struct("form", "lines", F.col("n").alias("count"))).alias("forms"), "lines", "first")
    both = casing.unionByName(variant_findings(tokens, several=several).select("doc_id", F.lit("variants").alias("kind"), "recommendation", "forms", "lines", "first"))
    order = Window.partitionBy("doc_id").orderBy(F.array_min("lines"), "kind", "first")
    return both.withColumn("place", F.row_number().over(order)).select("doc_id", "place", "kind", "recommendation", "forms", "lines")
