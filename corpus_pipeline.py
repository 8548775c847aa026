"""The corpus pipeline: language, near-duplicates, repeated passages, source mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept. Each is written as Parquet in the shared folder and read again as
the next stage's input. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.exchange import packed, unpacked
from wordloom.llm.jaccard_join import jaccard_components
from wordloom.llm.language_id import identify
from wordloom.llm.mixing import training_order
from wordloom.llm.packing import pack
from wordloom.llm.substring_dedup import dedup_substrings
from wordloom.storage import Scope, settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: What this thread's stages have settled for results that may still be to be written.
_left: ContextVar[tuple[Scope, ...]] = ContextVar("left", default=())


def _stage(function: Stage) -> Stage:
    """A stage that first removes what the stages before it settled, as its input, their result, is written by now.

    Tables that the input still reads stay, as when a stage is called on another's unwritten result.
    """

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        still = [s for s in _left.get() if s.feeds(docs)]
        for scope in set(_left.get()) - set(still):
            scope.remove(spark)
        with Scope() as own:
            _left.set((*still, own))
            return function(spark, docs, sf_dir)

    return run


def _names(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; `lang` becomes the language found in the text.

    A null or empty text, and one without a letter, goes. Equal rows stay or go
    together. Further columns stay as they are, whatever their names; an empty
    table stays empty.
    """
    own = [c for c in docs.columns if c not in ("doc_id", "lang")]
    named = identify(docs, carry=own).where(~F.col("rejected"))
    return named.select("doc_id", F.col("lang_pred").alias("lang"), *unpacked(own)).select(*_names(docs))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, once.

    Texts without words, and rows without doc_id, are in no group and stay. Rows
    that share a doc_id are one document to the join and stay or go together; of
    those with one text one stays, the last by its columns written as JSON.
    Further columns are those of the row that stays, whatever their names; an
    empty table stays empty.
    """
    groups = jaccard_components(docs).where("doc_id is not null").groupBy("doc_id")
    verdicts = groups.agg(F.max(F.col("doc_id") != F.col("component_id")).alias("gone"), (F.count("*") > 1).alias("repeated"))
    verdicts = settle(verdicts.where("gone or repeated"))  # its size is known before the texts are joined, once
    own = [c for c in docs.columns if c != "doc_id"]
    kept = docs.select("doc_id", packed(docs, own).alias("carried")).join(verdicts, "doc_id", "left").where("not coalesce(gone, false)")
    text = F.col("carried")[f"c{own.index('text')}"]
    once = kept.where("repeated").groupBy("doc_id", text.alias("text")).agg(F.max_by("carried", F.to_json("carried")).alias("carried"))
    stay = kept.where("not coalesce(repeated, false)").select("doc_id", "carried").unionByName(once.select("doc_id", "carried"))
    return stay.select("doc_id", *unpacked(own)).select(*_names(docs))


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated passages; one of which nothing is left stays, with an empty text.

    A null text becomes empty; n_chars follows the text. Equal rows keep what the
    operator says of rows with one doc_id. Further columns stay as they are,
    whatever their names; an empty table stays empty.
    """
    own = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    kept = dedup_substrings(docs, carry=own)
    size = [F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")] if "n_chars" in docs.columns else []
    return kept.select("doc_id", "text", *size, *unpacked(own)).select(*_names(docs))


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix of sources takes, in training order.

    A text without words is taken by no source's demand and goes; a null source
    is a source of its own. Further columns stay as they are, whatever their
    names; an empty table stays empty.
    """
    return training_order(docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all copies and their places in sequences.

    A null or empty text is its end id alone; equal rows are pieces of their own.
    Further columns are left out; an empty table gives no piece.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources", mixture),
    ("packing", packing),
]

#: SQL cannot express the language models or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's written result is removed when the next one's is written."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with Scope() as written:
            docs = settle(stage(spark, docs, sf_dir))
        if held is not None:
            held.remove(spark)
        held = written
    return STAGES[-1][1](spark, docs, sf_dir)
