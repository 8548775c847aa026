"""Checking a stream of documents against static word tables: an extension, one document at a time without state across them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wordloom import storage
from wordloom.plans.check import Options, check


def check_stream(docs: DataFrame, options: Options, path: str, checkpoint: str) -> StreamingQuery:
    """Append (doc_id, word, n, lines, suggestions, top_distance) of each micro-batch of docs(doc_id, text) to a Parquet table.

    A batch is read once, as its tokens are settled, and the word tables should be
    settled by the caller, so that no batch makes them anew. A batch is written under its number, so that a batch run again after a failure replaces its own rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        with storage.Scope() as own:
            rows = check(batch, options).misspelt.drop("first")
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        own.remove(batch.sparkSession)

    return docs.select("doc_id", F.col("text")).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
