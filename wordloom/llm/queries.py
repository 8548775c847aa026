"""The registered queries of the training-data operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import credential_links, embedding_dedup, filter_audit, html_text, jaccard_join, language_id, mixing, packing, substring_dedup, tandem_runs, topk_search, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.by_position(mixing.mix(table(spark, sf_dir, "documents")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tandem_runs.periodic_runs(table(spark, sf_dir, "documents"))


def op12_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credential_links.scan_secrets(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_topk_search": op2_topk_search,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_mixing": op4_mixing,
        "op5_packing": op5_packing,
        "op6_toxicity": op6_toxicity,
        "op7_html_text": op7_html_text,
        "op8_language_id": op8_language_id,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_warc": op10_warc,
        "op11_tandem_runs": op11_tandem_runs,
        "op12_credential_links": op12_credential_links,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_jaccard_join": jaccard_join.SQL,
        "op2_topk_search": topk_search.SQL,
        "op3_substring_dedup": substring_dedup.SQL,
        "op4_mixing": mixing.SQL,
        "op9_embedding_dedup": embedding_dedup.SQL,
        "op10_warc": warc.SQL,
        "op11_tandem_runs": tandem_runs.SQL,
        "op12_credential_links": credential_links.SQL,
        "op13_filter_audit": filter_audit.SQL,
    }
