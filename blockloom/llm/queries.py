"""The registered corpus queries: each applies its operator to the whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bayes_jaccard, cover_tree, crf_secrets, decontamination, grace_dedup, lexical_search, quality_pu, slack_packing, streaming_viterbi, token_attribution, toxicity_pu, warc_index, whitening
from .shared import read_table


def op1_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_pu.score(docs, quality_pu.train(docs, read_table(spark, sf_dir, "labels")))


def op2_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_attribution.count_tokens(read_table(spark, sf_dir, "documents"))


def op3_bayes_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes_jaccard.jaccard_join(read_table(spark, sf_dir, "documents")).drop("text_key")


def op4_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slack_packing.pack(read_table(spark, sf_dir, "documents"))


def op5_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming_viterbi.encode(read_table(spark, sf_dir, "documents"))


def op6_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity_pu.score(docs, toxicity_pu.train(docs, read_table(spark, sf_dir, "labels")))


def op7_crf_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return crf_secrets.digest(crf_secrets.scan(docs, crf_secrets.train(docs)))


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    found = warc_index.look_up(warc_index.archive(spark, pages), pages, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace_dedup.mark(read_table(spark, sf_dir, "documents"))


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.listed(*whitening.whiten(read_table(spark, sf_dir, "embeddings")))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_quality_pu": op1_quality_pu,
    "op2_token_attribution": op2_token_attribution,
    "op3_bayes_jaccard": op3_bayes_jaccard,
    "op4_slack_packing": op4_slack_packing,
    "op5_streaming_viterbi": op5_streaming_viterbi,
    "op6_toxicity_pu": op6_toxicity_pu,
    "op7_crf_secrets": op7_crf_secrets,
    "op8_warc_index": op8_warc_index,
    "op9_grace_dedup": op9_grace_dedup,
    "op10_cover_tree": op10_cover_tree,
    "op11_whitening": op11_whitening,
    "op12_decontamination": op12_decontamination,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES = {
    "op8_warc_index": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
        ), g AS (
            SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS response FROM p
        )
        SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> response THEN response END AS refers_to
        FROM g
    """,
    "op9_grace_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY h) AS keep_id,
               count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY h) AS kept,
               h AS text_sha256
        FROM d
    """,
    "op12_decontamination": decontamination.SQL,
    "op13_lexical_search": lexical_search.SQL,
}
