"""The registered queries of these operators and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelight.llm import decontaminate, html_text, licenses, mixing, ngram_jaccard, oracles, permutation_index, private_data, quality, secrets, table_kmeans, token_alignment, toxicity, warc
from wirelight.llm.workspace import Workspace


TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file, in the folder that TOKENIZER_DIR names."""
    return os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return private_data.scan(docs, private_data.train(docs))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.document_paths(table(spark, sf_dir, "documents")))


def warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark)
    root = space.path("archives")
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), root, space)
    found = warc.read_archives(manifest, root)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return permutation_index.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html_text.extract(F.col("html")).alias("text"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", quality.held_out().alias("held_out"))
    model = quality.train(docs.where("NOT held_out"), table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "slot", "phase", "position")


def token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizers = token_alignment.load(tokenizer_path(TOKENIZER_A), tokenizer_path(TOKENIZER_B))
    return token_alignment.align_tokens(table(spark, sf_dir, "documents"), tokenizers)


def toxicity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", toxicity.held_out().alias("held_out"))
    machine = toxicity.train(docs.where("NOT held_out"), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def vector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_kmeans.cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": ngram_jaccard_join,
    "op2_personal_data": personal_data,
    "op3_warc_archive": warc_archive,
    "op4_license_scan": license_scan,
    "op5_nearest_vectors": nearest_vectors,
    "op6_secret_scan": secret_scan,
    "op7_decontamination": decontamination,
    "op8_main_text": main_text,
    "op9_quality_score": quality_score,
    "op10_source_mix": source_mix,
    "op11_token_alignment": token_links,
    "op12_toxicity_score": toxicity_score,
    "op13_vector_clusters": vector_clusters,
}

SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": oracles.NGRAM_JACCARD_JOIN,
    "op3_warc_archive": oracles.WARC_ARCHIVE,
    "op13_vector_clusters": oracles.TABLE_KMEANS,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
