"""From raw documents to a mixed training corpus, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelight.llm import decontaminate, mixing, ngram_jaccard, quality, secrets
from wirelight.llm.workspace import Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier scores below 0.7; it learns from the labelled rows outside of the held-out fold."""
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs.where(~quality.held_out()), labels)
    return quality.score(docs, model, score_col="_score").where(F.col("_score") >= 0.7).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: that of the smallest id, NULL last, then of the smallest digest of its text.

    Groups are of rows, not of ids: a row without an id, or with one that others
    have too, is judged by its own text. Blank texts are in no group and all stay.
    """
    space = Workspace(spark)
    rows = space.keep(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = ngram_jaccard.jaccard_components(rows, "_row")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "_row")
    firsts = groups.join(rows.select("_row", rank.alias("_rank")), "_row").groupBy("component_id").agg(F.min("_rank").alias("_first"))
    return rows.join(firsts.select(F.col("_first._row").alias("_kept")), F.col("_row") == F.col("_kept"), "left_semi").select(*COLUMNS)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents into which a benchmark item has leaked."""
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; n_chars follows."""
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places all documents by target weights of their sources."""
    return mixing.mix_sources(docs.select(*COLUMNS))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_leaked),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result written to the shared folder and read again."""
    space = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = space.keep(stage(spark, docs, sf_dir), f"stage{i}")
        space.close(f"stage{i}")
    return docs


