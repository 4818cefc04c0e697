"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; ``run`` writes every stage's result as Parquet and hands the reread table
on. All but the last stage return the columns of their input. Null and empty texts
pass every filter but that they are never taken into the mix; empty tables give
empty tables; long texts are worked on whole; columns beside those of documents
are carried along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, jaccard_join, mixing, pii, toxicity
from foliant.llm.catalog import vocabulary
from foliant.llm.common import fresh, stage, table

#: Words of a shingle and least similarity in percent for near duplicates; score from which a document is toxic.
SHINGLE, SIMILAR, TOXIC = 5, 80, 0.7


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; the model learns from the labelled rows that aren't held out."""
    model = toxicity.learn(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    score = fresh(docs, "_score")
    return toxicity.score(docs, model, score).filter(F.col(score) < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies."""
    return jaccard_join.keep_one(docs, SHINGLE, SIMILAR)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by tags."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks of documents that the mix takes; a document taken r times over has up to r rows."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, n_tokens, decoded_sha256)`` of every row: its token ids, and the digest of what they spell."""
    both = bpe.encode(docs, vocabulary(), decoded="decoded")
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("jaccard_join", drop_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: SQL can't express a trained model, PartEnum's classes or byte-pair merges; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(spark, step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
