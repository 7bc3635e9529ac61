"""From documents to token ids: five stages, each written to the shared folder and read by the next.

Toxic documents go, later repeated runs of lines are deleted, one document of each near-duplicate group stays,
sources are mixed to their target weights, and the rest is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talktally.llm.base import stored, table
from talktally.llm.bpe import encode
from talktally.llm.line_dedup import dedup_lines
from talktally.llm.minhash import without_near_duplicates
from talktally.llm.mixing import mixed
from talktally.llm.toxicity import toxicity


def unused(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half."""
    score = unused(docs, "score")
    scored = toxicity(docs, table(spark, sf_dir, "labels"), column=score)
    return scored.where(F.col(score) < 0.5).drop(score)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later repeated runs of lines; n_chars follows the text."""
    deleted = unused(docs, "lines_deleted")
    cut = dedup_lines(docs, lines=unused(docs, "lines_of_text"), deleted=deleted)
    if "n_chars" in docs.columns:
        shorter = F.when(F.col(deleted) > 0, F.length("text")).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", shorter.cast(docs.schema["n_chars"].dataType))
    return cut.select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group."""
    return without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    ids = encode(docs.select("doc_id", "lang", "source", "text"))
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]
# The stages learn, sketch and encode with methods that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
