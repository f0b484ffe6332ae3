"""The corpus pipeline: five stages, each calling one operator and reading what the one before it kept.

`STAGES` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next one's docs. All but the last return the columns of
`documents`. The stages drop toxic documents, keep one document of each group of near duplicates,
cover personal data, draw the mixture, and encode the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import mixing, nearcopies, pii, tokenfile, tokens, toxicity
from loomgraph.llm.common import ready, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scorer rejects go; null texts stay."""
    return toxicity.drop_toxic(docs, table(ready(spark), sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share 0.8 or more of their five-word shingles, the document with the
    least doc_id stays; null keys stay."""
    gone = nearcopies.groups(docs).where("component_id < doc_id")
    return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is covered by its kind; n_chars follows the new text."""
    covered = pii.redact(docs)
    size = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return covered.withColumn("n_chars", size).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn by calibrated probabilities."""
    return mixing.sample(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each text, with the digests of ids and of the decoded bytes."""
    import public_tokenizers

    return tokens.encode_documents(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True
    )


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("pii", private),
    ("mixing", mixture),
    ("encoding", encoded),
]

#: Learning, hashing and tokenising are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again."""
    docs, before = table(ready(spark), sf_dir, "documents"), None
    for name, stage in STAGES:
        path = tokenfile.shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            tokenfile.delete(spark, before)  # written and read again: no longer needed
        before = path
    return docs
