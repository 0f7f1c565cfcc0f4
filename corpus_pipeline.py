"""The corpus pipeline: stages over documents, each on what the one before it kept.

Defined cases: a null or empty text has no words, so the first stage rejects it; later stages, run by
themselves, keep such a text (toxicity scores it by the intercept; all of them are copies of one another;
it has no personal data; it is packed as its end alone). Rows with a null id are kept like others. Of
repeated rows the near-duplicate stage keeps one; of a class's texts it keeps that with the least id, null
ids last. Columns beside those of documents are dropped by each stage, whatever their names. An empty table
gives an empty one. Nothing is bounded but the number of labelled texts that the classifier is fitted on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import line_quality, packing, pii, simhash, toxicity
from quire.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that are rejected."""
    return line_quality.clean_documents(docs, "doc_id", "text").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on those that came this far, scores at the threshold or more go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five-word shingles, similarity 0.8 or more) one document stays."""
    return simhash.near_dedup(docs, shingle=5, similarity=0.8).select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [("quality", quality), ("toxicity", toxic), ("near_dedup", near_copies), ("pii", private), ("packing", packed)]

#: No stage but the first can be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
