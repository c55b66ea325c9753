"""The training-corpus pipeline: five operators in turn over the documents table.

Each stage takes (spark, docs, sf_dir), with docs as the stage before left them, and
returns a frame; ``run`` writes each stage's rows as Parquet in the shared folder and
reads them again for the next, so a lost executor never repeats earlier stages.

All stages read whole texts of any length.  Null texts have no words, no personal data and
no tokens: of null and empty texts one row stays, as one class of copies.  Rows without an id
are kept or dropped by their text like all others.  Of repeated rows, as of all near copies,
the one with the least id (then the least text hash) stays.  An empty table gives an empty
result.  All but the last stage return the columns of their input, whatever others there
are beside those of documents; texts that a stage keeps come back as they were, but for the
surrogates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe_tree, decontaminate, kneser_ney, neardup, pii
from docloom.llm.tables import modest_batches, table, whole_row, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier keeps."""
    modest_batches(spark)
    return kneser_ney.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    modest_batches(spark)
    return neardup.one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    modest_batches(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates in place of personal data; n_chars follows the new text."""
    modest_batches(spark)
    rows = docs.select("text", F.col("n_chars").alias("old_size"), whole_row(docs, ("text",)).alias("row"))
    new = pii.with_surrogates(rows, pii.key_of(spark))
    size = F.when(F.col("pii_n") > 0, F.length("text").cast("long")).otherwise(F.col("old_size"))
    own = {"text": F.col("text"), "n_chars": size}
    return new.select(*[(own[c] if c in own else F.col("row").getField(c)).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    modest_batches(spark)
    return bpe_tree.digest_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII surrogates", pii_surrogates),
    ("byte-level BPE", tokens),
]

ORACLE_SQL = None  # perplexities, MinHash classes and BPE are beyond SQL; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
