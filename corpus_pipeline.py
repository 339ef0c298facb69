"""The corpus pipeline: good documents, one of each near-duplicate group, masked, mixed and packed.

Every stage takes ``(spark, docs, sf_dir)`` with ``docs`` in the columns of ``documents``; all but the last return
those columns. Each stage works on all rows that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelcast.llm import milquality, minhash, mixing, packing, pii
from panelcast.llm.shared import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents of an Arrow batch. They are long: with Spark's 10,000 a batch takes tens of megabytes in the executor and again
#: in each of its Python workers.
ROWS_PER_BATCH = 1000


def _own(docs: DataFrame) -> DataFrame:
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    return docs.select(COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this stage's own input, predicts to be good."""
    docs = _own(docs)
    return milquality.drop_poor(docs, milquality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each near-duplicate group."""
    return minhash.drop_near_copies(_own(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return pii.mask(_own(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.draw(_own(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most 2048 tokens."""
    return packing.pack(_own(docs))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Fitted models, best fit and masking have no SQL form; tests/llm hold the stages' operators against plain twins and
#: round trips, and the whole run against what must hold of its result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written as Parquet to the shared folder and read again; a stage's table
    is removed when the next one is written."""
    scratch = Scratch(spark)
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.staged(docs, name)
            if last is not None:
                scratch.drop(last)
            last = docs
    return docs
