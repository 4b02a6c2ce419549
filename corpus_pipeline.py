"""The training-data pipeline: five stages over ``documents``, each one of the operators in flowfacts.llm.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the columns of
``documents``; a driver may write each result as Parquet and read it again as the next stage's docs. Stages whose Python work is
done when the result is written leave the session with small Arrow batches; ``run`` sets it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowfacts.llm.common import materialize, small_batches
from flowfacts.llm.jaccard_join import keep_one_of_each_group
from flowfacts.llm.line_dedup import dedup_lines
from flowfacts.llm.packing import pack
from flowfacts.llm.pii import redact_documents
from flowfacts.llm.toxicity import drop_toxic

TOKENIZER = "word_bpe_49k.json"

#: Rows of an Arrow batch, at most: its texts are held on both sides of the pipe to Python.
BATCH_ROWS = 1000


def _few_rows(spark: SparkSession) -> None:
    """From now on Arrow batches are small. Spark looks this up when a result is written, which is after a stage has returned."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels``, does not call toxic."""
    _few_rows(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; one whose whole text was said before is left out."""
    return dedup_lines(docs, drop_emptied=True)


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its 5-word shingles."""
    return keep_one_of_each_group(docs, words=5, per_cent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    _few_rows(spark)
    return redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids."""
    return pack(docs, TOKENIZER, remembered=100_000, keep=False)  # workers hold what other stages remember, too


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("jaccard", jaccard), ("pii", personal_data), ("packing", packing)]

#: Classification, hashing of shingles, tokenisation and packing are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; what a stage keeps is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with small_batches(spark, BATCH_ROWS):
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        return STAGES[-1][1](spark, docs, sf_dir)
