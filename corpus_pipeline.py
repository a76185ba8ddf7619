"""A training-text pipeline: each stage reads what its predecessor kept.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns a DataFrame.  The caller may write each result as Parquet and hand
the re-read table to the next stage, as :func:`run` does.  All stages but the
last return the columns of ``documents``.  Each begins with executors that have
given back what the stages before it threw away.

Defined results: null texts count as empty; the quality model judges them, exact
dedup keeps one of them, the near-duplicate and decontamination stages leave
texts without words alone, and packing gives them their end token.  Extra
columns pass through the filtering stages.  An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewright.llm.common import Scratch, read_table, settle
from tidewright.llm.decontaminate import drop_contaminated
from tidewright.llm.exact_dedup import drop_exact_duplicates
from tidewright.llm.packing import pack_documents
from tidewright.llm.quality import drop_low_quality, fit_quality
from tidewright.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the model of ``labels.quality`` scores below 0.3.

    The model learns from the labelled documents of ``sf_dir``, whole as they came.
    """
    settle(spark)
    model = fit_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return drop_low_quality(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of equal texts."""
    settle(spark)
    return drop_exact_duplicates(spark, docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-copies: five words, similarity 0.8."""
    settle(spark)
    return drop_near_duplicates(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item: five words, similarity 0.8."""
    settle(spark)
    return drop_contaminated(spark, docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    settle(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("simhash_dedup", simhash_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: A trained model and a random search are among the stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``, each result stored and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
