"""Document quality by a generalised additive model with pairwise interactions.

Cyclic boosting of shallow one-feature trees fills a lookup table per feature,
and a few pairs get two-way tables.  A score is the sum of the entries a text's
bins point at, through the logistic function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, read_table
from .features import surface
from .labelled import feature_rows, labelled_sample, remainder, score_column
from .trees import AdditiveModel, sigmoid

#: Labelled rows that the model is fitted on, at most about this many.
SAMPLE = 12_000
THRESHOLD = 0.3


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AdditiveModel:
    """Learns from labelled rows whose crc32(doc_id) mod 5 is not 0, at most about ``sample`` of them.

    Without labelled rows every text scores one half.  What is drawn where labels
    or doc_ids repeat or are null says :func:`labelled_sample`.
    """
    rows = labelled_sample(docs, labels, "quality", remainder("doc_id", 5) != 0, sample)
    x, y, _ = feature_rows(rows, surface)
    if not len(y):
        x = x[:, :1].repeat(len(surface("")), axis=1)
    return AdditiveModel().fit(x, y)


def score_quality(docs: DataFrame, model: AdditiveModel, name: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality, by the text alone.

    Null texts score as empty ones, texts of any length whole, and equal texts
    alike, so repeated rows get equal scores.  All columns are passed on,
    whatever their names; ``name`` must not be among them.  An empty table
    stays empty.
    """
    return score_column(docs, surface, lambda x: sigmoid(model.margin(x)), name)


def drop_low_quality(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score ``threshold`` or more (a tie stays), all columns as they were."""
    mark = free_name(docs, "tidewright_score")
    return score_quality(docs, model, mark).where(F.col(mark) >= threshold).drop(mark)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = score_quality(docs.select("doc_id", "text"), fit_quality(docs, labels))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
