"""What both text classifiers share: a bounded labelled sample and scoring of whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back

#: Texts whose features are held at once.
BATCH = 256


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of the decimal doc_id modulo by; a null doc_id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % by


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int) -> DataFrame:
    """(doc_id, text, y, draw) of about ``most`` labelled rows where ``learn`` holds; draw is a fixed hash in [0, 1).

    Labels are drawn by a hash of doc_id, so the sample does not depend on
    partitioning.  Of repeated labels the largest counts, null labels and null
    doc_ids are left out.  Of several rows with one doc_id, the one whose text
    has the least hash is taken (null texts last), so there is a row a label at most.  ``most``
    labels are expected, a few standard deviations more possible; that bound is
    why the labels may be broadcast and the rows learned from on the driver.
    """
    own = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").where(learn)
    own = own.groupBy("doc_id").agg(F.max("y").alias("y"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) / 1e6
    n = own.count()
    drawn = own.withColumn("draw", draw).where(F.col("draw") < min(1.0, most / max(n, 1)))
    drawn = drawn.withColumn("draw", F.col("draw") / min(1.0, most / max(n, 1)))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    place = F.struct(F.col("text").isNull().alias("none"), F.xxhash64("text").alias("hash"), "text")
    return rows.groupBy("doc_id").agg(F.min(place).alias("least"), F.first("y").alias("y"), F.first("draw").alias("draw")).select("doc_id", "least.text", "y", "draw")


def feature_rows(sample: DataFrame, features: Callable[[str], list[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature matrix, labels and draws of a bounded sample, on the driver, in the order of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64())), batch.column("y"), batch.column("draw")], ["doc_id", "x", "y", "draw"])

    got = sample.mapInArrow(run, "doc_id long, x array<double>, y int, draw double").toArrow().sort_by("doc_id")
    x = np.array(got.column("x").to_pylist(), float)
    return x if len(x) else np.zeros((0, 1)), got.column("y").to_numpy().astype(float), got.column("draw").to_numpy()


def score_column(docs: DataFrame, features: Callable[[str], list[float]], score: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """``docs`` with a double column ``name``; all columns are passed on, whatever they are called."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                x = np.array([features(t or "") for t in batch.column("text").to_pylist()], float)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score(x), pa.float64())], [*batch.schema.names, name])
            give_back()

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
