"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are densities of a fixed and of a learned lexicon, nearness of hits to
the second person, rates of capitals, marks and obfuscation.  The learned
lexicon, the trees and the calibration are each fitted on a part of their own of
a bounded sample of labelled rows, so none learns from the others' fit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .features import stems, tokens, toxic
from .labelled import feature_rows, labelled_sample, remainder, score_column
from .trees import BoostedTrees, Isotonic

#: Labelled rows in the sample, at most about this many.
SAMPLE = 30_000
#: Entries of the learned lexicon, and the least number of toxic texts for one.
ENTRIES, LEAST = 2_000, 4
#: Least weight of an entry: the log of the ratio less one standard error.
WEAKEST = 0.8
#: Shares of the sample: lexicon, trees; the rest calibrates.
LEXICON_SHARE, TREE_SHARE = 0.4, 0.4
THRESHOLD = 0.7


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class that hold a stem, counted within the partition."""
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    texts = [0, 0]

    def out() -> pa.RecordBatch:
        rows = [(s, n if c else 0, 0 if c else n) for c in (0, 1) for s, n in seen[c].items()] + [("", texts[1], texts[0])]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["stem", "bad", "good"])

    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            words = {s for w in set(tokens(text or "")) for s in stems(w.strip("!*@$_")) if s}
            seen[int(y > 0)].update(words)
            texts[int(y > 0)] += 1
            if len(seen[0]) + len(seen[1]) > 400_000:
                yield out()
                seen, texts = {0: Counter(), 1: Counter()}, [0, 0]
    yield out()


def learn_lexicon(sample: DataFrame, entries: int = ENTRIES, least: int = LEAST) -> dict[str, float]:
    """Stems by how much likelier toxic texts are to hold them: a lower bound of the log of the ratio of smoothed shares."""
    counts = sample.select("text", "y").mapInArrow(_stem_counts, "stem string, bad long, good long")
    totals = counts.groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    whole = totals.where("stem = ''").first()
    bad, good = (whole.bad, whole.good) if whole else (0, 0)
    if not bad:
        return {}
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    doubt = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    top = totals.where((F.col("stem") != "") & (F.col("bad") >= least)).select("stem", (odds - doubt).alias("weight")).where(F.col("weight") > WEAKEST)
    return {r.stem: float(r.weight) for r in top.orderBy(F.desc("weight"), "stem").limit(entries).collect()}


class ToxicityModel:
    def __init__(self, lexicon: dict[str, float], trees: BoostedTrees, curve: Isotonic):
        self.lexicon, self.trees, self.curve = lexicon, trees, curve

    def features(self, text: str) -> list[float]:
        return toxic(text, self.lexicon)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.curve(self.trees.margin(x))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Learns from labelled rows whose crc32(doc_id) mod 3 is not 1, at most about ``sample`` of them.

    Without labelled rows every text scores one half.  What is drawn where labels
    or doc_ids repeat or are null says :func:`labelled_sample`.
    """
    rows = labelled_sample(docs, labels, "toxic", remainder("doc_id", 3) != 1, sample)
    lexicon = learn_lexicon(rows.where(F.col("draw") < LEXICON_SHARE))
    x, y, draw = feature_rows(rows.where(F.col("draw") >= LEXICON_SHARE), lambda t: toxic(t, lexicon))
    if not len(y):
        x = np.zeros((0, len(toxic("", {}))))
    grow = draw < LEXICON_SHARE + TREE_SHARE
    trees = BoostedTrees().fit(x[grow], y[grow])
    rest = ~grow if (~grow).any() else grow
    return ToxicityModel(lexicon, trees, Isotonic().fit(trees.margin(x[rest]), y[rest]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """``docs`` with the probability of toxicity, by the text alone.

    Null texts score as empty ones, texts of any length whole, and equal texts
    alike, so repeated rows get equal scores.  All columns are passed on,
    whatever their names; ``name`` must not be among them.  An empty table
    stays empty.
    """
    return score_column(docs, model.features, model.score, name)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, labels))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
