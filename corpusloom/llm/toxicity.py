"""Toxicity: cumulative-link ordinal regression over sparse hashed word features.

P(grade <= k) = sigmoid(cut_k - s), where s is one sum of feature weights shared by all ordered cuts. The
severity of a text is its expected grade, the sum over k of P(grade > k). A text is toxic if P(grade >= 1) is
at least 0.5. The features are counts of distinct words (A-Z in lower case) and of their beginnings; only
features that lean to higher grades beyond chance get a weight, and no weight is negative, so length adds nothing.

The model is fitted on at most `sample` labelled rows (the lowest hashes of doc_id, over all labelled rows);
it scores every whole text. Labels hold grades 0, 1, 2, ...; where they hold only 0 and 1, the 1s are dealt to
grades 1 and 2 at the median of how many of their words have a feature never seen in grade 0.

Null and empty texts have no features: their severity is that of the cuts alone. Very long texts are read whole. Unlabelled or single-grade
tables give a model that finds nothing; empty documents give no rows. Repeated rows are scored alike; several labels of a document count
as the highest. Extra columns pass through keep(); null ids are scored but never used for fitting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import WORDS, column, own, read, set_aside, sigmoid, texts
from corpusloom.llm.hashed import HALF, SPACE, Adam, memoised, packed, unpacked, word_features

#: Labelled rows used for fitting, at most.
SAMPLE = 6000
#: Documents of the sample that a feature must occur in: so many, and one in LEAST_SHARE.
LEAST_DOCS, LEAST_SHARE = 3, 500
#: Chi-square of a feature against grade 0, below which it gets no weight: keeps chance words out of long texts' sums.
LEAST_CHI2 = 30.0


@dataclass
class Ordinal:
    weights: np.ndarray
    cuts: np.ndarray

    def beyond(self, s: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and k."""
        return sigmoid(np.asarray(s, float)[:, None] - self.cuts[None, :])


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, steps: int = 300, rate: float = 0.1, l2: float = 5e-5) -> Ordinal:
    """Weights and ascending cuts of least penalised loss; rows hold feature numbers, repeated as often as they count."""
    grades = np.asarray(grades, np.int64)
    if len(set(grades.tolist())) < 2:
        return Ordinal(np.zeros(SPACE), np.full(1, 30.0 if not len(grades) or grades[0] == 0 else -30.0))
    k = int(grades.max())
    parts = [np.unique(r, return_counts=True) for r in rows]
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(f) for f, _ in parts])
    feature, count = np.concatenate([f for f, _ in parts]), np.concatenate([c for _, c in parts])
    del parts
    seen, high = np.bincount(feature, minlength=SPACE), np.bincount(feature, (grades > 0)[doc], SPACE)
    share = (grades > 0).mean()
    chi2 = (high - seen * share) ** 2 / np.maximum(seen * share * (1 - share), 1e-9) * (len(rows) / np.maximum(len(rows) - seen, 1))
    keep = ((seen >= max(LEAST_DOCS, len(rows) / LEAST_SHARE)) & (chi2 >= LEAST_CHI2) & (high > seen * share))[feature]
    doc, count = doc[keep], count[keep].astype(float)
    names, feature = np.unique(feature[keep], return_inverse=True)
    w = Adam(np.zeros(len(names)), rate)
    first, gaps = Adam(np.array([2.0]), rate), Adam(np.zeros(k - 1), rate)
    for _ in range(steps):
        cuts = first.x[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps.x))])
        s = np.bincount(doc, w.x[feature] * count, len(rows))
        ends = np.concatenate([[0.0 - 1e9], cuts, [1e9]])
        hi, lo = sigmoid(ends[grades + 1] - s), sigmoid(ends[grades] - s)
        p = np.maximum(hi - lo, 1e-9)
        ds = (1 - hi - lo) / len(rows)
        dcut = np.zeros(k)
        up, down = grades < k, grades > 0
        np.add.at(dcut, grades[up], -(hi * (1 - hi) / p)[up] / len(rows))
        np.add.at(dcut, grades[down] - 1, (lo * (1 - lo) / p)[down] / len(rows))
        w.step(np.bincount(feature, ds[doc] * count, len(names)) + l2 * w.x)
        np.maximum(w.x, 0.0, out=w.x)
        first.step(np.array([dcut.sum()]))
        if k > 1:
            gaps.step(np.cumsum(dcut[::-1])[::-1][1:] * np.exp(gaps.x))
    weights = np.zeros(SPACE)
    weights[names] = w.x
    return Ordinal(weights, first.x[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps.x))]))


def graded(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Grades 0 to 2 from labels 0 and 1; other labels stay."""
    toxic = np.asarray(toxic, np.int64)
    if set(toxic.tolist()) != {0, 1}:
        return toxic
    clean, bad = np.zeros(SPACE, np.int64), np.zeros(SPACE, np.int64)
    for r, y in zip(rows, toxic, strict=True):
        np.add.at(bad if y else clean, np.unique(r), 1)
    mark = (clean == 0) & (bad >= LEAST_DOCS)
    marked = np.array([len(np.unique(np.cumsum(r >= HALF)[mark[r]])) for r in rows])
    return toxic + (toxic & (marked > np.median(marked[toxic == 1])))


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """(text, y) of at most `sample` different texts of as many labelled ids. The broadcast ids are as many at most; an id may have any number of rows."""
    chosen = labels.select(column(labels, "doc_id", "long").alias("_id"), column(labels, label, "int").alias("y")).dropna().groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    one = docs.select(column(docs, "doc_id", "long").alias("_id"), column(docs, "text", "string").alias("text")).join(F.broadcast(chosen), "_id")
    marks = one.select(F.xxhash64("_id", "text").alias("_m"), "text", "y").groupBy("_m", "text").agg(F.max("y").alias("y")).groupBy("text").agg(F.max("y").alias("y"), F.min("_m").alias("_m"))
    return marks.orderBy("_m", "text").limit(sample).select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """The model from the labels of `docs`; the sample stays in one task, of which the driver gets weights and cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y = [], []
        for batch in batches:
            rows += [np.fromiter((f for w in sorted(set(t.translate(WORDS).split())) for f in word_features(w)), np.int32) for t in texts(batch.column(0))]
            y += batch.column(1).to_pylist()
        model = fit_ordinal(rows, graded(rows, np.array(y, np.int64)))
        yield pa.record_batch({"weights": pa.array([packed(model.weights)], pa.binary()), "cuts": pa.array([model.cuts.tobytes()], pa.binary())})

    got = labelled(docs, labels, "toxic", sample).coalesce(1).mapInArrow(run, "weights binary, cuts binary").first()
    return Ordinal(unpacked(got["weights"]), np.frombuffer(got["cuts"], np.float64)) if got else fit_ordinal([], np.zeros(0, np.int64))


def scored(docs: DataFrame, model: Ordinal) -> DataFrame:
    """The rows with severity double and toxic boolean in place of columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.cuts))
    docs = docs.drop("severity", "toxic")
    fields = [*docs.schema.fields]
    at = docs.columns.index("text") if "text" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts = shared.value
        total = memoised(weights, word_features)
        for batch in batches:
            rows = texts(batch.column(at)) if at is not None else [b""] * batch.num_rows
            p = Ordinal(weights, cuts).beyond(np.array([total(set(t.translate(WORDS).split())) for t in rows], float).reshape(-1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.sum(axis=1)), pa.array(p[:, 0] >= 0.5)], [*batch.schema.names, "severity", "toxic"])

    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*fields, StructField("severity", DoubleType()), StructField("toxic", BooleanType())]))


def keep(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that are not toxic, with their own columns."""
    model = fit(docs, read(spark, sf_dir, "labels"))
    plain, back = set_aside(docs, ["severity", "toxic"])
    return scored(plain, model).filter(~F.col("toxic")).drop("severity", "toxic").withColumnsRenamed(back).select(*own(docs))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, severity, toxic) of every document."""
    docs = read(spark, sf_dir, "documents")
    return scored(docs.select("doc_id", "text"), fit(docs, read(spark, sf_dir, "labels"))).select("doc_id", "severity", "toxic")
