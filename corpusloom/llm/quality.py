"""Quality classifier: a label model over weak heuristics, and a hashed linear scorer trained on its posteriors.

Each heuristic votes 0 (poor), 1 (good) or 2 (no opinion) on a text. Expectation-maximisation over the counts
of all vote patterns (3 to the number of heuristics at most, counted over every document) estimates each
heuristic's outcome rates in both classes; no gold label is used. The posteriors of a bounded sample of
documents then train a logistic model over hashed tokens, token shapes and bucketed text statistics, which
scores every whole text. A document is good if its score is at least 0.5 (a tie at 0.5 is good).

The sample is the `sample` different texts with the lowest hashes, so copies count once and its size is a bound.
Null and empty texts get no vote but 2 and are scored by the intercept and their buckets. Very long texts are read whole; all
statistics are shares or means, the same at every length. Repeated rows score
alike. An empty table gives an empty result. Extra columns pass through keep(), clashing ones included.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import UPPER, bounded, column, own, read, set_aside, sigmoid, texts
from corpusloom.llm.hashed import KEPT, SPACE, Adam, memoised, packed, unpacked

#: Documents that train the scorer, at most.
SAMPLE = 5000
#: Tokens of a stretch in which different ones are counted.
STRETCH = 100
SYMBOLS = b"#$%&*|<>{}[]~^=@\\_+"
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
DIGITS = bytes(range(48, 58))
SHAPE = bytes(65 if 65 <= i <= 90 else 97 if 97 <= i <= 122 or i >= 128 else 48 if 48 <= i <= 57 else i for i in range(256))
VOTERS = ("capitals", "symbols", "exclamations", "bars", "repeats", "variety", "word_length", "letters")


def variety(tokens: list[bytes]) -> float:
    """Mean share of different tokens in stretches of STRETCH tokens; the last stretch ends with the text, a shorter text is one."""
    n = len(tokens)
    starts = [*range(0, n - STRETCH, STRETCH), max(0, n - STRETCH)]
    return sum(len(set(tokens[i : i + STRETCH])) for i in starts) / (len(starts) * max(1, min(n, STRETCH)))


def statistics(text: bytes) -> tuple[list[bytes], tuple[float, ...]]:
    """White-space tokens; shares of capitals, symbols, exclamations, bars, repeated neighbours, different tokens; mean length; share of letters and digits."""
    tokens = text.split()
    n = max(1, len(tokens))
    letters = len(text) - len(text.translate(None, LETTERS))
    capitals = len(text) - len(text.translate(None, UPPER))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    repeats = sum(map(operator.eq, tokens[1:], tokens))
    solid = max(1, sum(map(len, tokens)))
    return tokens, (capitals / max(1, letters), symbols / n, text.count(b"!!") / n, text.count(b" | ") / n, repeats / n, variety(tokens), solid / n, (letters + len(text) - len(text.translate(None, DIGITS))) / solid)


def votes(tokens: int, x: tuple[float, ...]) -> tuple[int, ...]:
    """One vote of each heuristic."""
    if not tokens:
        return (2,) * len(VOTERS)
    few = tokens < 5
    low = lambda v, poor, good: 2 if few else 0 if v >= poor else 1 if v <= good else 2
    return (
        low(x[0], 0.5, 0.2), low(x[1], 0.4, 0.1), low(x[2], 0.2, 0.02), low(x[3], 0.15, 0.02), low(x[4], 0.2, 0.03),
        2 if tokens < 40 else 0 if x[5] < 0.2 else 1 if x[5] > 0.4 else 2,
        2 if few else 0 if x[6] > 14 or x[6] < 2 else 1 if 3.5 <= x[6] <= 10 else 2,
        2 if few else 0 if x[7] < 0.7 else 1 if x[7] > 0.85 else 2,
    )


@dataclass
class LabelModel:
    """prior: share of good texts; rates[c, voter, vote]."""

    prior: float
    rates: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good) of vote patterns; votes of 2 say nothing."""
        logs = np.log(self.rates)
        odds = np.full(len(patterns), np.log(self.prior / (1 - self.prior)))
        for v in range(patterns.shape[1]):
            said = patterns[:, v] < 2
            odds += np.where(said, logs[1, v, np.minimum(patterns[:, v], 1)] - logs[0, v, np.minimum(patterns[:, v], 1)], 0.0)
        return sigmoid(odds)


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> LabelModel:
    """EM from the start that a text is poor if any heuristic says so; a tenth of a vote smooths each rate."""
    good = np.where((patterns == 0).any(axis=1), 0.1, 0.9)
    model = LabelModel(0.5, np.full((2, patterns.shape[1], 2), 0.5))
    for _ in range(rounds if len(patterns) else 0):
        weight = np.stack([(1 - good) * counts, good * counts])
        rates = np.stack([np.stack([(weight * (patterns[:, v] == vote)).sum(axis=1) for vote in (0, 1)], axis=1) for v in range(patterns.shape[1])], axis=1) + 0.1
        model = LabelModel(float(np.clip(weight[1].sum() / counts.sum(), 0.01, 0.99)), rates / rates.sum(axis=2, keepdims=True))
        good = model.posterior(patterns)
    return model


def token_features(token: bytes) -> tuple[int, ...]:
    """Hashes of a token and of its shape with runs made one."""
    return (zlib.crc32(token) & SPACE - 1, zlib.crc32(re.sub(rb"(.)\1+", rb"\1", token.translate(SHAPE), flags=re.DOTALL), 1) & SPACE - 1)


def buckets(x: tuple[float, ...]) -> list[int]:
    """Hashes of each statistic with its bucket: tenths, or whole letters for the mean length."""
    return [zlib.crc32(b"%d:%d" % (i, min(20, int(v if i == 6 else 10 * v))), 2) & SPACE - 1 for i, v in enumerate(x)]


def fit_scorer(rows: list[tuple[np.ndarray, list[int]]], target: np.ndarray, steps: int = 150, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic weights and intercept for soft targets; a row is (token features, bucket features), tokens count by their share."""
    weights = np.zeros(SPACE)
    if not rows:
        return weights, 0.0
    doc, feature, value = [], [], []
    for i, (tokens, own) in enumerate(rows):
        f, c = np.unique(tokens, return_counts=True)
        doc += [np.full(len(f) + len(own), i, np.int32)]
        feature += [f, np.array(own, np.int32)]
        value += [(c * (2.0 / max(1, len(tokens)))).astype(np.float32), np.ones(len(own), np.float32)]
    doc, feature, value = np.concatenate(doc), np.concatenate(feature), np.concatenate(value)
    common = np.bincount(feature, minlength=SPACE)[feature] >= 3
    doc, value = doc[common], value[common]
    names, feature = np.unique(feature[common], return_inverse=True)
    w, b = Adam(np.zeros(len(names)), rate), Adam(np.zeros(1), rate)
    for _ in range(steps):
        g = (sigmoid(np.bincount(doc, w.x[feature] * value, len(rows)) + b.x[0]) - target) / len(rows)
        w.step(np.bincount(feature, g[doc] * value, len(names)) + l2 * w.x)
        b.step(np.array([g.sum()]))
    weights[names] = w.x
    return weights, float(b.x[0])


def pattern_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Every vote pattern of the corpus and its number of documents; counted in the workers, then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            for t in texts(batch.column(0)):
                tokens, x = statistics(t)
                code = sum(v * 3**i for i, v in enumerate(votes(len(tokens), x)))
                seen[code] = seen.get(code, 0) + 1
        yield pa.record_batch({"code": pa.array(seen.keys(), pa.int32()), "n": pa.array(seen.values(), pa.int64())})

    got = docs.select(column(docs, "text", "string")).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    return np.array([[r["code"] // 3**i % 3 for i in range(len(VOTERS))] for r in got], np.int64).reshape(-1, len(VOTERS)), np.array([r["n"] for r in got], float)


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[LabelModel, np.ndarray, float]:
    """The label model from all documents, the scorer from the sample."""
    patterns, counts = pattern_counts(docs)
    labels = fit_labels(patterns, counts)
    text = F.coalesce(column(docs, "text", "string"), F.lit(""))
    given = docs.select(F.xxhash64(text).alias("mark"), text.alias("text"))
    # the lowest marks are below a share that holds twice the sample, by an estimate of the number of different texts
    share = min(1.0, 2 * sample / max(1, given.agg(F.approx_count_distinct("mark")).first()[0]))
    low = F.col("mark") < int(share * (1 << 63)) * 2 - (1 << 63) if share < 1 else F.lit(True)
    marks = given.filter(low).select("mark").distinct().orderBy("mark").limit(sample)
    some = given.filter(low).join(F.broadcast(marks), "mark").select("mark", "text")  # as many marks as the sample, at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        known: dict[bytes, tuple[int, ...]] = {}

        def features(token: bytes) -> tuple[int, ...]:
            if (f := known.get(token)) is None:
                if len(known) >= KEPT:
                    known.clear()
                f = known[token] = token_features(token)
            return f

        for batch in batches:
            out: dict[str, list] = {"mark": [], "tokens": [], "own": [], "votes": []}
            for mark, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                if mark not in seen:
                    seen.add(mark)
                    tokens, x = statistics(t)
                    out["mark"].append(mark)
                    out["tokens"].append(np.fromiter((f for w in tokens for f in features(w)), np.int32).tobytes())
                    out["own"].append(buckets(x))
                    out["votes"].append(list(votes(len(tokens), x)))
            yield pa.record_batch({"mark": pa.array(out["mark"], pa.int64()), "tokens": pa.array(out["tokens"], pa.binary()), "own": pa.array(out["own"], pa.list_(pa.int32())), "votes": pa.array(out["votes"], pa.list_(pa.int32()))})

    def scorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, said = [], []
        for batch in batches:
            rows += [(np.frombuffer(t, np.int32), o) for t, o in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            said += batch.column(2).to_pylist()
        weights, intercept = fit_scorer(rows, labels.posterior(np.array(said, np.int64).reshape(-1, len(VOTERS))))
        yield pa.record_batch({"weights": pa.array([packed(weights)], pa.binary()), "intercept": pa.array([intercept], pa.float64())})

    # the sample stays in one task, of which the driver gets the weights
    rows = some.mapInArrow(run, "mark long, tokens binary, own array<int>, votes array<int>").dropDuplicates(["mark"])
    got = rows.repartition(1).sortWithinPartitions("mark").select("tokens", "own", "votes").mapInArrow(scorer, "weights binary, intercept double").first()
    return labels, *((unpacked(got["weights"]), got["intercept"]) if got else fit_scorer([], np.zeros(0)))


def scored(docs: DataFrame, weights: np.ndarray, intercept: float) -> DataFrame:
    """The rows with quality double (0 to 1) in place of a column of this name."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast((weights, intercept))
    docs = docs.drop("quality")
    at = docs.columns.index("text") if "text" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = shared.value
        total = memoised(weights, token_features)
        for batch in batches:
            s = []
            for t in texts(batch.column(at)) if at is not None else [b""] * batch.num_rows:
                tokens, x = statistics(t)
                s.append(intercept + total(tokens) / max(1, len(tokens)) + sum(weights[f] for f in buckets(x)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(np.array(s, float)))], [*batch.schema.names, "quality"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("quality", DoubleType())]))


def keep(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of good quality, with their own columns."""
    bounded(spark)
    _, weights, intercept = fit(docs)
    plain, back = set_aside(docs, ["quality"])
    return scored(plain, weights, intercept).filter("quality >= 0.5").drop("quality").withColumnsRenamed(back).select(*own(docs))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, quality, good) of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    _, weights, intercept = fit(docs)
    return scored(docs, weights, intercept).select("doc_id", "quality", (F.col("quality") >= 0.5).alias("good"))
