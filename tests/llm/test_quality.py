import os

import numpy as np

from corpusloom.llm import quality as Q
from corpusloom.llm.common import read


def test_agrees_with_labels_it_never_saw(spark):
    where = "/root/testdata/sf0.1"
    docs = read(spark, where, "documents").select("doc_id", "text")
    _, weights, intercept = Q.fit(docs)
    labels = read(spark, where, "labels").withColumnRenamed("quality", "truth").select("doc_id", "truth")
    got = Q.scored(docs, weights, intercept).join(labels, "doc_id").select("quality", "truth").collect()
    lost, poor = sum(r.truth and r.quality < 0.5 for r in got), sum(not r.truth and r.quality >= 0.5 for r in got)
    assert lost <= 0.01 * sum(r.truth for r in got)
    assert poor <= 0.1 * sum(not r.truth for r in got)


def test_em_recovers_rates():
    rng = np.random.default_rng(1)
    good = rng.random(20000) < 0.7
    said = np.array([0.9, 0.8, 0.6, 0.95])
    right = np.array([0.9, 0.8, 0.85, 0.95])
    votes = np.where(rng.random((20000, 4)) < said, np.where(rng.random((20000, 4)) < right, good[:, None], ~good[:, None]), 2)
    patterns, counts = np.unique(votes.astype(int), axis=0, return_counts=True)
    model = Q.fit_labels(patterns, counts.astype(float), 200)
    assert abs(model.prior - 0.7) < 0.06
    assert np.abs(model.rates[1, :, 1] - right).max() < 0.06
    assert ((model.posterior(votes.astype(int)) >= 0.5) == good).mean() > 0.95


def test_pattern_counts(spark, awkward):
    patterns, counts = Q.pattern_counts(awkward)
    assert counts.sum() == awkward.count()
    assert set(patterns.flatten()) <= {0, 1, 2}


def test_awkward_rows(spark, awkward):
    _, weights, intercept = Q.fit(awkward)
    assert Q.scored(awkward, weights, intercept).count() == awkward.count()
    none = awkward.limit(0)
    _, weights, intercept = Q.fit(none)
    assert Q.scored(none, weights, intercept).count() == 0
    kept = Q.keep(spark, awkward, "")
    assert kept.columns == awkward.columns and {str(r) for r in kept.collect()} <= {str(r) for r in awkward.collect()}


def test_em_against_plain_loops(spark, data):
    """The same rounds over every document, one by one."""
    votes = [Q.votes(len(t), x) for t, x in (Q.statistics((r.text or "").encode()) for r in read(spark, data, "documents").collect())]
    good = [0.1 if 0 in v else 0.9 for v in votes]
    for _ in range(50):
        prior = min(0.99, max(0.01, sum(good) / len(votes)))
        rates = []
        for c in (0, 1):
            own = []
            for k in range(len(Q.VOTERS)):
                said = [0.1, 0.1]
                for v, g in zip(votes, good, strict=True):
                    if v[k] < 2:
                        said[v[k]] += g if c else 1 - g
                own.append([x / sum(said) for x in said])
            rates.append(own)
        good = []
        for v in votes:
            p = [1 - prior, prior]
            for k, x in enumerate(v):
                if x < 2:
                    p = [p[c] * rates[c][k][x] for c in (0, 1)]
            good.append(p[1] / sum(p))
    model = Q.fit_labels(*Q.pattern_counts(read(spark, data, "documents")))
    assert abs(model.prior - prior) < 1e-9 and np.abs(model.rates - np.array(rates)).max() < 1e-9


def test_scorer_is_near_the_least_loss():
    """Against plain gradient descent with as many steps as it takes."""
    rng = np.random.default_rng(4)
    rows = [(rng.integers(0, 12, 20), [100 + int(rng.integers(0, 3))]) for _ in range(300)]
    target = np.array([0.95 if (t < 4).sum() > 6 else 0.1 for t, _ in rows])
    x = np.zeros((300, 104))
    for i, (t, o) in enumerate(rows):
        x[i, :12] = np.bincount(t, minlength=12) * 2.0 / len(t)
        x[i, o] = 1

    def loss(w, b):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).mean() + 0.5e-4 * (w @ w)

    w, b = np.zeros(104), 0.0
    for _ in range(20000):
        e = (1 / (1 + np.exp(-(x @ w + b))) - target) / 300
        w, b = w - 2.0 * (x.T @ e + 1e-4 * w), b - 2.0 * e.sum()
    weights, intercept = Q.fit_scorer(rows, target, steps=600)
    assert loss(weights[:104], intercept) < loss(w, b) + 0.01


def test_query(spark, data):
    """Every row scored, as a plain loop over its tokens scores it."""
    docs = read(spark, data, "documents")
    _, weights, intercept = Q.fit(docs.select("doc_id", "text"))
    got = {r.doc_id: (r.quality, r.good) for r in Q.op3_quality(spark, data).collect()}
    want = {}
    for r in docs.collect():
        tokens, x = Q.statistics((r.text or "").encode())
        s = intercept + sum(weights[f] for t in tokens for f in Q.token_features(t)) / max(1, len(tokens)) + sum(weights[f] for f in Q.buckets(x))
        want[r.doc_id] = 1 / (1 + np.exp(-s))
    assert got.keys() == want.keys()
    assert all(abs(q - want[i]) < 1e-9 and good == (q >= 0.5) for i, (q, good) in got.items())


def test_variety_at_every_length():
    """Few different words are few at 20,000 tokens, too; many stay many."""
    few, many = ([b"w%d" % (i % n) for i in range(20_000)] for n in (12, 5000))
    for n in (40, 99, 100, 101, 299, 301, 5000, 20_000):
        assert Q.variety(few[:n]) <= 0.3 and Q.variety(many[:n]) == 1.0, n
    assert Q.variety([]) == 0.0 and Q.variety([b"a"]) == 1.0


def test_the_sample_is_a_bound(spark, monkeypatch):
    """Copies, under one id, many or none, count once; the fit never gets more than the sample."""
    sizes = []
    real = Q.fit_scorer
    monkeypatch.setattr(Q, "fit_scorer", lambda rows, target: sizes.append(len(rows)) or real(rows, target))
    rows = [(None if i % 3 else 1, "the same text in many rows, again and again") for i in range(3000)] + [(1, f"text number {i} of one id") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    Q.fit(docs, 100)
    Q.fit(docs, 10_000)
    assert sizes[0] <= 100 and sizes[0] >= 10 and sizes[1] == 401
    Q.fit(docs.filter("text like 'the same%'"), 5)
    assert sizes[2] == 1


def test_the_fit_is_not_on_the_driver(spark, data, monkeypatch):
    """The sample and the scorer's fit stay in a task."""
    docs = read(spark, data, "documents")
    _, want, b = Q.fit(docs)

    def elsewhere(*given, mine=os.getpid(), fit=Q.fit_scorer):
        assert os.getpid() != mine
        return fit(*given)

    monkeypatch.setattr(Q, "fit_scorer", elsewhere)
    _, got, intercept = Q.fit(docs)
    assert (got == want).all() and intercept == b and got.any()
