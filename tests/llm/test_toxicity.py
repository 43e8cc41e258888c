import os

import numpy as np

from corpusloom.llm import toxicity as T
from corpusloom.llm.common import WORDS, read
from corpusloom.llm.hashed import word_features


def test_held_out_accuracy(spark):
    """Half of the labels fit, the other half judge."""
    where = "/root/testdata/sf0.1"
    labels = read(spark, where, "labels")
    docs = read(spark, where, "documents")
    model = T.fit(docs, labels.filter("doc_id % 2 = 0"))
    held = labels.filter("doc_id % 2 = 1").withColumnRenamed("toxic", "truth").select("doc_id", "truth")
    got = T.scored(docs.select("doc_id", "text"), model).join(held, "doc_id").select("toxic", "truth").collect()
    missed, wrong = sum(r.truth and not r.toxic for r in got), sum(r.toxic and not r.truth for r in got)
    assert missed <= 0.1 * sum(r.truth for r in got)
    assert wrong <= 0.01 * len(got)


def test_cuts_are_ordered_and_severity_grows():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for k in range(600):
        g = k % 3
        words = [b"mild"] * (g == 1) + [b"grave"] * (g == 2) + [b"w%d" % i for i in rng.integers(0, 50, 20)]
        rows.append(np.array([f for w in set(words) for f in word_features(w)], np.int32))
        grades.append(g)
    model = T.fit_ordinal(rows, np.array(grades))
    assert list(model.cuts) == sorted(model.cuts)
    p = model.beyond(np.array([model.weights[r].sum() for r in rows])).sum(axis=1)
    means = [p[np.array(grades) == g].mean() for g in range(3)]
    assert means[0] < 0.2 and 0.6 < means[1] < 1.4 and means[2] > 1.6


def test_gradient_is_that_of_the_loss():
    rows = [np.array(r, np.int32) for r in ([1], [1], [1, 2], [2], [2], [3], [3], [3])] * 40
    grades = np.array([0, 0, 2, 1, 1, 0, 0, 0] * 40)
    model = T.fit_ordinal(rows, grades, steps=1500)
    p = model.beyond(np.array([model.weights[r].sum() for r in rows]))
    assert abs((p[:, 0] > 0.5).mean() - (grades > 0).mean()) < 0.05


def test_no_labels_find_nothing(spark, awkward):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = T.fit(awkward, empty)
    assert not T.scored(awkward, model).filter("toxic").count()


def test_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(10, 1, 1), (4, 1, 0), (4, 1, None), (5, None, 0), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    got = T.scored(awkward, T.fit(awkward, labels))
    assert got.count() == awkward.count()
    assert T.scored(awkward.limit(0), T.fit(awkward.limit(0), labels)).count() == 0


def test_keep_returns_the_columns(spark, awkward, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = T.keep(spark, awkward, str(tmp_path))
    assert kept.columns == awkward.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, awkward.collect()))


def test_words_rule():
    assert "A-b é2_c".encode().translate(WORDS).split() == [b"a", b"b", "é2".encode(), b"c"]


def test_no_small_change_lowers_the_loss():
    """The fitted weights and cuts against the loss written out plainly, changed one by one."""
    rng = np.random.default_rng(3)
    rows = [np.array([7] * int(rng.integers(0, 2)) + [9] * int(rng.integers(0, 3)), np.int32) for _ in range(900)]
    grades = np.array([min(2, max(0, int(round((r == 7).sum() * 0.8 + (r == 9).sum() * 0.7 + rng.normal(0, 0.6))))) for r in rows])
    model = T.fit_ordinal(rows, grades, steps=3000)

    def loss(w7, w9, c0, c1):
        s = np.array([w7 * (r == 7).sum() + w9 * (r == 9).sum() for r in rows])
        upto = [1 / (1 + np.exp(-(c - s))) for c in (c0, c1)]
        p = np.stack([upto[0], upto[1] - upto[0], 1 - upto[1]], axis=1)[np.arange(len(rows)), grades]
        return -np.log(p).mean() + 0.5 * 5e-5 * (w7**2 + w9**2)

    at = [model.weights[7], model.weights[9], *model.cuts]
    for k in range(4):
        for d in (-0.1, 0.1):
            assert loss(*[x + d * (k == j) for j, x in enumerate(at)]) > loss(*at) - 1e-5


def test_query(spark, data):
    """Every row scored, as a plain loop over its different words scores it."""
    docs, labels = read(spark, data, "documents"), read(spark, data, "labels")
    model = T.fit(docs, labels)
    got = {r.doc_id: (r.severity, r.toxic) for r in T.op1_toxicity(spark, data).collect()}
    for r in docs.collect():
        s = sum(model.weights[f] for w in set((r.text or "").encode().translate(WORDS).split()) for f in word_features(w))
        p = [1 / (1 + np.exp(c - s)) for c in model.cuts]
        assert abs(got[r.doc_id][0] - sum(p)) < 1e-9 and got[r.doc_id][1] == (p[0] >= 0.5)
    assert len(got) == docs.count()


def test_the_sample_is_a_bound(spark):
    """An id with many texts gives no more rows than the sample."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "same")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert T.labelled(docs, labels, "toxic", 20).count() == 20 and T.labelled(docs, labels, "toxic", 1000).count() == 501


def test_the_fit_is_not_on_the_driver(spark, data, monkeypatch):
    """The labelled sample and its fit stay in a task."""
    docs, labels = read(spark, data, "documents"), read(spark, data, "labels")
    want = T.fit(docs, labels)

    def elsewhere(*given, mine=os.getpid(), fit=T.fit_ordinal):
        assert os.getpid() != mine
        return fit(*given)

    monkeypatch.setattr(T, "fit_ordinal", elsewhere)
    got = T.fit(docs, labels)
    assert (got.weights == want.weights).all() and (got.cuts == want.cuts).all() and got.weights.any()
