"""Quality classifier: held-out accuracy, ordered thresholds and odd input."""

import random

import numpy as np
from pyspark.sql import functions as F

from reviewloom.llm import quality_classifier as qc
from reviewloom.llm.queries import graded_labels
from reviewloom.llm.shared import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    grades = graded_labels(spark, SF).where("grade IS NOT NULL")
    train = grades.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) > 0)
    held = grades.join(train, "doc_id", "left_anti")
    out = qc.classify(docs, train).join(held, "doc_id").select("grade", "kept", "expected_grade", "tail_probability").toPandas()
    clean, bad = out[out.grade == 2], out[out.grade < 2]
    assert len(bad) > 15 and clean.kept.mean() >= 0.97 and bad.kept.mean() <= 0.15
    assert clean.expected_grade.mean() > bad.expected_grade.mean() + 0.5
    assert out.tail_probability.between(0, 1).all() and out.expected_grade.between(0, 2).all()


def test_fit_is_ordinal():
    rng = random.Random(1)
    buckets, grades = [], []
    for _ in range(900):
        bad = [rng.random() < 0.3 for _ in range(3)]
        buckets.append(np.array(sorted({i for i, b in enumerate(bad) if b} | {rng.randint(10, 500)})))
        grades.append(3 - sum(bad))
    m = qc.fit(buckets, np.array(grades), 4)
    assert m.thresholds == sorted(m.thresholds) and all(m.weights[i] < -1 for i in range(3))
    p = m.probabilities(np.array([0.0, m.weights[0], m.weights[0] + m.weights[1]]))
    assert np.allclose(p.sum(axis=1), 1) and (np.diff(p @ np.arange(4)) < 0).all() and p[:, 1:].argmax(axis=1)[0] == 2


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, "x", "b"), (None, "", "c"), (2, "y" * 300_000, "d")], "doc_id long, text string, grade string")
    none = spark.createDataFrame([(1, None), (2, None)], "doc_id long, grade int")
    for labels in (none, none.limit(0), spark.createDataFrame([(1, 2), (1, 2)], "doc_id long, grade int")):
        out = qc.classify(docs, labels).collect()
        assert len(out) == 4 and all(r.kept for r in out)
    assert qc.classify(docs.limit(0), none).collect() == []


def test_labels_with_conflicts_and_unknown_values(spark):
    raw = spark.createDataFrame([(0, 0, 2), (1, 1, 1), (0, 1, 0), (1, 0, 2), (None, 0, None), (7, 0, None)], "quality int, toxic int, g int")
    assert all(r.g == r.h if (r.quality, r.toxic) in {(1, 1), (0, 1), (1, 0)} else True for r in raw.withColumn("h", qc.quality_grade(F.col("quality"), F.col("toxic"))).collect()[1:])
    texts = [(i, "fine words here" if i % 2 else "awful words here") for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 2 if i % 2 else 0) for i in range(80)] + [(1, 0)], "doc_id long, grade int")
    got = {r.doc_id: r.kept for r in qc.classify(docs, labels).collect()}
    assert all(got[i] == bool(i % 2) for i in range(80))
    few = qc.training_rows(docs, labels, 10, "doc_id", "text")
    assert len(few) == 10


def penalised_loss(w, cut, buckets, grades, n_grades):
    """The fitted objective, document by document."""
    present = np.bincount(grades, minlength=n_grades)
    weight = 1 / np.sqrt(present[grades])
    weight = weight / weight.sum()
    out = 0.0
    for b, g, share in zip(buckets, grades, weight, strict=True):
        score = sum(w.get(int(x), 0.0) for x in b)
        edge = [0.0, *(1 / (1 + np.exp(-np.clip(t - score, -40, 40))) for t in cut), 1.0]
        out -= share * np.log(max(edge[g + 1] - edge[g], 1e-9))
    return out + qc.PENALTY / (2 * max(len(w), 1)) * sum(x * x for x in w.values())


def test_no_other_parameters_fit_better():
    rng = random.Random(17)
    buckets, grades = [], []
    for _ in range(400):
        g = rng.choice([0, 1, 2, 2])
        words = {rng.randrange(100, 160) for _ in range(20)} | {k for k in range(12) if rng.random() < (0.7, 0.35, 0.05)[g]}
        buckets.append(np.array(sorted(words)))
        grades.append(g)
    grades = np.array(grades)
    m = qc.fit(buckets, grades, 3)
    assert m.weights and m.thresholds[0] < m.thresholds[1]
    best = penalised_loss(m.weights, m.thresholds, buckets, grades, 3)
    for k in range(150):
        size = (0.3, 0.05, 0.01)[k % 3]
        w = {c: x + rng.gauss(0, size) for c, x in m.weights.items()}
        cut = sorted(t + rng.gauss(0, size) for t in m.thresholds)
        assert penalised_loss(w, cut, buckets, grades, 3) > best - 2e-4
    for c in m.weights:
        for step in (-0.05, 0.05):
            assert penalised_loss(m.weights | {c: m.weights[c] + step}, m.thresholds, buckets, grades, 3) > best - 2e-4


def test_screening_by_executors_gives_the_model_of_all_buckets(spark):
    rng = random.Random(31)
    bad, plain = [f"bad{i}" for i in range(40)], [f"word{i}" for i in range(300)]
    texts, grades = [], []
    for _ in range(300):
        grades.append(rng.randrange(3))
        texts.append(" ".join(rng.choices(plain, k=30) + rng.choices(bad, k=2 * (2 - grades[-1]))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame(list(enumerate(grades)), "doc_id long, grade int")
    rows = qc.training_rows(df, labels, 1000, "doc_id", "text")
    whole = [np.unique([qc.bucket(w) for w in qc.tokens_of(t)]) for t in texts]
    got, want = (qc.fit(b, np.array(grades), 3) for b in ([b for b, _ in rows], whole))
    assert [g for _, g in rows] == grades and sum(len(b) for b, _ in rows) < sum(map(len, whole)) / 3
    assert got.weights == want.weights and got.thresholds == want.thresholds and len(got.weights) > 10
    assert qc.training_rows(df, labels.limit(0), 1000, "doc_id", "text") == []
