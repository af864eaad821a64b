from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pickline.llm import grades

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, grade string, accepted int, r_id string"


def test_held_out_accuracy(spark):
    """Fitted on half of the rated documents, judged on the other half."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    model = grades.train(docs, labels.filter(half == 0))
    graded = grades.grade(docs, model).join(labels.filter(half == 1), "doc_id").toPandas()
    clean = (graded.quality == 1) & (graded.toxic == 0)
    assert graded[clean].accepted.mean() > 0.98
    assert graded[graded.toxic == 1].accepted.mean() < 0.25
    assert graded[(graded.quality == 0) & (graded.toxic == 0)].accepted.mean() < 0.15
    assert graded[clean].expected_grade.mean() > graded[graded.quality == 0].expected_grade.mean() \
        > graded[graded.toxic == 1].expected_grade.mean() - 0.5


def small():
    rng = random.Random(0)
    vocab = [f"w{'abcdefgh'[i % 8]}{'xyz'[i % 3]}" for i in range(24)]
    rows, labels = [], []
    for i in range(120):
        text = " ".join(rng.choices(vocab, k=30))
        kind = i % 3
        text += {0: " vile vile", 1: " %%% %%% ###", 2: ""}[kind]
        rows.append((i, text))
        labels.append((i, int(kind == 2), int(kind == 0)))
    return rows, labels


def frames(spark, rows, labels):
    return (spark.createDataFrame([(i, t, "g", 0, "r") for i, t in rows], SCHEMA),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_grades_and_edge_rows(spark):
    rows, labels = small()
    extra = [(900, None), (901, ""), (None, "wax vile vile"), (5, rows[5][1]), (902, "x" * 400_000)]
    docs, rated = frames(spark, rows + extra, labels + [(None, 1, 0), (0, None, None), (1, 1, None)])
    got = grades.graded_documents(docs, rated).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 900}
    assert np.mean([by[i].grade == i % 3 for i in range(120)]) > 0.95
    assert all(by[i].accepted == (i % 3 == 2) for i in range(120))
    kept = grades.accepted_documents(docs, rated)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 900} == {i for i in range(120) if i % 3 == 2}


def test_without_or_with_one_kind_of_labels(spark):
    rows, labels = small()
    docs, none = frames(spark, rows, [])
    assert all(r.accepted for r in grades.graded_documents(docs, none).collect())
    docs, poor = frames(spark, rows, [(1, 0, 0)])
    assert {r.grade for r in grades.graded_documents(docs, poor).collect()} == {1}
    docs, some = frames(spark, [], labels)
    assert grades.graded_documents(docs, some).collect() == []


def test_gradient_is_that_of_the_likelihood():
    """The fit ends where no small change of any weight or threshold is better."""
    rows, labels = small()
    y = [0 if t else 1 + q for _, q, t in labels]
    texts = [t for _, t in rows]

    def loss(model):
        p = np.array([model.probabilities(t)[g] for t, g in zip(texts, y, strict=True)])
        return -np.log(p).mean() + grades.PENALTY / 2 * (model.weights.astype(float) ** 2).sum()

    model = grades.fit(texts, y, steps=1500)
    best = loss(model)
    for k in np.flatnonzero(model.weights)[:20]:
        for d in (-0.3, 0.3):
            other = grades.Model(model.weights.copy(), model.thresholds)
            other.weights[k] += d
            assert loss(other) > best - 1e-6
    for d in (-0.3, 0.3):
        assert loss(grades.Model(model.weights, model.thresholds + [d, 0])) > best - 1e-6
    assert model.thresholds[0] < model.thresholds[1]
    assert model.probabilities(texts[2]).sum() == pytest.approx(1)
