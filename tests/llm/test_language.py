"""Language identification: the sample's bounds, the training against a dense version, letters, held-out accuracy."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanloom.llm import language

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_sample_is_bounded_under_null_and_repeated_ids(spark):
    rows = [(None, f"text {chr(97 + i % 26)} {i}", "en") for i in range(3000)] + [(7, "the very same", "fr")] * 2000 + [(i % 3, f"texte {i}", "fr") for i in range(400)] + [(1, "12 34", "de"), (2, None, "de"), (3, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language.sample_of(docs, F.col("doc_id"), "text", "lang", 100).toPandas()
    n = sample.groupby("lang").size()
    assert set(n.index) == {"en", "fr"} and all(100 <= x <= 160 for x in n)
    kept = language.bounded(sample, 100, 150)
    assert kept.groupby("lang").size().to_dict() == {"en": 75, "fr": 75} and not kept.duplicated(["lang", "key"]).any()
    again = language.sample_of(docs.repartition(7), F.col("doc_id"), "text", "lang", 100).toPandas()
    assert set(again["key"]) == set(sample["key"])


def test_no_label_is_left_out(spark):
    rows = [(i, f"word{chr(97 + i % 20)} number {i}", f"l{i % 90}") for i in range(360)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id"), rows=180)
    assert len(model["languages"]) == 90
    empty = language.train(spark.createDataFrame([], "doc_id long, text string, lang string"), F.col("doc_id"))
    assert empty["languages"] == []


def dense_ftrl(sample, languages):
    """The same training on dense vectors: every weight in closed form from z and s at each step."""
    n, k = len(sample), len(languages)
    x = np.zeros((n, language.DIM + 1))
    for i, (f, v) in enumerate(zip(sample["idx"], sample["val"], strict=True)):
        x[i, f] = v
    df = (x[:, :-1] > 0).sum(axis=0)
    idf = np.log((1 + n) / (1 + df)) + 1
    x[:, :-1] *= language.SCALE * idf
    x[:, -1] = 1
    y = np.array([languages.index(v) for v in sample["lang"]])
    z, s = np.zeros((language.DIM + 1, k)), np.zeros((language.DIM + 1, k))
    order = np.random.default_rng(0)
    train = np.arange(n)
    lead = lambda: np.where(np.abs(z) <= language.L1, 0, -(z - np.sign(z) * language.L1) / ((language.BETA + np.sqrt(s)) / language.ALPHA + language.L2))
    for _ in range(language.EPOCHS):
        for part in np.array_split(order.permutation(train), max(1, n // language.BATCH)):
            w = lead()
            p = np.exp(x[part] @ w)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            g = x[part].T @ p / len(part)
            z += g - (np.sqrt(s + g * g) - np.sqrt(s)) / language.ALPHA * w
            s += g * g
    w = lead()
    return language.SCALE * w[:-1] * idf[:, None], w[-1]


def test_training_against_a_dense_version():
    texts = {"en": "the cat and the dog", "fr": "le chat et le chien", "de": "die katze und der hund"}
    rows = []
    for i in range(24):  # too few to hold any out for calibration
        lang = list(texts)[i % 3]
        f, n = np.unique(language.grams(texts[lang] + " " + "abcdefgh"[i % 8]), return_counts=True)
        rows.append((lang, i, f, (n / n.sum()).astype(np.float32)))
    sample = pd.DataFrame(rows, columns=["lang", "key", "idx", "val"])
    model = language.fit(sample)
    weights, bias = dense_ftrl(sample, model["languages"])
    assert np.allclose(model["weights"], weights, atol=1e-3) and np.allclose(model["bias"], bias, atol=1e-4)
    assert (model["weights"] == 0).mean() > 0.9


def test_letters():
    for text, letter in (("½ ² ① Ⅳ 12 _ -", False), ("", False), (None, False), ("12 ß", True), ("文", True), ("ª", True)):
        assert language.has_letter(text) == letter, text


@pytest.mark.skipif(not os.path.exists(DOCS), reason="no test tables here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCS)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language.train(docs.filter(~held), F.col("doc_id"))
    got = language.predict(docs.filter(held), model).filter("lang IS NOT NULL AND lang_pred <> 'und'").toPandas()
    right = (got["lang"] == got["lang_pred"]).mean()
    print("held out", len(got), right, "mean score", got["score"].mean())
    assert right >= 0.97 and abs(got["score"].mean() - right) < 0.06


def test_the_one_task_gets_the_bound_with_many_labels(spark):
    rows = [(i, f"text number {i} of some length", f"l{i % 1000}") for i in range(30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language.sample_of(docs, F.col("doc_id"), "text", "lang", per_language=100, rows=2000)
    n = sample.count()
    # two rows each; a language's last level may bring a few more
    assert 2000 <= n <= 3 * 1000 and sample.select("lang").distinct().count() == 1000
    assert language.share_of(1000, 100, 2000) == 2 and language.share_of(0, 100, 2000) == 100 and language.share_of(5000, 100, 2000) == 1
