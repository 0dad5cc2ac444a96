"""Work that must be done once or within bounds: scoring, tokenizing, order statistics."""

from __future__ import annotations

import random
import statistics

import numpy as np
from pyspark.sql import functions as F
from spanloom.operators import dataset, decode, quantile


def test_scorer_sees_bounded_batches(spark, tmp_path):
    log = str(tmp_path / "sizes")

    def scorer():
        def score(windows):
            with open(log, "a") as f:
                f.write(f"{len(windows)} {sum(len(w) for w in windows) * 3}\n")
            return [np.array([[(i * 7) % 5, (i * 3) % 9, (i * 11) % 9] for i in w], float) for w in windows]

        return score

    def one():
        return lambda ids: np.array([[(i * 7) % 5, (i * 3) % 9, (i * 11) % 9] for i in ids], float)

    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([0, 1, 40, 700]))) if i else None) for i in range(60)]
    books = spark.createDataFrame(rows, "doc_id long, text string")
    got = decode.predict_spans(books, scorer, penalty=1.0, content=50, stride=30, batched=True, cells=600)
    want = {tuple(r) for r in decode.predict_spans(books, one, penalty=1.0, content=50, stride=30).collect()}
    assert {tuple(r) for r in got.collect()} == want and want
    sizes = [tuple(map(int, x.split())) for x in open(log)]
    assert max(cells for _, cells in sizes) <= 600 and max(n for n, _ in sizes) >= 4
    # a window above the bound goes alone
    alone = decode.predict_spans(books, scorer, penalty=1.0, content=50, stride=30, batched=True, cells=10)
    assert {tuple(r) for r in alone.collect()} == want


def test_texts_are_tokenized_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def tokenizer():
        def tokens(text):
            with open(log, "a") as f:
                f.write("x\n")
            return [(len(w), i, i + 1) for i, w in enumerate(text)]

        return tokens

    books = spark.createDataFrame([(i, "abc de") for i in range(20)] + [(99, "unlisted")], "doc_id long, text string")
    spans = spark.createDataFrame([(i, 0, 3) for i in range(20)], "doc_id long, s long, e long")
    splits = spark.createDataFrame([(i, "train") for i in range(20)], "doc_id long, split string")
    made = dataset.build_dataset(books, spans, splits, tokenizer, content=4, stride=2)
    assert made.count() == 40 and made.filter("split = 'train'").count() == 40
    assert len(open(log).readlines()) == 20


def test_order_statistics(spark, monkeypatch):
    rng = random.Random(6)
    groups = {"a": [rng.random() * 10**rng.randint(-9, 9) for _ in range(700)], "b": [5.0] * 150, None: [float(rng.randint(0, 9)) for _ in range(101)], "one": [-3.5], "two": [1.0, 2.0], "none": [None], "far": [float("inf"), float("-inf"), 1.0, 2.0, 3.0, float("nan"), None]}
    df = spark.createDataFrame([(k, v) for k, own in groups.items() for v in own], "k string, v double")
    for cells in (1000, 3):
        monkeypatch.setattr(quantile, "CELLS", cells)
        got = {r.k: r for r in quantile.exclusive_quantiles(df, "k", "v", (1, 10, 50, 99)).collect()}
        assert set(got) == set(groups) - {"none"}
        for k, own in groups.items():
            if k == "none":
                continue
            own = [x for x in own if x == x and x is not None]
            cuts = statistics.quantiles(own, n=100) if len(own) > 100 else None
            for p in (1, 10, 50, 99):
                assert got[k][f"p{p}"] is None if cuts is None else abs(got[k][f"p{p}"] - cuts[p - 1]) <= 1e-9 * max(1, abs(cuts[p - 1]))
        middle = {r.k: r["median"] for r in quantile.median(df, "k", "v").collect()}
        assert middle == {k: statistics.median([x for x in own if x == x and x is not None]) for k, own in groups.items() if k != "none"}
    found = quantile.order_statistics(df, "k", "v", {"first": F.lit(1), "out": F.col("n") + 1})
    assert {(r.k, r.first, r.out) for r in found.collect()} == {(k, min(x for x in own if x == x and x is not None), None) for k, own in groups.items() if k != "none"}
    assert quantile.median(df.limit(0), "k", "v").count() == 0 and quantile.exclusive_quantiles(df.limit(0), "k", "v", (10,)).count() == 0
