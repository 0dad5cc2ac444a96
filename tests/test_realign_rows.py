"""Re-alignment in rows: the offsets of each book, and no call to Python for each of them."""

from __future__ import annotations

import random

import numpy as np

from spanloom.operators import clean


def test_realign_offsets_takes_many_books_in_a_call(spark):
    rng = random.Random(3)
    spans, anchors = [], []
    for b in (None, *range(20)):
        at = sorted(rng.sample(range(0, 4000, 20), rng.randint(1, 12)))
        spans += [(b, s, s + rng.randint(5, 15)) for s in at] * (2 if b == 4 else 1)
        anchors += [(b, s + 12, e + 12) for k, s, e in spans if k == b and rng.random() < 0.8] if b != 7 else []
    anchors.append((50, 1, 2))
    df = clean.realign_offsets(spark.createDataFrame(spans, "doc_id long, s long, e long"), spark.createDataFrame(anchors, "doc_id long, s long, e long"))
    want = []
    for b in {x[0] for x in spans}:
        own = np.array(sorted(x[1:] for x in spans if x[0] == b), np.int64)
        marks = np.array([x[1:] for x in anchors if x[0] == b], np.int64).reshape(-1, 2)
        want += [(b, s, e, o) for (s, e), o in zip(own.tolist(), clean.choose_offsets(own[:, 0], own[:, 1], marks[:, 0], marks[:, 1]).tolist(), strict=True)]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, want)) and any(x[3] == 12 for x in want)
    assert "CoGroup" not in df._jdf.queryExecution().optimizedPlan().toString()
