"""Greedy matching by rounds and the sparse re-alignment, against plain versions."""

from __future__ import annotations

import random
import time

import numpy as np
from spanloom.operators import clean, score


def test_one_island_of_many_pairs(spark):
    rng = random.Random(8)
    pairs = sorted({(rng.randrange(3000), rng.randrange(3000)) for _ in range(100_000)})
    rows = [(1, g, p, rng.randint(1, 500) / 500, 0, 9, 0, 9) for g, p in pairs]
    cands = spark.createDataFrame(rows, "doc_id long, gold_ix long, pred_ix long, iou double, s long, e long, ps long, pe long")
    gold, pred, want = set(), set(), set()
    for i, g, p in sorted(((r[3], r[1], r[2]) for r in rows), reverse=True):
        if g not in gold and p not in pred:
            gold.add(g)
            pred.add(p)
            want.add((g, p, i))
    got = score.greedy_match(cands)
    assert {(r.gold_ix, r.pred_ix, r.iou) for r in got.collect()} == want
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and "Pandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_chain_is_decided_pair_by_pair(spark):
    """Every pair but the first waits for the one before: as many rounds as it takes."""
    rows = [("b", i // 2, (i + 1) // 2, 0.9 - i / 100, 0, 1, 0, 1) for i in range(9)]
    cands = spark.createDataFrame(rows, "doc_id string, gold_ix long, pred_ix long, iou double, s long, e long, ps long, pe long")
    assert sorted((r.gold_ix, r.pred_ix) for r in score.greedy_match(cands).collect()) == [(i, i) for i in range(5)]
    assert score.greedy_match(cands.limit(0)).count() == 0


def dense_offsets(s, e, anchor_s, anchor_e):
    """All offsets at every span."""
    lengths, votes = anchor_e - anchor_s, []
    for a, b in zip(s, e, strict=True):
        off = anchor_s[np.abs(lengths - (b - a)) <= 1] - a
        votes.append(np.unique(off[np.abs(off) <= clean.REACH]))
    states = np.unique(np.concatenate([[0], *votes]))
    total, back = np.zeros(len(states)), []
    for v in votes:
        best = int(total.argmin())
        moved = total > total[best] + clean.SWITCH_COST
        back.append(np.where(moved, best, np.arange(len(states))))
        total = np.minimum(total, total[best] + clean.SWITCH_COST) + ~np.isin(states, v)
    at, out = int(total.argmin()), []
    for step in reversed(back):
        out.append(states[at])
        at = step[at]
    return np.array(out[::-1], np.int64)


def test_sparse_offsets_are_those_of_all_states(monkeypatch):
    rng = random.Random(4)
    for _ in range(1500):
        monkeypatch.setattr(clean, "REACH", rng.choice([50_000, 25]))
        n, size = rng.randint(1, 40), rng.choice([30, 100, 2000])
        s = np.array(sorted(rng.randrange(size * 10) for _ in range(n)), np.int64)
        e = s + np.array([rng.randint(5, 9) for _ in range(n)], np.int64)
        shift = rng.choice([0, 7, -12])
        a = [int(x) + (shift if rng.random() < 0.6 else rng.choice([0, 3, -5, rng.randint(-50, 50)])) for x in s if rng.random() < 0.8]
        a = np.array(a + [rng.randrange(size * 10) for _ in range(rng.randint(0, 30))], np.int64)
        b = a + np.array([rng.randint(5, 9) for _ in a], np.int64)
        assert (dense_offsets(s, e, a, b) == clean.choose_offsets(s, e, a, b)).all()
    assert len(clean.choose_offsets(*[np.array([], np.int64)] * 4)) == 0


def test_cost_is_linear_in_votes():
    def took(n):
        rng = np.random.default_rng(0)
        s = np.sort(rng.integers(0, 500 * n, n))
        e = s + rng.integers(10, 200, n)
        a = rng.integers(0, 500 * n, 5 * n)
        start = time.process_time()
        clean.choose_offsets(s, e, a, a + rng.integers(10, 200, 5 * n))
        return time.process_time() - start

    small = max(took(5_000), 0.05)
    assert took(40_000) < 8 * small * 3  # 40,000 spans and 200,000 anchors; all states at every span would be 64 times
