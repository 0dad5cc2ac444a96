"""Rules that are easy to get wrong, on small tables."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions.profiles import TIBETAN
from spanloom.operators import checks, clean, dataset, decode, groups, intervals, score
from spanloom.operators.quantile import exclusive_quantiles
from spanloom.operators.spans import attach_text


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_attach_text_over_chunks_and_wide_characters(spark):
    text = "ab\U0001f600" + "x" * 20 + "yz"
    books = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 2, 9), (1, 0, 3), (1, 20, 25)], "doc_id long, s long, e long")
    got = {(r.s, r.e): (r.before, r.seg, r.after) for r in attach_text(spans, books, context=2, size=4).collect()}
    assert got == {(s, e): (text[max(0, s - 2) : s], text[s:e], text[e : e + 2]) for s, e in got}


def test_snap_walks_to_text_ends_and_gives_up(spark):
    text = "ka་khaga་ngaaaaaa"
    books = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 5, 8), (1, 1, 3), (1, 9, 13)], "doc_id long, s long, e long")
    df = attach_text(spans, books)
    s, e, act = T.snap_edges(F.col("s"), F.col("e"), F.col("seg"), F.col("before"), F.col("after"), TIBETAN)
    got = {r.s: (r.s2, r.e2, r.act) for r in df.select("s", s.alias("s2"), e.alias("e2"), act.alias("act")).collect()}
    assert got == {5: (3, 8, "start-2"), 1: (0, 3, "start-1"), 9: (9, 13, "end_unfixed")}


def test_strip_ws_takes_no_break_spaces(spark):
    assert spark.range(1).select(T.strip_ws(F.lit("a\xa0b c\n"))).first()[0] == "abc"


def test_exclusive_quantiles(spark):
    df = spark.range(1, 102).select(F.lit("a").alias("k"), F.col("id").alias("v")).union(spark.range(100).select(F.lit("b"), "id"))
    got = {r.k: r.p10 for r in exclusive_quantiles(df, "k", "v", (10,)).collect()}
    assert got == {"a": pytest.approx(10.2), "b": None}


def test_windows_cover(spark):
    for n, length, step in [(0, 10, 5), (10, 10, 5), (11, 10, 5), (25, 10, 5), (26, 10, 7), (15, 10, 20), (40, 10, 12)]:
        got = [(w.s, w.e) for w in spark.range(1).select(dataset.sliding_windows(F.lit(n), length, step).alias("w")).first().w]
        want, start = [], 0
        if n <= length:
            want = [(0, n)] if n > 0 else []
        else:
            while start < n:
                want.append((start, min(start + length, n)))
                if want[-1][1] == n:
                    break
                start += step
                if start < n and start + length >= n:
                    want.append((n - length, n))
                    break
        assert got == list(dict.fromkeys(want)), (n, length, step)


def test_nested_spans_and_zero_width_tokens(spark):
    toks = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 2, 4), (1, 2, 4, 6), (1, 3, 6, 8), (1, 4, 8, 8), (1, 5, 8, 9)], "doc_id long, tok_ix long, s long, e long")
    spans = spark.createDataFrame([(1, 0, 9), (1, 2, 5)], "doc_id long, s long, e long")
    assert [x[1] for x in rows(dataset.label_rows(toks, spans), "tok_ix", "label")] == [1, 1, 2, 2, 0, 2]


def test_labels_convert(spark):
    df = spark.createDataFrame([([0, 1, 2, 2, 1, 0, -100],)], "l array<int>")
    got = df.select(T.convert_labels(F.col("l"), "io").alias("io"), T.convert_labels(F.col("l"), "bioe").alias("e")).first()
    assert got.io == [0, 1, 1, 1, 1, 0, -100] and got.e == [0, 1, 2, 3, 3, 0, -100]


@pytest.mark.parametrize("scheme", ["bio", "bioe", "multi"])
def test_viterbi_is_the_best_legal_path(scheme):
    rng = random.Random(1)
    k = decode.LABELS[scheme]
    step = decode.transitions(scheme, 2.0)
    closed = [x for _, i, e in decode.ENTITIES[scheme] for x in (i, e) if x is not None]
    for _ in range(20):
        n = rng.randint(1, 5)
        x = np.array([[rng.randint(0, 6) for _ in range(k)] for _ in range(n)], float)
        path = decode.best_paths(x[None], np.array([n]), scheme, 2.0)[0]
        value = lambda p: sum(x[i, v] for i, v in enumerate(p)) + sum(step[a, b] for a, b in itertools.pairwise(p)) + (decode.NEG if p[0] in closed else 0)
        assert value(path) == max(map(value, itertools.product(range(k), repeat=n)))


def test_orphan_inside_opens(spark):
    df = spark.createDataFrame([(1, [2, 2, 1, 1, 0, 2]), (2, [])], "id long, path array<int>")
    assert rows(decode.spans_from_labels(df), "s", "e") == [(0, 2), (2, 3), (3, 4), (5, 6)]


def test_greedy_ties_and_brute_force(spark):
    rng = random.Random(3)
    data, want = [], set()
    for b in range(30):
        gold = sorted({(s := rng.randint(0, 40), s + rng.randint(2, 12)) for _ in range(6)})
        pred = [(s := rng.randint(0, 40), s + rng.randint(2, 12)) for _ in range(8)]
        data += [("g", b, i, *x) for i, x in enumerate(gold)] + [("p", b, i, *x) for i, x in enumerate(pred)]
        iou = lambda x, y: max(0, min(x[1], y[1]) - max(x[0], y[0])) / (x[1] - x[0] + y[1] - y[0] - max(0, min(x[1], y[1]) - max(x[0], y[0])))
        cands = sorted(((iou(g, p), i, j) for i, g in enumerate(gold) for j, p in enumerate(pred) if iou(g, p) >= 0.3), reverse=True)
        ug, up = set(), set()
        for _, i, j in cands:
            if i not in ug and j not in up:
                ug.add(i)
                up.add(j)
                want.add((b, i, j))
    df = spark.createDataFrame(data, "k string, doc_id long, ix long, s long, e long")
    g, p = df.filter("k = 'g'").withColumnRenamed("ix", "gold_ix"), df.filter("k = 'p'").withColumnRenamed("ix", "pred_ix")
    got = score.greedy_match(score.match_candidates(g, p, 0.3))
    assert set(rows(got, "doc_id", "gold_ix", "pred_ix")) == want


def test_dedupe_chain_keeps_both_ends(spark):
    spans = spark.createDataFrame([(1, 0, 10), (1, 3, 13), (1, 6, 16)], "doc_id long, s long, e long")
    assert rows(score.dedupe_spans(spans), "s", "e") == [(0, 10), (6, 16)]


def test_subtract_split_clip_swallow(spark):
    low = spark.createDataFrame([(1, "a", 0, 10), (1, "b", 20, 30), (1, "c", 41, 44)], "doc_id long, ann_id string, s long, e long")
    high = spark.createDataFrame([(1, 3, 5), (1, 25, 32), (1, 40, 50)], "doc_id long, s long, e long")
    assert rows(intervals.subtract_intervals(low, high), "ann_id", "s", "e", "lost") == [("a", 0, 3, 2), ("a#1", 5, 10, 2), ("b", 20, 25, 5)]
    got = intervals.precedence_stats(high, low).first().asDict()
    assert got == {"quote_spans_in": 3, "quote_spans_touched": 3, "quote_spans_clipped": 2, "quote_spans_fragmented": 1, "quote_spans_dropped": 1, "quote_spans_out": 3, "chars_suppressed": 10}


def test_components_of_a_chain_and_fixed_splits(spark):
    books = spark.range(60).select(F.col("id").alias("doc_id"))
    links = spark.range(49).select((F.col("id") * 37 % 50).alias("a"), ((F.col("id") + 1) * 37 % 50).alias("b"))
    found = groups.connected_groups(books, links)
    assert rows(found.groupBy("group_id").count(), "group_id", "count")[0] == (0, 50)
    prior = spark.createDataFrame([(0, "train", 0), (7, "test", 7), (55, "val", 55)], "doc_id long, split string, group_id long")
    assert rows(groups.resolve_fixed_splits(found, prior), "group_id", "split", "n_splits") == [(0, "test", 2), (55, "val", 1)]


def test_offsets_follow_anchors():
    s = np.arange(0, 400, 40)
    e = s + np.array([11, 17, 23, 13, 19, 29, 31, 12, 16, 21])
    shift = np.array([5] * 6 + [9] * 4)
    got = clean.choose_offsets(s, e, s + shift, e + shift)
    assert (got == shift).all()
    assert (clean.choose_offsets(s, e, np.array([], int), np.array([], int)) == 0).all()


def test_checks_fail(spark):
    splits = spark.createDataFrame([(1, "train"), (2, "test")], "doc_id long, split string")
    assert checks.exclude_books(splits, splits.filter("doc_id = 1")).count() == 1
    for ids in ([2], [9], [1, 1]):
        with pytest.raises(Exception, match="excluded book"):
            checks.exclude_books(splits, spark.createDataFrame([(i,) for i in ids], "doc_id long")).collect()
    with pytest.raises(Exception, match="n is not 3"):
        checks.check_totals(splits, {"n": (F.count("*"), 3)}).collect()
    with pytest.raises(Exception, match="overlap"):
        intervals.assert_no_overlap(spark.createDataFrame([(1, 0, 5), (1, 4, 8)], "doc_id long, s long, e long"), "doc_id").collect()
