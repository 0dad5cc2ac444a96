"""Empty tables and null ids: every operator has a defined result and none fails."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanloom.operators import dataset, decode, groups, intervals, score, sharing
from spanloom.plans.latin import LATIN


@pytest.fixture(scope="module")
def spans(spark):
    return spark.createDataFrame([], "doc_id long, seg_idx long, ann_id string, gold_ix long, pred_ix long, s long, e long, batch string, layer string")


@pytest.fixture(scope="module")
def books(spark):
    return spark.createDataFrame([], "doc_id long, batch string, n_chars long, text string, weight long")


def test_empty_spans_and_books(spark, spans, books):
    two = spans.select("doc_id", "s", "e")
    splits = spark.createDataFrame([], "doc_id long, split string, group_id long")
    links = spark.createDataFrame([], "a long, b long")
    tokens = spark.createDataFrame([], "doc_id long, tok_ix long, s long, e long")
    needles = sharing.needles(spans, books, LATIN)
    found = sharing.verbatim_matches(needles, books, LATIN)
    empty = [
        intervals.merge_intervals(two, "doc_id"), intervals.next_span(two, "doc_id"), intervals.assert_no_overlap(two, "doc_id"),
        intervals.subtract_intervals(spans.select("doc_id", "ann_id", "s", "e"), two), intervals.overlap_layers(two, spans.select("doc_id", "layer", "s", "e")),
        needles, found, sharing.pair_share(found, needles), sharing.leakage_rate(needles, found, splits), sharing.anchors(books, None, LATIN),
        groups.connected_groups(books, links), groups.leak_aware_split(books, links, splits), groups.stratified_split(books, "n_chars"), groups.straddling_links(links, splits),
        dataset.tokenize(books.select("doc_id", "text")), dataset.label_rows(tokens, two), dataset.clause_table(books, LATIN),
        score.match_candidates(spans, spans), score.greedy_match(score.match_candidates(spans, spans)), score.dedupe_spans(two), score.score_spans(books, spans, spans),
        decode.token_to_char_spans(two, tokens),
    ]
    assert [df.count() for df in empty] == [0] * len(empty)


def test_null_ids_meet_nothing_and_stay_apart(spark):
    rows = [(None, 0, 5), (None, 3, 9), (1, 0, 5), (1, 5, 8), (1, 20, 30)]
    df = spark.createDataFrame(rows, "doc_id long, s long, e long")
    merged = {(r.doc_id, r.s, r.e) for r in intervals.merge_intervals(df, "doc_id").collect()}
    assert merged == {(None, 0, 9), (1, 0, 8), (1, 20, 30)}
    gold, pred = df.withColumn("gold_ix", F.col("s")), df.withColumn("pred_ix", F.col("s"))
    pairs = score.match_candidates(gold, pred)
    assert {(r.doc_id, r.gold_ix, r.pred_ix) for r in pairs.collect()} == {(1, 0, 0), (1, 5, 5), (1, 20, 20)}
    books = spark.createDataFrame([(None, 3), (1, 4), (2, 9), (2, 9)], "doc_id long, n_chars long")
    assert {r.doc_id for r in groups.stratified_split(books, "n_chars").collect()} == {None, 1, 2}
    texts = spark.createDataFrame([(None, "a b"), (1, None), (2, "")], "doc_id long, text string")
    assert {(r.doc_id, len(r.ids)) for r in dataset.tokenize(texts).collect()} == {(None, 2), (1, 0), (2, 0)}
