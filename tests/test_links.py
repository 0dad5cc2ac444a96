"""Links of books without the pairs that don't link, against all pairs."""

from __future__ import annotations

import random

import pytest
from spanloom.operators import groups, sharing


def made(spark, seed):
    """Needles and holders in which few texts are common; some books own a text twice, some texts are held but not owned."""
    r = random.Random(seed)
    weights = [1 / (i + 1) for i in range(60)]
    needles, holders = [], set()
    for b in range(80):
        for k, i in enumerate(r.choices(range(60), weights, k=r.choice([0, 1, 2, 4, 12, 25]))):
            needles.append((b, k, f"t{i:02}", 40 + i * r.choice([1, 1, 3])))
            holders.add((f"t{i:02}", b))
        holders |= {(f"t{i:02}", b) for i in r.choices(range(60), weights, k=2)}
    return spark.createDataFrame(needles, "doc_id long, needle_id long, nd string, len int"), spark.createDataFrame(sorted(holders), "nd string, other long")


@pytest.mark.parametrize("seed", [1, 2])
def test_links_equal_those_of_all_pairs(spark, seed):
    needles, holders = made(spark, seed)
    found = sharing.expand(needles, holders)
    assert found.count() == found.distinct().count()
    shares = sharing.pair_share(found, needles)
    rows = lambda df: sorted(tuple(x) for x in df.select("a", "b", "chars", "n_shared", "share").collect())
    assert rows(sharing.shares_of(needles, holders)) == rows(shares)
    for rule in ("split", "audit"):
        got = sharing.linking_shares(needles, holders, rule)
        assert 0 < got.count() < shares.count()
        assert rows(got) == rows(shares.filter(sharing._linked(shares.n_shared, shares.share, rule)))
    pairs = lambda df: {tuple(x) for x in df.collect()}
    audit = sharing.linking_shares(needles, holders, "audit")
    assert pairs(sharing.boilerplate_links(audit, sharing.link_books(shares))) == pairs(sharing.boilerplate_links(shares))
    one = sharing.one_match(needles, holders)
    assert pairs(one.select("doc_id", "needle_id")) == pairs(found.select("doc_id", "needle_id")) and one.subtract(found).count() == 0
    assert pairs(sharing.holding_books(needles, holders)) == pairs(found.select("other"))


def test_a_common_line_makes_no_pairs(spark, monkeypatch):
    """300 books share one line each, and two of them another: the pairs written down are those of the other line."""
    needles = [(b, 0, "common", 50) for b in range(300)] + [(b, 1, "other", 60) for b in (7, 9)]
    needles = spark.createDataFrame(needles, "doc_id long, needle_id long, nd string, len int")
    written = []
    stage = sharing.stage
    monkeypatch.setattr(sharing, "stage", lambda df: written.append(stage(df)) or written[-1])
    links = sharing.link_books(sharing.linking_shares(needles, needles.selectExpr("nd", "doc_id AS other")))
    assert [tuple(x) for x in links.collect()] == [(7, 9)]
    assert max(df.count() for df in written) <= 302


def test_link_sets_against_sets(spark):
    needles, holders = made(spark, 3)
    found = sharing.expand(needles, holders)
    links = sharing.link_books(sharing.shares_of(needles, holders)).union(spark.createDataFrame([(1000, 1001)], "a long, b long"))
    splits = spark.createDataFrame([(b, "train") for b in range(0, 90, 3)], "doc_id long, split string")
    way = {(x.doc_id, x.other) for x in found.collect()}
    pair, link = {(min(p), max(p)) for p in way}, {(x.a, x.b) for x in links.collect()}
    want = {("difference", *p) for p in link - pair} | {("not_linked", *p) for p in pair - link} | {("both_ways", a, b) for a, b in way if a < b and (b, a) in way}
    want |= {("held", b, None) for b in range(0, 90, 3) if b in {y for _, y in way}}
    for holding in (None, sharing.holding_books(needles, holders)):
        got = [tuple(x) for x in groups.link_sets(links, found, splits, holding=holding).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("seed", [1, 4])
def test_connecting_links_connect_the_same_books(spark, seed):
    needles, holders = made(spark, seed)
    books = spark.createDataFrame([(b,) for b in range(80)], "doc_id long")
    rows = lambda df: sorted(tuple(x) for x in df.collect())
    for rule in ("split", "audit"):
        all_links = sharing.link_books(sharing.linking_shares(needles, holders, rule), rule)
        assert rows(groups.connected_groups(books, sharing.connecting_links(needles, holders, rule))) == rows(groups.connected_groups(books, all_links))


def test_a_line_that_links_alone_makes_a_star(spark):
    """100 books hold a line, twice each: 4,950 links, that 99 pairs connect."""
    needles = spark.createDataFrame([(b, k, "twice", 50) for b in range(100) for k in (0, 1)] + [(200, 0, "own", 50)], "doc_id long, needle_id long, nd string, len int")
    holders = needles.selectExpr("nd", "doc_id AS other").distinct()
    assert sharing.link_books(sharing.linking_shares(needles, holders)).count() == 4950
    assert sorted(tuple(x) for x in sharing.connecting_links(needles, holders).collect()) == [(0, b) for b in range(1, 100)]


@pytest.mark.parametrize("wide", [64, 2, 0])
def test_linked_books_are_the_links_of_all_pairs(spark, monkeypatch, wide):
    monkeypatch.setattr(sharing, "WIDE", wide)
    monkeypatch.setattr(sharing, "PART", 7)
    needles, holders = made(spark, 5 + wide)
    splits = {b: "ab"[b % 2] for b in range(0, 80, 3)}
    ends = spark.createDataFrame(list(splits.items()), "doc_id long, split string")
    shares = sharing.shares_of(needles, holders)
    for rule in ("split", "audit"):
        want = {(x.a, x.b, splits.get(x.a), splits.get(x.b)) for x in sharing.link_books(shares, rule).collect()}
        got = [tuple(x) for x in sharing.linked_books(needles, holders, rule, ends=ends).select("a", "b", "split_a", "split_b").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_pairs_that_one_text_links_are_not_written_or_dealt_out(spark, monkeypatch):
    """300 books hold a line, twice each: 44,850 links, of which none is in a staged table or goes through a shuffle."""
    needles = spark.createDataFrame([(b, k, "twice", 50) for b in range(300) for k in (0, 1)], "doc_id long, needle_id long, nd string, len int")
    holders = needles.selectExpr("nd", "doc_id AS other").distinct()
    written = []
    stage = sharing.stage
    monkeypatch.setattr(sharing, "stage", lambda df: written.append(stage(df)) or written[-1])
    for rule in ("split", "audit"):
        assert sharing.linked_books(needles, holders, rule).count() == 44_850
    assert max(df.count() for df in written) <= 300


def test_matches_of_a_common_text_are_made_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharing, "PART", 10)
    needles = spark.createDataFrame([(b, 0, "common", 50) for b in range(100)] + [(1, 1, "own", 50)], "doc_id long, needle_id long, nd string, len int")
    holders = needles.selectExpr("nd", "doc_id AS other")
    got = [tuple(x) for x in sharing.expand(needles, holders).collect()]
    assert len(got) == 9900 and set(got) == {(a, 0, b) for a in range(100) for b in range(100) if a != b}
