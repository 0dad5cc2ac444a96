"""The multi-pattern search against plain containment."""

from __future__ import annotations

import random

from spanloom.operators import search, sharing
from spanloom.plans.latin import LATIN


def test_holders_against_containment(spark):
    rng = random.Random(2)
    letters = "abc den\n𝔘é."
    texts = {i: "".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 200, 9000]))) for i in range(40)}
    texts[40], texts[41] = None, "x" * 10_000  # one text that every window of x's meets
    strings = {"x" * 17, "x" * 5000, "x" * 10_001, "a", "𝔘", "qq", ""}
    for t in list(texts.values()):
        for n in (1, 2, 5, 12, 13, 15, 16, 31, 32, 33, 100, 4096, 5000, 8999):
            if t and len(t) >= n:
                at = rng.choice([0, len(t) - n, rng.randrange(len(t) - n + 1)])
                strings |= {t[at : at + n], t[at : at + n - 1] + "z"}
    rows = spark.createDataFrame([(s,) for s in [*strings, *list(strings)[:50]]], "nd string")
    books = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {(s, b) for s in strings if s for b, t in texts.items() if t and s in t}
    got = [tuple(r) for r in search.holders(rows, books).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert search.holders(rows.limit(0), books).count() == 0 and search.holders(rows, books.limit(0)).count() == 0


def test_more_windows_than_are_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([("hello wor",), ("ello world, this is a long string that goes on",), ("no",)], "nd string")
    books = spark.createDataFrame([("a", "hello world"), ("b", "say: hello world, this is a long string that goes on and on")], "doc_id string, text string")
    want = {("hello wor", "a"), ("hello wor", "b"), ("ello world, this is a long string that goes on", "b")}
    assert {tuple(r) for r in search.holders(rows, books).collect()} == want
    monkeypatch.setattr(search, "MAX_BROADCAST_KEYS", 0)
    assert {tuple(r) for r in search.holders(rows, books).collect()} == want


def test_a_hot_book_is_many_tasks(spark):
    """Thousands of needles in one long book: no row of the plan holds them, or the book, together."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(60_000)]
    hot = " ".join(words)
    needles = [" ".join(words[i : i + 9]) for i in range(0, 50_000, 10)]
    rows = spark.createDataFrame([(1, i, n, len(n), n.split()) for i, n in enumerate(needles)], "doc_id long, needle_id long, nd string, len int, syl array<string>")
    books = spark.createDataFrame([(0, hot), (1, " ".join(needles[:100])), (2, "nothing")], "doc_id long, text string")
    found = sharing.verbatim_matches(rows, books, LATIN)
    assert found.count() == len(needles) and found.filter("other <> 0").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(nd" not in plan and "collect_list(struct(nd" not in plan


def test_one_scan_for_all_widths(spark):
    rows = spark.createDataFrame([("x" * n,) for n in (1, 3, 9, 14, 20, 50)], "nd string")
    books = spark.createDataFrame([(1, "x" * 30)], "doc_id long, text string")
    calls = []
    scan = search._scan
    try:
        search._scan = lambda shared: calls.append(1) or scan(shared)
        assert {len(r.nd) for r in search.holders(rows, books).collect()} == {1, 3, 9, 14, 20}
    finally:
        search._scan = scan
    assert len(calls) == 1


def test_few_other_windows_pass_the_bitmap(spark, monkeypatch):
    """More windows than are broadcast: what leaves the scan to meet them is not all windows of the texts."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghijkl") for _ in range(20_000)) for _ in range(4)]
    rows = spark.createDataFrame([(t[i : i + 50],) for t in texts[:2] for i in range(0, 5000, 50)], "nd string")
    books = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(search, "MAX_BROADCAST_KEYS", 0)
    seen = []
    scan = search._scan

    def counted(shared):
        run = scan(shared)

        def both(batches):
            for b in run(batches):
                assert b.num_rows < 1000, "nearly all windows leave the scan"
                yield b

        seen.append(1)
        return both

    monkeypatch.setattr(search, "_scan", counted)
    assert search.holders(rows, books).count() == 200 and seen


def test_strings_are_not_dealt_out_with_their_places(spark):
    """Places and holders carry a digest of 16 bytes; the string itself meets them at the end."""
    rows = spark.createDataFrame([("hello world, this is a long string that goes on",)], "nd string")
    books = spark.createDataFrame([(1, "say: hello world, this is a long string that goes on and on")], "doc_id long, text string")
    found = search.held_keys(rows, books)
    assert found.columns == ["key", "other"] and len(found.first().key) == 16
