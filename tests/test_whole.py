"""Queries that must not leave out a part of their input, against brute force on a small table."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanloom.plans.latin import LATIN
from spanloom.operators import clean, sharing
from spanloom.operators.audit import heading_rates
from spanloom.operators.spans import attach_text
from spanloom.plans import registry
from spanloom.plans.fixtures import Tables

COPIED = "The common line of many books goes on and on without any end in sight"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = []
    for i in range(24):
        own = [f"The {'abcdefghijklmnopqrstuvwx'[i]}{j} river flows along the {j * 7 + i} stones and goes on to the sea" for j in range(8)]
        if i % 10 == 3:  # no headings: a low rate without a shift
            own = [f"zzzz{j} kkkkk mmmm ppppp rrrr{i} bbbbb zzzz" for j in range(8)]
        own[i % 5] = COPIED
        own[5:5] = ["stock phrase one two", "stock phrase one two", "ab cdefghijklmnopq", "unbrokenwordoftwentyfive"]
        text = ". ".join(own) + "."
        rows.append((i, text, "en", f"s{i}", len(text)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(24) if i % 6], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def spans(df):
    return [(r.doc_id, r.seg_idx, r.s, r.e) for r in df.collect()]


def test_realign_offsets_takes_every_low_book(spark, folder):
    t = Tables(spark, folder)
    texts = {r.doc_id: r.text for r in t.texts().collect()}
    rates = {r.doc_id: r.heading_rate for r in heading_rates(attach_text(t.raw().select("doc_id", "seg_idx", "s", "e"), t.texts()), LATIN).collect()}
    own = defaultdict(list)
    for d, _, s, e in spans(t.raw()):
        own[d].append((s, e))
    want = set()
    for d in own:
        if rates[d] < clean.MIN_HEADING:
            found = [m.span() for m in re.finditer(LATIN.anchor, texts[d])]
            s, e = np.array(sorted(own[d])).T
            a, b = np.array(found, np.int64).reshape(-1, 2).T
            want |= {(d, int(x), int(y), int(o)) for x, y, o in zip(s, e, clean.choose_offsets(s, e, a, b), strict=True)}
    got = {(r.doc_id, r.s, r.e, r.offset) for r in registry.queries()["realign_offsets"](spark, folder).collect()}
    assert got == want and any(d % 10 for d, *_ in got)


def test_book_profile_counts_repeated_long_spans(spark, folder):
    t = Tables(spark, folder)
    texts = {r.doc_id: r.text for r in t.texts().collect()}
    want = Counter()
    for d, _, s, e in spans(t.gold()):
        seg = texts[d][s:e]
        want[d] += e - s >= 40 and len([x for x in re.split(r"[ \n.,!]+", seg) if x]) >= 8 and any(seg in x for o, x in texts.items() if o != d)
    got = {r.doc_id: r.n_long_repeated for r in registry.queries()["book_profile"](spark, folder).collect()}
    assert got == dict(want) and any(got.values())


def test_leakage_by_spread_takes_spans_of_any_length(spark, folder):
    t = Tables(spark, folder)
    texts = {r.doc_id: r.text for r in t.texts().collect()}
    splits = {r.doc_id: r.split for r in t.prior().collect()}

    def brute(rows):
        want = defaultdict(lambda: [0, 0])
        for d, _, s, e in rows:
            if splits.get(d) == "test":
                c = sum(texts[d][s:e] in x for o, x in texts.items() if splits.get(o) == "train")
                cell = want["0" if not c else "1-2" if c <= 2 else "3-9" if c <= 9 else "10+"]
                cell[0] += 1
                cell[1] += e - s < 15
        return dict(want)

    read = lambda df: {r.spread: [r.n, r.n_short] for r in df.collect()}
    assert read(registry.queries()["leakage_by_spread"](spark, folder)) == brute(spans(t.gold()))
    # any place and length: parts of words, one and two syllables, separators
    some = [(d, i, 11 * i % 400, 11 * i % 400 + 1 + i % 37) for d in (10, 20) for i in range(90)]
    got = sharing.leakage_by_spread(spark.createDataFrame(some, "doc_id long, seg_idx long, s long, e long"), t.texts(), t.prior())
    assert read(got) == brute(some)
