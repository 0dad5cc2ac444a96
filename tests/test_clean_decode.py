"""Cleaning, masks, constrained decoding and prediction against plain versions of their rules."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import clean as C
from spanloom.operators import decode as V
from spanloom.plans.latin import LATIN


def cheapest_offsets(spans, anchors):
    """All sequences of allowed offsets: 1 for a span without a vote, 3 for a change; ties by the rule of the lowest offsets."""
    votes = [{a - s for a, b in anchors if abs((b - a) - (e - s)) <= 1 and abs(a - s) <= C.REACH} for s, e in spans]
    states = sorted({0}.union(*votes))
    cost = lambda p: sum(o not in v for o, v in zip(p, votes, strict=True)) + 3 * sum(a != b for a, b in itertools.pairwise(p))
    return min(cost(p) for p in itertools.product(states, repeat=len(spans))), cost


def test_offsets_cost_least():
    r = random.Random(5)
    for _ in range(60):
        spans = sorted((s, s + r.randint(3, 6)) for s in r.sample(range(0, 60, 7), r.randint(1, 5)))
        anchors = [(s + r.choice([0, 4, 4, 9]) + r.choice([0, 0, 1]), 0) for s, _ in spans if r.random() < 0.8]
        anchors = [(a, a + r.randint(3, 6)) for a, _ in anchors]
        best, cost = cheapest_offsets(spans, anchors)
        got = C.choose_offsets(*(np.array(x, np.int64) for x in ([s for s, _ in spans], [e for _, e in spans], [a for a, _ in anchors], [b for _, b in anchors])))
        assert cost(tuple(got.tolist())) == best


def heading(text, s, e):
    seg, before, after = text[s:e], text[max(0, s - 3) : s], text[e : e + 6]
    head, tail = text[max(0, s - 2) : e][:14], text[max(s, e - 4) : e + 2]
    starts = s == 0 or before.endswith("\n") or re.fullmatch("[# ]*", before) or before.endswith("\n# ")
    alone = starts and re.match(r"[. \t\xa0]*(\n|\Z)", after)
    return any(o in head for o in LATIN.ordinals) or LATIN.particle in tail or re.search(LATIN.numbered, seg) is not None or bool(alone)


def snapped(text, s, e):
    edge = lambda i: 0 <= i < len(text) and text[i] in LATIN.boundary
    acts, ns, ne = [], s, e
    if s > 0 and s < len(text) and not edge(s - 1) and not edge(s):
        k = next((k for k in (1, 2, 3) if s - k == 0 or (s - k > 0 and edge(s - k - 1))), None)
        acts.append(f"start-{k}" if k else "start_unfixed")
        ns -= k or 0
    if e < len(text) and not edge(e - 1) and not edge(e):
        k = next((k for k in (1, 2, 3) if e + k >= len(text) or edge(e + k)), None)
        acts.append(f"end+{k}" if k else "end_unfixed")
        ne += k or 0
    return ns, ne, "|".join(acts)


def brute_clean(text, spans):
    """Sidecar rows and verdict of a book, rule by rule."""
    rate = lambda xs: sum(heading(text, s, e) for s, e in xs) / len(xs) if xs else 0.0
    spans = sorted(spans)
    raw = rate(spans)
    offsets = [0] * len(spans)
    realigned = False
    if raw < 0.6:
        marks = [m.span() for m in re.finditer(LATIN.anchor, text)]
        tried = C.choose_offsets(*(np.array(x, np.int64) for x in ([s for s, _ in spans], [e for _, e in spans], [a for a, _ in marks], [b for _, b in marks]))).tolist()
        moved = [(s + o, e + o) for (s, e), o in zip(spans, tried, strict=True)]
        inside = all(s >= 0 and e <= len(text) for s, e in moved)
        if inside and rate(moved) >= 0.6 and rate(moved) - raw >= 0.2:
            realigned, offsets = True, tried
    used = rate([(s + o, e + o) for (s, e), o in zip(spans, offsets, strict=True)])
    excluded = used < 0.3
    rows = []
    for (s, e), o in zip(spans, offsets, strict=True):
        ns, ne, act = snapped(text, s + o, e + o)
        bad = realigned and act != "" and not heading(text, ns, ne)
        rows.append([s, e, ns, ne, excluded or bad])
    kept = sorted(r for r in rows if not r[4])
    kept.sort(key=lambda r: (r[2], r[3]))
    for a, b in itertools.pairwise(kept):
        a[3] = min(a[3], b[2])
    return sorted(map(tuple, rows)), (round(raw, 3), realigned, "exclude" if excluded else "realigned" if realigned else "keep")


def test_cleaning_of_whole_books(spark):
    r = random.Random(11)
    books, spans, want_rows, want_books = [], [], {}, {}
    for b in range(14):
        sentences = []
        for i in range(14):
            start = r.choice(["The", "And", "Der", "La", "xo", "yy"]) if b % 3 else r.choice(["The", "Die"])
            sentences.append(start + " " + " ".join("".join(r.choice("abcdef") for _ in range(r.randint(3, 9))) for _ in range(r.randint(2, 4))) + r.choice([" station", " form", " nation"]) + ".")
        text = " ".join(sentences)
        own, at = [], 0
        for i, x in enumerate(sentences):
            own.append((at, at + len(x) - 1))
            at += len(x) + 1
        shift = {0: 12, 1: 0, 2: 1, 3: 7}[b % 4]
        moved = [(s + shift, e + shift) for i, (s, e) in enumerate(own) if i % 2 == 0 and e + shift <= len(text)]
        books.append((b, "old" if b % 2 else "new", len(text), text))
        spans += [(b, i, s, e) for i, (s, e) in enumerate(moved)]
        want_rows[b], want_books[b] = brute_clean(text, moved)
    df = spark.createDataFrame(books, "doc_id long, batch string, n_chars long, text string")
    sidecar, verdicts = C.clean_spans(df, spark.createDataFrame(spans, "doc_id long, ident int, s long, e long"), LATIN)
    got: dict = {}
    for x in sidecar.collect():
        got.setdefault(x.doc_id, []).append((x.raw_s, x.raw_e, x.s, x.e, x.dropped))
    assert {b: sorted(v) for b, v in got.items()} == want_rows
    rows = verdicts.collect()
    assert {x.doc_id: (x.heading_rate_raw, x.realigned, x.verdict) for x in rows} == want_books
    assert len({v for *_, v in want_books.values()}) >= 2
    totals = C.clean_totals(sidecar).first()
    assert totals.n_spans == len(spans) and totals.dropped_unverified == sum(x.reason == "realigned_span_unverified" for x in sidecar.collect())
    counted = {(x.batch, x.verdict): x.n for x in C.verdict_counts(verdicts).collect()}
    assert sum(counted.values()) == len(books)
    out = {x.doc_id for x in C.excluded_books(verdicts, spark.createDataFrame([(1, 0.1)], "doc_id long, recall double")).collect()}
    assert out == {b for b, v in want_books.items() if v[2] == "exclude"} | {1}


def test_particle_mask_by_characters(spark):
    r = random.Random(6)
    closers = ("aba", "ab", "ba", "c")
    rows = [(i, ["".join(r.choice("abc") for _ in range(r.randint(0, 3))) for _ in range(r.randint(0, 12))]) for i in range(40)]
    got = {x.i: x["mask"] for x in V.particle_mask(spark.createDataFrame(rows, "i int, pieces array<string>"), closers).collect()}
    for i, parts in rows:
        text, covered = "".join(parts), set()
        for c in sorted(closers, key=len, reverse=True):
            for k in range(len(text) - len(c) + 1):
                if text[k : k + len(c)] == c and not covered & set(range(k, k + len(c))):
                    covered |= set(range(k, k + len(c)))
        at, want = 0, []
        for p in parts:
            want.append(bool(covered & set(range(at, at + len(p)))))
            at += len(p)
        assert got[i] == want


def best_score(scores, penalty):
    legal = [p for p in itertools.product(range(3), repeat=len(scores)) if p[0] != 2 and all(not (a == 0 and b == 2) for a, b in itertools.pairwise(p))]
    value = lambda p: sum(scores[i][x] for i, x in enumerate(p)) - penalty * sum(a in (1, 2) and b != 2 for a, b in itertools.pairwise(p))
    return max(value(p) for p in legal), value


def test_constrained_decoding_and_batches(spark, monkeypatch):
    monkeypatch.setattr(V, "CELLS", 20)
    r = random.Random(8)
    rows = []
    for i in range(30):
        n = r.randint(0, 6)
        rows.append((i, [[float(r.randint(0, 9)) for _ in range(3)] for _ in range(n)], [r.random() < 0.4 for _ in range(n)]))
    rows.append((99, None, None))
    df = spark.createDataFrame(rows, "i int, logits array<array<double>>, mask array<boolean>")
    free = {(x.i, x.penalty): x.path for x in V.viterbi_decode(df.drop("mask"), [0.0, 2.0]).collect()}
    barred = {x.i: x.path for x in V.constrained_decode(df, 2.0).collect()}
    for i, logits, mask in rows:
        if not logits:
            assert free[i, 2.0] == barred[i] == []
            continue
        for p in (0.0, 2.0):
            best, value = best_score(logits, p)
            assert value(free[i, p]) == best
        shut = [[x[0], -1e9, -1e9] if m else x for x, m in zip(logits, mask, strict=True)]
        best, value = best_score(shut, 2.0)
        assert value(barred[i]) == pytest.approx(best)
        assert all(not m or x == 0 for x, m in zip(barred[i], mask, strict=True))


def test_prediction_of_whole_books(spark):
    from spanloom.operators.dataset import regex_tokenizer

    def scorer():  # of this function, so that tasks need no test module
        return lambda ids: np.array([[2.0, 5.0 if i % 5 == 0 else 0.0, 3.0 if i % 3 else 0.0] for i in ids]).reshape(-1, 3)

    texts = {1: "one two three four five six seven eight", 2: "", 3: "a bb ccc dddd eeeee ffffff", 4: None}
    books = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got: dict = {}
    for x in V.predict_spans(books, scorer, penalty=1.0, content=4, stride=2).collect():
        got.setdefault(x.doc_id, []).append((x.s, x.e))
    for b, text in texts.items():
        ids, offsets = [x[0] for x in regex_tokenizer(text or "")], [x[1:] for x in regex_tokenizer(text or "")]
        n = len(ids)
        starts = [] if n == 0 else [0] if n <= 4 else [*range(0, n - 4, 2), n - 4]
        found = set()
        spans = []
        for w in dict.fromkeys(starts):
            part = ids[w : w + 4]
            best, value = best_score(scorer()(part).tolist(), 1.0)
            path = min((p for p in itertools.product(range(3), repeat=len(part)) if p[0] != 2 and all(not (x == 0 and y == 2) for x, y in itertools.pairwise(p)) and value(p) == best))
            at = None
            for i, x in enumerate([*path, 0]):
                if at is not None and x != 2:
                    spans.append((offsets[w + at][0], offsets[w + i - 1][1]))
                    at = None
                if x == 1:
                    at = i
        kept = []
        for s, e in sorted(spans):
            if all(max(0, min(e, d) - max(s, c)) / ((e - s) + (d - c) - max(0, min(e, d) - max(s, c))) < 0.5 for c, d in kept):
                kept.append((s, e))
        found = set(kept)
        assert set(got.get(b, [])) == found, b


def test_dump_to_book_spans_and_alignment(spark):
    tokens = spark.createDataFrame([(1, i, i * 10, i * 10 + (0 if i == 2 else 7)) for i in range(8)], "doc_id long, tok_ix long, s long, e long")
    windows = spark.createDataFrame([(1, 0, 0, 4, 0), (1, 1, 2, 6, 30)], "doc_id long, window_index long, token_start long, token_end long, char_start long")
    spans = spark.createDataFrame([(1, 0, 1, 3), (1, 0, 3, 4), (1, 1, 1, 2), (1, 1, 3, 4)], "doc_id long, window_index long, s long, e long")
    got = sorted((x.s, x.e) for x in V.dump_to_book_spans(spans, windows, tokens).collect())
    assert got == [(10, 20), (30, 37), (50, 57)]
    bad = windows.withColumn("char_start", F.col("char_start") + F.col("window_index"))
    with pytest.raises(Exception, match="window out of line"):
        V.check_window_alignment(bad, tokens).collect()
