"""Phrase mining against counting by dictionaries, with budgets that make words and pairs heavy."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.llm import phrases


def brute(rows, least=10, top=2000):
    pieces = {}
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        pieces.setdefault("und" if lang is None else lang, []).extend(re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n-\r]", low))
    out = []
    for lang, own in pieces.items():
        f = Counter(tuple(p[i : i + k]) for p in own for k in (1, 2, 3) for i in range(len(p) - k + 1))
        n = sum(len(p) for p in own)
        found = {c: a for c, a in f.items() if len(c) > 1 and a >= least}
        best = []
        for c, a in found.items():
            if any(len(x) > len(c) and 100 * b >= 50 * a and any(x[i : i + len(c)] == c for i in range(2)) for x, b in found.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[c[:k]] * f[c[k:]]), k) for k in range(1, len(c)))
            best.append((-score, -a, " ".join(c).encode(), (lang, " ".join(c), a, f[c[:k]], f[c[k:]], n, score)))
        out += [(x[3][0], i, *x[3][1:]) for i, x in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def corpus(seed, size=400):
    rng = random.Random(seed)
    words = ["the", "of", "And", "é", "ß-x", "a\x00b", "x|y", "z"] + [f"w{i}" for i in range(40)]
    weight = [30, 20, 10, 5, 5, 3, 3, 3] + [1] * 40
    rows = []
    for i in range(size):
        text = "".join(rng.choices(words, weight)[0] + rng.choice([" "] * 8 + [". ", "\t", "  ", ",", "\n", "\r\n"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "fr", None, "und", "odd\tname"]), text))
    return [*rows, ("en", None), (None, ""), ("en", "of the end " * 300), *[("fr", "same passage of words, again")] * 60]


@pytest.mark.parametrize("budget", [250_000, 300, 40])
def test_against_dictionaries(spark, budget):
    rows = corpus(budget)
    docs = spark.createDataFrame([(i, t, lang, "x") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, leaf string").repartition(5)
    got = phrases.mine(docs, group_suffixes=budget)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows)
    assert want and sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, phrases.mine(docs, top=3, group_suffixes=budget).collect())) == brute(rows, top=3)


def test_heavy_words_are_extended(spark):
    docs = spark.createDataFrame([(lang, t) for lang, t in corpus(1)], "lang string, text string").selectExpr("coalesce(lang, 'und') AS lang", "text")
    words = docs.mapInArrow(phrases._word_counts, "lang string, word string, h bigint, n bigint").groupBy("lang", "word").agg(F.min("h").alias("h"), F.sum("n").alias("n"))
    part = phrases.vertical_partition(words, 10, 40)
    assert b"the" in part.heavy["en"] and len(part.cuts) > 10
    assert phrases.vertical_partition(words, 10, 10**6).heavy == {}


def test_long_texts_are_cut_at_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 50)
    texts = [b"one two. three four, five " * 20, b"no end here " * 30, b"", b"."]
    parts = list(phrases._chunks(texts))
    whole = [p for t in texts for p in t.translate(phrases._TABLE).split(b"\xff") if p.strip()]
    assert [p for c in parts for p in c.split(b"\xff") if p.strip()] == whole and len(parts) > 5


def test_nothing_to_find(spark):
    docs = spark.createDataFrame([("en", "a b c")] * 9, "lang string, text string")
    assert phrases.mine(docs).count() == 0 and phrases.mine(docs.limit(0)).count() == 0
    # ties: equal scores and counts go by the phrase's bytes
    tied = spark.createDataFrame([("en", "b c. é f. Z y.")] * 10, "lang string, text string")
    assert [(r.rank, r.phrase, r.score) for r in phrases.mine(tied).orderBy("rank").collect()] == [(1, "b c", 10**6), (2, "z y", 10**6), (3, "é f", 10**6)]
