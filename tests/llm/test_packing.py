"""Packing: exact ids, gapless sequences, few of them; least squares against its optimality conditions."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from spanloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["'s", "'LL", "'", "<|endoftext|>", "<|", "|>", " ", "\n", "\x1c", "\x1f", "\x85", "\xa0", " ", "İ", "I", "ſ", "Σ", "ας", "ß", "É", "é", "é", "́", "½", "²", "日本", "한글", "가", "😀", "a", "B", "9", "_", "...", "ŉ", "ǅ", "ﬁ", "​", "﻿", "\x00", "\t", "µ", "º", "word"]


def test_ids_are_the_tokenizers_own():
    encoder = packing.Encoder(PATH)
    assert encoder.fast
    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    texts += [f"a{chr(c)}B" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    for t in texts:
        assert encoder.encode(t).tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def check(rows, size):
    """Every sequence is filled from 0 without gaps."""
    sequences = {}
    for length, sequence, offset in rows:
        sequences.setdefault(sequence, []).append((offset, length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


def expand(plan, counts):
    length, first_rank, per, first, offset = plan.arrays()
    rows = []
    for i in range(len(length)):
        end = first_rank[i + 1] if i + 1 < len(length) and length[i + 1] == length[i] else counts[length[i]]
        rows += [(int(length[i]), int(first[i] + k // per[i]), int(offset[i] + k % per[i] * length[i])) for k in range(int(end - first_rank[i]))]
    return rows


def first_fit(lengths, size):
    """Best-fit decreasing, one by one."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(size - n)
    return len(rooms)


@pytest.mark.parametrize("kind", ["mixed", "long", "short", "one", "hot", "none"])
def test_plan(kind):
    rng = random.Random(kind)
    size, width = 256, 16
    lengths = {
        "mixed": [min(size, max(1, int(rng.lognormvariate(4, 1)))) for _ in range(1500)], "long": [rng.randint(129, 256) for _ in range(300)], "short": [rng.randint(1, 9) for _ in range(900)],
        "one": [100] * 501, "hot": [90] * 400 + [rng.randint(1, 256) for _ in range(400)], "none": [],
    }[kind]
    counts = np.bincount(np.array(lengths, np.int64), minlength=size + 1)
    plan = packing.plan(counts, size, width)
    rows = expand(plan, counts)
    assert sorted(r[0] for r in rows) == sorted(lengths)
    n = check(rows, size)
    assert n == plan.sequences and n >= -(-sum(lengths) // size)
    assert n <= first_fit(lengths, size) + max(1, n // 100)
    # rows of the plan don't grow with the counts
    again = packing.plan(counts * 1000, size, width)
    assert len(again.rows) <= 4 * size * 12


def test_least_squares_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.integers(0, 3, (12, 40)).astype(float), rng.integers(0, 50, 12).astype(float)
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope <= 1e-6).all() and np.abs(slope[x > 1e-9]).max(initial=0) < 1e-6
    assert (packing.nnls(a, np.zeros(12)) == 0).all()


def test_patterns_can_be_filled():
    size, width = 64, 8
    a = packing.patterns(size, width)
    found = {tuple(np.repeat(np.arange(1, 9), a[:, j].astype(int))) for j in range(a.shape[1])}
    want = set()
    for n in (1, 2, 3):
        def go(own, left):
            if len(own) == n:
                if left == 0:
                    want.add(tuple(sorted(-(-x // width) for x in own)))
                return
            for x in range(1, left + 1):
                go([*own, x], left - x)
        go([], size)
    assert found == want


def test_table(spark):
    rng = random.Random(4)
    texts = [None, "", "hello", "x " * 9000, *[" ".join(rng.choice(["the", "cat", "sat", "日本", "it's"]) for _ in range(rng.randint(0, 400))) for _ in range(200)], *["same text"] * 50]
    docs = spark.createDataFrame([(i if i % 40 else None, t, 7, "o", 1) for i, t in enumerate(texts)], "doc_id long, text string, length int, offset string, _row int").repartition(3)
    size = 512
    pieces = packing.tokenize(docs, PATH, size=size, with_ids=True)
    placed = packing.pack(pieces, size=size).cache()
    got = placed.collect()
    encoder = packing.Encoder(PATH)
    want = []
    for i, t in enumerate(texts):
        ids = encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END_ID]
        want += [(i if i % 40 else None, k // size, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())) for k in range(0, len(ids), size) for own in [ids[k : k + size]]]
    key = lambda r: (r[0] is not None, *[x or 0 for x in r])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    n = check([(r.length, r.sequence_id, r.offset) for r in got], size)
    assert n <= first_fit([r.length for r in got], size) + 1
    whole = {r.sequence_id: r.ids for r in packing.sequences(placed).collect()}
    for r in got:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert packing.pack(packing.tokenize(docs.limit(0), PATH)).count() == 0
    with pytest.raises(Exception, match="a piece of length 999"):
        packing.pack(spark.createDataFrame([(1, 999)], "doc_id long, length long"), size=size)
