"""Roles by Viterbi: brute force, parts, ties and nulls, held-out accuracy."""

from __future__ import annotations

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import chat

TURNS = "/root/testdata/sf0.01/conversations.parquet"


def random_model(seed):
    r = np.random.default_rng(seed)
    tables = {f: r.random((chat.N_STATES, n)) + 0.01 for f, n in chat.SIZES.items()}
    return chat._model(r.random(chat.N_STATES) + 0.01, r.random((chat.N_STATES, chat.N_STATES)) + 0.01, tables)


def score(path, codes, model, before=None):
    total = (model["start"] if before is None else model["trans"][before])[path[0]]
    return total + sum(model["trans"][a, b] for a, b in itertools.pairwise(path)) + sum(model["emit"][o, s] for o, s in zip(codes, path, strict=True))


def test_viterbi_against_all_paths():
    r = np.random.default_rng(7)
    for seed in range(6):
        model = random_model(seed)
        seqs = [r.integers(0, chat.N_OBS, n) for n in (0, 1, 5, 2, 4, 1)]
        for before, last in ((None, None), ([None, 2, 0, None, 5, 1], [None, None, 3, 1, None, 0])):
            got = chat.viterbi(seqs, model, before, last)
            for i, (codes, path) in enumerate(zip(seqs, got, strict=True)):
                if not len(codes):
                    assert not len(path)
                    continue
                b, e = (before or [None] * 6)[i], (last or [None] * 6)[i]
                ends = [p for p in itertools.product(range(chat.N_STATES), repeat=len(codes)) if e is None or p[-1] == e]
                assert score(path, codes, model, b) == pytest.approx(max(score(p, codes, model, b) for p in ends))
        for codes, m in zip(seqs, chat.transfers(seqs, model), strict=True):
            if len(codes) in (1, 2):
                for entry, end in itertools.product([None, *range(chat.N_STATES)], range(chat.N_STATES)):
                    best = max(score(p, codes, model, entry) for p in itertools.product(range(chat.N_STATES), repeat=len(codes)) if p[-1] == end)
                    assert m[chat.N_STATES if entry is None else entry, end] == pytest.approx(best)


def test_parts_agree_with_whole_transcripts(spark):
    rows = [(c, t, ["user", "assistant", "system", None][(c + t) % 4 if t else 2], f"line {t}\nmore of {c}?" if t % 3 else "yes") for c in range(8) for t in range(1 + c * 3)]
    rows += [(None, t, "user", f"null {t}") for t in range(9)] + [(90, None, "user", None), (91, 0, "user", "same"), (91, 0, "assistant", "same"), (91, 0, "assistant", "other")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    model = chat.learn(chat.as_transcripts(df))
    whole, parts = chat.as_transcripts(df, 1000), chat.as_transcripts(df, 3)
    assert parts.filter("part > 0").count() > 10 and whole.filter("part > 0").count() == 0
    one, many = (sorted(map(str, chat.turns(t, model, part_col="part").collect())) for t in (whole, parts))
    assert one == many and len(one) > 50
    assert sorted(map(str, chat.turns(whole, model).collect())) == one
    body = lambda t: sorted(((r.id, r.body, r.role, r.first) for r in chat.recover_roles(t, model, part_col="part").collect()), key=str)
    assert body(whole) == body(parts)


def test_labels_follow_the_lines(spark):
    df = spark.createDataFrame([(1, 0, "system", "a\n\nb"), (1, 1, "user", "c"), (1, 1, "assistant", "d"), (1, 2, "x", "e")], "conv_id long, turn int, role string, text string")
    for size in (100, 2):
        for r in chat.as_transcripts(df, size).collect():
            lines = r.text.split("\n")
            starts = [r.lead + sum(r.sizes[:i]) for i in range(len(r.sizes))]
            ends = [lines[s][-1] for s in starts]
            assert sorted(ends) == (["a", "c", "d", "e"] if size == 100 else [["a", "c", "d"], ["e"]][r.part])
            assert r.roles == [{"a": 0, "c": 1, "d": 2, "e": 1}[x] for x in ends]


def test_empty_null_and_repeated_rows(spark):
    rows = [(1, "User: hi\nAssistant: ho", "own"), (1, "User: hi\nAssistant: ho", "own"), (None, "User: x", None), (2, None, None), (3, " \n ", None)]
    df = spark.createDataFrame(rows, "id long, text string, role string")
    got = sorted(((r.id, r.turn, r.role, r.content) for r in chat.turns(df).collect()), key=str)
    assert got == sorted([(1, 0, "user", "hi"), (1, 1, "assistant", "ho")] * 2 + [(None, 0, "user", "x")], key=str)
    assert chat.turns(df.limit(0)).count() == chat.recover_roles(df.limit(0)).count() == 0
    none = chat.as_transcripts(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))
    assert chat.turns(none, chat.learn(none), part_col="part").count() == 0


@pytest.mark.skipif(not os.path.exists(TURNS), reason="no test tables here")
def test_held_out_accuracy(spark):
    df = chat.as_transcripts(spark.read.parquet(TURNS))
    held = F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2
    lines = chat.recover_roles(df.filter(held), chat.learn(df.filter(~held)), part_col="part")
    found = {(r.id, r.line): (r.role, r.first) for r in lines.collect()}
    right = opened = 0
    for r in df.filter(held).collect():
        starts = [r.lead + sum(r.sizes[:i]) for i in range(len(r.sizes))]
        for line in (x for i, x in found if i == r.id):
            turn = max(i for i, s in enumerate(starts) if s <= line)
            role, first = found[r.id, line]
            right += role == chat.ROLES[r.roles[turn]]
            opened += first == (line in starts)
    print("roles", right / len(found), "turn starts", opened / len(found))
    assert right / len(found) >= 0.95 and opened / len(found) >= 0.93
