"""The filter interaction audit against removing documents filter by filter."""

from __future__ import annotations

import random
from collections import defaultdict
from fractions import Fraction
from itertools import permutations
from math import factorial

from spanloom.llm import interaction


def fails(docs):
    """Of each row its part, the filters it fails, by plain rules."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, text, source in docs:
        t = text or ""
        words = [w for w in "".join("\n" if c in " \t\n\x0b\x0c\r" else c for c in t).split("\n") if w]
        bad = ""
        bad += "A" if len(words) < 200 else ""
        bad += "B" if 100 * len(set(words)) < 50 * len(words) else ""
        bad += "C" if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else ""
        bad += "D" if any(c in "#$%&*|" for c in t) else ""
        bad += "E" if i is not None and i > least[t] else ""
        out.append((source or "", bad, i))
    return out


def brute(docs, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for part, bad, i in fails(docs):
        parts[part].append((bad, i))
    rows = []
    for part, own in parts.items():
        steps, shapley = [], defaultdict(int)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                failing, only = sum(f in x[0] for x in own), sum(x[0] == f for x in own)
                steps.append((part, "".join(order), k, f, len(left), len(gone), failing - len(gone), only, sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)))
        rows += [(*s[:3], *s[4:], shapley[s[3]]) for s in steps]
    return sorted(rows)


def test_every_order_step_by_step(spark):
    rng = random.Random(9)
    texts = [None, "", " \t\n", "A", "one two", "x " * 250, " ".join(f"w{i}" for i in range(250)), "ABC " * 5, "50% off", "a|b", " é #", " ".join(f"w{i % 90}" for i in range(400)), " ".join(f"w{i}" for i in range(201)) + " $", "\x1cword\x85word"]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "s1", "s2", "s3"])) for _ in range(300)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(50)]
    frame = spark.createDataFrame([(*d, 1, "m") for d in docs], "doc_id long, text string, source string, mask int, part string").repartition(4)
    marks = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = interaction.audit(frame, marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute(docs, labels)
    assert interaction.audit(frame.limit(0), marks).count() == 0
    assert interaction.audit(frame, marks.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_least_squares_give_shapley_values():
    rng = random.Random(2)
    for n in (2, 3, 4, 5):
        solution = interaction.shapley_solution(n)
        for _ in range(5):
            v = [0] + [rng.randint(0, 10**6) for _ in range((1 << n) - 1)]
            for f in range(n):
                want = Fraction(0)
                for order in permutations(range(n)):
                    before = sum(1 << x for x in order[: order.index(f)])
                    want += v[before | 1 << f] - v[before]
                assert sum(c * x for c, x in zip(solution[f], v, strict=True)) == want
            assert sum(sum(c * x for c, x in zip(row, v, strict=True)) for row in solution) == factorial(n) * v[-1]
