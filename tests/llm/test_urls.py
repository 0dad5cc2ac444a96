"""URL models against counts in dicts, both ways of scoring, calibration, small tables."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from spanloom.llm import urls


def symbols(url):
    return [0] * urls.ORDER + [48 if 48 <= x <= 57 else x for x in (url or "").encode()] + [3]


def brute_ratio(url, examples):
    """The same models from dicts of counts."""
    total = []
    for cls in (0, 1):
        after = defaultdict(Counter)
        for u, c in examples:
            s = symbols(u)
            if c == cls:
                for i in range(urls.ORDER, len(s)):
                    for k in range(urls.ORDER + 1):
                        after[tuple(s[i - k : i])][s[i]] += 1
        s, logs = symbols(url), []
        for i in range(urls.ORDER, len(s)):
            p = 1 / urls.ALPHABET
            for k in range(urls.ORDER + 1):
                seen = after.get(tuple(s[i - k : i]))
                if seen:
                    p = (seen[s[i]] + len(seen) * p) / (sum(seen.values()) + len(seen))
            logs.append(math.log(p))
        total.append(sum(logs) / len(logs))
    return total[1] - total[0]


def test_ratios_against_dicts(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcé1/-") for _ in range(r.randint(1, 9)))
    examples = [(f"http://{word()}.org/{word()}", i % 2) for i in range(40)] + [("", 0), (None, 1)]
    model = urls.train(spark.createDataFrame(examples, "url string, cls int"))
    wanted = [examples[0][0], "http://new/xyz", "", None, word(), word() * 40]
    df = spark.createDataFrame([(u, i) for i, u in enumerate(wanted)], "url string, i int")
    few = {x.i: x.ratio for x in urls.score(df, model).collect()}
    many = {x.i: x.ratio for x in urls.score(df, model, max_broadcast=0).collect()}
    for i, u in enumerate(wanted):
        assert few[i] == pytest.approx(brute_ratio(u, examples)) and many[i] == pytest.approx(few[i])


def test_calibration_separates(spark):
    rows = [(0, -0.5 - i / 100) for i in range(50)] + [(1, 0.7 + i / 100) for i in range(50)]
    cut = urls.calibrate(spark.createDataFrame(rows, "cls int, ratio double"))
    assert -0.5 < cut < 0.7
    assert urls.calibrate(spark.createDataFrame(rows[:50], "cls int, ratio double")) == 0.0


def test_models_decide_where_no_rule_fits(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        name = "".join(r.choice("abcdefgh") for _ in range(6))
        rows += [(i, f"http://{name}.org/good/{name}"), (1000 + i, f"http://{name}.com/de/cheap-pills-{name}")]
    rows += [(5000, "http://xyz.net/good/abcdef"), (5001, "http://xyz.net/de/cheap-pills-abc"), (5001, "http://xyz.net/de/cheap-pills-abc"), (None, None)]
    df = spark.createDataFrame([(*x, "own") for x in rows], "page_id long, url string, verdict string")
    got = urls.judge(df)
    assert got.count() == len(rows)
    verdict = {(x.page_id, x.verdict) for x in got.filter("page_id >= 5000").collect()}
    assert verdict == {(5000, "allow"), (5001, "block")}
    assert urls.judge(df.limit(0)).count() == 0
