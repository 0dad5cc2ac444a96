"""The stages of the pipeline, each on what the one before kept."""

from __future__ import annotations

import itertools
import random
import re

import corpus_pipeline

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which".split()


def test_stages_take_effect(spark, tmp_path):
    def prose(seed, n=60):
        return " ".join(WORDS[(seed * 7 + i * i * (seed + 3)) % len(WORDS)] + str((seed * 31 + i) % 97) for i in range(n))

    question = " ".join(f"q{i}" for i in range(12))
    rows = [(i, prose(i), "en", f"s{i % 3}", len(prose(i))) for i in range(20)]
    rows += [(20, prose(0), "en", "s0", None), (21, "12345 !", "en", "s0", None), (22, None, None, None, None), (23, prose(50) + " " + question, "en", "s1", None), (24, prose(51) + " password=abcdefghijklmn", "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    sizes = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stage(spark, kept, str(tmp_path))
        ids = {r.doc_id for r in kept.collect()}
        sizes.append(len(ids))
        if i < 4:
            assert kept.columns == docs.columns
    assert sizes[:4] == [23, 22, 21, 21]  # no letters and null go; the copy goes; the contaminated goes
    out = {r.doc_id: r for r in kept.collect()}
    assert all(1 <= r.copies <= 3 and r.taken == r.copies * r.size for r in out.values())
    assert "password" not in out.get(24, {"text": ""})["text"]


def test_join_stage_takes_five_words_and_80_percent(spark):
    words = [f"w{i}" for i in range(1000)]

    def replaced(n):
        return " ".join(f"x{i}" if i % 45 == 20 and i // 45 < n else w for i, w in enumerate(words))

    def jaccard(a, b, k):
        x, y = ({tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)} for t in (a, b))
        return len(x & y) / len(x | y)

    base = " ".join(words)
    assert jaccard(base, replaced(21), 5) == 891 / 1101 and jaccard(base, replaced(21), 4) < 0.85
    far = " ".join(f"y{i}" if i % 40 == 5 else w for i, w in enumerate(words))
    assert jaccard(base, far, 5) < 0.8
    docs = spark.createDataFrame([(1, base), (2, replaced(21)), (3, far)], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.join_near_copies(spark, docs, "").collect()} == {1, 3}


def test_repeated_and_null_ids(spark):
    def prose(seed):
        return " ".join(f"{seed}-{i}" for i in range(30))

    rows = [(1, prose("a")), (1, prose("b")), (2, prose("b")), (3, prose("a")), (None, prose("c")), (None, prose("c")), (None, prose("d")), (None, prose("a")), (4, prose("e")), (4, prose("e")), (5, None), (None, " ")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    kept = corpus_pipeline.join_near_copies(spark, docs, "")
    want = [(1, prose("a")), (1, prose("b")), (None, prose("c")), (None, prose("d")), (4, prose("e")), (5, None), (None, " ")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    some = spark.createDataFrame([(None if i % 2 else 7, prose(i), "s") for i in range(8)], docs.schema)
    mixed = corpus_pipeline.mix_sources(spark, some, "").collect()
    texts = [r.text for r in mixed]
    assert mixed and len(texts) == len(set(texts)) and all(r.taken == 30 * r.copies for r in mixed)


def test_run_keeps_all_columns(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(WORDS[i % 9 : i % 9 + 20]) + f" x{i}", "en", "s", 1) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS score", "'x' AS findings", "2 AS copies", "3 AS _id")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert set(docs.columns) < set(got.columns) and got.count() > 0


def plain_chain(rows, benchmark):
    """Stages two to four by their rules: (doc_id, text) that stay."""
    shingled = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        shingled[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(shingled), 2):
        if 100 * len(shingled[a] & shingled[b]) >= 80 * len(shingled[a] | shingled[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    windows = set()
    for item in benchmark:
        w = re.findall(r"[a-z0-9]+", item.lower())
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    out = {}
    for d, t in rows:
        w = re.findall(r"[a-z0-9]+", t.lower())
        if find(d) == d and not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1)):
            out[d] = re.sub(r"AKIA[A-Z0-9]{14,}", "[access]", t)
    return out


def test_run_against_plain_rules(spark, tmp_path):
    r = random.Random(9)
    word = lambda: WORDS[r.randrange(len(WORDS))] + str(r.randrange(60))
    question = " ".join(word() for _ in range(14))
    rows = []
    for i in range(70):
        w = [word() for _ in range(r.randint(30, 90))]
        if i % 9 == 4:
            w[20:20] = question.split()[: r.choice([9, 10, 14])]
        if i % 11 == 3:
            w.insert(5, "AKIA" + "".join(r.choice("ABCDEF12") for _ in range(r.choice([10, 14, 20]))))
        rows.append((i, " ".join(w)))
        if i % 6 == 0:
            for k in range(r.randint(1, 3)):
                copy = list(w)
                for _ in range(r.randint(0, 2 + k)):
                    copy[r.randrange(len(copy))] = word()
                rows.append((100 * (k + 1) + i, " ".join(copy)))
    docs = spark.createDataFrame([(d, t, "en", f"s{d % 4}", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    first = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    want = plain_chain([(x.doc_id, x.text) for x in first.collect()], [question])
    assert 40 < len(want) < len(rows) and any("[access]" in t for t in want.values())
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, str(tmp_path))
    assert {x.doc_id: x.text for x in kept.collect()} == want
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(want[x.doc_id] == x.text and x.size == len(x.text.split()) and 1 <= x.copies <= 3 for x in got)
    sizes = {s: sum(len(t.split()) for d, t in want.items() if d % 4 == i) for i, s in enumerate(("s0", "s1", "s2", "s3"))}
    for s in sizes:
        own = [x for x in got if x.source == s]
        assert all(x.source_size == sizes[s] for x in own) and abs(sum(x.taken for x in own) - own[0].target) <= 100
