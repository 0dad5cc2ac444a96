"""Reports that hold all of their parts, and readers and labels that deal out no texts or tokens twice."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import dataset
from spanloom.plans import q_dataset, registry
from spanloom.plans.fixtures import Tables
from spanloom.sources import io

TEXTS = [" leading space and a line\nthat breaks. The next sentence goes on and on. Another one, of words. End.", "One. ", "", None, "  \n ", "The long sentence of the book has quite some words in it. " * 30]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("reports"))
    rows = [(i, TEXTS[i % len(TEXTS)], "en", f"src{i}", len(TEXTS[i % len(TEXTS)] or "")) for i in range(36)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 36, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stats_report_has_windows_books_spans_and_all_weights(spark, folder):
    t = Tables(spark, folder)
    report = json.loads(registry.queries()["stats_report"](spark, folder).first().report)
    windows = q_dataset.split_windows(t)
    counts = dataset.label_counts(windows)
    prior = t.prior().select("doc_id", "split")
    n = {r.split: r.n for r in windows.groupBy("split").agg(F.count("*").alias("n")).collect()}
    docs = {r.split: r["count"] for r in prior.groupBy("split").count().collect()}
    spans = {r.split: r["count"] for r in t.gold().join(prior, "doc_id").groupBy("split").count().collect()}
    assert {s["split"]: (s["windows"], s["docs"], s["spans"]) for s in report["splits"]} == {k: (n.get(k, 0), docs[k], spans.get(k, 0)) for k in docs}
    assert all(s["old"] + s["new"] == s["docs"] for s in report["splits"]) and report["spans_total"] == sum(spans.values()) and report["spans_without_b"] == 0
    for r in counts.collect():
        assert next(s for s in report["splits"] if s["split"] == r.split)["label_counts"][str(r.label)] == r.n
    for scheme in ("balanced", "inv", "sqrt_inv"):
        for r in dataset.class_weights(counts, scheme).collect():
            assert next(s for s in report["splits"] if s["split"] == r.split)["weights"][scheme].get(str(r.label)) == r.weight


def test_spans_without_b_are_counted(spark):
    books = spark.createDataFrame([(1, "a", [0, 1, 2, 0], [3, 9]), (2, "a", [], [4])], "doc_id long, split string, labels array<int>, span_s array<bigint>")
    got = {r.doc_id: (r.windows, r.spans, r.spans_without_b, r.c0, r.c1, r.c2) for r in dataset.book_totals(books, content=3, stride=2).collect()}
    assert got == {1: (2, 2, 1, 2, 2, 2), 2: (0, 1, 1, 0, 0, 0)}


def test_books_are_chosen_by_path_alone(spark, tmp_path, monkeypatch):
    books = spark.createDataFrame([("P1", "nested"), ("P2", "both"), ("P3", None)], "book_id string, text string")
    io.write_books(books, str(tmp_path))
    io.write_books(books.filter("book_id <> 'P1'").withColumn("text", F.lit("flat")), str(tmp_path), nested=False)
    (tmp_path / "P2.txt").write_text("plain")
    want = {("P1", "nested"), ("P2", "both"), ("P3", "flat")}
    df = io.read_books(spark, str(tmp_path))
    assert {tuple(r) for r in df.collect()} == want and "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(io, "MAX_BROADCAST_PATHS", 0)
    assert {tuple(r) for r in io.read_books(spark, str(tmp_path)).collect()} == want


def test_convert_labels_deals_out_no_tokens(spark, folder):
    t = Tables(spark, folder)
    df = registry.queries()["convert_labels"](spark, folder)
    whole = dataset.label_arrays(dataset.label_rows(t.tok(), t.gold()))
    count = lambda scheme, v: F.size(F.filter(T.convert_labels(F.col("labels"), scheme), lambda x: x == v)).cast("long")
    want = whole.select("doc_id", F.size("labels").alias("n"), count("io", 1), count("bioe", 3))
    assert sorted(tuple(r) for r in df.collect()) == sorted(tuple(r) for r in want.collect())
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_split_report_is_on_the_split_that_is_made_and_keeps_its_lists(spark, tmp_path):
    text = "The first long sentence that several books of this test have in common goes on and on. And the second one that they share is long too, as it has to be."
    texts = [text if i % 4 == 1 else f"Book {i} has words of its own, number {i} of {i * 7}, and they go on until it ends after {i * 13} of them. " for i in range(40)]
    docs = [(i, x, "en", f"src{i}", len(x)) for i, x in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 3)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    report = json.loads(registry.queries()["split_report"](spark, str(tmp_path)).first().report)
    kept = {k: spark.read.parquet(report[k]["path"]) for k in ("straddle", "boilerplate_links", "conflicts", "moved", "excluded")}
    assert {k: df.count() for k, df in kept.items()} == {k: report[k]["n"] for k in kept}
    asked = lambda name: sorted(map(str, (tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect())))
    found = lambda name: sorted(map(str, (tuple(r) for r in kept[name].collect())))
    for table, name in (("boilerplate_links", "boilerplate_links"), ("moved", "moved_books"), ("excluded", "excluded_books")):
        assert found(table) == asked(name), table
    assert sum(s["books"] for s in report["stats"]) == 40
    groups = registry.queries()["connected_groups"](spark, str(tmp_path)).groupBy("group_id").count()
    assert (report["n_groups"], report["n_multi_groups"]) == (groups.count(), groups.filter("count > 1").count())
    # linked books stay together in the split that is made
    assert report["n_links"] == registry.queries()["link_books"](spark, str(tmp_path)).count() and report["straddle"]["n"] == report["n_straddling"]
