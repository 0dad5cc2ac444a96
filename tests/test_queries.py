"""Registered queries against their DuckDB twins, over the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from spanloom.plans import registry

DATA = "/root/testdata/sf0.001"
CHOSEN = ("score_micro_prf", "span_audit", "subtract_intervals", "verbatim_matches", "label_tokens_nested", "pack_windows", "sliding_windows", "snap_edges", "argmax_decode", "stratified_split", "window_eval", "book_eval_from_windows", "token_to_char_spans", "leakage_by_spread", "book_profile", "precedence_stats")


def test_every_twin_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 100


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got = registry.queries()[name](spark, DATA)
    want = con.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key) == sorted(map(tuple, want.fetchall()), key=key)
