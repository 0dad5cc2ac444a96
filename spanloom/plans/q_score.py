"""Queries of scoring, de-duplication and stitching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset
from ..operators import score
from ..operators.tables import stage
from .fixtures import Tables, collector, sql
from .latin import Latin

D = Latin(dataset)
S = Latin(score)
QUERIES: dict = {}
ORACLES: dict = {}
query = collector(QUERIES, ORACLES)

IOU = "(greatest(0, least(g.e, p.e) - greatest(g.s, p.s)) / ((g.e - g.s) + (p.e - p.s) - greatest(0, least(g.e, p.e) - greatest(g.s, p.s))))"
CANDS = f"gx AS (SELECT doc_id, seg_idx AS gold_ix, s, e FROM gold), cands AS (SELECT g.doc_id, gold_ix, pred_ix, {IOU} AS iou FROM gx g JOIN pred p ON g.doc_id = p.doc_id AND p.s < g.e AND g.s < p.e WHERE {IOU} >= {{thr}})"


def greedy_sql(cands: str = "cands", keys: str = "doc_id", rounds: int = 4) -> str:
    """Greedy matching as rounds of pairs that are the best of both their ends; CTE ``mt``. Four rounds settle all clusters here."""
    out, left = [], cands
    for r in range(rounds):
        best = "iou DESC, gold_ix DESC, pred_ix DESC"
        out.append(f"""b{r} AS (SELECT *, row_number() OVER (PARTITION BY {keys}, gold_ix ORDER BY {best}) AS rg, row_number() OVER (PARTITION BY {keys}, pred_ix ORDER BY {best}) AS rp FROM {left}),
w{r} AS (SELECT * EXCLUDE (rg, rp) FROM b{r} WHERE rg = 1 AND rp = 1)""")
        if r + 1 < rounds:
            on = lambda ix: " AND ".join(f"w.{k.strip()} = c.{k.strip()}" for k in (*keys.split(","), ix))
            out.append(f"c{r} AS (SELECT c.* FROM {left} c WHERE NOT EXISTS (SELECT 1 FROM w{r} w WHERE {on('gold_ix')}) AND NOT EXISTS (SELECT 1 FROM w{r} w WHERE {on('pred_ix')}))")
            left = f"c{r}"
    return ",\n".join(out) + ",\nmt AS (" + " UNION ALL ".join(f"SELECT * FROM w{r}" for r in range(rounds)) + ")"


MATCH = CANDS.format(thr="0.5") + ",\n" + greedy_sql()
SCORES = f"""{MATCH}, sc AS (SELECT b.doc_id, b.batch, coalesce(tp, 0)::BIGINT AS tp, coalesce(n_pred, 0)::BIGINT AS n_pred, coalesce(n_gold, 0)::BIGINT AS n_gold FROM books b
  LEFT JOIN (SELECT doc_id, count(*) AS tp FROM mt GROUP BY 1) m ON m.doc_id = b.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n_pred FROM pred GROUP BY 1) p ON p.doc_id = b.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n_gold FROM gold GROUP BY 1) g ON g.doc_id = b.doc_id)"""


def prf_sql(tp: str = "tp", n_pred: str = "n_pred", n_gold: str = "n_gold") -> str:
    return (
        f"round(CASE WHEN {n_pred} > 0 THEN {tp}::DOUBLE / {n_pred} ELSE 0 END, 6) AS precision, round(CASE WHEN {n_gold} > 0 THEN {tp}::DOUBLE / {n_gold} ELSE 0 END, 6) AS recall, "
        f"round(CASE WHEN {n_pred} + {n_gold} > 0 THEN 2 * {tp}::DOUBLE / ({n_pred} + {n_gold}) ELSE 0 END, 6) AS f1"
    )


def gold(t: Tables):
    return t.gold().select("doc_id", F.col("seg_idx").alias("gold_ix"), "s", "e")


def scores(t: Tables):
    # the spans are derived from the texts once
    return S.score_spans(t.books().select("doc_id", "batch"), stage(gold(t)), stage(t.pred()))


@query(sql(f"WITH {CANDS.format(thr='0.5')} SELECT doc_id, gold_ix, pred_ix, round(iou, 6) AS iou FROM cands", "gold", "pred"))
def match_candidates(t):
    return S.match_candidates(gold(t), t.pred()).select("doc_id", "gold_ix", "pred_ix", F.round("iou", 6).alias("iou"))


@query(sql(f"WITH {MATCH} SELECT doc_id, gold_ix, pred_ix, round(iou, 6) AS iou FROM mt", "gold", "pred"))
def greedy_match(t):
    return S.greedy_match(S.match_candidates(gold(t), t.pred())).withColumn("iou", F.round("iou", 6))


@query(sql(f"WITH {SCORES} SELECT * FROM sc", "gold", "pred", "books"))
def score_spans(t):
    return scores(t)


@query(sql(f"WITH {SCORES}, r AS (SELECT coalesce(batch, 'all') AS grp, sum(tp)::BIGINT AS tp, sum(n_pred)::BIGINT AS n_pred, sum(n_gold)::BIGINT AS n_gold FROM sc GROUP BY ROLLUP (batch)) SELECT *, n_pred - tp AS fp, n_gold - tp AS fn, {prf_sql()}, round(CASE WHEN n_gold > 0 THEN n_pred::DOUBLE / n_gold ELSE 0 END, 6) AS overproposal FROM r", "gold", "pred", "books"))
def score_micro_prf(t):
    return S.micro_prf(scores(t))


@query(sql(f"WITH {SCORES} SELECT round(median(CASE WHEN n_pred + n_gold > 0 THEN 2 * tp::DOUBLE / (n_pred + n_gold) ELSE 0 END), 6) AS median_f1 FROM sc", "gold", "pred", "books"))
def median_book_f1(t):
    return S.median_book_f1(scores(t))


@query(sql(f"WITH {SCORES} SELECT *, n_pred - tp AS fp, round(CASE WHEN n_pred + n_gold > 0 THEN 2 * tp::DOUBLE / (n_pred + n_gold) ELSE 0 END, 6) AS f1 FROM sc ORDER BY fp DESC, doc_id", "gold", "pred", "books"))
def book_ranking(t):
    return S.book_ranking(scores(t))


@query(sql(f"""WITH {CANDS.format(thr='0.5').replace('cands AS', 'c5 AS')}, cands AS (SELECT c5.*, thr FROM c5, (VALUES (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE), (1.0::DOUBLE)) v(thr) WHERE iou >= thr), {greedy_sql(keys='doc_id, thr')},
k AS (SELECT thr, count(*) AS tp FROM mt GROUP BY thr), z AS (SELECT v.thr, coalesce(tp, 0)::BIGINT AS tp, (SELECT count(*) FROM pred) AS n_pred, (SELECT count(*) FROM gold) AS n_gold FROM (VALUES (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE), (1.0::DOUBLE)) v(thr) LEFT JOIN k ON k.thr = v.thr)
SELECT *, {prf_sql()} FROM z""", "gold", "pred"))  # fmt: skip
def threshold_sweep(t):
    return S.threshold_sweep(gold(t), t.pred())


# spans of an island in order, the kept ones so far carried along
DEDUPE = """m0 AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {0}),
il AS (SELECT *, sum(CASE WHEN r IS NULL OR s >= r THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM m0),
ir AS (SELECT *, row_number() OVER (PARTITION BY doc_id, isl ORDER BY s, e) AS k FROM il),
dd AS (SELECT doc_id, isl, k, s, e, true AS keep, [struct_pack(s := s, e := e)] AS kept FROM ir WHERE k = 1
  UNION ALL SELECT i.doc_id, i.isl, i.k, i.s, i.e, h = 0, CASE WHEN h = 0 THEN list_append(kept, struct_pack(s := i.s, e := i.e)) ELSE kept END
  FROM (SELECT ir.*, dd.kept, len(list_filter(dd.kept, lambda x: least(ir.e, x.e) > greatest(ir.s, x.s) AND (least(ir.e, x.e) - greatest(ir.s, x.s)) / ((ir.e - ir.s) + (x.e - x.s) - (least(ir.e, x.e) - greatest(ir.s, x.s))) >= 0.5)) AS h
        FROM dd JOIN ir ON ir.doc_id = dd.doc_id AND ir.isl = dd.isl AND ir.k = dd.k + 1) i)"""


@query(sql(f"WITH {DEDUPE.format('pred')} SELECT doc_id, s, e FROM dd WHERE keep", "pred", recursive=True))
def dedupe_spans(t):
    return S.dedupe_spans(t.pred())


PARTS = f"""{MATCH}, parts AS (SELECT doc_id, 'gold' AS kind, s, e FROM gx UNION ALL SELECT doc_id, 'predicted', s, e FROM pred
UNION ALL SELECT doc_id, 'matched', s, e FROM gx WHERE EXISTS (SELECT 1 FROM mt WHERE mt.doc_id = gx.doc_id AND mt.gold_ix = gx.gold_ix)
UNION ALL SELECT doc_id, 'missed', s, e FROM gx WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.doc_id = gx.doc_id AND mt.gold_ix = gx.gold_ix)
UNION ALL SELECT doc_id, 'false', s, e FROM pred WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.doc_id = pred.doc_id AND mt.pred_ix = pred.pred_ix))"""


@query(sql(rf"WITH {PARTS}, o AS (SELECT kind, regexp_matches(substring(d.text, s + 1, e - s), '^[ \n]*([0-9]+[.)]? *)?(The|And|Die|Der|De|La|In)') AS o FROM parts p JOIN documents d ON d.doc_id = p.doc_id) SELECT kind, count(*) AS n, count_if(o)::BIGINT AS n_ordinal, round(count_if(o) * 100.0 / count(*), 2)::DOUBLE AS pct_ordinal FROM o GROUP BY kind", "gold", "pred"))
def marker_rates(t):
    g, p = gold(t), t.pred()
    return S.marker_rates(g, p, S.greedy_match(S.match_candidates(g, p)), t.texts())


@query(sql(f"WITH {PARTS} SELECT p.doc_id, kind, s, e, replace(left(substring(d.text, s + 1, e - s), 120), E'\\n', ' ') AS text FROM parts p JOIN documents d ON d.doc_id = p.doc_id WHERE kind IN ('missed', 'false')", "gold", "pred"))
def error_rows(t):
    g, p = gold(t), t.pred()
    return S.error_rows(g, p, S.greedy_match(S.match_candidates(g, p)), t.texts())


CONTENT, STRIDE = 64, 40
WINDOWS = f"""nt AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id),
win AS (SELECT doc_id, n, i AS window_index, CASE WHEN n <= {CONTENT} THEN 0 WHEN i = k - 1 THEN n - {CONTENT} ELSE i * {STRIDE} END AS t0, CASE WHEN n <= {CONTENT} OR i = k - 1 THEN n ELSE i * {STRIDE} + {CONTENT} END AS t1
  FROM (SELECT *, unnest(generate_series(0, k - 1)) AS i FROM (SELECT *, CASE WHEN n <= {CONTENT} THEN 1 ELSE 1 + (n - {CONTENT} + {STRIDE} - 1) // {STRIDE} END::BIGINT AS k FROM nt)))"""


def window_rows(t: Tables):
    return D.window_table(t.token_counts(), "n", CONTENT, STRIDE)


@query(sql(f"WITH {WINDOWS}, tw AS (SELECT doc_id, window_index, t0, t1, unnest(generate_series(t0, t1 - 1)) AS ti FROM win), rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ti ORDER BY abs(ti - (t0 + t1) / 2), window_index) AS r FROM tw) SELECT doc_id, window_index, min(ti)::BIGINT AS own_from, max(ti)::BIGINT + 1 AS own_to FROM rk WHERE r = 1 GROUP BY 1, 2", "tok"))
def best_window_per_token(t):
    return S.best_window_per_token(window_rows(t)).filter("own_to > own_from")
