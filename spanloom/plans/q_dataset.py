"""Queries of tokens, labels, windows and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import dataset
from .fixtures import Tables, collector, sql
from .latin import Latin
from .q_score import CONTENT, STRIDE, WINDOWS, window_rows
from .q_text import CLAUSES_SQL, LABELS_SQL, N_SYL_SQL

D = Latin(dataset)
QUERIES: dict = {}
ORACLES: dict = {}
query = collector(QUERIES, ORACLES)


@query(sql("SELECT doc_id, tok_ix, s, e, md5(rtrim(piece, E' \\n')) AS digest FROM tok", "tok"))
def tokenize(t):
    rows = D.token_rows(D.tokenize(t.texts()))
    texts = rows.join(t.tok().select("doc_id", "tok_ix", "piece"), ["doc_id", "tok_ix"])
    return texts.select("doc_id", "tok_ix", "s", "e", F.md5(F.rtrim("piece", F.lit(" \n")).cast("binary")).alias("digest"))


def labelled(t: Tables):
    return D.label_rows(t.tok(), t.gold())


@query(sql(f"WITH {LABELS_SQL} SELECT doc_id, tok_ix, label FROM lab", "gold", "tok"))
def label_tokens(t):
    return labelled(t).select("doc_id", "tok_ix", "label")


# pred spans nest: the latest-starting span that covers a token wins
NESTED = """cov AS (SELECT t.doc_id, t.tok_ix, max(struct_pack(s := p.s, e := p.e)) AS sp FROM tok t JOIN pred p ON t.doc_id = p.doc_id AND p.s <= t.s AND t.s < p.e WHERE t.e > t.s GROUP BY 1, 2),
nl AS (SELECT t.doc_id, t.tok_ix, CASE WHEN sp IS NULL THEN 0 WHEN row_number() OVER (PARTITION BY t.doc_id, sp ORDER BY t.tok_ix) = 1 THEN 1 ELSE 2 END AS label FROM tok t LEFT JOIN cov ON cov.doc_id = t.doc_id AND cov.tok_ix = t.tok_ix)"""


@query(sql(f"WITH {NESTED} SELECT doc_id, tok_ix, label FROM nl", "pred", "tok"))
def label_tokens_nested(t):
    return D.label_rows(t.tok(), t.pred()).select("doc_id", "tok_ix", "label")


CLS = """cs AS (SELECT g.doc_id, s, e, 'ROOT' AS cls FROM gold g UNION ALL SELECT doc_id, s, e, 'QUOTE' FROM seg WHERE (doc_id * 31 + seg_idx * 7) % 4 = 2),
c5 AS (SELECT t.doc_id, t.tok_ix, CASE WHEN t.e <= t.s OR c.s IS NULL OR t.s >= c.e THEN 0 ELSE (CASE WHEN c.s > coalesce(lag(t.s) OVER (PARTITION BY t.doc_id ORDER BY t.tok_ix), -1) THEN 1 ELSE 2 END) + CASE WHEN cls = 'QUOTE' THEN 2 ELSE 0 END END AS label
  FROM tok t ASOF LEFT JOIN cs c ON t.doc_id = c.doc_id AND t.s >= c.s)"""


@query(sql(f"WITH {CLS} SELECT doc_id, tok_ix, label FROM c5", "gold", "tok"))
def label_tokens_5(t):
    cls = t.gold().select("doc_id", "s", "e", F.lit("ROOT").alias("cls")).union(t.other().filter("layer = 'quote'").select("doc_id", "s", "e", F.lit("QUOTE")))
    return D.label_rows(t.tok(), cls, cls="cls", pairs={"ROOT": (1, 2), "QUOTE": (3, 4)}).select("doc_id", "tok_ix", "label")


STATS = rf"""{CLAUSES_SQL}, cn AS (SELECT *, {N_SYL_SQL} AS n_syl, coalesce(sum(length(clause)) OVER (PARTITION BY doc_id ORDER BY ci ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM cl),
cf AS (SELECT doc_id, ci, s, least(n_syl / 20.0, 1.0)::DOUBLE AS f1, (n_syl IN (7, 9, 11, 13))::INT::DOUBLE AS f2, least(coalesce(stddev_pop(n_syl) OVER (PARTITION BY doc_id ORDER BY ci ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) / 10.0, 1.0)::DOUBLE AS f3,
  coalesce(regexp_matches(lag(clause) OVER w, '(the\.|of\.|de\.|en\.)$'), false)::INT::DOUBLE AS f4, regexp_matches(coalesce(lead(clause, 1) OVER w, '') || coalesce(lead(clause, 2) OVER w, ''), 'tion|heit|mente')::INT::DOUBLE AS f5 FROM cn WINDOW w AS (PARTITION BY doc_id ORDER BY ci))"""


def stats(t: Tables):
    return D.clause_stats(D.clause_table(t.texts()))


@query(f"WITH {STATS} SELECT doc_id, ci, s, f1, f2, round(f3, 6) AS f3, f4, f5 FROM cf")
def clause_stats(t):
    return stats(t).withColumn("f3", F.round("f3", 6))


@query(sql(f"WITH {STATS} SELECT t.doc_id, t.tok_ix, CASE WHEN t.e > t.s THEN f1 ELSE 0 END AS f1, CASE WHEN t.e > t.s THEN f2 ELSE 0 END AS f2, round(CASE WHEN t.e > t.s THEN f3 ELSE 0 END, 6) AS f3, CASE WHEN t.e > t.s THEN f4 ELSE 0 END AS f4, CASE WHEN t.e > t.s THEN f5 ELSE 0 END AS f5 FROM tok t ASOF JOIN cf ON t.doc_id = cf.doc_id AND t.s >= cf.s", "tok"))
def token_features(t):
    return D.token_features(t.tok(), stats(t)).withColumn("f3", F.round("f3", 6))


_IGNORE = "seg WHERE (doc_id * 31 + seg_idx * 7) % 4 IN (0, 2) AND seg_idx % 3 = 0"


@query(sql(f"WITH {LABELS_SQL}, ig AS (SELECT doc_id, s + 10 AS s, e + 10 AS e FROM {_IGNORE}) SELECT l.doc_id, l.tok_ix, CASE WHEN label <> 0 AND EXISTS (SELECT 1 FROM ig WHERE ig.doc_id = l.doc_id AND ig.s <= t.s AND t.s < ig.e) THEN -100 ELSE label END AS label FROM lab l JOIN tok t ON t.doc_id = l.doc_id AND t.tok_ix = l.tok_ix", "gold", "tok"))
def mask_ignored(t):
    ignore = t.seg().filter("(doc_id * 31 + seg_idx * 7) % 4 IN (0, 2) AND seg_idx % 3 = 0").selectExpr("doc_id", "s + 10 AS s", "e + 10 AS e")
    tokens = D.tokenize(D.with_spans(D.with_spans(t.texts(), t.gold()), ignore, name="ignore"), carry=("span_s", "span_e", "ignore_s", "ignore_e"))
    return D.label_in_rows(tokens, ("doc_id",), "ignore").select("doc_id", F.posexplode("labels").alias("tok_ix", "label")).withColumn("tok_ix", F.col("tok_ix").cast("long"))


@query(sql("SELECT t.doc_id, t.tok_ix FROM tok t WHERE EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = t.doc_id AND g.s <= t.s AND t.s < g.e) AND EXISTS (SELECT 1 FROM other o WHERE o.doc_id = t.doc_id AND o.s <= t.s AND t.s < o.e)", "gold", "other", "tok"))
def tokens_suppressed(t):
    return D.tokens_suppressed(t.tok().select("doc_id", "tok_ix", "s", "e"), t.gold(), t.other()).select("doc_id", "tok_ix")


@query(sql(f"WITH {WINDOWS} SELECT doc_id, window_index, t0::BIGINT AS token_start, t1::BIGINT AS token_end FROM win", "tok"))
def sliding_windows(t):
    return window_rows(t)


@query(sql(f"WITH {WINDOWS} SELECT doc_id, max(window_index) AS last_index, count(*) AS n_windows FROM win GROUP BY doc_id", "tok"))
def window_index(t):
    return window_rows(t).groupBy("doc_id").agg(F.max("window_index").alias("last_index"), F.count("*").alias("n_windows"))


PACKED = f"""{LABELS_SQL}, {WINDOWS}, pk AS (SELECT w.doc_id, window_index, any_value(t0)::BIGINT AS token_start, any_value(t1)::BIGINT AS token_end, any_value(n)::BIGINT AS n_tokens_doc, {CONTENT} + 2 AS n_ids, count(*) + 2 AS n_mask,
  sum(label)::BIGINT AS label_sum, count_if(label = 1)::BIGINT AS n_b, count_if(label = 2)::BIGINT AS n_i, count_if(label = 0)::BIGINT AS n_o, coalesce(min(CASE WHEN t.e > t.s THEN t.s END), -1) AS char_start, coalesce(max_by(t.e, t.tok_ix) FILTER (WHERE t.e > t.s), -1) AS char_end
  FROM win w JOIN tok t ON t.doc_id = w.doc_id AND t.tok_ix >= t0 AND t.tok_ix < t1 JOIN lab l ON l.doc_id = t.doc_id AND l.tok_ix = t.tok_ix GROUP BY w.doc_id, window_index)"""


def packed(t: Tables, books=None, carry: tuple[str, ...] = ()):
    """Windows of all books, from the default tokenizer."""
    tokens = D.tokenize(D.with_spans(t.texts() if books is None else books, t.gold()), carry=(*carry, "span_s", "span_e"))
    return D.pack_windows(D.label_in_rows(tokens, ("doc_id", *carry, "ids", "starts", "ends")), CONTENT, STRIDE, carry=carry)


@query(sql(f"WITH {PACKED} SELECT doc_id, window_index::INT AS window_index, token_start::INT AS token_start, token_end::INT AS token_end, n_tokens_doc::INT AS n_tokens_doc, n_ids::BIGINT AS n_ids, n_mask, label_sum, n_b, char_start::INT AS char_start, char_end::INT AS char_end FROM pk", "gold", "tok"))
def pack_windows(t):
    count = lambda c, f: F.size(F.filter(c, f)).cast("long")
    kept = F.filter("labels", lambda x: x != D.IGNORE)
    return packed(t).select(
        "doc_id", "window_index", "token_start", "token_end", "n_tokens_doc", F.size("input_ids").cast("long").alias("n_ids"), count("attention_mask", lambda x: x == 1).alias("n_mask"),
        F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x).alias("label_sum"), count("labels", lambda x: x == 1).alias("n_b"), "char_start", "char_end",
    )


def split_windows(t: Tables):
    """Windows of the books that have a split: those are chosen before they become windows."""
    return packed(t, t.texts().join(t.prior().select("doc_id", "split"), "doc_id"), ("split",))


COUNTS = f"{PACKED}, ps AS (SELECT pk.*, split FROM pk JOIN prior ON prior.doc_id = pk.doc_id), lc AS (SELECT split, unnest([0, 1, 2]) AS label, unnest([sum(n_o), sum(n_b), sum(n_i)])::BIGINT AS n FROM ps GROUP BY split)"


@query(sql(f"WITH {COUNTS} SELECT split, label, n FROM lc", "gold", "tok", "prior"))
def label_counts(t):
    return D.label_counts(split_windows(t))


def _weights(scheme: str, expr: str):
    @query(sql(f"WITH {COUNTS} SELECT split, label, n, {expr} AS weight FROM lc", "gold", "tok", "prior"))
    def run(t):
        df = D.class_weights(D.label_counts(split_windows(t)), scheme)
        return df.withColumn("weight", F.round("weight", 4))

    return run


for _name, _expr in (
    ("balanced", "round(sum(n) OVER (PARTITION BY split)::DOUBLE / (3 * n), 4)"),
    ("inv", "round(CASE WHEN label = 0 THEN 1.0 ELSE max(CASE WHEN label = 0 THEN n END) OVER (PARTITION BY split)::DOUBLE / greatest(n, 1) END, 4)::DOUBLE"),
    ("sqrt_inv", "round(sqrt(CASE WHEN label = 0 THEN 1.0 ELSE max(CASE WHEN label = 0 THEN n END) OVER (PARTITION BY split)::DOUBLE / greatest(n, 1) END), 4)::DOUBLE"),
):
    _run = _weights(_name, _expr)
    QUERIES[f"class_weights_{_name}"], ORACLES[f"class_weights_{_name}"] = QUERIES.pop("run"), ORACLES.pop("run")


@query(sql(f"WITH {COUNTS} SELECT split, sum(n_b + n_i)::BIGINT AS positive, sum(n_b + n_i + n_o)::BIGINT AS total, round(sum(n_b + n_i)::DOUBLE * 100.0 / sum(n_b + n_i + n_o), 4) AS pct FROM ps GROUP BY split", "gold", "tok", "prior"))
def token_stats(t):
    return D.token_stats(split_windows(t))


@query(sql(f"WITH {COUNTS} SELECT split, count_if(doc_id % 10 = 5)::BIGINT AS n_windows, coalesce(sum(n_b + n_i) FILTER (WHERE doc_id % 10 = 5), 0)::BIGINT AS positive, round(coalesce(sum(n_b + n_i) FILTER (WHERE doc_id % 10 = 5), 0)::DOUBLE * 100.0 / sum(n_b + n_i), 4) AS pct FROM ps GROUP BY split", "gold", "tok", "prior"))
def outlier_share(t):
    return D.outlier_share(split_windows(t), F.col("doc_id") % 10 == 5)


@query(sql("SELECT b.doc_id, round(coalesce(sum(e - s), 0)::DOUBLE * 100.0 / any_value(b.n_chars), 4) AS coverage_pct FROM books b LEFT JOIN gold g ON g.doc_id = b.doc_id GROUP BY b.doc_id", "gold", "books"))
def coverage_pct(t):
    return D.coverage_pct(t.books(), t.gold())


@query(sql("WITH sp AS (SELECT doc_id, s, e FROM gold UNION ALL SELECT doc_id, e AS s, e + 1 AS e FROM gold WHERE seg_idx % 3 = 0) SELECT doc_id, s, e FROM sp WHERE NOT EXISTS (SELECT 1 FROM tok t WHERE t.doc_id = sp.doc_id AND t.s >= sp.s AND t.s < sp.e AND t.e > t.s)", "gold", "tok"))
def lost_spans(t):
    spans = t.gold().select("doc_id", "s", "e").union(t.gold().filter("seg_idx % 3 = 0").selectExpr("doc_id", "e", "e + 1"))
    return D.lost_spans(D.label_rows(t.tok(), spans), spans)


@query(sql(f"WITH {COUNTS} SELECT split, count(*) AS n_windows, count(DISTINCT doc_id) AS n_books, sum(n_b)::BIGINT AS n_b, sum(n_i)::BIGINT AS n_i, sum(n_o)::BIGINT AS n_o FROM ps GROUP BY split", "gold", "tok", "prior"))
def build_dataset(t):
    df = D.build_dataset(t.texts(), t.gold(), t.prior(), content=CONTENT, stride=STRIDE)
    count = lambda v: F.sum(F.size(F.filter("labels", lambda x: x == v))).alias({0: "n_o", 1: "n_b", 2: "n_i"}[v])
    return df.groupBy("split").agg(F.count("*").alias("n_windows"), F.countDistinct("doc_id").alias("n_books"), count(1), count(2), count(0))


@query(sql("SELECT b.doc_id FROM books b WHERE b.doc_id NOT IN (SELECT doc_id FROM prior)", "books", "prior"))
def missing_books(t):
    return C.missing_books(t.books(), t.prior())


@query(sql("SELECT b.doc_id, batch, n_chars, split FROM books b JOIN prior p ON p.doc_id = b.doc_id", "books", "prior"))
def restrict_to_split(t):
    return C.restrict_to_split(t.books(), t.prior())


@query(sql("WITH v AS (SELECT 'n_spans' AS name, count(*) AS value FROM gold UNION ALL SELECT 'n_books', count(DISTINCT doc_id) FROM gold UNION ALL SELECT 'n_long', count_if(e - s >= 40)::BIGINT FROM gold) SELECT name, value::BIGINT AS value, CASE WHEN name = 'n_long' THEN -1 ELSE value END::BIGINT AS expected, name <> 'n_long' AS ok FROM v", "gold"))
def check_totals(t):
    names = {"n_spans": F.count("*"), "n_books": F.countDistinct("doc_id"), "n_long": F.count_if(F.col("e") - F.col("s") >= 40)}
    frozen = t.gold().agg(F.count("*").alias("value")).select(F.lit("n_spans").alias("name"), "value").union(t.gold().agg(F.countDistinct("doc_id")).select(F.lit("n_books"), "*")).union(t.gold().limit(1).select(F.lit("n_long"), F.lit(-1).cast("long")))
    return C.check_totals_against(t.gold(), names, frozen)
