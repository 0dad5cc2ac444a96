"""Queries of intervals, neighbours and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit
from ..operators import intervals
from ..operators.spans import attach_text
from ..operators.tables import stage
from .fixtures import Tables, collector, sql
from .latin import LATIN, Latin
from .q_sharing import FOUND
from .q_text import MARKERS_SQL, ST, _b, heading_sql

A = Latin(audit)
I = Latin(intervals)
QUERIES: dict = {}
ORACLES: dict = {}
query = collector(QUERIES, ORACLES)

# gold with the batch of its book
GB = "gb AS (SELECT g.*, b.batch FROM gold g JOIN books b ON b.doc_id = g.doc_id)"
BATCH_TEXT = "bt AS (SELECT st.*, b.batch FROM st JOIN books b ON b.doc_id = st.doc_id)"


def gold_batch(t: Tables):
    return t.gold().join(t.books().select("doc_id", "batch"), "doc_id").select("doc_id", "seg_idx", "s", "e", "batch")


def gold_texts(t: Tables):
    return attach_text(gold_batch(t), t.texts())


def exact_quantile(p: int, value: str, digits: str = "") -> str:
    """The exclusive quantile over a sorted list ``l`` of n values."""
    j = f"greatest(1, least(({p} * (n + 1)) // 100, n - 1))"
    return f"CASE WHEN n > 100 THEN (l[{j}] * (100 - ({p} * (n + 1) - {j} * 100)) + l[{j} + 1] * ({p} * (n + 1) - {j} * 100)) / 100.0 END"


@query(sql("""WITH c AS (SELECT doc_id, count(*) AS n FROM gold GROUP BY 1)
SELECT batch, count(*)::BIGINT AS n_books, count_if(b.n_chars > 100)::BIGINT AS n_file, count_if(n > 0)::BIGINT AS n_nonempty, coalesce(sum(n), 0)::BIGINT AS n_spans FROM books b LEFT JOIN c ON b.doc_id = c.doc_id GROUP BY batch""", "gold", "books"))  # fmt: skip
def coverage(t):
    return A.coverage(t.books(), t.gold(), F.col("n_chars") > 100)


@query(sql(f"""WITH {GB}, q AS (SELECT batch, count(*) AS n, list(e - s ORDER BY e - s) AS l, median(e - s) AS median, max(e - s) AS max,
  round(count_if(e - s < 15) * 100.0 / count(*), 1) AS pct_lt15, round(count_if(e - s > 300) * 100.0 / count(*), 1) AS pct_gt300 FROM gb GROUP BY batch)
SELECT batch, n, {', '.join(f"({exact_quantile(p, 'l')})::DOUBLE AS p{p}" for p in (10, 25, 75, 90, 99))}, median::DOUBLE AS median, max, pct_lt15::DOUBLE AS pct_lt15, pct_gt300::DOUBLE AS pct_gt300 FROM q""", "gold", "books"))  # fmt: skip
def length_distribution(t):
    df = A.length_distribution(gold_batch(t))
    return df.select(*[F.col(c).cast("double").alias(c) if c.startswith("p") or c == "median" else F.col(c) for c in df.columns])


NEXT = """nx AS (SELECT *, lead(s) OVER w AS next_s, lead(e) OVER w AS next_e FROM {0} WINDOW w AS (PARTITION BY doc_id ORDER BY s, e))"""


@query(sql(f"WITH {NEXT.format('pred')} SELECT doc_id, pred_ix, s, e, next_s, next_e FROM nx", "pred"))
def next_span(t):
    return I.next_span(t.pred(), "doc_id").select("doc_id", "pred_ix", "s", "e", "next_s", "next_e")


FRAG = f"""pb AS (SELECT p.*, b.batch FROM pred p JOIN books b ON b.doc_id = p.doc_id), {NEXT.format('pb')},
fr AS (SELECT nx.*, coalesce(next_s >= e AND regexp_matches(substring(d.text, e + 1, next_s - e), '^[ \\n.,!]*$'), false) AS frag_next FROM nx JOIN documents d ON d.doc_id = nx.doc_id)"""


@query(sql(f"""WITH {FRAG} SELECT batch, count(*) AS n, count_if(frag_next)::BIGINT AS n_frag, round(count_if(frag_next) * 100.0 / count(*), 1)::DOUBLE AS pct_frag, count_if(frag_next AND next_s = e)::BIGINT AS n_gap0,
  count_if(next_s < e)::BIGINT AS n_overlap, count_if(next_s < e AND next_e <= e)::BIGINT AS n_nested FROM fr GROUP BY batch""", "pred", "books"))  # fmt: skip
def fragmentation(t):
    spans = t.pred().join(t.books().select("doc_id", "batch"), "doc_id").select("doc_id", "s", "e", "pred_ix", "batch")
    return A.fragmentation(A.gap_flags(spans, t.texts()))


@query(sql("SELECT DISTINCT g.doc_id, g.seg_idx, o.layer FROM gold g JOIN other o ON g.doc_id = o.doc_id AND o.s < g.e AND g.s < o.e", "gold", "other"))
def overlap_layers(t):
    return I.overlap_layers(t.gold().select("doc_id", "seg_idx", "s", "e"), t.other()).select("doc_id", "seg_idx", "layer")


@query(sql(f"""WITH {GB}, h AS (SELECT DISTINCT g.doc_id, g.seg_idx, o.layer FROM gold g JOIN other o ON g.doc_id = o.doc_id AND o.s < g.e AND g.s < o.e),
f AS (SELECT gb.doc_id, gb.seg_idx, batch, bool_or(layer = 'quote') AS q, bool_or(layer = 'chapter') AS c FROM gb LEFT JOIN h ON gb.doc_id = h.doc_id AND gb.seg_idx = h.seg_idx GROUP BY 1, 2, 3)
SELECT batch, round(count_if(q) * 100.0 / count(*), 1)::DOUBLE AS pct_quote, round(count_if(c) * 100.0 / count(*), 1)::DOUBLE AS pct_chapter, round(count_if(q OR c) * 100.0 / count(*), 1)::DOUBLE AS pct_any FROM f GROUP BY batch""", "gold", "other", "books"))  # fmt: skip
def layer_overlap_pct(t):
    return A.layer_overlap_pct(gold_batch(t), t.other(), ["quote", "chapter"])


_STX = f"{ST.format('gold')}, {BATCH_TEXT}"


@query(sql(f"""WITH {_STX}, m AS (SELECT batch, {', '.join(MARKERS_SQL)} FROM bt)
SELECT batch, {', '.join(f"round(count_if({a}) * 100.0 / count(*), 1)::DOUBLE AS {b}" for a, b in (('ordinal', 'pct_ordinal'), ('closes_ni', 'pct_ni'), ('closes_la', 'pct_la'), ('shad', 'pct_shad')))} FROM m GROUP BY batch""", "gold", "books"))  # fmt: skip
def lexical_markers(t):
    return A.lexical_markers(gold_texts(t))


_FLAGS = f"fl AS (SELECT doc_id, seg_idx, s, e, batch, NOT (pc = '' OR {_b('pc')}) AS ds, NOT {_b('lc')} AS de, seg FROM bt)"
_RAW_FLAGS = f"{ST.format('raw')}, {BATCH_TEXT}, {_FLAGS}"


def raw_flags(t: Tables):
    spans = t.raw().join(t.books().select("doc_id", "batch"), "doc_id").select("doc_id", "seg_idx", "s", "e", "batch")
    return A.with_boundary_flags(attach_text(spans, t.texts()))


@query(sql(f"WITH {_RAW_FLAGS} SELECT coalesce(batch, 'combined') AS batch, count(*) AS total, count_if(ds)::BIGINT AS n_start, count_if(de)::BIGINT AS n_end, count_if(ds OR de)::BIGINT AS n_either FROM fl GROUP BY ROLLUP (batch)", "raw", "books"))
def boundary_report(t):
    return A.boundary_report(raw_flags(t))


@query(sql(f"WITH {_RAW_FLAGS} SELECT doc_id, seg_idx, s, e, ds AS dirty_start, de AS dirty_end FROM fl WHERE ds OR de", "raw", "books"))
def dirty_spans(t):
    return A.dirty_spans(raw_flags(t)).select("doc_id", "seg_idx", "s", "e", "dirty_start", "dirty_end")


@query(sql(f"""WITH {_STX}, {_FLAGS}, {NEXT.format('gold')},
fr AS (SELECT nx.doc_id, nx.seg_idx, coalesce(next_s >= e AND regexp_matches(substring(d.text, e + 1, next_s - e), '^[ \\n.,!]*$'), false) AS frag_next FROM nx JOIN documents d ON d.doc_id = nx.doc_id),
ov AS (SELECT g.doc_id, g.seg_idx, string_agg(DISTINCT o.layer, '|' ORDER BY o.layer) AS layers FROM gold g JOIN other o ON g.doc_id = o.doc_id AND o.s < g.e AND g.s < o.e GROUP BY 1, 2)
SELECT fl.doc_id, batch, s, e, e - s AS length, ds AS dirty_start, de AS dirty_end, frag_next, coalesce(layers, '') AS layers, replace(left(seg, 80), E'\\n', ' ') AS preview
FROM fl JOIN fr ON fl.doc_id = fr.doc_id AND fl.seg_idx = fr.seg_idx LEFT JOIN ov ON fl.doc_id = ov.doc_id AND fl.seg_idx = ov.seg_idx""", "gold", "other", "books"))  # fmt: skip
def span_audit(t):
    return A.span_audit(gold_batch(t), t.other(), t.texts())


PROFILE = """bp AS (SELECT b.doc_id, b.batch, count(*) AS n_spans, any_value(b.n_chars) AS n_chars, round(count(*) * 100000.0 / greatest(any_value(b.n_chars), 1), 2)::DOUBLE AS per_100k, sum(e - s)::BIGINT AS span_chars
  FROM books b JOIN gold g ON b.doc_id = g.doc_id GROUP BY b.doc_id, b.batch)"""


@query(sql(f"""WITH {FOUND}, {PROFILE}, rp AS (SELECT doc_id, count(DISTINCT needle_id) AS c FROM found GROUP BY doc_id), o AS (SELECT doc_id, bool_or(layer = 'quote') AS q, count_if(layer = 'chapter') AS c FROM other GROUP BY doc_id)
SELECT bp.*, coalesce(q, false) AS has_quote, coalesce(o.c, 0)::BIGINT AS n_chapter, coalesce(split, '') AS split, coalesce(rp.c, 0)::BIGINT AS n_long_repeated FROM bp LEFT JOIN rp ON rp.doc_id = bp.doc_id LEFT JOIN o ON o.doc_id = bp.doc_id LEFT JOIN prior ON prior.doc_id = bp.doc_id""", "gold", "other", "books", "prior"))  # fmt: skip
def book_profile(t):
    from ..operators import sharing
    from .q_sharing import needles_held

    # one match a needle tells that it is repeated
    return A.book_profile(t.books(), t.gold(), t.other(), t.prior(), Latin(sharing).one_match(*needles_held(t)))


@query(sql(f"""WITH {PROFILE}, q AS (SELECT batch, count(*) AS n, list(n_spans ORDER BY n_spans) AS l, list(per_100k ORDER BY per_100k) AS l2, median(n_spans) AS m1, median(per_100k) AS m2, count_if(n_spans < 10) AS n_lt10, count_if(per_100k < 5) AS n_lt5 FROM bp GROUP BY batch)
SELECT batch, n, ({exact_quantile(10, 'l')})::DOUBLE AS spans_p10, round(({exact_quantile(10, 'l2').replace('l[', 'l2[')})::DOUBLE, 4) AS density_p10, m1::DOUBLE AS spans_median, round(m2::DOUBLE, 4) AS density_median, n_lt10::BIGINT AS n_lt10, n_lt5::BIGINT AS n_lt5 FROM q""", "gold", "books"))  # fmt: skip
def density_summary(t):
    df = A.density_summary(A.book_profile(t.books(), t.gold(), t.other(), t.prior()))
    return df.select("batch", "n", F.col("spans_p10").cast("double").alias("spans_p10"), "density_p10", "spans_median", "density_median", "n_lt10", "n_lt5")


@query(sql(r"""WITH """ + _STX + r""", y AS (SELECT batch, list_filter(string_split_regex(seg, '[ \n.,!]+'), lambda x: x <> '') AS y FROM bt),
p AS (SELECT batch, 'first' AS place, y[1] AS syl FROM y UNION ALL SELECT batch, 'last', y[-1] FROM y),
c AS (SELECT batch, place, syl, count(*) AS n FROM p WHERE syl IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY batch, place ORDER BY n DESC, syl) AS rank FROM c), z AS (SELECT batch, count(*) AS z FROM y GROUP BY 1)
SELECT r.batch, place, rank, syl, n, round(n * 100.0 / z, 1)::DOUBLE AS pct FROM r JOIN z ON r.batch = z.batch WHERE rank <= 8""", "gold", "books"))  # fmt: skip
def top_syllables(t):
    return A.top_syllables(gold_texts(t))


@query(sql("SELECT DISTINCT doc_id FROM other WHERE layer IN ('quote') AND doc_id NOT IN (SELECT doc_id FROM gold)", "gold", "other"))
def books_missing_layer(t):
    return A.books_missing_layer(t.other(), t.gold(), ["quote"])


@query(sql(f"WITH {ST.format('gold')} SELECT doc_id, count(*) AS n, count_if({heading_sql()})::BIGINT AS n_heading, round(count_if({heading_sql()}) / count(*), 6) AS heading_rate FROM st GROUP BY doc_id", "gold"))
def heading_rate(t):
    texts = attach_text(t.gold().select("doc_id", "seg_idx", "s", "e"), t.texts())
    return A.heading_rates(texts, LATIN).withColumn("heading_rate", F.round("heading_rate", 6))


MERGE = """m0 AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {0}),
mi AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM m0),
merged AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM mi GROUP BY doc_id, isl)"""


@query(sql(f"WITH {MERGE.format('pred')} SELECT doc_id, s, e FROM merged", "pred"))
def merge_intervals(t):
    return I.merge_intervals(t.pred(), "doc_id")


@query(sql(f"WITH {NEXT.format('pred')} SELECT doc_id, pred_ix, s, CASE WHEN next_s < e THEN next_s ELSE e END AS e, CASE WHEN next_s < e THEN 'keep|trim_overlap' ELSE 'keep' END AS action FROM nx", "pred"))
def trim_overlaps(t):
    return I.trim_overlaps(t.pred().withColumn("action", F.lit("keep")), "doc_id").select("doc_id", "pred_ix", "s", "e", "action")


@query(sql("""WITH o AS (SELECT doc_id, s, e, CASE WHEN doc_id % 10 = 0 AND seg_idx < 20 THEN -12 WHEN doc_id % 10 = 0 THEN -17 WHEN seg_idx % 5 = 0 THEN -1 ELSE 0 END AS o FROM raw),
l AS (SELECT *, lag(o) OVER (PARTITION BY doc_id ORDER BY s, e) AS p FROM o)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 + coalesce(count_if(p <> o), 0) ELSE 0 END::BIGINT AS n_offset_segments FROM l GROUP BY doc_id""", "raw"))  # fmt: skip
def offset_segments(t):
    offset = F.when((F.col("doc_id") % 10 == 0) & (F.col("seg_idx") < 20), -12).when(F.col("doc_id") % 10 == 0, -17).when(F.col("seg_idx") % 5 == 0, -1).otherwise(0)
    return I.offset_segments(t.raw().withColumn("offset", offset), "doc_id", realigned=F.col("doc_id") % 2 == 0).withColumn("n_offset_segments", F.col("n_offset_segments").cast("long"))


@query(sql("SELECT doc_id, seg_idx, s, e FROM gold", "gold"))
def assert_no_overlap(t):
    return I.assert_no_overlap(t.gold().select("doc_id", "seg_idx", "s", "e"), "doc_id")


# pred spans as the lower layer (an id for each), chapter spans and gold as the higher one
LOW = "low AS (SELECT doc_id, pred_ix AS ann_id, s, e FROM pred), high AS (SELECT doc_id, s, e FROM seg WHERE (doc_id * 31 + seg_idx * 7) % 4 = 0 AND seg_idx % 2 = 0 UNION ALL SELECT doc_id, s + 3, s + 9 FROM seg WHERE (doc_id * 31 + seg_idx * 7) % 4 = 0 AND seg_idx % 2 = 1)"
SUBTRACT = f"""{LOW}, {MERGE.format('high')},
ht AS (SELECT l.doc_id, ann_id, l.s, l.e, greatest(l.s, m.s) AS bs, least(l.e, m.e) AS be FROM low l JOIN merged m ON l.doc_id = m.doc_id AND m.s < l.e AND l.s < m.e),
pt AS (SELECT doc_id, ann_id, s, e, bs, be FROM ht UNION ALL SELECT doc_id, ann_id, s, e, e, e FROM low),
gp AS (SELECT doc_id, ann_id, s, e, coalesce(lag(be) OVER (PARTITION BY doc_id, ann_id ORDER BY bs, be), s) AS ps, bs AS pe FROM pt),
ls AS (SELECT doc_id, ann_id, sum(be - bs)::BIGINT AS lost FROM ht GROUP BY 1, 2),
pc AS (SELECT gp.doc_id, gp.ann_id, ps AS s, pe AS e, coalesce(lost, 0)::BIGINT AS lost, lost IS NOT NULL AS touched, row_number() OVER (PARTITION BY gp.doc_id, gp.ann_id ORDER BY ps) - 1 AS k FROM gp LEFT JOIN ls ON ls.doc_id = gp.doc_id AND ls.ann_id = gp.ann_id WHERE pe > ps)"""


def low_high(t: Tables):
    gold = t.gold()
    high = gold.filter("seg_idx % 2 = 0").select("doc_id", "s", "e").union(gold.filter("seg_idx % 2 = 1").selectExpr("doc_id", "s + 3", "s + 9"))
    return t.pred().select("doc_id", F.col("pred_ix").alias("ann_id"), "s", "e"), high


@query(sql(f"WITH {SUBTRACT} SELECT doc_id, ann_id || CASE WHEN k > 0 THEN '#' || k ELSE '' END AS ann_id, s, e, lost, touched FROM pc", "pred"))
def subtract_intervals(t):
    return I.subtract_intervals(*low_high(t))


@query(sql(f"""WITH {SUBTRACT}, n AS (SELECT doc_id, ann_id, count(*) AS n FROM pc GROUP BY 1, 2), j AS (SELECT low.doc_id, coalesce(n, 0) AS n, lost FROM low LEFT JOIN n ON n.doc_id = low.doc_id AND n.ann_id = low.ann_id LEFT JOIN ls ON ls.doc_id = low.doc_id AND ls.ann_id = low.ann_id)
SELECT count(*) AS quote_spans_in, count_if(lost IS NOT NULL)::BIGINT AS quote_spans_touched, count_if(lost IS NOT NULL AND n > 0)::BIGINT AS quote_spans_clipped, count_if(lost IS NOT NULL AND n > 1)::BIGINT AS quote_spans_fragmented,
  count_if(lost IS NOT NULL AND n = 0)::BIGINT AS quote_spans_dropped, sum(n)::BIGINT AS quote_spans_out, coalesce(sum(lost), 0)::BIGINT AS chars_suppressed,
  (SELECT count(*) FROM tok WHERE EXISTS (SELECT 1 FROM low WHERE low.doc_id = tok.doc_id AND low.s <= tok.s AND tok.s < low.e) AND EXISTS (SELECT 1 FROM high h WHERE h.doc_id = tok.doc_id AND h.s <= tok.s AND tok.s < h.e)) AS tokens_suppressed FROM j""", "pred", "tok"))  # fmt: skip
def precedence_stats(t):
    low, high = low_high(t)
    return I.precedence_stats(high, low, tokens=t.tok().select("doc_id", "tok_ix", "s", "e"))


# quote spans are disjoint, as the higher layer is: nothing may overlap in the result
@query(sql(f"""WITH high AS (SELECT doc_id, seg_idx AS ann_id, s + 4 AS s, e + 3 AS e FROM gold), low AS (SELECT doc_id, seg_idx AS ann_id, s, e FROM seg WHERE (doc_id * 31 + seg_idx * 7) % 4 IN (0, 1)), {SUBTRACT[len(LOW) + 2:]}
SELECT doc_id, ann_id::VARCHAR AS ann_id, s, e, 'ROOT' AS cls FROM high UNION ALL SELECT doc_id, ann_id || CASE WHEN k > 0 THEN '#' || k ELSE '' END, s, e, 'QUOTE' FROM pc""", "gold"))  # fmt: skip
def apply_precedence(t):
    high = t.gold().selectExpr("doc_id", "seg_idx AS ann_id", "s + 4 AS s", "e + 3 AS e")
    low = t.seg().filter("(doc_id * 31 + seg_idx * 7) % 4 IN (0, 1)").selectExpr("doc_id", "seg_idx AS ann_id", "s", "e")
    return I.apply_precedence(high, low).select("doc_id", "ann_id", "s", "e", "cls")


@query(sql(r"""WITH g AS (SELECT *, lag(e) OVER (PARTITION BY doc_id ORDER BY s, e) AS pe FROM seg),
f AS (SELECT g.doc_id, s, e, CASE WHEN pe <= s AND regexp_matches(substring(d.text, pe + 1, s - pe), '^[ \n.,!]*$') AND s - pe < 3 THEN 0 WHEN pe <= s AND regexp_matches(substring(d.text, pe + 1, s - pe), '^[ \n.,!]*$') THEN 0 ELSE 1 END AS nw FROM g JOIN documents d ON d.doc_id = g.doc_id),
i AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM f) SELECT doc_id, min(s) AS s, max(e) AS e, count(*) AS n_merged FROM i GROUP BY doc_id, isl""", "seg"))  # fmt: skip
def merge_adjacent(t):
    return I.merge_adjacent(t.seg(), t.texts(), LATIN)
