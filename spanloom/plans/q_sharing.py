"""Queries of shared text, groups and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import groups as G
from ..operators import sharing
from ..operators.spans import attach_text
from ..operators.tables import stage
from .fixtures import Tables, collector, sql
from .latin import Latin
from .q_text import NORM_SQL, ST

H = Latin(sharing)
QUERIES: dict = {}
ORACLES: dict = {}
query = collector(QUERIES, ORACLES)

# DuckDB finds the needles by plain containment in every other text
NEEDLES = rf"""{ST.format('gold')}, nd AS (SELECT doc_id, seg_idx AS needle_id, regexp_replace(seg, '\s+', ' ', 'g') AS nd, e - s AS len FROM st WHERE e - s >= 40),
ndl AS MATERIALIZED (SELECT * FROM nd WHERE len(list_filter(string_split_regex(nd, '[ \n.,!]+'), lambda x: x <> '')) >= 8)"""
# texts meet needles on the needle's first 24 characters at any place: windows of texts are hashed
FOUND = rf"""{NEEDLES}, sx AS MATERIALIZED (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS t FROM documents),
gr AS MATERIALIZED (SELECT DISTINCT doc_id, substring(t, i, 24) AS g FROM (SELECT doc_id, t, unnest(generate_series(1, length(t) - 23)) AS i FROM sx)),
fc AS MATERIALIZED (SELECT n.doc_id, n.needle_id, n.nd, gr.doc_id AS other FROM ndl n JOIN gr ON substring(n.nd, 1, 24) = gr.g AND gr.doc_id <> n.doc_id),
found AS MATERIALIZED (SELECT fc.doc_id, needle_id, other FROM fc JOIN sx ON sx.doc_id = fc.other WHERE contains(sx.t, fc.nd))"""
SHARES = f"""{FOUND}, tt AS (SELECT doc_id, sum(len) AS tot FROM ndl GROUP BY 1),
sh AS MATERIALIZED (SELECT f.doc_id AS a, f.other AS b, sum(len)::BIGINT AS chars, count(*) AS n_shared, sum(len)::DOUBLE / any_value(tot)::DOUBLE AS share FROM found f JOIN ndl n ON n.doc_id = f.doc_id AND n.needle_id = f.needle_id JOIN tt ON tt.doc_id = f.doc_id GROUP BY 1, 2)"""
LINKS = f"{SHARES}, lk AS MATERIALIZED (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM sh WHERE (share >= 0.1 AND n_shared >= 2) OR n_shared >= 10)"


def rows(t: Tables):
    return stage(H.needles(t.gold(), t.texts()).drop("syl"))


def needles_held(t: Tables):
    """The needles, with digests for their texts, and the books that hold them: matches are expanded from them only where a query
    returns them."""
    n = rows(t)
    return H.keyed(n), stage(H.held(n, t.texts()))


def linking(t: Tables, rule: str = "split"):
    n, h = needles_held(t)
    return H.linked_books(n, h, rule)


@query(sql(f"WITH {NEEDLES} SELECT doc_id, needle_id, md5(nd) AS digest, len FROM ndl", "gold"))
def needles(t):
    return H.needles(t.gold(), t.texts()).select("doc_id", "needle_id", F.md5(F.col("nd").cast("binary")).alias("digest"), "len")


@query(sql(f"WITH {FOUND} SELECT doc_id, needle_id, other FROM found", "gold"))
def verbatim_matches(t):
    return H.verbatim_matches(rows(t), t.texts())


@query(sql(f"WITH {SHARES} SELECT a, b, chars, n_shared, round(share, 6) AS share FROM sh", "gold"))
def pair_share(t):
    return H.shares_of(*needles_held(t)).withColumn("share", F.round("share", 6))


@query(sql(f"WITH {LINKS} SELECT a, b FROM lk", "gold"))
def link_books(t):
    return linking(t)


@query(sql(f"WITH {SHARES} SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM sh WHERE share >= 0.1", "gold"))
def link_books_audit(t):
    return linking(t, "audit")


@query(sql(f"WITH {LINKS} SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM sh WHERE share >= 0.1 AND n_shared < 2 EXCEPT SELECT a, b FROM lk", "gold"))
def boilerplate_links(t):
    n, h = needles_held(t)
    return H.boilerplate_links(H.linking_shares(n, h, "audit"), H.link_books(H.linking_shares(n, h)))


@query(sql(f"""WITH {FOUND}, l AS (SELECT DISTINCT f.doc_id, f.needle_id FROM found f JOIN prior p ON p.doc_id = f.other AND p.split = 'train')
SELECT p.split, count(*) AS n_long, count(l.doc_id) AS n_in_train, round(count(l.doc_id) * 100.0 / count(*), 2)::DOUBLE AS pct FROM ndl n JOIN prior p ON p.doc_id = n.doc_id AND p.split <> 'train' LEFT JOIN l ON l.doc_id = n.doc_id AND l.needle_id = n.needle_id GROUP BY p.split""", "gold", "prior"))  # fmt: skip
def leakage_rate(t):
    n, h = needles_held(t)
    train = t.prior().filter("split = 'train'").select(F.col("doc_id").alias("other"))
    return H.leakage_rate(n, H.one_match(n, h.join(train, "other", "left_semi")), t.prior())


@query(sql(f"""WITH {FOUND}, l AS (SELECT DISTINCT doc_id, needle_id FROM found)
SELECT coalesce(batch, 'all') AS batch, count(*) AS n_long, count(l.doc_id) AS n_repeated, round(count(l.doc_id) * 100.0 / count(*), 1)::DOUBLE AS pct FROM ndl n JOIN books b ON b.doc_id = n.doc_id LEFT JOIN l ON l.doc_id = n.doc_id AND l.needle_id = n.needle_id GROUP BY ROLLUP (batch)""", "gold", "books"))  # fmt: skip
def repeat_rate(t):
    n, h = needles_held(t)
    return H.repeat_rate(n, H.one_match(n, h), t.books())


# every gold span of the test books against every train text
@query(sql(rf"""WITH {ST.format('gold')}, own AS MATERIALIZED (SELECT regexp_replace(seg, '\s+', ' ', 'g') AS nd, e - s AS len FROM st JOIN prior p ON p.doc_id = st.doc_id AND p.split = 'test'),
tr AS MATERIALIZED (SELECT regexp_replace(text, '\s+', ' ', 'g') AS t FROM documents d JOIN prior p ON p.doc_id = d.doc_id AND p.split = 'train'),
hc AS (SELECT nd, count(*) AS c FROM (SELECT DISTINCT nd FROM own) o JOIN tr ON contains(tr.t, o.nd) GROUP BY nd), r AS (SELECT len, coalesce(c, 0) AS c FROM own LEFT JOIN hc ON hc.nd = own.nd)
SELECT CASE WHEN c = 0 THEN '0' WHEN c <= 2 THEN '1-2' WHEN c <= 9 THEN '3-9' ELSE '10+' END AS spread, count(*) AS n, count_if(len < 15)::BIGINT AS n_short FROM r GROUP BY 1""", "gold", "prior"))  # fmt: skip
def leakage_by_spread(t):
    return H.leakage_by_spread(t.gold().select("doc_id", "seg_idx", "s", "e"), t.texts(), t.prior())


@query(sql(f"WITH {ST.format('gold')}, c AS (SELECT {NORM_SQL} AS t, count(*) AS n FROM st GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, t) AS r FROM c) SELECT sum(n)::BIGINT AS n_spans, count(*) AS n_distinct, count_if(n = 1)::BIGINT AS n_single, sum(n) FILTER (WHERE r <= 10)::BIGINT AS top10, sum(n) FILTER (WHERE r <= 100)::BIGINT AS top100, max(CASE WHEN r = 1 THEN t END) AS most_common FROM r", "gold"))
def span_diversity(t):
    return H.span_diversity(attach_text(t.gold().select("doc_id", "seg_idx", "s", "e"), t.texts(), context=0))


_ANCHOR = r"(?:The|And|Die|Der|De|La|In)[^.]{0,200}?on"
# DuckDB's matches carry no offsets: texts between matches give them
ANCHORS = rf"""am AS (SELECT doc_id, text, regexp_extract_all(text, '{_ANCHOR}') AS m, string_split_regex(text, '{_ANCHOR}') AS b FROM documents),
ap AS (SELECT doc_id, i, b[i] AS gap, m[i] AS hit FROM (SELECT doc_id, m, b, unnest(generate_series(1, len(m))) AS i FROM am)),
an AS (SELECT doc_id, (coalesce(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(gap))::BIGINT AS s, length(hit) AS len FROM ap)"""


@query(f"WITH {ANCHORS} SELECT doc_id, s, s + len AS e FROM an")
def find_anchors(t):
    return H.anchors(t.texts())


@query(sql(f"WITH {ANCHORS}, h AS (SELECT an.*, EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = an.doc_id AND g.s < an.s + len AND an.s < g.e) AS hit FROM an) SELECT doc_id, count(*) AS n_anchors, count_if(hit)::BIGINT AS n_annotated, round(count_if(hit) / count(*), 6) AS recall FROM h GROUP BY ROLLUP (doc_id)", "gold"))
def anchor_recall(t):
    return H.anchor_recall(H.anchors(t.texts()), t.gold())


# groups: walk the links and prior groups from every book
GROUPS = f"""{LINKS}, ed AS MATERIALIZED (SELECT a, b FROM lk UNION SELECT b, a FROM lk UNION SELECT x.doc_id, y.doc_id FROM prior x JOIN prior y ON x.group_id = y.group_id AND x.doc_id <> y.doc_id),
wk AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT ed.b, wk.r FROM wk JOIN ed ON ed.a = wk.v), gp AS MATERIALIZED (SELECT v AS doc_id, min(r) AS group_id FROM wk GROUP BY v),
fx AS MATERIALIZED (SELECT group_id, min_by(split, CASE split WHEN 'test' THEN 0 WHEN 'val' THEN 1 ELSE 2 END) AS split, count(DISTINCT split) AS n_splits FROM gp JOIN prior USING (doc_id) GROUP BY group_id)"""
GROUPS = GROUPS.replace("FROM gp JOIN prior USING (doc_id) GROUP BY group_id", "FROM (SELECT gp.group_id, prior.split FROM gp JOIN prior ON prior.doc_id = gp.doc_id) GROUP BY group_id")


def links(t: Tables):
    return stage(linking(t))


def connecting(t: Tables):
    """What groups need of the links: pairs that connect the same books."""
    return stage(H.connecting_links(*needles_held(t)))


@query(sql(f"WITH {GROUPS} SELECT doc_id, group_id FROM gp", "gold", "prior", recursive=True))
def connected_groups(t):
    return G.connected_groups(t.books(), connecting(t), t.prior())


@query(sql(f"WITH {GROUPS} SELECT group_id, split, n_splits FROM fx", "gold", "prior", recursive=True))
def resolve_fixed_splits(t):
    return G.resolve_fixed_splits(G.connected_groups(t.books(), connecting(t), t.prior()), t.prior())


@query(sql(f"WITH {GROUPS} SELECT gp.doc_id, p.split AS was, fx.split FROM gp JOIN prior p ON p.doc_id = gp.doc_id JOIN fx ON fx.group_id = gp.group_id WHERE p.split <> fx.split", "gold", "prior", recursive=True))
def moved_books(t):
    g = stage(G.connected_groups(t.books(), connecting(t), t.prior()))
    return G.moved_books(g, G.resolve_fixed_splits(g, t.prior()), t.prior())


def weighted(t: Tables):
    return t.books().withColumn("weight", F.ceil(F.col("n_chars") / 500).cast("long"))


# free groups one after the other, with what each split holds so far
PLACE = f"""{GROUPS}, sz AS MATERIALIZED (SELECT gp.group_id, sum(ceil(n_chars / 500))::BIGINT AS weight FROM gp JOIN documents d ON d.doc_id = gp.doc_id GROUP BY 1),
fr AS MATERIALIZED (SELECT group_id, weight, row_number() OVER (ORDER BY weight DESC, md5('123|' || group_id)) AS k FROM sz WHERE group_id NOT IN (SELECT group_id FROM fx)),
c0 AS (SELECT coalesce(sum(weight) FILTER (WHERE split = 'train'), 0)::DOUBLE AS a, coalesce(sum(weight) FILTER (WHERE split = 'val'), 0)::DOUBLE AS b, coalesce(sum(weight) FILTER (WHERE split = 'test'), 0)::DOUBLE AS c FROM sz JOIN fx ON fx.group_id = sz.group_id),
tw AS MATERIALIZED (SELECT sum(weight)::DOUBLE AS w FROM sz),
pl AS (SELECT 0::BIGINT AS k, 0::BIGINT AS group_id, '' AS split, a, b, c FROM c0
 UNION ALL SELECT k, group_id, pick, CASE WHEN pick = 'train' THEN a + weight ELSE a END, CASE WHEN pick = 'val' THEN b + weight ELSE b END, CASE WHEN pick = 'test' THEN c + weight ELSE c END
 FROM (SELECT f.k, f.group_id, weight, a, b, c, CASE WHEN (0.83::DOUBLE * w - a) / 0.83::DOUBLE >= (0.085::DOUBLE * w - b) / 0.085::DOUBLE AND (0.83::DOUBLE * w - a) / 0.83::DOUBLE >= (0.085::DOUBLE * w - c) / 0.085::DOUBLE THEN 'train' WHEN (0.085::DOUBLE * w - b) / 0.085::DOUBLE >= (0.085::DOUBLE * w - c) / 0.085::DOUBLE THEN 'val' ELSE 'test' END AS pick
  FROM pl JOIN fr f ON f.k = pl.k + 1, tw)),
asg AS (SELECT group_id, split FROM fx UNION ALL SELECT group_id, split FROM pl WHERE k > 0), spl AS (SELECT gp.doc_id, asg.split, gp.group_id FROM gp JOIN asg ON asg.group_id = gp.group_id)"""


def split_of(t: Tables):
    return G.leak_aware_split(weighted(t), connecting(t), t.prior())


@query(sql(f"WITH {PLACE} SELECT group_id, split FROM pl WHERE k > 0", "gold", "prior", recursive=True))
def assign_free_groups(t):
    prior = t.prior()
    groups = stage(G.connected_groups(t.books(), connecting(t), prior))
    sized = groups.join(weighted(t).select("doc_id", "weight"), "doc_id").groupBy("group_id").agg(F.sum("weight").alias("weight")).join(G.resolve_fixed_splits(groups, prior), "group_id", "left")
    sized = stage(sized)
    current = {r["split"]: r["w"] for r in sized.filter("split IS NOT NULL").groupBy("split").agg(F.sum("weight").alias("w")).collect()}
    return G.assign_free_groups(sized.filter("split IS NULL").select("group_id", "weight"), current)


@query(sql(f"WITH {PLACE} SELECT doc_id, split, group_id FROM spl", "gold", "prior", recursive=True))
def leak_aware_split(t):
    return split_of(t)


@query(sql(f"""WITH {PLACE}, sn AS (SELECT doc_id, count(*) AS n FROM gold GROUP BY 1), j AS (SELECT s.split, b.batch, ceil(b.n_chars / 500)::BIGINT AS weight, coalesce(n, 0) AS n, p.doc_id AS p FROM spl s JOIN books b ON b.doc_id = s.doc_id LEFT JOIN sn ON sn.doc_id = s.doc_id LEFT JOIN prior p ON p.doc_id = s.doc_id)
SELECT split, count(*) AS books, count_if(batch = 'old')::BIGINT AS old, count_if(batch = 'new')::BIGINT AS new, sum(weight)::BIGINT AS windows, sum(n)::BIGINT AS spans, count(p) AS inherited, round(sum(weight) * 100.0 / sum(sum(weight)) OVER (), 1)::DOUBLE AS pct_windows FROM j GROUP BY split""", "gold", "books", "prior", recursive=True))  # fmt: skip
def split_stats(t):
    return G.split_stats(split_of(t), weighted(t), t.gold(), t.prior())


@query(sql(f"WITH {LINKS} SELECT a, b, x.split AS split_a, y.split AS split_b FROM lk LEFT JOIN prior x ON x.doc_id = a LEFT JOIN prior y ON y.doc_id = b WHERE x.split IS DISTINCT FROM y.split", "gold", "prior"))
def straddling_links(t):
    return G.straddling_links(links(t), t.prior())


@query(sql(f"""WITH {LINKS}, pr AS (SELECT DISTINCT least(doc_id, other) AS a, greatest(doc_id, other) AS b FROM found), wy AS (SELECT DISTINCT doc_id AS a, other AS b FROM found)
SELECT 'difference' AS kind, a, b FROM (SELECT a, b FROM lk EXCEPT SELECT a, b FROM pr) UNION ALL SELECT 'not_linked', a, b FROM (SELECT a, b FROM pr EXCEPT SELECT a, b FROM lk)
UNION ALL SELECT 'both_ways', a, b FROM wy WHERE a < b AND EXISTS (SELECT 1 FROM wy z WHERE z.a = wy.b AND z.b = wy.a) UNION ALL SELECT 'held', doc_id, NULL FROM (SELECT doc_id FROM prior INTERSECT SELECT other FROM found)""", "gold", "prior"))  # fmt: skip
def link_sets(t):
    n, h = needles_held(t)
    return G.link_sets(H.link_books(H.linking_shares(n, h)), H.expand(n, h), t.prior(), holding=H.holding_books(n, h))


@query("""WITH e AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS q2, quantile_cont(n_chars, 0.75) AS q3, min(n_chars) AS lo FROM documents),
st AS (SELECT doc_id, len(list_distinct(list_filter([q1, q2, q3], lambda x: x < n_chars AND x > lo)))::INT AS stratum, md5('42|' || doc_id) AS k FROM documents, e),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY k, doc_id) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM st),
c AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, round_even(n * 0.1, 0)) ELSE round_even(n * 0.1, 0) END AS w FROM r)
SELECT doc_id, stratum, CASE WHEN r <= w THEN 'test' WHEN r <= 2 * w THEN 'val' ELSE 'train' END AS split FROM c""")
def stratified_split(t):
    return G.stratified_split(t.documents().select("doc_id", "n_chars"), "n_chars")
