"""Queries of the scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators.spans import attach_text
from .fixtures import Tables, collector, sql
from .latin import LATIN, Latin

T = Latin(text)
QUERIES: dict = {}
ORACLES: dict = {}


query = collector(QUERIES, ORACLES)


#: Fixed: the boundary characters and word lists of the Latin profile, for DuckDB.
_B = r"E' \n.,!?()[]'"
_STARTS = "'The', 'And', 'Die', 'Der', 'De', 'La', 'In'"


def _b(ch: str) -> str:
    return f"({ch} <> '' AND contains({_B}, {ch}))"


# spans with text, the characters around, and n
ST = """st AS (SELECT g.doc_id, g.seg_idx, g.s, g.e, d.n_chars AS n, d.text AS t, substring(d.text, g.s + 1, g.e - g.s) AS seg,
  CASE WHEN g.s > 0 THEN substring(d.text, g.s, 1) ELSE '' END AS pc, substring(d.text, g.e, 1) AS lc, substring(d.text, g.s + 1, 1) AS fc, substring(d.text, g.e + 1, 1) AS nc
  FROM {0} g JOIN documents d ON d.doc_id = g.doc_id)"""


def _texts(t: Tables, name: str = "gold"):
    return attach_text(getattr(t, name)().select("doc_id", "seg_idx", "s", "e"), t.texts())


@query("SELECT doc_id, CASE WHEN trim(source) <> '' AND doc_id % 3 = 0 THEN source WHEN starts_with(id, 'P') THEN 'old' WHEN starts_with(id, 'I') THEN 'new' ELSE 'unknown' END AS batch FROM (SELECT *, ['P', 'I', 'X'][1 + doc_id % 3] || doc_id AS id FROM documents)")
def infer_batch(t):
    ids = F.concat(F.get(F.array(F.lit("P"), F.lit("I"), F.lit("X")), (F.col("doc_id") % 3).cast("int")), F.col("doc_id").cast("string"))
    return t.documents().select("doc_id", T.infer_batch(ids, F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.lit("  "))).alias("batch"))


@query(sql("SELECT g.doc_id, seg_idx, substring(text, s + 1, e - s) AS seg FROM gold g JOIN documents d ON d.doc_id = g.doc_id", "gold"))
def span_text(t):
    return _texts(t).select("doc_id", "seg_idx", "seg")


@query(r"SELECT doc_id, length(regexp_replace(text, '\s+', '', 'g'))::BIGINT AS n_solid, md5(regexp_replace(text, '\s+', '', 'g')) AS digest FROM documents")
def strip_ws(t):
    bare = T.strip_ws(F.col("text"))
    return t.documents().select("doc_id", F.length(bare).cast("long").alias("n_solid"), F.md5(bare.cast("binary")).alias("digest"))


@query(r"SELECT doc_id, len(y)::BIGINT AS n, md5(array_to_string(y, '|')) AS digest FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \n.,!]+'), lambda x: x <> '') AS y FROM documents)")
def syllables(t):
    y = T.syllables(F.col("text"))
    return t.documents().select("doc_id", F.size(y).cast("long").alias("n"), F.md5(F.array_join(y, "|").cast("binary")).alias("digest"))


_ESC = r"replace({0}, E'\n', '\n')"


@query(sql(f"WITH {ST.format('raw')} SELECT doc_id, seg_idx, pc = '' OR {_b('pc')} AS start_clean, {_b('lc')} AS end_clean, {_ESC.format('pc')} AS char_before, {_ESC.format('lc')} AS char_last FROM st", "raw"))
def boundary_flags(t):
    a, b, c, d = T.boundary_flags(F.col("seg"), F.col("before"))
    return _texts(t, "raw").select("doc_id", "seg_idx", a.alias("start_clean"), b.alias("end_clean"), c.alias("char_before"), d.alias("char_last"))


_BAD_S = f"(pc <> '' AND fc <> '' AND NOT {_b('pc')} AND NOT {_b('fc')})"
_BAD_E = f"(lc <> '' AND nc <> '' AND NOT {_b('lc')} AND NOT {_b('nc')})"


@query(sql(f"WITH {ST.format('raw')} SELECT doc_id, seg_idx, {_BAD_S} AS bad_start, {_BAD_E} AS bad_end FROM st", "raw"))
def mid_syllable_flags(t):
    a, b = T.mid_syllable_flags(F.col("seg"), F.col("before"), F.col("after"))
    return _texts(t, "raw").select("doc_id", "seg_idx", a.alias("bad_start"), b.alias("bad_end"))


def snap_sql(source: str) -> str:
    """CTE ``sn``: spans of ``source`` snapped, with act."""
    back = "CASE " + " ".join(f"WHEN s = {k} OR {_b(f'CASE WHEN s > {k} THEN substring(t, s - {k}, 1) ELSE {chr(39) * 2} END')} THEN {k}" for k in (1, 2, 3)) + " END"
    forth = "CASE " + " ".join(f"WHEN e + {k} >= n OR {_b(f'substring(t, e + {k} + 1, 1)')} THEN {k}" for k in (1, 2, 3)) + " END"
    return f"""{ST.format(source)}, sk AS (SELECT *, {_BAD_S} AS bs, {_BAD_E} AS be, {back} AS ks, {forth} AS ke FROM st),
sn AS (SELECT doc_id, seg_idx, n, t, s AS raw_s, e AS raw_e, CASE WHEN bs THEN s - coalesce(ks, 0) ELSE s END AS s, CASE WHEN be THEN e + coalesce(ke, 0) ELSE e END AS e,
  concat_ws('|', CASE WHEN bs THEN coalesce('start-' || ks, 'start_unfixed') END, CASE WHEN be THEN coalesce('end+' || ke, 'end_unfixed') END) AS act FROM sk)"""


@query(sql(f"WITH {snap_sql('raw')} SELECT doc_id, seg_idx, s, e, act FROM sn", "raw"))
def snap_edges(t):
    s, e, act = T.snap_edges(F.col("s"), F.col("e"), F.col("seg"), F.col("before"), F.col("after"))
    return _texts(t, "raw").select("doc_id", "seg_idx", s.alias("s"), e.alias("e"), act.alias("act"))


def heading_sql(text: str = "t", s: str = "s", e: str = "e") -> str:
    pre = f"substring({text}, greatest({s} - 3, 0) + 1, {s} - greatest({s} - 3, 0))"
    head = f"left(substring({text}, greatest({s} - 2, 0) + 1, {e} - greatest({s} - 2, 0)), 14)"
    seg = f"substring({text}, {s} + 1, {e} - {s})"
    tail = f"(right({seg}, 4) || substring({text}, {e} + 1, 2))"
    starts = f"({s} = 0 OR ends_with({pre}, E'\\n') OR regexp_matches({pre}, '^[# ]*$') OR ends_with({pre}, E'\\n# '))"
    alone = f"regexp_matches(substring({text}, {e} + 1, 6), '\\A[. \\t\\x{{00A0}}]*(\\n|\\z)')"
    ordinal = " OR ".join(f"contains({head}, {o})" for o in _STARTS.split(", "))
    number = f"regexp_matches({seg}, '^[ \\n]*([\\(\\{{\\[] *[0-9]+ *[\\)\\}}\\]]|[0-9]+ *[\\.)])')"
    return f"({ordinal} OR contains({tail}, 'on') OR {number} OR ({starts} AND {alone}))"


@query(sql(f"WITH {ST.format('gold')} SELECT doc_id, seg_idx, {heading_sql()} AS heading FROM st", "gold"))
def heading_like(t):
    return _texts(t).select("doc_id", "seg_idx", T.heading_like(F.col("s"), F.col("seg"), F.col("before"), F.col("after")).alias("heading"))


_CORE = r"rtrim(regexp_replace(seg, '^\s+|\s+$', '', 'g'), '.  ')"
MARKERS_SQL = (
    "(" + " OR ".join(f"starts_with(ltrim(seg, '. '), {o})" for o in _STARTS.split(", ")) + ") AS ordinal",
    f"ends_with({_CORE}, 'on') AS closes_ni",
    f"(ends_with({_CORE}, 'de') OR ends_with({_CORE}, 'er')) AS closes_la",
    r"ends_with(regexp_replace(seg, '\s+$', ''), '.') AS shad",
)


@query(sql(f"WITH {ST.format('gold')} SELECT doc_id, seg_idx, {MARKERS_SQL[0]} FROM st", "gold"))
def opens_with_ordinal(t):
    return _texts(t).select("doc_id", "seg_idx", T.opens_with_ordinal(F.col("seg")).alias("ordinal"))


@query(sql(f"WITH {ST.format('gold')} SELECT doc_id, seg_idx, {MARKERS_SQL[1]}, {MARKERS_SQL[2]} FROM st", "gold"))
def closes_with(t):
    a, b = T.closes_with(F.col("seg"))
    return _texts(t).select("doc_id", "seg_idx", a.alias("closes_ni"), b.alias("closes_la"))


@query(sql(f"WITH {ST.format('raw')} SELECT doc_id, seg_idx, {MARKERS_SQL[3]} FROM st", "raw"))
def ends_with_shad(t):
    return _texts(t, "raw").select("doc_id", "seg_idx", T.ends_with_shad(F.col("seg")).alias("shad"))


_ORD_START = r"'^[ \n]*([0-9]+[.)]? *)?(The|And|Die|Der|De|La|In)'"


@query(sql(f"WITH {ST.format('gold')} SELECT doc_id, seg_idx, regexp_matches(seg, {_ORD_START}) AS ordinal FROM st", "gold"))
def ordinal_start(t):
    return _texts(t).select("doc_id", "seg_idx", T.ordinal_start(F.col("seg")).alias("ordinal"))


@query(sql(r"WITH nx AS (SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY s, e) AS s2 FROM seg) SELECT nx.doc_id, seg_idx, regexp_matches(substring(text, e + 1, s2 - e), '^[ \n.,!]*$') AS punct FROM nx JOIN documents d ON d.doc_id = nx.doc_id WHERE s2 >= e", "seg"))
def punct_gap(t):
    from ..operators.intervals import next_span

    gaps = next_span(t.seg().select("doc_id", "seg_idx", "s", "e"), "doc_id").filter("next_s >= e").select("doc_id", "seg_idx", F.col("e").alias("gs"), F.col("next_s").alias("ge"))
    return attach_text(gaps, t.texts(), s="gs", e="ge", context=0).select("doc_id", "seg_idx", T.punct_gap(F.col("seg")).alias("punct"))


@query(sql(f"WITH {snap_sql('raw')} SELECT doc_id, seg_idx, coalesce(nullif(concat_ws('|', CASE WHEN o <> 0 THEN format('shift{{:+d}}', o) END, nullif(act, '')), ''), 'keep') AS action FROM (SELECT *, CASE WHEN doc_id % 10 = 0 THEN -17 ELSE doc_id % 3 - 1 END AS o FROM sn)", "raw"))
def action_string(t):
    _, _, act = T.snap_edges(F.col("s"), F.col("e"), F.col("seg"), F.col("before"), F.col("after"))
    offset = F.when(F.col("doc_id") % 10 == 0, F.lit(-17)).otherwise(F.col("doc_id") % 3 - 1)
    return _texts(t, "raw").select("doc_id", "seg_idx", T.action_string(offset.cast("long"), act).alias("action"))


@query(sql(f"WITH {ST.format('raw')} SELECT doc_id, seg_idx, replace(left(seg, 80), E'\\n', ' ') AS preview FROM st", "raw"))
def preview(t):
    return _texts(t, "raw").select("doc_id", "seg_idx", T.preview(F.col("seg")).alias("preview"))


@query(sql("SELECT doc_id, pred_ix, s, e - 1 AS e_incl, e - 1 + 1 AS e_back FROM pred", "pred"))
def to_inclusive(t):
    return t.pred().select("doc_id", "pred_ix", "s", T.to_inclusive(F.col("e")).alias("e_incl"), T.to_half_open(T.to_inclusive(F.col("e"))).alias("e_back"))


@query(sql("SELECT g.doc_id, g.seg_idx, p.pred_ix, round(greatest(0, least(g.e, p.e) - greatest(g.s, p.s)) / ((g.e - g.s) + (p.e - p.s) - greatest(0, least(g.e, p.e) - greatest(g.s, p.s))), 6) AS iou FROM gold g JOIN pred p ON g.doc_id = p.doc_id AND p.s < g.e AND g.s < p.e", "pred"))
def iou(t):
    from ..operators.intervals import overlap_join

    met = overlap_join(t.gold().select("doc_id", "seg_idx", "s", "e"), t.pred())
    return met.select("doc_id", "seg_idx", F.col("r_pred_ix").alias("pred_ix"), F.round(T.iou(F.col("s"), F.col("e"), F.col("r_s"), F.col("r_e")), 6).alias("iou"))


CLAUSES_SQL = r"cl AS (SELECT doc_id, generate_subscripts(c, 1) - 1 AS ci, unnest(c) AS clause FROM (SELECT doc_id, CASE WHEN text = '' THEN [''] ELSE regexp_extract_all(text, '[^.!]*[.!]|[^.!]+') END AS c FROM documents))"


@query(f"WITH {CLAUSES_SQL} SELECT doc_id, ci, coalesce(sum(length(clause)) OVER (PARTITION BY doc_id ORDER BY ci ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s, length(clause)::BIGINT AS len, md5(clause) AS digest FROM cl")
def clauses(t):
    from ..operators import dataset

    df = Latin(dataset).clause_table(t.texts())
    return df.select("doc_id", "ci", "s", F.length("clause").cast("long").alias("len"), F.md5(F.col("clause").cast("binary")).alias("digest"))


N_SYL_SQL = r"len(list_filter(string_split_regex(clause, ' '), lambda x: regexp_matches(x, '\S')))"


@query(f"WITH {CLAUSES_SQL} SELECT doc_id, ci, {N_SYL_SQL}::BIGINT AS n_syl FROM cl")
def n_syllables(t):
    from ..operators import dataset

    return Latin(dataset).clause_table(t.texts()).select("doc_id", "ci", T.n_syllables(F.col("clause")).cast("long").alias("n_syl"))


LABELS_SQL = """lab AS (SELECT t.doc_id, t.tok_ix, CASE WHEN t.e <= t.s OR g.s IS NULL OR t.s >= g.e THEN 0 WHEN g.s > coalesce(lag(t.s) OVER (PARTITION BY t.doc_id ORDER BY t.tok_ix), -1) THEN 1 ELSE 2 END AS label
  FROM tok t ASOF LEFT JOIN gold g ON t.doc_id = g.doc_id AND t.s >= g.s)"""


@query(sql(f"WITH {LABELS_SQL} SELECT doc_id, count(*) AS n, count_if(label = 1 OR label = 2)::BIGINT AS n_io, count_if(label > 0 AND coalesce(nxt, -100) <> 2)::BIGINT AS n_e FROM (SELECT *, lead(label) OVER (PARTITION BY doc_id ORDER BY tok_ix) AS nxt FROM lab) GROUP BY doc_id", "gold", "tok"))
def convert_labels(t):
    from ..operators.dataset import label_in_rows, tokenize, with_spans
    from .q_decode import _places

    # texts meet their spans, and labels are made and converted in the row; books without tokens aren't listed
    df = label_in_rows(tokenize(with_spans(t.texts(), t.gold()), lambda: _places, carry=("span_s", "span_e"))).filter(F.size("labels") > 0)
    count = lambda scheme, v: F.size(F.filter(T.convert_labels(F.col("labels"), scheme), lambda x: x == v)).cast("long")
    return df.select("doc_id", F.size("labels").cast("long").alias("n"), count("io", 1).alias("n_io"), count("bioe", 3).alias("n_e"))


@query("SELECT doc_id, n_chars FROM documents WHERE source = 'src1' OR source = 'src2' ORDER BY doc_id LIMIT 50")
def select_books(t):
    from ..operators.checks import select_books as run

    return run(t.documents(), F.col("source").isin("src1", "src2"), 50).select("doc_id", "n_chars")


@query(sql("SELECT doc_id, split, group_id FROM prior WHERE NOT (split = 'train' AND doc_id % 7 = 3)", "prior"))
def exclude_books(t):
    from ..operators.checks import exclude_books as run

    prior = t.prior()
    return run(prior, prior.filter("split = 'train' AND doc_id % 7 = 3").select("doc_id")).select("doc_id", "split", "group_id")


NORM_SQL = r"trim(rtrim(regexp_replace(regexp_replace(trim(regexp_replace(seg, '\s+', ' ', 'g')), '^[#]+ ?', ''), '^[ \n]*([\(\{\[] *[0-9]+ *[\)\}\]]|[0-9]+ *[\.)])', ''), '. '))"


@query(sql(f"WITH {ST.format('raw')} SELECT doc_id, seg_idx, {NORM_SQL} AS norm FROM st", "raw"))
def normalise_span_text(t):
    return _texts(t, "raw").select("doc_id", "seg_idx", T.normalise_span_text(F.col("seg"), LATIN).alias("norm"))
