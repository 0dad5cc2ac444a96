"""Quality rules by distribution divergence, with DataFrame functions only.

Each document gets a character-class and a common-word histogram. Language references are the same
histograms summed over all documents of a language; a document whose Jensen-Shannon distance from both its
language's and the whole corpus's reference exceeds a bound is dropped, but only where it is long enough
for its histogram to mean something. Labels of languages may be wrong or rare, so the nearer reference decides: good
prose under a wrong label is near the corpus, whatever its label says. Base rules (length, repeated passages) come
first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, stage_table

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
#: Histograms of fewer words (for words) or characters (for classes) aren't judged.
MIN_WORDS_JUDGED = 100
MIN_CHARS_JUDGED = 400
#: Largest Jensen-Shannon distance (base 2, 0 to 1) that is kept.
MAX_CHAR_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.25
#: Fixed: frequent function words of English, French, German and Spanish.
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "was",
    "le", "les", "et", "des", "que", "une", "dans", "pour", "qui", "sur",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "ist", "nicht",
    "el", "los", "y", "del", "las", "por", "con", "para", "una", "se",
)
CLASSES = ("lower", "upper", "digit", "space", "point", "symbol", "wide")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def repeated_words(words: Column) -> Column:
    """Number of words inside 8-word windows that occur twice or more, the first occurrence included.

    Windows are compared by 64-bit hashes of their words; texts whose windows all differ (most) stop there.
    """
    n = F.size(words)
    hashes = F.transform(
        F.sequence(F.lit(0), n - REPEAT_WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(REPEAT_WINDOW)]),
    )
    return F.when(n < REPEAT_WINDOW + 1, F.array().cast("array<bigint>")).otherwise(hashes)


def _covered(hashes: Column) -> Column:
    """Words under the windows whose hash occurs more than once: windows sorted by (hash, position), twins kept,
    then a running union of [p, p + 8)."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return ordered


def _count_cover(ordered: Column) -> Column:
    size = F.size(ordered)
    twins = F.filter(
        F.transform(
            ordered,
            lambda x, i: F.when(
                ((i > 0) & (F.get(ordered, F.greatest(i - 1, F.lit(0)))["h"] == x["h"])) | ((i < size - 1) & (F.get(ordered, F.least(i + 1, size - 1))["h"] == x["h"])),
                x["p"],
            ),
        ),
        lambda p: p.isNotNull(),
    )
    start = F.struct(F.lit(-REPEAT_WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(
        F.array_sort(twins),
        start,
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(REPEAT_WINDOW), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, lang, base counts and both histograms of every whole text (null: empty)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), text.alias("_t"), _words(text).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    df = df.select("*", lines.alias("_l"), repeated_words(F.col("_w")).alias("_h"), F.array_join("_w", "").alias("_j"))
    df = df.withColumn("_same", F.size("_h") == F.size(F.array_distinct("_h")))
    # only texts with a repeated window are sorted
    df = df.withColumn("_o", F.when(F.col("_same"), F.array().cast("array<struct<h:bigint,p:int>>")).otherwise(_covered(F.col("_h"))))
    common = F.filter("_w", lambda w: w.isin(*COMMON_WORDS))
    chars, solid = F.length("_t"), F.length("_j")
    df = df.select(
        "_id", "_lang",
        F.size("_w").cast("long").alias("n_words"),
        solid.cast("long").alias("word_chars"),
        F.regexp_count("_j", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_same"), F.lit(0)).otherwise(_count_cover(F.col("_o"))).cast("long").alias("n_repeat_words"),
        F.regexp_count("_j", F.lit("[A-Z]")).alias("_upper"),
        F.regexp_count("_j", F.lit("[0-9]")).alias("_digit"),
        F.regexp_count("_j", F.lit(r"""[.,;:!?'"()\-]""")).alias("_point"),
        (F.octet_length("_j") - solid).alias("_wide"),
        (chars - solid).alias("_space"),
        chars.alias("_chars"),
        F.concat(F.lit("|"), F.array_join(common, "||"), F.lit("|")).alias("_c"),
    )
    rest = F.greatest(F.lit(0), F.col("word_chars") - F.col("_upper") - F.col("_digit") - F.col("_point") - F.col("n_symbols") - F.col("_wide"))
    classes = F.array(*[F.coalesce(x.cast("double"), F.lit(0.0)) for x in (rest, F.col("_upper"), F.col("_digit"), F.col("_space"), F.col("_point"), F.col("n_symbols"), F.col("_wide"))])
    counts = [((F.octet_length("_c") - F.octet_length(F.replace(F.col("_c"), F.lit(f"|{w}|"), F.lit("")))) / (len(w) + 2)) for w in COMMON_WORDS]
    df = df.withColumn("_counts", F.array(*counts))
    words = F.concat("_counts", F.array(F.greatest(F.lit(0.0), F.col("n_words") - F.aggregate("_counts", F.lit(0.0), lambda a, x: a + x))))
    return df.select("_id", "_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("_chars"), classes.alias("_chist"), words.alias("_whist"))


def _shares(hist: Column) -> Column:
    total = F.aggregate(hist, F.lit(0.0), lambda a, x: a + x)
    return F.transform(hist, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares of equal length."""

    def part(a, m):
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) / 2))


def references(feats: DataFrame, by: list[str]) -> DataFrame:
    """Summed histograms of all documents with at least MIN_WORDS words, as shares, for each language or in all."""
    sums = [F.sum(F.col("_chist")[i]).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.col("_whist")[i]).alias(f"w{i}") for i in range(len(COMMON_WORDS) + 1)]
    df = feats.filter(F.col("n_words") >= MIN_WORDS).groupBy(*by).agg(*sums)
    c, w = F.array(*[f"c{i}" for i in range(len(CLASSES))]), F.array(*[f"w{i}" for i in range(len(COMMON_WORDS) + 1)])
    return df.select(*by, _shares(c).alias("c"), _shares(w).alias("w"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: id_col, the counts, base_failed, char_distance, word_distance, kept.

    Null and empty texts have no words and fail the base rules; a null language is judged by the whole corpus's
    reference alone; repeated rows are each judged; other columns are not carried; an empty table gives no rows.
    """
    feats = stage_table(features(docs, id_col, text_col, lang_col))
    own = references(feats.filter(F.col("_lang").isNotNull()), ["_lang"]).select(F.col("_lang").alias("_rl"), F.struct("c", "w").alias("_own"))
    every = references(feats, []).select(F.struct("c", "w").alias("_all"))  # one row
    df = feats.join(own, F.col("_lang") == F.col("_rl"), "left").crossJoin(F.broadcast(every))
    df = df.withColumn("_c", _shares(F.col("_chist"))).withColumn("_w", _shares(F.col("_whist")))
    near = lambda k, h: F.least(js_distance(F.col(h), F.col(f"_own.{k}")), js_distance(F.col(h), F.col(f"_all.{k}")))
    df = df.withColumn("char_distance", near("c", "_c")).withColumn("word_distance", near("w", "_w"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    odd = reduce(
        lambda a, b: a | b,
        [
            (F.col("_chars") >= MIN_CHARS_JUDGED) & (F.col("char_distance") > MAX_CHAR_DISTANCE),
            (F.col("n_words") >= MIN_WORDS_JUDGED) & (F.col("word_distance") > MAX_WORD_DISTANCE),
        ],
    )
    return df.withColumn("base_failed", failed).select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "char_distance", "word_distance", (~failed & ~F.coalesce(odd, F.lit(False))).alias("kept"),
    )


def op9_quality_divergence(spark, sf_dir):
    from .common import table

    return judge(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


_COMMON_SQL = "[" + ", ".join(f"'{w}'" for w in COMMON_WORDS) + "]"
_SHARES_SQL = "list_transform({0}, lambda x: CASE WHEN list_sum({0}) > 0 THEN x / list_sum({0}) ELSE 0 END)"
_PART_SQL = "CASE WHEN x[{0}] > 0 THEN x[{0}] * log2(x[{0}] / ((x[1] + x[2]) / 2)) ELSE 0 END"
_JS_SQL = f"sqrt(greatest(0, list_sum(list_transform(list_zip({{0}}, {{1}}), lambda x: {_PART_SQL.format(1)} + {_PART_SQL.format(2)})) / 2))"
_SUMS_SQL = ", ".join(f"sum({h}[{i + 1}])" for h, n in (("ch", len(CLASSES)),) for i in range(n))
_WSUMS_SQL = ", ".join(f"sum(wh[{i + 1}])" for i in range(len(COMMON_WORDS) + 1))
OP9_SQL = rf"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
r AS (SELECT rid, count(DISTINCT p)::BIGINT AS n FROM (SELECT rid, unnest(generate_series(i, i + 7)) AS p FROM (
        SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM (SELECT rid, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 7)) AS i FROM t WHERE len(w) >= 8))) WHERE c > 1) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM t),
b AS (SELECT t.rid, doc_id, lang, len(w)::BIGINT AS n_words, array_to_string(w, '') AS j, len(t) AS chars, w, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
      FROM t JOIN l ON l.rid = t.rid LEFT JOIN r ON r.rid = t.rid),
c AS (SELECT *, len(j)::BIGINT AS word_chars, len(regexp_extract_all(j, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(j, '[A-Z]')) AS up, len(regexp_extract_all(j, '[0-9]')) AS dg,
        len(regexp_extract_all(j, '[.,;:!?''"()\-]')) AS pt, octet_length(encode(j)) - len(j) AS wd, list_transform({_COMMON_SQL}, lambda v: len(list_filter(w, lambda x: x = v))) AS cw FROM b),
h AS MATERIALIZED (SELECT *, list_transform([greatest(0, word_chars - up - dg - pt - n_symbols - wd), up, dg, chars - word_chars, pt, n_symbols, wd], lambda x: x::DOUBLE) AS ch,
        list_transform(list_append(cw, greatest(0, n_words - list_sum(cw))), lambda x: x::DOUBLE) AS wh FROM c),
o AS (SELECT lang, [{_SUMS_SQL}] AS c, [{_WSUMS_SQL}] AS w FROM h WHERE n_words >= {MIN_WORDS} AND lang IS NOT NULL GROUP BY lang),
a AS (SELECT [{_SUMS_SQL}] AS c, [{_WSUMS_SQL}] AS w FROM h WHERE n_words >= {MIN_WORDS}),
s AS (SELECT h.*, {_SHARES_SQL.format("ch")} AS sc, {_SHARES_SQL.format("wh")} AS sw, {_SHARES_SQL.format("o.c")} AS oc, {_SHARES_SQL.format("o.w")} AS ow, {_SHARES_SQL.format("a.c")} AS ac, {_SHARES_SQL.format("a.w")} AS aw, o.lang IS NOT NULL AS known
      FROM h LEFT JOIN o ON o.lang = h.lang CROSS JOIN a),
j AS (SELECT *, least(CASE WHEN known THEN {_JS_SQL.format("sc", "oc")} END, {_JS_SQL.format("sc", "ac")}) AS cd, least(CASE WHEN known THEN {_JS_SQL.format("sw", "ow")} END, {_JS_SQL.format("sw", "aw")}) AS wdist,
        n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce((chars >= {MIN_CHARS_JUDGED} AND cd > {MAX_CHAR_DISTANCE}) OR (n_words >= {MIN_WORDS_JUDGED} AND wdist > {MAX_WORD_DISTANCE}), false) AS kept FROM j
"""
