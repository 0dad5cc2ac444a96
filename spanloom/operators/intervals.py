"""Interval operators: joins on overlap, merging, subtraction, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 2048


def _buckets(df: DataFrame, s: str, e: str, bucket: int) -> DataFrame:
    last = F.greatest(F.col(e) - 1, F.col(s))
    return df.withColumn("_bk", F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor(last / bucket))))


def overlap_join(left: DataFrame, right: DataFrame, book: str = "doc_id", bucket: int = BUCKET, how: str = "inner") -> DataFrame:
    """Pairs of spans (s, e) of the same book that overlap; the right side's columns get the prefix ``r_``.

    Both sides are dealt to fixed buckets of positions; a pair counts in the bucket of its later start only, so no
    distinct is needed. ``how``: inner or left_semi.
    """
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    a, b = _buckets(left, "s", "e", bucket), _buckets(r, "r_s", "r_e", bucket).withColumnRenamed("_bk", "_rbk")
    meet = (F.col(book) == F.col(f"r_{book}")) & (F.col("_bk") == F.col("_rbk")) & (F.col("r_s") < F.col("e")) & (F.col("s") < F.col("r_e"))
    own = F.floor(F.greatest("s", "r_s") / bucket) == F.col("_bk")
    if how == "left_semi":
        return a.join(b, meet & own, "left_semi").drop("_bk")
    return a.join(b, meet & own).drop("_bk", "_rbk", f"r_{book}")


def overlap_layers(target: DataFrame, others: DataFrame, book: str = "doc_id") -> DataFrame:
    """(target's columns, layer) for every layer that a target span touches, each once."""
    return overlap_join(target, others.select(book, "s", "e", "layer"), book).select(*target.columns, F.col("r_layer").alias("layer")).distinct()


def merge_intervals(spans: DataFrame, *keys: str) -> DataFrame:
    """Overlapping or touching spans of a key as one: keys, s, e."""
    order = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = spans.withColumn("_new", (reach.isNull() | (F.col("s") > reach)).cast("int"))
    return starts.withColumn("_isl", F.sum("_new").over(order)).groupBy(*keys, "_isl").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_isl")


def islands(spans: DataFrame, *keys: str) -> DataFrame:
    """``spans`` with ``island``: the number of the group of spans that overlap, in order of s."""
    order = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("_new", (reach.isNull() | (F.col("s") >= reach)).cast("int")).withColumn("island", F.sum("_new").over(order)).drop("_new")


def next_span(spans: DataFrame, *keys: str) -> DataFrame:
    """``spans`` with next_s and next_e: the next span of the key in (s, e) order."""
    order = Window.partitionBy(*keys).orderBy("s", "e")
    return spans.withColumn("_n", F.lead(F.struct("s", "e")).over(order)).select(*spans.columns, F.col("_n.s").alias("next_s"), F.col("_n.e").alias("next_e"))


def trim_overlaps(spans: DataFrame, *keys: str) -> DataFrame:
    """A span that reaches into the next one ends where that starts; its ``action`` says so."""
    nxt = F.lead("s").over(Window.partitionBy(*keys).orderBy("s", "e"))
    cut = F.coalesce(nxt < F.col("e"), F.lit(False))
    out = spans.withColumn("_nxt", nxt).withColumn("_cut", cut)
    out = out.withColumn("action", F.when(F.col("_cut"), F.concat("action", F.lit("|trim_overlap"))).otherwise(F.col("action")))
    return out.withColumn("e", F.when(F.col("_cut"), F.col("_nxt")).otherwise(F.col("e"))).drop("_nxt", "_cut")


def offset_segments(offsets: DataFrame, *keys: str, offset: str = "offset", realigned: Column | None = None) -> DataFrame:
    """keys, n_offset_segments: 1 + the changes of offset along a key's spans; 0 where not realigned."""
    before = F.lag(offset).over(Window.partitionBy(*keys).orderBy("s", "e"))
    change = (before.isNotNull() & (before != F.col(offset))).cast("long")
    counted = offsets.withColumn("_c", change).groupBy(*keys).agg((F.sum("_c") + 1).alias("n_offset_segments"), F.max(realigned if realigned is not None else F.lit(True)).alias("_r"))
    return counted.select(*keys, F.when(F.col("_r"), F.col("n_offset_segments")).otherwise(F.lit(0)).alias("n_offset_segments"))


def assert_no_overlap(spans: DataFrame, *keys: str) -> DataFrame:
    """``spans``; the job fails at a span whose successor starts before its end."""
    nxt = F.lead("s").over(Window.partitionBy(*keys).orderBy("s", "e"))
    message = F.concat(F.lit("spans overlap: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys], F.col("s").cast("string"), F.col("e").cast("string")))
    checked = spans.withColumn("_n", nxt)
    return checked.withColumn("e", F.when(F.col("_n") < F.col("e"), F.raise_error(message).cast("long")).otherwise(F.col("e"))).drop("_n")


def subtract_intervals(low: DataFrame, high: DataFrame, book: str = "doc_id", ident: str = "ann_id") -> DataFrame:
    """The pieces of ``low`` spans outside of ``high`` spans: book, ident (``id``, then ``id#k`` for later pieces), s, e,
    lost (characters of the whole span that high spans took), touched. Swallowed spans have no piece."""
    blockers = merge_intervals(high.select(book, "s", "e"), book)
    base = low.select(book, ident, "s", "e")
    hits = overlap_join(base, blockers, book).select(book, ident, "s", "e", F.greatest("s", "r_s").alias("bs"), F.least("e", "r_e").alias("be"))
    per = hits.groupBy(book, ident, "s", "e").agg(F.array_sort(F.collect_list(F.struct("bs", "be"))).alias("bl"))
    whole = base.join(per, [book, ident, "s", "e"], "left").withColumn("bl", F.coalesce("bl", F.array().cast("array<struct<bs:bigint,be:bigint>>")))
    # gaps between neighbouring blockers, and at both ends
    n = F.size("bl")
    gaps = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.struct(
            F.when(i == 0, F.col("s")).otherwise(F.get("bl", F.greatest(i - 1, F.lit(0)))["be"]).alias("s"),
            F.when(i == n, F.col("e")).otherwise(F.get("bl", F.least(i, n - 1))["bs"]).alias("e"),
        ),
    )
    lost = F.aggregate("bl", F.lit(0).cast("long"), lambda a, x: a + x["be"] - x["bs"])
    pieces = whole.select(book, ident, lost.alias("lost"), (n > 0).alias("touched"), F.posexplode(F.filter(gaps, lambda g: g["e"] > g["s"])).alias("k", "g"))
    name = F.when(F.col("k") == 0, F.col(ident).cast("string")).otherwise(F.concat(F.col(ident).cast("string"), F.lit("#"), F.col("k").cast("string")))
    return pieces.select(book, name.alias(ident), F.col("g.s").alias("s"), F.col("g.e").alias("e"), "lost", "touched")


def apply_precedence(high: DataFrame, low: DataFrame, book: str = "doc_id", high_class: str = "ROOT", low_class: str = "QUOTE") -> DataFrame:
    """All ``high`` spans and what they leave of ``low`` ones, with ``cls``; no overlap may be left."""
    left = subtract_intervals(low, high, book).select(book, "ann_id", "s", "e", F.lit(low_class).alias("cls"))
    both = high.select(book, F.col("ann_id").cast("string").alias("ann_id"), "s", "e", F.lit(high_class).alias("cls")).unionByName(left)
    return assert_no_overlap(both, book)


def precedence_stats(high: DataFrame, low: DataFrame, book: str = "doc_id", tokens: DataFrame | None = None) -> DataFrame:
    """One row: low spans in, touched, clipped, fragmented, dropped, out (pieces), characters lost, and with ``tokens``
    (book, tok_ix, s, e) the tokens that start inside spans of both."""
    pieces = subtract_intervals(low.withColumn("ann_id", F.col("ann_id").cast("string")), high, book)
    own = pieces.withColumn("_id", F.regexp_replace("ann_id", "#[0-9]+$", "")).groupBy(book, "_id").agg(F.count("*").alias("n"))
    blockers = merge_intervals(high.select(book, "s", "e"), book)
    lost = overlap_join(low.select(book, F.col("ann_id").cast("string").alias("_id"), "s", "e"), blockers, book).groupBy(book, "_id").agg(F.sum(F.least("e", "r_e") - F.greatest("s", "r_s")).alias("lost"))
    df = low.select(book, F.col("ann_id").cast("string").alias("_id")).join(own, [book, "_id"], "left").join(lost, [book, "_id"], "left")
    n, t = F.coalesce("n", F.lit(0)), F.col("lost").isNotNull()
    stats = df.agg(
        F.count("*").alias("quote_spans_in"), F.count_if(t).alias("quote_spans_touched"), F.count_if(t & (n > 0)).alias("quote_spans_clipped"),
        F.count_if(t & (n > 1)).alias("quote_spans_fragmented"), F.count_if(t & (n == 0)).alias("quote_spans_dropped"), F.coalesce(F.sum(n), F.lit(0)).alias("quote_spans_out"),
        F.coalesce(F.sum("lost"), F.lit(0)).alias("chars_suppressed"),
    )
    if tokens is None:
        return stats
    from .dataset import tokens_suppressed

    both = tokens_suppressed(tokens, high.select(book, "s", "e"), low.select(book, "s", "e"), book)
    return stats.crossJoin(both.agg(F.count("*").alias("tokens_suppressed")))  # one row each


def merge_adjacent(spans: DataFrame, books: DataFrame, profile, book: str = "doc_id", text: str = "text") -> DataFrame:
    """Neighbours whose gap is punctuation only become one span: book, s, e, n_merged."""
    from ..functions.text import punct_gap
    from .spans import attach_text

    order = Window.partitionBy(book).orderBy("s", "e")
    gaps = spans.select(book, "s", "e").withColumn("gs", F.lag("e").over(order))
    texts = attach_text(gaps.filter("gs <= s").select(book, F.col("gs").alias("_gs"), F.col("s").alias("_ge")).distinct(), books, book, "_gs", "_ge", text, context=0)
    joins = texts.select(F.col(book).alias("_b"), F.col("_gs"), F.col("_ge"), punct_gap(F.col("seg"), profile).alias("_join"))
    flagged = gaps.join(joins, (F.col(book) == F.col("_b")) & (F.col("gs") == F.col("_gs")) & (F.col("s") == F.col("_ge")), "left").select(book, "s", "e", (~F.coalesce("_join", F.lit(False))).cast("int").alias("_new"))
    return flagged.withColumn("_isl", F.sum("_new").over(order)).groupBy(book, "_isl").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n_merged")).drop("_isl")
