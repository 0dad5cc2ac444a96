"""Audits of span layers: coverage, lengths, fragmentation, markers, boundaries, density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.profiles import TIBETAN, Profile
from .intervals import next_span, overlap_layers
from .quantile import exclusive_quantiles, median
from .spans import attach_text


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.try_divide(part * 100.0, whole), digits)


def coverage(books: DataFrame, spans: DataFrame, has_file: Column | None = None, book: str = "doc_id") -> DataFrame:
    """Per batch: books, books with a layer file, books with spans, spans. ``books``: book, batch."""
    n = spans.groupBy(book).agg(F.count("*").alias("_n"))
    df = books.withColumn("_file", has_file if has_file is not None else F.lit(True)).join(n, book, "left")
    return df.groupBy("batch").agg(F.count("*").alias("n_books"), F.count_if("_file").alias("n_file"), F.count_if(F.col("_n") > 0).alias("n_nonempty"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_spans"))


def length_distribution(spans: DataFrame, by: str = "batch") -> DataFrame:
    """Per batch: n, exclusive quantiles, median, max, percent under 15 and over 300."""
    df = spans.withColumn("len", F.col("e") - F.col("s"))
    q = exclusive_quantiles(df, by, "len", (10, 25, 75, 90, 99))
    rest = df.groupBy(by).agg(
        F.max("len").alias("max"),
        percent(F.count_if(F.col("len") < 15), F.count("*")).alias("pct_lt15"), percent(F.count_if(F.col("len") > 300), F.count("*")).alias("pct_gt300"),
    )
    return q.join(median(df, by, "len"), by).join(rest, by).select(by, "n", *[c for c in q.columns if c.startswith("p")], "median", "max", "pct_lt15", "pct_gt300")


def gap_flags(spans: DataFrame, books: DataFrame, profile: Profile = TIBETAN, book: str = "doc_id") -> DataFrame:
    """``spans`` with next_s, next_e and frag_next: the next span follows after punctuation only."""
    nxt = next_span(spans, book)
    gaps = nxt.filter("next_s >= e").select(book, F.col("e").alias("gs"), F.col("next_s").alias("ge")).distinct()
    gaps = attach_text(gaps, books, book, "gs", "ge", context=0).select(F.col(book).alias("_b"), F.col("gs").alias("_gs"), F.col("ge").alias("_ge"), T.punct_gap(F.col("seg"), profile).alias("_p"))
    df = nxt.join(gaps, (F.col(book) == F.col("_b")) & (F.col("e") == F.col("_gs")) & (F.col("next_s") == F.col("_ge")), "left")
    return df.select(*nxt.columns, F.coalesce("_p", F.lit(False)).alias("frag_next"))


def fragmentation(flagged: DataFrame, by: str = "batch") -> DataFrame:
    """Per batch, of all spans: next by punctuation only, of these without a gap, overlapping the next, holding it."""
    return flagged.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count_if("frag_next").alias("n_frag"), percent(F.count_if("frag_next"), F.count("*")).alias("pct_frag"),
        F.count_if(F.col("frag_next") & (F.col("next_s") == F.col("e"))).alias("n_gap0"),
        F.count_if(F.col("next_s") < F.col("e")).alias("n_overlap"),
        F.count_if((F.col("next_s") < F.col("e")) & (F.col("next_e") <= F.col("e"))).alias("n_nested"),
    )


def layer_overlap_pct(target: DataFrame, others: DataFrame, layers: list[str], by: str = "batch", book: str = "doc_id") -> DataFrame:
    """Per batch: percent of target spans that touch each layer, and any. ``target``: book, s, e, batch and a key."""
    hits = overlap_layers(target, others, book)
    per = hits.groupBy(*target.columns).pivot("layer", layers).agg(F.lit(1))
    per = per.groupBy(by).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in layers], F.count("*").alias("_any"))
    total = target.groupBy(by).agg(F.count("*").alias("_n"))
    return total.join(per, by, "left").select(by, *[percent(F.coalesce(x, F.lit(0)), F.col("_n")).alias(f"pct_{x}") for x in layers], percent(F.coalesce("_any", F.lit(0)), F.col("_n")).alias("pct_any"))


def lexical_markers(texts: DataFrame, by: str = "batch", profile: Profile = TIBETAN) -> DataFrame:
    """Per batch, percent of spans that open with an ordinal, close with the particles, end with a shad. ``texts`` has seg."""
    ni, la = T.closes_with(F.col("seg"), profile)
    share = lambda c: percent(F.count_if(c), F.count("*"))
    return texts.groupBy(by).agg(share(T.opens_with_ordinal(F.col("seg"), profile)).alias("pct_ordinal"), share(ni).alias("pct_ni"), share(la).alias("pct_la"), share(T.ends_with_shad(F.col("seg"), profile)).alias("pct_shad"))


def with_boundary_flags(texts: DataFrame, profile: Profile = TIBETAN) -> DataFrame:
    start, end, prev, last = T.boundary_flags(F.col("seg"), F.col("before"), profile)
    return texts.withColumn("dirty_start", ~start).withColumn("dirty_end", ~end).withColumn("char_before", prev).withColumn("char_last", last)


def boundary_report(flagged: DataFrame, by: str = "batch") -> DataFrame:
    """Per batch and for all ("combined"): spans, dirty starts, ends, either."""
    either = F.col("dirty_start") | F.col("dirty_end")
    df = flagged.rollup(by).agg(F.count("*").alias("total"), F.count_if("dirty_start").alias("n_start"), F.count_if("dirty_end").alias("n_end"), F.count_if(either).alias("n_either"))
    return df.withColumn(by, F.coalesce(by, F.lit("combined")))


def dirty_spans(flagged: DataFrame) -> DataFrame:
    return flagged.filter(F.col("dirty_start") | F.col("dirty_end"))


def span_audit(target: DataFrame, others: DataFrame, books: DataFrame, profile: Profile = TIBETAN, book: str = "doc_id") -> DataFrame:
    """A row for each span: length, dirty flags, frag_next, touched layers, preview."""
    flagged = gap_flags(target, books, profile, book)
    texts = with_boundary_flags(attach_text(flagged, books, book), profile)
    hits = overlap_layers(target, others, book).groupBy(book, "s", "e").agg(F.array_join(F.array_sort(F.collect_set("layer")), "|").alias("layers"))
    df = texts.join(hits, [book, "s", "e"], "left")
    return df.select(book, "batch", "s", "e", (F.col("e") - F.col("s")).alias("length"), "dirty_start", "dirty_end", "frag_next", F.coalesce("layers", F.lit("")).alias("layers"), T.preview(F.col("seg")).alias("preview"))


def book_profile(books: DataFrame, spans: DataFrame, others: DataFrame, splits: DataFrame, repeated: DataFrame | None = None, book: str = "doc_id") -> DataFrame:
    """Per book with spans: counts, spans per 100k characters, annotated characters, other layers, split, repeated long spans."""
    own = spans.groupBy(book).agg(F.count("*").alias("n_spans"), F.sum(F.col("e") - F.col("s")).alias("span_chars"))
    rest = others.groupBy(book).agg(F.max((F.col("layer") == "quote").cast("int")).alias("_q"), F.count_if(F.col("layer") == "chapter").alias("_c"))
    df = books.join(own, book).join(rest, book, "left").join(splits.select(book, "split"), book, "left")
    if repeated is not None:
        df = df.join(repeated.groupBy(book).agg(F.count("*").alias("_rep")), book, "left")
    else:
        df = df.withColumn("_rep", F.lit(0))
    per = F.round(F.col("n_spans") * 100000.0 / F.greatest("n_chars", F.lit(1)), 2)
    return df.select(book, "batch", "n_spans", "n_chars", per.alias("per_100k"), "span_chars", (F.coalesce("_q", F.lit(0)) > 0).alias("has_quote"), F.coalesce("_c", F.lit(0)).alias("n_chapter"), F.coalesce("split", F.lit("")).alias("split"), F.coalesce("_rep", F.lit(0)).cast("long").alias("n_long_repeated"))


def density_summary(profiles: DataFrame, by: str = "batch") -> DataFrame:
    """Per batch: books, median and p10 of spans and density, books under 10 spans and under 5 per 100k."""
    counts = exclusive_quantiles(profiles, by, "n_spans", (10,)).withColumnRenamed("p10", "spans_p10")
    dens = exclusive_quantiles(profiles, by, "per_100k", (10,)).select(by, F.round("p10", 4).alias("density_p10"))
    middle = median(profiles, by, "n_spans", "spans_median").join(median(profiles, by, "per_100k").select(by, F.round("median", 4).alias("density_median")), by)
    rest = profiles.groupBy(by).agg(F.count_if(F.col("n_spans") < 10).alias("n_lt10"), F.count_if(F.col("per_100k") < 5).alias("n_lt5"))
    return counts.join(dens, by).join(middle, by).join(rest, by)


def top_syllables(texts: DataFrame, by: str = "batch", k: int = 8, profile: Profile = TIBETAN) -> DataFrame:
    """Per batch and place (first, last): the k commonest syllables of spans, with percent of all spans; ties by syllable."""
    syl = T.syllables(F.col("seg"), profile)
    total = texts.groupBy(by).agg(F.count("*").alias("_n"))
    df = texts.select(by, F.explode(F.array(F.struct(F.lit("first").alias("place"), F.get(syl, F.lit(0)).alias("syl")), F.struct(F.lit("last").alias("place"), F.try_element_at(syl, F.lit(-1)).alias("syl")))).alias("x"))
    counts = df.filter("x.syl IS NOT NULL").groupBy(by, "x.place", "x.syl").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(by, "place").orderBy(F.desc("n"), "syl"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k).join(total, by).select(by, "place", "rank", "syl", "n", percent(F.col("n"), F.col("_n")).alias("pct"))


def books_missing_layer(others: DataFrame, target: DataFrame, layers: list[str], book: str = "doc_id") -> DataFrame:
    """Books with one of ``layers`` but without a target span."""
    return others.filter(F.col("layer").isin(*layers)).select(book).distinct().join(target, book, "left_anti")


def heading_rates(texts: DataFrame, profile: Profile = TIBETAN, book: str = "doc_id") -> DataFrame:
    """book, n, n_heading, heading_rate of spans with their surroundings."""
    like = T.heading_like(F.col("s"), F.col("seg"), F.col("before"), F.col("after"), profile)
    df = texts.groupBy(book).agg(F.count("*").alias("n"), F.count_if(like).alias("n_heading"))
    return df.withColumn("heading_rate", F.col("n_heading") / F.col("n"))
