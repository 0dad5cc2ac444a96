"""Attaching text to spans without carrying whole books: books are cut into chunks, spans meet the chunks they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 4096
CONTEXT = 8


def chunks(books: DataFrame, book: str = "doc_id", text: str = "text", size: int = CHUNK) -> DataFrame:
    """(book, chunk, piece): the text in pieces of ``size`` code points, cut in one pass."""
    pieces = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return books.select(F.col(book).alias("_cb"), F.posexplode(pieces).alias("_ck", "_piece"))


def attach_text(spans: DataFrame, books: DataFrame, book: str = "doc_id", s: str = "s", e: str = "e", text: str = "text", context: int = CONTEXT, size: int = CHUNK) -> DataFrame:
    """``spans`` with ``before``, ``seg`` and ``after``: up to ``context`` code points, the span's text, and as many.

    A span meets only the chunks that it touches; parts of a span over several chunks are put together again.
    Rows must be distinct. Spans outside of their text get empty parts, those of unknown books too.
    """
    return attach_pieces(spans, chunks(books, book, text, size), book, s, e, context, size)


def attach_pieces(spans: DataFrame, pieces: DataFrame, book: str = "doc_id", s: str = "s", e: str = "e", context: int = CONTEXT, size: int = CHUNK) -> DataFrame:
    """attach_text over texts that are cut already: ``pieces(_cb, _ck, _piece)``, as of ``chunks``."""
    lo, hi = F.greatest(F.col(s) - context, F.lit(0)), F.greatest(F.col(e) + context, F.lit(0))
    keys = spans.columns
    touched = spans.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_k", F.explode(F.sequence(F.floor(F.col("_lo") / size), F.floor(F.greatest(F.col("_hi") - 1, F.col("_lo")) / size))))
    met = touched.join(pieces, (F.col(book) == F.col("_cb")) & (F.col("_k") == F.col("_ck")), "left")
    frm = F.greatest(F.col("_lo") - F.col("_k") * size, F.lit(0))
    to = F.least(F.col("_hi") - F.col("_k") * size, F.lit(size))
    part = F.coalesce(F.substring("_piece", (frm + 1).cast("int"), (to - frm).cast("int")), F.lit(""))
    whole = met.select(*keys, "_lo", F.struct(F.col("_k").alias("k"), part.alias("t")).alias("_part")).groupBy(*keys, "_lo").agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    joined = whole.withColumn("_t", F.array_join(F.transform("_parts", lambda x: x["t"]), ""))
    skip = (F.col(s) - F.col("_lo")).cast("int")
    length = (F.col(e) - F.col(s)).cast("int")
    return joined.select(*keys, F.left("_t", skip).alias("before"), F.substring("_t", skip + 1, length).alias("seg"), F.substring("_t", skip + length + 1, F.lit(context)).alias("after"))
