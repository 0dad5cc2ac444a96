"""Cleaning span offsets: re-alignment by anchors, snapping, verdicts."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.profiles import TIBETAN, Profile
from .audit import heading_rates
from .dataset import _row
from .intervals import offset_segments, trim_overlaps
from .sharing import anchors
from .spans import attach_text
from .tables import bounded_batches, stage

SWITCH_COST, REACH = 3.0, 50_000
MIN_HEADING, MIN_GAIN, EXCLUDE_BELOW = 0.60, 0.20, 0.30


def offset_votes(s: np.ndarray, e: np.ndarray, anchor_s: np.ndarray, anchor_e: np.ndarray) -> list[np.ndarray]:
    """For each span the offsets that anchors vote for: those of the span's length, give or take one, within reach. Anchors lie sorted by
    length and start, so that a span meets its own ones only."""
    order = np.lexsort((anchor_s, anchor_e - anchor_s))
    starts, lengths = anchor_s[order], (anchor_e - anchor_s)[order]
    sizes, first = np.unique(lengths, return_index=True)
    ends = np.append(first[1:], len(starts))[: len(first)]
    by_length = {int(n): starts[i:j] for n, i, j in zip(sizes, first, ends, strict=True)}
    votes = []
    for a, n in zip(s.tolist(), (e - s).tolist(), strict=True):
        found = []
        for own in (by_length.get(n + d) for d in (-1, 0, 1)):
            if own is not None:
                found.append(own[np.searchsorted(own, a - REACH) : np.searchsorted(own, a + REACH, side="right")] - a)
        votes.append(np.unique(np.concatenate([np.empty(0, np.int64), *found])).astype(np.int64))
    return votes


def choose_offsets(s: np.ndarray, e: np.ndarray, anchor_s: np.ndarray, anchor_e: np.ndarray) -> np.ndarray:
    """One offset for each span (in order): a span without a vote for its offset costs 1, a change of offset SWITCH_COST, and 0 is
    always allowed. Ties go to the least offset.

    A sparse dynamic programme: an offset is touched only where it is voted for. One that isn't costs 1 more with each span, and
    never more than the cheapest one, a change and 1; the cheapest one's cost rises by 1 at most. So an offset that was
    last touched at span i with cost c costs min(c + j - i, low[j - 1] + SWITCH_COST + 1) at span j, without a look at the spans between.
    """
    votes = offset_votes(s, e, anchor_s, anchor_e)
    if not votes:
        return np.zeros(0, np.int64)
    touches: dict[int, tuple[list[int], list[float]]] = {}
    low: list[float] = []
    lows: list[int] = []  # the cheapest offset at each span
    least, cheapest = 1.0, min([0, *[int(v[0]) for v in votes if len(v)]])  # its cost less the span's number: an offset without a vote costs j + 1

    def cost(offset: int, j: int) -> float:
        if j < 0:
            return 0.0
        at, costs = touches.get(offset, ((), ()))
        k = bisect_right(at, j) - 1
        last, c = (at[k], costs[k]) if k >= 0 else (-1, 0.0)
        return c if last == j else min(c + j - last, low[j - 1] + SWITCH_COST + 1 if j else 1.0)

    for j, voted in enumerate(votes):
        top = low[j - 1] + SWITCH_COST if j else 0.0
        for offset in voted.tolist():
            c = min(cost(offset, j - 1), top)
            at, costs = touches.setdefault(offset, ([], []))
            at.append(j)
            costs.append(c)
            if c - j < least:
                least, cheapest = c - j, offset
            elif c - j == least:
                cheapest = min(cheapest, offset)
        low.append(least + j)
        lows.append(cheapest)
    out = np.zeros(len(votes), np.int64)
    at = lows[-1]
    for j in range(len(votes) - 1, -1, -1):
        out[j] = at
        if j and cost(at, j - 1) > low[j - 1] + SWITCH_COST:
            at = lows[j - 1]
    return out


def realign_offsets(spans: DataFrame, found: DataFrame, book: str = "doc_id") -> DataFrame:
    """book, s, e, offset. ``found``: anchors (book, s, e). A book's offsets and anchors, not texts, meet in a row, and many such rows go to Python
    together: a call for each book would cost more than its work."""
    bounded_batches(spans.sparkSession)
    side = lambda df, own: df.select(book, F.struct(F.col("s").cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e")).alias("_x"), F.lit(own).alias("_own"))
    met = side(spans, True).union(side(found, False)).groupBy(book).agg(F.array_sort(F.collect_list(F.when(F.col("_own"), F.col("_x")))).alias("_sp"), F.collect_list(F.when(~F.col("_own"), F.col("_x"))).alias("_an"))
    arrays = [F.transform(c, lambda x: x[k]).alias(f"{c}{k}") for c in ("_sp", "_an") for k in ("s", "e")]  # noqa: B023

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [[np.empty(0, np.int64)] for _ in range(4)]
            for i, (s, e, anchor_s, anchor_e) in enumerate(zip(*[_row(b.column(k)) for k in range(1, 5)], strict=True)):
                for column, value in zip(columns, (np.full(len(s), i), s, e, choose_offsets(s, e, anchor_s, anchor_e)), strict=True):
                    column.append(value)
            at, *flat = [pa.array(np.concatenate(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), *flat], [book, "s", "e", "offset"])

    return met.filter(F.size("_sp") > 0).select(book, *arrays).mapInArrow(run, f"`{book}` {spans.schema[book].dataType.simpleString()}, s bigint, e bigint, offset bigint")


def low_books(texts: DataFrame, profile: Profile = TIBETAN, book: str = "doc_id") -> DataFrame:
    """Books to re-align: those whose spans (with their surroundings) have a low heading rate."""
    return heading_rates(texts, profile, book).filter(F.col("heading_rate") < MIN_HEADING).select(book)


def accept_realignment(rate_raw: Column, rate_new: Column, in_bounds: Column) -> Column:
    return in_bounds & (rate_new >= MIN_HEADING) & (rate_new - rate_raw >= MIN_GAIN)


def clean_spans(books: DataFrame, spans: DataFrame, profile: Profile = TIBETAN, book: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The cleaned spans (book, ident, raw_s, raw_e, s, e, action, dropped, reason) and the verdicts of books.

    ``books``: book, batch, n_chars, text; ``spans``: book, ident, s, e. Only books with a low heading rate are re-aligned.
    """
    texts = stage(attach_text(spans.select(book, "ident", "s", "e"), books, book))
    raw = heading_rates(texts, profile, book).select(book, F.col("n").alias("n_spans"), F.col("heading_rate").alias("rate_raw"))
    low = stage(raw.filter(F.col("rate_raw") < MIN_HEADING).select(book))
    gated = spans.join(low, book, "left_semi")
    shifts = stage(realign_offsets(gated, anchors(books.join(low, book, "left_semi"), None, profile, book), book))
    moved = gated.join(shifts, [book, "s", "e"]).withColumnRenamed("s", "raw_s").withColumnRenamed("e", "raw_e").select(book, "ident", "raw_s", "raw_e", "offset", (F.col("raw_s") + F.col("offset")).alias("s"), (F.col("raw_e") + F.col("offset")).alias("e"))
    bounds = moved.join(books.select(book, "n_chars"), book).groupBy(book).agg(F.min((F.col("s") >= 0) & (F.col("e") <= F.col("n_chars"))).alias("in_bounds"))
    tried = heading_rates(attach_text(moved.select(book, "ident", "s", "e"), books, book), profile, book).select(book, F.col("heading_rate").alias("rate_try"))
    gate = raw.join(tried, book, "left").join(bounds, book, "left")
    gate = gate.withColumn("realigned", F.coalesce(accept_realignment(F.col("rate_raw"), F.col("rate_try"), F.col("in_bounds")), F.lit(False)))
    gate = stage(gate.withColumn("rate_used", F.when(F.col("realigned"), F.col("rate_try")).otherwise(F.col("rate_raw"))).withColumn("excluded", F.col("rate_used") < EXCLUDE_BELOW))
    base = spans.select(book, "ident", F.col("s").alias("raw_s"), F.col("e").alias("raw_e")).join(gate.select(book, "realigned", "excluded"), book)
    base = base.join(shifts.select(book, F.col("s").alias("raw_s"), F.col("e").alias("raw_e"), "offset"), [book, "raw_s", "raw_e"], "left")
    base = base.withColumn("offset", F.when(F.col("realigned"), F.coalesce("offset", F.lit(0))).otherwise(F.lit(0)).cast("long")).withColumn("s", F.col("raw_s") + F.col("offset")).withColumn("e", F.col("raw_e") + F.col("offset"))
    around = attach_text(base, books, book)
    s, e, act = T.snap_edges(F.col("s"), F.col("e"), F.col("seg"), F.col("before"), F.col("after"), profile)
    snapped = stage(around.withColumn("_s", s).withColumn("_e", e).withColumn("act", act).drop("before", "seg", "after", "s", "e").withColumnRenamed("_s", "s").withColumnRenamed("_e", "e"))
    again = attach_text(snapped, books, book)
    like = T.heading_like(F.col("s"), F.col("seg"), F.col("before"), F.col("after"), profile)
    judged = stage(again.withColumn("bad", F.col("realigned") & (F.col("act") != "") & ~like).withColumn("_like", like).withColumn("action", T.action_string(F.col("offset"), F.col("act"))).drop("before", "seg", "after"))
    final = judged.filter("NOT bad").groupBy(book).agg((F.count_if("_like") / F.count("*")).alias("rate_final"))
    marked = judged.withColumn("dropped", F.col("excluded") | F.col("bad")).withColumn("reason", F.when(F.col("excluded"), "book_excluded_unrecoverable_offsets").when(F.col("bad"), "realigned_span_unverified").otherwise(""))
    cols = [book, "ident", "raw_s", "raw_e", "s", "e", "action", "dropped", "reason"]
    kept = trim_overlaps(marked.filter("NOT dropped").select(*cols), book)
    sidecar = kept.select(*cols).unionByName(marked.filter("dropped").select(*cols))
    segments = offset_segments(judged, book, realigned=F.col("realigned"))
    verdict = F.when(F.col("excluded"), "exclude").when(F.col("realigned"), "realigned").otherwise("keep")
    verdicts = gate.join(final, book, "left").join(segments, book).join(books.select(book, "batch"), book).select(
        book, "batch", "n_spans", F.round("rate_raw", 3).alias("heading_rate_raw"), F.round(F.coalesce("rate_final", F.lit(0.0)), 3).alias("heading_rate_final"), "realigned", F.col("n_offset_segments").cast("long").alias("n_offset_segments"), verdict.alias("verdict")
    )
    return sidecar, verdicts


def clean_totals(sidecar: DataFrame) -> DataFrame:
    """One row: spans, shifted, snapped (nothing unfixed), unfixed, dropped as unverified, trimmed."""
    a = F.col("action")
    unfixed, moved = a.contains("unfixed"), a.rlike(r"start[-_]|end[+_]")
    return sidecar.agg(F.count("*").alias("n_spans"), F.count_if(a.contains("shift")).alias("shifted"), F.count_if(moved & ~unfixed).alias("snapped"), F.count_if(unfixed).alias("unfixed"), F.count_if(F.col("reason") == "realigned_span_unverified").alias("dropped_unverified"), F.count_if(a.contains("trim_overlap")).alias("trimmed"))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """batch, verdict, n; a null batch is one like others, an empty table gives no rows."""
    return verdicts.groupBy("batch", "verdict").agg(F.count("*").alias("n"))


def excluded_books(verdicts: DataFrame, overrides: DataFrame | None = None, book: str = "doc_id") -> DataFrame:
    """book, batch, n_spans, reason, evidence: books whose verdict is exclude, and those in ``overrides(book, recall)``."""
    reason = F.when(F.col("batch") == "old", "offsets_unrecoverable").otherwise("no_heading_like_spans")
    out = verdicts.filter("verdict = 'exclude'").select(book, "batch", "n_spans", reason.alias("reason"), F.format_string("heading_rate=%.3f", "heading_rate_final").alias("evidence"))
    if overrides is None:
        return out
    more = verdicts.filter("verdict <> 'exclude'").join(overrides.select(book, "recall"), book)
    return out.unionByName(more.select(book, "batch", "n_spans", F.lit("under_annotated_body_headings").alias("reason"), F.format_string("titled_heading_recall=%.2f", "recall").alias("evidence")))
