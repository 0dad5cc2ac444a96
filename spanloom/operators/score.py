"""Scoring predicted spans against gold: candidates by an interval join, one-to-one matching, P/R/F1."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.profiles import TIBETAN, Profile
from .intervals import islands, overlap_join
from .quantile import median
from .tables import stage

#: Islands of overlapping spans that one call of the de-duplication handles.
ISLANDS = 256


def match_candidates(gold: DataFrame, pred: DataFrame, thr: float = 0.5, book: str = "doc_id") -> DataFrame:
    """book, gold_ix, pred_ix, iou of all pairs with IoU >= thr. ``gold``: gold_ix, s, e; ``pred``: pred_ix, s, e."""
    met = overlap_join(gold.select(book, "gold_ix", "s", "e"), pred.select(book, "pred_ix", "s", "e"), book)
    met = met.withColumn("iou", T.iou(F.col("s"), F.col("e"), F.col("r_s"), F.col("r_e"))).filter(F.col("iou") >= thr)
    return met.select(book, "gold_ix", F.col("r_pred_ix").alias("pred_ix"), "iou", "s", "e", F.col("r_s").alias("ps"), F.col("r_e").alias("pe"))


def greedy_match(cands: DataFrame, book: str = "doc_id", keys: tuple[str, ...] = ()) -> DataFrame:
    """The greedy one-to-one matching of candidates in order of (iou, gold_ix, pred_ix), all descending, by rounds: a pair that
    comes first for both of its ends is in the matching, whatever the rest is, and takes its ends' other pairs out. Most pairs are
    decided in the first round; each round sees what the one before left open, of islands of any size."""
    by = [book, *keys]
    out = [*by, "gold_ix", "pred_ix", "iou"]
    gold, pred = Window.partitionBy(*by, "gold_ix"), Window.partitionBy(*by, "pred_ix")
    own = F.struct("iou", "gold_ix", "pred_ix")
    left, rounds = cands.select(*out), []
    while not rounds or not left.isEmpty():
        best = left.withColumn("_g", F.max(own).over(gold) == own).withColumn("_m", F.col("_g") & (F.max(own).over(pred) == own))
        best = best.withColumn("_p", F.max("_m").over(pred))
        marked = stage(best.withColumn("_g", F.max("_m").over(gold)))
        rounds.append(marked.filter("_m").select(*out))
        left = marked.filter("NOT _p AND NOT _g").select(*out)
    return reduce(DataFrame.union, rounds)


def score_spans(books: DataFrame, gold: DataFrame, pred: DataFrame, thr: float = 0.5, book: str = "doc_id") -> DataFrame:
    """Per book: tp, n_pred, n_gold (0 where it has none). Both sides are derived once, into one table that is matched and counted."""
    side = lambda df, ix, is_gold: df.select(book, F.col(ix).alias("ix"), "s", "e", F.lit(is_gold).alias("is_gold"))
    rows = stage(side(gold, "gold_ix", True).union(side(pred, "pred_ix", False)))
    own = lambda ix, where: rows.filter(where).select(book, F.col("ix").alias(ix), "s", "e")
    tp = greedy_match(match_candidates(own("gold_ix", "is_gold"), own("pred_ix", "NOT is_gold"), thr, book), book).groupBy(book).agg(F.count("*").alias("tp"))
    counts = rows.groupBy(book).agg(F.count_if(~F.col("is_gold")).alias("n_pred"), F.count_if("is_gold").alias("n_gold"))
    # columns in the order tp, n_pred, n_gold
    df = books.join(tp, book, "left").join(counts, book, "left")
    return df.fillna(0, ["tp", "n_pred", "n_gold"])


def prf(tp: Column, n_pred: Column, n_gold: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; 0 on empty denominators."""
    zero = F.lit(0.0)
    p, r = F.coalesce(F.try_divide(tp.cast("double"), n_pred), zero), F.coalesce(F.try_divide(tp.cast("double"), n_gold), zero)
    return p, r, F.coalesce(F.try_divide(2 * tp.cast("double"), n_pred + n_gold), zero)


def micro_prf(scores: DataFrame, by: str = "batch") -> DataFrame:
    """By batch and for all: summed counts, fp, fn, precision, recall, F1, predicted per gold."""
    df = scores.rollup(by).agg(*[F.sum(c).alias(c) for c in ("tp", "n_pred", "n_gold")])
    p, r, f1 = prf(F.col("tp"), F.col("n_pred"), F.col("n_gold"))
    over = F.coalesce(F.try_divide(F.col("n_pred").cast("double"), F.col("n_gold")), F.lit(0.0))
    return df.select(F.coalesce(by, F.lit("all")).alias("grp"), "tp", "n_pred", "n_gold", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gold") - F.col("tp")).alias("fn"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), F.round(over, 6).alias("overproposal"))


def median_book_f1(scores: DataFrame) -> DataFrame:
    """One row: the median F1 of books; null without books."""
    f1 = scores.select(F.lit(1).alias("all"), prf(F.col("tp"), F.col("n_pred"), F.col("n_gold"))[2].alias("f1"))
    return median(f1, "all", "f1").agg(F.round(F.max("median"), 6).alias("median_f1"))


def book_ranking(scores: DataFrame, book: str = "doc_id") -> DataFrame:
    """Books by number of false predictions, most first; ties by book."""
    fp = F.col("n_pred") - F.col("tp")
    return scores.withColumn("fp", fp).withColumn("f1", F.round(prf(F.col("tp"), F.col("n_pred"), F.col("n_gold"))[2], 6)).orderBy(F.desc("fp"), book)


def threshold_sweep(gold: DataFrame, pred: DataFrame, thresholds=(0.5, 0.7, 0.9, 1.0), book: str = "doc_id") -> DataFrame:
    """Micro P/R/F1 at each IoU threshold; candidates are joined once, at the least one."""
    cands = match_candidates(gold, pred, min(thresholds), book)
    each = cands.withColumn("thr", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).filter("iou >= thr")
    tp = greedy_match(each, book, ("thr",)).groupBy("thr").agg(F.count("*").alias("tp"))
    sizes = gold.agg(F.count("*").alias("n_gold")).crossJoin(pred.agg(F.count("*").alias("n_pred")))
    grid = sizes.withColumn("thr", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    p, r, f1 = prf(F.col("tp"), F.col("n_pred"), F.col("n_gold"))
    return grid.join(tp, "thr", "left").fillna(0, ["tp"]).select("thr", "tp", "n_pred", "n_gold", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def kept_spans(starts: list[int], ends: list[int], thr: float) -> list[bool]:
    """Which of the spans, in order of (s, e), have no IoU >= thr with one that is kept before."""
    kept: list[tuple[int, int]] = []
    keep = []
    for s, e in zip(starts, ends, strict=True):
        ok = True
        kept = [x for x in kept if x[1] > s]
        for a, b in kept:
            both = min(e, b) - max(s, a)
            if both > 0 and both / ((e - s) + (b - a) - both) >= thr:
                ok = False
                break
        keep.append(ok)
        if ok:
            kept.append((s, e))
    return keep


def _dedupe(frame: pd.DataFrame, thr: float) -> pd.DataFrame:
    frame = frame.sort_values(["s", "e"])
    return frame[kept_spans(frame["s"].tolist(), frame["e"].tolist(), thr)]


def dedupe_spans(spans: DataFrame, thr: float = 0.5, book: str = "doc_id") -> DataFrame:
    """book, s, e, without any other column: in (s, e) order a span goes if its IoU with a kept one is >= thr, and so do all but one of equal
    ones. Only islands of several overlapping spans go to Python. An empty table gives no rows."""
    isl = islands(spans.select(book, "s", "e"), book)
    isl = isl.withColumn("_n", F.count("*").over(Window.partitionBy(book, "island")))
    kind = spans.schema[book].dataType.simpleString()
    many = isl.filter("_n > 1").withColumn("island", F.floor(F.col("island") / ISLANDS)).groupBy(book, "island").applyInPandas(lambda f: _dedupe(f, thr)[[book, "s", "e"]], f"{book} {kind}, s bigint, e bigint")
    return isl.filter("_n = 1").select(book, "s", "e").unionByName(many)


def split_matches(gold: DataFrame, pred: DataFrame, matches: DataFrame, book: str = "doc_id") -> dict[str, DataFrame]:
    """The spans of gold, pred, matched (gold), missed (gold) and false (pred)."""
    missed = gold.join(matches.select(book, "gold_ix"), [book, "gold_ix"], "left_anti")
    return {
        "gold": gold, "predicted": pred,
        "matched": gold.join(matches.select(book, "gold_ix"), [book, "gold_ix"], "left_semi"),
        "missed": missed, "false": pred.join(matches.select(book, "pred_ix"), [book, "pred_ix"], "left_anti"),
    }


def _labelled(parts: dict[str, DataFrame], names, book: str) -> DataFrame:
    out = None
    for n in names:
        x = parts[n].select(book, F.lit(n).alias("kind"), "s", "e")
        out = x if out is None else out.unionByName(x)
    return out


def marker_rates(gold: DataFrame, pred: DataFrame, matches: DataFrame, books: DataFrame, profile: Profile = TIBETAN, book: str = "doc_id") -> DataFrame:
    """Percent of spans that start with an ordinal among gold, predicted, matched, missed and false spans."""
    from .spans import attach_text

    parts = _labelled(split_matches(gold, pred, matches, book), ("gold", "predicted", "matched", "missed", "false"), book)
    spans = attach_text(parts.select(book, "s", "e").distinct(), books, book, context=0).select(F.col(book).alias("_b"), F.col("s").alias("_s"), F.col("e").alias("_e"), T.ordinal_start(F.col("seg"), profile).alias("ordinal"))
    df = parts.join(spans, (F.col(book) == F.col("_b")) & (F.col("s") == F.col("_s")) & (F.col("e") == F.col("_e")))
    return df.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("ordinal").alias("n_ordinal"), F.round(F.count_if("ordinal") * 100.0 / F.count("*"), 2).alias("pct_ordinal"))


def error_rows(gold: DataFrame, pred: DataFrame, matches: DataFrame, books: DataFrame, book: str = "doc_id") -> DataFrame:
    """Missed gold and false predictions with a preview of their text."""
    from .spans import attach_text

    rows = _labelled(split_matches(gold, pred, matches, book), ("missed", "false"), book)
    ids = F.row_number().over(Window.partitionBy(book, "kind", "s", "e").orderBy("s"))
    return attach_text(rows.withColumn("_i", ids), books, book, context=0).select(book, "kind", "s", "e", T.preview(F.col("seg"), 120).alias("text"))


def best_window_per_token(windows: DataFrame, book: str = "doc_id") -> DataFrame:
    """book, window_index, own_from, own_to: the tokens each window owns, i.e. those whose centre is nearest (ties: the
    earlier window). ``windows``: window_index, token_start, token_end. No token is exploded: window i owns up to
    the midpoint of its and its successor's centres, midpoint included."""
    order = Window.partitionBy(book).orderBy("window_index")
    twice = F.col("token_start") + F.col("token_end")  # twice the centre
    nxt = F.lead(twice).over(order)
    own_to = F.least(F.floor((twice + nxt) / 4), F.col("token_end") - 1) + 1
    df = windows.withColumn("own_to", F.coalesce(own_to, F.col("token_end")))
    own_from = F.greatest(F.coalesce(F.lag("own_to").over(order), F.col("token_start")), F.col("token_start"))
    return df.withColumn("own_from", own_from).select(book, "window_index", "own_from", "own_to")
