"""URL filters: rules first, then the ratio of two character language models.

The models are smoothed variable-order Markov models of accepted and rejected URLs: every context of up to ORDER
characters that was seen predicts the next one, blended with what the context one shorter predicts by Witten-Bell
weights, (n(context, c) + T * P(c | shorter)) / (n(context) + T) with T the number of different characters seen
after the context. A context that wasn't seen leaves it at the shorter one, and before the empty context all bytes are
equally likely. Counts are exact and kept as a table of windows (context and next character), which grows with the
URLs. Only the windows that are to be scored get a probability, by joins of their shorter and shorter ends with
the counts. A URL is blocked if its length-normalised log-likelihood difference lies on the rejected side of a threshold
that labelled URLs outside training calibrate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage_table

#: Fixed rules: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Longest context; it and the next character are ORDER + 1 bytes, which a long holds.
ORDER = 5
ALPHABET = 256
#: So many scored windows (16 bytes each) are broadcast; with more, URLs meet them by a shuffle, with the same result.
MAX_BROADCAST_WINDOWS = 1_000_000
#: Labelled URLs with this remainder of their hash calibrate, the others train.
CALIBRATION_PART = 5
BINS, RANGE = 800, 4.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*", 0)
    return F.when(at > 0, F.translate(rest, _UPPER, _LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def windows(url: str | None) -> np.ndarray:
    """A number for each byte of a URL and its end mark: the ORDER bytes before it (0 before the start) and itself, from
    high to low. Digits are one symbol."""
    b = np.frombuffer((url or "").encode("utf-8", "replace"), np.uint8).astype(np.int64)
    b[(b >= 48) & (b <= 57)] = 48
    c = np.concatenate((np.zeros(ORDER, np.int64), b, [3]))
    out = np.zeros(len(b) + 1, np.int64)
    for k in range(ORDER + 1):
        out = out << 8 | c[k : k + len(out)]
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the URLs of a batch (url, cls): (w, n0, n1), n0 in accepted ones, n1 in rejected ones."""
    for b in batches:
        codes = [windows(u) for u in b.column(0).to_pylist()]
        if not codes:
            continue
        cls = np.repeat(b.column(1).to_numpy(), [len(c) for c in codes])
        w, at = np.unique(np.concatenate(codes), return_inverse=True)
        n1 = np.bincount(at, weights=cls, minlength=len(w)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(np.bincount(at, minlength=len(w)) - n1), pa.array(n1)], ["w", "n0", "n1"])


def train(labelled: DataFrame) -> DataFrame:
    """The models of ``labelled(url, cls)``, cls 0 accepted, 1 rejected: exact counts (w, n0, n1) of all windows."""
    small_batches(labelled.sparkSession)
    counted = labelled.select("url", F.col("cls").cast("int")).mapInArrow(_counts, "w bigint, n0 bigint, n1 bigint")
    return stage_table(counted.groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


def window_ratios(wanted: DataFrame, model: DataFrame) -> DataFrame:
    """(w, ratio) for the windows ``wanted(w)``: log P(next | context) of the rejected minus that of the accepted model."""
    out = wanted.select("w", *[F.lit(1.0 / ALPHABET).alias(f"p{c}") for c in (0, 1)])
    for k in range(ORDER + 1):
        # the last k + 1 bytes of a window: a context of k bytes and the next one
        own = (1 << 8 * (k + 1)) - 1
        grams = model.groupBy(F.col("w").bitwiseAND(own).alias("g")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        stats = [f(F.col(n)).alias(f"{x}{n}") for n in ("n0", "n1") for x, f in (("s", F.sum), ("t", lambda c: F.sum((c > 0).cast("long"))))]
        contexts = grams.groupBy(F.shiftright("g", 8).alias("h")).agg(*stats)
        gram = F.col("w").bitwiseAND(own)
        out = out.join(contexts, F.shiftright(gram, 8) == F.col("h"), "left").join(grams, gram == F.col("g"), "left")
        blended = [(F.coalesce(F.col(f"n{c}"), F.lit(0)) + F.col(f"tn{c}") * F.col(f"p{c}")) / (F.col(f"sn{c}") + F.col(f"tn{c}")) for c in (0, 1)]
        out = stage_table(out.select("w", *[F.when(F.col(f"sn{c}") > 0, p).otherwise(F.col(f"p{c}")).alias(f"p{c}") for c, p in enumerate(blended)]))
    return out.select("w", (F.log("p1") - F.log("p0")).alias("ratio"))


def _distinct(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.empty(0, np.int64), *map(windows, b.column(0).to_pylist())])))], ["w"])


def _spread(batches):
    for b in batches:
        codes = [windows(u) for u in b.column(1).to_pylist()]
        key = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(key)), pa.array(np.concatenate([np.empty(0, np.int64), *codes]))], ["u", "w"])


def ratios_of(df: DataFrame, model: DataFrame) -> DataFrame:
    """(w, ratio) of all windows of the URLs of ``df`` (with url)."""
    small_batches(df.sparkSession)
    return stage_table(window_ratios(df.select("url").mapInArrow(_distinct, "w bigint").distinct(), model))


def score(df: DataFrame, model: DataFrame, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """``df`` (with url) with ``ratio``: (log P(rejected) - log P(accepted)) per character."""
    return with_ratio(df, ratios_of(df, model), max_broadcast)


def with_ratio(df: DataFrame, ratios: DataFrame, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """``df`` (with url) with ``ratio``, the mean over its windows, which all are in ``ratios``."""
    if ratios.count() > max_broadcast:
        urls = stage_table(df.select(F.coalesce("url", F.lit("")).alias("u")).distinct())
        spread = urls.select("u", F.col("u").alias("url")).mapInArrow(_spread, "u string, w bigint")
        means = spread.join(ratios, "w").groupBy("u").agg(F.avg("ratio").alias("ratio"))
        return df.join(means, F.coalesce("url", F.lit("")) == F.col("u")).drop("u")
    table = ratios.orderBy("w").toArrow()
    shared = df.sparkSession.sparkContext.broadcast((table.column("w").to_numpy(), table.column("ratio").to_numpy()))
    at = df.columns.index("url")

    def run(batches):
        w, ratio = shared.value
        for b in batches:
            codes = [windows(u) for u in b.column(at).to_pylist()]
            if codes:
                size = np.array([len(c) for c in codes])
                found = ratio[np.searchsorted(w, np.concatenate(codes))]
                mean = np.add.reduceat(found, np.concatenate(([0], np.cumsum(size[:-1])))) / size
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(mean)], [*b.schema.names, "ratio"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, ratio double")


def calibrate(scored: DataFrame) -> float:
    """The threshold with the best balanced accuracy on rows (cls, ratio), from histograms of BINS bins; 0 if a class lacks."""
    bin_of = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("ratio") + RANGE) / (2 * RANGE) * BINS)))
    hist = np.zeros((2, BINS))
    for r in scored.groupBy("cls", bin_of.alias("bin")).count().collect():
        hist[r["cls"], r["bin"]] = r["count"]
    if not hist.sum(axis=1).all():
        return 0.0
    share = hist / hist.sum(axis=1, keepdims=True)
    # blocked: bins from i on
    right = np.concatenate(([0], np.cumsum(share[0]))) + 1 - np.concatenate(([0], np.cumsum(share[1])))
    best = np.flatnonzero(right == right.max())
    return float((best.mean()) / BINS * 2 * RANGE - RANGE)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """One row per row of ``pages``: id_col, host, path, rule, verdict, ratio (null where a rule decides).

    Rules decide where one fits; elsewhere a URL is blocked if its ratio exceeds the calibrated threshold. URLs
    under allow rules are the accepted examples, those under block rules the rejected. Without examples of
    rejected (accepted) URLs everything else is allowed (blocked unless neither has examples). A null URL has
    empty host and path and is scored as an empty one; repeated rows are each judged; other columns are not
    carried; an empty table gives no rows.
    """
    url = F.col(url_col)
    host, path = F.coalesce(host_of(url), F.lit("")), F.coalesce(path_of(url), F.lit(""))
    df = pages.select(F.col(id_col).alias("_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    df = df.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules)).select("_id", "url", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("_v"))
    labelled = df.filter(F.col("_v").isNotNull()).select("url", (F.col("_v") == "block").cast("int").alias("cls"))
    part = F.pmod(F.xxhash64("url", F.lit("part")), F.lit(CALIBRATION_PART))
    model = train(labelled.filter(part != 0))
    accepted, rejected = model.agg(F.coalesce(F.sum("n0"), F.lit(0)), F.coalesce(F.sum("n1"), F.lit(0))).first()
    ruled = df.filter(F.col("_v").isNotNull()).select(F.col("_id").alias(id_col), "host", "path", "rule", F.col("_v").alias("verdict"), F.lit(None).cast("double").alias("ratio"))
    rest = df.filter(F.col("_v").isNull())
    if accepted and rejected:
        calibrating = labelled.filter(part == 0)
        ratios = ratios_of(calibrating.select("url").union(rest.select("url")), model)
        threshold = calibrate(with_ratio(calibrating, ratios, max_broadcast))
        rest = with_ratio(rest, ratios, max_broadcast)
        own = F.when(F.col("ratio") > threshold, "block").otherwise("allow")
    else:
        rest = rest.withColumn("ratio", F.lit(None).cast("double"))
        own = F.lit("block" if rejected else "allow")
    return ruled.union(rest.select(F.col("_id").alias(id_col), "host", "path", "rule", own.alias("verdict"), "ratio"))


def op7_url_model_ratio(spark, sf_dir):
    from .common import table

    return judge(table(spark, sf_dir, "pages")).drop("ratio")
