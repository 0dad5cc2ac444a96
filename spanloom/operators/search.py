"""Which texts hold which strings: a multi-pattern search over chunks of texts by hashes of windows.

A string's key is a window of it: of the largest width in WIDTHS that it has room for, and of several such windows the one that
occurs least in the texts. Every chunk of a text is scanned once for all widths together: running sums of a polynomial
give the hash of any window, and only windows that some string asks for leave the scan. Where a key occurs, its string may start
so many characters before it; the text there is cut from the chunks and compared by its digest, which stands for the string on its
way, so that strings themselves aren't shuffled with their places. A chunk reaches into the next one
by the widest window, and a string of any length meets only the chunks that it touches, so nothing holds a whole
text or all candidates of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import CHUNK
from .tables import bounded_batches, stage

#: Widths of keys, in characters.
WIDTHS = (*range(1, 13), 16, 24, 32)
#: So many windows (8 bytes each) are broadcast to the texts. Of more, a bitmap goes there, which lets few others pass; what passes meets
#: them by a shuffle.
MAX_BROADCAST_KEYS = 1_000_000
#: Bits of that bitmap at most (64 MB); a window sets one for each of SHIFTS, and there are 10 bits a window up to 50 million of them.
MAX_BITS = 1 << 29
SHIFTS = (0, 17, 34)
_BASE = 0x9E3779B97F4A7C55
_FILTER_BITS = 1 << 22


class Windows:
    """Hashes of all windows of a sequence of code points, of any width."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def load(self, codes: np.ndarray) -> None:
        if len(codes) > len(self.up):
            n = max(len(codes), 2 * len(self.up))
            up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * self.up[: len(codes)], out=self.sums[1:])

    def hashes(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return _mix((self.sums[width:] - self.sums[:n]) * self.down[:n] + np.uint64(width)).view(np.int64) if n > 0 else np.empty(0, np.int64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _string_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n, w, h, off) of the windows of each string (key, nd) that may be its key: side by side, and the last."""
    windows = Windows()
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for i, text in enumerate(b.column(1).to_pylist()):
            codes = _codes(text)
            width = max(w for w in WIDTHS if w <= len(codes))
            windows.load(codes)
            own = windows.hashes(width)
            at = np.unique(np.append(np.arange(0, len(own), width), len(own) - 1))
            for column, value in zip(out, (np.full(len(at), i), np.full(len(at), len(codes)), np.full(len(at), width), own[at], at), strict=True):
                column.append(value)
        flat = [np.concatenate([np.empty(0, np.int64), *c]).astype(np.int64) for c in out]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(flat[0])), *[pa.array(c) for c in flat[1:]]], ["key", "n", "w", "h", "off"])


def _scan(shared):
    """(book, h, pos) of the wanted windows that start in a chunk; rows (book, chunk, piece, tail). With a bitmap in place of the set, of all
    windows that it lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, bitmap, widths = shared.value
        if wanted is not None:
            passing = np.zeros(_FILTER_BITS, bool)
            passing[wanted & (_FILTER_BITS - 1)] = True
        windows = Windows()
        for b in batches:
            pieces, tails = ([x or "" for x in b.column(i).to_pylist()] for i in (2, 3))
            own, whole = np.array([len(x) for x in pieces]), np.array([len(x) + len(y) for x, y in zip(pieces, tails, strict=True)])
            first = np.concatenate(([0], np.cumsum(whole)))
            windows.load(_codes("".join(x + y for x, y in zip(pieces, tails, strict=True))))
            row = np.repeat(np.arange(len(own)), whole)
            place = np.arange(first[-1]) - np.repeat(first[:-1], whole)
            starts = place < np.repeat(own, whole)
            room = np.repeat(whole, whole) - place
            for width in widths:
                h = windows.hashes(width)
                at = np.flatnonzero(starts[: len(h)] & (room[: len(h)] >= width) & (True if wanted is None else passing[h & (_FILTER_BITS - 1)]))
                if wanted is None:
                    for shift in SHIFTS:
                        bit = (h[at] >> shift) & (len(bitmap) * 64 - 1)
                        at = at[(bitmap[bit >> 6] >> (bit & 63)) & 1 == 1]
                else:
                    at = at[wanted[np.minimum(np.searchsorted(wanted, h[at]), len(wanted) - 1)] == h[at]]
                if len(at):
                    pos = b.column(1).to_numpy()[row[at]].astype(np.int64) * CHUNK + place[at]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[at])), pa.array(h[at]), pa.array(pos)], ["_b", "h", "pos"])

    return run


def _bitmap(wanted: DataFrame, n: int) -> np.ndarray:
    """The bits that n windows (h) set, as words of 64; Spark sets them, and the driver gets a row for each word."""
    bits = 64
    while bits < min(10 * n, MAX_BITS):
        bits *= 2
    bit = F.explode(F.array(*[F.shiftright("h", s).bitwiseAND(bits - 1) for s in SHIFTS]))
    words = wanted.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, int(b & 63))")).alias("w")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("i").to_numpy()] = words.column("w").to_numpy()
    return out


def overlapping_chunks(texts: DataFrame, book: str, text: str) -> DataFrame:
    """(_cb, _ck, _piece, _tail): texts in pieces of CHUNK characters, each with the next ones that the widest window may need."""
    cut = f"(?s)(.{{1,{CHUNK}}})(?=(.{{0,{max(WIDTHS) - 1}}}))"
    both = F.arrays_zip(*[F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(cut), F.lit(i)).alias(n) for i, n in ((1, "p"), (2, "t"))])
    cut_up = texts.select(F.col(book).alias("_cb"), F.posexplode(both).alias("_ck", "_x"))
    return cut_up.select("_cb", "_ck", F.col("_x.p").alias("_piece"), F.col("_x.t").alias("_tail"))


def digest(text: Column) -> Column:
    """16 bytes that stand for a text; two texts are taken for equal only if theirs agree."""
    return F.unhex(F.md5(text.cast("binary")))


def holders(strings: DataFrame, texts: DataFrame, book: str = "doc_id", text: str = "text") -> DataFrame:
    """(nd, other), each once: the books whose text holds each of the distinct non-empty ``strings(nd)``. ``texts`` has one row for each
    book; null texts hold nothing; of empty tables nothing is found."""
    kept = stage(strings.filter("nd <> ''").select("nd").distinct())
    return kept.withColumn("key", digest(F.col("nd"))).join(held_keys(kept, texts, book, text), "key").select("nd", "other")


def held_keys(strings: DataFrame, texts: DataFrame, book: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, other), each once: ``holders`` with the digests of the strings in their place."""
    spark = texts.sparkSession
    bounded_batches(spark, rows=2000)
    pieces = stage(overlapping_chunks(texts, book, text))
    own = strings.filter("nd <> ''").select("nd").distinct().select(digest(F.col("nd")).alias("key"), "nd")
    keys = stage(own.mapInArrow(_string_windows, "key binary, n bigint, w bigint, h bigint, off bigint"))
    wanted = stage(keys.select("w", "h").distinct())
    widths = sorted(r["w"] for r in wanted.select("w").distinct().collect())  # at most len(WIDTHS)
    kind = texts.schema[book].dataType.simpleString()
    n = wanted.count()
    few = n <= MAX_BROADCAST_KEYS
    told = np.sort(wanted.select("h").distinct().toArrow().column("h").to_numpy()) if few and widths else None
    shared = spark.sparkContext.broadcast((told, None if few else _bitmap(wanted, n), widths))
    hits = pieces.mapInArrow(_scan(shared), f"_b {kind}, h bigint, pos bigint")
    hits = stage(hits if few else hits.join(wanted.select("h").distinct(), "h", "left_semi"))
    often = hits.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    # a string with a window that no text has is in none
    best = keys.join(often, "h", "left").groupBy("key", "n").agg(F.min_by(F.struct("w", "h", "off"), F.struct(F.coalesce("df", F.lit(0)), "off")).alias("k"), F.min(F.coalesce("df", F.lit(0))).alias("df")).filter("df > 0")
    met = best.select("key", "n", "k.w", "k.h", "k.off").join(hits, "h").select(F.col("_b").alias("other"), "key", (F.col("pos") - F.col("off")).alias("s"), "n", "w").filter("s >= 0")
    # a string has one key, so its places differ; where the key is the whole string, one place of a book is enough
    places = met.filter("n > w").select("other", "key", "s", "n")
    if not keys.filter("n = w").isEmpty():
        places = places.union(met.filter("n = w").groupBy("other", "key", "n").agg(F.min("s").alias("s")).select("other", "key", "s", "n"))
    # texts are dealt out once: a place inside of one chunk is compared where it meets it, the parts of others are put together after
    chunk = lambda at: F.floor(at / CHUNK)
    touched = places.withColumn("_k", F.explode(F.sequence(chunk(F.col("s")), chunk(F.col("s") + F.col("n") - 1))))
    inside = chunk(F.col("s")) == chunk(F.col("s") + F.col("n") - 1)
    begin = F.greatest(F.col("s") - F.col("_k") * CHUNK, F.lit(0))
    part = F.substring("_piece", (begin + 1).cast("int"), (F.least(F.col("s") + F.col("n") - F.col("_k") * CHUNK, F.lit(CHUNK)) - begin).cast("int"))
    parts = touched.join(pieces.drop("_tail"), (F.col("other") == F.col("_cb")) & (F.col("_k") == F.col("_ck"))).select("key", "other", "s", "_k", inside.alias("_in"), part.alias("_p"))
    parts = parts.filter(~F.col("_in") | (digest(F.col("_p")) == F.col("key")))
    parts = parts.select("key", "other", "s", F.when(~F.col("_in"), F.struct("_k", "_p")).alias("_p")).repartition("key", "other")
    whole = parts.groupBy("key", "other", "s").agg(F.array_sort(F.collect_list("_p")).alias("_ps"))
    same = digest(F.array_join(F.transform("_ps", lambda x: x["_p"]), "")) == F.col("key")
    return whole.filter((F.size("_ps") == 0) | same).select("key", "other").distinct()
